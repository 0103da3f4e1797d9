"""Migration histories: status, reconciliation, divergence, completion, lineage."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions.scalars import is_digest, multiset_digest
from tidewright.operators.graphs import Parts
from tidewright.session import checkpointed


def migration_status(manifest: DataFrame, revisions: DataFrame, history: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """target_id, version, classification, dirty, drift of each migration a target should or does have.

    manifest(target_id, version, position, file, sql_digest), revisions(target_id, version, kind,
    state, attempt, file, sql_digest, plan_digest, to_version, started_at), history(target_id,
    plan_digest, attempt, state). What a target's last valid reversal or reapply leaves behind is
    "reversed". Only drift and unknown revisions outrank recorded states. heads(target_id, manifest_digest, generation):
    of a target's last migration, the revision's manifest_digest and generation are held against them as well.
    """
    tries = history.groupBy("target_id", "plan_digest", "attempt").agg(
        F.bool_or(F.col("state").isin("intended", "uncertain")).alias("open"), F.bool_or(F.col("state") == "confirmed").alias("confirmed")
    )
    r = revisions.join(tries, ["target_id", "plan_digest", "attempt"], "left").withColumn("open", F.coalesce("open", F.lit(False))).withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))
    positions = manifest.select("target_id", F.col("version").alias("to_version"), F.col("position").alias("to_position"))
    controls = r.filter(F.col("kind").isin("reversal", "reapply") & (F.col("state") == "applied") & F.col("confirmed") & ~F.col("open")).join(positions, ["target_id", "to_version"])
    last = controls.groupBy("target_id").agg(F.max_by("to_position", F.struct("started_at", "version")).alias("reversed_to"))
    bound = ["manifest_digest", "generation"] if heads is not None else []
    plain = r.select("target_id", "version", F.struct("kind", "state", "file", "sql_digest", "open", *bound).alias("r"))
    m = manifest.select("target_id", "version", F.struct("position", "file", "sql_digest").alias("m"))
    joined = m.join(plain, ["target_id", "version"], "full_outer").join(last, "target_id", "left").join(controls.select("target_id", "version", F.lit(True).alias("control")).distinct(), ["target_id", "version"], "left")
    drift = F.coalesce((F.col("m.file") != F.col("r.file")) | (F.col("m.sql_digest") != F.col("r.sql_digest")), F.lit(False))
    if heads is not None:
        last_at = manifest.groupBy("target_id").agg(F.max("position").alias("last_at"))
        joined = joined.join(last_at.join(heads.select("target_id", F.struct("manifest_digest", "generation").alias("head")), "target_id"), "target_id", "left")
        other = ~F.struct("r.manifest_digest", "r.generation").eqNullSafe(F.col("head"))
        drift = drift | F.coalesce((F.col("m.position") == F.col("last_at")) & F.col("head").isNotNull() & F.col("r").isNotNull() & other, F.lit(False))
    undone = F.coalesce(F.col("m.position") > F.col("reversed_to"), F.lit(False))
    classification = (
        F.when(F.col("m").isNull(), F.when(F.col("control"), F.col("r.kind")).otherwise("unknown"))
        .when(undone, "reversed")
        .when(F.col("r").isNull(), "pending")
        .when(drift, "drift")
        .otherwise(F.col("r.state"))
    )
    dirty = F.when(F.col("m").isNull(), ~F.coalesce("control", F.lit(False))).when(undone, False).otherwise(F.coalesce(F.col("r.state").isin("failed", "partial") | F.col("r.open"), F.lit(False)))
    return joined.select("target_id", "version", classification.alias("classification"), dirty.alias("dirty"), (F.col("m").isNotNull() & drift).alias("drift"))


def status_counts(status: DataFrame) -> DataFrame:
    """target_id, classification, n, any_dirty, any_drift."""
    w = W.partitionBy("target_id")
    per = status.groupBy("target_id", "classification").agg(F.count("*").alias("n"), F.bool_or("dirty").alias("d"), F.bool_or("drift").alias("f"))
    return per.select("target_id", "classification", "n", F.max("d").over(w).alias("any_dirty"), F.max("f").over(w).alias("any_drift"))


def reconcile_history(expected: DataFrame, executed: DataFrame) -> DataFrame:
    """artifact, step, finding: missing, unexpected, duplicate and unconfirmed steps of executions."""
    e = expected.select("artifact", "step").distinct().withColumn("wanted", F.lit(True))
    x = executed.groupBy("artifact", "step").agg(F.count("*").alias("n"), F.bool_or(F.col("state") == "confirmed").alias("confirmed"))
    finding = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "duplicate").when(~F.col("confirmed"), "unconfirmed")
    return e.join(x, ["artifact", "step"], "full_outer").withColumn("finding", finding).filter("finding is not null").select("artifact", "step", "finding")


#: What a confirmed step has in common with the plan it belongs to.
BOUND = ("step_hash", "phase", "mode", "plan_digest", "bundle_digest")


def reconcile_executions(revisions: DataFrame, expected: DataFrame, executed: DataFrame) -> DataFrame:
    """artifact, attempt, step, finding of executed steps against revisions, by artifact, step and attempt.

    revisions(artifact, attempt, state), expected(artifact, step, and BOUND), executed(artifact, step, attempt, state, and BOUND).
    An attempt of a revision has each expected step once: missing, unexpected, duplicate, unconfirmed, and conflicting if what
    it is bound to differs. A baseline has no executions at all (baseline), and an artifact that no revision names is unbound.
    """
    named = revisions.select("artifact").distinct()
    unbound = executed.join(named, "artifact", "left_anti").select("artifact", "attempt", "step", F.lit("unbound").alias("finding")).distinct()
    baseline = executed.join(revisions.filter("state = 'baseline'").select("artifact").distinct(), "artifact", "left_semi").select("artifact", "attempt", "step", F.lit("baseline").alias("finding")).distinct()
    own = revisions.filter("state <> 'baseline'").select("artifact", "attempt").distinct()
    content = lambda name: F.struct(*[F.col(c) for c in BOUND]).alias(name)
    wanted = own.join(expected.select("artifact", "step", content("wanted")), "artifact")
    seen = executed.join(own, ["artifact", "attempt"], "left_semi").groupBy("artifact", "attempt", "step").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("state") == "confirmed", F.lit(False))).alias("confirmed"), F.min(content("b")).alias("low"), F.max(content("b")).alias("high"))
    joined = wanted.join(seen, ["artifact", "attempt", "step"], "full_outer")
    same = F.col("wanted").eqNullSafe(F.col("low")) & F.col("wanted").eqNullSafe(F.col("high"))
    finding = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "duplicate").when(~F.col("confirmed"), "unconfirmed").when(~same, "conflicting")
    return joined.withColumn("finding", finding).filter("finding is not null").select("artifact", "attempt", "step", "finding").unionByName(baseline).unionByName(unbound)


def first_divergence(findings: dict[str, DataFrame], at: str = "version") -> DataFrame:
    """target_id, version, finding: each target's earliest finding; of one version, the kind listed first."""
    tagged = [df.select("target_id", at, F.lit(kind).alias("finding"), F.lit(i).alias("_rank")) for i, (kind, df) in enumerate(findings.items())]
    union = reduce(DataFrame.unionByName, tagged)
    return union.groupBy("target_id").agg(F.min(F.struct(at, "_rank", "finding")).alias("f")).select("target_id", f"f.{at}", "f.finding")


def completion_proof(steps: DataFrame, events: DataFrame, required: list[str], forbidden: list[str]) -> DataFrame:
    """execution, complete: every step is confirmed in one attempt, each required event is there, no forbidden one.

    steps(execution, step), events(execution, step or null, attempt, type).
    """
    confirmed = events.filter(F.col("type") == "confirmed").groupBy("execution", "step").agg(F.count_distinct("attempt").alias("attempts"))
    per_step = steps.join(confirmed, ["execution", "step"], "left").groupBy("execution").agg(F.bool_and(F.coalesce(F.col("attempts") == 1, F.lit(False))).alias("steps_ok"))
    seen = events.groupBy("execution").agg(F.collect_set(F.when(F.col("type").isin(required), F.col("type"))).alias("seen"), F.bool_or(F.col("type").isin(forbidden)).alias("failed"))
    all_seen = F.size(F.array_except(F.array(*[F.lit(r) for r in required]), "seen")) == 0
    return per_step.join(seen, "execution", "left").select("execution", F.coalesce(F.col("steps_ok") & all_seen & ~F.col("failed"), F.lit(False)).alias("complete"))


def descends_from(manifests: DataFrame, pairs: DataFrame) -> DataFrame:
    """child, ancestor, descends: whether the ancestor's entries are the child's first ones, by chain digest.

    manifests(manifest_id, position, chain_digest), positions from 0; pairs(child, ancestor).
    """
    last = manifests.groupBy(F.col("manifest_id").alias("ancestor")).agg(F.max("position").alias("position"), F.max_by("chain_digest", "position").alias("digest"))
    child = manifests.select(F.col("manifest_id").alias("child"), "position", F.col("chain_digest").alias("own"))
    # sizes are guessed from files here, so that a broadcast could take any number of rows through the driver
    ends = pairs.join(last.hint("merge"), "ancestor").join(child.hint("merge"), ["child", "position"], "left")
    return ends.select("child", "ancestor", F.coalesce(F.col("own") == F.col("digest"), F.lit(False)).alias("descends"))


def changeset(revisions: DataFrame, refs: DataFrame, directory: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, problems) of refs(changeset_id, base, head) in revisions(id, parent; with directory: file).

    Members are what the parents of head reach before base. Problems: a missing head, a parent that is missing, a walk that
    comes back to itself, one that ends without meeting base, and a member whose file lies outside the directory.
    """
    changes = F.col("target_id").alias("changeset_id")
    parents = revisions.filter("parent is not null")
    walks = refs.select(F.col("changeset_id").alias("target_id"), F.col("head").alias("id"), "base")
    start = walks.join(revisions.select("id"), "id", "left_semi")
    # one walk per changeset: its edges stop at its base
    walked = reachable_edges(start, parents)
    member = ~F.col("id").eqNullSafe(F.col("base"))
    known = revisions.select("id", "parent", F.lit(True).alias("known"), F.startswith("file", F.lit(directory.rstrip("/") + "/")).alias("inside") if directory else F.lit(True).alias("inside"))
    looked = walked.join(known, "id", "left").select(changes, F.lit(0).alias("ref"), (~member).alias("met"), (member & F.col("known").isNull()).alias("missing"), (member & F.col("known").isNotNull() & F.col("parent").isNull()).alias("root"), (member & ~F.col("inside")).alias("outside"))
    nothing = [F.lit(None).cast("boolean").alias(name) for name in ("met", "missing", "root", "outside")]
    seen = looked.unionByName(refs.select("changeset_id", F.lit(1).alias("ref"), *nothing)).groupBy("changeset_id")
    # one row for each changeset, found where sizes are measured: guessed ones could take any number of them through the driver
    facts = checkpointed(seen.agg(F.sum("ref").cast("int").alias("refs"), *[F.coalesce(F.bool_or(name), F.lit(False)).alias(name) for name in ("met", "root", "outside")], F.bool_or("missing").alias("missing")))
    why = F.when(F.col("missing"), "missing parent").when(F.col("root"), "head does not descend from base").when(F.col("missing").isNull(), "missing head").otherwise("cycle")
    unmet = facts.filter("not met").select("changeset_id", F.explode(F.array_repeat(why, F.col("refs"))).alias("problem"))
    problems = unmet.unionByName(facts.filter("met and outside").select("changeset_id", F.lit("outside the directory").alias("problem")))
    whole = facts.filter("met and not outside").select("changeset_id")
    return walked.filter(member).select(changes, "id").join(whole.hint("merge"), "changeset_id", "left_semi"), problems


def reachable_edges(start: DataFrame, parents: DataFrame) -> DataFrame:
    """target_id, base, id: start(target_id, id, base) and what its parents reach, no further than base."""
    frontier = checkpointed(start.select("target_id", "base", "id"))
    seen = Parts(frontier)
    while True:
        nxt = frontier.filter(~F.col("id").eqNullSafe(F.col("base"))).join(parents.select("id", "parent"), "id").select("target_id", "base", F.col("parent").alias("id"))
        frontier = checkpointed(nxt.distinct().join(seen.all().select("target_id", "id"), ["target_id", "id"], "left_anti"))
        if frontier.isEmpty():
            return seen.all()
        seen.add(frontier)


def manifest_problems(entries: DataFrame) -> DataFrame:
    """manifest_id, version, problem: parents that are missing, come later or are not the entry before.

    entries(manifest_id, position, version, parents, nonlinear).
    """
    e = entries.select("manifest_id", "position", "version", "nonlinear", F.explode_outer("parents").alias("parent"))
    where = entries.select("manifest_id", F.col("version").alias("parent"), F.col("position").alias("at"))
    problem = (
        F.when(F.col("parent").isNotNull() & F.col("at").isNull(), "missing parent")
        .when(F.col("at") >= F.col("position"), "forward parent")
        .when(~F.coalesce("nonlinear", F.lit(False)) & F.col("at").isNotNull() & (F.col("at") != F.col("position") - 1), "not linear")
    )
    return e.join(where, ["manifest_id", "parent"], "left").withColumn("problem", problem).filter("problem is not null").select("manifest_id", "version", "problem").distinct()


#: What of an entry goes into its chain digest, in this order, and what checkpoints may say of data.
CHAINED = ("version", "file", "sql_digest", "kind", "covered_from", "covered_to", "schema_fingerprint", "data_policy")
DATA_POLICIES = ("schema_only", "declared_replay")


def chain_digests(entries: DataFrame, only: Column | None = None) -> DataFrame:
    """manifest_id, position, version, chain_digest: each entry's digest over its own content and those of all its parents.

    entries: manifest_id, position, the columns of CHAINED, parents (array of versions; none: the entry before), nonlinear.
    A digest is the SHA-256 of the domain, the content, nonlinear, the parents and their digests, sorted; what a parent is
    not known to is "". Nulls count as empty. All entries are folded; with only, the digests of those that it holds for are given.

    An entry waits for its parents, so a manifest is a fold in one task, and manifests are folded side by side: sorted
    entries stream through, and a digest is kept only as long as some later entry has it as a parent, so that a
    manifest of any length needs as much memory as it has open branches. Entries move once, to the task of their manifest.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CHAINED]
    content = F.concat_ws("\0", F.lit("chain"), *text, F.coalesce("nonlinear", F.lit(False)).cast("string"))
    rows = entries.select(
        "manifest_id", F.col("position").cast("long").alias("position"), F.col("version").cast("string").alias("version"), content.alias("content"),
        F.coalesce("parents", F.array()).cast("array<string>").alias("parents"), (F.lit(True) if only is None else F.coalesce(only, F.lit(False))).alias("wanted"),
    ).repartition("manifest_id")
    # an entry meets those that name it as a parent: the first of its names is its own, the others are its parents'
    names = rows.select("*", F.posexplode(F.concat(F.array("version"), "parents")).alias("_i", "_name"))
    own = lambda name: F.when(F.col("_i") == 0, F.col(name)).alias(name)
    named = names.select("manifest_id", "position", "_i", "_name", *[own(name) for name in ("content", "parents", "wanted")])
    last_use = F.max(F.when(F.col("_i") > 0, F.col("position"))).over(W.partitionBy("manifest_id", "_name"))
    kept = named.withColumn("last_use", F.coalesce(last_use, F.lit(-(2**63)))).filter("_i = 0").select("manifest_id", "position", F.col("_name").alias("version"), "content", "parents", "last_use", "wanted")
    ordered, chosen = kept.sortWithinPartitions("manifest_id", "position"), only is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        manifest, begun = None, False
        before: tuple[str, str] | None = None
        known: dict[str, tuple[str, int]] = {}
        for batch in batches:
            values = lambda column: column.to_numpy(zero_copy_only=False).tolist()
            positions, versions, contents, lasts = (values(batch.column(i)) for i in (1, 2, 3, 5))
            counts, parents = values(pc.list_value_length(batch.column(4))), values(batch.column(4).flatten())
            runs = pc.run_end_encode(batch.column(0))
            row = at = 0
            digests = []
            for key, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if not begun or key != manifest:
                    manifest, begun, before, known = key, True, None, {}
                for row in range(row, end):
                    version, position, n = versions[row], positions[row], counts[row]
                    if n:
                        links, at = parents[at : at + n], at + n
                        above = sorted(before[1] if before and v == before[0] else known.get(v, ("",))[0] for v in links)
                        linked = ",".join(links) + "\0" + ",".join(above)
                    else:
                        links, linked = (), "\0".join(before) if before else "\0"
                    digest = hashlib.sha256(f"{contents[row]}\0{linked}".encode()).hexdigest()
                    digests.append(digest)
                    before = (version, digest)
                    if lasts[row] > position:
                        known[version] = (digest, lasts[row])
                    for v in links:
                        if v in known and known[v][1] <= position:
                            del known[v]
                row = end
            found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(digests, pa.string())], ["manifest_id", "position", "version", "chain_digest"])
            yield found.filter(batch.column(6)) if chosen else found

    kind = dict(rows.dtypes)["manifest_id"]
    return ordered.mapInArrow(run, f"manifest_id {kind}, position long, version string, chain_digest string")


def manifest_digests(chained: DataFrame) -> DataFrame:
    """manifest_id, generation, n of chained entries: a mergeable digest of positions, versions and chain digests."""
    row = F.sha2(F.concat_ws("\0", F.col("position").cast("string"), "version", "chain_digest"), 256)
    return chained.select("manifest_id", row.alias("_row")).groupBy("manifest_id").agg(multiset_digest(F.col("_row")).alias("generation"), F.count("*").alias("n"))


def checkpoint_ranges(entries: DataFrame) -> DataFrame:
    """manifest_id, version, first, last: the positions that each valid checkpoint covers; problem, else, is why it is not valid.

    A checkpoint names two entries of its manifest, in order and before itself, a digest of the schema and a policy for data.
    """
    own = entries.filter("kind = 'checkpoint'").select("manifest_id", "version", "position", "covered_from", "covered_to", "schema_fingerprint", "data_policy")
    at = lambda side, place: entries.select("manifest_id", F.col("version").alias(side), F.col("position").alias(place))
    found = own.join(at("covered_from", "first"), ["manifest_id", "covered_from"], "left").join(at("covered_to", "last"), ["manifest_id", "covered_to"], "left")
    problem = (
        F.when(F.col("first").isNull() | F.col("last").isNull(), "unknown range")
        .when(F.col("first") > F.col("last"), "range runs backwards")
        .when(F.col("last") >= F.col("position"), "range is not earlier")
        .when(~is_digest(F.col("schema_fingerprint")), "no schema digest")
        .when(~F.coalesce(F.col("data_policy").isin(*DATA_POLICIES), F.lit(False)), "no data policy")
    )
    return found.select("manifest_id", "version", "first", "last", problem.alias("problem"))


def checkpoint_cover(entries: DataFrame) -> DataFrame:
    """manifest_id, version, covers: how many valid checkpoints cover each entry.

    A range counts up where it begins and down behind its end; the running sum is the cover, so that ranges are never
    spelled out, however many lie over one another.
    """
    valid = checkpoint_ranges(entries).filter("problem is null")
    up = valid.select("manifest_id", F.col("first").alias("position"), F.lit(1).alias("turn"))
    turns = up.unionByName(valid.select("manifest_id", (F.col("last") + 1).alias("position"), F.lit(-1).alias("turn"))).groupBy("manifest_id", "position").agg(F.sum("turn").alias("turn"))
    running = F.sum(F.coalesce("turn", F.lit(0))).over(W.partitionBy("manifest_id").orderBy("position").rowsBetween(W.unboundedPreceding, 0))
    joined = entries.select("manifest_id", "position", "version").join(turns, ["manifest_id", "position"], "left")
    return joined.select("manifest_id", "version", running.alias("covers"))


def entry_problems(entries: DataFrame) -> DataFrame:
    """manifest_id, version, problem: what manifest_problems does not look at.

    Versions and file names (without case) that several entries share, parents of a first entry, parents named twice,
    entries declared nonlinear that are linear, and checkpoints without a valid range.
    """
    one = lambda condition, text: entries.filter(condition).select("manifest_id", "version", F.lit(text).alias("problem"))

    def repeated(key: Column, text: str) -> DataFrame:
        keyed = entries.select("manifest_id", "version", key.alias("_key"))
        many = keyed.groupBy("manifest_id", "_key").agg(F.count("*").alias("_n")).filter("_n > 1")
        return keyed.join(many, ["manifest_id", "_key"]).select("manifest_id", "version", F.lit(text).alias("problem"))

    n = F.coalesce(F.size("parents"), F.lit(0))
    before = entries.select("manifest_id", (F.col("position") + 1).alias("position"), F.col("version").alias("_before"))
    linked = entries.join(before, ["manifest_id", "position"], "left")
    linear = F.when(F.col("position") == 0, n == 0).otherwise((n == 0) | ((n == 1) & (F.get("parents", F.lit(0)) == F.col("_before"))))
    spurious = linked.filter(F.coalesce("nonlinear", F.lit(False)) & F.coalesce(linear, F.lit(False))).select("manifest_id", "version", F.lit("linear, but declared nonlinear").alias("problem"))
    found = [
        repeated(F.col("version"), "version collision"),
        repeated(F.lower("file"), "file collision"),
        one((F.col("position") == 0) & (n > 0), "root has parents"),
        one(n > F.size(F.array_distinct("parents")), "parent named twice"),
        spurious,
        checkpoint_ranges(entries).filter("problem is not null").select("manifest_id", "version", F.concat(F.lit("checkpoint: "), "problem").alias("problem")),
    ]
    return reduce(DataFrame.unionByName, found).distinct()
