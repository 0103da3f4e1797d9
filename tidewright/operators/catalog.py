"""Catalog snapshots of many targets at once: fingerprints, diffs, renames, closures, order.

resources: target_id, id, kind, name, parent (an id or null), spec (canonical JSON text).
edges: target_id, id, dep (id depends on dep). Every iteration runs all targets together, on a
frontier that only holds what the last round found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions.canonical import canonical_or_text
from tidewright.functions.scalars import digest, glob, multiset_digest
from tidewright.operators import graphs
from tidewright.operators.graphs import in_or_behind_cycles, reachable
from tidewright.session import checkpointed

__all__ = ["in_or_behind_cycles", "reachable"]

#: The kinds that hand access over, the annotation that holds rename hints, and the order of operations.
ACCESS = ("grant", "membership", "default_privilege")
RENAME_HINTS = "rename_hints"
RANK = {"rename": "1", "alter": "1", "create": "2", "drop": "3"}


def resource_fingerprint(resources: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """resources with fp: what a resource means; where it was declared and rename hints do not count.

    Specs, and annotations if there is such a column, count by their canonical JSON. edges(target_id, id, dep; more columns: type)
    are what a resource depends on, in any order; a mergeable digest of them is joined, so that a hub is never gathered.
    """
    parts = [F.col("kind"), F.col("name"), F.col("parent"), canonical_or_text(F.col("spec"))]
    if "annotations" in resources.columns:
        parts.append(canonical_or_text(F.col("annotations")))
    if edges is None:
        return resources.withColumn("fp", digest("resource", *parts))
    kind = F.coalesce("type", F.lit("")) if "type" in edges.columns else F.lit("")
    linked = set_digest(edges.withColumn("_to", F.concat_ws("\0", "dep", kind)).dropDuplicates(["target_id", "id", "_to"]), ["target_id", "id"], F.col("_to"))
    joined = resources.join(linked.select("target_id", "id", F.col("digest").alias("_edges")), ["target_id", "id"], "left")
    return joined.withColumn("fp", digest("resource", *parts, F.col("_edges"))).select(*resources.columns, "fp")


def set_digest(df: DataFrame, by: list[str], member: Column) -> DataFrame:
    """by, digest, n: content address of each group's members in any order."""
    return df.select(*by, F.sha2(member, 256).alias("_row")).groupBy(*by).agg(multiset_digest(F.col("_row")).alias("digest"), F.count("*").alias("n"))


def semantic_fingerprint(resources: DataFrame, edges: DataFrame | None = None, annotations: DataFrame | None = None) -> DataFrame:
    """target_id, digest, n of whole documents: their resources with what these depend on.

    annotations(target_id, key, value) of documents are members too, but for rename hints.
    """
    members = resource_fingerprint(resources, edges).select("target_id", F.concat_ws("=", "id", "fp").alias("member"))
    if annotations is not None:
        notes = annotations.filter(F.col("key") != RENAME_HINTS)
        members = members.unionByName(notes.select("target_id", F.concat_ws("\0", F.lit("annotation"), "key", canonical_or_text(F.col("value"))).alias("member")))
    return set_digest(members, ["target_id"], F.col("member"))


def diff_resources(current: DataFrame, desired: DataFrame, current_edges: DataFrame | None = None, desired_edges: DataFrame | None = None) -> DataFrame:
    """target_id, id, op (create, alter, drop) by fingerprints; specs are not moved for what is equal.

    With both sides' edges a resource that only depends on something else is altered.
    """
    a = resource_fingerprint(current, current_edges).select("target_id", "id", F.col("fp").alias("before"))
    b = resource_fingerprint(desired, desired_edges).select("target_id", "id", F.col("fp").alias("after"))
    op = F.when(F.col("before").isNull(), "create").when(F.col("after").isNull(), "drop").when(F.col("before") != F.col("after"), "alter")
    return a.join(b, ["target_id", "id"], "full_outer").withColumn("op", op).filter("op is not null").select("target_id", "id", "op", "before", "after")


def apply_rename_hints(current: DataFrame, desired: DataFrame, hints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(renames, problems) of hints(target_id, old_name, new_name).

    A side of a hint is an id, a name or kind:name. renames: target_id, old_id, new_id. A hint whose sides are not exactly one dropped and one
    created resource of a kind is a problem, and so are sides with other parents.
    """
    def sides(all_: DataFrame, other: DataFrame, side: str) -> DataFrame:
        """What only one side has, in one row per id, name or kind:name: a name of many resources meets one of many without all their pairs."""
        own = all_.join(other.select("target_id", "id"), ["target_id", "id"], "left_anti")
        keys = F.explode(F.array_distinct(F.array("id", "name", F.concat_ws(":", "kind", "name"))))
        ends = [f(x).alias(f"{side}_{which}_{n}") for n, x in (("parent", F.struct("parent")), ("kind", F.col("kind"))) for which, f in (("low", F.min), ("high", F.max))]
        named = own.select("target_id", keys.alias(f"{side}_name"), "id", "kind", "parent")
        return named.groupBy("target_id", f"{side}_name").agg(F.count_distinct("id").alias(f"n_{side}"), F.min("id").alias(f"{side}_id"), *ends)

    key = ["target_id", "old_name", "new_name"]
    wanted = hints.select(*key).distinct()
    counted = wanted.join(sides(current, desired, "old"), ["target_id", "old_name"], "left").join(sides(desired, current, "new"), ["target_id", "new_name"], "left")
    counted = counted.withColumn("n_old", F.coalesce("n_old", F.lit(0))).withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    low = F.col("old_low_parent")
    same_parent = low.eqNullSafe(F.col("old_high_parent")) & low.eqNullSafe(F.col("new_low_parent")) & low.eqNullSafe(F.col("new_high_parent"))
    kind = F.col("old_low_kind")
    same_kind = (kind == F.col("old_high_kind")) & (kind == F.col("new_low_kind")) & (kind == F.col("new_high_kind"))
    problem = (
        F.when((F.col("n_old") == 0) | (F.col("n_new") == 0), "not found")
        .when((F.col("n_old") > 1) | (F.col("n_new") > 1), "ambiguous")
        .when(~same_parent, "other parent")
        .when(~same_kind, "other kind")
    )
    judged = checkpointed(counted.select(*key, "old_id", "new_id", problem.alias("problem")))
    return judged.filter("problem is null").select("target_id", "old_id", "new_id"), judged.filter("problem is not null").select(*key, "problem")


def propagate_parent_renames(current: DataFrame, desired: DataFrame, renames: DataFrame) -> DataFrame:
    """renames with those of children: same kind and name under a renamed parent, if there is just one of each."""
    known = ["target_id", "old_id", "new_id"]
    found = frontier = checkpointed(renames.select(known).distinct())
    while not frontier.isEmpty():
        old = current.select("target_id", "kind", "name", F.col("parent").alias("old_id"), F.col("id").alias("old_child"))
        new = desired.select("target_id", "kind", "name", F.col("parent").alias("new_id"), F.col("id").alias("new_child"))
        pairs = frontier.join(old, ["target_id", "old_id"]).join(new, ["target_id", "new_id", "kind", "name"]).filter("old_child <> new_child")
        single = pairs.groupBy("target_id", "old_id", "new_id", "kind", "name").agg(F.count("*").alias("n"), F.min("old_child").alias("o"), F.min("new_child").alias("c")).filter("n = 1")
        # a loop of containment comes back to what is known and ends there
        frontier = checkpointed(single.select("target_id", F.col("o").alias("old_id"), F.col("c").alias("new_id")).distinct().join(found, known, "left_anti"))
        found = checkpointed(found.unionByName(frontier))
    return found


def diff_with_renames(current: DataFrame, desired: DataFrame, renames: DataFrame) -> DataFrame:
    """target_id, id, op, old_id: as diff_resources, with renames (and alters) instead of drops and creates."""
    moved = current.join(renames, (current.target_id == renames.target_id) & (current.id == renames.old_id), "left").select(
        current.target_id, F.coalesce("new_id", "id").alias("id"), "kind", "name", "parent", "spec"
    )
    plain = diff_resources(current.join(renames.select("target_id", F.col("old_id").alias("id")), ["target_id", "id"], "left_anti"), desired.join(renames.select("target_id", F.col("new_id").alias("id")), ["target_id", "id"], "left_anti"))
    renamed = renames.select("target_id", F.col("new_id").alias("id"), F.lit("rename").alias("op"), "old_id")
    old_spec = moved.select("target_id", "id", F.col("spec").alias("old_spec"))
    altered = renames.select("target_id", F.col("new_id").alias("id")).join(old_spec, ["target_id", "id"]).join(desired.select("target_id", "id", "spec"), ["target_id", "id"]).filter(~F.col("old_spec").eqNullSafe(F.col("spec")))
    return plain.select("target_id", "id", "op", F.lit(None).cast("string").alias("old_id")).unionByName(renamed).unionByName(altered.select("target_id", "id", F.lit("alter").alias("op"), F.lit(None).cast("string").alias("old_id")))


def select_closure(resources: DataFrame, edges: DataFrame, contains: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """target_id, id: resources that the globs select, by id, name or kind:name.

    Included ones bring what they contain and all their dependencies; excluded ones take all their
    parts and dependents with them, and theirs. contains: target_id, id (the part), dep (the whole).
    """
    def matches(globs: list[str]) -> DataFrame:
        names = [F.col("id"), F.col("name"), F.concat_ws(":", "kind", "name")]
        hit = reduce(lambda a, b: a | b, [glob(n, g) for g in globs for n in names], F.lit(False))
        return resources.filter(hit).select("target_id", "id")

    start = matches(include) if include else resources.select("target_id", "id")
    kept = reachable(reachable(start, contains, forward=False), edges, forward=True)
    if exclude:
        held = edges.select("target_id", "id", "dep").unionByName(contains.select("target_id", "id", "dep"))
        kept = kept.join(reachable(matches(exclude), held, forward=False), ["target_id", "id"], "left_anti")
    return kept


def change_levels(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """target_id, id, level: the longest chain of changes that must come before; edges must have no cycle."""
    nodes = changes.select("target_id", "id").distinct()
    inner = edges.join(nodes, ["target_id", "id"], "left_semi").join(nodes.withColumnRenamed("id", "dep"), ["target_id", "dep"], "left_semi").distinct()
    levels, cyclic = graphs.levels(nodes, inner)
    if not cyclic.isEmpty():
        raise ValueError("no order: the edges have a cycle")
    return levels


def drop_order_edges(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between changes(target_id, id, op): drops go before what they depend on, others after it."""
    a = changes.select("target_id", "id", F.col("op").alias("op"))
    b = changes.select("target_id", F.col("id").alias("dep"))
    e = edges.join(a, ["target_id", "id"]).join(b, ["target_id", "dep"])
    drops = F.col("op") == "drop"
    return e.select("target_id", F.when(drops, F.col("dep")).otherwise(F.col("id")).alias("id"), F.when(drops, F.col("id")).otherwise(F.col("dep")).alias("dep"))


def change_edges(changes: DataFrame, current_edges: DataFrame, desired_edges: DataFrame) -> DataFrame:
    """target_id, id, dep, weight: which changes wait for which, as change ids.

    changes: target_id, change_id, op, before_id, after_id, kind, parent (of the resource after the change, or before a drop).
    An alteration waits for the renaming to the id it alters. Drops come before what the dropped depends on and before its
    parent, all others after these. What is dropped under a parent, but for columns, comes before columns of it are dropped or
    renamed. Grants and the like come after all else that is not dropped, and are dropped before all else is.

    The last two would be edges of all pairs; instead, one side waits for a node of its own (its id begins with \1) and that
    node for the other side, at no weight.
    """
    key, c = "target_id", F.col
    r = changes.withColumn("id", F.coalesce("after_id", "before_id"))
    renamed = changes.filter("op = 'rename'").select(key, c("after_id").alias("before_id"), c("change_id").alias("dep"))
    after_rename = changes.filter("op = 'alter'").join(renamed, [key, "before_id"]).select(key, c("change_id").alias("id"), "dep", F.lit(1).alias("weight"))
    # a resource's change: its alteration, if it is renamed as well
    known = r.select(key, c("id").alias("of"), "op", "change_id").unionByName(r.filter("before_id <> id").select(key, c("before_id").alias("of"), "op", "change_id"))
    owner = known.groupBy(key, "of").agg(F.min_by("change_id", F.struct("op", "change_id")).alias("owner"))
    parents = r.filter("parent is not null").select(key, "change_id", "op", c("parent").alias("of"))
    own = lambda edges, drop: edges.join(r.filter((c("op") == "drop") == F.lit(drop)).select(key, "id", "change_id", "op"), [key, "id"]).select(key, "change_id", "op", c("dep").alias("of"))
    needs = own(current_edges, True).unionByName(own(desired_edges, False)).unionByName(parents).join(owner, [key, "of"]).filter("owner <> change_id")
    drops = c("op") == "drop"
    by_need = needs.select(key, F.when(drops, c("owner")).otherwise(c("change_id")).alias("id"), F.when(drops, c("change_id")).otherwise(c("owner")).alias("dep"), F.lit(1).alias("weight"))

    def barrier(name: Column, waiting: DataFrame, first: DataFrame) -> DataFrame:
        """Edges by which all of `waiting` come after all of `first` with the same name."""
        w, f = waiting.select(key, name.alias("node"), "change_id"), first.select(key, name.alias("node"), "change_id")
        both = w.select(key, "node").distinct().join(f.select(key, "node").distinct(), [key, "node"])
        up = w.join(both, [key, "node"]).select(key, c("change_id").alias("id"), c("node").alias("dep"), F.lit(1).alias("weight"))
        return up.unionByName(f.join(both, [key, "node"]).select(key, c("node").alias("id"), c("change_id").alias("dep"), F.lit(0).alias("weight")))

    column = c("kind") == "column"
    had_parent = changes.filter("parent is not null and before_id is not null")
    columns = barrier(F.concat(F.lit("\1columns:"), "parent"), had_parent.filter(column & c("op").isin("drop", "rename")), had_parent.filter(~column & drops))
    access = c("kind").isin(*ACCESS)
    granted = barrier(F.lit("\1granted"), changes.filter(access & ~drops), changes.filter(~access & ~drops))
    revoked = barrier(F.lit("\1revoked"), changes.filter(~access & drops), changes.filter(access & drops))
    return reduce(DataFrame.unionByName, [after_rename, by_need, columns, granted, revoked]).distinct()


def change_sort_key(op: Column, kind: Column, parent: Column, ordinal: Column, name: Column, change_id: Column) -> Column:
    """What orders changes of a level: operation, kind, parent, a created column's ordinal, name, id."""
    rank = F
    for k, v in RANK.items():
        rank = rank.when(op == k, v)
    place = F.when((op == "create") & (kind == "column") & ordinal.isNotNull(), F.concat(F.lpad(ordinal.cast("string"), 9, "0"), F.lit("\0"))).otherwise("")
    empty = lambda x: F.coalesce(x, F.lit(""))
    return F.concat_ws("\0", rank, empty(kind), empty(parent), F.concat(place, empty(name)), change_id)


def change_order(changes: DataFrame, current_edges: DataFrame, desired_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ordered, cyclic): changes with level and sort_key, and target_id, change_id of those in or behind a cycle.

    changes as for change_edges, with name and ordinal (may be null) as well. By (target_id, level, sort_key) every change
    comes after all that it waits for.
    """
    nodes = changes.select("target_id", F.col("change_id").alias("id"))
    levels, cyclic = graphs.levels(nodes, change_edges(changes, current_edges, desired_edges))
    own = changes.join(levels.withColumnRenamed("id", "change_id"), ["target_id", "change_id"])
    key = change_sort_key(*[F.col(k) for k in ("op", "kind", "parent", "ordinal", "name", "change_id")])
    real = cyclic.withColumnRenamed("id", "change_id").join(changes.select("target_id", "change_id"), ["target_id", "change_id"], "left_semi")
    return own.withColumn("sort_key", key), real


def phases(steps: DataFrame, by: list[str], order: str, mode: str) -> DataFrame:
    """by, phase, mode, first, last, n: maximal runs of steps with the same transaction mode."""
    w = W.partitionBy(*by).orderBy(order)
    starts = (~F.col(mode).eqNullSafe(F.lag(mode).over(w))).cast("int")
    numbered = steps.withColumn("_start", starts).withColumn("phase", F.sum("_start").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "phase").agg(F.first(mode).alias("mode"), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def fk_edges(foreign_keys: DataFrame, tables: DataFrame) -> DataFrame:
    """child, parent, name: entity edges of foreign keys(name, parent, spec) between tables(id, name).

    The referenced table is the spec's target, else referenced_table, else table.
    """
    referenced = F.coalesce(*[F.get_json_object("spec", f"$.{k}") for k in ("target", "referenced_table", "table")])
    child = tables.select(F.col("id").alias("parent"), F.col("name").alias("child"))
    return foreign_keys.withColumn("referenced", referenced).filter("referenced is not null").join(child, "parent").select("child", F.col("referenced").alias("to_table"), "name")


def compose(*documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resources, conflicts) of several sources with target_id, id, fp, source.

    The same definition in several sources is one; other definitions of an id conflict, and both
    sources are named.
    """
    union = reduce(DataFrame.unionByName, documents)
    judged = union.groupBy("target_id", "id").agg(F.min("fp").alias("fp"), F.count_distinct("fp").alias("n"), F.min(F.struct("source", "fp")).alias("one"), F.max(F.struct("source", "fp")).alias("other"), F.sort_array(F.collect_set("source")).alias("sources"))
    return judged.filter("n = 1").select("target_id", "id", "fp", "sources"), judged.filter("n > 1").select("target_id", "id", "sources")


def explode_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resources, edges) of documents(target_id, document): JSON with resources and their dependencies."""
    schema = "struct<resources: array<struct<id: string, kind: string, name: string, dependencies: array<struct<target: string, type: string>>>>>"
    rows = documents.select("target_id", F.explode(F.from_json("document", schema)["resources"]).alias("r"))
    edges = rows.select("target_id", F.col("r.id").alias("id"), F.explode("r.dependencies").alias("d")).select("target_id", "id", F.col("d.target").alias("dep"), F.col("d.type").alias("type"))
    return rows.select("target_id", "r.id", "r.kind", "r.name"), edges
