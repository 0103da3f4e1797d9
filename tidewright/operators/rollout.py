"""Fleets of targets: selection, batches, canaries, monitoring and drift incidents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions.scalars import digest, glob


def select_targets(targets: DataFrame, provider: str | None = None, ids: str | None = None, environment: str | None = None, labels: dict[str, str] | None = None) -> DataFrame:
    """Targets by provider, globs on id and environment, and globs on labels, whose keys must exist."""
    if provider is not None:
        targets = targets.filter(F.col("provider") == provider)
    for column, pattern in (("id", ids), ("environment", environment)):
        if pattern is not None:
            targets = targets.filter(glob(F.col(column), pattern))
    for key, pattern in (labels or {}).items():
        targets = targets.filter(F.coalesce(F.map_contains_key("labels", F.lit(key)), F.lit(False)) & glob(F.try_element_at("labels", F.lit(key)), pattern))
    return targets


def union_of_providers(*targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets, duplicates): all providers' targets, and ids that more than one row claims."""
    union = reduce(DataFrame.unionByName, targets)
    return union, union.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def split_active(tenants: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(active, retired, duplicates): only active tenants may not repeat a tenant_id."""
    active, retired = tenants.filter("active"), tenants.filter(~F.coalesce("active", F.lit(False)))
    return active, retired, active.groupBy("tenant_id").agg(F.count("*").alias("n")).filter("n > 1")


def plan_batches(targets: DataFrame, by: list[str], order: str, canary: str, size: str) -> DataFrame:
    """targets with batch: 0 for the first `canary` of a group in order, then runs of `size`."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1
    first = F.when(F.col(canary) > 0, 1).otherwise(0)
    batch = F.when(F.col("_rank") < F.col(canary), 0).otherwise(F.floor((F.col("_rank") - F.col(canary)) / F.col(size)).cast("int") + first)
    return targets.withColumn("_rank", rank).withColumn("batch", batch.cast("int")).drop("_rank")


def canary_outcome(results: DataFrame, by: list[str], order: str, canary: str) -> DataFrame:
    """results(ok, resumed) with state: after the canary, all that follow a failure are skipped.

    resumed: an earlier state; passed and skipped ones are kept, and never count as failures. A
    failure is one of a row that runs; a skipped row does not run, so failures are those before the
    first row that the rule reaches.
    """
    w = W.partitionBy(*by).orderBy(order)
    keeps = F.col("resumed").isin("passed", "skipped")
    marked = results.withColumn("_index", F.row_number().over(w) - 1).withColumn("_keeps", F.coalesce(keeps, F.lit(False)))
    failed = (~F.col("_keeps") & ~F.col("ok")).cast("int")
    earlier = F.coalesce(F.max(failed).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    skips = (F.col(canary) > 0) & (F.col("_index") >= F.col(canary)) & (F.col("_earlier") == 1)
    state = F.when(F.col("_keeps"), F.col("resumed")).when(skips, "skipped").when(F.col("ok"), "passed").otherwise("failed")
    return marked.withColumn("_earlier", earlier).withColumn("state", state).drop("_index", "_keeps", "_earlier")


def rollout_outcome(results: DataFrame, by: list[str]) -> DataFrame:
    """by, status, succeeded: failed if any is, else partial if any was skipped, else passed."""
    status = F.when(F.bool_or(F.col("state") == "failed"), "failed").when(F.bool_or(F.col("state") == "skipped"), "partial").otherwise("passed")
    return results.groupBy(*by).agg(status.alias("status"), F.bool_and(F.col("state") == "passed").alias("succeeded"))


def rollout_replay(events: DataFrame) -> DataFrame:
    """rollout_id, target_id, state, attempts, last_error of events(rollout_id, target_id, seq, type, attempt, reason)."""
    return events.groupBy("rollout_id", "target_id").agg(
        F.max_by("type", "seq").alias("state"), F.max("attempt").alias("attempts"), F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col("seq"))).alias("last_error")
    )


def rollout_status(replayed: DataFrame, targets: DataFrame, environment: str | None = None, drifted_only: bool = False) -> DataFrame:
    """Replayed states with their targets' metadata(target_id, environment, expected_digest, observed_digest) and a drift flag."""
    joined = replayed.join(targets, "target_id").withColumn("drift", ~F.col("expected_digest").eqNullSafe(F.col("observed_digest")))
    if environment is not None:
        joined = joined.filter(F.col("environment") == environment)
    return joined.filter("drift") if drifted_only else joined


def monitor_health(inspections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(checkpoints, alerts) of inspections(target_id, revoked, error, findings, plan_digest, checked_at).

    Revoked targets have a checkpoint and an alert, and nothing else is looked at.
    """
    n = F.coalesce(F.size("findings"), F.lit(0))
    health = F.when(F.col("revoked"), "revoked").when(F.col("error").isNotNull(), "failed").when(n > 0, "drifted").otherwise("healthy")
    checkpoints = inspections.select(
        "target_id", health.alias("health"), F.col("checked_at").alias("last_checked"), F.when(health == "healthy", F.col("checked_at")).alias("last_success"), "plan_digest", "findings"
    )
    kind = F.when(F.col("health") == "revoked", "target_revoked").when(F.col("health") == "failed", "monitor_failed").when(F.col("health") == "drifted", "drift_detected")
    proposal = F.when(F.col("health") == "drifted", F.concat(F.lit("proposal:"), digest("proposal", F.col("target_id"), F.col("plan_digest"), F.array_join("findings", ","))))
    alerts = checkpoints.withColumn("type", kind).filter("type is not null").select("target_id", "type", "health", proposal.alias("proposal_id"), F.col("last_checked").alias("at"))
    return checkpoints.drop("plan_digest", "findings"), alerts


def stale_targets(checkpoints: DataFrame, now: Column, interval_seconds: int) -> DataFrame:
    """Healthy targets whose last success is longer ago than the interval."""
    limit = now - F.make_dt_interval(secs=F.lit(float(interval_seconds)))
    return checkpoints.filter((F.col("health") == "healthy") & (F.col("last_success") < limit))


def drift_incidents(observations: DataFrame, ignored: list[str] | None = None) -> DataFrame:
    """Incidents of observations(target_id, seq, at, signature, resource_id; may have accepted); a null signature is in sync.

    An incident is a target and a signature. It is open from its first observation until the target
    is in sync or, with accepted = true, its state is taken as the baseline, and again when it comes back; then it keeps its
    last resolution. last_seen is its last observation or resolution. remediation: whether its resource is managed, not
    ignored by a glob.
    """
    accepted = F.coalesce("accepted", F.lit(False)) if "accepted" in observations.columns else F.lit(False)
    seen = observations.withColumn("_accepted", accepted)
    # from the last row to the first, what was met last is the next resolution
    w = W.partitionBy("target_id").orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, -1)
    ends = F.when(F.col("signature").isNull() | F.col("_accepted"), F.struct("seq", "at", F.when(F.col("_accepted"), "accepted").otherwise("in_sync").alias("by")))
    drifted = seen.withColumn("next_end", F.last(ends, ignorenulls=True).over(w)).filter("signature is not null and not _accepted")
    is_ignored = reduce(lambda a, b: a | b, [glob(F.col("resource_id"), p) for p in ignored or []], F.lit(False))
    grouped = drifted.groupBy("target_id", "signature").agg(
        F.min_by("at", "seq").alias("first_seen"),
        F.max_by(F.struct("at", "next_end"), "seq").alias("last"),
        F.max("next_end").alias("resolved"),
        F.max_by(~is_ignored, "seq").alias("remediation"),
    )
    is_resolved = F.col("last.next_end").isNotNull()
    return grouped.select(
        "target_id", "signature", "first_seen", F.coalesce("last.next_end.at", "last.at").alias("last_seen"), F.col("resolved.at").alias("resolved_at"), F.col("resolved.by").alias("resolved_by"), F.when(is_resolved, "resolved").otherwise("open").alias("status"), "remediation"
    )


def pending(outbox: DataFrame, finalised: DataFrame, key: str = "id") -> DataFrame:
    """Outbox events that are not finalised yet."""
    return outbox.join(finalised.select(key).distinct(), key, "left_anti")


def undelivered(notifications: DataFrame, delivered: DataFrame, max_attempts: int) -> DataFrame:
    """Distinct notifications(channel, hash, attempts) not delivered before and with attempts left."""
    fresh = notifications.dropDuplicates(["channel", "hash"]).filter(F.col("attempts") < max_attempts)
    return fresh.join(delivered.select("channel", "hash").distinct(), ["channel", "hash"], "left_anti")
