"""Schema statistics: complexity, thresholds, growth, retention, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.config import Thresholds
from tidewright.functions.scalars import is_digest

#: What a table, an index, a foreign key and an unused index add to the complexity.
WEIGHTS = {"tables": "1.00", "indexes": "0.50", "foreign_keys": "0.75", "unused_indexes": "1.00"}


def complexity(tables: DataFrame, indexes: DataFrame, constraints: DataFrame, by: list[str]) -> DataFrame:
    """by, tables, indexes, constraints, foreign_keys, unused_indexes, max_indexes, total_bytes, dead_rows, score.

    Constraints other than foreign keys add nothing to the score; max_indexes is over known tables.
    """
    t = tables.groupBy(*by).agg(F.count("*").alias("tables"), F.sum("total_bytes").alias("total_bytes"), F.sum("dead_rows").alias("dead_rows"))
    i = indexes.groupBy(*by).agg(F.count("*").alias("indexes"), F.count_if(F.col("scans") == 0).alias("unused_indexes"))
    known = indexes.join(tables.select(*by, F.col("id").alias("table_id")), [*by, "table_id"], "left_semi")
    m = known.groupBy(*by, "table_id").agg(F.count("*").alias("n")).groupBy(*by).agg(F.max("n").alias("max_indexes"))
    k = constraints.groupBy(*by).agg(F.count("*").alias("constraints"), F.count_if(F.lower("kind") == "foreign_key").alias("foreign_keys"))
    names = ["tables", "indexes", "constraints", "foreign_keys", "unused_indexes", "max_indexes", "total_bytes", "dead_rows"]
    joined = t.join(i, by, "left").join(m, by, "left").join(k, by, "left").select(*by, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    score = sum((F.col(n).cast("decimal(18,2)") * F.lit(w).cast("decimal(4,2)") for n, w in WEIGHTS.items()), F.lit(0).cast("decimal(18,2)"))
    return joined.withColumn("score", score.cast("decimal(18,2)"))


def growth(snapshots: DataFrame, target: str = "target_id", at: str = "observed_at", total: str = "total_bytes", schema: str = "schema_digest") -> DataFrame:
    """snapshots with growth: the change of `total` since the target's previous snapshot, if both have one schema digest."""
    w = W.partitionBy(target).orderBy(at)
    same = F.lag(schema).over(w).eqNullSafe(F.col(schema)) & F.lag(at).over(w).isNotNull()
    return snapshots.withColumn("growth", F.when(same, F.col(total) - F.lag(total).over(w)))


def evaluate_thresholds(stats: DataFrame, limits: Thresholds, keep: list[str]) -> DataFrame:
    """keep, code, value, maximum: a row for each limit that is on and strictly exceeded."""
    sources = {"complexity": "score", "dead_rows": "dead_rows", "growth_bytes": "growth", "table_bytes": "total_bytes", "unused_indexes": "unused_indexes"}
    found = []
    for code, column in sources.items():
        limit = getattr(limits, code)
        if limit > 0 and column in stats.columns:
            kind = "decimal(20,2)"
            row = F.struct(F.lit(code).alias("code"), F.col(column).cast(kind).alias("value"), F.lit(limit).cast(kind).alias("maximum"), F.lit("warning").alias("severity"))
            found.append(F.when(F.col(column) > limit, row))
    return stats.select(*keep, F.explode(F.array_compact(F.array(*found))).alias("f")).select(*keep, "f.*")


def retain_snapshots(snapshots: DataFrame, max_age_seconds: int, max_count: int, target: str = "target_id", at: str = "observed_at") -> DataFrame:
    """Each target's snapshots not older than max_age_seconds before its last one, then at most the newest max_count."""
    newest = F.max(at).over(W.partitionBy(target))
    young = snapshots.withColumn("_cutoff", newest - F.make_dt_interval(secs=F.lit(float(max_age_seconds)))).filter(F.col(at) >= F.col("_cutoff")).drop("_cutoff")
    return young.withColumn("_rank", F.row_number().over(W.partitionBy(target).orderBy(F.desc(at)))).filter(F.col("_rank") <= max_count).drop("_rank")


def snapshot_range(snapshots: DataFrame, target, since, until, key: str = "target_id", at: str = "observed_at") -> DataFrame:
    """A target's snapshots of a span of time, both ends included."""
    return snapshots.filter((F.col(key) == target) & F.col(at).between(since, until))


def invalid_records(df: DataFrame, required: list[str], not_negative: list[str], members: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """keep, reason: required values that are missing or blank, negative counters, values outside their set."""
    reasons = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"{c} is required")) for c in required]
    reasons += [F.when(F.col(c) < 0, F.lit(f"{c} is negative")) for c in not_negative]
    reasons += [F.when(~F.coalesce(F.col(c).isin(allowed), F.lit(False)), F.lit(f"{c} is unknown")) for c, allowed in members.items()]
    return df.select(*keep, F.explode(F.array_compact(F.array(*reasons))).alias("reason"))


def inconsistent_records(df: DataFrame, key: list[str], references: dict[str, tuple[DataFrame, str]], digests: list[str]) -> DataFrame:
    """key, reason: keys that repeat, references(column -> (table, its column)) that lead nowhere, digests of another shape.

    Null references lead nowhere on purpose, and null digests have no shape.
    """
    repeated = df.groupBy(*key).agg(F.count("*").alias("_n")).filter("_n > 1").select(*key, F.lit("repeated").alias("reason"))
    found = [repeated]
    for column, (table, to) in references.items():
        known = table.select(F.col(to).alias("_to")).distinct()
        found.append(df.filter(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_to"), "left_anti").select(*key, F.lit(f"{column} leads nowhere").alias("reason")))
    found += [df.filter(F.col(c).isNotNull() & ~is_digest(F.col(c))).select(*key, F.lit(f"{c} is no digest").alias("reason")) for c in digests]
    return reduce(DataFrame.unionByName, found)
