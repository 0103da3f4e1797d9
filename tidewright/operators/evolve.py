"""Evolving columns: version views, backfill, dual writes, and the evidence that both agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.scalars import transform


def version_view(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """A physical table under a version's column names (mapping: exposed name -> physical column)."""
    return df.select(*[F.col(p).alias(n) for n, p in mapping.items()])


def view_is_exact(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """view, position, expected, observed: where an observed view's columns (view, position, name) differ."""
    e = expected.select("view", "position", F.col("name").alias("expected"))
    o = observed.select("view", "position", F.col("name").alias("observed"))
    return e.join(o, ["view", "position"], "full_outer").filter(~F.col("expected").eqNullSafe(F.col("observed")))


def eligible(source: str, dest: str) -> Column:
    """Rows that a backfill still has to fill."""
    return F.col(dest).isNull() & F.col(source).isNotNull()


def backfill(df: DataFrame, source: str, dest: str, forward: str) -> DataFrame:
    """dest filled from source where it is null; running it again changes nothing."""
    return df.withColumn(dest, F.when(eligible(source, dest), transform(F.col(source), forward)).otherwise(F.col(dest)))


def eligible_batch(df: DataFrame, key: str, source: str, dest: str, n: int) -> DataFrame:
    """The first n eligible rows in key order."""
    return df.filter(eligible(source, dest)).orderBy(key).limit(n)


def backfill_progress(df: DataFrame, source: str, dest: str) -> DataFrame:
    """total, processed, remaining rows, and whether the backfill is complete."""
    remaining = F.count_if(eligible(source, dest))
    has_source = F.count_if(F.col(source).isNotNull())
    return df.agg(has_source.alias("total"), (has_source - remaining).alias("processed"), remaining.alias("remaining"), (remaining == 0).alias("complete"))


def equivalence(df: DataFrame, source: str, dest: str, forward: str) -> DataFrame:
    """n_rows, n_different: rows whose new column is not what the old one transforms to."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(~F.col(dest).eqNullSafe(transform(F.col(source), forward))).alias("n_different"))


def shadow_sync(changes: DataFrame, forward: str, reverse: str | None, lossy: bool = False) -> DataFrame:
    """Dual writes of a column pair over change rows.

    changes: op (insert or update), old_old, old_new (images before, for updates), new_old, new_new
    (images written). An insert with one side derives the other; with both, they must agree. On an
    update a side counts only if it changed; if both did they must agree. Writing the new side of
    a pair without a reverse transform is an error. More columns out_old, out_new, error.
    """
    fwd = lambda c: transform(c, forward)
    old, new = F.col("new_old"), F.col("new_new")
    insert = F.col("op") == "insert"
    old_set = F.when(insert, old.isNotNull()).otherwise(~old.eqNullSafe(F.col("old_old")))
    new_set = F.when(insert, new.isNotNull()).otherwise(~new.eqNullSafe(F.col("old_new")))
    conflict = old_set & new_set & ~new.eqNullSafe(fwd(old))
    stuck = new_set & ~old_set & F.lit(reverse is None)
    back = transform(new, reverse) if reverse is not None else F.lit(None).cast("string")
    error = F.when(conflict, "conflict").when(stuck, "not reversible")
    return (
        changes.withColumn("error", error)
        .withColumn("out_old", F.when(F.col("error").isNotNull(), None).when(new_set & ~old_set, back).otherwise(old))
        .withColumn("out_new", F.when(F.col("error").isNotNull(), None).when(old_set & ~new_set, fwd(old)).otherwise(new))
        .withColumn("lossy", F.lit(lossy))
    )


def rollback_eligible(pairs: DataFrame) -> DataFrame:
    """table, eligible: no column pair (table, lossy, reversible) of a table is lossy or one-way."""
    return pairs.groupBy("table").agg(F.bool_and(~F.col("lossy") & F.col("reversible")).alias("eligible"))
