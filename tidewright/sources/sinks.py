"""Writing tables in whole versions, replicas and their staleness."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.config import ManagedTable


class LimitExceeded(ValueError):
    """A table is larger than it may be."""


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _limited(df: DataFrame, max_rows: int | None) -> DataFrame:
    """df, of which a task stops at the row that is one too many for the whole table."""
    if max_rows is None:
        return df
    within_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.filter(F.when(within_task < max_rows, True).otherwise(F.raise_error(F.lit(f"more than {max_rows} rows")).cast("boolean")))


def write_managed(df: DataFrame, table: ManagedTable, root: str, version: str) -> dict[str, int]:
    """write_version under the table's limits of rows and JSON bytes; gives rows and bytes.

    Both are counted by the job that writes. A table beyond a limit leaves neither files nor a pointer, and
    LimitExceeded is raised.
    """
    path, seen = f"{root}/versions/{version}", Observation()
    size = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    counted = _limited(df, table.max_rows).observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    try:
        counted.write.mode("errorifexists").parquet(path)
    except Exception as e:
        if table.max_rows is None or f"more than {table.max_rows} rows" not in str(e):
            raise
        _delete(df.sparkSession, path)
        raise LimitExceeded(f"more than {table.max_rows} rows") from None
    found = {k: int(v) for k, v in seen.get.items()}
    for name, limit in (("rows", table.max_rows), ("bytes", table.max_bytes)):
        if limit is not None and found[name] > limit:
            _delete(df.sparkSession, path)
            raise LimitExceeded(f"{found[name]} {name}, of {limit} at most")
    _point_to(df.sparkSession, root, version)
    return found


def backfill_batch(batch: DataFrame, epoch: int, dest: str, changed_at: str, write, ledger: str) -> None:
    """Writes a filled batch by write(batch) and its measures to the ledger; for foreachBatch.

    epoch, rows, filled, seconds, newest (the latest changed_at): the counts come from the job that writes.
    """
    seen, began = Observation(), time.time()
    write(batch.observe(seen, F.count("*").alias("rows"), F.count(F.col(dest)).alias("filled"), F.max(F.col(changed_at).cast("timestamp")).alias("newest")))
    m = seen.get
    row = (epoch, m["rows"], m["filled"], time.time() - began, m["newest"])
    batch.sparkSession.createDataFrame([row], "epoch long, rows long, filled long, seconds double, newest timestamp").coalesce(1).write.mode("overwrite").parquet(f"{ledger}/epoch_dir={epoch}")


def backfill_rates(ledger: DataFrame, now: Column) -> DataFrame:
    """batches, rows, filled, rows_per_second, lag_seconds (of now behind the newest row) of a ledger of backfill_batch."""
    rate = F.sum("rows") / F.greatest(F.sum("seconds"), F.lit(1e-9))
    lag = F.greatest(F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.max("newest")), F.lit(0))
    return ledger.agg(F.count("*").alias("batches"), F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), rate.alias("rows_per_second"), lag.alias("lag_seconds"))


def write_version(df: DataFrame, root: str, version: str) -> None:
    """A new version of a table, then the pointer to it: readers see the old one or the new one, whole.

    The pointer is a one-row table of its own; a write that fails before it leaves the old version.
    """
    df.write.mode("errorifexists").parquet(f"{root}/versions/{version}")
    _point_to(df.sparkSession, root, version)


def _point_to(spark: SparkSession, root: str, version: str) -> None:
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").json(f"{root}/pointers")


def write_ordered(df: DataFrame, path: str, keys: list[str]) -> None:
    """df in order of keys over all its files: ranges are dealt to tasks, each sorts its own, and files are named in that order.

    Ties of the keys should be none, or their order is open.
    """
    df.orderBy(*keys).write.mode("errorifexists").parquet(path)


def read_in_order(spark: SparkSession, path: str) -> DataFrame:
    """The rows of write_ordered with place, their number from 0: files by name, rows as they are in them."""
    rows = spark.read.parquet(path).select("*", "_metadata.file_name", "_metadata.row_index")
    sizes = rows.groupBy("file_name").agg(F.count("*").alias("n"))
    # a row for each file
    w = W.orderBy("file_name").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("file_name", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return rows.join(before, "file_name").withColumn("place", F.col("before") + F.col("row_index")).drop("before", "file_name", "row_index")


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The version that was pointed to last; versions order as text."""
    current = spark.read.schema("version string").json(f"{root}/pointers").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{root}/versions/{current}")


def replicate(records: DataFrame, replicated_at: Column) -> DataFrame:
    """records(digest, created_at) with replicated_at and lag_seconds; a clock ahead of time lags 0."""
    lag = F.greatest(F.unix_timestamp(replicated_at.cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp")), F.lit(0))
    return records.withColumn("replicated_at", replicated_at).withColumn("lag_seconds", lag)


def read_with_fallback(primary: DataFrame, backup: DataFrame, now: Column, max_staleness_seconds: int) -> DataFrame:
    """Primary records, and those that only the backup has and that are fresh enough; more column origin."""
    fresh = backup.filter(F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("replicated_at").cast("timestamp")) <= max_staleness_seconds)
    rest = fresh.join(primary.select("digest").distinct(), "digest", "left_anti").select(*primary.columns)
    return primary.withColumn("origin", F.lit("primary")).unionByName(rest.withColumn("origin", F.lit("backup")))


def staleness_report(copies: DataFrame, now: Column, limit_seconds: int) -> DataFrame:
    """digest, age_seconds, within: age of each recoverable copy; a limit of 0 or less is none."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("replicated_at").cast("timestamp"))
    return copies.select("digest", age.alias("age_seconds"), (F.lit(limit_seconds <= 0) | (age <= limit_seconds)).alias("within"))
