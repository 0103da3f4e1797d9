"""Assertions, constraints, uniqueness and fingerprints over tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.scalars import multiset_digest


def assert_max(df: DataFrame, checks: dict[str, tuple[Column, int]]) -> DataFrame:
    """name, observed, maximum, passed: rows per predicate, all predicates counted in one pass."""
    counts = df.agg(*[F.count_if(F.coalesce(p, F.lit(False))).alias(name) for name, (p, _) in checks.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("observed"), F.lit(m).cast("long").alias("maximum")) for n, (_, m) in checks.items()])
    return counts.select(F.inline(rows)).withColumn("passed", F.col("observed") <= F.col("maximum"))


def duplicate_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys without nulls that occur more than once, with their count."""
    known = df.dropna(subset=columns)
    return known.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def uniqueness_evidence(df: DataFrame, columns: list[str]) -> DataFrame:
    """n_rows, n_null, n_duplicate_keys, usable: whether the columns identify rows, measured."""
    per_key = df.groupBy(*columns).agg(F.count("*").alias("n"))
    null = F.greatest(*[F.col(c).isNull() for c in columns]) if len(columns) > 1 else F.col(columns[0]).isNull()
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(null, F.col("n")).otherwise(0)), F.lit(0)).alias("n_null"),
        F.count_if(~null & (F.col("n") > 1)).alias("n_duplicate_keys"),
    ).withColumn("usable", (F.col("n_null") == 0) & (F.col("n_duplicate_keys") == 0))


def row_violations(df: DataFrame, not_null: list[str], checks: dict[str, Column]) -> DataFrame:
    """constraint, violations of not-null and check constraints, in one pass. A check that is null holds."""
    found = {f"not_null:{c}": F.col(c).isNull() for c in not_null} | {f"check:{n}": ~p for n, p in checks.items()}
    names = {f"c{i}": name for i, name in enumerate(found)}
    counts = df.agg(*[F.count_if(F.coalesce(p, F.lit(False))).alias(f"c{i}") for i, p in enumerate(found.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("constraint"), F.col(c).alias("violations")) for c, n in names.items()])
    return counts.select(F.inline(rows))


def foreign_key_violations(child: DataFrame, columns: list[str], parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of child whose columns, all set, have no row in parent."""
    target = parent.select(*[F.col(k).alias(f"_parent_{i}") for i, k in enumerate(keys)])
    on = [F.col(c) == F.col(f"_parent_{i}") for i, c in enumerate(columns)]
    return child.dropna(subset=columns).join(target, on, "left_anti")


def table_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """fingerprint, n_rows: a digest of all rows in any order; repeated rows count. Partial sums are all that moves."""
    row = F.sha2(F.concat_ws("\x1f", *[F.concat(F.when(F.col(c).isNull(), "0").otherwise("1"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]), 256)
    return df.select(row.alias("row")).agg(multiset_digest(F.col("row")).alias("fingerprint"), F.count("*").alias("n_rows"))


def scalar_assert(query: DataFrame, expected: Column) -> DataFrame:
    """rows, passed: the query gives one row and column of the expected type and value; values are not shown."""
    if len(query.columns) != 1:
        raise ValueError("a scalar query has one column")
    value = query.limit(2).withColumnRenamed(query.columns[0], "value")
    kind = query.sparkSession.range(1).select(expected.alias("e")).schema["e"].dataType
    same_type = query.schema.fields[0].dataType == kind
    passed = (F.count("*") == 1) & F.lit(same_type) & F.coalesce(F.bool_and(F.col("value").eqNullSafe(expected)) if same_type else F.lit(False), F.lit(False))
    return value.agg(F.count("*").alias("rows"), passed.alias("passed"))


def bounded(df: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """n_rows, n_bytes, within: whether a table keeps to its limits of rows and JSON bytes."""
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(size), F.lit(0)).alias("n_bytes")).withColumn("within", (F.col("n_rows") <= max_rows) & (F.col("n_bytes") <= max_bytes))


def at_most(df: DataFrame, n: int) -> DataFrame:
    """counted, within: whether a result has at most n rows; no more than n + 1 are made."""
    return df.limit(n + 1).agg(F.count("*").alias("counted")).withColumn("within", F.col("counted") <= n)
