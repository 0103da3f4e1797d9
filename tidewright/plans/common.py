"""What the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Queries by name, with the DuckDB SQL that gives the same rows."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def register(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return register


def multiset_digest_sql(row: str) -> str:
    """DuckDB's expression of functions.scalars.multiset_digest over SHA-256 digests."""
    lanes = ", ".join(f"coalesce(sum(CAST('0x' || substr({row}, {1 + 15 * i}, 15) AS BIGINT)), 0)" for i in range(4))
    return f"sha256(concat_ws(',', count(*), {lanes}))"
