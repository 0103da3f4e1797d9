"""Rows from files, with declared schemas and limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Records of JSON files: an array of objects, or one object; what is not an object is dropped."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    files = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    is_kind = lambda c, name: F.schema_of_variant(c).like(f"{name}%")
    records = files.select(F.explode(F.when(is_kind(F.col("v"), "ARRAY"), F.col("v").try_cast("array<variant>")).otherwise(F.array("v"))).alias("v"))
    return records.filter(is_kind(F.col("v"), "OBJECT")).select(F.from_json(F.to_json("v"), kind).alias("r")).select("r.*")


def headers(spark: SparkSession, path: str) -> list[list[str]]:
    """The names in the first line of each CSV file, without blanks and quotes around them; those of equal files once, at most two."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    first = lines.filter("file_block_start = 0").groupBy("file_path").agg(F.min_by("value", "at").alias("line"))
    # commas outside quotes; a header is one line
    names = F.transform(F.split("line", ',(?=(?:[^"]*"[^"]*")*+[^"]*$)'), lambda n: F.regexp_replace(F.regexp_replace(n, r"^\s+|\s+$", ""), '^"+|"+$', ""))
    return [r[0] for r in first.select(names.alias("names")).distinct().limit(2).collect()]


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of CSV files with a header, whose names may have blanks around them.

    A row of another width, a value that does not fit its type, or a file with another header, is
    an error; empty is null.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    for names in headers(spark, path) or [[]]:
        if names != kind.names:
            raise ValueError(f"the header has {names}, declared are {kind.names}")
    return spark.read.schema(kind).csv(path, header=True, mode="FAILFAST", nullValue="", escape='"', enforceSchema=True)


def read_csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files, each cell typed alone: bool first (1, 0, t and f too), integer, number, else text, as VARIANT.

    Files with different headers are an error.
    """
    found = headers(spark, path)
    if len(found) > 1:
        raise ValueError(f"files have different headers: {found[0]} and {found[1]}")
    rows = spark.read.csv(path, header=True, mode="FAILFAST", nullValue="", escape='"')

    def cell(name: str):
        c = F.col(f"`{name}`")
        true, false = F.lower(c).isin("1", "t", "true"), F.lower(c).isin("0", "f", "false")
        text = F.when(true, "true").when(false, "false").when(c.try_cast("bigint").isNotNull(), c.try_cast("bigint").cast("string"))
        number = c.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")
        return F.parse_json(F.coalesce(text, F.when(number, c), F.when(c.isNotNull(), F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)))).alias(name.strip())

    return rows.select(*[cell(n) for n in rows.columns])


def read_yaml(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of YAML files (a list of mappings, or one); files are dealt to tasks and parsed there."""
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            for content in batch["content"]:
                loaded = yaml.safe_load(content)
                records = [r for r in (loaded if isinstance(loaded, list) else [loaded]) if isinstance(r, dict)]
                yield pd.DataFrame([[r.get(n) for n in names] for r in records], columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def verify_digests(files: DataFrame, locks: DataFrame) -> DataFrame:
    """path, status of files(path, content) against locks(path, digest): verified, changed, unlocked or missing."""
    found = files.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("actual"))
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("digest").isNull(), "unlocked").when(F.col("actual") == F.col("digest"), "verified").otherwise("changed")
    return found.join(locks.select("path", "digest"), "path", "full_outer").select("path", status.alias("status"))


def catalog_columns(spark: SparkSession, url: str, properties: dict[str, str]) -> DataFrame:
    """target columns of a database's information schema as resources, read over JDBC."""
    query = "(select table_schema, table_name, column_name, data_type, is_nullable from information_schema.columns) as c"
    rows = spark.read.jdbc(url, query, properties=properties)
    return columns_as_resources(rows)


def columns_as_resources(rows: DataFrame) -> DataFrame:
    """id, kind, name, parent, spec of captured catalog columns."""
    parent = F.concat_ws(".", "table_schema", "table_name")
    spec = F.to_json(F.struct(F.col("data_type").alias("type"), (F.col("is_nullable") == "YES").alias("nullable")))
    return rows.select(F.concat(F.lit("column:"), parent, F.lit("."), "column_name").alias("id"), F.lit("column").alias("kind"), F.concat_ws(".", parent, "column_name").alias("name"), F.concat(F.lit("table:"), parent).alias("parent"), spec.alias("spec"))
