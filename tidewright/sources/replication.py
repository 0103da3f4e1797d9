"""Replicas of content-addressed objects: copied by executors, verified, and known by a manifest that is written last.

A destination holds objects (digest, created_at, bytes, content) in one folder for each copy, and manifests (digest,
created_at, replicated_at, bytes, copy) likewise. What no manifest names was never replicated: a copy that was torn is not seen by
readers and does not stand in the way of the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "digest string, created_at timestamp, replicated_at timestamp, bytes long, copy string"
OBJECTS = "digest string, created_at timestamp, bytes long, content binary, copy string"


def content_digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def objects_of_files(spark: SparkSession, path: str) -> DataFrame:
    """digest, created_at, content, path of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(content_digest(F.col("content")).alias("digest"), F.col("modificationTime").alias("created_at"), "content", "path")


def manifest(spark: SparkSession, destination: str) -> DataFrame:
    """The entries of all finished copies; an object is there once, with its first replication."""
    try:
        entries = spark.read.schema(MANIFEST).parquet(f"{destination}/manifests")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)
    return entries.groupBy("digest").agg(F.min(F.struct("replicated_at", "created_at", "bytes", "copy")).alias("e")).select("digest", "e.created_at", "e.replicated_at", "e.bytes", "e.copy")


def replicate(objects: DataFrame, destination: str, copy: str, replicated_at: Column) -> DataFrame:
    """Copies objects(digest, created_at, content) that the destination does not have yet; gives the new manifest entries.

    Content whose digest is another one ends the copy, and so does a copy that does not read back as it was written; neither
    leaves a manifest. Copying the same objects again copies nothing. A copy's name is used once.
    """
    spark = objects.sparkSession
    fresh = objects.join(manifest(spark, destination).select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
    sound = F.when(content_digest(F.col("content")) == F.col("digest"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("other content under "), "digest")).cast("binary"))
    rows = fresh.select("digest", F.col("created_at").cast("timestamp").alias("created_at"), F.octet_length("content").cast("long").alias("bytes"), sound.alias("content"))
    rows.write.mode("errorifexists").parquet(f"{destination}/objects/copy={copy}")
    written = spark.read.parquet(f"{destination}/objects/copy={copy}")
    checked = F.when(content_digest(F.col("content")) == F.col("digest"), F.col("bytes")).otherwise(F.raise_error(F.lit("the copy does not read back")).cast("long"))
    entries = written.select("digest", "created_at", replicated_at.cast("timestamp").alias("replicated_at"), checked.alias("bytes"))
    entries.write.mode("errorifexists").parquet(f"{destination}/manifests/copy={copy}")
    return spark.read.parquet(f"{destination}/manifests/copy={copy}").withColumn("copy", F.lit(copy))


def replicas(spark: SparkSession, destination: str) -> DataFrame:
    """The objects that the manifest names."""
    named = manifest(spark, destination).select("digest", "copy", "replicated_at")
    return spark.read.schema(OBJECTS).parquet(f"{destination}/objects").join(named, ["digest", "copy"])


def verify(spark: SparkSession, destination: str) -> DataFrame:
    """digest, problem: objects of the manifest that are missing, have another size or other content."""
    held = spark.read.schema(OBJECTS).parquet(f"{destination}/objects").select("digest", "copy", F.octet_length("content").cast("long").alias("held"), (content_digest(F.col("content")) == F.col("digest")).alias("same"))
    found = manifest(spark, destination).join(held, ["digest", "copy"], "left")
    problem = F.when(F.col("held").isNull(), "missing").when(F.col("held") != F.col("bytes"), "other size").when(~F.col("same"), "other content")
    return found.select("digest", problem.alias("problem")).filter("problem is not null")


def lag_seconds(created_at: Column, replicated_at: Column, now: Column) -> Column:
    """The delay of a replication; 0 if a time is not known, or if the replica is of the future."""
    at = lambda c: F.unix_timestamp(c.cast("timestamp"))
    known = created_at.isNotNull() & replicated_at.isNotNull() & (at(replicated_at) <= at(now))
    return F.when(known, at(replicated_at) - at(created_at)).otherwise(F.lit(0)).cast("long")
