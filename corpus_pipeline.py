"""A corpus pipeline: documents to packed training windows.

Each stage takes what the one before it kept, written as Parquet and read again. Every stage takes empty tables, more
columns of any names (all pass through), and rows repeated or with null doc_ids, which are judged like any other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import removed, shared_folder, table
from tidewright.llm.decontaminate import decontaminate as without_benchmark
from tidewright.llm.linededup import drop_boilerplate
from tidewright.llm.packing import packed_pieces
from tidewright.llm.quality import with_quality
from tidewright.llm.queries import tokenizer_file
from tidewright.llm.simhash import one_of_each_group

#: Documents below this probability of being good are rejected.
MIN_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts are scored as texts without words; equal texts have equal scores. Without labels all
    scores are 0.5 and nothing is rejected.
    """
    score = "_quality" + "_" * max(map(len, docs.columns))
    return with_quality(docs, table(spark, sf_dir, "labels"), score).filter(F.col(score) >= MIN_QUALITY).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; n_chars follows the text.

    Null and empty texts stay as they are (n_chars of a null text is null), a null source is one source, and a text of boilerplate lines only becomes empty.
    """
    kept = drop_boilerplate(docs, host="source", ratio=0.1, min_pages=2, counts=None)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar by 0.8 or more.

    Texts without words are one group. The smallest doc_id stays (null before all), ties by a hash of the text; of repeated rows
    one stays.
    """
    return one_of_each_group(docs, k=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item.

    Items of fewer words are one window, items without words none; texts without words stay.
    """
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"), width=10)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 tokens.

    Null and empty texts are the end token alone; a repeated row has pieces of its own.
    """
    found = packed_pieces(docs, tokenizer_file(), capacity=1024, end=0)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Classifier scores and tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            removed(spark, before)  # what comes next starts from what is written now
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
