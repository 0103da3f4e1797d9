"""Benchmark decontamination by a prefix-filtered set join.

A window of an item occurs in a document only if the document holds every word of the window, so
it is enough to join one necessary prefix word: the rarest, by the document counts of the corpus.
A document word that is no prefix word is dropped in place, before anything is exploded. What is
left carries a slice of the words around it; the position bounds (the window must fit between the
first and the last word) and the exact comparison decide. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import alnum_words, checkpointed, unused

#: Up to so many words a set is tested as it is; larger sets by a table of so many marks.
MAX_IN_PLACE = 20_000
SLOTS = 1 << 24


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id, words: the distinct windows of each item. A short item is one window, an empty one none."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), alnum_words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return (
        words.filter(F.size("w") > 0)
        .select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(width)))).alias("words"))
        .distinct()
    )


def membership(df: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test on words that holds for all values of a column, and for few others; it works in place at any size.

    Up to MAX_IN_PLACE values are a literal set. More of them mark a table of SLOTS bytes by their hash,
    16 MB at most, and other words pass with the share of marked slots; a join afterwards tells them apart.
    """
    rows = df.select(column).distinct().limit(MAX_IN_PLACE + 1).collect()
    if len(rows) <= MAX_IN_PLACE:
        values = [r[0] for r in rows]
        return lambda w: w.isin(values)
    slot = F.pmod(F.xxhash64(column), F.lit(SLOTS)) + 1
    maps = df.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    table = np.zeros(SLOTS, np.uint8)
    for r in maps:
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        start = (r["bucket"] - 1) * len(bits)
        table[start : start + len(bits)] = bits[: SLOTS - start]
    marks = F.lit(table.tobytes())
    return lambda w: F.substr(marks, F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")


def rarest_first(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """windows with their prefix: the word that the fewest documents hold (ties: the smaller), and its offset."""
    known = membership(windows.select(F.explode("words").alias("word")), "word")
    held = docs.select(F.explode(F.array_distinct(F.filter(alnum_words(F.col("text")), known))).alias("word"))
    counts = held.groupBy("word").agg(F.count("*").alias("n"))
    ranked = (
        windows.select("item_id", "words", F.posexplode("words").alias("offset", "word"))
        .join(counts, "word", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )
    first = F.min(F.struct("n", "word", "offset")).alias("first")
    return (
        ranked.groupBy("item_id", "words")
        .agg(first)
        .filter("first.n > 0")
        .select("item_id", "words", F.col("first.word").alias("word"), F.col("first.offset").alias("offset"))
    )


def _per_text(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n_words, copies, n_hit, items: a row for each distinct (doc_id, text), copies of which there are."""
    docs = docs.select("doc_id", "text")
    # a table of the benchmark's size, used twice below: written once, so that the corpus is counted once
    windows = checkpointed(rarest_first(docs, item_windows(benchmark.select("item_id", "text"), width)))
    is_prefix = membership(windows, "word")

    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), alnum_words(F.col("text")).alias("w"))
    words = words.withColumn("n_words", F.size("w"))
    places = F.array_compact(F.transform("w", lambda w, i: F.when(is_prefix(w), i)))

    def place(i: Column) -> Column:
        # the words at most width-1 before and after; lead: how many there are before
        lead = F.least(i, F.lit(width - 1))
        return F.struct(F.get("w", i).alias("word"), i.alias("at"), lead.alias("lead"), F.slice("w", i - lead + 1, lead + F.lit(width)).alias("around"))

    # the head stands for the row itself; its word, unlike any real one, holds a space and spreads over the join's tasks
    head = F.struct(F.concat(F.lit(" "), F.col("text_hash").cast("string")).alias("word"), F.lit(-1).alias("at"), F.lit(0).alias("lead"), F.array().cast("array<string>").alias("around"))
    found = words.select("doc_id", "text_hash", "n_words", F.explode(F.concat(F.array(head), F.transform(places, place))).alias("p")).select("doc_id", "text_hash", "n_words", "p.*")

    size, start = F.size("words"), F.col("at") - F.col("offset")
    fits = (F.col("offset") <= F.col("lead")) & (start + size <= F.col("n_words"))
    same = F.slice("around", F.col("lead") - F.col("offset") + 1, size) == F.col("words")
    match = F.when(fits, same)
    per_text = (
        found.join(windows, "word", "left")
        .groupBy("doc_id", "text_hash", "n_words")
        .agg(
            F.count_if(F.col("at") < 0).alias("copies"),
            F.sort_array(F.collect_set(F.when(match, F.struct(start.alias("start"), size.alias("size"))))).alias("spans"),
            F.sort_array(F.collect_set(F.when(match, F.col("item_id")))).alias("items"),
        )
    )
    return per_text.withColumn("n_hit", _covered(F.col("spans"))).drop("spans")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted item_ids as strings) for each row of docs(doc_id, text).

    Null and empty texts have no words and no hits. Rows that are repeated come out as often. Null
    item texts have no windows. A null doc_id is a value as any other. An empty benchmark or table
    gives no hits or no rows. Other columns of the inputs are not read.
    """
    per_row = _per_text(docs, benchmark, width).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return per_row.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", "items")


def _covered(spans: Column) -> Column:
    """Words that at least one of the sorted spans (start, size) covers."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(a: Column, s: Column) -> Column:
        end = (s["start"] + s["size"]).cast("long")
        new = F.greatest(end - F.greatest(a["end"], s["start"].cast("long")), F.lit(0).cast("long"))
        return F.struct((a["n"] + new).alias("n"), F.greatest(a["end"], end).alias("end"))

    return F.aggregate(spans, zero, add)["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents that hold no window of an item, with all their columns.

    The decision is a row's own, by its doc_id (null as a value) and a hash of its text: rows that share
    a doc_id with a hit one stay if their text has no hit. Nulls, empty texts and tables and repeated
    rows are as in `contamination`; columns may have any names.
    """
    id_, hash_ = unused(docs, "_hit_id", "_hit_hash")
    hit = _per_text(docs, benchmark, width).filter("n_hit > 0").select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_))
    return docs.join(hit, docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(hash_)), "left_anti")
