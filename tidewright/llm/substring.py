"""Substring dedup by level-wise doubling.

Windows that repeat at one length alone are extended to twice that length: 4, 8 and then 13 words,
until the full length is reached or no candidate survives. At each length a full window is stood for
by its anchor, the short window of smallest hash inside it: equal full windows have equal anchors, so
none is missed, at a fraction of the rows. Each level is a job of its own that leaves the positions
of repeated anchors per document, and its shuffle files are given back before the next one begins.
Counting is a partial aggregate on the hash; what goes back to the documents is joined on it, so that
a passage in a third of all documents is split over tasks. Full windows are told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import CHUNK_BYTES, checkpointed, cuts, released, shingles, utf8, word_hashes

_POSITION_BITS = 32
_SPOTS = "h long, h2 long, key long, spot long"


def levels(width: int) -> list[int]:
    """Window lengths: a quarter of the width, rounded up, then twice the one before, the width at last."""
    found = [max(1, -(-width // 4))]
    while found[-1] < width:
        found.append(min(width, 2 * found[-1]))
    return found


def _anchors(words: np.ndarray, starts: np.ndarray, length: int, width: int) -> np.ndarray:
    """For each full window, by its start: the start of the window of `length` in it with the smallest hash, the first of several."""
    if length == width or not len(starts):
        return starts
    hashes = np.lib.stride_tricks.sliding_window_view(shingles(words, length), width - length + 1)
    return starts + hashes[starts].argmin(axis=1)


def _spots(length: int, width: int, previous: int | None) -> Callable:
    """Windows of `length` that are anchors of full windows whose anchors of the previous length are among `positions`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            keys = batch.column("key").to_numpy()
            tags = batch.column("text_hash").to_numpy().astype(np.int64) << _POSITION_BITS
            data, offsets = utf8(batch.column("text"))
            for i, j in cuts(offsets, CHUNK_BYTES):
                words, first = word_hashes(data, offsets[i : j + 1])
                if len(words) < width:
                    continue
                starts = np.arange(len(words) - width + 1)
                doc = np.searchsorted(first, starts, "right") - 1
                keep = (starts + width <= first[doc + 1]) & named[i:j][doc]
                starts, doc = starts[keep], doc[keep]
                if previous is not None:
                    part = batch.column("positions").slice(i, j - i)
                    known = np.zeros(len(words) + 1, bool)
                    known[part.flatten().to_numpy() + np.repeat(first[:-1], part.value_lengths().to_numpy(zero_copy_only=False))] = True
                    keep = known[_anchors(words, starts, previous, width)]
                    starts, doc = starts[keep], doc[keep]
                anchor, at = np.unique(_anchors(words, starts, length, width), return_index=True)
                doc = doc[at]
                h = shingles(words, length)[anchor]
                # the full length alone decides: it has twice the bits
                h2 = shingles(word_hashes(data, offsets[i : j + 1], seed=1)[0], length)[anchor] if length == width else np.zeros(len(h), np.uint64)
                columns = [h.view(np.int64), h2.view(np.int64), keys[i:j][doc], tags[i:j][doc] | (anchor - first[doc])]
                yield pa.record_batch([pa.array(c) for c in columns], ["h", "h2", "key", "spot"])

    return run


def _repeated(spots: DataFrame) -> DataFrame:
    """h, h2, first: windows of more than one document, with the first of them.

    Grouping by a turned h makes the aggregate's partitioning another one than the later join's on h: the
    join then has an exchange of its own on both sides, and adaptive execution can split a hot window's
    rows over tasks.
    """
    turned = F.lit(0x5555555555555555)
    per_window = spots.groupBy(F.col("h").bitwiseXOR(turned).alias("t"), "h2").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    return per_window.filter("first < last").select(F.col("t").bitwiseXOR(turned).alias("h"), "h2", "first")


def _positions(spots: DataFrame) -> DataFrame:
    """key, text_hash, positions: where the spots lie in each document."""
    at = F.col("spot").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return spots.groupBy("key", F.shiftright("spot", _POSITION_BITS).cast("int").alias("text_hash")).agg(F.collect_set(at).alias("positions"))


def _copies(docs: DataFrame) -> DataFrame:
    """key, text_hash of the documents whose whole text is that of a document with a smaller doc_id."""
    texts = docs.filter("doc_id is not null").select("key", "text_hash", F.xxhash64("text").alias("h"), F.md5("text").alias("h2"))
    later = texts.join(_repeated(texts), ["h", "h2"]).filter("key > first")
    return later.select("key", "text_hash").distinct()


def remove_repeated(docs: DataFrame, width: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space) for each row of docs(doc_id, text).

    A word is removed if it lies in a window of `width` words that also starts in a document with a
    smaller doc_id; windows are judged on the input. Words are split at ASCII space. Null and empty
    texts have no words, and texts under `width` words keep all. Rows with one doc_id are one
    document: none removes from another. A null doc_id is neither earlier nor later than any.
    Repeated rows come out as often; other columns are not read.
    """
    docs = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.hash(F.coalesce("text", F.lit(""))).alias("text_hash"),
    )
    on = ["key", "text_hash"]
    # a whole copy is removed as a whole: it needs no windows, whatever the size of its group
    copies = checkpointed(_copies(docs))
    candidates, previous = docs.join(copies, on, "left_anti"), None
    for length in levels(width):
        spots = candidates.mapInArrow(_spots(length, width, previous), _SPOTS)
        found = spots.join(_repeated(spots), ["h", "h2"])
        positions = released(_positions(found.filter("key > first") if length == width else found))
        if positions.isEmpty():
            break
        # documents without a candidate need not be looked at again
        candidates, previous = docs.join(positions, on), length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, copy = batch.column("positions"), batch.column("copy").to_pylist()
            n, removed, kept = [], [], []
            for row, text in enumerate(batch.column("text")):
                words = text.as_py().encode().split()
                n.append(len(words))
                if copy[row] and len(words) >= width:
                    words = []
                elif starts[row].is_valid:
                    cover = np.zeros(len(words) + width + 1, np.int64)
                    at = starts[row].values.to_numpy()
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + width, -1)
                    keep = np.cumsum(cover)[: len(words)] == 0
                    words = [w for w, k in zip(words, keep) if k]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    flagged = docs.join(positions, on, "left").join(copies.withColumn("copy", F.lit(True)), on, "left")
    return flagged.select("doc_id", "text", "positions", "copy").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
