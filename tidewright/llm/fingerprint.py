"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k smallest distinct 64-bit hashes of a text's shingles. Sketches of parts merge by
the k smallest of their union; resemblance, containment and the number of distinct shingles are
estimated from sketches alone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.llm.common import CHUNK_BYTES, shuffle_partitions, text_shingles, word_hashes

K = 128
SHINGLE = 5


def sketches(texts: list[bytes], k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted bottom-k sketch of each text; a text under `shingle` words is one shingle, an empty one has none."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    words, first = word_hashes(np.frombuffer(b"".join(texts), np.uint8), offsets)
    return [np.unique(h)[:k] for h in text_shingles(words, first, shingle)]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both parts together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard index; two texts without words resemble each other fully."""
    both = np.concatenate([a, b])
    if not len(both):
        return 1.0
    both.sort()
    twice = both[1:] == both[:-1]
    first = np.concatenate([[True], ~twice])
    last = np.flatnonzero(first)[:k]
    return float(np.concatenate([twice, [False]])[last].mean())


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / float(a[-1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return min(1.0, shared / distinct_shingles(a, k))


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint of each row of docs(doc_id, text); null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(1)]
            for i, j in _parts(texts):
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array([encode(s) for s in sketches(texts[i:j], k, shingle)], pa.string())], ["doc_id", "fingerprint"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, fingerprint string")


def _hashes(fingerprint: Column) -> Column:
    """A fingerprint's hashes as longs that order as the unsigned hashes do."""
    raw = F.hex(F.unbase64(fingerprint))
    places = F.sequence(F.lit(1), F.greatest(F.length(raw) - 15, F.lit(1)), F.lit(16))
    # two halves, as a signed conversion holds 63 bits
    half = lambda at: F.conv(F.substr(raw, at, F.lit(8)), 16, 10).cast("long")
    return F.when(raw == "", F.array().cast("array<long>")).otherwise(F.transform(places, lambda at: (half(at) - (1 << 31)) * (1 << 32) + half(at + 8)))


def merged_sketches(sketched: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """by, hashes (ascending) of each group of sketched(by, fingerprint): the sketch of all its parts together.

    Hashes that parts share become one before they are ranked, and each task ranks its own ones first and sends k of a group
    on, so that a group may hold any share of the rows, copies of one sketch included. A group of empty sketches has an empty one; repeated rows change nothing; null keys are one
    group. Hashes are longs that order as the unsigned ones do.
    """
    h = sketched.select(*by, F.explode_outer(_hashes(F.col("fingerprint"))).alias("h")).distinct()
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.asc_nulls_last("h")))
    least = h.withColumn("place", place).filter(F.col("place") <= k)
    return least.groupBy(*by).agg(F.sort_array(F.collect_set("h")).alias("hashes"))


def estimates(pairs: DataFrame, a: str, b: str, k: int = K) -> DataFrame:
    """pairs with resemblance, containment (of a in b) and distinct_a, distinct_b: estimates from two columns of sketch hashes.

    Empty sketches resemble each other fully, and an empty a is contained in anything.
    """
    def distinct(c: Column) -> Column:
        largest = F.element_at(c, -1).cast("double") + 2.0**63
        return F.when(F.size(c) < k, F.size(c).cast("double")).otherwise((k - 1) * 2.0**64 / largest)

    ca, cb = F.col(a), F.col(b)
    both = F.slice(F.array_sort(F.array_union(ca, cb)), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect(ca, cb), both))
    alike = F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))
    inside = F.when(F.size(ca) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), alike * distinct(both) / distinct(ca)))
    return pairs.select("*", alike.alias("resemblance"), inside.alias("containment"), distinct(ca).alias("distinct_a"), distinct(cb).alias("distinct_b"))


def _parts(texts: list[bytes]):
    """Ranges of texts of about CHUNK_BYTES."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as ordered runs: columns part, halo, doc_id, text, sorted within partitions.

    Rows are split by quantiles of doc_id into parts. Each part ends with a halo row, the first row
    of the next part (of the first part, after the last), so that a row's successor always follows
    it in the same partition. Ties in doc_id are ordered by text; null doc_ids come first.
    """
    spark = docs.sparkSession
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    n = 2 * shuffle_partitions(spark)
    docs = docs.withColumn("key", key)
    bounds = docs.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    bounds = sorted(set(bounds))
    # two levels, so that a row is compared with about 2 * sqrt(n) bounds
    step = max(1, int(len(bounds) ** 0.5))
    literal = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    tops = F.array(*[F.lit(b).cast("long") for b in bounds[step - 1 :: step]]) if bounds else F.array().cast("array<long>")
    below = F.size(F.filter(tops, lambda b: b <= F.col("key"))) * step
    part = below + F.size(F.filter(F.slice(literal, below + 1, F.lit(step)), lambda b: b <= F.col("key")))
    docs = docs.withColumn("part", part)
    order = F.struct("key", F.xxhash64("text"))
    firsts = sorted((r[0], r[1][0], r[1][1]) for r in docs.groupBy("part").agg(F.min(order)).collect())
    if not firsts:
        return docs.select("part", F.lit(0).alias("halo"), "doc_id", "text")
    table = {p: (firsts[i - 1][0], key_, h) for i, (p, key_, h) in enumerate(firsts)}
    table = [table.get(p, (None, None, None)) for p in range(len(bounds) + 1)]
    previous, first_key, first_text = (F.get(F.array(*[F.lit(t[i]).cast("long") for t in table]), F.col("part")) for i in range(3))
    leads = (F.col("key") == first_key) & (F.xxhash64("text") == first_text)
    own = F.struct(F.col("part").alias("p"), F.lit(0).alias("halo"))
    copies = F.when(leads, F.array(own, F.struct(previous.cast("int").alias("p"), F.lit(1).alias("halo")))).otherwise(F.array(own))
    rows = docs.select("doc_id", "key", "text", F.explode(copies).alias("c")).select(F.col("c.p").alias("part"), F.col("c.halo").alias("halo"), "key", "doc_id", "text")
    return rows.repartition("part").sortWithinPartitions("part", "halo", "key", F.xxhash64("text")).select("part", "halo", "doc_id", "text")


def edited_likeness(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of each row of docs(doc_id, text), of its edited text and their likeness.

    Edited: the last floor(n_chars / 4) code points give way to the first as many of the next row
    in ascending doc_id, or all of it; after the last row comes the first. A single row is its own
    next. Null texts count as empty; empty texts have the empty fingerprint and full likeness to
    each other. Equal doc_ids are ordered by a hash of the text, null doc_ids come first. An empty
    table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def block(rows: list[tuple]) -> pa.RecordBatch:
        """Of each row but the last; a row follows its predecessor, or begins a part."""
        texts = [r[3] for r in rows]
        edited = []
        for a, b in zip(rows, rows[1:]):
            q = len(a[3]) // 4
            edited.append((a[3][: len(a[3]) - q] + b[3][:q]).encode() if not a[1] else b"")
        own, other = sketches([t.encode() for t in texts], k, shingle), sketches(edited, k, shingle)
        at = [i for i in range(len(rows) - 1) if not rows[i][1]]
        return pa.record_batch(
            [
                pa.array([rows[i][2] for i in at], pa.int64()),
                pa.array([len(texts[i]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(edited[i]).hexdigest() for i in at], pa.string()),
                pa.array([encode(own[i]) for i in at], pa.string()),
                pa.array([encode(other[i]) for i in at], pa.string()),
                pa.array([resemblance(own[i], other[i], k) for i in at], pa.float64()),
                pa.array([resemblance(own[i], own[i + 1], k) for i in at], pa.float64()),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] and rows and rows[-1][1]:
                    continue  # a tie of the halo row
                rows.append(row)
                size += len(row[3])
                if size > CHUNK_BYTES:
                    yield block(rows)
                    rows, size = rows[-1:], 0
        if len(rows) > 1:
            yield block(rows)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(run, schema)
