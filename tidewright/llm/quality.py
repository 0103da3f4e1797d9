"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Statistics of a text (never its labels, language, source or id) are standardised and mapped to
cosines at fixed random frequencies, which approximates a Gaussian kernel. Each partition of the
labelled rows sums its part of the normal equations; the driver adds the few sums and solves them.
Raw scores of labelled rows kept apart from the fit are binned and made monotonic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.common import CHUNK_BYTES, checkpointed, cuts, shingles, utf8, word_hashes

FEATURES = 256
#: The fit uses at most about so many labelled rows (a fixed hash of doc_id chooses), in so many partitions.
FIT_ROWS = 200_000
FIT_PARTITIONS = 16
RIDGE = 1e-3
#: The kernel's width in standard deviations per root of the number of statistics, and how far statistics may stand out.
WIDTH = 2.0
CLIP = 3.0
#: Least standard deviation taken for a statistic.
LEAST_SCALE = 0.02
SEED = 7
BINS = 1000

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\r",
    "line": b"\n",
    "stop": b".,;:?",
    "bang": b"!",
    "bar": b"|",
    "quote": b"\"'()-",
    "sign": b"#$%&*+/<=>@[\\]^_`{}~",
}


def _class_table() -> np.ndarray:
    table = np.full(256, len(_CLASSES), np.uint8)
    for i, chars in enumerate(_CLASSES.values()):
        table[list(chars)] = i
    return table


_TABLE = _class_table()


def _distinct_share(hashes: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Distinct share of the k-word shingles of each text, 1 if it has none."""
    out = np.ones(len(first) - 1)
    h = shingles(hashes, k)
    for d, (a, z) in enumerate(zip(first[:-1], first[1:])):
        if z - k + 1 > a:
            out[d] = len(np.unique(h[a : z - k + 1])) / (z - k + 1 - a)
    return out


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each text."""
    base = int(offsets[0])
    b, at = data[base : int(offsets[-1])], offsets - base
    n = np.diff(at).astype(float)
    docs = np.repeat(np.arange(len(n)), np.diff(at))
    kinds = len(_CLASSES) + 1
    counts = np.bincount(docs * kinds + _TABLE[b], minlength=len(n) * kinds).reshape(len(n), kinds).astype(float)
    hashes, first = word_hashes(data, offsets)
    words = np.diff(first).astype(float)
    shares = counts / np.maximum(n, 1)[:, None]
    upper = counts[:, 1] / np.maximum(counts[:, 0] + counts[:, 1], 1)
    extra = [np.log1p(n), (n - counts[:, 3] - counts[:, 4]) / np.maximum(words, 1), upper, words / np.maximum(counts[:, 4] + 1, 1) / 100]
    return np.column_stack([np.sqrt(shares), *extra, _distinct_share(hashes, first, 1), _distinct_share(hashes, first, 3)])


def document_statistics(docs: DataFrame) -> DataFrame:
    """docs without the text, and x, the statistics of each row's text; null texts count as empty."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in cuts(offsets, CHUNK_BYTES):
                x = statistics(data, offsets[i : j + 1])
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.record_batch([*(c.slice(i, j - i) for c in batch.columns[1:]), lists], [*rest, "x"])

    schema = T.StructType([docs.schema[c] for c in rest]).add("x", T.ArrayType(T.DoubleType()))
    return docs.select("text", *rest).mapInArrow(run, schema)


@dataclass(frozen=True)
class Model:
    """mean, scale: of the statistics; w, b: frequencies and phases; beta: ridge weights; x, y: the calibration's steps."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    x: np.ndarray
    y: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.column_stack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.x, self.y), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _partition_sums(rows: DataFrame, sums) -> np.ndarray:
    """Adds what `sums` (an array of fixed shape) makes of each of at most FIT_PARTITIONS partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                part = sums(_matrix(batch.column(0)), batch.column(1).to_numpy())
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([total.astype("<f8").tobytes()])], ["total"])

    parts = rows.select("x", "y").mapInArrow(run, "total binary").collect()
    return sum(np.frombuffer(p[0], "<f8") for p in parts)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and values of the blocks of the increasing step function nearest to y over ascending x."""
    blocks: list[list[float]] = []  # sum of weight * y, weight, sum of weight * x
    for a, b, w in zip(x, y, weight):
        blocks.append([b * w, w, a * w])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([c / w for _, w, c in blocks]), np.array([v / w for v, w, _ in blocks])


def held_out(doc_id: str) -> Column:
    """Rows that nothing is learnt from; a null doc_id is none."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, features: int = FEATURES) -> Model | float:
    """A model of docs(doc_id, text) and labels(doc_id, quality); a constant if the labelled rows are of one kind or none.

    A doc_id with several labels counts with their mean; null labels and doc_ids are left out. The
    labels that count are about fit_rows at most, so they are broadcast, and only the documents that
    they are of are looked at.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    known = known.filter("y is not null and doc_id is not null").filter(~held_out("doc_id")).groupBy("doc_id").agg(F.avg("y").alias("y"))
    n = known.count()
    if n > fit_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / n))
    apart = F.pmod(F.crc32(F.concat(F.lit("apart "), F.col("doc_id").cast("string"))), F.lit(4)) == 0
    learnt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("text", "y", apart.alias("apart"))
    rows = checkpointed(document_statistics(learnt).select("x", "y", "apart").repartition(FIT_PARTITIONS))
    count, total, least, most = rows.agg(F.count("*"), F.sum("y"), F.min("y"), F.max("y")).first()
    if not count or least == most:
        return total / count if count else 0.5
    moments = _partition_sums(rows, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    k = (len(moments) - 1) // 2
    mean = moments[1 : k + 1] / moments[0]
    scale = np.sqrt(np.maximum(moments[k + 1 :] / moments[0] - mean**2, 0)) + LEAST_SCALE
    rng = np.random.default_rng(SEED)
    w, b = rng.normal(size=(k, features)) / (WIDTH * np.sqrt(k)), rng.uniform(0, 2 * np.pi, features)
    empty = np.zeros(0)
    model = Model(mean, scale, w, b, empty, empty, empty)

    def normal_equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    fitted = rows.filter("not apart")
    if fitted.isEmpty():
        fitted = rows
    sums = _partition_sums(fitted, normal_equations)
    m = features + 1
    beta = np.linalg.solve(sums[: m * m].reshape(m, m) + RIDGE * count * np.eye(m) / m, sums[m * m :])
    model = Model(mean, scale, w, b, beta, empty, empty)

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raw = model.raw(x)
        at = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(at, v, BINS) for v in (np.ones(len(y)), y, raw)])

    apart = rows.filter("apart")
    if apart.isEmpty():
        apart = rows
    n, y, raw = _partition_sums(apart, binned).reshape(3, BINS)
    full = n > 0
    x, y = isotonic(raw[full] / n[full], y[full] / n[full], n[full])
    return Model(mean, scale, w, b, beta, x, y)


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, score (0 to 1, higher: quality 1 likelier) for each row of docs(doc_id, text); see with_quality."""
    return with_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, "score", fit_rows).select("doc_id", "score")


def with_quality(docs: DataFrame, labels: DataFrame, score: str = "score", fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs with one more column, the score of each row's text; rows are not moved between tasks.

    Null and empty texts have the statistics of an empty text and so a score of their own. Without
    labels of both kinds each score is the labels' mean, or 0.5. Equal texts have equal scores,
    repeated rows come out as often, an empty table gives no rows; columns may have any names but
    that of the score.
    """
    model = fit(docs, labels, fit_rows)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            for i, j in cuts(offsets, CHUNK_BYTES):
                scores = np.full(j - i, model) if isinstance(model, float) else model.score(statistics(data, offsets[i : j + 1]))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], schema=part.schema.append(pa.field(score, pa.float64())))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))
