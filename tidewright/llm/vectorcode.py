"""Short codes of vectors: product quantisation over metric trees.

Vectors become integers and are cut into equal parts, each with a codebook of its own. Blocks of rows
get an anchors hierarchy for each part: anchors take the points nearest to them, are joined middle-out
into balls, and their sets are divided further in the same way. Each ball caches the sum and the count
of its points. A round walks the balls of all blocks from the top with lists of codebook entries; a ball
inherits the entries that its parent could not rule out, and a ball that one entry is left for is
added to it as a whole. The trees are written once and read by every round. All decisions are made in
exact integers, so that the codes are those of a full search.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import shared_folder, unused

#: Rows of a block, which has a tree for each part, and points of a leaf.
BLOCK, LEAF = 4096, 64
#: Larger components count as this.
LARGEST = 1 << 62
#: Up to this size differences of 128 components can be squared and added as 64-bit numbers.
_SMALL = 1 << 26


def _whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or Python's where squares would not fit."""
    x = np.floor(values.astype(np.float64) * scale)
    if not x.size or np.abs(x).max() <= _SMALL:
        return x.astype(np.int64)
    out = np.empty(x.shape, object)
    out.flat = [max(-LARGEST, min(LARGEST, int(v))) for v in x.flat]
    return out


def _squares(d: np.ndarray) -> np.ndarray:
    return (d * d).sum(axis=-1)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class Balls:
    """A binary tree of balls over the points (n, d) of one part of one block.

    order: points as the leaves have them; ball i covers order[lo[i]:hi[i]], with its pivot (the floor of the
    mean), its radius, the sum of its points and its children (-1 for a leaf). Ball 0 is the root.
    """

    def __init__(self, points: np.ndarray | None = None) -> None:
        self.lo: list[int] = []
        self.hi: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.order = np.zeros(0, np.int64)
        if points is None or not len(points):
            return
        placed: list[np.ndarray] = []
        at = 0
        # a work list instead of recursion; ("set", points) and ("tree", anchors' merge tree) fill ball i
        todo: list[tuple[int, str, object]] = [(self._new(), "set", np.arange(len(points)))]
        while todo:
            i, kind, what = todo.pop()
            self.lo[i] = at
            if kind == "set":
                what = np.asarray(what)
                sets = anchors(points, what) if len(what) > LEAF else [what]
                if len(sets) == 1:
                    placed.append(what)
                    at += len(what)
                    continue
                what = middle_out(points, sets)
            if isinstance(what, tuple):
                self.left[i], self.right[i] = self._new(), self._new()
                todo.append((self.right[i], "tree", what[1]))
                todo.append((self.left[i], "tree", what[0]))
            else:
                todo.append((i, "set", what))
        self.order = np.concatenate(placed)
        sorted_points = points[self.order]
        n = len(self.lo)
        self.hi = [0] * n
        for i in range(n - 1, -1, -1):  # children have higher numbers
            self.hi[i] = self.hi[self.right[i]] if self.right[i] >= 0 else self.lo[i] + self._leaf_size(i, n)
        self._measure(sorted_points)

    def _new(self) -> int:
        for column in (self.lo, self.hi, self.left, self.right):
            column.append(-1)
        return len(self.lo) - 1

    def _leaf_size(self, i: int, n: int) -> int:
        if not hasattr(self, "_ends"):
            starts = sorted(self.lo[j] for j in range(n) if self.left[j] < 0)
            self._ends = dict(zip(starts, [*starts[1:], len(self.order)]))
        return self._ends[self.lo[i]] - self.lo[i]

    def _measure(self, points: np.ndarray) -> None:
        self.lo, self.hi, self.left, self.right = (np.array(c, np.int64) for c in (self.lo, self.hi, self.left, self.right))
        before = np.concatenate([np.zeros((1, points.shape[1]), points.dtype), np.cumsum(points, axis=0)])
        self.sums = before[self.hi] - before[self.lo]
        self.pivots = self.sums // (self.hi - self.lo)[:, None]
        self.radius = np.array([_root(_squares(points[a:z] - p)).max() for a, z, p in zip(self.lo, self.hi, self.pivots)]) * (1 + 1e-9)

    def columns(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in ("order", "lo", "hi", "left", "right", "sums", "pivots", "radius")}

    @classmethod
    def of(cls, columns: dict[str, np.ndarray]) -> Balls:
        balls = cls()
        for k, v in columns.items():
            setattr(balls, k, v)
        return balls


def anchors(points: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
    """The points `of`, divided among about sqrt(n) anchors (fewer if leaves suffice), each point with its nearest anchor.

    A new anchor is the point that is farthest from its own one. It takes points from older anchors only within
    reach: those farther from theirs than half the distance between the two anchors; the rest is not looked at.
    """
    k = max(2, min(round(len(of) ** 0.5), -(-len(of) // LEAF)))
    p = points[of].astype(np.float64)
    found, owner = [0], np.zeros(len(of), np.int64)
    away = np.sqrt(_squares(p - p[0]))
    while len(found) < k:
        new = int(away.argmax())
        if away[new] == 0:
            break  # copies
        gap = np.sqrt(_squares(p[found] - p[new]))
        reach = np.flatnonzero(away > gap[owner] / 2)
        to_new = np.sqrt(_squares(p[reach] - p[new]))
        closer = to_new < away[reach]
        taken = reach[closer]
        owner[taken], away[taken] = len(found), to_new[closer]
        found.append(new)
    order = np.argsort(owner, kind="stable")
    sets = np.split(of[order], np.searchsorted(owner[order], np.arange(1, len(found))))
    return [s for s in sets if len(s)]


def middle_out(points: np.ndarray, sets: list[np.ndarray]) -> tuple:
    """The sets joined pairwise into a binary tree of nested pairs, the pair with the smallest ball around it first."""
    trees: list = list(sets)
    mean = np.array([points[s].astype(np.float64).mean(axis=0) for s in sets])
    count = np.array([len(s) for s in sets], np.float64)
    radius = np.array([np.sqrt(((points[s].astype(np.float64) - m) ** 2).sum(axis=1).max()) for s, m in zip(sets, mean)])
    cost = np.sqrt(((mean[:, None] - mean[None]) ** 2).sum(axis=2)) + radius[:, None] + radius[None]
    np.fill_diagonal(cost, np.inf)
    for _ in range(len(sets) - 1):
        i, j = divmod(int(cost.argmin()), len(sets))
        both = (mean[i] * count[i] + mean[j] * count[j]) / (count[i] + count[j])
        radius[i] = max(np.sqrt(((mean[i] - both) ** 2).sum()) + radius[i], np.sqrt(((mean[j] - both) ** 2).sum()) + radius[j])
        trees[i], mean[i] = (trees[i], trees[j]), both
        count[i] += count[j]
        cost[j], cost[:, j] = np.inf, np.inf
        live = np.isfinite(cost[i])
        cost[i, live] = np.sqrt(((mean[live] - both) ** 2).sum(axis=1)) + radius[live] + radius[i]
        cost[:, i] = cost[i]
    return trees[int(count.argmax())]


def owned(balls: Balls, points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of each place in order, sums, counts) of the nearest entries of `book`, ties to the lower one.

    All balls of a level are looked at together. An entry is ruled out for a ball if another one is nearer to
    every point in it: |p - c|^2 - |p - b|^2 > 2 * radius * |c - b| for the pivot p and the best entry b. Of equal
    entries only the first is a candidate. What is left in a leaf is decided point by point.
    """
    code = np.zeros(len(points), np.int64)
    sums, counts = np.zeros_like(book), np.zeros(len(book), np.int64)
    if not len(points):
        return code, sums, counts
    distinct: dict[tuple, int] = {}
    for i, entry in enumerate(book.tolist()):
        distinct.setdefault(tuple(entry), i)
    candidates = np.array(sorted(distinct.values()), np.int64)
    gap = _root(_squares(book[:, None] - book[None])) * (1 + 1e-9)
    ball = np.zeros(len(candidates), np.int64)  # (ball, entry) pairs, by ball, entries ascending
    entry = candidates
    single: list[np.ndarray] = []  # places that were decided point by point
    while len(ball):
        away = _squares(balls.pivots[ball] - book[entry])
        first = np.flatnonzero(np.concatenate([[True], ball[1:] != ball[:-1]]))
        size = np.diff(np.append(first, len(ball)))
        least = np.repeat(np.minimum.reduceat(away, first), size)
        place = np.where(away == least, np.arange(len(ball)), len(ball))
        best = entry[np.repeat(np.minimum.reduceat(place, first), size)]
        left = (away - least).astype(np.float64) <= 2 * balls.radius[ball] * gap[entry, best]
        ball, entry = ball[left], entry[left]
        first = np.flatnonzero(np.concatenate([[True], ball[1:] != ball[:-1]]))
        size = np.diff(np.append(first, len(ball)))
        node = ball[first]
        for i in np.flatnonzero(size == 1).tolist():  # owned as a whole
            b, e = node[i], entry[first[i]]
            code[balls.lo[b] : balls.hi[b]] = e
            sums[e] += balls.sums[b]
            counts[e] += balls.hi[b] - balls.lo[b]
        leaf = balls.left[node] < 0
        open_leaves = np.flatnonzero((size > 1) & leaf)
        if len(open_leaves):
            place, nearest = _decided(balls, points, book, node[open_leaves], first[open_leaves], size[open_leaves], entry)
            code[place] = nearest
            single.append(place)
        inherit = np.repeat((size > 1) & ~leaf, size)
        ball, entry = ball[inherit], entry[inherit]
        order = np.lexsort((np.tile(entry, 2), both := np.concatenate([balls.left[ball], balls.right[ball]])))
        ball, entry = both[order], np.tile(entry, 2)[order]
    if single:
        place = np.concatenate(single)
        np.add.at(sums, code[place], points[place])
        np.add.at(counts, code[place], 1)
    return code, sums, counts


def _decided(balls: Balls, points: np.ndarray, book: np.ndarray, node: np.ndarray, first: np.ndarray, size: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, entries): the nearest one of each leaf's candidates, entry[first : first + size], for its points; ties to the lower one."""
    lo, m = balls.lo[node], balls.hi[node] - balls.lo[node]
    pairs = m * size
    k = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    width = np.repeat(size, pairs)
    place, candidate = np.repeat(lo, pairs) + k // width, entry[np.repeat(first, pairs) + k % width]
    away = _squares(points[place] - book[candidate])
    begin = np.flatnonzero(k % width == 0)
    least = np.repeat(np.minimum.reduceat(away, begin), np.diff(np.append(begin, len(away))))
    at = np.minimum.reduceat(np.where(away == least, np.arange(len(away)), len(away)), begin)
    return place[begin], candidate[at]


def _pack(trees: list[Balls], vectors: np.ndarray) -> bytes:
    """The trees and vectors of a block; Python's integers as text, so that nothing is pickled."""
    columns = {f"{i}.{k}": v for i, t in enumerate(trees) for k, v in t.columns().items()} | {"vectors": vectors}
    out = io.BytesIO()
    np.savez(out, **{k + ("!" if v.dtype == object else ""): v.astype(str) if v.dtype == object else v for k, v in columns.items()})
    return out.getvalue()


def _unpack(data: bytes) -> tuple[list[Balls], np.ndarray]:
    columns = {}
    with np.load(io.BytesIO(data), allow_pickle=False) as stored:
        for k in stored.files:
            v = stored[k]
            if k.endswith("!"):
                whole = np.empty(v.shape, object)
                whole.flat = [int(x) for x in v.flat]
                v = whole
            columns[k.rstrip("!")] = v
    vectors = columns.pop("vectors")
    by: dict[int, dict] = {}
    for k, v in columns.items():
        part, name = k.split(".")
        by.setdefault(int(part), {})[name] = v
    return [Balls.of(by[i]) for i in sorted(by)], vectors


def _blocks(source: DataFrame, width: int, parts: int, scale: int) -> DataFrame:
    """id, label, balls: lists of a block's rows and its packed trees, of source(id, label, vector)."""

    def block(ids: pa.Array, labels: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
        x = _whole(vectors, scale)
        cut = np.split(x, parts, axis=1)
        wrap = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.record_batch([wrap(ids), wrap(labels), pa.array([_pack([Balls(c) for c in cut], x)], pa.binary())], ["id", "label", "balls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            while rows >= BLOCK or last and rows:
                t = pa.Table.from_batches(held)
                head = t.slice(0, BLOCK).combine_chunks()
                v = head.column(2).combine_chunks()
                v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
                lengths = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                flat = v.flatten().to_numpy(zero_copy_only=False)
                padded = np.zeros((len(v), width))
                row = np.repeat(np.arange(len(v)), lengths)
                padded[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
                one = lambda a: a.combine_chunks().chunk(0) if isinstance(a.combine_chunks(), pa.ChunkedArray) else a.combine_chunks()
                yield block(one(head.column(0)), one(head.column(1)), padded)
                rows -= len(v)
                held = t.slice(len(v)).to_batches() if rows else []

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
                yield from flush(False)
        yield from flush(True)

    kinds = dict(source.dtypes)
    return source.mapInArrow(run, f"id array<{kinds['id']}>, label array<{kinds['label']}>, balls binary")


def _round(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each entry the floor of the mean of the parts it owns, or as before if there are none."""
    parts, entries, width = len(books), len(books[0]), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(entries, np.int64) for _ in books]
        for batch in batches:
            for data in batch.column(0):
                trees, vectors = _unpack(data.as_py())
                for p, (tree, x, book) in enumerate(zip(trees, np.split(vectors, parts, axis=1), books)):
                    big = x.dtype == object or book.dtype == object
                    kind = object if big else np.int64
                    _, s, n = owned(tree, x[tree.order].astype(kind), book.astype(kind))
                    sums[p] = sums[p] + s
                    counts[p] += n
        rows = [(p, e, j, int(sums[p][e, j]), int(counts[p][e])) for p in range(parts) for e in np.flatnonzero(counts[p]).tolist() for j in range(width)]
        columns = list(zip(*rows)) or [[]] * 5
        types = [pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()]
        columns[3] = [Decimal(v) for v in columns[3]]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["part", "entry", "j", "s", "n"])

    found = blocks.select("balls").mapInArrow(run, "part int, entry int, j int, s decimal(38,0), n long")
    out = [b.astype(object) for b in books]
    # bounded: a row for each component of each entry
    for r in found.groupBy("part", "entry", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        out[r["part"]][r["entry"], r["j"]] = int(r["s"]) // r["n"]
    return [_narrow(b) for b in out]


def _narrow(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if all(abs(v) <= _SMALL for v in book.flat) else book


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, list[list[list[int]]]]:
    """(codes, codebooks): codes has id, label, code, error; codebooks[part][entry] are integers.

    Components become floor(scale * x). Each part's codebook starts as that part of the `entries` smallest ids;
    `rounds` times all parts are assigned to their nearest entry (ties to the lower) and entries become the floor
    of the mean of their parts, unused ones stay; then all are assigned again. A code has two hexadecimal digits for
    each part, or as many as the largest index needs; the error is the sum of the squared distances.

    Rows whose vector is null or holds null, NaN or infinite components are left out. Equal ids are ordered by
    their vectors, null ids come last, and repeated rows count as often as they are there. Fewer rows than entries give smaller codebooks,
    none give no rows. Vectors of other lengths are filled up with zeros to the longest, rounded up to a multiple of parts.
    Components beyond 2^62 after scaling count as that, errors beyond a long as the largest. Other columns are not read.
    """
    spark = vectors.sparkSession
    v = F.col(vector)
    clean = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    source = vectors.filter(clean).select(F.col(id).alias("id"), F.col(label).alias("label"), v.cast("array<double>").alias("vector"))
    folder = f"{shared_folder(spark)}/vector-codes-{uuid.uuid4().hex}"
    longest = source.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    seeds = source.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()  # bounded
    _blocks(source, width, parts, scale).write.parquet(folder)
    blocks = spark.read.parquet(folder)
    start = np.zeros((len(seeds), width))
    for row, r in zip(start, seeds):
        row[: len(r["vector"])] = r["vector"]
    books = [_narrow(b.astype(object)) for b in np.split(_whole(start, scale), parts, axis=1)]
    for _ in range(rounds if seeds else 0):
        books = _round(blocks, books)
    digits = max(2, len(f"{entries - 1:x}"))
    kinds = dict(source.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                trees, x = _unpack(batch.column(2)[i].as_py())
                codes, error = np.zeros((len(x), parts), np.int64), np.zeros(len(x), object)
                for p, (tree, own, book) in enumerate(zip(trees, np.split(x, parts, axis=1), books)):
                    kind = object if own.dtype == object or book.dtype == object else np.int64
                    own, book = own.astype(kind), book.astype(kind)
                    codes[tree.order, p] = owned(tree, own[tree.order], book)[0]
                    error = error + _squares(own - book[codes[:, p]])
                texts = ["".join(f"{c:0{digits}x}" for c in row) for row in codes.tolist()]
                errors = pa.array([min(int(e), (1 << 63) - 1) for e in error], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(texts, pa.string()), errors], ["id", "label", "code", "error"])

    coded = blocks.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")
    return coded.select(F.col("id").alias(id), F.col("label").alias(label), "code", "error"), [b.tolist() for b in books]


def codebooks_sha256(codebooks: list[list[list[int]]]) -> str:
    """The digest of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for book in codebooks for entry in book for v in entry).encode()).hexdigest()


def with_label_error(codes: DataFrame, label: str = "label", total: str = "label_error") -> DataFrame:
    """codes with the sum of `error` over rows of the same label; nulls are together.

    Sums are made before anything is shuffled, and joined back, so that a label may have any share of the rows.
    A sum beyond a long counts as the largest.
    """
    key, sum_ = unused(codes, "key", "sum")
    sums = codes.groupBy(F.col(label).alias(key)).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias(sum_))
    return codes.join(sums, codes[label].eqNullSafe(sums[key])).withColumn(total, F.col(sum_)).drop(key, sum_)
