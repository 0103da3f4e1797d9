"""Packing into fixed token windows by Karmarkar-Karp multiway differencing.

A document that fits a window stays whole. A longer one has to be cut: full windows first, and the
rest into short pieces, which level the windows they come into. The items of many documents that
follow each other in a task are then divided into k windows: partial partitions, at first one item
each, are merged two at a time, those with the largest imbalance first, the fullest windows of one
onto the emptiest of the other. k starts at the least possible count and rises whenever a window
exceeds the capacity. Every task works on its own rows: nothing is shuffled, and memory holds one
group.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.tokencount import parts, text_ids, whole_tokens

CAPACITY = 1024
#: Items that are divided together: at most 8 MB of ids.
GROUP_ROWS = 2048
#: Most ids of a piece of what is left of a document longer than a window.
PIECE = 128


def differencing(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """(sum, items) of each of at most k windows with near-equal sums; items are indexes of sizes.

    A partial partition is a list of its windows that are not empty, in ascending order of sums. A
    small one is added to a large one by a few insertions, so that n single items take about
    n * log(n) steps.
    """
    heap = [(-s, i, [(s, i, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        # the fullest windows of b go to a's empty ones, the next to a's emptiest
        free = min(k - len(a), len(b))
        rest = b[: len(b) - free]
        low = a[: len(rest)]
        added = b[len(b) - free :]
        for (s, _, m), (t, at, n) in zip(low, reversed(rest)):
            n.extend(m)
            added.append((s + t, at, n))
        del a[: len(rest)]
        if len(added) > 16:
            a += added
            a.sort()
        else:
            for window in added:
                insort(a, window)
        least = a[0][0] if len(a) == k else 0
        heapq.heappush(heap, (least - a[-1][0], serial, a))
        serial += 1
    return [(s, m) for s, _, m in heap[0][2]] if heap else []


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of items (indexes of sizes, each of 1 to `capacity`) with sums of at most `capacity`.

    The count starts at the least possible one and rises by half of what the fullest window's excess
    asks for, at least by one.
    """
    k = -(-sum(sizes) // capacity)
    while True:
        windows = differencing(sizes, k)
        excess = windows[-1][0] - capacity if windows else 0
        if excess <= 0:
            return [items for _, items in windows]
        k += max(1, k * excess // (2 * capacity))


def spans(total: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: one if it fits, else full windows and near-equal pieces of the rest."""
    full = total // capacity * capacity
    found = [(start, capacity) for start in range(0, full, capacity)]
    rest = total - full
    if not full:
        found.append((0, rest))
    elif rest:
        n = -(-rest // piece)
        cuts = [full + rest * i // n for i in range(n + 1)]
        found += [(a, z - a) for a, z in zip(cuts, cuts[1:])]
    return found


def packed_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """A row per piece of each row of docs(doc_id, text): where it lies in its document and in its sequence.

    Columns doc_id, start, length, ids (little-endian 32-bit integers), doc_tokens, sequence_id,
    offset. A document is its ids by the tokenizer file at `path`, then the id `end`; null and empty
    texts are that id alone. Sequences hold at most `capacity` ids; their number carries the task's
    partition in the upper bits, so it is unique and the same when a task runs again. Repeated rows
    are packed each; an empty table gives no rows; other columns are not read.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # bounded by the vocabulary
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    last = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = text_ids(path, whole.value)
        sequence = TaskContext.get().partitionId() << 40
        items: list[tuple] = []  # doc_id, start, length, ids, doc_tokens
        rows: list[tuple] = []

        def flush() -> None:
            nonlocal sequence
            for window in pack([item[2] for item in items], capacity):
                offset = 0
                for i in window:
                    rows.append((*items[i], sequence, offset))
                    offset += items[i][2]
                sequence += 1
            items.clear()

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(names)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            batch = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            rows.clear()
            return batch

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for i, j in parts(texts):
                for doc_id, found in zip(doc_ids[i:j], ids_of(texts[i:j])):
                    total = len(found) + 1
                    ids = array("I", found).tobytes() + last
                    for start, n in spans(total, capacity):
                        piece = (doc_id, start, n, ids[4 * start : 4 * (start + n)], total)
                        if n == capacity:
                            rows.append((*piece, sequence, 0))
                            sequence += 1
                        else:
                            items.append(piece)
                    if len(items) >= GROUP_ROWS:
                        flush()
                yield out()
        flush()
        yield out()

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
