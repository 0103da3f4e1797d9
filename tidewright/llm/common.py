"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that one numpy pass looks at; temporaries are some tens of times that.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; in local mode a temporary one if none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder of the cluster."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that a job wrote, wherever it is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def released(df: DataFrame) -> DataFrame:
    """checkpointed, and the shuffle files that went into it are deleted at once, not when the driver forgets them."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return checkpointed(df.select("*"))  # a new frame: it is made under the setting
    finally:
        conf.set(name, before)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores appended until df has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def alnum_words(c: Column) -> Column:
    """Lower-cased words of ASCII letters, digits and non-ASCII characters; null has none."""
    parts = F.split(ascii_lower(F.coalesce(c, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(parts, lambda w: w != "")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data if data is not None else b"", np.uint8), at


def cuts(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of rows of at most `limit` bytes, or of a single row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Longer words are hashed one by one, which their length pays for.
_LONG = 64


def word_hashes(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the ASCII-space-separated words of some texts, and each text's first word.

    A word is taken eight bytes at a time, all words together, each step mixed in before the next, so
    that no Python object is made for it; a word of more than 64 bytes is given to XXH3.
    """
    base = int(offsets[0])
    b = data[base : int(offsets[-1])]
    at = np.asarray(offsets) - base
    n = len(b)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    space = _SPACE[b]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.concatenate([[True], space[:-1]]) | edge[:-1]
    after = np.concatenate([space[1:], [True]]) | edge[1:]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    eight = np.ndarray((n,), "<u8", np.concatenate([b, np.zeros(8, np.uint8)]), strides=(1,))
    left = ends - starts
    h = mix(left.astype(np.uint64) ^ np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    rows, place = np.arange(len(starts)), starts
    while len(rows):
        bits = (8 * np.minimum(left, 8)).astype(np.uint64)
        chunk = eight[place] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - bits))
        h[rows] = mix(h[rows] * np.uint64(0xD6E8FEB86659FD93) ^ chunk)
        more = left > 8
        rows, place, left = rows[more], place[more] + 8, left[more] - 8
        if len(rows) and place[0] - starts[rows[0]] == _LONG:
            for i in rows.tolist():
                h[i] = np.uint64(xxhash.xxh3_64_intdigest(b[starts[i] : ends[i]].tobytes(), seed))
            break
    return h, np.searchsorted(starts, at)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive words, across the bounds of texts too; each word is mixed in before the next."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ words[j : j + n]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return mix(h)


def text_shingles(words: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """The k-word shingles of each text; a text of fewer words is one shingle, an empty one has none."""
    h = shingles(words, k)
    out = []
    for a, z in zip(first[:-1], first[1:]):
        if z - a >= k:
            out.append(h[a : z - k + 1])
        else:
            out.append(shingles(words[a:z], int(z - a)) if z > a else h[:0])
    return out
