"""SimHash near-duplicates by a binary trie self-join.

Equal fingerprints are merged first. The 64 bits are cut into blocks; two fingerprints that differ
in at most blocks - exact bits agree on at least `exact` blocks, so each fingerprint is sent to one
task group per choice of that many blocks, keyed by their bits: the upper part of a binary trie
over the bits in that order, with no error spent yet. Groups that are too large go down the trie
further: pairs of sub-tries whose paths differ in more than max_bits bits are pruned, each other
pair is a group of its own. Within a group the rest of the trie is traversed by node pairs, level
by level; a pair of nodes is dropped as soon as its differing bits exceed the budget. A group of n
fingerprints gives a minimum spanning forest of its links, fewer than n rows, never all pairs.
Connected components are joined across groups by Spark. Where links are verified afterwards, what
a failed link has left apart is searched again between the verified components (see ROUNDS).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import CHUNK_BYTES, checkpointed, cuts, mix, released, shared_folder, text_shingles, unused, utf8, word_hashes

BITS = 64
#: Fingerprints in one trie group; larger groups are split by the next bits of the trie.
GROUP_ROWS = 2048
#: Node pairs of at most so many member pairs are compared at once.
LEAF_PAIRS = 1024
#: A table of large groups of at most so many rows is broadcast.
MAX_BROADCAST = 100_000
#: Links of each row between components that are verified in the rounds after the forest; None: all that are left.
ROUNDS = (4, None)
#: Bits of a sketch, by which candidates of those rounds are sifted before they are verified.
SKETCH_BITS = 2048


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of the k-word shingles, repeats included; a text of fewer words is one shingle."""
    words = text.lower().split()  # for bytes: A-Z and ASCII space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(k, len(words))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.fromiter((digest(joined[a:z], 42) for a, z in pairs), np.uint64, len(words) - k + 1)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without hashes."""
    if not len(h):
        return 0
    ones = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def simhash(text: bytes, k: int) -> int:
    return majority(shingle_hashes(text, k))


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of each row of docs(doc_id, text); null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash((t.as_py() or "").encode(), k) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, fp long")


def _tables(blocks: int, exact: int) -> list[tuple[int, int]]:
    """For each choice of `exact` of the blocks: a mask of their bits, and the bit where the next block begins."""
    bounds = np.linspace(0, BITS, blocks + 1).astype(int).tolist()
    mask = lambda i: ((1 << bounds[i + 1]) - 1) ^ ((1 << bounds[i]) - 1)
    return [(sum(mask(i) for i in chosen), bounds[chosen[-1] + 1] % BITS) for chosen in combinations(range(blocks), exact)]


def blocks_for(n: int, max_bits: int) -> tuple[int, int]:
    """(blocks, exact) for n distinct fingerprints: as few equal blocks as leave groups of GROUP_ROWS when bits are even.

    Links of max_bits = blocks - exact bits are all found; the copies of a fingerprint grow with the
    logarithm of n: 5 up to 16 million, 15 up to 4 billion, 35 beyond.
    """
    exact = 1
    while n >> (BITS * exact // (max_bits + exact)) > GROUP_ROWS:
        exact += 1
    return max_bits + exact, exact


def spanning_links(n: int, links: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Indexes of the links of a minimum spanning forest of n rows, by Kruskal's algorithm."""
    root, kept = np.arange(n), []
    for d in np.unique(distance):
        at = np.flatnonzero(distance == d)
        while len(at):
            a, b = root[links[at, 0]], root[links[at, 1]]
            apart = a != b
            at, lo, hi = at[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            once = np.unique(hi, return_index=True)[1]  # each root is hooked to a smaller one at most once a turn
            root[hi[once]] = lo[once]
            kept.append(at[once])
            while (root[root] != root).any():
                root = root[root]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def nearest_links(links: np.ndarray, distance: np.ndarray, most: int) -> np.ndarray:
    """Which links are among the `most` nearest ones of at least one of their ends."""
    ends, other = links.T.ravel(), links[:, ::-1].T.ravel()
    order = np.lexsort((other, np.tile(distance, 2), ends))
    first = np.searchsorted(ends[order], ends[order])
    near = np.zeros(len(links), bool)
    near[order[np.arange(len(order)) - first < most] % max(len(links), 1)] = True
    return near


def trie_links(fps: np.ndarray, group: np.ndarray, side: np.ndarray, max_bits: int, check: np.ndarray, max_total: int) -> np.ndarray:
    """A minimum spanning forest of the links (i, j) of trie_pairs."""
    found = np.zeros((0, 2), np.int64)
    for links in trie_pairs(fps, group, side, max_bits, check, max_total):
        found = np.concatenate([found, links])
        found = found[spanning_links(len(fps), found, _bits(fps, *found.T) + _bits(check, *found.T))]
    return found


def links_between(fps, group, side, max_bits, check, max_total, root: np.ndarray, sketch: np.ndarray, max_apart: int, most: int | None, table: np.ndarray, masks: np.ndarray, second: bool) -> Iterator[np.ndarray]:
    """The links (i, j) of trie_pairs between rows of different root whose sketches differ in at most max_apart bits.

    A link lies in the groups of all choices of blocks that its ends agree on; it is given in the group of the first of these
    only (masks: the choices' bits; table: each row's choice). `second`: links that the other half's tries hold as well are theirs.
    With `most`, links are left out that are not among the `most` nearest ones of an end, in their group.
    """

    def own(links: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(links), bool)
        for at in np.array_split(np.arange(len(links)), len(links) // 50_000 + 1):
            i, j = links[at].T
            equal = ((fps[i] ^ fps[j])[:, None] & masks) == 0
            keep[at] = equal.argmax(axis=1) == table[i]
            if second:
                other = check[i] ^ check[j]
                keep[at] &= ~((np.bitwise_count(other) <= max_bits) & ((other[:, None] & masks) == 0).any(axis=1))
        return links[keep]

    found = np.zeros((0, 2), np.int64)
    for links in trie_pairs(fps, group, side, max_bits, check, max_total):
        links = links[root[links[:, 0]] != root[links[:, 1]]]
        links = links[sketch_distance(sketch, links) <= max_apart]
        if most is None:
            yield own(links)
            continue
        found = np.concatenate([found, links])
        found = found[nearest_links(found, sketch_distance(sketch, found), most)]
    yield own(found)


def sketch_distance(sketch: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Differing bits of the two sketches of each link, some megabytes at a time."""
    parts = np.array_split(links, len(links) // 100_000 + 1)
    return np.concatenate([np.bitwise_count(sketch[x[:, 0]] ^ sketch[x[:, 1]]).sum(axis=1, dtype=np.int64) for x in parts])


def sketch_limit(similarity: float) -> int:
    """Differing bits at a Jaccard index of `similarity`, and four standard deviations more: one pair in 30,000 has more."""
    p = (1 - similarity) / 2
    return int(SKETCH_BITS * p + 4 * (SKETCH_BITS * p * (1 - p)) ** 0.5)


_TURNS = mix(np.arange(1, SKETCH_BITS + 1, dtype=np.uint64)) | np.uint64(1)


def sketch_of(shingles: np.ndarray) -> bytes:
    """One bit of each of SKETCH_BITS minimum hashes: two sketches differ in about (1 - Jaccard index) / 2 of them."""
    least = np.full(SKETCH_BITS, np.iinfo(np.uint64).max)
    for part in np.array_split(shingles, len(shingles) // 2048 + 1):
        if len(part):
            np.minimum(least, (_TURNS[:, None] * part).min(axis=1), out=least)
    return np.packbits((mix(least) & np.uint64(1)).astype(bool)).tobytes()


def trie_pairs(fps: np.ndarray, group: np.ndarray, side: np.ndarray, max_bits: int, check: np.ndarray, max_total: int) -> Iterator[np.ndarray]:
    """All links (i, j), in parts: rows of a group that differ in at most max_bits bits.

    check: more bits of each row, which the trie does not hold; with them a link has at most
    max_total bits.

    Rows are sorted by (group, side, fp). In a group with both sides only links across are sought.
    Node pairs are ranges of rows; all groups are traversed together.
    """
    edge = np.flatnonzero(np.diff(group) != 0) + 1
    lo, hi = np.concatenate([[0], edge]), np.concatenate([edge, [len(fps)]])
    ones = np.concatenate([[0], np.cumsum(side)])
    mid = hi - (ones[hi] - ones[lo])  # where side 1 begins
    whole = (mid == hi) | (mid == lo)
    alo, ahi = lo, np.where(whole, hi, mid)
    blo, bhi = np.where(whole, lo, mid), hi
    err = np.zeros(len(lo), np.int64)
    for bit in range(BITS - 1, -2, -1):
        small = ((ahi - alo) * (bhi - blo) <= LEAF_PAIRS) | (bit < 0)
        if small.any():
            yield from _leaf(fps, check, alo[small], ahi[small], blo[small], bhi[small], max_bits, max_total)
        keep = ~small
        alo, ahi, blo, bhi, err = (x[keep] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            break
        amid, bmid = _split(fps, alo, ahi, bit), _split(fps, blo, bhi, bit)
        same = alo == blo
        always = np.ones_like(same)
        parts = [
            (alo, amid, blo, bmid, err, always),
            (amid, ahi, bmid, bhi, err, always),
            (alo, amid, bmid, bhi, err + 1, always),
            (amid, ahi, blo, bmid, err + 1, ~same),
        ]
        alo, ahi, blo, bhi, err = (
            np.concatenate([p[i][p[5] & (p[4] <= max_bits) & (p[1] > p[0]) & (p[3] > p[2])] for p in parts]) for i in range(5)
        )


def _split(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """In each sorted range with equal upper bits: where the given bit turns 1."""
    ones = np.concatenate([[0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
    return hi - (ones[hi] - ones[lo])


def _bits(values: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values[i] ^ values[j]).astype(np.int64)


def _leaf(fps, check, alo, ahi, blo, bhi, max_bits, max_total) -> Iterator[np.ndarray]:
    """Links between the members of node pairs, some million comparisons at a time."""
    sizes = (ahi - alo) * (bhi - blo)
    for part in np.array_split(np.arange(len(alo)), int(sizes.sum()) // 1_000_000 + 1):
        n = sizes[part]
        at = np.repeat(part, n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = (bhi - blo)[at]
        i, j = alo[at] + k // width, blo[at] + k % width
        d = np.bitwise_count(fps[i] ^ fps[j])
        near = np.flatnonzero((i < j) & (d <= max_bits))
        i, j, d = i[near], j[near], d[near]
        near = d + _bits(check, i, j) <= max_total
        yield np.stack([i[near], j[near]], 1)


def near_links(distinct: DataFrame, max_bits: int = 4, blocks: int = 5, exact: int = 1, max_total: int = 2 * BITS, most: int | None = None, max_apart: int = SKETCH_BITS, second: bool = False) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all at most max_bits apart.

    With columns node and check, links are between nodes, and of at most max_total bits with check's.
    Links of up to blocks - exact bits are all accounted for; of the longer ones, those that leave
    `exact` blocks equal. Links of fewer bits are preferred. With columns root and sketch, links are
    those of links_between instead of forests: between different roots, of at most max_apart
    differing bits of the sketches, each given once; `second` leaves those to the other half's tries that these hold as well.
    """
    tables = _tables(blocks, exact)
    rounds = ["root", "sketch"] if "root" in distinct.columns else []
    if "node" not in distinct.columns:
        distinct = distinct.select("fp", F.col("fp").alias("node"), F.lit(0).cast("long").alias("check"))
    row = F.struct("fp", F.col("node").alias("id"), "check", *rounds)
    signed = lambda x: x - (1 << BITS) if x >= 1 << (BITS - 1) else x
    choices = F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(signed(mask)).cast("long")).alias("value")) for i, (mask, _) in enumerate(tables)])
    placed = distinct.select("fp", row.alias("row"), F.explode(choices).alias("p")).select("fp", "row", "p.*")
    # depth: bits below the chosen blocks by which a large group is split into sub-tries
    large = placed.groupBy("block", "value").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP_ROWS)
    large = checkpointed(large.select("block", "value", F.ceil(F.log2(F.col("n") / GROUP_ROWS)).cast("int").alias("depth")))
    small_table = large.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    placed = placed.join(F.broadcast(large) if small_table else large, ["block", "value"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    next_bit = F.get(F.array(*[F.lit(bit) for _, bit in tables]), F.col("block"))
    below = F.expr("shiftrightunsigned(fp, next_bit) | CASE WHEN next_bit = 0 THEN 0L ELSE shiftleft(fp, 64 - next_bit) END")
    nodes = F.expr("shiftleft(1L, depth) - 1")
    placed = placed.withColumn("next_bit", next_bit).withColumn("node", below.bitwiseAND(nodes))
    # the paths that differ from a node's in at most max_bits of depth bits, built bit by bit: no others are looked at
    none = F.array(F.lit(0).cast("long"))
    with_bit = lambda masks, b: F.concat(masks, F.transform(F.filter(masks, lambda m: F.bit_count(m) < max_bits), lambda m: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))
    masks = F.when(F.col("depth") > 0, F.aggregate(F.sequence(F.lit(0), F.col("depth") - 1), none, with_bit)).otherwise(none)
    others = F.transform(masks, lambda m: m.bitwiseXOR(F.col("node")))
    pairs = placed.select("row", "block", "value", "node", F.explode(others).alias("other")).select(
        "row.*",
        F.xxhash64("block", "value", F.least("node", "other"), F.greatest("node", "other")).alias("grp"),
        (F.col("node") > F.col("other")).cast("int").alias("side"),
        *([F.col("block").alias("table")] if rounds else []),
    )
    masks = np.array([mask for mask, _ in tables], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def between(frame: pd.DataFrame, given: tuple) -> Iterator[np.ndarray]:
            sketch = np.frombuffer(b"".join(frame["sketch"]), np.uint64).reshape(len(frame), -1)
            return links_between(*given, frame["root"].to_numpy(), sketch, max_apart, most, frame["table"].to_numpy(), masks, second)

        def solve(frame: pd.DataFrame) -> Iterator[pa.RecordBatch]:
            fps = frame["fp"].to_numpy().view(np.uint64)
            check, ids = frame["check"].to_numpy().view(np.uint64), frame["id"].to_numpy()
            given = fps, frame["grp"].to_numpy(), frame["side"].to_numpy(), max_bits, check, max_total
            for links in between(frame, given) if rounds else [trie_links(*given)]:
                yield pa.record_batch([pa.array(ids[links[:, i]]) for i in range(2)], ["a", "b"])

        for batch in batches:
            frame = batch.to_pandas()
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            last = int(np.searchsorted(rest["grp"].to_numpy(), rest["grp"].iloc[-1])) if len(rest) else 0
            if last:  # all groups but the one that may go on
                yield from solve(rest.iloc[:last])
                rest = rest.iloc[last:]
        if rest is not None and len(rest):
            yield from solve(rest)

    order = F.col("fp").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned
    ordered = pairs.repartition("grp").sortWithinPartitions("grp", "side", order).select("fp", "id", "check", "grp", "side", *rounds, *(["table"] if rounds else []))
    return ordered.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root: for each node of links(a, b) the smallest node that is reachable.

    Each round gives a node the smallest label among its neighbours and then follows the label's
    own label, so that paths shrink by about half; partial aggregation keeps hubs out of one task.
    """
    both = checkpointed(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node")
    labels = checkpointed(labels)
    while True:
        offered = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("offer"))
        step = labels.join(offered, F.col("node") == F.col("a")).select("node", F.least("label", "offer").alias("new"), F.col("label").alias("old"))
        over = step.select(F.col("node").alias("n2"), F.col("new").alias("jump"))
        step = checkpointed(step.join(over, F.col("new") == F.col("n2"), "left").select("node", F.least("new", F.coalesce("jump", "new")).alias("label"), "old"))
        moved = step.filter(F.col("label") != F.col("old")).limit(1).count()
        labels = step.select("node", "label")
        if not moved:
            return labels.withColumnRenamed("label", "root")


def near_duplicates(docs: DataFrame, k: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fp, component_id for each row of docs(doc_id, text).

    component_id is the smallest doc_id among the rows whose fingerprints a chain of links of at
    most max_bits bits reaches. Null and empty texts have fingerprint 0 and link like any other.
    Null doc_ids are never a component_id unless a component has no other. Repeated rows come out
    as often; an empty table gives no rows; other columns of the input are not read.
    """
    prints = checkpointed(fingerprints(docs, k))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    distinct = checkpointed(distinct)
    roots = components(near_links(distinct.select("fp"), max_bits, *blocks_for(distinct.count(), max_bits)))
    member = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    label = member.join(smallest, "root").select(F.col("fp").alias("f"), "component_id")
    return prints.join(label, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """node, shingles of docs(node, text): hashes of the distinct k-word shingles of the lower-cased text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
            for i, j in cuts(offsets, CHUNK_BYTES):
                sets = [np.unique(h).view(np.int64) for h in text_shingles(*word_hashes(data, offsets[i : j + 1]), k)]
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32), np.concatenate(sets))
                yield pa.record_batch([batch.column(0).slice(i, j - i), lists], ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def sketches(sets: DataFrame) -> DataFrame:
    """node, sketch (see sketch_of) of sets(node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch_of(x.values.to_numpy().view(np.uint64)) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary())], ["node", "sketch"])

    return sets.select("node", "shingles").mapInArrow(run, "node long, sketch binary")


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder: unlike a checkpoint, it does not carry the estimated sizes of its joins on, whose product grows with every round."""
    path = f"{shared_folder(df.sparkSession)}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_of_each_group(docs: DataFrame, k: int = 5, similarity: float = 0.8, max_bits: int = 14, blocks: int = 12, exact: int = 2, max_total: int = 28) -> DataFrame:
    """The rows of docs that stay when one document of each group of near-duplicates is kept.

    Fingerprints have 128 bits here, of distinct shingles. Candidates are nearest ones of at most
    max_total differing bits, max_bits at most in one of the halves, each of which has a trie; two are linked if the Jaccard index of their
    texts' k-word shingles is at least `similarity`, or if all 128 bits are equal. A candidate is
    left unverified only if its ends are connected by links already, or if SKETCH_BITS bits of minimum
    hashes say that its index lies below `similarity` by four standard deviations. Of each connected
    group the row with the smallest doc_id (null before all; ties by a hash of the text) stays, of
    rows repeated with doc_id and text just one. All columns pass through.
    """
    row_hash = F.xxhash64("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.unique(shingle_hashes((t.as_py() or "").encode(), k)) for t in batch.column(2)]
            halves = [pa.array(np.array([majority(h) for h in half], np.uint64).view(np.int64)) for half in (hashes, map(mix, hashes))]
            yield pa.record_batch([batch.column(0), batch.column(1), *halves], ["doc_id", "row_hash", "fp", "check"])

    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash.alias("row_hash"), "text")
    prints = checkpointed(keys.mapInArrow(run, "doc_id long, row_hash long, fp long, check long"))
    node = F.xxhash64("fp", "check")
    distinct = prints.groupBy(node.alias("node"), "fp", "check").agg(F.min(F.struct("doc_id", "row_hash")).alias("first"))

    def candidates(nodes: DataFrame, most: int | None = None) -> DataFrame:
        rest = ["root", "sketch"] if "root" in nodes.columns else []
        halves = nodes.select("fp", "node", "check", *rest), nodes.select(F.col("check").alias("fp"), "node", F.col("fp").alias("check"), *rest)
        a, b = (near_links(half, max_bits, blocks, exact, max_total, most, sketch_limit(similarity), second) for half, second in zip(halves, (False, True)))
        return released(a.unionByName(b).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def judged(links: DataFrame) -> DataFrame:
        sides = links.join(sets.withColumnsRenamed({"node": "a", "shingles": "sa"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "sb"}), "b")
        shared, both = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
        return checkpointed(sides.select("a", "b", (shared >= similarity * (both - shared)).alias("similar")))

    links = candidates(distinct)
    linked = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    chosen = distinct.join(linked, "node").select("node", F.col("first.doc_id").alias("d"), F.col("first.row_hash").alias("h"))
    texts = keys.join(chosen, keys.doc_id.eqNullSafe(F.col("d")) & (keys.row_hash == F.col("h"))).select("node", "text").dropDuplicates(["node"])
    sets = checkpointed(shingle_sets(texts, k))
    tried = judged(links)
    roots = written(components(tried.filter("similar").select("a", "b")).withColumnRenamed("node", "n"))

    # a failed link of the forest may stand before a candidate that would pass: candidates between
    # the components that failed links have left apart are tried too, until none is left
    def end(side: str) -> DataFrame:
        return roots.select(F.col("n").alias(side), F.col("root").alias(f"r{side}"))

    apart = tried.filter("not similar").join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")).filter("ra <> rb")
    apart = checkpointed(apart.select(F.explode(F.array("ra", "rb")).alias("was")).distinct())
    merged = apart.select("was", F.col("was").alias("now"))
    if not apart.isEmpty():
        split = distinct.select("node", "fp", "check").join(roots, F.col("node") == F.col("n"), "left").withColumn("was", F.coalesce("root", "node"))
        split = split.join(apart, "was", "left_semi").select("node", "fp", "check", "was")
        split = checkpointed(split.join(sketches(sets.join(split.select("node"), "node", "left_semi")), "node"))
        for most in ROUNDS:
            now = checkpointed(split.join(merged, "was").select("node", "fp", "check", "sketch", F.col("now").alias("root")))
            between = candidates(now, most)
            fresh = judged(between.join(tried, ["a", "b"], "left_anti"))
            label = now.select("node", "root")
            passed = fresh.filter("similar").select("a", "b").join(label.withColumnsRenamed({"node": "a", "root": "ra"}), "a").join(label.withColumnsRenamed({"node": "b", "root": "rb"}), "b")
            passed = checkpointed(passed.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
            if not passed.isEmpty():
                over = checkpointed(components(passed).select(F.col("node").alias("now"), F.col("root").alias("new")))
                merged = checkpointed(merged.join(over, "now", "left").select("was", F.coalesce("new", "now").alias("now")))
            tried = tried.unionByName(fresh)
    member = distinct.join(roots, F.col("node") == F.col("n"), "left").select("first", F.coalesce("root", "node").alias("was"))
    member = member.join(merged, "was", "left").select("first", F.coalesce("now", "was").alias("root"))
    hash_, d, h = unused(docs, "_row_hash", "_d", "_h")
    kept = member.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(d), F.col("first.row_hash").alias(h))
    own = F.col("doc_id").cast("long")
    marked = docs.withColumn(hash_, row_hash)
    return marked.join(kept, own.eqNullSafe(F.col(d)) & (F.col(hash_) == F.col(h)), "left_semi").dropDuplicates(["doc_id", hash_]).drop(hash_)
