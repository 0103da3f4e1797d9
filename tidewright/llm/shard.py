"""Sharding by balanced label propagation.

Documents with equal texts are linked. The few groups that are large against a shard are laid out
first, on as few shards as they fit. Every other document starts on a shard of its own hash; in each
round, linked documents move towards the shard that holds most of their group, as far as that
shard's quota allows, until no document moves. A group is kept as at most one cell per start shard, so a group of
any size is a few rows, and cells move whole. Documents without links then fill the shards up to
exact quotas; no step ranks rows in one task. DataFrame functions only.
"""

from __future__ import annotations

from itertools import count as numbers

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.llm.common import checkpointed, shuffle_partitions

#: A group of more than 1 / (LARGE * shards) of all rows is large; there are fewer than LARGE * shards.
LARGE = 4


def _numbers(values: list[float], kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def _per_shard(df: DataFrame, shard: str, n: str, shards: int) -> list[int]:
    found = {r[0]: r[1] for r in df.groupBy(shard).agg(F.sum(n)).collect() if r[0] is not None}  # a row a shard
    return [found.get(s, 0) for s in range(shards)]


def place_large(groups: list[tuple[bytes, int]], quota: list[int]) -> tuple[dict[bytes, list[tuple[int, int]]], list[int]]:
    """({group: [(shard, rows)]}, rows left per shard): large groups on as few shards as they fit, the largest first."""
    left, placed = list(quota), {}
    for grp, n in sorted(groups, key=lambda g: (-g[1], g[0])):
        placed[grp] = []
        while n and max(left) > 0:
            whole = [s for s, x in enumerate(left) if x >= n]
            s = min(whole, key=lambda s: left[s]) if whole else max(range(len(left)), key=lambda s: left[s])
            put = min(n, left[s])
            placed[grp].append((s, put))
            left[s] -= put
            n -= put
    return placed, left


def _drawn(u: Column, weights: list[int]) -> Column:
    """A shard drawn by its weight: u is uniform in [0, 1)."""
    total = max(sum(weights), 1)
    ends = _numbers([sum(weights[: i + 1]) / total for i in range(len(weights) - 1)], "double")
    return F.size(F.filter(ends, lambda end: end <= u)).cast("int")


def propagate(cells: DataFrame, quota: list[int]) -> DataFrame:
    """cells(grp, home, n) with the shard that label propagation gives each.

    A cell moves to the shard with most rows of its group (ties by a hash), within what that shard
    has room for and gives away in the same round; if more want to move, a hash of cell and round
    chooses. It ends when no cell wants to move, or none can. A group's best shard only gains by moves and stays its best, so
    it does end.
    """
    shards = len(quota)
    cells = checkpointed(cells.withColumn("shard", F.col("home")))
    load = _per_shard(cells, "shard", "n", shards)
    for step in numbers():
        votes = F.sum("n").over(W.partitionBy("grp", "shard"))
        rank = F.struct(F.col("votes"), F.xxhash64("grp", "shard").alias("tie"), F.col("shard").alias("shard"))
        wish = cells.withColumn("votes", votes).withColumn("rank", rank).withColumn("best", F.max("rank").over(W.partitionBy("grp")))
        wish = checkpointed(wish.select("grp", "home", "n", "shard", F.when(F.col("best.shard") != F.col("shard"), F.col("best.shard")).alias("to")))
        moving = wish.filter("to is not null")
        wanted, leaving = _per_shard(moving, "to", "n", shards), _per_shard(moving, "shard", "n", shards)
        room = [max(q - x + int(0.9 * out), 0) for q, x, out in zip(quota, load, leaving)]
        if not sum(min(w, r) for w, r in zip(wanted, room)):
            return wish.select("grp", "home", "n", "shard")
        share = [r / w if r < w else 1.0 for r, w in zip(room, wanted)]
        draw = F.pmod(F.xxhash64("grp", "home", F.lit(step)), F.lit(1 << 20)) / (1 << 20)
        moves = draw < F.get(_numbers(share, "double"), F.col("to"))
        cells = checkpointed(wish.withColumn("shard", F.when(moves, F.col("to")).otherwise(F.col("shard"))).select("grp", "home", "n", "shard"))
        load = _per_shard(cells, "shard", "n", shards)
    raise AssertionError("numbers end")


def _shuffled_rank(df: DataFrame, key: str, parts: int) -> DataFrame:
    """df with rank: rows of equal key numbered from 0, by hash parts of bounded size and their offsets."""
    df = df.withColumn("part", F.pmod(F.xxhash64("doc_id", "grp", F.lit("part")), F.lit(parts)).cast("int"))
    sizes = df.groupBy(key, "part").agg(F.count("*").alias("n"))  # (shards + 1) * parts rows
    before = F.coalesce(F.sum("n").over(W.partitionBy(key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col(key).alias("k"), F.col("part").alias("p"), before.alias("before"))
    numbered = df.withColumn("within", F.row_number().over(W.partitionBy(key, "part").orderBy("doc_id", "grp")) - 1)
    return numbered.join(offsets, (F.col(key) == F.col("k")) & (F.col("part") == F.col("p"))).withColumn("rank", F.col("before") + F.col("within")).drop("k", "p", "before", "within", "part")


def shard_rows(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs(doc_id, text).

    Shards' row counts differ by one at most; slots are gapless from 0 in each shard. size: UTF-8
    bytes plus 1. Rows with equal texts stay on one shard as far as quotas allow. Null texts count
    as empty, null doc_ids are values as any other, repeated rows have slots of their own. An empty
    table gives no rows; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = checkpointed(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.md5(text)).alias("grp"),
        )
    )
    count = rows.count()
    quota = [count // shards + (s < count % shards) for s in range(shards)]
    # at most LARGE * shards groups are so large; they are placed before the others, which start in what is left
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"))
    large = [(bytes(r[0]), r[1]) for r in sizes.filter(F.col("n") > max(count / (LARGE * shards), 1)).collect()]
    placed_large, left = place_large(large, quota)
    draw = F.pmod(F.xxhash64("doc_id", "grp"), F.lit(1 << 30)) / (1 << 30)
    home = F
    for grp, pieces in placed_large.items():
        home = home.when(F.col("grp") == F.lit(grp), _drawn(draw, [sum(n for t, n in pieces if t == s) for s in range(shards)]))
    home = home.otherwise(_drawn(draw, left)) if placed_large else _drawn(draw, left)
    rows = rows.withColumn("home", home)
    cells = rows.groupBy("grp", "home").agg(F.count("*").alias("n"))
    linked = cells.withColumn("all", F.sum("n").over(W.partitionBy("grp"))).filter(F.col("all") > 1).drop("all")
    settled = F.col("grp").isin([F.lit(g) for g in placed_large]) if placed_large else F.lit(False)
    fixed = linked.filter(settled).withColumn("shard", F.col("home"))
    free = [q - x for q, x in zip(quota, _per_shard(fixed, "shard", "n", shards))]
    labels = propagate(linked.filter(~settled), free).unionByName(fixed).select(F.col("grp").alias("g"), F.col("home").alias("h"), F.col("shard").alias("label"))
    # rows without links have the label `shards`: the pool
    placed = rows.join(labels, (F.col("grp") == F.col("g")) & (F.col("home") == F.col("h")), "left").select("doc_id", "size", "text_crc32", "grp", F.coalesce("label", F.lit(shards)).alias("label"))
    ranked = checkpointed(_shuffled_rank(placed, "label", shuffle_partitions(docs.sparkSession)))
    load = _per_shard(ranked.select("label", F.lit(1).alias("n")), "label", "n", shards + 1)
    over = [max(x - q, 0) for x, q in zip(load, quota)]
    room = [max(q - x, 0) for x, q in zip(load, quota)]
    over_before = [load[shards] + sum(over[:s]) for s in range(shards)]
    room_before = [sum(room[:s]) for s in range(shards)]
    limit = F.get(_numbers(quota + [0], "long"), F.col("label"))
    stays = (F.col("label") < shards) & (F.col("rank") < limit)
    pool_rank = F.when(F.col("label") == shards, F.col("rank")).otherwise(F.get(_numbers(over_before + [0], "long"), F.col("label")) + F.col("rank") - limit)
    target = F.size(F.filter(_numbers([b + r for b, r in zip(room_before, room)], "long"), lambda end: end <= F.col("pool_rank")))
    moved_slot = F.get(_numbers([q - r for q, r in zip(quota, room)], "long"), F.col("target")) + F.col("pool_rank") - F.get(_numbers(room_before, "long"), F.col("target"))
    return (
        ranked.withColumn("stays", stays)
        .withColumn("pool_rank", pool_rank)
        .withColumn("target", target)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.when(F.col("stays"), F.col("label")).otherwise(F.col("target")).cast("int").alias("shard"),
            F.when(F.col("stays"), F.col("rank")).otherwise(moved_slot).cast("long").alias("slot"),
        )
    )
