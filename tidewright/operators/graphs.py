"""Walks over dependency graphs of many targets at once.

edges: target_id, id, dep (id depends on dep; more columns: weight). Runs of nodes with one edge in and
one out are contracted first, within ranges of ids and by pointers that jump twice as far in each round, so that
the rounds of a walk follow the forks of a graph and not its length. A walk keeps what a round finds as a part of its
own; parts are put together now and then, not in each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import checkpointed

KEY = ["target_id", "id"]
#: Parts that are put together into one.
PARTS = 16


class Parts:
    """A table that grows by parts."""

    def __init__(self, first: DataFrame) -> None:
        self._parts = [first]

    def add(self, part: DataFrame) -> None:
        self._parts.append(part)
        if len(self._parts) > PARTS:
            self._parts = [checkpointed(self.all())]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self._parts)


@dataclass(frozen=True)
class Contracted:
    """short: target_id, id, dep, weight, chain: edges between the nodes that stay; chain names the run that an edge goes through.
    used, uses: whether something depends on id, and whether dep depends on something.

    inner: target_id, id, chain, end, distance: the other nodes, the node their run ends at and how far away it is; uses as above.
    loops: target_id, id: nodes of cycles that consist of such nodes only.
    nodes: target_id, id, out, in: the edges of each node.
    """

    short: DataFrame
    inner: DataFrame
    loops: DataFrame
    nodes: DataFrame


#: Pointers beyond the first number double among a sample of the nodes; of those that still move, up to the second are broadcast.
SAMPLED, BROADCAST = 1_000_000, 20_000
#: One node in so many is of a sample.
SAMPLE = 8


#: Types whose pointers move within tasks.
PLAIN = ("string", "bigint", "int")


def _move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's pointers, moved as far as its own nodes lead; circles of these are left out."""
    rows = pa.Table.from_batches(found).combine_chunks() if (found := list(batches)) else None
    if not rows:
        return
    n = len(rows)
    coded = lambda *columns: pa.chunked_array([c for name in columns for c in rows[name].chunks]).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype("int64")
    nodes, targets = coded("id", "end"), coded("target_id") * (2 * n + 1)
    ids, ends = targets + nodes[:n], targets + nodes[n:]
    order = np.argsort(ids)
    at = order[np.minimum(np.searchsorted(ids, ends, sorter=order), n - 1)]
    following = np.where(rows["open"].to_numpy() & (ids[at] == ends), at, -1)
    last, distance = np.arange(n), rows["distance"].to_numpy().copy()
    for _ in range(n.bit_length() + 1):
        moving = np.flatnonzero(following >= 0)
        ahead = following[moving]
        last[moving], distance[moving], following[moving] = last[ahead], distance[moving] + distance[ahead], following[ahead]
    led = rows.select(["chain", "end", "open", "uses"]).take(last)
    moved = pa.table({c: pa.chunked_array([distance]) if c == "distance" else led[c] if c in led.column_names else rows[c] for c in rows.column_names})
    yield from moved.filter(pa.array(following < 0)).to_batches(max_chunksize=10_000)


def _final(pointers: DataFrame) -> DataFrame:
    """target_id, id, chain, end, distance, uses of pointers (with open: end is a pointer's id, too); nodes of circles are left out.

    Each task takes a range of ids and moves its pointers as far as they lead within it. Only the nodes at which a pointer enters
    another range are left to be solved, in the same way, as long as they are fewer by half.
    """
    columns = ["target_id", "id", "chain", "end", "distance", "uses"]
    kinds = dict(pointers.dtypes)
    if kinds["target_id"] not in PLAIN or kinds["id"] not in PLAIN or kinds["id"] != kinds["end"]:
        return _doubled(pointers)
    moved = checkpointed(pointers.repartitionByRange("target_id", "id").mapInArrow(_move, pointers.schema))
    closed = moved.filter("not open").select(columns)
    entered = checkpointed(moved.filter("open").select("target_id", F.col("end").alias("id")).distinct())
    n = entered.count()
    if not n:
        return closed
    if 2 * n > moved.count():
        return _doubled(moved)
    return closed.unionByName(_behind(moved.filter("open"), _final(checkpointed(moved.join(entered, KEY, "left_semi")))))


def _behind(pointers: DataFrame, solved: DataFrame) -> DataFrame:
    """Pointers to solved ones, led on to where these end."""
    ends = solved.select("target_id", F.col("id").alias("end"), F.col("chain").alias("chain2"), F.col("end").alias("end2"), F.col("distance").alias("more"), F.col("uses").alias("uses2"))
    led = pointers.join(ends, ["target_id", "end"])
    return checkpointed(led.select("target_id", "id", F.col("chain2").alias("chain"), F.col("end2").alias("end"), (F.col("distance") + F.col("more")).alias("distance"), F.col("uses2").alias("uses")))


def _doubled(pointers: DataFrame, level: int = 0) -> DataFrame:
    """As _final, for ids whose order says nothing of the runs.

    A round replaces a pointer by that of the node it points to, and only writes pointers that moved. Of many pointers, a
    sample is chosen by hash first: each pointer moves up to the next node of the sample, those of the sample are solved in
    the same way, and the others go on from there, so that the work is in proportion to the nodes and not to their
    logarithm. Pointers meet in windows, not joins: a join's size is estimated as the product of its sides', a number that
    would have twice the digits after each round, and is kept by the driver.
    """
    n = pointers.filter("open").count()
    sampled = n > SAMPLED
    hit = lambda node: F.pmod(F.xxhash64("target_id", node, F.lit(level)), F.lit(SAMPLE)) == 0
    moves = F.col("open") & ~hit("end") if sampled else F.col("open")
    tasks = int(pointers.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a semi join by broadcast has as many as all parts before
    parts, moving, left = Parts(pointers.filter(~moves)), pointers.filter(moves), None
    if sampled:
        n = moving.count()
    node = Window.partitionBy("target_id", "node")
    while n and n != left:
        left = n
        movers = moving.select("target_id", F.col("end").alias("node"), F.struct("id", "distance").alias("mover"))
        own = parts.all().unionByName(moving).select("target_id", F.col("id").alias("node"), F.struct("chain", "end", "distance", "open", "uses").alias("own"))
        if n <= BROADCAST:
            own = own.join(F.broadcast(movers.select("target_id", "node")), ["target_id", "node"], "left_semi")
        elif sampled:
            own = own.filter(~hit("node"))
        met = own.unionByName(movers, allowMissingColumns=True).withColumn("own", F.max("own").over(node)).filter("mover is not null and own is not null")
        moved = met.select("target_id", "mover.id", "own.chain", "own.end", (F.col("mover.distance") + F.col("own.distance")).alias("distance"), "own.open", "own.uses")
        moved = checkpointed(moved).coalesce(tasks)
        parts.add(moved.filter(~moves))
        moving = moved.filter(moves)
        n = moving.count()
    closed = parts.all().filter("not open").drop("open")
    if not sampled:
        return closed
    found = checkpointed(parts.all())
    solved = checkpointed(_doubled(checkpointed(found.filter(hit("id"))), level + 1))
    others = _behind(found.filter(F.col("open") & ~hit("id")), solved)
    return found.filter("not open").drop("open").filter(~hit("id")).unionByName(solved).unionByName(others)


def contract(edges: DataFrame, keep: DataFrame | None = None, nodes: DataFrame | None = None) -> Contracted:
    """edges without the nodes that have one edge in and one out, but for those of keep(target_id, id); more nodes have no edges.

    Each such node points to the next one; pointers that never leave such nodes run in circles.
    """
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1)
    edges = edges.select("target_id", "id", "dep", weight.cast("long").alias("weight")).groupBy("target_id", "id", "dep").agg(F.max("weight").alias("weight"))
    edges = checkpointed(edges)
    ends = edges.select("target_id", F.col("id"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select("target_id", F.col("dep").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    if nodes is not None:
        ends = ends.unionByName(nodes.select(*KEY, F.lit(0).alias("out"), F.lit(0).alias("in")))
    counted = checkpointed(ends.groupBy(*KEY).agg(F.sum("out").alias("out"), F.sum("in").alias("in")))
    # nodes with edges on both sides; all others begin or end each path that they are on
    middle = counted.filter("out > 0 and `in` > 0").select(*KEY, ((F.col("out") == 1) & (F.col("in") == 1)).alias("single"))
    if keep is not None:
        kept = keep.select(*KEY, F.lit(True).alias("_kept")).distinct()
        middle = middle.join(kept, KEY, "left").select(*KEY, (F.col("single") & F.col("_kept").isNull()).alias("single"))
    middle = checkpointed(middle)
    below = middle.select("target_id", F.col("id").alias("dep"), F.col("single").alias("dep_single"))
    looked = edges.join(middle, KEY, "left").join(below, ["target_id", "dep"], "left")
    no = F.lit(False)
    looked = checkpointed(looked.select("target_id", "id", "dep", "weight", F.col("single").isNotNull().alias("used"), F.col("dep_single").isNotNull().alias("uses"), F.coalesce("single", no).alias("single"), F.coalesce("dep_single", no).alias("open")))
    inside = looked.filter("single")
    pointers = inside.select("target_id", "id", F.col("id").alias("chain"), F.col("dep").alias("end"), F.col("weight").alias("distance"), "open", "uses")
    inner = _final(pointers)
    loops = inside.filter("open").select(*KEY).join(inner.select(*KEY), KEY, "left_anti")
    outer = looked.filter("not single")
    into = inner.select("target_id", F.col("id").alias("dep"), F.col("chain"), "end", "distance", F.col("uses").alias("uses2"))
    # no edge leads into a loop from outside: its nodes have one edge in
    through = outer.filter("open").join(into, ["target_id", "dep"])
    through = through.select("target_id", "id", F.col("end").alias("dep"), (F.col("weight") + F.col("distance")).alias("weight"), "chain", "used", F.col("uses2").alias("uses"))
    direct = outer.filter("not open").withColumn("chain", F.lit(None).cast(dict(inner.dtypes)["chain"])).select(through.columns)
    return Contracted(direct.unionByName(checkpointed(through)), inner, checkpointed(loops), counted)


def reachable(start: DataFrame, edges: DataFrame, forward: bool = True) -> DataFrame:
    """target_id, id: start and all that its edges reach (forward: dependencies; else dependents)."""
    if not forward:
        edges = edges.select("target_id", F.col("dep").alias("id"), F.col("id").alias("dep"))
    frontier = checkpointed(start.select(*KEY).distinct())
    graph = contract(edges.select("target_id", "id", "dep"), keep=frontier)
    seen = Parts(frontier)
    while not frontier.isEmpty():
        reached = graph.short.join(frontier, KEY, "left_semi").select("target_id", F.col("dep").alias("id")).distinct()
        frontier = checkpointed(reached.join(seen.all(), KEY, "left_anti"))
        seen.add(frontier)
    found = checkpointed(seen.all())
    runs = graph.short.filter("chain is not null").join(found, KEY, "left_semi").select("target_id", "chain").distinct()
    return found.unionByName(graph.inner.join(runs, ["target_id", "chain"], "left_semi").select(*KEY))


def levels(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(levels, cyclic): target_id, id, level of all nodes that lead into no cycle, and target_id, id of those that do.

    A level is the greatest weight of a path to a node without dependencies (weight 1 an edge, if there is no such column).
    Nodes are freed when all their edges are: a round counts the edges to the nodes freed in the last one, so each edge is
    looked at once. Rounds are for edges between nodes with edges on both sides; nodes without dependencies are freed before
    them, nodes that nothing depends on after them, in one job each.
    """
    graph = contract(edges, nodes=nodes)
    core = checkpointed(graph.short.filter("used and uses").select("target_id", "id", "dep", "weight"))
    base = graph.short.filter("used and not uses").groupBy(*KEY).agg(F.lit(0).cast("long").alias("n"), F.max("weight").alias("level"))
    base = checkpointed(base)
    degrees = checkpointed(core.groupBy(*KEY).agg(F.count("*").alias("degree")))
    frontier = checkpointed(base.join(degrees, KEY, "left_anti").select(*KEY, "level"))
    found = Parts(frontier)
    counts = Parts(base)
    while not frontier.isEmpty():
        freed = frontier.select("target_id", F.col("id").alias("dep"), F.col("level").alias("below"))
        touched = core.join(freed, ["target_id", "dep"]).groupBy(*KEY).agg(F.count("*").alias("n"), F.max(F.col("below") + F.col("weight")).alias("level"))
        touched = checkpointed(touched)
        counts.add(touched)
        total = counts.all().join(touched.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("level").alias("level"))
        frontier = checkpointed(total.join(degrees, KEY).filter("n = degree").select(*KEY, "level"))
        found.add(frontier)
    middle = checkpointed(found.all())
    known = middle.select("target_id", F.col("id").alias("dep"), F.col("level").alias("below"))
    first = graph.nodes.filter("out = 0").select(*KEY, F.lit(0).cast("long").alias("level"))
    # the level of what nothing depends on; null if one of its edges leads to a node without a level
    last = graph.short.filter("not used")
    reached = last.filter("uses").join(known, ["target_id", "dep"], "left").select(*KEY, (F.col("below") + F.col("weight")).alias("level"))
    reached = last.filter("not uses").select(*KEY, F.col("weight").alias("level")).unionByName(reached)
    top = checkpointed(reached.groupBy(*KEY).agg(F.when(F.count("level") == F.count("*"), F.max("level")).alias("level")))
    inner = graph.inner.filter("uses").join(known.withColumnRenamed("dep", "end"), ["target_id", "end"], "left").select(*KEY, (F.col("below") + F.col("distance")).alias("level"))
    inner = checkpointed(inner)
    found_all = reduce(DataFrame.unionByName, [first, middle, top.filter("level is not null"), graph.inner.filter("not uses").select(*KEY, F.col("distance").alias("level")), inner.filter("level is not null")])
    held = checkpointed(core.select(*KEY).distinct().join(middle, KEY, "left_anti"))
    stuck = reduce(DataFrame.unionByName, [held, top.filter("level is null").select(*KEY), inner.filter("level is null").select(*KEY), graph.loops])
    return found_all, stuck


def in_or_behind_cycles(edges: DataFrame) -> DataFrame:
    """target_id, id: nodes of which some path of edges ends in a cycle."""
    return levels(edges.select(*KEY).limit(0), edges)[1]
