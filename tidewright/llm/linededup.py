"""Line dedup by site-relative frequency.

For each host, the pages that hold a line are divided by the pages of the host; lines above a
ratio are boilerplate and are dropped. Lines are counted by 96 bits of hashes with a partial
aggregate, so a hot host or line costs a row per task. What is dropped per host is a short list (a
host has at most lines per page / ratio boilerplate lines) that is joined back by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import checkpointed, unused

#: Lists with at most so many hashes in all are broadcast; larger ones are joined by a shuffle.
MAX_BROADCAST = 500_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(F.trim(line)).alias("h"), F.hash(F.trim(line)).alias("h2"))


def boilerplate(pages: DataFrame, host: str = "host", text: str = "text", ratio: float = 0.1, min_pages: int = 2) -> DataFrame:
    """host, hashes: the lines that more than `ratio` of the host's pages hold, and at least min_pages.

    With min_pages = 2 a line of a single page is no boilerplate, even of a host with few pages.
    """
    lines = F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: F.trim(x) != ""), _hash))
    held = pages.select(F.col(host).alias("host"), F.explode(lines).alias("line"))
    counts = held.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    totals = pages.groupBy(F.col(host).alias("h")).agg(F.count("*").alias("total"))
    frequent = counts.join(totals, F.col("host").eqNullSafe(F.col("h"))).filter(F.col("n") > F.col("total") * ratio)
    return frequent.groupBy("host").agg(F.collect_list("line").alias("hashes"))


def drop_boilerplate(
    pages: DataFrame, host: str = "host", text: str = "text", ratio: float = 0.1, min_pages: int = 2, counts: tuple[str, str] | None = ("n_lines", "n_dropped")
) -> DataFrame:
    """pages with the boilerplate lines of their host taken out of `text`.

    Lines are compared without blanks around them; blank lines are never dropped. A page that is
    boilerplate throughout keeps its blank lines only. Null and
    empty texts stay as they are. Null hosts are one host. Rows that are repeated count as pages
    each. Other columns pass through. counts: names of two more columns, the lines of a page and
    those dropped, which take the place of columns of these names; None for none.
    """
    own_host, hashes_, all_, kept_, dropped_ = unused(pages, "_host", "_hashes", "_all", "_kept", "_dropped")
    lists = checkpointed(boilerplate(pages, host, text, ratio, min_pages).withColumnsRenamed({"host": own_host, "hashes": hashes_}))
    size = lists.agg(F.coalesce(F.sum(F.size(hashes_) + 1), F.lit(0))).first()[0]
    joined = pages.join(F.broadcast(lists) if size <= MAX_BROADCAST else lists, F.col(host).eqNullSafe(F.col(own_host)), "left")
    hashes = F.coalesce(hashes_, F.expr("cast(array() as array<struct<h:bigint,h2:int>>)"))
    dropped = F.size(all_) - F.size(kept_)
    lines = (
        joined.withColumn(all_, _lines(F.col(text)))
        .withColumn(kept_, F.when(F.size(hashes) == 0, F.col(all_)).otherwise(F.filter(all_, lambda x: (F.trim(x) == "") | ~F.array_contains(hashes, _hash(x)))))
        .withColumn(dropped_, dropped.cast("long"))
        .withColumn(text, F.when(F.col(dropped_) == 0, F.col(text)).otherwise(F.array_join(kept_, "\n")))
    )
    if counts is not None:
        lines = lines.withColumns({counts[0]: F.size(all_).cast("long"), counts[1]: F.col(dropped_)})
    return lines.drop(own_host, hashes_, all_, kept_, dropped_)
