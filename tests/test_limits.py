"""Walks of any depth are whole."""

import inspect

from pyspark.sql import functions as F

from tidewright.operators import catalog, history

CHAIN = [("t", f"n{i}", f"n{i + 1}") for i in range(6)]


def test_walks_have_no_limit(spark):
    for walk in (catalog.reachable, catalog.in_or_behind_cycles, catalog.change_levels, history.reachable_edges):
        assert "max_rounds" not in inspect.signature(walk).parameters
    edges = spark.createDataFrame(CHAIN, "target_id string, id string, dep string")
    start = edges.filter("id = 'n0'").select("target_id", "id")
    assert catalog.reachable(start, edges).count() == 7
    assert catalog.in_or_behind_cycles(edges).count() == 0
    parents = edges.select("id", F.col("dep").alias("parent"))
    begin = start.withColumn("base", F.lit("n6"))
    assert history.reachable_edges(begin, parents).count() == 7


def test_renames_follow_parents_of_any_depth(spark):
    schema = "target_id string, id string, kind string, name string, parent string, spec string"
    rows = lambda mark: spark.createDataFrame([("t", f"{mark}{i}", "part", f"n{i}", f"{mark}{i - 1}" if i else None, "{}") for i in range(8)], schema)
    renames = spark.createDataFrame([("t", "a0", "b0")], "target_id string, old_id string, new_id string")
    assert catalog.propagate_parent_renames(rows("a"), rows("b"), renames).count() == 8
