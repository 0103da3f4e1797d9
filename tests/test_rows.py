"""Fixtures and properties of row reconciliation, column evolution and evidence."""

import pytest
from pyspark.sql import functions as F

from tidewright.config import ManagedTable
from tidewright.functions.scalars import glob_regex, transform
from tidewright.operators import evidence, evolve, reconcile

COLUMNS = "code string, label string, updated_at string"


def contract(mode, **more):
    return ManagedTable(keys=("code",), columns=("label", "updated_at"), skip_diff=("updated_at",), mode=mode, **more)


def actions(spark, mode, desired, observed, **more):
    d, o = (spark.createDataFrame(rows, COLUMNS) for rows in (desired, observed))
    return sorted((r["code"], r["action"]) for r in reconcile.reconcile(d, o, contract(mode, **more)).collect())


def test_modes(spark):
    desired = [("active", "Active", "2"), ("new", "New", "2")]
    observed = [("active", "Old", "1"), ("retired", "Retired", "1")]
    assert actions(spark, "insert", desired, observed) == [("new", "insert")]
    assert actions(spark, "upsert", desired, observed) == [("active", "update"), ("new", "insert")]
    # sync plans no updates, unless it is asked to
    assert actions(spark, "sync", desired, observed) == [("new", "insert"), ("retired", "delete")]
    assert actions(spark, "sync", desired, observed, sync_updates=True) == [("active", "update"), ("new", "insert"), ("retired", "delete")]


def test_skipped_columns_make_no_update_and_nulls_are_equal(spark):
    assert actions(spark, "upsert", [("a", None, "2")], [("a", None, "1")]) == []
    assert actions(spark, "upsert", [("a", "x", "1")], [("a", None, "1")]) == [("a", "update")]


def test_apply_reaches_the_declaration_and_refuses_deletes(spark):
    desired = spark.createDataFrame([("a", "1", "x"), ("b", "2", "x")], COLUMNS)
    observed = spark.createDataFrame([("a", "0", "x"), ("c", "3", "x")], COLUMNS)
    table = contract("sync", sync_updates=True)
    plan = reconcile.reconcile(desired, observed, table)
    applied = reconcile.apply_plan(observed, plan, table, approved=True)
    assert sorted(applied.collect()) == sorted(desired.collect())
    assert reconcile.reconcile(desired, applied, table).count() == 0
    with pytest.raises(Exception, match="not approved"):
        reconcile.apply_plan(observed, plan, table).collect()


def test_invalid_declarations(spark):
    rows = spark.createDataFrame([("a", "1", "x"), ("a", "2", "x"), (None, "3", "x")], COLUMNS)
    assert sorted((r["code"] or "", r["reason"]) for r in reconcile.invalid_declaration(rows, contract("insert")).collect()) == [("", "null key"), ("a", "duplicate key")]
    with pytest.raises(ValueError, match="lacks"):
        reconcile.invalid_declaration(rows.drop("label"), contract("insert"))
    with pytest.raises(ValueError):
        ManagedTable(keys=(), columns=("a",))


def test_backfill_is_idempotent_and_casts_must_fit(spark):
    df = spark.createDataFrame([(1, "A", None), (2, None, None), (3, "C", "kept")], "id int, old string, new string")
    once = evolve.backfill(df, "old", "new", "lower(value)")
    assert [r["new"] for r in once.orderBy("id").collect()] == ["a", None, "kept"]
    assert evolve.backfill(once, "old", "new", "lower(value)").exceptAll(once).count() == 0
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        df.select(transform(F.col("old"), "value::int4")).collect()
    with pytest.raises(ValueError):
        transform(F.col("old"), "reverse(value)")


def test_shadow_sync_rules(spark):
    rows = [
        ("insert", None, None, "NAME", None),
        ("insert", None, None, None, "name"),
        ("insert", None, None, "NAME", "other"),
        ("update", "A", "a", "B", "a"),
        ("update", "A", "a", "A", "b"),
        ("update", "A", "a", "B", "c"),
    ]
    df = spark.createDataFrame(rows, "op string, old_old string, old_new string, new_old string, new_new string")
    found = [(r["out_old"], r["out_new"], r["error"]) for r in evolve.shadow_sync(df, "lower(value)", "upper(value)").collect()]
    assert found == [("NAME", "name", None), ("NAME", "name", None), (None, None, "conflict"), ("B", "b", None), ("B", "b", None), (None, None, "conflict")]
    one_way = [r["error"] for r in evolve.shadow_sync(df, "lower(value)", None).collect()]
    assert one_way[1] == "not reversible" and one_way[4] == "not reversible"


def test_fingerprint_ignores_order_and_counts_repeats(spark):
    df = spark.range(200).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("s"))
    one = lambda d: evidence.table_fingerprint(d, ["id", "s"]).first()
    assert one(df) == one(df.orderBy(F.desc("id")).repartition(7))
    assert one(df)["fingerprint"] != one(df.union(df.limit(1)))["fingerprint"]
    assert one(df)["fingerprint"] != one(df.withColumn("s", F.coalesce("s", F.lit(""))))["fingerprint"]
    assert one(df.limit(0))["n_rows"] == 0


def test_uniqueness_and_checks(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (None, 2)], "a int, b int")
    assert tuple(evidence.uniqueness_evidence(df, ["a", "b"]).first()) == (3, 1, 1, False)
    found = evidence.assert_max(df, {"ones": (F.col("a") == 1, 1), "any": (F.col("b") > 0, 3)}).collect()
    assert [(r["name"], r["observed"], r["passed"]) for r in found] == [("ones", 2, False), ("any", 3, True)]
    assert evidence.scalar_assert(df.agg(F.max("b")), F.lit(2)).first()["passed"]
    assert not evidence.scalar_assert(df.agg(F.max("b")), F.lit("2")).first()["passed"]
    assert not evidence.scalar_assert(df.select("b"), F.lit(1)).first()["passed"]


def test_globs_stay_within_a_part():
    import re

    assert re.match(glob_regex("db/*"), "db/a") and not re.match(glob_regex("db/*"), "db/a/b")
    assert re.match(glob_regex("t[12]?"), "t1x") and not re.match(glob_regex("t.1"), "tx1")
