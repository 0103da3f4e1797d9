"""Traps of catalog, policy, statistics, events and rollouts."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewright.config import Thresholds
from tidewright.functions.scalars import version_key
from tidewright.operators import catalog, events, governance, lint, rollout, stats

RESOURCE = "target_id string, id string, kind string, name string, parent string, spec string"


def test_diff_of_itself_is_empty_in_any_order(spark):
    rows = [("t", f"r{i}", "table", f"n{i}", None, "{}") for i in range(50)]
    a = spark.createDataFrame(rows, RESOURCE)
    b = spark.createDataFrame(rows[::-1], RESOURCE).repartition(3)
    assert catalog.diff_resources(a, b).count() == 0
    assert catalog.semantic_fingerprint(a).collect() == catalog.semantic_fingerprint(b).collect()


def test_rename_across_parents_is_refused(spark):
    a = spark.createDataFrame([("t", "c1", "column", "x", "p", "{}")], RESOURCE)
    b = spark.createDataFrame([("t", "c2", "column", "y", "q", "{}")], RESOURCE)
    hints = spark.createDataFrame([("t", "x", "y")], "target_id string, old_name string, new_name string")
    renames, problems = catalog.apply_rename_hints(a, b, hints)
    assert renames.count() == 0 and problems.first()["problem"] == "other parent"


def test_levels_refuse_cycles(spark):
    nodes = spark.createDataFrame([("t", "a"), ("t", "b")], "target_id string, id string")
    edges = spark.createDataFrame([("t", "a", "b"), ("t", "b", "a")], "target_id string, id string, dep string")
    with pytest.raises(ValueError, match="cycle"):
        catalog.change_levels(nodes, edges)
    assert catalog.in_or_behind_cycles(edges).count() == 2


def test_policy_is_two_valued_and_numbers_are_exact(spark):
    df = spark.createDataFrame([(None, "9007199254740993"), ("x", "9007199254740992")], "owner string, n string")
    rule = lambda r: [x[0] for x in df.select(governance.compile_rule(r, {"owner": F.col("owner"), "n": F.col("n").cast("decimal(38,0)")})).collect()]
    assert rule({"eq": {"ref": "owner", "value": "x"}}) == [False, True]
    assert rule({"ne": {"ref": "owner", "value": "x"}}) == [False, False]
    assert rule({"not": {"ne": {"ref": "owner", "value": "x"}}}) == [True, True]
    assert rule({"eq": {"ref": "n", "value": 9007199254740993}}) == [True, False]
    with pytest.raises(ValueError, match="itself"):
        governance.compile_rule({"predicate": "p"}, {}, predicates={"p": {"not": {"predicate": "p"}}})


def test_thresholds_are_strict_and_off_at_zero(spark):
    df = spark.createDataFrame([("t", 100, 4)], "target_id string, total_bytes long, dead_rows long")
    codes = lambda **k: [r["code"] for r in stats.evaluate_thresholds(df, Thresholds(**k), ["target_id"]).collect()]
    assert codes(table_bytes=100) == [] and codes(table_bytes=99) == ["table_bytes"] and codes(dead_rows=3, table_bytes=0) == ["dead_rows"]


def test_retention_keeps_the_cutoff(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t), ("a", t - timedelta(minutes=30)), ("a", t - timedelta(hours=1))], "target_id string, observed_at timestamp_ntz")
    assert stats.retain_snapshots(df, 1800, 10).count() == 2
    assert stats.retain_snapshots(df, 1800, 1).count() == 1


def test_unknown_sizes_raise_severity(spark):
    df = spark.createDataFrame([("p", "c", "r", "102", "warning", "access exclusive", True, True)], "plan_id string, change_id string, resource_id string, rule string, severity string, lock string, scan boolean, rewrite boolean")
    none = spark.createDataFrame([], "resource_id string, estimated_rows long, total_bytes long")
    found = lint.escalate(lint.with_table_stats(df, none), max_rows=10).first()
    assert found["severity"] == "error" and found["why"] == "unproven estimated_rows"
    assert lint.escalate(lint.with_table_stats(df, none)).first()["severity"] == "warning"


@pytest.mark.parametrize(
    "before, after, narrow",
    [("varchar(10)", "varchar(9)", True), ("text", "varchar(9)", True), ("bigint", "int", True), ("int4", "int8", False), ("numeric(10,2)", "numeric(10,3)", True), ("numeric", "numeric(5,1)", True), ("numeric(5,1)", "decimal", False), ("integer", "text", False)],
)
def test_narrowing(spark, before, after, narrow):
    assert spark.range(1).select(lint.narrows(F.lit(before), F.lit(after))).first()[0] is narrow


def test_versions_order(spark):
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.10.0", "v2.0.0"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "v string")
    assert [r[0] for r in df.orderBy(version_key(F.col("v"))).collect()] == order


def test_chain_breaks_on_any_edit(spark):
    rows = [(1, i, f"p{i}") for i in range(6)] + [(2, 0, "x")]
    log = events.append_chain(spark.createDataFrame(rows, "log_id long, seq long, payload string"), ["seq"])
    assert all(r["valid"] for r in events.verify_chain(log).collect())
    for column, value in (("payload", F.lit("y")), ("previous_hash", F.lit("0" * 64)), ("hash", F.lit("1" * 64)), ("sequence", F.lit(9).cast("long"))):
        edited = log.withColumn(column, F.when((F.col("log_id") == 1) & (F.col("sequence") == 3), value).otherwise(F.col(column)))
        assert {r["log_id"]: r["valid"] for r in events.verify_chain(edited).collect()} == {1: False, 2: True}, column
    gap = log.filter(~((F.col("log_id") == 1) & (F.col("sequence") == 3)))
    assert not events.verify_chain(gap).filter("log_id = 1").first()["valid"]


def test_inventory_is_by_arrival(spark):
    df = spark.createDataFrame([("t", 1, "2024-02-01", "late"), ("t", 2, "2024-01-01", "early")], "target_id string, arrival long, observed_at string, status string")
    assert events.latest_by_arrival(df, ["target_id"], "arrival").first()["status"] == "early"


def test_canary(spark):
    rows = [("r", "a", False, None, 1), ("r", "b", True, None, 1), ("s", "a", False, None, 0), ("s", "b", True, None, 0), ("u", "a", False, "passed", 1), ("u", "b", True, None, 1)]
    df = spark.createDataFrame(rows, "rollout string, id string, ok boolean, resumed string, canary int")
    states = {(r["rollout"], r["id"]): r["state"] for r in rollout.canary_outcome(df, ["rollout"], "id", "canary").collect()}
    assert states == {("r", "a"): "failed", ("r", "b"): "skipped", ("s", "a"): "failed", ("s", "b"): "passed", ("u", "a"): "passed", ("u", "b"): "passed"}
    status = {r["rollout"]: r["status"] for r in rollout.rollout_outcome(rollout.canary_outcome(df, ["rollout"], "id", "canary"), ["rollout"]).collect()}
    assert status == {"r": "failed", "s": "failed", "u": "passed"}


def test_label_key_must_exist(spark):
    df = spark.createDataFrame([("a", {"tier": "x"}), ("b", {"zone": "x"}), ("c", None)], "id string, labels map<string,string>")
    assert [r["id"] for r in rollout.select_targets(df, labels={"tier": "*"}).collect()] == ["a"]


def test_reopened_incident_keeps_its_resolution(spark):
    t = datetime(2024, 1, 1)
    at = [t + timedelta(hours=i) for i in range(4)]
    rows = [("t", 0, at[0], "s", "r"), ("t", 1, at[1], None, "r"), ("t", 2, at[2], "s", "r"), ("t", 3, at[3], "other", "r")]
    df = spark.createDataFrame(rows, "target_id string, seq long, at timestamp_ntz, signature string, resource_id string")
    found = {r["signature"]: r for r in rollout.drift_incidents(df, ["r"]).collect()}
    s = found["s"]
    assert (s["first_seen"], s["last_seen"], s["resolved_at"], s["status"], s["remediation"]) == (at[0], at[2], at[1], "open", False)


def test_redaction(spark):
    df = spark.createDataFrame([('postgres://u:p@h/d token = "abc" password=x, ok',)], "t string")
    assert df.select(events.redacted(F.col("t"))).first()[0] == "postgres://[redacted]@h/d token = [redacted] password=[redacted], ok"


@pytest.mark.parametrize(
    "sql, found",
    [
        ("do $fn$ ; truncate t $fn$", []),
        ("/* a /* b */ ; truncate t */ select 1", []),
        ('select 1 as "a;truncate b"', []),
        ("select 'it''s ;' -- ; truncate x\n; TRUNCATE only t", ["002"]),
        ("/* no end ; truncate t", ["unread_comment"]),
        ("/*" + "x" * 100_000 + "*/ truncate t", ["002"]),
        ("select '" + "x''" * 50_000 + "'; truncate t", ["002"]),
        ("create function f() as $b$ begin execute 'drop ' || t; end $b$", ["202"]),
        ("with x as (select 1) insert into t select * from x", ["206"]),
        ("create table a (b text check (b like 'x'))", []),
        ("", []),
        (None, []),
    ],
)
def test_statement_rules_look_at_commands(spark, sql, found):
    s = spark.createDataFrame([("p", "c", sql, None)], "plan_id string, change_id string, sql string, transactional boolean")
    changes = spark.createDataFrame([("p", "c", "r")], "plan_id string, id string, resource_id string")
    assert sorted(r["rule"] for r in lint.lint_statements(s, changes).collect()) == found
