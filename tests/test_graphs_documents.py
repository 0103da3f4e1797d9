"""Graph walks against plain ones, change orders, documents of any depth, canonical JSON."""

import json
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.functions import canonical
from tidewright.operators import catalog, documents, graphs, lint

EDGE = "target_id string, id long, dep long"


def plain_levels(edges):
    deps, nodes = defaultdict(set), set()
    for t, a, b in edges:
        deps[t, a].add((t, b))
        nodes |= {(t, a), (t, b)}
    level = {}
    while free := {v for v in nodes - set(level) if deps[v] <= set(level)}:
        level |= {v: max((level[d] + 1 for d in deps[v]), default=0) for v in free}
    return level, nodes - set(level)


def random_edges(seed):
    rng = random.Random(seed)
    edges = {("any", rng.randrange(45), rng.randrange(45)) for _ in range(60)}
    for _ in range(70):
        a, b = rng.sample(range(60), 2)
        edges.add(("down", max(a, b), min(a, b)))
    return sorted(edges)


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_cycles_and_reach(spark, seed):
    edges = random_edges(seed)
    df = spark.createDataFrame(edges, EDGE)
    levels, cyclic = graphs.levels(df.select("target_id", "id").limit(0), df)
    level, stuck = plain_levels(edges)
    assert {(r[0], r[1]): r[2] for r in levels.collect()} == level
    assert {tuple(r) for r in cyclic.collect()} == stuck
    start = [("any", 1), ("down", 50), ("down", 3), ("none", 7)]
    for forward in (True, False):
        follow = defaultdict(set)
        for t, a, b in edges:
            follow[(t, a) if forward else (t, b)].add((t, b) if forward else (t, a))
        seen, todo = set(start), list(start)
        while todo:
            new = follow[todo.pop()] - seen
            seen |= new
            todo += new
        found = graphs.reachable(spark.createDataFrame(start, "target_id string, id long"), df, forward)
        assert {tuple(r) for r in found.collect()} == seen


def test_a_chain_of_ten_thousand_takes_few_rounds(spark, monkeypatch):
    rounds = []
    plain = graphs.checkpointed
    monkeypatch.setattr(graphs, "checkpointed", lambda df: rounds.append(1) or plain(df))
    n = 10_000
    rows = spark.range(n).select(F.lit("t").alias("target_id"), "id", (F.col("id") + 1).alias("dep"))
    circle = spark.range(50).select(F.lit("u").alias("target_id"), "id", ((F.col("id") + 1) % 50).alias("dep"))
    edges = rows.unionByName(circle).unionByName(spark.createDataFrame([("v", 1, 1), ("v", 0, 1)], EDGE))
    levels, cyclic = graphs.levels(edges.select("target_id", "id").limit(0), edges)
    assert levels.agg(F.max("level"), F.count("*")).first()[:] == (n, n + 1)
    assert {r[0]: r[1] for r in cyclic.groupBy("target_id").count().collect()} == {"u": 50, "v": 2}
    assert len(rounds) < 30  # 14 of them double pointers
    start = spark.createDataFrame([("t", 3)], "target_id string, id long")
    assert graphs.reachable(start, edges).count() == n - 2
    assert graphs.reachable(start, edges, forward=False).count() == 4


def test_long_runs_are_solved_by_samples_and_never_broadcast(spark, monkeypatch):
    monkeypatch.setattr(graphs, "SAMPLED", 30)
    monkeypatch.setattr(graphs, "BROADCAST", 5)
    edges = [("t", i, i + 1) for i in range(150)] + [("u", i, (i + 1) % 60) for i in range(60)] + [("v", 0, 1), ("v", 1, 2), ("v", 2, 1)]
    df = spark.createDataFrame(edges, EDGE)
    levels, cyclic = graphs.levels(df.select("target_id", "id").limit(0), df)
    level, stuck = plain_levels(edges)
    assert {(r[0], r[1]): r[2] for r in levels.collect()} == level
    assert {tuple(r) for r in cyclic.collect()} == stuck


@pytest.mark.parametrize("sampled, broadcast", [(10**6, 20_000), (200, 50)])
def test_pointers_of_scattered_ids_leave_no_growing_estimates(spark, monkeypatch, sampled, broadcast):
    monkeypatch.setattr(graphs, "SAMPLED", sampled)
    monkeypatch.setattr(graphs, "BROADCAST", broadcast)
    bits = []
    plain = graphs.checkpointed

    def watched(df):
        done = plain(df)
        bits.append(done._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return done

    monkeypatch.setattr(graphs, "checkpointed", watched)
    scattered = lambda i: i * 7919 % 10_007
    n, circle = 2000, [3000 + i for i in range(60)]
    rows = [("t", scattered(i), scattered(i + 1)) for i in range(n)] + [("t", scattered(a), scattered(b)) for a, b in zip(circle, circle[1:] + circle[:1])]
    df = spark.createDataFrame(rows, EDGE).repartition(4)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        levels, cyclic = graphs.levels(df.select("target_id", "id").limit(0), df)
        assert {r["id"]: r["level"] for r in levels.collect()} == {scattered(i): n - i for i in range(n + 1)}
        assert {r["id"] for r in cyclic.collect()} == {scattered(i) for i in circle}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert max(bits) < 2000  # a size of so many binary digits is kept for each plan


def test_a_task_moves_its_pointers_as_far_as_its_nodes_lead():
    rows = [("t", 1, 1, 2, 1, True, False), ("t", 2, 2, 3, 5, True, False), ("t", 3, 3, 9, 1, False, True), ("u", 1, 1, 2, 1, True, False), ("v", 7, 7, 8, 1, True, False), ("v", 8, 8, 7, 1, True, False), ("v", 1, 1, 1, 1, True, False)]
    columns = ["target_id", "id", "chain", "end", "distance", "open", "uses"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(columns, r)) for r in part]) for part in (rows[:2], rows[2:])]
    moved = [tuple(r.values()) for b in graphs._move(iter(batches)) for r in b.to_pylist()]
    assert moved == [("t", 1, 3, 9, 7, False, True), ("t", 2, 3, 9, 6, False, True), rows[2], rows[3]]
    assert list(graphs._move(iter([]))) == []


def test_checkpoints_plan_no_broadcast_by_file_size(spark, monkeypatch):
    seen = []
    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "checkpoint", lambda df: seen.append(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")) or df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    graphs.checkpointed(spark.range(1))
    assert seen == ["-1"] and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_a_name_of_many_does_not_meet_all_its_pairs(spark):
    n = 20_000
    side = lambda mark: spark.range(n).select(F.lit("t").alias("target_id"), F.concat(F.lit(mark), F.col("id").cast("string")).alias("id"), F.lit("table").alias("kind"), F.lit(mark).alias("name"), F.lit(None).cast("string").alias("parent"))
    hints = spark.createDataFrame([("t", "a", "b"), ("t", "a1", "b2")], "target_id string, old_name string, new_name string")
    renames, problems = catalog.apply_rename_hints(side("a"), side("b"), hints)
    assert [tuple(r) for r in renames.collect()] == [("t", "a1", "b2")]
    assert [tuple(r) for r in problems.collect()] == [("t", "a", "b", "ambiguous")]


CHANGE = "target_id string, change_id string, op string, before_id string, after_id string, kind string, parent string, name string, ordinal int"


def ordered(spark, rows, current=(), desired=()):
    changes = spark.createDataFrame([("t", *r) for r in rows], CHANGE)
    e = lambda pairs: spark.createDataFrame([("t", a, b) for a, b in pairs], "target_id string, id string, dep string")
    found, cyclic = catalog.change_order(changes, e(current), e(desired))
    return [r["change_id"] for r in found.orderBy("target_id", "level", "sort_key").collect()], {r["change_id"] for r in cyclic.collect()}


def test_changes_wait_for_what_they_need(spark):
    rows = [
        ("alter", "alter", "new", "new", "table", None, "new", None),
        ("rename", "rename", "old", "new", "table", None, "new", None),
        ("col9", "create", None, "c9", "column", "new", "a", 9),
        ("col2", "create", None, "c2", "column", "new", "z", 2),
        ("view", "create", None, "v", "view", None, "v", None),
        ("grant", "create", None, "g", "grant", None, "g", None),
    ]
    order, cyclic = ordered(spark, rows, desired=[("v", "c9"), ("g", "new")])
    assert not cyclic and order == ["rename", "alter", "col2", "col9", "view", "grant"]


def test_drops_go_from_the_leaves(spark):
    rows = [
        ("table", "drop", "t1", None, "table", None, "t", None),
        ("col", "drop", "c1", None, "column", "t1", "c", None),
        ("index", "drop", "i1", None, "index", "t1", "i", None),
        ("grant", "drop", "g1", None, "grant", None, "g", None),
        ("other", "rename", "x", "y", "column", "t1", "x", None),
    ]
    order, cyclic = ordered(spark, rows, current=[("g1", "t1")])
    assert not cyclic and order[0] == "grant" and order[1] == "index" and order.index("col") < order.index("table") and order.index("index") < order.index("other")


def test_cycles_are_reported(spark):
    rows = [(k, "create", None, k, "view", None, k, None) for k in "abcd"]
    order, cyclic = ordered(spark, rows, desired=[("a", "b"), ("b", "a"), ("c", "a")])
    assert order == ["d"] and cyclic == {"a", "b", "c"}


RESOURCE = "target_id string, id string, kind string, name string, parent string, spec string"


def test_a_change_of_dependencies_alone_is_an_alteration(spark):
    rows = spark.createDataFrame([("t", k, "view", k, None, '{"a":1}') for k in "abc"], RESOURCE)
    same = spark.createDataFrame([("t", k, "view", k, None, '{ "a": 1.0 }') for k in "abc"], RESOURCE)
    edge = "target_id string, id string, dep string, type string"
    before = spark.createDataFrame([("t", "a", "x", "uses"), ("t", "a", "y", "uses"), ("t", "b", "x", "uses")], edge)
    after = spark.createDataFrame([("t", "a", "y", "uses"), ("t", "a", "x", "uses"), ("t", "a", "x", "uses"), ("t", "b", "x", "owns")], edge)
    assert [(r["id"], r["op"]) for r in catalog.diff_resources(rows, same, before, after).collect()] == [("b", "alter")]
    assert catalog.diff_resources(rows, same).count() == 0
    notes = lambda *pairs: spark.createDataFrame([("t", k, v) for k, v in pairs], "target_id string, key string, value string")
    digest = lambda e, n: catalog.semantic_fingerprint(rows, e, n).first()["digest"]
    assert digest(before, notes(("k", "1"))) == digest(before, notes(("rename_hints", "x"), ("k", "1.0")))
    assert len({digest(before, notes(("k", "1"))), digest(before, notes(("k", "2"))), digest(after, notes(("k", "1")))}) == 3


def random_document(rng, depth):
    if not depth or rng.random() < 0.3:
        return rng.choice([1, None, 'x"y', [1, {"b": 2, "a": 1}], True, {}, 1.5])
    return {rng.choice(["a", "b", "c", "é", "a b", "a.b"]): random_document(rng, depth - 1) for _ in range(rng.randrange(0, 4))}


def merge(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: merge(a[k], b[k]) if k in a and k in b else b.get(k, a.get(k)) for k in a | b}
    return b


def test_overlay_of_any_depth(spark):
    rng = random.Random(3)
    pairs = [(random_document(rng, 10), random_document(rng, 10)) for _ in range(300)]
    deep = lambda leaf: json.loads('{"k":' * 40 + leaf + "}" * 40)
    pairs.append((deep('{"a":1,"x":2}'), deep('{"a":3}')))
    base = spark.createDataFrame([(i, json.dumps(a)) for i, (a, _) in enumerate(pairs)] + [(1000, '{"x":1}'), (1002, None)], "id long, document string")
    over = spark.createDataFrame([(i, json.dumps(b)) for i, (_, b) in enumerate(pairs)] + [(1001, '{"y":{}}'), (1002, None)], "id long, document string")
    found = {r["id"]: json.loads(r["document"]) for r in documents.overlay(base, over).collect()}
    assert found == {i: merge(a, b) for i, (a, b) in enumerate(pairs)} | {1000: {"x": 1}, 1001: {"y": {}}}


def test_overlaid_texts_are_read_once_at_any_depth(spark, monkeypatch):
    jobs = []
    plain = documents.checkpointed
    monkeypatch.setattr(documents, "checkpointed", lambda df: jobs.append(1) or plain(df))
    deep = lambda leaf: '{"k":' * 60 + leaf + "}" * 60
    odd = [({"a": {"]": 1, "}": ["[", {"x": {}}], '"': 2}, "b\\": {}}, {"a": {"]": [[]], "\uffee": 1, "\U0001f600": 2, "\n": {"c": "{"}}, "b\\": {"d": ":,"}})]
    odd += [({"a": 1}, [1]), ([1], {"a": {"b": 1}}), ({"a": {}}, {"a": 1.50}), ({"a": "1.0"}, {"a": {}}), ({"a": {"b": 1}}, {"a": {}}), ({}, {}), (1, None)]
    pairs = [(deep('{"a":1,"x":2.0}'), deep('{"a":3}'))] + [(json.dumps(a, indent=1), json.dumps(b, ensure_ascii=False)) for a, b in odd]
    side = lambda i: spark.createDataFrame([(n, p[i]) for n, p in enumerate(pairs)], "id long, document string")
    found = documents.overlay(side(0), side(1))
    rows = {r["id"]: r for r in found.select("id", "document", canonical.canonical_json(F.col("document")).alias("normal")).collect()}
    assert [json.loads(rows[n]["document"]) for n in range(len(pairs))] == [merge(json.loads(a), json.loads(b)) for a, b in pairs]
    assert [r["document"] for r in rows.values()] == [r["normal"] for r in rows.values()]
    assert len(jobs) == 2


def test_four_levels_of_documents_take_one_job(spark, monkeypatch):
    jobs = []
    plain = documents.checkpointed
    monkeypatch.setattr(documents, "checkpointed", lambda df: jobs.append(1) or plain(df))
    df = spark.createDataFrame([(1, '{"a":{"b":{"c":{"d":1,"e":{}}}},"x":[1.0]}')], "id long, document string")
    leaves = {("/".join(r["path"]), r["value"]) for r in documents.flatten(df).collect()}
    assert leaves == {("a/b/c/d", "1"), ("a/b/c/e", "{}"), ("x", "[1]")} and len(jobs) == 2
    jobs.clear()
    over = spark.createDataFrame([(1, '{"a":{"b":{"c":{"d":[1.0]}}},"y":{"z":1}}')], "id long, document string")
    assert documents.overlay(df, over).first()["document"] == '{"a":{"b":{"c":{"d":[1],"e":{}}}},"x":[1],"y":{"z":1}}'
    assert len(jobs) == 2


def test_a_number_is_read_once():
    assert str(canonical.number_text(F.lit("1.0"))).count("regexp_extract(") <= 3


@pytest.mark.parametrize(
    "text, normal",
    [
        ("1.0", "1"), ("1e0", "1"), ("10e-1", "1"), ("1E2", "100"), ("0.10", "0.1"), ("-0.0", "0"), ("1e40", "1E40"), ("12e-40", "12E-40"), ("0.00125", "0.00125"),
        ("12345678901234567890.5", "12345678901234567890.5"), ('{"b": [1.0, 2], "a": "1.0E5 \\" 1.0"}', '{"a":"1.0E5 \\" 1.0","b":[1,2]}'), ("nope", None), ('{"a":1,"a":2}', None), ("null", "null"), (None, None),
    ],
)
def test_canonical_json(spark, text, normal):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(canonical.canonical_json(F.col("t"))).first()[0] == normal


def test_defaults_are_compared_as_json(spark):
    specs = [('{"default":{"a":1,"b":2}}', '{"default":{"b":2.0,"a":1}}'), ('{"default":"1"}', '{"default":1}'), ('{"default":null}', "{}"), ('{"default":[1,2]}', '{"default":[2,1]}')]
    rows = [("p", i, f"c{i}", "alter", f"r{i}", "column", "x", a, b) for i, (a, b) in enumerate(specs)]
    df = spark.createDataFrame(rows, "plan_id string, ordinal int, id string, op string, resource_id string, kind string, name string, before string, after string")
    assert sorted(r["change_id"] for r in lint.lint_changes(df).filter("rule = '005'").collect()) == ["c1", "c3"]
