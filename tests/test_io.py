"""Files in and out, and streams against their batch twins."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewright.operators import events, rollout
from tidewright.sources import readers, sinks
from tidewright.streaming import stateful


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1, "s": "x"}, 5, {"id": 2}]')
    (tmp_path / "b.json").write_text('{"id": 3, "s": "z"}')
    rows = readers.read_json(spark, str(tmp_path), "id int, s string")
    assert sorted((r["id"], r["s"]) for r in rows.collect()) == [(1, "x"), (2, None), (3, "z")]


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(" id , s\n1,x\n2,\n")
    assert [tuple(r) for r in readers.read_csv(spark, str(path), "id int, s string").collect()] == [(1, "x"), (2, None)]
    with pytest.raises(ValueError, match="header"):
        readers.read_csv(spark, str(path), "id int, other string")
    path.write_text("id,s\nx,y\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        readers.read_csv(spark, str(path), "id int, s string").collect()


def test_csv_cells_try_booleans_first(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a,b,c\n1,7,x\"y\nf,2.5,true\n")
    rows = readers.read_csv_cells(spark, str(path)).select(*[F.to_json(c).alias(c) for c in "abc"]).collect()
    assert [tuple(r) for r in rows] == [("true", "7", '"x\\"y"'), ("false", "2.5", "true")]


def test_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("- id: 1\n  s: x\n- id: 2\n- 5\n")
    assert sorted(tuple(r) for r in readers.read_yaml(spark, str(tmp_path), "id long, s string").collect()) == [(1, "x"), (2, None)]


def test_digests(spark, tmp_path):
    import hashlib

    for name in "abc":
        (tmp_path / name).write_text(name)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select(F.substring_index("path", "/", -1).alias("path"), "content")
    locks = spark.createDataFrame([("a", "sha256:" + hashlib.sha256(b"a").hexdigest()), ("b", "sha256:0"), ("d", "sha256:1")], "path string, digest string")
    assert {r["path"]: r["status"] for r in readers.verify_digests(files, locks).collect()} == {"a": "verified", "b": "changed", "c": "unlocked", "d": "missing"}


def test_versions_swap_whole(spark, tmp_path):
    root = str(tmp_path / "t")
    sinks.write_version(spark.range(3), root, "v1")
    sinks.write_version(spark.range(5), root, "v2")
    assert sinks.read_current(spark, root).count() == 5
    with pytest.raises(Exception, match="boom"):
        sinks.write_version(spark.range(1).select(F.raise_error(F.lit("boom")).cast("string").alias("id")), root, "v3")
    assert sinks.read_current(spark, root).count() == 5


def stream(spark, df, folder, files):
    """df as a stream of several files, a file a batch, in order of seq."""
    import os
    import time

    rows = df.orderBy("seq").toPandas()
    step = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows.iloc[i * step : (i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    assert os.listdir(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture
def rocksdb(spark):
    stateful.keep_state_in_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_drift_stream_equals_batch_over_a_restart(spark, tmp_path, rocksdb):
    t = datetime(2024, 1, 1)
    signatures = ["a", "b", None, "a", "a", "c", None, "b", None, "a"]
    rows = [(k, i * 3 + k, t + timedelta(minutes=i), signatures[(i + k) % 10], (i + 2 * k) % 9 == 4) for k in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "target_id long, seq long, at timestamp, signature string, accepted boolean")
    source = stream(spark, df, str(tmp_path / "in"), 4)
    out: dict = {}

    def keep(batch, _):
        for r in batch.collect():
            out[(r["target_id"], r["signature"])] = tuple(r)[2:]

    for _ in range(2):  # the second start goes on from the checkpoint
        query = stateful.drift_incidents(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
    batch = rollout.drift_incidents(df.withColumn("resource_id", F.lit("r"))).drop("remediation")
    assert out == {(r["target_id"], r["signature"]): tuple(r)[2:] for r in batch.collect()}
    assert {r["resolved_by"] for r in batch.collect()} >= {"in_sync", "accepted"}


def test_audit_stream_is_idempotent_and_chained(spark, tmp_path, rocksdb):
    rows = [(i % 2, i % 15, i, "password=x" if i == 4 else f"p{i % 15}") for i in range(30)]
    df = spark.createDataFrame(rows, "log_id long, event_id long, seq long, payload string")
    source = stream(spark, df, str(tmp_path / "in"), 3)
    query = stateful.audit_ingest(source).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
    query.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    checked = {r["log_id"]: (r["n"], r["valid"]) for r in events.verify_chain(found).collect()}
    assert checked == {0: (14, True), 1: (15, True)}  # the sensitive one is left out
    first = df.filter("payload not like 'password%'").groupBy("log_id", "event_id").agg(F.min("seq").alias("seq"), F.first("payload").alias("payload"))
    batch = events.append_chain(first, ["seq"])
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, found.select(batch.columns).collect()))


def test_notifications_go_out_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"c{i % 2}", f"h{i % 5}") for i in range(20)], "seq long, channel string, hash string")
    source = stream(spark, df, str(tmp_path / "in"), 2)
    sent, calls = [], []

    def deliver(batch):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("try again")
        sent.extend((r["channel"], r["hash"]) for r in batch.collect())

    for n in range(2):
        stateful.notify_once(source, deliver, str(tmp_path / "delivered"), str(tmp_path / f"ck{n}")).awaitTermination()
    assert sorted(sent) == sorted({(f"c{i % 2}", f"h{i % 5}") for i in range(20)})


def test_backfill_stream_and_control(spark, tmp_path):
    df = spark.createDataFrame([(i, f"N{i}", None if i % 2 else "kept") for i in range(10)], "seq long, old string, new string")
    source = stream(spark, df, str(tmp_path / "in"), 2)
    state, seen = ["pause"], []
    start = lambda: stateful.controlled(stateful.backfill_stream(source, "old", "new", "lower(value)"), lambda: state[0], lambda b: seen.extend(r["new"] for r in b.collect()), str(tmp_path / "ck"))
    with pytest.raises(Exception, match="pause"):
        start().awaitTermination()
    assert seen == []
    state[0] = "run"
    start().awaitTermination()
    assert sorted(seen) == sorted(f"n{i}" if i % 2 else "kept" for i in range(10))
