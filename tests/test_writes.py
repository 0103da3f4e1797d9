"""Replicas, the outbox, writes under limits, measured backfills and expression trees."""

import os
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewright.config import ManagedTable
from tidewright.functions.expressions import Refused, expression
from tidewright.sources import replication, sinks
from tidewright.streaming.outbox import Outbox

def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def objects(spark, names):
    rows = [(n.encode(), datetime(2024, 1, 31)) for n in names]
    df = spark.createDataFrame(rows, "content binary, created_at timestamp")
    return df.withColumn("digest", replication.content_digest(F.col("content")))


def test_replicas_hold_what_the_manifest_names(spark, tmp_path):
    to = str(tmp_path / "replica")
    assert replication.replicate(objects(spark, "abc"), to, "one", now()).count() == 3
    assert replication.replicate(objects(spark, "abcd"), to, "two", now()).count() == 1
    assert replication.manifest(spark, to).count() == 4 and replication.replicas(spark, to).count() == 4
    assert replication.verify(spark, to).count() == 0
    lag = replication.lag_seconds(F.col("created_at"), F.col("replicated_at"), now())
    assert {r[0] for r in replication.manifest(spark, to).select(lag).collect()} == {86400}


def test_a_torn_copy_is_not_seen_and_not_in_the_way(spark, tmp_path):
    to = str(tmp_path / "replica")
    replication.replicate(objects(spark, "ab"), to, "one", now())
    forged = objects(spark, "cd").withColumn("digest", F.when(F.col("content") == F.lit(b"d"), "sha256:0").otherwise(F.col("digest")))
    with pytest.raises(Exception, match="other content"):
        replication.replicate(forged, to, "torn", now())
    # what a lost driver leaves behind: objects without a manifest
    objects(spark, "x").select("digest", "created_at", F.lit(1).cast("long").alias("bytes"), "content").write.parquet(f"{to}/objects/copy=half")
    assert replication.replicas(spark, to).count() == 2
    assert replication.replicate(objects(spark, "abx"), to, "two", now()).count() == 1
    assert replication.verify(spark, to).count() == 0
    # a copy that was damaged later
    part = next(f for f in os.listdir(f"{to}/objects/copy=one") if f.startswith("part"))
    shutil.copy(f"{to}/objects/copy=half/{next(f for f in os.listdir(f'{to}/objects/copy=half') if f.startswith('part'))}", f"{to}/objects/copy=one/{part}")
    crc = f"{to}/objects/copy=one/.{part}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    assert {r["problem"] for r in replication.verify(spark, to).collect()} == {"missing"}


def test_files_are_objects(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a").write_bytes(b"one")
    (tmp_path / "in" / "deep" / "b").write_bytes(b"two")
    found = replication.objects_of_files(spark, str(tmp_path / "in"))
    assert replication.replicate(found, str(tmp_path / "replica"), "files", now()).count() == 2
    assert sorted(bytes(r["content"]) for r in replication.replicas(spark, str(tmp_path / "replica")).collect()) == [b"one", b"two"]


def test_the_outbox_survives_a_restart_in_mid_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(3):
        spark.range(10 * i, 10 * i + 12).select(F.concat(F.lit("e"), "id").alias("event_id"), F.lit("{}").alias("payload")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("event_id string, payload string").option("maxFilesPerTrigger", 1).parquet(source)
    box, fail = Outbox(spark, str(tmp_path / "box")), [1]

    def each(batch, epoch):
        if epoch == fail[0]:
            # events are there, the ledger is not
            batch.select("event_id", "payload").write.mode("overwrite").parquet(str(tmp_path / f"box/events/epoch={epoch}"))
            raise OSError("lost")
        box.enqueue(batch, epoch)
        box.enqueue(batch, epoch)

    start = lambda: stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    assert box.pending().count() == 12
    fail[0] = -1
    start().awaitTermination()
    assert sorted(r["event_id"] for r in box.pending().collect()) == sorted(f"e{i}" for i in range(32))
    box.finalise(spark.createDataFrame([("e1",), ("e2",)], "event_id string"))
    assert box.pending().count() == 30
    with pytest.raises(ValueError, match="pending"):
        box.finalise(spark.createDataFrame([("e1",), ("e3",)], "event_id string"))
    assert box.pending().count() == 30
    with pytest.raises(Exception, match="needs an id"):
        box.enqueue(spark.createDataFrame([("", "x")], "event_id string, payload string"), 99)


def test_a_table_beyond_its_limits_leaves_nothing(spark, tmp_path):
    root, df = str(tmp_path / "t"), spark.range(100)
    limits = lambda **k: ManagedTable(keys=("id",), columns=("x",), **k)
    assert sinks.write_managed(df, limits(max_rows=100, max_bytes=100_000), root, "v1")["rows"] == 100
    for bad in (limits(max_rows=99), limits(max_rows=10), limits(max_bytes=50)):
        with pytest.raises(sinks.LimitExceeded):
            sinks.write_managed(df, bad, root, "v2")
        assert os.listdir(f"{root}/versions") == ["v1"]
    assert sinks.read_current(spark, root).count() == 100


def test_backfills_are_measured_by_the_job_that_writes(spark, tmp_path):
    ledger, out, t = str(tmp_path / "ledger"), str(tmp_path / "out"), datetime(2024, 1, 1)
    for epoch in (0, 1, 1):
        batch = spark.createDataFrame([(i, "x" if i % 2 else None, t + timedelta(hours=epoch)) for i in range(10)], "id long, new string, at timestamp")
        sinks.backfill_batch(batch, epoch, "new", "at", lambda df, e=epoch: df.write.mode("overwrite").parquet(f"{out}/{e}"), ledger)
    rates = sinks.backfill_rates(spark.read.parquet(ledger), F.lit("2024-01-01 03:00:00").cast("timestamp")).first()
    assert (rates["batches"], rates["rows"], rates["filled"], rates["lag_seconds"]) == (2, 20, 10, 7200) and rates["rows_per_second"] > 0


TYPES = {"a": "string", "n": "bigint", "b": "boolean", "xs": "array<int>"}


@pytest.mark.parametrize(
    "tree",
    [
        "lower(a)", {"column": "none"}, {"column": "xs"}, {"call": "now", "args": []}, {"call": "lower", "args": [{"column": "n"}]}, {"call": "lower", "args": []}, {"cast": {"column": "a"}, "to": "json"},
        {"+": [{"column": "a"}, {"value": 1}]}, {"=": [{"column": "a"}, {"value": 1}]}, {"and": [{"column": "b"}]}, {"not": {"column": "n"}}, {"%": [{"value": 1}, {"value": 2}]}, {"value": [1]}, {"case": []}, {"and": {"column": "b"}},
        {"case": [{"when": {"column": "b"}, "then": {"value": 1}}], "else": {"value": "x"}}, {"call": "coalesce", "args": []}, {"column": "a", "value": 1},
    ],
)
def test_everything_else_is_refused(spark, tree):
    with pytest.raises(Refused):
        expression(tree, TYPES)


def test_trees_keep_to_three_values(spark):
    df = spark.createDataFrame([(None, 1, None), ("X", 5, True)], "a string, n bigint, b boolean")
    tree = {"case": [{"when": {"and": [{"column": "b"}, {">": [{"column": "n"}, {"value": 2}]}]}, "then": {"call": "lower", "args": [{"column": "a"}]}}, {"when": {"is_null": {"column": "b"}}, "then": {"cast": {"/": [{"column": "n"}, {"value": 2}]}, "to": "text"}}]}
    assert [r[0] for r in df.select(expression(tree, dict(df.dtypes))).collect()] == ["0.5", "x"]
