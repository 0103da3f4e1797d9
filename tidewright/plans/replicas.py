"""Queries over replicas of records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewright.plans.common import Registry, table
from tidewright.session import shared_folder
from tidewright.sources import replication, sinks
from tidewright.sources.readers import columns_as_resources

registry = Registry()
c = F.col


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def records(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.concat(F.lit("d"), c("event_id").cast("string")).alias("digest"), c("ts").alias("created_at"), c("event_id").alias("k"))


@registry.add("SELECT 'd' || event_id AS digest, CASE WHEN event_id % 5 = 0 THEN 0 ELSE epoch(date_trunc('second', TIMESTAMP '2024-01-31')) - epoch(date_trunc('second', ts)) END::BIGINT AS lag_seconds FROM events")
def s12_replicate(spark, sf_dir):
    r = records(spark, sf_dir)
    ahead = r.withColumn("created_at", F.when(c("k") % 5 == 0, F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")).otherwise(c("created_at")))
    return sinks.replicate(ahead, now()).select("digest", "lag_seconds")


@registry.add("SELECT 'd' || event_id AS digest, CASE WHEN event_id % 3 = 0 THEN 'primary' ELSE 'backup' END AS origin FROM events WHERE event_id % 3 = 0 OR (event_id % 2 = 0 AND ts >= TIMESTAMP '2024-01-21')")
def s13_read_with_fallback(spark, sf_dir):
    r = records(spark, sf_dir)
    primary = r.filter(c("k") % 3 == 0).select("digest")
    backup = r.filter(c("k") % 2 == 0).select("digest", c("created_at").alias("replicated_at"))
    return sinks.read_with_fallback(primary, backup, now(), 10 * 86400)


@registry.add("SELECT 'd' || event_id AS digest, (epoch(TIMESTAMP '2024-01-31') - epoch(date_trunc('second', ts)))::BIGINT AS age_seconds, (epoch(TIMESTAMP '2024-01-31') - epoch(date_trunc('second', ts))) <= 864000 AS within FROM events")
def s14_staleness_report(spark, sf_dir):
    return sinks.staleness_report(records(spark, sf_dir).withColumnRenamed("created_at", "replicated_at"), now(), 10 * 86400)


@registry.add("""SELECT 'column:' || p_brand || '.' || p_type || '.' || p_partkey AS id, 'column' AS kind, p_brand || '.' || p_type || '.' || p_partkey AS name, 'table:' || p_brand || '.' || p_type AS parent, '{"type":"' || p_name || '","nullable":' || (p_size % 2 = 0) || '}' AS spec FROM part""")
def s9_catalog_snapshot(spark, sf_dir):
    captured = table(spark, sf_dir, "part").select(c("p_brand").alias("table_schema"), c("p_type").alias("table_name"), c("p_partkey").cast("string").alias("column_name"), c("p_name").alias("data_type"), F.when(c("p_size") % 2 == 0, "YES").otherwise("NO").alias("is_nullable"))
    return columns_as_resources(captured)


def new_folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@registry.add("""SELECT 'sha256:' || sha256(e) AS digest, CASE WHEN min(event_id) % 3 = 0 THEN 'first' ELSE 'second' END AS copy, CAST(octet_length(encode(e)) AS BIGINT) AS bytes,
CASE WHEN min(event_id) % 5 = 0 THEN 0 ELSE CAST(epoch(TIMESTAMP '2024-01-31') - epoch(date_trunc('second', min(ts))) AS BIGINT) END AS lag_seconds FROM (SELECT *, event_id || event_type AS e FROM events) GROUP BY e""")
def s12_replicate_objects(spark, sf_dir):
    """Objects replicated in two copies, of which the second holds what the first has not; the replica is verified."""
    folder = new_folder(spark, "replica")
    content = F.concat(c("event_id").cast("string"), "event_type")
    objects = table(spark, sf_dir, "events").select(replication.content_digest(content.cast("binary")).alias("digest"), F.when(c("event_id") % 5 != 0, c("ts").cast("timestamp")).alias("created_at"), content.cast("binary").alias("content"), "event_id")
    replication.replicate(objects.filter(c("event_id") % 3 == 0), folder, "first", now())
    replication.replicate(objects, folder, "second", now())
    sound = replication.manifest(spark, folder).join(replication.verify(spark, folder), "digest", "left_anti")
    return sound.select("digest", "copy", "bytes", replication.lag_seconds(c("created_at"), c("replicated_at"), now()).alias("lag_seconds"))


@registry.add("SELECT 'e' || event_id AS event_id, event_type AS payload FROM events WHERE event_id % 5 <> 0")
def r8_outbox(spark, sf_dir):
    """Three epochs, the second of which comes twice and holds events of the first; each fifth event is finalised."""
    from tidewright.streaming.outbox import Outbox

    box = Outbox(spark, new_folder(spark, "outbox"))
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), c("event_id").cast("string")).alias("event_id"), c("event_type").alias("payload"), c("event_id").alias("k"))
    for epoch, part in ((0, e.filter(c("k") % 3 == 0)), (1, e.filter(c("k") % 2 == 0)), (1, e.filter(c("k") % 2 == 0)), (2, e)):
        box.enqueue(part, epoch)
    box.finalise(e.filter(c("k") % 5 == 0))
    return box.pending()


@registry.add("SELECT count(*) AS n_rows, sum(p_size) AS total FROM part")
def s4_bounded_write(spark, sf_dir):
    """A table that is written under limits that it keeps to, after a write that broke one was refused."""
    from tidewright.config import ManagedTable

    folder = new_folder(spark, "bounded")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    limits = lambda rows, size: ManagedTable(keys=("p_partkey",), columns=("p_size",), max_rows=rows, max_bytes=size)
    try:
        sinks.write_managed(p, limits(None, 100), folder, "v2")
    except sinks.LimitExceeded:
        sinks.write_managed(p, limits(1 << 40, 1 << 50), folder, "v1")
    return sinks.read_current(spark, folder).agg(F.count("*").alias("n_rows"), F.sum("p_size").alias("total"))
