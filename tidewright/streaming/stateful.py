"""Structured Streaming twins of the keyed operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewright.functions.scalars import transform
from tidewright.operators.events import GENESIS, sensitive
from tidewright.operators.evolve import eligible, shadow_sync

#: Fixed value: the state store that keeps maps of any size on disk and reads single entries.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
INCIDENT = "target_id long, signature string, first_seen timestamp, last_seen timestamp, resolved_at timestamp, resolved_by string, status string"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """The keyed streams below need this setting before they start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Incidents(StatefulProcessor):
    """A target's incidents: a value for the last sequence, a map of open incidents and one of resolved ones.

    An observation reads its own incident; only a resolution goes through the open ones. `forget_after` (milliseconds) is how
    long a resolved incident is remembered; a signature that comes back later begins a new one.
    """

    def __init__(self, forget_after: int | None = None) -> None:
        self._forget_after = forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        entry = "first timestamp, last timestamp, resolved timestamp, by string"
        self._last = handle.getValueState("last", "seq long")
        self._open = handle.getMapState("open", "signature string", entry)
        self._done = handle.getMapState("done", "signature string", entry, self._forget_after)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen = self._last.get()[0] if self._last.exists() else None
        changed: dict[str, tuple] = {}
        # the order within a micro-batch is that of the sequence; the source's rate bounds what is sorted
        for seq, at, signature, accepted in sorted(((r["seq"], r["at"], r["signature"], r["accepted"]) for r in rows), key=lambda r: r[0]):
            if seen is not None and seq <= seen:
                continue
            seen = seq
            if accepted or signature is None:
                by = "accepted" if accepted else "in_sync"
                for (name,), (first, *_) in list(self._open.iterator()):
                    self._done.updateValue((name,), (first, at, at, by))
                    self._open.removeKey((name,))
                    changed[name] = (first, at, at, by, "resolved")
                continue
            name = (signature,)
            if self._open.containsKey(name):
                first, _, resolved, by = self._open.getValue(name)
            elif self._done.containsKey(name):
                first, _, resolved, by = self._done.getValue(name)
                self._done.removeKey(name)
            else:
                first, resolved, by = at, None, None
            self._open.updateValue(name, (first, at, resolved, by))
            changed[signature] = (first, at, resolved, by, "open")
        if seen is not None:
            self._last.update((seen,))
        for signature, found in sorted(changed.items()):
            yield Row(target_id=key[0], signature=signature, first_seen=found[0], last_seen=found[1], resolved_at=found[2], resolved_by=found[3], status=found[4])

    def close(self) -> None:
        pass


def drift_incidents(observations: DataFrame, forget_after: int | None = None) -> DataFrame:
    """A stream of incidents as they change, from observations(target_id, seq, at, signature; may have accepted).

    A null signature resolves the target's open incidents, and so does a row with accepted = true, by which an operator takes
    the present state as the baseline. An observation that is not later than what was seen is left out. Output mode update; the
    last row per incident holds. Needs keep_state_in_rocksdb.
    """
    accepted = F.coalesce("accepted", F.lit(False)) if "accepted" in observations.columns else F.lit(False)
    rows = observations.select(F.col("target_id").cast("long").alias("target_id"), F.col("seq").cast("long").alias("seq"), "at", "signature", accepted.alias("accepted"))
    return rows.groupBy("target_id").transformWithState(Incidents(forget_after), INCIDENT, "Update", "None" if forget_after is None else "ProcessingTime")


class Chain(StatefulProcessor):
    """A log's head (sequence and hash) as a value, and the ids it holds as a map that is asked one id at a time.

    `forget_after` (milliseconds) bounds how long an id is remembered, if given.
    """

    def __init__(self, forget_after: int | None = None) -> None:
        self._forget_after = forget_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._head = handle.getValueState("head", "sequence long, hash string")
        self._ids = handle.getMapState("ids", "event_id long", "known boolean", self._forget_after)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        sequence, previous = self._head.get() if self._head.exists() else (0, GENESIS)
        for _, event_id, payload in sorted(((r["seq"], r["event_id"], r["payload"]) for r in rows), key=lambda r: r[:2]):
            if self._ids.containsKey((event_id,)):
                continue
            self._ids.updateValue((event_id,), (True,))
            sequence += 1
            own = hashlib.sha256("\0".join(["audit", previous, str(sequence), payload or ""]).encode()).hexdigest()
            yield Row(log_id=key[0], sequence=sequence, previous_hash=previous, hash=own, payload=payload)
            previous = own
        if sequence:
            self._head.update((sequence, previous))

    def close(self) -> None:
        pass


def audit_ingest(events: DataFrame, forget_after: int | None = None) -> DataFrame:
    """A stream of chained records from events(log_id, event_id, seq, payload): idempotent by id, sensitive ones left out.

    A batch reads as many ids of a log's state as it has events, however many the log has. Within a batch events are in order of seq;
    needs keep_state_in_rocksdb.
    """
    clean = events.filter(~sensitive(F.col("payload"))).select(F.col("log_id").cast("long").alias("log_id"), F.col("event_id").cast("long").alias("event_id"), F.col("seq").cast("long").alias("seq"), "payload")
    schema = "log_id long, sequence long, previous_hash string, hash string, payload string"
    return clean.groupBy("log_id").transformWithState(Chain(forget_after), schema, "Append", "None" if forget_after is None else "ProcessingTime")


def shadow_sync_stream(changes: DataFrame, forward: str, reverse: str | None) -> tuple[DataFrame, DataFrame]:
    """(written, dead_letters) of a stream of change rows; no state."""
    judged = shadow_sync(changes, forward, reverse)
    return judged.filter("error is null"), judged.filter("error is not null")


def backfill_stream(rows: DataFrame, source: str, dest: str, forward: str) -> DataFrame:
    """The stream with dest filled where it is eligible; the source's files per trigger are the rate."""
    return rows.withColumn(dest, F.when(eligible(source, dest), transform(F.col(source), forward)).otherwise(F.col(dest)))


def controlled(rows: DataFrame, control: Callable[[], str], sink: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Starts a stream that asks `control` before each batch: run, pause (fail the batch, to be tried again) or cancel."""

    def each(batch: DataFrame, epoch: int) -> None:
        state = control()
        if state != "run":
            raise RuntimeError(f"the stream is to {state}; batch {epoch} is kept for the next start")
        sink(batch)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def notify_once(notifications: DataFrame, deliver: Callable[[DataFrame], None], delivered: str, checkpoint: str, max_attempts: int = 3) -> StreamingQuery:
    """Delivers each (channel, hash) once for ever: delivered keys are a table that each batch is held against."""
    spark = notifications.sparkSession

    def each(batch: DataFrame, epoch: int) -> None:
        try:
            known = spark.read.schema("channel string, hash string").parquet(delivered)
            fresh = batch.dropDuplicates(["channel", "hash"]).join(known, ["channel", "hash"], "left_anti")
        except Exception as e:  # the table begins with the first delivery
            if "PATH_NOT_FOUND" not in str(e):
                raise
            fresh = batch.dropDuplicates(["channel", "hash"])
        for attempt in range(1, max_attempts + 1):
            try:
                deliver(fresh)
                break
            except Exception:
                if attempt == max_attempts:
                    raise
        fresh.select("channel", "hash").write.mode("append").parquet(delivered)

    return notifications.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """A stream of each key's last event, by an aggregate with update output."""
    return events.groupBy(*key).agg(F.max_by(F.struct(*[c for c in events.columns if c not in key]), order).alias("last")).select(*key, "last.*")
