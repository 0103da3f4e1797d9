"""An outbox of events: enqueued once however often a batch is repeated, pending until they are finalised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id string, payload string, epoch long"


class Outbox:
    """A folder with events by epoch, a ledger of epochs that are complete, and ids that are finalised.

    An epoch's events are written first and its ledger entry last; events of an epoch without an entry are not seen, and a
    repeated epoch replaces what its first attempt left. Epochs are those of one stream.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._spark, self._root = spark, root

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self._spark.read.schema(schema).parquet(f"{self._root}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self._spark.createDataFrame([], schema)

    def _ledger(self) -> DataFrame:
        return self._read("ledger", "epoch long").distinct()

    def events(self) -> DataFrame:
        """event_id, payload, epoch of complete epochs."""
        return self._read("events", EVENT).join(F.broadcast(self._ledger()), "epoch", "left_semi").select("event_id", "payload", "epoch")

    def enqueue(self, events: DataFrame, epoch: int) -> None:
        """Adds events(event_id, payload) that are not there yet; for foreachBatch. Events without an id or a payload are an error."""
        if not self._ledger().filter(F.col("epoch") == epoch).isEmpty():
            return
        empty = (F.coalesce("event_id", F.lit("")) == "") | (F.coalesce("payload", F.lit("")) == "")
        key = F.when(empty, F.raise_error(F.lit("an event needs an id and a payload")).cast("string")).otherwise(F.col("event_id"))
        fresh = events.select(key.alias("event_id"), "payload").groupBy("event_id").agg(F.min("payload").alias("payload"))
        fresh = fresh.join(self.events().select("event_id"), "event_id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{self._root}/events/epoch={epoch}")
        self._spark.range(1).select(F.lit(True).alias("complete")).coalesce(1).write.mode("overwrite").parquet(f"{self._root}/ledger/epoch={epoch}")

    def pending(self) -> DataFrame:
        """event_id, payload of events that are not finalised."""
        done = self._read("finalised", "event_id string").distinct()
        return self.events().join(done, "event_id", "left_anti").select("event_id", "payload")

    def finalise(self, ids: DataFrame) -> None:
        """Marks events(event_id) as finalised; an id that is not pending is an error, and then none is marked."""
        ids = ids.select("event_id").distinct()
        if not ids.join(self.pending(), "event_id", "left_anti").isEmpty():
            raise ValueError("only pending events can be finalised")
        ids.write.mode("append").parquet(f"{self._root}/finalised")
