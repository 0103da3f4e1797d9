"""Audit logs, inventories and lifecycle events as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions.scalars import digest

#: Fixed value: the previous hash of a log's first record.
GENESIS = "0" * 64


def audit_search(events: DataFrame, since=None, until=None, **equal) -> DataFrame:
    """Events with the given values and within a span of time, both ends included."""
    for column, value in equal.items():
        events = events.filter(F.col(column) == value)
    if since is not None:
        events = events.filter(F.col("at") >= since)
    if until is not None:
        events = events.filter(F.col("at") <= until)
    return events


def export_jsonl(events: DataFrame) -> DataFrame:
    """One JSON line per event, keys in column order, nulls left out."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def record_hash(previous: Column, sequence: Column, payload: Column) -> Column:
    return digest("audit", previous, sequence, payload)


def append_chain(events: DataFrame, order: list[str], retain=None) -> DataFrame:
    """log_id, sequence, previous_hash, hash, payload: events(log_id, payload, order) linked per log from 1.

    A hash needs the one before, so each log is a fold in one task: sorted rows stream through it,
    with one hash kept from batch to batch. Logs are folded side by side.
    """
    import hashlib

    events = events if retain is None else events.filter(retain)
    ordered = events.select("log_id", "payload", *order).repartition("log_id").sortWithinPartitions("log_id", *order).select("log_id", "payload")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, sequence, previous = None, 0, GENESIS
        for batch in batches:
            rows = []
            for log_id, payload in zip(batch["log_id"], batch["payload"]):
                if log_id != log:
                    log, sequence, previous = log_id, 0, GENESIS
                sequence += 1
                text = "\0".join(["audit", previous, str(sequence), payload or ""])
                own = hashlib.sha256(text.encode()).hexdigest()
                rows.append((log_id, sequence, previous, own, payload))
                previous = own
            yield pd.DataFrame(rows, columns=["log_id", "sequence", "previous_hash", "hash", "payload"])

    kind = events.schema["log_id"].dataType.simpleString()
    return ordered.mapInPandas(run, f"log_id {kind}, sequence long, previous_hash string, hash string, payload string")


def verify_chain(log: DataFrame) -> DataFrame:
    """log_id, n, broken, valid: recomputed hashes, links to the record before by an equi-join, and gaps.

    No window over a log: a log of any size is checked in parallel.
    """
    own = log.withColumn("_good", F.col("hash") == record_hash(F.col("previous_hash"), F.col("sequence"), F.col("payload")))
    before = log.select("log_id", (F.col("sequence") + 1).alias("sequence"), F.col("hash").alias("_before"))
    linked = own.join(before, ["log_id", "sequence"], "left").withColumn("_linked", F.coalesce("_before", F.when(F.col("sequence") == 1, GENESIS)).eqNullSafe(F.col("previous_hash")))
    return (
        linked.groupBy("log_id")
        .agg(F.count("*").alias("n"), F.count_if(~(F.col("_good") & F.col("_linked"))).alias("broken"), F.max("sequence").alias("_last"), F.count_distinct("sequence").alias("_distinct"))
        .withColumn("valid", (F.col("broken") == 0) & (F.col("_last") == F.col("n")) & (F.col("_distinct") == F.col("n")))
        .drop("_last", "_distinct")
    )


def deduplicated(events: DataFrame, key: list[str], content: Column, arrival: str) -> tuple[DataFrame, DataFrame]:
    """(events, conflicts): the first arrival of each id; ids that came with other content, with their contents' number."""
    marked = events.withColumn("_fp", content)
    conflicts = marked.groupBy(*key).agg(F.count_distinct("_fp").alias("contents")).filter("contents > 1")
    first = marked.groupBy(*key).agg(F.min_by(F.struct(*events.columns), arrival).alias("e")).select("e.*")
    return first, conflicts


def latest_by_arrival(reports: DataFrame, key: list[str], arrival: str) -> DataFrame:
    """The report of each key that arrived last, whatever time it was observed at."""
    return reports.groupBy(*key).agg(F.max_by(F.struct(*[c for c in reports.columns if c not in key]), arrival).alias("r")).select(*key, "r.*")


def inventory_events(deployments: DataFrame, target: str | None = None, since=None, until=None, **equal) -> DataFrame:
    """Deployments with the given values, and a target among targets (array of structs with target_id)."""
    found = audit_search(deployments, since, until, **equal)
    return found.filter(F.exists("targets", lambda t: t["target_id"] == target)) if target is not None else found


def tag_history(tags: DataFrame, at: str) -> DataFrame:
    """tags(repository, tag, digest, at) with sequence and previous digest."""
    w = W.partitionBy("repository", "tag").orderBy(at)
    return tags.withColumn("sequence", F.row_number().over(w)).withColumn("previous", F.lag("digest").over(w))


def resolve_tags(tags: DataFrame, at: str) -> DataFrame:
    return tags.groupBy("repository", "tag").agg(F.max_by("digest", at).alias("digest"))


def lifecycle_conflicts(events: DataFrame, identity: str, content: list[str]) -> DataFrame:
    """Event ids whose contents differ once their timestamps are left out."""
    return events.groupBy(identity).agg(F.count_distinct(digest("lifecycle", *[F.col(c) for c in content])).alias("contents")).filter("contents > 1")


# -- what must not be stored or shown ----------------------------------------------------------------------------------

#: What marks a text as sensitive, what marks a detail's key or value, and keys that hold secrets.
SENSITIVE = r"(?i)://|[\r\n]|password|passwd|secret|bearer |token ?[=:]|private_key|credential"
SENSITIVE_DETAIL = r"(?i)password|secret|token|private_key|query_result|credential"
SECRET_KEYS = r"(?i)^(.*[_-])?(password|passwd|secret|token|api_?key|dsn)$"


def sensitive(c: Column) -> Column:
    return F.coalesce(c.rlike(SENSITIVE), F.lit(False))


def split_sensitive(df: DataFrame, texts: list[str], details: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected): rows whose texts, or whose map of details by a key or value, look like they hold credentials; with reason."""
    reasons = [F.when(sensitive(F.col(c)), F.lit(c)) for c in texts]
    if details is not None:
        reasons.append(F.when(F.exists(F.map_entries(details), lambda e: e["key"].rlike(SECRET_KEYS) | e["value"].rlike(SENSITIVE) | e["key"].rlike(SENSITIVE_DETAIL) | e["value"].rlike(SENSITIVE_DETAIL)), F.lit(details)))
    marked = df.withColumn("reason", F.array_join(F.array_compact(F.array(*reasons)), ","))
    return marked.filter("reason = ''").drop("reason"), marked.filter("reason <> ''")


def redacted(c: Column) -> Column:
    """Text without URL credentials and without quoted or plain values of secret names."""
    no_user = F.regexp_replace(c, r"://[^/@\s]+@", "://[redacted]@")
    quoted = F.regexp_replace(no_user, r"(?i)\b(password|passwd|secret|token|api_key)(\s*[=:]\s*)(\"[^\"]*\"|'[^']*')", "$1$2[redacted]")
    return F.regexp_replace(quoted, r"(?i)\b(password|passwd|secret|token|api_key)(\s*[=:]\s*)([^\s\"'\[][^\s,;&]*)", "$1$2[redacted]")


def redacted_map(c: Column) -> Column:
    return F.transform_values(c, lambda k, v: F.when(k.rlike(SECRET_KEYS), "[redacted]").otherwise(redacted(v)))


def masked_connection(c: Column) -> Column:
    """A connection reference without user information and without values of secret query keys."""
    no_user = F.regexp_replace(c, r"://[^/@\s]+@", "://***@")
    return F.regexp_replace(no_user, r"(?i)([?&](?:password|token|secret|key)=)[^&#]*", "$1***")
