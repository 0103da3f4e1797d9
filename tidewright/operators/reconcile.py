"""Declared rows against observed rows: plans, checks, totals, applying."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.config import ManagedTable


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def reconcile(desired: DataFrame, observed: DataFrame, table: ManagedTable) -> DataFrame:
    """keys, action (insert, update, delete), before, after: what turns observed rows into desired ones.

    One full outer join on the keys. Columns in skip_diff do not make an update. Mode "insert" plans
    inserts, "upsert" also updates, "sync" inserts and deletes (and updates with sync_updates). Keys
    are taken to be unique and not null; see invalid_declaration.
    """
    names = [*table.keys, *table.columns]
    d = desired.select(*table.keys, F.struct(*names).alias("after"))
    o = observed.select(*table.keys, F.struct(*names).alias("before"))
    compared = [c for c in table.columns if c not in table.skip_diff]
    differs = any_of([~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")) for c in compared])
    action = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").when(differs, "update")
    wanted = {"insert": ["insert"], "upsert": ["insert", "update"], "sync": ["insert", "delete"] + ["update"] * table.sync_updates}[table.mode]
    joined = d.join(o, list(table.keys), "full_outer").withColumn("action", action)
    return joined.filter(F.col("action").isin(wanted)).select(*table.keys, "action", "before", "after")


def invalid_declaration(desired: DataFrame, table: ManagedTable) -> DataFrame:
    """keys, reason, n: rows of a declaration with a null key, and keys that occur more than once."""
    missing = [c for c in (*table.keys, *table.columns) if c not in desired.columns]
    if missing:
        raise ValueError(f"declaration lacks columns {missing}")
    null = any_of([F.col(k).isNull() for k in table.keys])
    counts = desired.groupBy(*table.keys).agg(F.count("*").alias("n"))
    reason = F.when(null, "null key").when(F.col("n") > 1, "duplicate key")
    return counts.withColumn("reason", reason).filter("reason is not null").select(*table.keys, "reason", "n")


def plan_totals(plan: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of actions, and whether the plan needs an approval (it deletes)."""
    count = lambda a: F.count_if(F.col("action") == a)
    return plan.groupBy(*(by or [])).agg(
        count("insert").alias("inserts"),
        count("update").alias("updates"),
        count("delete").alias("deletes"),
        (count("delete") > 0).alias("requires_approval"),
    )


def apply_plan(observed: DataFrame, plan: DataFrame, table: ManagedTable, approved: bool = False) -> DataFrame:
    """observed after the plan: managed columns as in `after`; deletes without approval are refused.

    The refusal is part of the result's plan, so nothing is written when it strikes.
    """
    names = [*table.keys, *table.columns]
    if not approved:
        refuse = F.when(F.col("action") == "delete", F.raise_error(F.lit("the plan deletes rows and is not approved")).cast("string")).otherwise(F.col("action"))
        plan = plan.withColumn("action", refuse)
    kept = observed.select(*names).join(plan.select(*table.keys), list(table.keys), "left_anti")
    written = plan.filter("action <> 'delete'").select("after.*")
    return kept.unionByName(written)
