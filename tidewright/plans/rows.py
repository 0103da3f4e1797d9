"""Queries over declared rows, evolving columns and table evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.config import ManagedTable
from tidewright.functions.expressions import expression
from tidewright.functions.scalars import safe_call, sanitized, stable_id, version_key
from tidewright.operators import evidence, evolve, reconcile
from tidewright.plans.common import Registry, table, multiset_digest_sql

registry = Registry()

CUSTOMERS = ManagedTable(keys=("c_custkey",), columns=("c_name", "c_acctbal", "c_mktsegment"), skip_diff=("c_mktsegment",))
SYNC = ManagedTable(keys=("c_custkey",), columns=("c_name", "c_acctbal", "c_mktsegment"), skip_diff=("c_mktsegment",), mode="sync")
FULL_SYNC = ManagedTable(keys=("c_custkey",), columns=("c_name", "c_acctbal", "c_mktsegment"), skip_diff=("c_mktsegment",), mode="sync", sync_updates=True)


def desired_customers(spark, sf_dir):
    """customer without each tenth row, with changed balances and segments, and with some new rows."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    changed = c.filter(F.col("c_custkey") % 10 != 0).select(
        "c_custkey",
        "c_name",
        F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("MOVED")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    return changed.unionByName(c.filter(F.col("c_custkey") % 50 == 1).withColumn("c_custkey", F.col("c_custkey") + 1_000_000))


DESIRED = """d AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 3 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 10 <> 0
  UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 50 = 1),
p AS (SELECT coalesce(d.c_custkey, o.c_custkey) AS c_custkey,
  CASE WHEN o.c_custkey IS NULL THEN 'insert' WHEN d.c_custkey IS NULL THEN 'delete'
       WHEN d.c_name IS DISTINCT FROM o.c_name OR d.c_acctbal IS DISTINCT FROM o.c_acctbal THEN 'update' END AS action,
  o.c_acctbal AS before_acctbal, d.c_acctbal AS after_acctbal, d.c_name AS d_name, d.c_mktsegment AS d_seg
  FROM d FULL JOIN customer o ON d.c_custkey = o.c_custkey)"""


def _flat(plan):
    return plan.select("c_custkey", "action", F.col("before.c_acctbal").alias("before_acctbal"), F.col("after.c_acctbal").alias("after_acctbal"))


def _plan(spark, sf_dir, contract):
    return reconcile.reconcile(desired_customers(spark, sf_dir), table(spark, sf_dir, "customer"), contract)


@registry.add(f"WITH {DESIRED} SELECT c_custkey, action, before_acctbal, after_acctbal FROM p WHERE action IN ('insert', 'update')")
def j1_reconcile(spark, sf_dir):
    return _flat(_plan(spark, sf_dir, CUSTOMERS))


@registry.add(f"WITH {DESIRED} SELECT c_custkey, action, before_acctbal, after_acctbal FROM p WHERE action IN ('insert', 'delete')")
def j1_reconcile_sync(spark, sf_dir):
    return _flat(_plan(spark, sf_dir, SYNC))


@registry.add("""WITH d AS (SELECT o_custkey AS c_custkey FROM orders UNION ALL SELECT NULL FROM nation)
SELECT c_custkey, CASE WHEN c_custkey IS NULL THEN 'null key' ELSE 'duplicate key' END AS reason, count(*) AS n FROM d GROUP BY c_custkey HAVING c_custkey IS NULL OR count(*) > 1""")
def j2_validate_declaration(spark, sf_dir):
    declared = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).unionAll(table(spark, sf_dir, "nation").select(F.lit(None).cast("long")))
    return reconcile.invalid_declaration(declared, ManagedTable(keys=("c_custkey",), columns=()))


@registry.add(f"""WITH {DESIRED} SELECT count(*) FILTER (action = 'insert') AS inserts, count(*) FILTER (action = 'update') AS updates,
count(*) FILTER (action = 'delete') AS deletes, count(*) FILTER (action = 'delete') > 0 AS requires_approval FROM p""")
def a16_plan_totals(spark, sf_dir):
    return reconcile.plan_totals(_plan(spark, sf_dir, FULL_SYNC))


@registry.add(f"""WITH {DESIRED} SELECT o.c_custkey, c_name, c_acctbal, c_mktsegment FROM customer o JOIN p USING (c_custkey) WHERE action IS NULL
UNION ALL SELECT c_custkey, d_name, after_acctbal, d_seg FROM p WHERE action IN ('insert', 'update')""")
def s11_apply_changes(spark, sf_dir):
    return reconcile.apply_plan(table(spark, sf_dir, "customer"), _plan(spark, sf_dir, FULL_SYNC), FULL_SYNC, approved=True)


@registry.add("SELECT s_suppkey AS id, s_name AS display_name, s_acctbal AS balance FROM supplier")
def p1_version_view(spark, sf_dir):
    return evolve.version_view(table(spark, sf_dir, "supplier"), {"id": "s_suppkey", "display_name": "s_name", "balance": "s_acctbal"})


@registry.add("""WITH e AS (SELECT n_name AS view, i AS position, 'col_' || i AS name FROM nation, range(3) t(i)),
o AS (SELECT n_name AS view, i AS position, CASE WHEN n_nationkey % 4 = 0 AND i = 1 THEN 'renamed' ELSE 'col_' || i END AS name FROM nation, range(3) t(i) WHERE NOT (n_nationkey % 5 = 0 AND i = 2))
SELECT coalesce(e.view, o.view) AS view, coalesce(e.position, o.position) AS position, e.name AS expected, o.name AS observed FROM e FULL JOIN o ON e.view = o.view AND e.position = o.position WHERE e.name IS DISTINCT FROM o.name""")
def p2_view_is_exact(spark, sf_dir):
    columns = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("view"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("position"))
    named = columns.withColumn("name", F.concat(F.lit("col_"), F.col("position").cast("string")))
    renamed = F.when((F.col("n_nationkey") % 4 == 0) & (F.col("position") == 1), "renamed").otherwise(F.col("name"))
    observed = named.filter(~((F.col("n_nationkey") % 5 == 0) & (F.col("position") == 2))).withColumn("name", renamed)
    return evolve.view_is_exact(named, observed)


@registry.add("SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, trim('  ' || p_type || ' ') AS trimmed, CAST(CAST(p_size AS VARCHAR) AS BIGINT) AS size FROM part")
def p3_transform(spark, sf_dir):
    t = evolve.transform
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        t(F.col("p_name"), "upper(value)").alias("up"),
        t(F.col("p_brand"), "lower( value )").alias("low"),
        t(F.concat(F.lit("  "), "p_type", F.lit(" ")), "btrim(value)").alias("trimmed"),
        t(F.col("p_size").cast("string"), "value::int8").alias("size"),
    )


@registry.add("SELECT p_partkey, coalesce(lower(p_brand), trim(p_type)) AS label, substring(p_type, 2, 4) AS part_of_type, abs(p_size - 25) AS distance, length(p_name) AS n FROM part WHERE NOT (p_size = 3 OR p_name IS NULL)")
def p4_safe_expression(spark, sf_dir):
    c = F.col
    return (
        table(spark, sf_dir, "part")
        .filter(~((c("p_size") == 3) | c("p_name").isNull()))
        .select(
            "p_partkey",
            safe_call("coalesce", safe_call("lower", c("p_brand")), safe_call("btrim", c("p_type"))).alias("label"),
            safe_call("substring", c("p_type"), F.lit(2), F.lit(4)).alias("part_of_type"),
            safe_call("abs", c("p_size") - 25).alias("distance"),
            safe_call("length", c("p_name")).alias("n"),
        )
    )


#: An expression tree with each form that is allowed.
TREE = {
    "case": [
        {"when": {"or": [{"is_null": {"column": "p_name"}}, {"and": [{">": [{"column": "p_size"}, {"value": 40}]}, {"not": {"=": [{"column": "p_brand"}, {"value": "Brand#11"}]}}]}]}, "then": {"value": "large"}},
        {"when": {"<=": [{"*": [{"column": "p_size"}, {"value": 2}]}, {"value": 20}]}, "then": {"||": [{"call": "upper", "args": [{"column": "p_type"}]}, {"cast": {"-": [{"column": "p_size"}, {"value": 1}]}, "to": "text"}]}},
    ],
    "else": {"call": "coalesce", "args": [{"value": None}, {"call": "substring", "args": [{"column": "p_name"}, {"value": 1}, {"value": 3}]}]},
}


@registry.add("""SELECT p_partkey, CASE WHEN p_name IS NULL OR (p_size > 40 AND NOT p_brand = 'Brand#11') THEN 'large' WHEN p_size * 2 <= 20 THEN upper(p_type) || (p_size - 1) ELSE substring(p_name, 1, 3) END AS label FROM part""")
def p4_expression_tree(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", expression(TREE, dict(p.dtypes)).alias("label"))


def backfill_parts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return p.withColumn("p_slug", F.when(F.col("p_partkey") % 3 == 0, F.lower("p_name")))


@registry.add("SELECT p_partkey, p_name, lower(p_name) AS p_slug FROM part")
def r7_backfill(spark, sf_dir):
    return evolve.backfill(backfill_parts(spark, sf_dir), "p_name", "p_slug", "lower(value)")


@registry.add("SELECT p_partkey, p_name, CAST(NULL AS VARCHAR) AS p_slug FROM part WHERE p_partkey % 3 <> 0 AND p_name IS NOT NULL ORDER BY p_partkey LIMIT 100")
def o3_eligible_batch(spark, sf_dir):
    return evolve.eligible_batch(backfill_parts(spark, sf_dir), "p_partkey", "p_name", "p_slug", 100)


@registry.add("SELECT count(p_name) AS total, count(p_name) FILTER (p_partkey % 3 = 0) AS processed, count(p_name) FILTER (p_partkey % 3 <> 0) AS remaining, count(p_name) FILTER (p_partkey % 3 <> 0) = 0 AS complete FROM part")
def a3_backfill_progress(spark, sf_dir):
    return evolve.backfill_progress(backfill_parts(spark, sf_dir), "p_name", "p_slug")


@registry.add("SELECT count(*) AS n_rows, count(*) FILTER (p_partkey % 3 <> 0 AND p_name IS NOT NULL) AS n_different FROM part")
def a4_equivalence(spark, sf_dir):
    return evolve.equivalence(backfill_parts(spark, sf_dir), "p_name", "p_slug", "lower(value)")


def order_changes(spark, sf_dir):
    """Change rows of a pair (o_orderpriority, its lower-case twin): all combinations of sides written."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    k = F.col("o_orderkey")
    p = F.col("o_orderpriority")
    return o.select(
        "o_orderkey",
        F.when(k % 2 == 0, "insert").otherwise("update").alias("op"),
        F.when(k % 2 == 1, p).alias("old_old"),
        F.when(k % 2 == 1, F.lower(p)).alias("old_new"),
        F.when(k % 3 == 0, p).when(k % 3 == 1, F.concat(p, F.lit("X"))).alias("new_old"),
        F.when(k % 5 == 0, F.lower(p)).when(k % 5 == 1, F.lit("other")).when(k % 5 == 2, F.concat(F.lower(p), F.lit("x"))).alias("new_new"),
    )


@registry.add("""WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'insert' ELSE 'update' END AS op,
  CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS old_old, CASE WHEN o_orderkey % 2 = 1 THEN lower(o_orderpriority) END AS old_new,
  CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderpriority || 'X' END AS new_old,
  CASE o_orderkey % 5 WHEN 0 THEN lower(o_orderpriority) WHEN 1 THEN 'other' WHEN 2 THEN lower(o_orderpriority) || 'x' END AS new_new FROM orders),
s AS (SELECT *, CASE WHEN op = 'insert' THEN new_old IS NOT NULL ELSE new_old IS DISTINCT FROM old_old END AS so,
  CASE WHEN op = 'insert' THEN new_new IS NOT NULL ELSE new_new IS DISTINCT FROM old_new END AS sn FROM c),
e AS (SELECT *, CASE WHEN so AND sn AND new_new IS DISTINCT FROM lower(new_old) THEN 'conflict' END AS error FROM s)
SELECT o_orderkey, error, CASE WHEN error IS NOT NULL THEN NULL WHEN sn AND NOT so THEN upper(new_new) ELSE new_old END AS out_old,
  CASE WHEN error IS NOT NULL THEN NULL WHEN so AND NOT sn THEN lower(new_old) ELSE new_new END AS out_new FROM e""")
def r6_shadow_sync(spark, sf_dir):
    return evolve.shadow_sync(order_changes(spark, sf_dir), "lower(value)", "upper(value)").select("o_orderkey", "error", "out_old", "out_new")


@registry.add("SELECT p_brand AS \"table\", bool_and(p_size % 50 <> 7 AND p_partkey % 97 <> 0) AS eligible FROM part GROUP BY p_brand")
def a14_rollback_eligible(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select(F.col("p_brand").alias("table"), (F.col("p_size") % 50 == 7).alias("lossy"), (F.col("p_partkey") % 97 != 0).alias("reversible"))
    return evolve.rollback_eligible(pairs)


@registry.add("""SELECT unnest(['big quantity', 'no discount', 'returned']) AS name, unnest([count(*) FILTER (l_quantity > 49), count(*) FILTER (l_discount = 0 AND l_tax > 0.05), count(*) FILTER (l_returnflag = 'R')]) AS observed,
unnest([CAST(100 AS BIGINT), 1000000000, 10]) AS maximum, unnest([count(*) FILTER (l_quantity > 49) <= 100, count(*) FILTER (l_discount = 0 AND l_tax > 0.05) <= 1000000000, count(*) FILTER (l_returnflag = 'R') <= 10]) AS passed FROM lineitem""")
def p5_assert_max(spark, sf_dir):
    c = F.col
    checks = {"big quantity": (c("l_quantity") > 49, 100), "no discount": ((c("l_discount") == 0) & (c("l_tax") > 0.05), 1_000_000_000), "returned": (c("l_returnflag") == "R", 10)}
    return evidence.assert_max(table(spark, sf_dir, "lineitem"), checks)


@registry.add("""WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (l_orderkey IS NULL OR l_linenumber IS NULL), 0) AS BIGINT) AS n_null, count(*) FILTER (n > 1) AS n_duplicate_keys, count(*) FILTER (n > 1) = 0 AS usable FROM k""")
def a5_uniqueness(spark, sf_dir):
    return evidence.uniqueness_evidence(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@registry.add("""SELECT unnest(['not_null:l_orderkey', 'not_null:l_shipdate', 'check:discount', 'check:quantity']) AS "constraint",
unnest([count(*) FILTER (l_orderkey IS NULL), count(*) FILTER (l_shipdate IS NULL), count(*) FILTER (NOT (l_discount BETWEEN 0 AND 1)), count(*) FILTER (NOT l_quantity < 50)]) AS violations FROM lineitem
UNION ALL SELECT 'foreign_key:o_custkey', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 11 <> 0) AND o_custkey IS NOT NULL""")
def a6_constraints(spark, sf_dir):
    c = F.col
    rows = evidence.row_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_shipdate"], {"discount": c("l_discount").between(0, 1), "quantity": c("l_quantity") < 50})
    parents = table(spark, sf_dir, "customer").filter(c("c_custkey") % 11 != 0)
    orphans = evidence.foreign_key_violations(table(spark, sf_dir, "orders"), ["o_custkey"], parents, ["c_custkey"])
    return rows.unionByName(orphans.agg(F.lit("foreign_key:o_custkey").alias("constraint"), F.count("*").alias("violations")))


@registry.add("""WITH r AS (SELECT sha256(concat_ws(chr(31), CASE WHEN o_orderkey IS NULL THEN '0' ELSE '1' || o_orderkey END, CASE WHEN o_custkey IS NULL THEN '0' ELSE '1' || o_custkey END, CASE WHEN o_orderpriority IS NULL THEN '0' ELSE '1' || o_orderpriority END)) AS "row" FROM orders)
SELECT """ + multiset_digest_sql('"row"') + """ AS fingerprint, count(*) AS n_rows FROM r""")
def a7_table_fingerprint(spark, sf_dir):
    return evidence.table_fingerprint(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderpriority"])


@registry.add("SELECT CAST(1 AS BIGINT) AS rows, count(*) FILTER (o_orderkey IS NULL) = 0 AS passed FROM orders")
def a15_scalar_assert(spark, sf_dir):
    return evidence.scalar_assert(table(spark, sf_dir, "orders").agg(F.count_if(F.col("o_orderkey").isNull())), F.lit(0).cast("long"))


@registry.add("""SELECT count(*) AS n_rows, CAST(sum(length('{"n":' || n_nationkey || ',"s":"' || n_name || '"}')) AS BIGINT) AS n_bytes, count(*) <= 10 AND sum(length('{"n":' || n_nationkey || ',"s":"' || n_name || '"}')) <= 4096 AS within FROM nation, range(3)""")
def s4_bounded(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("s"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i")).drop("i")
    return evidence.bounded(rows, 10, 4096)


@registry.add("SELECT s_suppkey, 'table:' || substr(sha256(concat_ws(chr(0), 'table', 'main', '', CAST(s_nationkey AS VARCHAR), s_name)), 1, 24) AS id, regexp_replace(s_name, '[^\\p{L}\\p{Nd}_]', '_', 'g') AS name FROM supplier")
def f_stable_id(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", stable_id(F.lit("table"), F.lit("main"), F.lit(""), F.col("s_nationkey").cast("string"), F.col("s_name")).alias("id"), sanitized(F.col("s_name")).alias("name"))


@registry.add("""WITH v AS (SELECT p_partkey, p_size % 3 AS a, p_partkey % 4 AS b, p_partkey % 5 AS c, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '-rc.' || (p_partkey % 12) ELSE '-beta' END AS pre FROM part),
g AS (SELECT DISTINCT a, b, c, pre FROM v),
k AS (SELECT *, dense_rank() OVER (ORDER BY a, b, c, CASE WHEN pre = '' THEN 1 ELSE 0 END, CASE WHEN pre LIKE '-rc%' THEN 1 ELSE 0 END, CASE WHEN pre LIKE '-rc%' THEN CAST(substr(pre, 5) AS INTEGER) END) AS rank FROM g)
SELECT 'v' || a || '.' || b || '.' || c || pre AS version, CAST(rank AS INTEGER) AS rank FROM k""")
def w13_version_rank(spark, sf_dir):
    from pyspark.sql import Window

    k = F.col("p_partkey")
    pre = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("-rc."), (k % 12).cast("string"))).otherwise("-beta")
    versions = table(spark, sf_dir, "part").select(F.concat(F.lit("v"), F.concat_ws(".", F.col("p_size") % 3, k % 4, k % 5), pre).alias("version")).distinct()
    # distinct versions are few and the ranking is over them, not over rows
    return versions.select("version", F.dense_rank().over(Window.orderBy(version_key(F.col("version")))).alias("rank"))
