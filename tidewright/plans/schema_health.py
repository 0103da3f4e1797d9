"""Queries over schema statistics and lint rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.config import Thresholds
from tidewright.operators import evidence, lint, stats
from tidewright.plans.common import Registry, table

registry = Registry()
c = F.col


def fleet(spark, sf_dir):
    """(tables, indexes, constraints) of one snapshot per nation: customers are tables, orders indexes, and lines constraints."""
    cust = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").join(cust.select(c("c_custkey").alias("o_custkey"), c("c_nationkey").alias("target_id")), "o_custkey")
    tables = cust.select(c("c_nationkey").alias("target_id"), c("c_custkey").alias("id"), (c("c_custkey") * 1000).alias("total_bytes"), (c("c_custkey") % 100).alias("dead_rows"))
    indexes = orders.select("target_id", c("o_orderkey").alias("id"), F.when(c("o_orderkey") % 10 == 0, -1).otherwise(c("o_custkey")).alias("table_id"), (c("o_orderkey") % 4).alias("scans"))
    kinds = F.when(c("o_orderkey") % 2 == 0, "FOREIGN_KEY").otherwise("check_constraint")
    return tables, indexes, orders.select("target_id", c("o_orderkey").alias("id"), kinds.alias("kind"))


FLEET = """t AS (SELECT c_nationkey AS target_id, count(*) AS tables, CAST(sum(c_custkey * 1000) AS BIGINT) AS total_bytes, CAST(sum(c_custkey % 100) AS BIGINT) AS dead_rows FROM customer GROUP BY 1),
o AS (SELECT c_nationkey AS target_id, o_orderkey, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey),
i AS (SELECT target_id, count(*) AS indexes, count(*) FILTER (o_orderkey % 4 = 0) AS unused_indexes, count(*) AS constraints, count(*) FILTER (o_orderkey % 2 = 0) AS foreign_keys FROM o GROUP BY 1),
m AS (SELECT target_id, max(n) AS max_indexes FROM (SELECT target_id, o_custkey, count(*) AS n FROM o WHERE o_orderkey % 10 <> 0 GROUP BY ALL) GROUP BY 1),
s AS (SELECT t.*, coalesce(indexes, 0) AS indexes, coalesce(constraints, 0) AS constraints, coalesce(foreign_keys, 0) AS foreign_keys, coalesce(unused_indexes, 0) AS unused_indexes, coalesce(max_indexes, 0) AS max_indexes,
CAST(tables + CAST(0.5 AS DECIMAL(4,2)) * coalesce(indexes, 0) + CAST(0.75 AS DECIMAL(4,2)) * coalesce(foreign_keys, 0) + coalesce(unused_indexes, 0) AS DECIMAL(18,2)) AS score FROM t LEFT JOIN i USING (target_id) LEFT JOIN m USING (target_id))"""


@registry.add(f"WITH {FLEET} SELECT * FROM s")
def a1_complexity(spark, sf_dir):
    return stats.complexity(*fleet(spark, sf_dir), ["target_id"])


@registry.add(f"""WITH {FLEET} SELECT target_id, code, CAST(value AS DECIMAL(20,2)) AS value, CAST(maximum AS DECIMAL(20,2)) AS maximum, 'warning' AS severity FROM (
SELECT target_id, 'complexity' AS code, score AS value, 900 AS maximum FROM s UNION ALL SELECT target_id, 'dead_rows', dead_rows, 3000 FROM s
UNION ALL SELECT target_id, 'table_bytes', total_bytes, 45000000 FROM s UNION ALL SELECT target_id, 'unused_indexes', unused_indexes, 150 FROM s) WHERE value > maximum""")
def a2_thresholds(spark, sf_dir):
    found = stats.complexity(*fleet(spark, sf_dir), ["target_id"])
    return stats.evaluate_thresholds(found, Thresholds(table_bytes=45_000_000, dead_rows=3000, unused_indexes=150, complexity=900), ["target_id"])


def order_snapshots(spark, sf_dir):
    """A snapshot per customer and day of orders; the schema digest changes now and then."""
    days = table(spark, sf_dir, "orders").groupBy(c("o_custkey").alias("target_id"), c("o_orderdate").alias("observed_at")).agg(F.sum(F.round(c("o_totalprice")).cast("bigint")).alias("total_bytes"))
    return days.withColumn("schema_digest", F.concat(F.lit("v"), (F.year("observed_at") % 2).cast("string")))


SNAPSHOTS = "sn AS (SELECT o_custkey AS target_id, o_orderdate AS observed_at, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS total_bytes, 'v' || (year(o_orderdate) % 2) AS schema_digest FROM orders GROUP BY ALL)"


@registry.add(f"""WITH {SNAPSHOTS} SELECT *, CASE WHEN lag(schema_digest) OVER w = schema_digest THEN total_bytes - lag(total_bytes) OVER w END AS growth FROM sn WINDOW w AS (PARTITION BY target_id ORDER BY observed_at)""")
def w4_growth(spark, sf_dir):
    return stats.growth(order_snapshots(spark, sf_dir))


@registry.add(f"""WITH {SNAPSHOTS}, y AS (SELECT *, max(observed_at) OVER (PARTITION BY target_id) AS newest FROM sn),
r AS (SELECT target_id, observed_at, total_bytes, schema_digest, row_number() OVER (PARTITION BY target_id ORDER BY observed_at DESC) AS rn FROM y WHERE observed_at >= newest - INTERVAL 400 DAY)
SELECT target_id, observed_at, total_bytes, schema_digest FROM r WHERE rn <= 3""")
def w3_retain_snapshots(spark, sf_dir):
    return stats.retain_snapshots(order_snapshots(spark, sf_dir), 400 * 86400, 3)


@registry.add(f"""WITH {SNAPSHOTS}, g AS (SELECT *, CASE WHEN lag(schema_digest) OVER w = schema_digest THEN total_bytes - lag(total_bytes) OVER w END AS growth FROM sn WINDOW w AS (PARTITION BY target_id ORDER BY observed_at))
SELECT target_id, observed_at, 'growth_bytes' AS code, CAST(growth AS DECIMAL(20,2)) AS value, CAST(200000 AS DECIMAL(20,2)) AS maximum, 'warning' AS severity FROM g WHERE growth > 200000""")
def a2_growth_findings(spark, sf_dir):
    return stats.evaluate_thresholds(stats.growth(order_snapshots(spark, sf_dir)), Thresholds(growth_bytes=200_000), ["target_id", "observed_at"])


@registry.add(f"WITH {SNAPSHOTS} SELECT * FROM sn WHERE target_id = 7 AND observed_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-01-01'")
def p8_snapshot_range(spark, sf_dir):
    from datetime import datetime

    return stats.snapshot_range(order_snapshots(spark, sf_dir), 7, datetime(1996, 1, 1), datetime(1998, 1, 1))


@registry.add("""SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderkey % 9 = 0 THEN 'status is required' END, CASE WHEN o_totalprice - 20000 < 0 THEN 'balance is negative' END, CASE WHEN o_orderkey % 9 = 0 OR o_orderstatus = 'P' THEN 'status is unknown' END], lambda x: x IS NOT NULL)) AS reason FROM orders""")
def p15_validate_records(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(c("o_orderkey") % 9 == 0, " ").otherwise(c("o_orderstatus")).alias("status"), (c("o_totalprice") - 20000).alias("balance"))
    return stats.invalid_records(o, ["status"], ["balance"], {"status": ["O", "F"]}, ["o_orderkey"])


# -- lint: changes and statements made from parts by templates ---------------------------------------------------------

_CHANGES = [  # op, kind, name, before, after, rules
    ("drop", "table", "public.old_parts", "{}", None, ["001", "101"]),
    ("rename", "table", "public.parts", "{}", "{}", ["007", "101"]),
    ("create", "column", "public.parts.size_mm", None, '{"type":"integer","not_null":true,"default":"random()"}', ["004", "005", "102", "104"]),
    ("create", "check_constraint", "public.parts.Positive", None, "{}", ["006", "201"]),
    ("alter", "column", "public.parts.name", '{"type":"varchar(40)"}', '{"type":"varchar(20)"}', ["003", "102"]),
    ("alter", "column", "public.parts.price", '{"type":"bigint","nullable":true}', '{"type":"integer","nullable":false}', ["003", "004", "102", "104"]),
    ("alter", "column", "public.parts.note", '{"type":"varchar"}', '{"type":"text","default":"now()"}', ["005"]),
    ("alter", "check_constraint", "public.parts.in_range", '{"definition":"a > 0"}', '{"definition":"a > 1"}', ["006"]),
    ("create", "column", "public.parts.brand", None, '{"type":"text","nullable":true}', []),
    ("alter", "column", "public.parts._weight", '{"type":"numeric(10,2)"}', '{"type":"decimal(12,2)"}', ["102", "201"]),
]
_STATEMENTS = [  # sql, transactional, rules
    ("TRUNCATE part", None, ["002"]),
    ("create index i on part (p_size)", None, ["103"]),
    ("-- c\nCREATE UNIQUE INDEX CONCURRENTLY i on part(p)", None, ["105"]),
    ("drop index concurrently i", False, []),
    ("alter type kind add value 'x'", None, ["105"]),
    ("alter table part validate constraint k", None, ["104"]),
    ("execute format('drop table %s', x)", None, ["202"]),
    ("create table copy as select * from part", None, ["203", "206"]),
    ("select 'truncate' /* create index */ ; update part set p = 1", None, ["206"]),
    ("select * into archive from part", None, ["203", "206"]),
]
_SEVERITY = {"001": "error", "002": "error", "003": "error", "105": "error", "202": "error", "206": "info"}


def _template(values, kind="string"):
    """The value of a row's template, by p_partkey."""
    picked = F.array(*[F.lit(v).cast(kind) for v in values])
    return F.get(picked, (c("p_partkey") % len(values)).cast("int"))


def changes(spark, sf_dir):
    columns = dict(zip(["op", "kind", "name", "before", "after"], zip(*[t[:5] for t in _CHANGES])))
    p = table(spark, sf_dir, "part")
    return p.select(c("p_brand").alias("plan_id"), c("p_partkey").alias("ordinal"), F.concat(F.lit("ch"), "p_partkey").alias("id"), F.concat(F.lit("r"), (c("p_partkey") % 500).cast("string")).alias("resource_id"), *[_template(v).alias(k) for k, v in columns.items()])


def statements(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(c("p_brand").alias("plan_id"), F.concat(F.lit("ch"), "p_partkey").alias("change_id"), _template([s[0] for s in _STATEMENTS]).alias("sql"), _template([s[1] for s in _STATEMENTS], "boolean").alias("transactional"))


def _expected(templates, last):
    pairs = [(i, r) for i, t in enumerate(templates) for r in t[last]]
    rows = ", ".join(f"({i}, '{r}', '{_SEVERITY.get(r, 'warning')}')" for i, r in pairs)
    return f"SELECT p_brand AS plan_id, 'ch' || p_partkey AS change_id, 'r' || (p_partkey % 500) AS resource_id, rule, severity FROM part JOIN (VALUES {rows}) x(t, rule, severity) ON p_partkey % {len(templates)} = t"


_BRIEF = ["plan_id", "change_id", "resource_id", "rule", "severity"]


@registry.add(_expected(_CHANGES, 5))
def l_changes(spark, sf_dir):
    return lint.lint_changes(changes(spark, sf_dir), version=16).select(_BRIEF)


@registry.add(_expected(_STATEMENTS, 2))
def l_statements(spark, sf_dir):
    return lint.lint_statements(statements(spark, sf_dir), changes(spark, sf_dir)).select(_BRIEF)


@registry.add(f"""WITH f AS ({_expected(_CHANGES, 5)} UNION ALL {_expected(_STATEMENTS, 2)}) SELECT rule, severity, count(*) AS n FROM f GROUP BY ALL""")
def u3_all_findings(spark, sf_dir):
    ch = changes(spark, sf_dir)
    both = lint.run_analyzers({"changes": lambda: lint.lint_changes(ch, version=16), "statements": lambda: lint.lint_statements(statements(spark, sf_dir), ch)})
    return both.groupBy("rule", "severity").agg(F.count("*").alias("n"))


@registry.add("""WITH ch AS (SELECT p_brand AS plan_id, 'r' || (p_partkey % 500) AS resource_id, p_partkey, ['drop','rename','create','create','alter','alter','alter','alter','create','alter'][p_partkey % 10 + 1] AS op FROM part),
l AS (SELECT *, lag(op) OVER w AS o, lag(p_partkey) OVER w AS k FROM ch WINDOW w AS (PARTITION BY plan_id, resource_id ORDER BY p_partkey))
SELECT plan_id, 'ch' || p_partkey AS change_id, resource_id FROM l WHERE k IS NOT NULL AND (o <> op OR k <> p_partkey)""")
def w8_merge_conflicts(spark, sf_dir):
    return lint.merge_conflicts(changes(spark, sf_dir)).select("plan_id", "change_id", "resource_id")


def table_stats(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter(c("p_partkey") % 500 < 400)
    return p.groupBy(F.concat(F.lit("r"), (c("p_partkey") % 500).cast("string")).alias("resource_id")).agg(F.sum(c("p_size").cast("bigint") * 1000).alias("estimated_rows"), F.sum(c("p_size").cast("bigint") * 100000).alias("total_bytes"))


_STATS = "ts AS (SELECT 'r' || (p_partkey % 500) AS resource_id, CAST(sum(p_size * 1000) AS BIGINT) AS estimated_rows, CAST(sum(p_size * 100000) AS BIGINT) AS total_bytes FROM part WHERE p_partkey % 500 < 400 GROUP BY 1)"


@registry.add(f"""WITH {_STATS}, f AS (SELECT * FROM ({_expected(_CHANGES, 5)}) LEFT JOIN ts USING (resource_id)),
w AS (SELECT plan_id, change_id, rule, severity, concat_ws(', ', CASE WHEN rule IN ('102', '104') THEN CASE WHEN estimated_rows IS NULL THEN 'unproven estimated_rows' WHEN estimated_rows > 100000 THEN 'exceeded estimated_rows' END END,
 CASE WHEN rule = '102' THEN CASE WHEN estimated_rows IS NULL THEN 'unproven rewrite_bytes' WHEN total_bytes > 12000000 THEN 'exceeded rewrite_bytes' END END) AS why FROM f)
SELECT plan_id, change_id, rule, why, CASE WHEN why <> '' THEN 'error' ELSE severity END AS severity FROM w""")
def l19_threshold_escalation(spark, sf_dir):
    found = lint.with_table_stats(lint.lint_changes(changes(spark, sf_dir), version=16), table_stats(spark, sf_dir))
    return lint.escalate(found, max_rows=100_000, max_bytes=12_000_000).select("plan_id", "change_id", "rule", "why", "severity")


def suppressions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = c("p_partkey")
    expires = F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, F.lit("2020-01-01 00:00:00")).otherwise(F.lit("2030-01-01 00:00:00")).cast("timestamp_ntz")
    return p.filter(k % 4 == 0).select(F.lit("001").alias("rule"), F.concat(F.lit("r"), (k % 500).cast("string")).alias("object_id"), k.alias("ordinal"), F.concat(F.lit("reason "), k.cast("string")).alias("reason"), expires.alias("expires_at"))


_SUPPRESSED = f"""sp AS (SELECT 'r' || (p_partkey % 500) AS resource_id, min(p_partkey) AS k FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 3 <> 1 GROUP BY 1),
f AS (SELECT f.*, k FROM ({_expected(_CHANGES, 5)}) f LEFT JOIN sp ON f.resource_id = sp.resource_id AND f.rule = '001')"""


def _suppressed(spark, sf_dir):
    found = lint.lint_changes(changes(spark, sf_dir), version=16)
    return lint.apply_suppressions(found, suppressions(spark, sf_dir), F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))


@registry.add(f"WITH {_SUPPRESSED} SELECT plan_id, change_id, rule, k IS NOT NULL AS suppressed, 'reason ' || k AS reason FROM f")
def j7_suppressions(spark, sf_dir):
    return _suppressed(spark, sf_dir).select("plan_id", "change_id", "rule", "suppressed", "reason")


@registry.add(f"WITH {_SUPPRESSED} SELECT plan_id, change_id, rule FROM f WHERE k IS NULL AND severity = 'error'")
def p16_blocking(spark, sf_dir):
    return lint.blocking(_suppressed(spark, sf_dir), "error").select("plan_id", "change_id", "rule")


@registry.add(f"SELECT plan_id, CAST(greatest(2, max(CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END)) AS INTEGER) AS risk FROM ({_expected(_CHANGES, 5)}) GROUP BY plan_id")
def a11_derived_risk(spark, sf_dir):
    return lint.derived_risk(lint.lint_changes(changes(spark, sf_dir), version=16), F.lit(2))


@registry.add("""SELECT p_brand AS plan_id, 'ch' || p_partkey AS id, p_partkey % 10 IN (0, 3) AS destructive, p_partkey % 10 IN (2, 6) AS rewrites,
p_partkey % 10 IN (1, 2, 3, 5, 7) AS scans, CASE WHEN p_partkey % 10 = 2 THEN 'share' ELSE 'exclusive' END AS lock FROM part""")
def l20_impact_classes(spark, sf_dir):
    sql = statements(spark, sf_dir).select(c("change_id").alias("id"), "sql")
    return lint.impact_classes(changes(spark, sf_dir).join(sql, "id"))


_HIDDEN = [  # one command truncates a table; the others only seem to
    "do $fn$ ; truncate t $fn$",
    "/* a /* b */ ; truncate t */ select 1",
    'select 1 as "a;truncate b"',
    "select 'it''s ;' -- ; truncate x\n; truncate only part",
]


@registry.add("SELECT 'ch' || p_partkey AS change_id, '002' AS rule FROM part WHERE p_partkey % 4 = 3")
def l2_hidden_truncates(spark, sf_dir):
    hidden = statements(spark, sf_dir).drop("sql", "transactional").join(table(spark, sf_dir, "part").select(F.concat(F.lit("ch"), "p_partkey").alias("change_id"), _template(_HIDDEN).alias("sql")), "change_id")
    return lint.lint_statements(hidden.withColumn("transactional", F.lit(True)), changes(spark, sf_dir)).select("change_id", "rule")


@registry.add(f"""SELECT change_id, '205' AS rule FROM ({_expected(_CHANGES, 5)}) WHERE false UNION ALL SELECT 'ch' || p_partkey, '205' FROM part""")
def l17_untrusted_changes(spark, sf_dir):
    return lint.lint_changes(changes(spark, sf_dir), version=16, untrusted=True).filter(c("rule") == "205").select("change_id", "rule")


@registry.add("""SELECT 'ch' || p_partkey AS change_id, sha256(concat_ws(chr(0), 'required-test', 'r' || (p_partkey % 500), CASE p_partkey % 10 WHEN 7 THEN 'create table copy as select * from part' WHEN 8 THEN 'select ''truncate'' /* create index */ ; update part set p = 1' ELSE 'select * into archive from part' END)) AS token,
CASE p_partkey % 10 WHEN 7 THEN 'create_as_select' WHEN 9 THEN 'select_into' END AS evidence FROM part WHERE p_partkey % 10 >= 7""")
def l18_test_tokens(spark, sf_dir):
    found = lint.lint_statements(statements(spark, sf_dir), changes(spark, sf_dir)).filter(c("rule") == "206").select("change_id", "resource_id")
    joined = found.join(statements(spark, sf_dir).select("change_id", "sql"), "change_id")
    return joined.select("change_id", lint.test_token(c("resource_id"), c("sql")).alias("token"), lint.copy_evidence(lint.commands(lint.pieces(c("sql")))).alias("evidence"))


@registry.add("SELECT least(count(*), 101) AS counted, count(*) <= 100 AS within FROM part WHERE p_partkey % 10 = 0")
def o5_max_changes(spark, sf_dir):
    return evidence.at_most(changes(spark, sf_dir).filter(c("op") == "drop"), 100)


@registry.add("""WITH i AS (SELECT p_brand AS plan_id, p_partkey % 10 AS k FROM part)
SELECT plan_id, count(*) AS changes, count(*) FILTER (k IN (0, 3)) AS destructive, count(*) FILTER (k IN (2, 6)) AS rewrites, count(*) FILTER (k IN (1, 2, 3, 5, 7)) AS scans, count(*) FILTER (k <> 2) AS exclusive, count(*) FILTER (k = 2) AS share, bool_or(k IN (0, 3)) AS requires_approval FROM i GROUP BY plan_id""")
def a16_impact_totals(spark, sf_dir):
    return lint.impact_totals(l20_impact_classes(spark, sf_dir), ["plan_id"])


@registry.add(f"""WITH {_STATS}, f AS (SELECT * FROM ({_expected(_CHANGES, 5)}) LEFT JOIN ts USING (resource_id))
SELECT plan_id, change_id, rule, CASE WHEN rule NOT IN ('102', '104') THEN 'certain' WHEN estimated_rows IS NULL THEN 'assumed' ELSE 'estimated' END AS confidence,
concat_ws(', ', CASE WHEN rule IN ('102', '104') THEN CASE WHEN estimated_rows IS NULL THEN 'the table may be of any size' ELSE 'sizes are as of the last statistics' END END, CASE WHEN rule IN ('101', '102', '104') THEN 'the lock is held until the transaction ends' END) AS assumptions FROM f""")
def l19_confidence(spark, sf_dir):
    found = lint.with_table_stats(lint.lint_changes(changes(spark, sf_dir), version=16), table_stats(spark, sf_dir))
    return lint.escalate(found, max_rows=100_000).select("plan_id", "change_id", "rule", "confidence", "assumptions")


@registry.add("""SELECT o_orderkey % 5000 AS id, 'repeated' AS reason FROM orders GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT o_orderkey % 5000, 'customer leads nowhere' FROM orders WHERE o_orderkey % 23 = 0 UNION ALL SELECT o_orderkey % 5000, 'digest is no digest' FROM orders WHERE o_orderkey % 19 = 0""")
def p15_inconsistent_records(spark, sf_dir):
    k = c("o_orderkey")
    digest = F.when(k % 19 == 0, F.lit("sha256:short")).when(k % 3 == 0, F.concat(F.lit("sha256:"), F.sha2(k.cast("string"), 256)))
    o = table(spark, sf_dir, "orders").select((k % 5000).alias("id"), F.when(k % 23 == 0, -1).otherwise(c("o_custkey")).alias("customer"), digest.alias("digest"))
    return stats.inconsistent_records(o, ["id"], {"customer": (table(spark, sf_dir, "customer"), "c_custkey")}, ["digest"])
