"""Queries over policies, security states, approvals and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import governance as g
from tidewright.plans.common import Registry, table

registry = Registry()
c = F.col


def now():
    return F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")

RULES = [
    {"name": "cheap", "assert": {"not": {"eq": {"ref": "size", "value": 7}}}},
    {"name": "known", "assert": {"all": [{"exists": {"ref": "owner"}}, {"ne": {"ref": "owner", "value": "Brand#3"}}]}, "severity": "warning"},
    {"name": "typed", "kinds": ["PROMO", "ECONOMY"], "assert": {"any": [{"predicate": "large"}, {"matches": {"ref": "name", "value": "^(small|red) "}}]}},
    {"name": "listed", "assert": {"in": {"ref": "size", "value": [1, 2, 3, "4"]}}, "severity": "info"},
]


@registry.add("""WITH r AS (SELECT p_partkey, p_type AS kind, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS owner, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size END AS size FROM part)
SELECT p_partkey, 'cheap' AS rule, 'error' AS severity FROM r WHERE size = 7 UNION ALL SELECT p_partkey, 'known', 'warning' FROM r WHERE owner IS NULL OR owner = 'Brand#3'
UNION ALL SELECT p_partkey, 'typed', 'error' FROM r WHERE kind IN ('PROMO', 'ECONOMY') AND NOT coalesce(size IN (30, 40), false) AND NOT regexp_matches(name, '^(small|red) ')
UNION ALL SELECT p_partkey, 'listed', 'info' FROM r WHERE NOT coalesce(size IN (1, 2, 3), false)""")
def p14_policy_violations(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", c("p_type").alias("kind"), c("p_name").alias("name"), F.when(c("p_partkey") % 5 != 0, c("p_brand")).alias("owner"), F.when(c("p_partkey") % 6 != 0, c("p_size")).alias("size"))
    rules = [*RULES[:3], {**RULES[3], "assert": {"in": {"ref": "size", "value": {"var": "sizes"}}}}]
    columns = {k: c(k) for k in ("kind", "name", "owner", "size")}
    found = g.violations(p, rules, columns, ["p_partkey"], variables={"sizes": [1, 2, 3]}, predicates={"large": {"in": {"ref": "size", "value": [30, 40]}}})
    return found.select("p_partkey", "rule", "severity")


# -- security: a state per nation, its customers are principals, orders are grants ------------------------------------


def principals(spark, sf_dir):
    k = c("c_custkey")
    return table(spark, sf_dir, "customer").select(c("c_nationkey").alias("state_id"), c("c_name").alias("name"), (k % 9 == 0).alias("external"), (k % 4 == 0).alias("login"), (k % 3).cast("int").alias("connection_limit"), (k % 5 != 0).alias("managed"), k.alias("k"))


def desired_principals(spark, sf_dir):
    p = principals(spark, sf_dir).filter(c("k") % 10 != 0).withColumn("login", F.when(c("k") % 7 == 0, ~c("login")).otherwise(c("login")))
    return p.unionByName(p.filter(c("k") % 50 == 1).withColumn("name", F.concat("name", F.lit("-new"))))


@registry.add("""WITH p AS (SELECT c_nationkey AS state_id, c_name AS name, c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'drop_principal' END WHEN c_custkey % 7 = 0 THEN 'alter_principal' END AS change FROM customer)
SELECT state_id, name, change, CASE WHEN change = 'alter_principal' AND k % 9 = 0 THEN 'external' WHEN change = 'drop_principal' AND name IN ('Customer#000000010', 'Customer#000000020') THEN 'lockout' END AS refused FROM p WHERE change IS NOT NULL
UNION ALL SELECT c_nationkey, c_name || '-new', 'create_principal', NULL FROM customer WHERE c_custkey % 50 = 1 AND c_custkey % 10 <> 0""")
def j9_diff_principals(spark, sf_dir):
    return g.diff_principals(desired_principals(spark, sf_dir), principals(spark, sf_dir), ["external", "login", "connection_limit"], ["Customer#000000010", "Customer#000000020"])


def grants(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select((c("o_custkey") % 25).alias("state_id"), F.concat(F.lit("t"), (c("o_orderkey") % 40).cast("string")).alias("object"), F.when(c("o_custkey") % 50 == 0, F.lit("PUBLIC")).otherwise(F.concat(F.lit("u"), c("o_custkey").cast("string"))).alias("grantee"), F.concat(F.lit("g"), (c("o_orderkey") % 7).cast("string")).alias("grantor"), c("o_orderstatus").alias("privilege"), (c("o_orderkey") % 2 == 0).alias("grantable"), c("o_orderkey").alias("k"))


GRANTS = """gr AS (SELECT o_custkey % 25 AS state_id, 't' || (o_orderkey % 40) AS object, CASE WHEN o_custkey % 50 = 0 THEN 'PUBLIC' ELSE 'u' || o_custkey END AS grantee, 'g' || (o_orderkey % 7) AS grantor, o_orderstatus AS privilege, o_orderkey % 2 = 0 AS grantable, o_orderkey AS k FROM orders)"""
_TUPLE = ["state_id", "object", "grantee", "grantor", "privilege", "grantable"]


@registry.add(f"""WITH {GRANTS}, a AS (SELECT DISTINCT state_id, object, grantee, grantor, privilege, grantable FROM gr), d AS (SELECT DISTINCT state_id, CASE WHEN k % 11 = 0 THEN object || 'x' ELSE object END AS object, grantee, grantor, privilege, grantable FROM gr WHERE k % 13 <> 0)
SELECT *, 'grant' AS change, 4 AS rank FROM (SELECT * FROM d EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'revoke', 6 FROM (SELECT * FROM a EXCEPT SELECT * FROM d)""")
def j10_diff_grants(spark, sf_dir):
    a = grants(spark, sf_dir)
    d = a.filter(c("k") % 13 != 0).withColumn("object", F.when(c("k") % 11 == 0, F.concat("object", F.lit("x"))).otherwise(c("object")))
    return g.ranked(g.diff_sets(d, a, _TUPLE, "grant", "revoke"))


def memberships(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((c("o_custkey") % 25).alias("state_id"), F.concat(F.lit("u"), c("o_custkey").cast("string")).alias("member"), F.concat(F.lit("r"), (c("o_orderkey") % 3).cast("string")).alias("parent")).distinct()


@registry.add(f"""WITH {GRANTS}, m AS (SELECT DISTINCT o_custkey % 25 AS state_id, 'u' || o_custkey AS name, 'inherits r' || (o_orderkey % 3) AS path FROM orders),
a AS (SELECT * FROM m UNION SELECT state_id, grantee, privilege || ' on ' || object FROM gr)
SELECT state_id, name, string_agg(path, '|' ORDER BY path) AS paths FROM a GROUP BY ALL""")
def j11_access_paths(spark, sf_dir):
    return g.access_paths(memberships(spark, sf_dir), grants(spark, sf_dir)).withColumn("paths", F.array_join("paths", "|"))


@registry.add(f"""WITH {GRANTS} SELECT DISTINCT state_id, object FROM gr WHERE regexp_matches(object, '^t[12]') AND NOT (state_id % 2 = 0 AND CAST(substr(object, 2) AS INTEGER) % 3 = 0)""")
def j12_require_row_policy(spark, sf_dir):
    gr = grants(spark, sf_dir)
    policies = gr.filter((c("state_id") % 2 == 0) & (F.substring("object", 2, 9).cast("int") % 3 == 0)).select("state_id", c("object").alias("table")).distinct()
    return g.tables_without_policy(gr, policies, "^t[12]")


@registry.add(f"""WITH {GRANTS} SELECT k FROM gr WHERE grantor IN ('g1', 'g2', 'g3') AND NOT (object IN ('t1', 't2', 't3', 't4', 't5') AND CAST(substr(object, 2) AS INTEGER) <> CAST(substr(grantor, 2) AS INTEGER))""")
def j13_ownership_violations(spark, sf_dir):
    gr = grants(spark, sf_dir)
    states = gr.select("state_id").distinct()
    pairs = F.explode(F.array(*[F.struct(F.lit(f"g{a}").alias("actor"), F.lit(f"t{t}").alias("object")) for a in (1, 2, 3) for t in range(1, 6) if t != a]))
    return g.ownership_violations(gr, states.select("state_id", pairs.alias("p")).select("state_id", "p.*")).select("k")


@registry.add(f"WITH {GRANTS} SELECT 'public grant' AS finding, state_id, count(*) AS n FROM gr WHERE grantee = 'PUBLIC' GROUP BY state_id UNION ALL SELECT 'unmanaged principal', c_nationkey, count(*) FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 9 <> 0 GROUP BY c_nationkey")
def l21_public_and_unmanaged(spark, sf_dir):
    a = g.public_grants(grants(spark, sf_dir)).groupBy(F.lit("public grant").alias("finding"), c("state_id").cast("long").alias("state_id")).agg(F.count("*").alias("n"))
    b = g.unmanaged_principals(principals(spark, sf_dir)).groupBy(F.lit("unmanaged principal").alias("finding"), c("state_id").cast("long").alias("state_id")).agg(F.count("*").alias("n"))
    return a.unionByName(b)


# -- approvals: a plan per user, events are approvals by other users --------------------------------------------------


def approval_tables(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter(c("event_id").isNotNull())
    u = c("user_id")
    users = e.select("user_id").distinct()
    plans = users.select(u.alias("digest"), F.when(u % 2 == 0, "prod").when(u % 7 == 1, "other").otherwise("test").alias("environment"), (u + 1).alias("author"), F.when(u % 20 == 0, u + 1).otherwise(u + 2).alias("requester"), (u % 4 + 1).cast("int").alias("risk"), F.when(u % 11 == 0, F.lit("2024-01-01 00:00:00")).cast("timestamp_ntz").alias("expires_at"))
    approvals = e.select(u.alias("plan_digest"), F.when(u % 2 == 0, "prod").otherwise("test").alias("environment"), ((c("event_id") % 5) + u).alias("approver"), c("ts").alias("approved_at"), (c("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"))
    roles = F.when(u % 3 == 0, F.array(F.lit("dba"), F.lit("dev"))).when(u % 3 == 1, F.array(F.lit("dev"))).otherwise(F.array(F.lit("dba")))
    identities = users.select(u.alias("id"), roles.alias("roles"))
    rows = F.array(*[F.struct(F.lit(e_).alias("environment"), F.lit(r).alias("minimum_risk"), F.lit(n).alias("approver_count"), F.array(*[F.lit(x) for x in ro]).alias("roles")) for e_, r, n, ro in (("prod", 1, 2, ["dev"]), ("prod", 3, 1, ["dba", "dev"]), ("test", 2, 1, ["dba"]))])
    requirements = spark.range(1).select(F.inline(rows))
    return plans, approvals, identities, requirements


@registry.add("""WITH u AS (SELECT DISTINCT user_id AS u FROM events),
p AS (SELECT u AS digest, CASE WHEN u % 2 = 0 THEN 'prod' WHEN u % 7 = 1 THEN 'other' ELSE 'test' END AS env, u + 1 AS author, CASE WHEN u % 20 = 0 THEN u + 1 ELSE u + 2 END AS requester, u % 4 + 1 AS risk, u % 11 = 0 AS expired FROM u),
v AS (SELECT DISTINCT digest, (event_id % 5) + user_id AS approver FROM events JOIN p ON user_id = digest WHERE env = CASE WHEN user_id % 2 = 0 THEN 'prod' ELSE 'test' END AND ts <= TIMESTAMP '2024-01-15' AND ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-15' AND (event_id % 5) + user_id NOT IN (author, requester) AND (event_id % 5) + user_id IN (SELECT u FROM u)),
n AS (SELECT digest, count(*) FILTER (approver % 3 IN (0, 1)) AS dev, count(*) FILTER (approver % 3 = 0) AS both_, count(*) FILTER (approver % 3 IN (0, 2)) AS dba FROM v GROUP BY 1)
SELECT p.digest, coalesce(author <> requester AND NOT expired AND CASE env WHEN 'prod' THEN coalesce(dev, 0) >= 2 AND (risk < 3 OR coalesce(both_, 0) >= 1) WHEN 'test' THEN risk < 2 OR coalesce(dba, 0) >= 1 ELSE false END, false) AS allowed FROM p LEFT JOIN n ON p.digest = n.digest""")
def j18_approval_quorum(spark, sf_dir):
    return g.approval_quorum(*approval_tables(spark, sf_dir), now())


_QUORUM = registry.sql["j18_approval_quorum"].replace("SELECT p.digest, coalesce(", ", q AS (SELECT p.*, coalesce(").replace(" AS allowed FROM p LEFT JOIN n ON p.digest = n.digest", " AS quorum FROM p LEFT JOIN n ON p.digest = n.digest)")


@registry.add(_QUORUM + """, s AS (SELECT *, digest % 6 < 3 AS said, digest % 6 = 0 AND requester % 4 = 0 AND requester IN (SELECT u FROM u) AS sound FROM q),
e AS (SELECT *, said AND sound AND env <> 'other' AND author <> requester AND NOT expired AS emergency FROM s)
SELECT digest, CASE WHEN said THEN emergency ELSE quorum END AS allowed, emergency, CASE WHEN emergency THEN 'outage ' || digest END AS reason FROM e""")
def j18_emergency_override(spark, sf_dir):
    """Every sixth plan is overridden by its requester, others by their author or without a reason; every fourth user has the authority."""
    plans, approvals, identities, requirements = approval_tables(spark, sf_dir)
    d = c("digest")
    kind = d % 6
    who = F.when(kind == 1, c("author")).otherwise(c("requester"))
    why = F.when(kind == 2, " ").otherwise(F.concat(F.lit("outage "), d.cast("string")))
    overrides = plans.filter(kind < 3).select(d.alias("plan_digest"), who.alias("identity"), why.alias("reason"))
    return g.decisions(plans, approvals, identities.withColumn("emergency", c("id") % 4 == 0), requirements, overrides, now())


@registry.add(f"""WITH {GRANTS} SELECT 'no public grants' AS rule, CAST(state_id AS VARCHAR) AS state_id, grantee AS principal, object, 'everyone holds ' || privilege AS message, 'grant to a role' AS remediation FROM gr WHERE grantee = 'PUBLIC'
UNION ALL SELECT 'nothing is granted on', CAST(state_id AS VARCHAR), grantee, object, 'may be granted on', '' FROM gr WHERE grantable AND k % 17 = 0""")
def security_rules(spark, sf_dir):
    """A rule over the grants of a state, and one over those that change."""
    gr = grants(spark, sf_dir)
    public = g.Rule("no public grants", lambda t: g.public_grants(t["grants"]).select("state_id", c("grantee").alias("principal"), "object", F.concat(F.lit("everyone holds "), "privilege").alias("message")), "grant to a role")
    onward = g.Rule("nothing is granted on", lambda t: t["changes"].filter("grantable").select("state_id", c("grantee").alias("principal"), "object", F.lit("may be granted on").alias("message")))
    return g.evaluate_rules({"grants": gr, "changes": gr.filter(c("k") % 17 == 0)}, [public, onward])


@registry.add("""WITH k AS (SELECT o_custkey AS gate, max(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 1 ELSE 0 END) AS urgent, max(CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' THEN 1 ELSE 0 END) AS high, max(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) AS bound,
min(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' THEN 0 ELSE 1 END) AS u_all, min(CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus <> 'F' THEN 0 ELSE 1 END) AS h_all FROM orders GROUP BY 1)
SELECT gate, (gate % 10 = 0 OR (urgent = 1 AND high = 1 AND u_all = 1 AND h_all = 1)) AND bound = 1 AS passed FROM k""")
def j19_gate_evidence(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    none = F.array().cast("array<string>")
    gates = o.select(c("o_custkey").alias("gate")).distinct().select("gate", F.concat(F.lit("e"), c("gate").cast("string")).alias("evidence"), F.when(c("gate") % 10 == 0, none).otherwise(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("required"))
    checks = o.select(c("o_custkey").alias("gate"), c("o_orderpriority").alias("name"), F.when(c("o_orderstatus") == "F", "pass").otherwise("fail").alias("status"))
    approvals = o.select(c("o_custkey").alias("gate"), F.concat(F.lit("e"), F.when(c("o_orderkey") % 3 == 0, c("o_custkey").cast("string")).otherwise("other")).alias("evidence"))
    return g.gate_evidence(gates, checks, approvals)


@registry.add("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus <> 'F' THEN 'backfill incomplete' END, CASE WHEN o_totalprice > 300000 THEN 'old readers remain' END, CASE WHEN o_orderkey % 5 = 0 THEN 'evidence missing' END) AS blockers FROM orders""")
def j20_blockers(spark, sf_dir):
    evidence = table(spark, sf_dir, "orders").select("o_orderkey", (c("o_orderstatus") == "F").alias("complete"), (c("o_totalprice") > 300_000).alias("readers"), F.when(c("o_orderkey") % 5 != 0, F.lit(False)).alias("lost"))
    found = g.blockers(evidence, ["o_orderkey"], {"backfill incomplete": ~c("complete"), "old readers remain": c("readers"), "evidence missing": c("lost")})
    return found.withColumn("blockers", F.array_join("blockers", ","))


@registry.add("SELECT o_custkey AS review, count(*) FILTER (o_orderkey % 4 <> 0) > 0 AND coalesce(bool_and(coalesce(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus <> 'P' END, false)), false) AS passed FROM orders GROUP BY 1")
def a13_review_outcome(spark, sf_dir):
    stages = table(spark, sf_dir, "orders").select(c("o_custkey").alias("review"), F.when(c("o_orderkey") % 4 != 0, c("o_orderstatus") != "P").alias("passed"))
    return g.review_outcome(stages, "review")
