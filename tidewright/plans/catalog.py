"""Queries over catalog resources derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions.canonical import canonical_json
from tidewright.operators import catalog, documents, graphs
from tidewright.plans.common import Registry, multiset_digest_sql, table

registry = Registry()
c = F.col


def current_parts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    spec = F.concat(F.lit('{"size":'), c("p_size").cast("string"), F.lit(',"type":"'), c("p_type"), F.lit('"}'))
    return p.select(c("p_brand").alias("target_id"), F.concat(F.lit("column:"), c("p_partkey").cast("string")).alias("id"), F.lit("column").alias("kind"), c("p_name").alias("name"), F.lit(None).cast("string").alias("parent"), spec.alias("spec"), "p_partkey")


def desired_parts(spark, sf_dir):
    p = current_parts(spark, sf_dir).filter(c("p_partkey") % 11 != 0)
    p = p.withColumn("spec", F.when(c("p_partkey") % 13 == 0, F.lit("{}")).otherwise(c("spec")))
    added = p.filter(c("p_partkey") % 17 == 0).withColumn("id", F.concat(c("id"), F.lit("-new")))
    return p.unionByName(added)


CUR = """cur AS (SELECT p_brand AS target_id, 'column:' || p_partkey AS id, 'column' AS kind, p_name AS name, CAST(NULL AS VARCHAR) AS parent, '{"size":' || p_size || ',"type":"' || p_type || '"}' AS spec, p_partkey FROM part),
des0 AS (SELECT target_id, id, kind, name, parent, CASE WHEN p_partkey % 13 = 0 THEN '{}' ELSE spec END AS spec, p_partkey FROM cur WHERE p_partkey % 11 <> 0),
des AS (SELECT * FROM des0 UNION ALL SELECT target_id, id || '-new', kind, name, parent, spec, p_partkey FROM des0 WHERE p_partkey % 17 = 0),
fc AS (SELECT *, sha256(concat_ws(chr(0), 'resource', coalesce(kind, ''), coalesce(name, ''), coalesce(parent, ''), coalesce(spec, ''))) AS fp FROM cur),
fd AS (SELECT *, sha256(concat_ws(chr(0), 'resource', coalesce(kind, ''), coalesce(name, ''), coalesce(parent, ''), coalesce(spec, ''))) AS fp FROM des)"""


@registry.add(f"""WITH {CUR} SELECT coalesce(a.target_id, b.target_id) AS target_id, coalesce(a.id, b.id) AS id,
CASE WHEN a.fp IS NULL THEN 'create' WHEN b.fp IS NULL THEN 'drop' ELSE 'alter' END AS op, a.fp AS before, b.fp AS after
FROM fc a FULL JOIN fd b ON a.target_id = b.target_id AND a.id = b.id WHERE a.fp IS DISTINCT FROM b.fp""")
def j3_diff_resources(spark, sf_dir):
    return catalog.diff_resources(current_parts(spark, sf_dir), desired_parts(spark, sf_dir))


@registry.add(f"WITH {CUR} SELECT target_id, {multiset_digest_sql("sha256(id || '=' || fp)")} AS digest, count(*) AS n FROM fc GROUP BY target_id")
def a8_semantic_fingerprint(spark, sf_dir):
    return catalog.semantic_fingerprint(current_parts(spark, sf_dir))


@registry.add(f"SELECT n_nationkey, {multiset_digest_sql('sha256(c_name)')} AS digest, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def a9_set_digest(spark, sf_dir):
    return catalog.set_digest(table(spark, sf_dir, "customer").select(c("c_nationkey").alias("n_nationkey"), "c_name"), ["n_nationkey"], c("c_name"))


@registry.add(f"WITH {CUR} SELECT a.target_id, a.id, a.fp = b.fp AS same FROM fc a JOIN fd b ON a.target_id = b.target_id AND a.id = b.id")
def u5_matched_pairs(spark, sf_dir):
    a = catalog.resource_fingerprint(current_parts(spark, sf_dir)).select("target_id", "id", c("fp").alias("a"))
    b = catalog.resource_fingerprint(desired_parts(spark, sf_dir)).select("target_id", "id", c("fp").alias("b"))
    return a.join(b, ["target_id", "id"]).select("target_id", "id", (c("a") == c("b")).alias("same"))


# -- renames: each customer is a table of its nation; orders are its columns -------------------------------------------


def schema_before(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select(c("c_nationkey").cast("string").alias("target_id"), F.concat(F.lit("table:"), c("c_custkey").cast("string")).alias("id"), F.lit("table").alias("kind"), F.concat(F.lit("t"), (c("c_custkey") % 40).cast("string")).alias("name"), F.lit(None).cast("string").alias("parent"), F.lit("{}").alias("spec"), c("c_custkey").alias("k"))
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey"))
    columns = o.select(c("c_nationkey").cast("string").alias("target_id"), F.concat_ws(":", F.lit("column"), c("c_custkey").cast("string"), c("o_orderkey").cast("string")).alias("id"), F.lit("column").alias("kind"), F.concat(F.lit("c"), (c("o_orderkey") % 5).cast("string")).alias("name"), F.concat(F.lit("table:"), c("c_custkey").cast("string")).alias("parent"), c("o_orderpriority").alias("spec"), c("c_custkey").alias("k"))
    return t.unionByName(columns)


def schema_after(spark, sf_dir):
    """Tables of each sixth customer have another id and name; so have the ids of their columns."""
    moved = c("k") % 6 == 0
    b = schema_before(spark, sf_dir)
    return b.select(
        "target_id",
        F.when(moved, F.concat(c("id"), F.lit("'"))).otherwise(c("id")).alias("id"),
        "kind",
        F.when(moved & (c("kind") == "table"), F.concat(c("name"), F.lit("_new"))).otherwise(c("name")).alias("name"),
        F.when(moved, F.concat(c("parent"), F.lit("'"))).otherwise(c("parent")).alias("parent"),
        F.when(moved & (c("k") % 12 == 0), F.concat(c("spec"), F.lit("!"))).otherwise(c("spec")).alias("spec"),
        "k",
    )


def rename_hints(spark, sf_dir):
    t = schema_before(spark, sf_dir).filter((c("kind") == "table") & (c("k") % 6 == 0)).select("target_id", c("name").alias("old_name"), F.concat(c("name"), F.lit("_new")).alias("new_name")).distinct()
    return t.unionByName(table(spark, sf_dir, "nation").select(c("n_nationkey").cast("string").alias("target_id"), F.lit("missing").alias("old_name"), F.lit("none").alias("new_name")))


SCHEMAS = """b AS (SELECT CAST(c_nationkey AS VARCHAR) AS target_id, 'table:' || c_custkey AS id, 'table' AS kind, 't' || (c_custkey % 40) AS name, CAST(NULL AS VARCHAR) AS parent, '{}' AS spec, c_custkey AS k FROM customer
UNION ALL SELECT CAST(c_nationkey AS VARCHAR), 'column:' || c_custkey || ':' || o_orderkey, 'column', 'c' || (o_orderkey % 5), 'table:' || c_custkey, o_orderpriority, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey),
h AS (SELECT target_id, name AS old_name, count(*) AS n, min(k) AS k FROM b WHERE kind = 'table' AND k % 6 = 0 GROUP BY ALL)"""


@registry.add(f"""WITH {SCHEMAS} SELECT target_id, old_name, old_name || '_new' AS new_name, CASE WHEN n > 1 THEN 'ambiguous' ELSE 'rename' END AS outcome FROM h
UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'missing', 'none', 'not found' FROM nation""")
def j4_rename_hints(spark, sf_dir):
    before, after = schema_before(spark, sf_dir), schema_after(spark, sf_dir)
    renames, problems = catalog.apply_rename_hints(before, after, rename_hints(spark, sf_dir))
    names = renames.join(before.select("target_id", c("id").alias("old_id"), c("name").alias("old_name")), ["target_id", "old_id"]).join(after.select("target_id", c("id").alias("new_id"), c("name").alias("new_name")), ["target_id", "new_id"])
    return names.select("target_id", "old_name", "new_name", F.lit("rename").alias("outcome")).unionByName(problems.withColumnRenamed("problem", "outcome"))


@registry.add(f"""WITH {SCHEMAS}, t AS (SELECT target_id, 'table:' || k AS old_id, k FROM h WHERE n = 1),
ch AS (SELECT b.target_id, b.parent, b.name, count(*) AS n, min(b.id) AS id FROM b JOIN t ON b.parent = t.old_id AND b.target_id = t.target_id GROUP BY ALL)
SELECT target_id, old_id, old_id || '''' AS new_id FROM t UNION ALL SELECT target_id, id, id || '''' FROM ch WHERE n = 1""")
def j5_parent_renames(spark, sf_dir):
    before, after = schema_before(spark, sf_dir), schema_after(spark, sf_dir)
    renames, _ = catalog.apply_rename_hints(before, after, rename_hints(spark, sf_dir))
    return catalog.propagate_parent_renames(before, after, renames)


@registry.add(f"""WITH {SCHEMAS}, t AS (SELECT target_id, 'table:' || k AS old_id, k FROM h WHERE n = 1),
a AS (SELECT target_id, CASE WHEN k % 6 = 0 THEN id || '''' ELSE id END AS id, kind, CASE WHEN k % 6 = 0 AND k % 12 = 0 THEN spec || '!' ELSE spec END AS spec FROM b)
SELECT target_id, id, 'drop' AS op, CAST(NULL AS VARCHAR) AS old_id FROM b WHERE k % 6 = 0 AND id NOT IN (SELECT old_id FROM t)
UNION ALL SELECT target_id, id || '''', 'create', NULL FROM b WHERE k % 6 = 0 AND id NOT IN (SELECT old_id FROM t)
UNION ALL SELECT target_id, old_id || '''', 'rename', old_id FROM t UNION ALL SELECT target_id, old_id || '''', 'alter', NULL FROM t WHERE k % 12 = 0""")
def j4_diff_with_renames(spark, sf_dir):
    before, after = schema_before(spark, sf_dir), schema_after(spark, sf_dir)
    renames, _ = catalog.apply_rename_hints(before, after, rename_hints(spark, sf_dir))
    return catalog.diff_with_renames(before, after, renames)


@registry.add("SELECT CAST(c_nationkey AS VARCHAR) AS target_id, 'table:' || c_custkey AS old_id, 'table:' || c_custkey || chr(39) AS new_id FROM customer WHERE c_custkey % 6 = 0")
def j4_hints_by_id(spark, sf_dir):
    """Hints that name one side by its id, and the other one by kind:name that is as unique, or by its id too."""
    before, after = schema_before(spark, sf_dir).filter("kind = 'table'"), schema_after(spark, sf_dir).filter("kind = 'table'")
    moved = before.filter(c("k") % 6 == 0)
    unique = F.concat(F.lit("only"), c("k").cast("string"))
    after = after.withColumn("name", F.when(c("k") % 12 == 0, unique).otherwise(c("name")))
    to = F.when(c("k") % 12 == 0, F.concat(F.lit("table:"), unique)).otherwise(F.concat("id", F.lit("'")))
    hints = moved.select("target_id", c("id").alias("old_name"), to.alias("new_name"))
    return catalog.apply_rename_hints(before, after, hints)[0]


# -- graphs: region <- nation <- customer <- orders --------------------------------------------------------------------


def containment(spark, sf_dir):
    """(nodes, edges): each order depends on its customer, and so on up to regions."""
    link = lambda t, kind, key, parent_kind, parent: table(spark, sf_dir, t).select(F.lit("all").alias("target_id"), F.concat_ws(":", F.lit(kind), c(key).cast("string")).alias("id"), F.concat_ws(":", F.lit(parent_kind), c(parent).cast("string")).alias("dep"))
    edges = link("nation", "nation", "n_nationkey", "region", "n_regionkey").unionByName(link("customer", "customer", "c_custkey", "nation", "c_nationkey")).unionByName(link("orders", "order", "o_orderkey", "customer", "o_custkey"))
    nodes = edges.select("target_id", "id").unionByName(table(spark, sf_dir, "region").select(F.lit("all").alias("target_id"), F.concat_ws(":", F.lit("region"), c("r_regionkey").cast("string")).alias("id")))
    return nodes.withColumn("kind", F.substring_index("id", ":", 1)).withColumn("name", F.substring_index("id", ":", -1)), edges


EDGES = """e AS (SELECT 'nation:' || n_nationkey AS id, 'region:' || n_regionkey AS dep FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders)"""


@registry.add(f"""WITH RECURSIVE {EDGES},
down(id) AS (SELECT 'region:2' UNION SELECT e.id FROM e JOIN down ON e.dep = down.id),
up(id) AS (SELECT id FROM down UNION SELECT e.dep FROM e JOIN up ON e.id = up.id),
gone(id) AS (SELECT 'nation:8' UNION SELECT e.id FROM e JOIN gone ON e.dep = gone.id)
SELECT 'all' AS target_id, id FROM up WHERE id NOT IN (SELECT id FROM gone)""")
def g1_select_closure(spark, sf_dir):
    nodes, edges = containment(spark, sf_dir)
    return catalog.select_closure(nodes, edges, edges, ["region:2"], ["nation:8"])


@registry.add("""WITH part AS (SELECT 'nation:' || n_nationkey AS id, 'region:' || n_regionkey AS dep FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer),
need AS (SELECT 'customer:' || o_custkey AS id, 'order:' || o_orderkey AS dep FROM orders UNION ALL SELECT 'customer:' || c_custkey, 'customer:' || (c_custkey - 1) FROM customer WHERE c_custkey % 40 = 1),
n AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
kept AS (SELECT c_custkey AS k FROM n WHERE n_regionkey = 2 UNION SELECT c_custkey - 1 FROM n WHERE n_regionkey = 2 AND c_custkey % 40 = 1),
gone AS (SELECT c_custkey AS k FROM n WHERE c_nationkey = 8 UNION SELECT c_custkey + 1 FROM n WHERE c_nationkey = 8 AND c_custkey % 40 = 0)
SELECT 'all' AS target_id, 'region:2' AS id UNION ALL SELECT 'all', 'nation:' || n_nationkey FROM nation WHERE n_regionkey = 2 AND n_nationkey <> 8
UNION ALL SELECT 'all', 'customer:' || k FROM kept WHERE k NOT IN (SELECT k FROM gone) UNION ALL SELECT 'all', 'order:' || o_orderkey FROM orders WHERE o_custkey IN (SELECT k FROM kept)""")
def g1_parts_and_needs(spark, sf_dir):
    """Customers are parts of nations and these of regions; a customer needs its orders, and each fortieth another customer."""
    nodes, links = containment(spark, sf_dir)
    is_order = c("id").startswith("order:")
    needs = links.filter(is_order).select("target_id", c("dep").alias("id"), c("id").alias("dep"))
    k = c("c_custkey")
    others = table(spark, sf_dir, "customer").filter(k % 40 == 1).select(F.lit("all").alias("target_id"), F.concat(F.lit("customer:"), k.cast("string")).alias("id"), F.concat(F.lit("customer:"), (k - 1).cast("string")).alias("dep"))
    return catalog.select_closure(nodes, needs.unionByName(others), links.filter(~is_order), ["region:2"], ["nation:8"])


@registry.add("""WITH RECURSIVE e AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1 ELSE c_custkey // 2 END AS dep FROM customer),
ok(id) AS (SELECT DISTINCT dep FROM e WHERE dep NOT IN (SELECT id FROM e) UNION SELECT e.id FROM e JOIN ok ON e.dep = ok.id)
SELECT 'all' AS target_id, id FROM e WHERE id NOT IN (SELECT id FROM ok)""")
def g2_cycles(spark, sf_dir):
    k = c("c_custkey")
    edges = table(spark, sf_dir, "customer").select(F.lit("all").alias("target_id"), k.alias("id"), F.when(k % 3 == 0, k + 1).otherwise(F.floor(k / 2)).alias("dep"))
    return catalog.in_or_behind_cycles(edges)


@registry.add(f"""WITH RECURSIVE {EDGES}, n AS (SELECT id FROM e UNION SELECT 'region:' || r_regionkey FROM region),
p(id, level) AS (SELECT id, 0 FROM n UNION SELECT e.id, p.level + 1 FROM e JOIN p ON e.dep = p.id)
SELECT 'all' AS target_id, id, max(level) AS level FROM p GROUP BY id""")
def o4_change_levels(spark, sf_dir):
    nodes, edges = containment(spark, sf_dir)
    changes = nodes.withColumn("op", F.lit("create"))
    return catalog.change_levels(changes, catalog.drop_order_edges(changes, edges))


@registry.add(f"""WITH RECURSIVE {EDGES}, n AS (SELECT id FROM e UNION SELECT 'region:' || r_regionkey FROM region),
p(id, level) AS (SELECT id, 0 FROM n UNION SELECT e.dep, p.level + 1 FROM e JOIN p ON e.id = p.id)
SELECT 'all' AS target_id, id, max(level) AS level FROM p GROUP BY id""")
def o4_drop_levels(spark, sf_dir):
    nodes, edges = containment(spark, sf_dir)
    changes = nodes.withColumn("op", F.lit("drop"))
    return catalog.change_levels(changes, catalog.drop_order_edges(changes, edges))


@registry.add("""WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag <> 'N' AS mode, CASE WHEN (l_returnflag <> 'N') IS NOT DISTINCT FROM lag(l_returnflag <> 'N') OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) THEN 0 ELSE 1 END AS st FROM lineitem_unique),
p AS (SELECT *, sum(st) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS phase FROM s)
SELECT l_orderkey, CAST(phase AS BIGINT) AS phase, bool_and(mode) AS mode, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS n FROM p GROUP BY l_orderkey, phase""".replace("lineitem_unique", "(SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)"))
def w7_phases(spark, sf_dir):
    steps = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.min("l_returnflag") != "N").alias("mode"))
    return catalog.phases(steps, ["l_orderkey"], "l_linenumber", "mode")


@registry.add("""SELECT 'nation_' || n_nationkey AS child, CASE c_custkey % 3 WHEN 0 THEN 'a' || c_custkey WHEN 1 THEN 'b' || c_custkey ELSE 'c' || c_custkey END AS to_table, c_name AS name
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 <> 3""")
def j8_fk_edges(spark, sf_dir):
    k = c("c_custkey")
    ref = lambda key, p: F.concat(F.lit(f'{{"{key}":"{p}'), k.cast("string"), F.lit('"}'))
    spec = F.when(k % 4 == 3, F.lit("{}")).when(k % 3 == 0, ref("target", "a")).when(k % 3 == 1, ref("referenced_table", "b")).otherwise(ref("table", "c"))
    keys = table(spark, sf_dir, "customer").select(c("c_name").alias("name"), c("c_nationkey").alias("parent"), spec.alias("spec"))
    tables = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("id"), F.concat(F.lit("nation_"), c("n_nationkey").cast("string")).alias("name"))
    return catalog.fk_edges(keys, tables)


def two_sources(spark, sf_dir):
    p = catalog.resource_fingerprint(current_parts(spark, sf_dir)).select("target_id", "id", "fp", "p_partkey")
    a = p.withColumn("source", F.lit("a.json"))
    b = p.filter(c("p_partkey") % 2 == 0).withColumn("fp", F.when(c("p_partkey") % 10 == 0, F.lit("other")).otherwise(c("fp"))).withColumn("source", F.lit("b.json"))
    return a.drop("p_partkey"), b.drop("p_partkey")


@registry.add(f"WITH {CUR} SELECT target_id, id, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE fp END AS fp, CASE WHEN p_partkey % 2 = 0 THEN 'a.json,b.json' ELSE 'a.json' END AS sources FROM fc")
def s7_compose_documents(spark, sf_dir):
    resources, conflicts = catalog.compose(*two_sources(spark, sf_dir))
    both = resources.unionByName(conflicts.withColumn("fp", F.lit(None).cast("string")))
    return both.withColumn("sources", F.array_join("sources", ","))


@registry.add("SELECT CAST(o_custkey AS VARCHAR) AS target_id, 'o' || o_orderkey AS id, 'c' || o_custkey AS dep, 'references' AS type FROM orders")
def s8_explode_documents(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    resource = F.struct(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.lit("order").alias("kind"), c("o_orderpriority").alias("name"), F.array(F.struct(F.concat(F.lit("c"), "o_custkey").alias("target"), F.lit("references").alias("type"))).alias("dependencies"))
    documents = o.groupBy(c("o_custkey").cast("string").alias("target_id")).agg(F.to_json(F.struct(F.collect_list(resource).alias("resources"))).alias("document"))
    return catalog.explode_documents(documents)[1]


#: Objects of eight levels; the sides differ at each of them.
LEVELS = 8


def _nested(inner, wrap):
    """JSON text of LEVELS objects in one another, `wrap` giving the members beside the next one."""
    text = inner
    for level in range(LEVELS, 0, -1):
        text = F.concat(F.lit("{"), F.concat_ws(",", wrap(level), F.concat(F.lit('"n":'), text)), F.lit("}"))
    return text


@registry.add("SELECT event_id, " + ", ".join(f"CASE WHEN (event_id + {i}) % 3 = 0 THEN 'o{i}' ELSE 'b{i}' END AS l{i}" for i in range(1, LEVELS + 1)) + """,
CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '[3]' WHEN 2 THEN '{"x":1,"y":' || user_id || '}' ELSE '{"z":{}}' END AS leaf FROM events""")
def s6_compose_overlay(spark, sf_dir):
    """Sides that agree on nothing but the keys on the way down; the innermost member is null, an array, an object to merge or another one."""
    e = table(spark, sf_dir, "events")
    kind = c("event_id") % 4
    below = F.when(kind == 2, F.lit('{"x":1}')).otherwise(F.lit('"scalar"'))
    above = F.when(kind == 0, F.lit("null")).when(kind == 1, F.lit("[3]")).when(kind == 2, F.concat(F.lit('{"y":'), c("user_id").cast("string"), F.lit("}"))).otherwise(F.lit('{"z":{}}'))
    base = e.select("event_id", _nested(below, lambda i: F.lit(f'"k":"b{i}"')).alias("document"))
    over = e.select("event_id", _nested(above, lambda i: F.when((c("event_id") + i) % 3 == 0, F.lit(f'"k":"o{i}"'))).alias("document"))
    merged = documents.overlay(base, over, id="event_id")
    parsed = merged.select("event_id", F.parse_json("document").alias("v"))
    at = lambda i: F.variant_get("v", "$" + ".n" * (i - 1) + ".k", "string").alias(f"l{i}")
    leaf = F.variant_get("v", "$" + ".n" * LEVELS, "variant")
    return parsed.select("event_id", *[at(i) for i in range(1, LEVELS + 1)], F.when(~F.is_variant_null(leaf), F.to_json(leaf)).alias("leaf"))


@registry.add("""SELECT event_id, unnest(['a', 'b/c', 'b/d/e', 'f']) AS path, unnest([CAST(event_id AS VARCHAR), '"' || event_type || '"', '[1,{}]', '{}']) AS value FROM events""")
def s6_flatten_documents(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit('{"b":{"d":{"e":[1.0,{}]},"c":"'), "event_type", F.lit('"},"f":{},"a":'), c("event_id").cast("string"), F.lit(".00}"))
    return documents.flatten(e.select("event_id", text.alias("document")), id="event_id").select("event_id", F.array_join("path", "/").alias("path"), "value")


@registry.add("""SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE '{"a":[' || event_id || ',"1.0E1",{"x":null,"y":true}],"b":' || CASE WHEN event_id % 10 = 0 THEN event_id // 10 || '' ELSE event_id // 10 || '.' || event_id % 10 END || '}' END AS normal FROM events""")
def canonical_documents(spark, sf_dir):
    """Five ways to write one document, the last of which is none."""
    n = c("event_id").cast("string")
    tenth = F.concat(F.floor(c("event_id") / 10).cast("string"), F.lit("."), (c("event_id") % 10).cast("string"))
    whole = F.when(c("event_id") % 5 == 0, n).when(c("event_id") % 5 == 1, F.concat(n, F.lit(".000"))).when(c("event_id") % 5 == 2, F.concat(n, F.lit("0e-1"))).otherwise(F.concat(n, F.lit("E0")))
    b = F.when(c("event_id") % 2 == 0, tenth).otherwise(F.concat(tenth, F.lit("0")))
    text = F.concat(F.lit('{ "b": '), b, F.lit(', "a" : ['), whole, F.lit(',"1.0E1",{"y":true,"x":null}'), F.when(c("event_id") % 5 == 4, "").otherwise("]"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", canonical_json(text).alias("normal"))


# -- what resources depend on: suppliers of parts ------------------------------------------------------------------------


def part_edges(spark, sf_dir, later: bool):
    """Each part depends on three suppliers; later, each ninth on another one and each tenth on one more."""
    k = c("p_partkey")
    extra = F.when(k % 10 == 0, F.array(F.lit(3))).otherwise(F.array().cast("array<int>")) if later else F.array().cast("array<int>")
    moved = F.when((k % 9 == 0) & F.lit(later), 100).otherwise(0)
    to = F.explode(F.concat(F.array(F.lit(0), F.lit(1), F.lit(2)), extra))
    e = table(spark, sf_dir, "part").select(c("p_brand").alias("target_id"), F.concat(F.lit("column:"), k.cast("string")).alias("id"), k, moved.alias("moved"), to.alias("i"))
    return e.select("target_id", "id", F.concat(F.lit("supplier:"), (c("p_partkey") % 50 + c("i") + c("moved")).cast("string")).alias("dep"), F.lit("uses").alias("type"))


def _edges_sql(later: bool) -> str:
    to = "CASE WHEN p_partkey % 10 = 0 THEN [0, 1, 2, 3] ELSE [0, 1, 2] END" if later else "[0, 1, 2]"
    moved = "CASE WHEN p_partkey % 9 = 0 THEN 100 ELSE 0 END" if later else "0"
    row = f"sha256('supplier:' || (p_partkey % 50 + i + {moved}) || chr(0) || 'uses')"
    return f"SELECT id, {multiset_digest_sql(row)} AS linked FROM (SELECT *, unnest({to}) AS i FROM cur) GROUP BY id"


LINKED = f"""{CUR}, l0 AS ({_edges_sql(False)}), l1 AS ({_edges_sql(True)}),
own AS (SELECT cur.*, sha256(concat_ws(chr(0), 'resource', kind, name, '', spec, l0.linked)) AS f0, sha256(concat_ws(chr(0), 'resource', kind, name, '', spec, l1.linked)) AS f1 FROM cur JOIN l0 USING (id) JOIN l1 USING (id))"""


@registry.add(f"WITH {LINKED} SELECT target_id, id, 'alter' AS op, f0 AS before, f1 AS after FROM own WHERE p_partkey % 9 = 0 OR p_partkey % 10 = 0")
def j3_diff_dependencies(spark, sf_dir):
    """Nothing but what parts depend on is changed."""
    parts = current_parts(spark, sf_dir)
    return catalog.diff_resources(parts, parts, part_edges(spark, sf_dir, False), part_edges(spark, sf_dir, True))


@registry.add(f"""WITH {LINKED}, m AS (SELECT target_id, id || '=' || f1 AS member FROM own UNION ALL SELECT DISTINCT target_id, 'annotation' || chr(0) || 'owner' || chr(0) || '"' || target_id || '"' FROM own)
SELECT target_id, {multiset_digest_sql('sha256(member)')} AS digest, count(*) AS n FROM m GROUP BY target_id""")
def a8_document_fingerprint(spark, sf_dir):
    """Documents with dependencies and annotations, of which rename hints do not count."""
    parts = current_parts(spark, sf_dir)
    notes = parts.select("target_id").distinct().select("target_id", F.explode(F.create_map(F.lit("owner"), F.concat(F.lit(' "'), "target_id", F.lit('" ')), F.lit("rename_hints"), F.lit("[]"))).alias("key", "value"))
    return catalog.semantic_fingerprint(parts, part_edges(spark, sf_dir, True), notes)


# -- changes in order: customers are tables, their orders columns, indexes and grants -------------------------------------


def schema_changes(spark, sf_dir):
    """(changes, edges): tables are created, dropped, renamed, altered or both, by customer; what belongs to them by order."""
    k, o = c("c_custkey"), c("o_orderkey")
    customer = table(spark, sf_dir, "customer").select(c("c_nationkey").cast("string").alias("target_id"), k)
    kind = k % 5
    ops = F.when(kind == 0, F.array(F.lit("create"))).when(kind == 1, F.array(F.lit("drop"))).when(kind == 2, F.array(F.lit("rename"))).when(kind == 3, F.array(F.lit("alter"))).otherwise(F.array(F.lit("rename"), F.lit("alter")))
    own = F.concat(F.lit("table:"), k.cast("string"))
    old = F.when((c("op") == "rename"), F.concat(own, F.lit("-old"))).when(c("op") == "create", None).otherwise(own)
    tables = customer.withColumn("op", F.explode(ops)).select(
        "target_id", F.concat_ws(":", "op", own).alias("change_id"), "op", old.alias("before_id"), F.when(c("op") != "drop", own).alias("after_id"), F.lit("table").alias("kind"), F.lit(None).cast("string").alias("parent"), own.alias("name"), F.lit(None).cast("int").alias("ordinal")
    )
    orders = table(spark, sf_dir, "orders").select(c("o_custkey").alias("c_custkey"), o).join(customer, "c_custkey")
    orders = orders.withColumn("kind", F.when(o % 4 < 2, "column").when(o % 4 == 2, "index").otherwise("grant"))
    op = F.when(kind == 1, "drop").when(o % 3 == 0, "create").when(o % 3 == 1, "drop").when(c("kind") == "column", "rename").otherwise("alter")
    item = F.concat_ws(":", "kind", o.cast("string"))
    items = orders.withColumn("op", op).select(
        "target_id", F.concat_ws(":", "op", item).alias("change_id"), "op", F.when(c("op") == "rename", F.concat(item, F.lit("-old"))).when(c("op") == "create", None).otherwise(item).alias("before_id"), F.when(c("op") != "drop", item).alias("after_id"), "kind",
        F.when(c("kind") != "grant", own).alias("parent"), item.alias("name"), (o % 100).cast("int").alias("ordinal"),
    )
    edges = orders.filter("kind = 'grant'").select("target_id", item.alias("id"), own.alias("dep"))
    return tables.unionByName(items), edges


CHANGES = """t AS (SELECT CAST(c_nationkey AS VARCHAR) AS target_id, c_custkey AS k, 'table:' || c_custkey AS own, unnest(CASE c_custkey % 5 WHEN 0 THEN ['create'] WHEN 1 THEN ['drop'] WHEN 2 THEN ['rename'] WHEN 3 THEN ['alter'] ELSE ['rename', 'alter'] END) AS op FROM customer),
i0 AS (SELECT CAST(c_nationkey AS VARCHAR) AS target_id, c_custkey AS k, o_orderkey AS o, CASE WHEN o_orderkey % 4 < 2 THEN 'column' WHEN o_orderkey % 4 = 2 THEN 'index' ELSE 'grant' END AS kind FROM orders JOIN customer ON o_custkey = c_custkey),
i AS (SELECT *, kind || ':' || o AS own, CASE WHEN k % 5 = 1 THEN 'drop' WHEN o % 3 = 0 THEN 'create' WHEN o % 3 = 1 THEN 'drop' WHEN kind = 'column' THEN 'rename' ELSE 'alter' END AS op FROM i0),
ch AS (SELECT target_id, op || ':' || own AS id, op, 'table' AS kind, k, CAST(NULL AS BIGINT) AS ordinal, CAST(NULL AS VARCHAR) AS parent, own FROM t
       UNION ALL SELECT target_id, op || ':' || own, op, kind, k, o % 100, CASE WHEN kind <> 'grant' THEN 'table:' || k END, own FROM i),
ow AS (SELECT k, min(op) || ':table:' || k AS owner FROM t GROUP BY k),
ed AS (SELECT target_id, 'alter:' || own AS id, 'rename:' || own AS dep FROM t WHERE op = 'rename' AND k % 5 = 4
       UNION SELECT target_id, CASE WHEN op = 'drop' THEN owner ELSE id END, CASE WHEN op = 'drop' THEN id ELSE owner END FROM ch JOIN ow USING (k) WHERE kind <> 'table'
       UNION SELECT a.target_id, a.id, b.id FROM ch a JOIN ch b ON a.parent = b.parent WHERE a.kind = 'column' AND a.op IN ('drop', 'rename') AND b.kind <> 'column' AND b.op = 'drop'),
base(target_id, id, level) AS (SELECT target_id, id, 0 FROM ch UNION SELECT ed.target_id, ed.id, level + 1 FROM base JOIN ed ON ed.dep = base.id)"""
# grants come a level after the highest of all others that are not dropped; what is dropped a level after grants that are


@registry.add(f"""WITH RECURSIVE {CHANGES},
g AS (SELECT target_id, max(level) AS top FROM base JOIN ch USING (target_id, id) WHERE kind <> 'grant' AND op <> 'drop' GROUP BY target_id),
r AS (SELECT DISTINCT target_id FROM ch WHERE kind = 'grant' AND op = 'drop'),
-- with grants revoked first, every path from a drop of something else starts one level higher
p(target_id, id, level) AS (SELECT ch.target_id, ch.id, CASE WHEN kind <> 'grant' AND op = 'drop' AND r.target_id IS NOT NULL THEN 1 ELSE 0 END FROM ch LEFT JOIN r USING (target_id)
    UNION SELECT ed.target_id, ed.id, level + 1 FROM p JOIN ed ON ed.dep = p.id),
h AS (SELECT p.target_id, p.id, max(level) AS level FROM p GROUP BY ALL),
top AS (SELECT target_id, max(level) AS top FROM h JOIN ch USING (target_id, id) WHERE kind <> 'grant' AND op <> 'drop' GROUP BY target_id)
SELECT ch.target_id, ch.id AS change_id, CASE WHEN kind = 'grant' AND op <> 'drop' THEN greatest(h.level, coalesce(top + 1, 0)) ELSE h.level END AS level,
concat_ws('|', CASE op WHEN 'create' THEN '2' WHEN 'drop' THEN '3' ELSE '1' END, kind, coalesce(parent, ''), CASE WHEN op = 'create' AND kind = 'column' THEN lpad(CAST(ordinal AS VARCHAR), 9, '0') || '|' ELSE '' END || own, ch.id) AS sort_key
FROM ch JOIN h USING (target_id, id) LEFT JOIN top USING (target_id)""")
def o4_change_order(spark, sf_dir):
    changes, edges = schema_changes(spark, sf_dir)
    ordered, _ = catalog.change_order(changes, edges, edges)
    return ordered.select("target_id", "change_id", "level", F.translate("sort_key", "\0", "|").alias("sort_key"))


@registry.add("""SELECT 'r' || (o_orderkey % 7) AS target_id, o_orderkey AS id, rank() OVER (PARTITION BY o_orderkey % 7 ORDER BY o_orderkey) - 1 AS level FROM orders""")
def o4_long_chains(spark, sf_dir):
    """Seven chains of orders, each waiting for the seventh before it."""
    k = c("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("r"), (k % 7).cast("string")).alias("target_id"), k.alias("id"))
    edges = orders.withColumn("dep", c("id") - 7).join(orders.withColumnRenamed("id", "dep"), ["target_id", "dep"], "left_semi")
    return graphs.levels(orders, edges)[0]


@registry.add("""WITH o AS (SELECT o_orderkey AS id FROM orders), b AS (SELECT max(o_orderkey) // 2 AS half FROM orders)
SELECT 'r' || (id % 7) AS target_id, id FROM o, b WHERE id >= half - half % 7 - 3""")
def g2_long_cycles(spark, sf_dir):
    """Chains of orders as above, of which the one in the middle waits for the last of its chain: half of each is behind a cycle, or in it."""
    k = c("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("r"), (k % 7).cast("string")).alias("target_id"), k.alias("id"))
    half = (orders.agg(F.max("id")).first()[0] or 0) // 2
    low = half - half % 7 - 3
    last = orders.groupBy("target_id").agg(F.max("id").alias("last"))
    back = orders.filter((c("id") >= low) & (c("id") < low + 7)).join(last, "target_id").select("target_id", "id", c("last").alias("dep"))
    edges = orders.withColumn("dep", c("id") - 7).join(orders.withColumnRenamed("id", "dep"), ["target_id", "dep"], "left_semi")
    return graphs.in_or_behind_cycles(edges.unionByName(back))
