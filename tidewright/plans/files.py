"""Queries over files that are written from the tables: records of several formats, locks, catalog captures."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewright.plans.common import Registry, table
from tidewright.session import shared_folder
from tidewright.sources import readers, sinks, snapshots

registry = Registry()
c = F.col
#: Rows of a file.
ROWS = 500


def written(spark, lines, name):
    """A folder with a text file for each value of `file` in lines(file, text)."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    lines.write.partitionBy("file").text(folder)
    return folder


def customers(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return t.withColumn("file", F.floor(c("c_custkey") / ROWS))


@registry.add("SELECT c_custkey, c_name, c_acctbal FROM customer")
def s1_read_json(spark, sf_dir):
    """Files with an array of records each, in which a number and a list stand between the records."""
    record = F.to_json(F.struct("c_custkey", "c_name", "c_acctbal"))
    text = F.concat(F.lit("[1, [2],\n"), F.array_join(F.collect_list(record), ",\n"), F.lit("]"))
    folder = written(spark, customers(spark, sf_dir).groupBy("file").agg(text.alias("text")), "json")
    return readers.read_json(spark, folder, "c_custkey long, c_name string, c_acctbal double")


@registry.add("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name || ', \"x\"' END AS name, c_acctbal AS balance FROM customer")
def s2_read_csv(spark, sf_dir):
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    name = F.when(c("c_custkey") % 7 != 0, F.concat("c_name", F.lit(', "x"')))
    # a name of the header holds a comma
    rows = customers(spark, sf_dir).select("c_custkey", name.alias("name"), c("c_acctbal").alias("the, balance"))
    rows.repartition(4, "c_custkey").write.option("quoteAll", True).option("escape", '"').option("nullValue", None).csv(folder, header=True)
    return readers.read_csv(spark, folder, "c_custkey long, name string, `the, balance` double").withColumnRenamed("the, balance", "balance")


@registry.add("SELECT c_custkey, c_name, c_acctbal FROM customer")
def s3_read_yaml(spark, sf_dir):
    record = F.concat(F.lit("- c_custkey: "), c("c_custkey").cast("string"), F.lit('\n  c_name: "'), "c_name", F.lit('"\n  c_acctbal: '), c("c_acctbal").cast("string"))
    folder = written(spark, customers(spark, sf_dir).groupBy("file").agg(F.array_join(F.collect_list(record), "\n").alias("text")), "yaml")
    return readers.read_yaml(spark, folder, "c_custkey long, c_name string, c_acctbal double")


@registry.add(f"""SELECT CAST(file AS VARCHAR) AS path, CASE file % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'changed' WHEN 2 THEN 'unlocked' ELSE 'missing' END AS status FROM (SELECT DISTINCT c_custkey // {ROWS // 10} AS file FROM customer)""")
def s5_verify_digests(spark, sf_dir):
    """Files held against a lock table: some were changed, some are not locked, some are gone."""
    rows = table(spark, sf_dir, "customer").groupBy(F.floor(c("c_custkey") / (ROWS // 10)).alias("file")).agg(F.array_join(F.sort_array(F.collect_list("c_name")), "\n").alias("text"))
    folder = written(spark, rows.filter(c("file") % 4 != 3).withColumn("text", F.when(c("file") % 4 == 1, F.concat("text", F.lit("!"))).otherwise(c("text"))), "locked")
    locks = rows.filter(c("file") % 4 != 2).select(c("file").cast("string").alias("path"), F.concat(F.lit("sha256:"), F.sha2(F.concat("text", F.lit("\n")), 256)).alias("digest"))
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "file=([0-9]+)", 1).alias("path"), "content")
    return readers.verify_digests(files, locks)


@registry.add("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS place FROM orders")
def o1_output_order(spark, sf_dir):
    """Orders written in order of their priority, and where each one stands when all files are read one after the other."""
    folder = f"{shared_folder(spark)}/ordered-{uuid.uuid4().hex}"
    sinks.write_ordered(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), folder, ["o_orderpriority", "o_orderkey"])
    return sinks.read_in_order(spark, folder).select("o_orderkey", "place")


def captures(spark, sf_dir):
    """A catalog: regions are schemas, nations roles, parts relations and what belongs to them, suppliers the rest."""
    s = lambda x: x.cast("string")
    t = lambda name: table(spark, sf_dir, name)
    p, k = t("part"), c("p_partkey")
    schema = F.concat(F.lit("s"), s(k % 5))
    own = p.select(k, schema.alias("schema_name"), F.concat(F.lit("t"), s(k)).alias("table_name"), F.concat(F.lit("n"), s(k % 25)).alias("owner"), (k % 2 == 0).alias("even"), c("p_type").alias("definition"))
    return {
        "schemas": t("region").select(F.concat(F.lit("s"), s(c("r_regionkey"))).alias("schema_name"), F.lit("n0").alias("owner")),
        "roles": t("nation").select(F.concat(F.lit("n"), s(c("n_nationkey"))).alias("role_name"), (c("n_nationkey") % 2 == 0).alias("login")),
        "memberships": t("nation").select(F.lit("n0").alias("role_name"), F.concat(F.lit("n"), s(c("n_nationkey"))).alias("member"), F.lit(False).alias("admin")),
        "relations": own.select("schema_name", "table_name", F.when(c("even"), "r").otherwise("v").alias("relation_kind"), F.when(~c("even"), c("definition")).alias("definition"), "owner"),
        "columns": own.select("schema_name", "table_name", F.lit("id").alias("column_name"), F.lit("bigint").alias("type"), c("even").alias("nullable"), F.lit(1).alias("ordinal")),
        "constraints": own.filter("even").select("schema_name", "table_name", F.lit("fk").alias("constraint_name"), F.when(k % 4 == 0, "f").otherwise("c").alias("constraint_kind"), F.lit("x").alias("definition"), F.when(k % 4 == 0, F.concat(F.lit("t"), s(k % 100))).alias("referenced_table")),
        "indexes": own.filter("even").select("schema_name", "table_name", F.lit("ix").alias("index_name"), "definition", F.lit(True).alias("unique")),
        "policies": own.filter(k % 10 == 0).select("schema_name", "table_name", F.lit("own").alias("policy_name"), F.lit("select").alias("command"), c("owner").alias("role_name")),
        "triggers": own.filter(k % 10 == 2).select("schema_name", "table_name", F.lit("tr").alias("trigger_name"), "definition", F.lit("f").alias("routine_name"), F.lit("").alias("arguments")),
        "grants": own.filter(k % 3 == 0).select("schema_name", "table_name", c("owner").alias("grantee"), F.lit("SELECT").alias("privilege"), c("even").alias("grantable")),
        "routines": t("region").select(F.concat(F.lit("s"), s(c("r_regionkey"))).alias("schema_name"), F.lit("f").alias("routine_name"), F.lit("").alias("arguments"), F.lit("sql").alias("language")),
        "types": t("region").select(F.concat(F.lit("s"), s(c("r_regionkey"))).alias("schema_name"), F.lit("mood").alias("type_name"), F.lit("enum").alias("category")),
        "default_privileges": t("region").select(F.concat(F.lit("s"), s(c("r_regionkey"))).alias("schema_name"), F.lit("n0").alias("owner"), F.lit("n1").alias("grantee"), F.lit("SELECT").alias("privilege"), F.lit("tables").alias("object_kind")),
    }


_CAPTURED = """p AS (SELECT p_partkey AS k, 's' || (p_partkey % 5) AS s, 't' || p_partkey AS t, 'n' || (p_partkey % 25) AS o, p_partkey % 2 = 0 AS even, p_type AS d FROM part),
r AS (SELECT 'schema' AS kind, 's' || r_regionkey AS name, NULL AS parent, '{"owner":"n0"}' AS spec, ['role:n0'] AS needs FROM region
UNION ALL SELECT 'role', 'n' || n_nationkey, NULL, '{"login":' || (n_nationkey % 2 = 0) || '}', [] FROM nation
UNION ALL SELECT 'membership', 'n0.n' || n_nationkey, 'role:n0', '{"admin":false}', ['role:n' || n_nationkey] FROM nation
UNION ALL SELECT CASE WHEN even THEN 'table' ELSE 'view' END, s || '.' || t, 'schema:' || s, CASE WHEN even THEN '{"owner":"' || o || '"}' ELSE '{"definition":"' || d || '","owner":"' || o || '"}' END, ['role:' || o] FROM p
UNION ALL SELECT 'column', s || '.' || t || '.id', 'table:' || s || '.' || t, '{"type":"bigint","nullable":' || even || ',"ordinal":1}', [] FROM p
UNION ALL SELECT CASE WHEN k % 4 = 0 THEN 'foreign_key' ELSE 'check_constraint' END, s || '.' || t || '.fk', 'table:' || s || '.' || t, '{"definition":"x"}', CASE WHEN k % 4 = 0 THEN ['table:' || s || '.t' || (k % 100)] ELSE [] END FROM p WHERE even
UNION ALL SELECT 'index', s || '.' || t || '.ix', 'table:' || s || '.' || t, '{"definition":"' || d || '","unique":true}', [] FROM p WHERE even
UNION ALL SELECT 'policy', s || '.' || t || '.own', 'table:' || s || '.' || t, '{"command":"select"}', ['role:' || o] FROM p WHERE k % 10 = 0
UNION ALL SELECT 'trigger', s || '.' || t || '.tr', 'table:' || s || '.' || t, '{"definition":"' || d || '"}', ['function:' || s || '.f.'] FROM p WHERE k % 10 = 2
UNION ALL SELECT 'grant', s || '.' || t || '.' || o || '.SELECT', 'table:' || s || '.' || t, '{"grantable":' || even || '}', ['role:' || o] FROM p WHERE k % 3 = 0
UNION ALL SELECT 'function', 's' || r_regionkey || '.f.', 'schema:s' || r_regionkey, '{"language":"sql"}', [] FROM region
UNION ALL SELECT 'type', 's' || r_regionkey || '.mood', 'schema:s' || r_regionkey, '{"category":"enum"}', [] FROM region
UNION ALL SELECT 'default_privilege', 's' || r_regionkey || '.n0.n1.SELECT', 'schema:s' || r_regionkey, '{"object_kind":"tables"}', ['role:n0', 'role:n1'] FROM region)"""


@registry.add(f"WITH {_CAPTURED} SELECT 'db' AS target_id, kind || ':' || name AS id, kind, name, parent, spec FROM r")
def s9_catalog_families(spark, sf_dir):
    return snapshots.snapshot(captures(spark, sf_dir), F.lit("db"))[0]


@registry.add(f"WITH {_CAPTURED} SELECT DISTINCT 'db' AS target_id, kind || ':' || name AS id, unnest(CASE WHEN parent IS NULL THEN needs ELSE list_append(needs, parent) END) AS dep FROM r")
def s9_catalog_edges(spark, sf_dir):
    return snapshots.snapshot(captures(spark, sf_dir), F.lit("db"))[1]
