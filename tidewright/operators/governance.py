"""Policies, security states, approvals and gates."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order in which security changes are carried out.
CHANGE_RANK = {"create_principal": 1, "alter_principal": 2, "membership": 3, "grant": 4, "policy": 5, "revoke": 6, "drop_principal": 7}


# -- policies ----------------------------------------------------------------------------------------------------------


def _typed(column: Column, value) -> tuple[Column, Column]:
    """Both sides of a comparison: numbers exactly, as decimals, and never equal to text."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return column, F.lit(value)
    return column.cast("decimal(38,10)"), F.lit(str(value)).cast("decimal(38,10)")


def compile_rule(rule: dict, columns: dict[str, Column], variables: dict | None = None, predicates: dict[str, dict] | None = None, _open: tuple = ()) -> Column:
    """A two-valued Column of a rule.

    all, any (lists), not (a rule), predicate (a name), or one of eq, ne, in, matches, exists with
    ref and value. A missing value makes eq and ne false alike, and not of that true.
    """
    variables, predicates = variables or {}, predicates or {}
    again = lambda r, opened=_open: compile_rule(r, columns, variables, predicates, opened)
    (kind, body), *rest = rule.items()
    if rest:
        raise ValueError(f"a rule has one operator, not {list(rule)}")
    if kind in ("all", "any"):
        join = (lambda a, b: a & b) if kind == "all" else (lambda a, b: a | b)
        return reduce(join, [again(r) for r in body], F.lit(kind == "all"))
    if kind == "not":
        return ~again(body)
    if kind == "predicate":
        if body in _open:
            raise ValueError(f"predicate {body!r} refers to itself")
        return again(predicates[body], (*_open, body))
    column = columns[body["ref"]]
    value = body.get("value")
    if isinstance(value, dict):
        value = variables.get(value["var"])
    if kind == "exists":
        leaf = column.isNotNull()
    elif kind in ("eq", "ne"):
        a, b = _typed(column, value)
        leaf = (a == b) if kind == "eq" else (a != b)
    elif kind == "in":
        leaf = reduce(lambda a, b: a | b, [x == y for x, y in (_typed(column, v) for v in value)], F.lit(False))
    elif kind == "matches":
        if re.search(r"\(\?[=!<]", value):
            raise ValueError("look-around is not allowed in patterns")
        leaf = column.rlike(value)
    else:
        raise ValueError(f"unknown operator {kind!r}")
    return F.coalesce(leaf, F.lit(False))


def violations(resources: DataFrame, rules: list[dict], columns: dict[str, Column], keep: list[str], kind: str = "kind", variables: dict | None = None, predicates: dict | None = None) -> DataFrame:
    """keep, rule, severity, message of each resource that does not satisfy a rule; all rules in one scan.

    A rule: name, assert, and optionally kinds, severity (error), message.
    """
    found = []
    for r in rules:
        holds = compile_rule(r["assert"], columns, variables, predicates)
        applies = F.col(kind).isin(r["kinds"]) if r.get("kinds") else F.lit(True)
        found.append(F.when(applies & ~holds, F.struct(F.lit(r["name"]).alias("rule"), F.lit(r.get("severity", "error")).alias("severity"), F.lit(r.get("message", "")).alias("message"))))
    return resources.select(*keep, F.explode(F.array_compact(F.array(*found))).alias("v")).select(*keep, "v.*")


# -- security states ---------------------------------------------------------------------------------------------------


def diff_principals(desired: DataFrame, observed: DataFrame, attributes: list[str], protected: list[str], allow_external: bool = False) -> DataFrame:
    """state_id, name, change, refused: create, alter, drop of principals(state_id, name, external, attributes).

    External principals are not dropped, and altering one is refused; so is dropping a protected one
    (who executes, and emergency accounts).
    """
    key = ["state_id", "name"]
    d = desired.select(*key, F.struct(*attributes).alias("d"))
    o = observed.select(*key, F.struct(*attributes).alias("o"), F.coalesce("external", F.lit(False)).alias("external"))
    change = F.when(F.col("o").isNull(), "create_principal").when(F.col("d").isNull(), "drop_principal").when(F.col("o") != F.col("d"), "alter_principal")
    external = F.coalesce("external", F.lit(False)) & F.lit(not allow_external)
    refused = F.when((F.col("change") == "alter_principal") & external, "external").when((F.col("change") == "drop_principal") & F.col("name").isin(protected), "lockout")
    joined = d.join(o, key, "full_outer").withColumn("change", change).filter("change is not null")
    return joined.filter(~((F.col("change") == "drop_principal") & external)).withColumn("refused", refused).select(*key, "change", "refused")


def diff_sets(desired: DataFrame, observed: DataFrame, columns: list[str], added: str, removed: str) -> DataFrame:
    """columns, change: rows of one side only, compared as whole tuples (nulls equal)."""
    d, o = desired.select(*columns).distinct(), observed.select(*columns).distinct()
    return d.exceptAll(o).withColumn("change", F.lit(added)).unionByName(o.exceptAll(d).withColumn("change", F.lit(removed)))


def ranked(changes: DataFrame) -> DataFrame:
    """changes with the rank in which they are carried out."""
    out = F
    for k, v in CHANGE_RANK.items():
        out = out.when(F.col("change") == k, v)
    return changes.withColumn("rank", out.otherwise(99))


def access_paths(memberships: DataFrame, grants: DataFrame) -> DataFrame:
    """state_id, name, paths: roles that a principal inherits and its direct grants, one hop."""
    inherits = memberships.select("state_id", F.col("member").alias("name"), F.concat(F.lit("inherits "), "parent").alias("path"))
    holds = grants.select("state_id", F.col("grantee").alias("name"), F.concat_ws(" ", "privilege", F.lit("on"), "object").alias("path"))
    return inherits.unionByName(holds).groupBy("state_id", "name").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def tables_without_policy(grants: DataFrame, policies: DataFrame, pattern: str) -> DataFrame:
    """state_id, object of granted tables that match and have no row policy."""
    wanted = grants.filter(F.col("object").rlike(pattern)).select("state_id", "object").distinct()
    return wanted.join(policies.select("state_id", F.col("table").alias("object")).distinct(), ["state_id", "object"], "left_anti")


def ownership_violations(grants: DataFrame, boundaries: DataFrame) -> DataFrame:
    """grants whose grantor has a boundary(state_id, actor, object) that does not hold the object."""
    bound = boundaries.select("state_id", F.col("actor").alias("grantor")).distinct()
    allowed = boundaries.select("state_id", F.col("actor").alias("grantor"), "object")
    return grants.join(bound, ["state_id", "grantor"], "left_semi").join(allowed, ["state_id", "grantor", "object"], "left_anti")


def public_grants(grants: DataFrame) -> DataFrame:
    return grants.filter(F.lower("grantee") == "public")


def unmanaged_principals(principals: DataFrame) -> DataFrame:
    return principals.filter(~F.coalesce("managed", F.lit(False)) & ~F.coalesce("external", F.lit(False)))


# -- approvals and gates -----------------------------------------------------------------------------------------------


def approval_quorum(plans: DataFrame, approvals: DataFrame, identities: DataFrame, requirements: DataFrame, now: Column) -> DataFrame:
    """digest, allowed: whether the approvals of a plan meet each requirement of its environment.

    plans(digest, environment, author, requester, risk, expires_at), approvals(plan_digest,
    environment, approver, approved_at, expires_at), identities(id, roles), requirements(environment,
    minimum_risk, approver_count, roles). An approval counts if it is for the plan's environment, not
    of the future, not expired, and of neither author nor requester; an approver counts once, with all
    roles. An environment without requirements rows is not allowed; nor is an expired plan.
    """
    valid = (
        approvals.join(plans.select(F.col("digest").alias("plan_digest"), F.col("environment").alias("plan_environment"), "author", "requester"), "plan_digest")
        .filter((F.col("environment") == F.col("plan_environment")) & (F.col("approved_at") <= now) & (F.col("expires_at") > now))
        .filter((F.col("approver") != F.col("author")) & (F.col("approver") != F.col("requester")))
        .join(identities.select(F.col("id").alias("approver"), F.col("roles").alias("held")), "approver")
        .select(F.col("plan_digest").alias("digest"), "approver", "held")
    )
    asked = plans.join(requirements.withColumn("requirement", F.struct("minimum_risk", "approver_count", "roles")).drop("minimum_risk", "approver_count", "roles"), "environment")
    applies = F.col("risk") >= F.col("requirement.minimum_risk")
    has_all = F.size(F.array_except("requirement.roles", "held")) == 0
    met = (
        asked.join(valid, "digest", "left")
        .groupBy("digest", "author", "requester", "expires_at", "requirement", applies.alias("applies"))
        .agg(F.count_distinct(F.when(has_all, F.col("approver"))).alias("n"))
        .withColumn("met", ~F.col("applies") | (F.col("n") >= F.col("requirement.approver_count")))
    )
    judged = met.groupBy("digest").agg(F.bool_and("met").alias("met"), F.first(F.col("author") != F.col("requester")).alias("apart"), F.first(F.col("expires_at").isNull() | (F.col("expires_at") > now)).alias("fresh"))
    return plans.select("digest").join(judged, "digest", "left").select("digest", F.coalesce(F.col("met") & F.col("apart") & F.col("fresh"), F.lit(False)).alias("allowed"))


def decisions(plans: DataFrame, approvals: DataFrame, identities: DataFrame, requirements: DataFrame, overrides: DataFrame, now: Column) -> DataFrame:
    """digest, allowed, emergency, reason: approval_quorum with overrides(plan_digest, identity, reason); identities have emergency too.

    An override stands in for the quorum of a plan that is apart, fresh and of a known environment, if its identity is the
    requester, has emergency authority and gives a reason. One that is not so denies the plan, whatever its approvals.
    """
    quorum = approval_quorum(plans, approvals, identities, requirements, now)
    holders = identities.filter(F.coalesce("emergency", F.lit(False))).select(F.col("id").alias("identity"), F.lit(True).alias("holds"))
    said = overrides.join(holders, "identity", "left").join(plans.select(F.col("digest").alias("plan_digest"), "requester"), "plan_digest")
    sound = (F.trim(F.coalesce("reason", F.lit(""))) != "") & (F.col("identity") == F.col("requester")) & F.coalesce("holds", F.lit(False))
    given = said.groupBy(F.col("plan_digest").alias("digest")).agg(F.bool_and(F.coalesce(sound, F.lit(False))).alias("sound"), F.min("reason").alias("reason"))
    known = requirements.select("environment").distinct().withColumn("_known", F.lit(True))
    ready = plans.join(known, "environment", "left").select("digest", (F.coalesce("_known", F.lit(False)) & (F.col("author") != F.col("requester")) & (F.col("expires_at").isNull() | (F.col("expires_at") > now))).alias("ready"))
    joined = quorum.join(given, "digest", "left").join(ready, "digest")
    emergency = F.coalesce(F.col("sound") & F.col("ready"), F.lit(False))
    allowed = F.when(F.col("sound").isNull(), F.col("allowed")).otherwise(emergency)
    return joined.select("digest", allowed.alias("allowed"), emergency.alias("emergency"), F.when(emergency, F.col("reason")).alias("reason"))


@dataclass(frozen=True)
class Rule:
    """A rule over a state or its changes: check gives rows (state_id, principal, object, message) for what breaks it."""

    name: str
    check: Callable[[dict[str, DataFrame]], DataFrame]
    remediation: str = ""


def evaluate_rules(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """rule, state_id, principal, object, message, remediation of all that the rules find in tables (a state's, or changes).

    Two rules of one name are refused, and so is a rule without a name.
    """
    names = [r.name for r in rules]
    if "" in names or len(set(names)) < len(names):
        raise ValueError("rules need names of their own")
    columns = ("state_id", "principal", "object", "message")
    found = [r.check(tables).select(F.lit(r.name).alias("rule"), *[F.col(c).cast("string").alias(c) for c in columns], F.lit(r.remediation).alias("remediation")) for r in rules]
    return reduce(DataFrame.unionByName, found)


def gate_evidence(gates: DataFrame, checks: DataFrame, approvals: DataFrame) -> DataFrame:
    """gate, passed: each required check passed, and an approval names the gate's evidence.

    gates(gate, evidence, required: array), checks(gate, name, status), approvals(gate, evidence).
    """
    required = gates.select("gate", F.explode_outer("required").alias("name")).join(checks, ["gate", "name"], "left")
    passed = required.groupBy("gate").agg(F.bool_and(F.col("name").isNull() | F.coalesce(F.col("status") == "pass", F.lit(False))).alias("checks"))
    bound = approvals.join(gates.select("gate", "evidence"), ["gate", "evidence"], "left_semi").select("gate").distinct().withColumn("bound", F.lit(True))
    return passed.join(bound, "gate", "left").select("gate", (F.col("checks") & F.coalesce("bound", F.lit(False))).alias("passed"))


def blockers(evidence: DataFrame, keep: list[str], conditions: dict[str, Column]) -> DataFrame:
    """keep, blockers: names of the conditions that hold for an evidence row, in the order given."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in conditions.items()]))
    return evidence.select(*keep, names.alias("blockers"))


def review_outcome(stages: DataFrame, by: str) -> DataFrame:
    """by, passed: all stages passed, and there is one; `by` rows without stages have a null passed column."""
    return stages.groupBy(by).agg(((F.count("passed") > 0) & F.coalesce(F.bool_and(F.coalesce("passed", F.lit(False))), F.lit(False))).alias("passed"))
