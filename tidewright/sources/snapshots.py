"""Captured catalog tables as resources and edges: a family for each kind of object.

A family says which columns name an object and its parent, which are its spec, and what it depends on. Rows come from
Parquet captures or over JDBC; names, not row numbers of the database, identify objects, so that captures of two databases
can be held against each other.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Family:
    """kind: a fixed kind, or "@column" for one that KINDS translates; name, parent: columns that make them up; spec: its members.

    parent_kind likewise; needs: (kind, columns) of what an object depends on, where all the columns are there.
    """

    kind: str
    name: tuple[str, ...]
    parent_kind: str | None = None
    parent: tuple[str, ...] = ()
    spec: tuple[str, ...] = ()
    needs: tuple[tuple[str, tuple[str, ...]], ...] = ()


#: Kinds by the letters that catalogs have for relations and constraints.
KINDS = {"r": "table", "p": "table", "v": "view", "m": "materialized_view", "S": "sequence", "f": "foreign_table"}
CONSTRAINT_KINDS = {"p": "primary_key", "u": "unique_constraint", "c": "check_constraint", "f": "foreign_key", "x": "exclusion_constraint"}
_SCHEMA, _TABLE = ("schema", ("schema_name",)), ("table", ("schema_name", "table_name"))
#: The families of a catalog.
FAMILIES = {
    "schemas": Family("schema", ("schema_name",), spec=("owner",), needs=(("role", ("owner",)),)),
    "types": Family("type", ("schema_name", "type_name"), *_SCHEMA, spec=("category", "definition")),
    "relations": Family("@relation_kind", ("schema_name", "table_name"), *_SCHEMA, spec=("definition", "owner"), needs=(("role", ("owner",)),)),
    "columns": Family("column", ("schema_name", "table_name", "column_name"), *_TABLE, spec=("type", "nullable", "default", "ordinal")),
    "constraints": Family("@constraint_kind", ("schema_name", "table_name", "constraint_name"), *_TABLE, spec=("definition",), needs=(("table", ("schema_name", "referenced_table")),)),
    "indexes": Family("index", ("schema_name", "table_name", "index_name"), *_TABLE, spec=("definition", "unique")),
    "routines": Family("function", ("schema_name", "routine_name", "arguments"), *_SCHEMA, spec=("language", "definition")),
    "triggers": Family("trigger", ("schema_name", "table_name", "trigger_name"), *_TABLE, spec=("definition",), needs=(("function", ("schema_name", "routine_name", "arguments")),)),
    "policies": Family("policy", ("schema_name", "table_name", "policy_name"), *_TABLE, spec=("command", "using_expression"), needs=(("role", ("role_name",)),)),
    "roles": Family("role", ("role_name",), spec=("login", "inherits")),
    "grants": Family("grant", ("schema_name", "table_name", "grantee", "privilege"), *_TABLE, spec=("grantable",), needs=(("role", ("grantee",)),)),
    "memberships": Family("membership", ("role_name", "member"), "role", ("role_name",), spec=("admin",), needs=(("role", ("member",)),)),
    "default_privileges": Family("default_privilege", ("schema_name", "owner", "grantee", "privilege"), *_SCHEMA, spec=("object_kind",), needs=(("role", ("owner",)), ("role", ("grantee",)))),
}


def _kind(kind: str) -> Column:
    if not kind.startswith("@"):
        return F.lit(kind)
    out, column = F, kind[1:]
    for letter, name in (CONSTRAINT_KINDS if column == "constraint_kind" else KINDS).items():
        out = out.when(F.col(column) == letter, name)
    return out.otherwise(F.raise_error(F.concat(F.lit(f"unknown {column} "), F.coalesce(column, F.lit("null")))).cast("string"))


def _dotted(columns: tuple[str, ...]) -> Column:
    return F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), ".")


def snapshot(captured: dict[str, DataFrame], target_id: Column) -> tuple[DataFrame, DataFrame]:
    """(resources, edges) of captured tables by family: target_id, id, kind, name, parent, spec; and target_id, id, dep.

    An id is kind:name. Columns of a spec that a capture does not have are left out of it, and so are nulls. An object depends on its parent
    and on what it needs; a family without a capture is not there, an unknown one is an error.
    """
    unknown = sorted(set(captured) - set(FAMILIES))
    if unknown:
        raise ValueError(f"there is no family {unknown[0]!r}")
    resources, edges = [], []
    for name, rows in captured.items():
        f = FAMILIES[name]
        own = F.concat(_kind(f.kind), F.lit(":"), _dotted(f.name))
        parent = F.concat(F.lit(f"{f.parent_kind}:"), _dotted(f.parent)) if f.parent_kind else F.lit(None).cast("string")
        held = [F.col(c) for c in f.spec if c in rows.columns]
        spec = F.to_json(F.struct(*held)) if held else F.lit("{}")
        resources.append(rows.select(target_id.alias("target_id"), own.alias("id"), _kind(f.kind).alias("kind"), _dotted(f.name).alias("name"), parent.alias("parent"), spec.alias("spec")))
        links = [parent] if f.parent_kind else []
        for kind, columns in f.needs:
            if set(columns) <= set(rows.columns):
                there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
                links.append(F.when(there, F.concat(F.lit(f"{kind}:"), _dotted(columns))))
        if links:
            edges.append(rows.select(target_id.alias("target_id"), own.alias("id"), F.explode(F.array_compact(F.array(*links))).alias("dep")))
    return reduce(DataFrame.unionByName, resources), reduce(DataFrame.unionByName, edges).distinct()
