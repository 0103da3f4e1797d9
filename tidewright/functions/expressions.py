"""Scalar expressions as data: trees of an allow-list, compiled to columns with checked types.

A tree is JSON: {"column": "a"}, {"value": 5}, {"call": "lower", "args": [...]}, {"cast": tree, "to": "int8"},
{"case": [{"when": tree, "then": tree}, ...], "else": tree}, {"is_null": tree}, {"not": tree}, {"and": [...]}, {"or": [...]},
or an operator with two trees, {"+": [a, b]}. Everything else is refused, before any plan is made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.scalars import CASTS, safe_call, uuid

#: Operators, and the families of types that casts lead to.
ARITHMETIC, COMPARISONS = ("+", "-", "*", "/"), ("=", "<>", "<", "<=", ">", ">=")
FAMILIES = {"string": "text", "boolean": "truth", "date": "date", "timestamp": "time", "timestamp_ntz": "time"} | dict.fromkeys(("tinyint", "smallint", "int", "bigint", "float", "double"), "number")
#: What the functions take and give; ... stands for any number of the last one.
SIGNATURES = {
    "lower": (("text",), "text"), "upper": (("text",), "text"), "trim": (("text",), "text"), "btrim": (("text",), "text"), "ltrim": (("text",), "text"), "rtrim": (("text",), "text"),
    "length": (("text",), "number"), "substring": (("text", "number", "number"), "text"), "abs": (("number",), "number"), "round": (("number",), "number"),
}


class Refused(ValueError):
    """An expression that is not allowed."""


@dataclass(frozen=True)
class Typed:
    """A column and the family of its values: text, number, truth, date, time or, for a bare null, null."""

    column: Column
    family: str


def family(kind: str) -> str:
    """The family of a Spark type's name."""
    if kind.startswith("decimal"):
        return "number"
    if kind not in FAMILIES:
        raise Refused(f"columns of type {kind} are not allowed")
    return FAMILIES[kind]


def _same(families: list[str]) -> str:
    known = sorted(set(families) - {"null"})
    if len(known) > 1:
        raise Refused(f"{' and '.join(known)} do not go together")
    return known[0] if known else "null"


def _want(found: Typed, wanted: str, where: str) -> Column:
    if found.family not in (wanted, "null"):
        raise Refused(f"{where} takes {wanted}, not {found.family}")
    return found.column


def typed(tree, columns: dict[str, str]) -> Typed:
    """The column and family of a tree over columns (name -> Spark type)."""
    if not isinstance(tree, dict):
        raise Refused(f"{tree!r} is no expression")
    keys = set(tree)
    sub = lambda t: typed(t, columns)
    if keys == {"column"}:
        name = tree["column"]
        if name not in columns:
            raise Refused(f"there is no column {name!r}")
        return Typed(F.col(f"`{name}`"), family(columns[name]))
    if keys == {"value"}:
        value = tree["value"]
        kinds = {bool: "truth", int: "number", float: "number", str: "text", type(None): "null"}
        if type(value) not in kinds:
            raise Refused(f"{value!r} is no scalar")
        return Typed(F.lit(value), kinds[type(value)])
    if keys == {"call", "args"}:
        return _call(tree["call"], [sub(a) for a in tree["args"]])
    if keys == {"cast", "to"}:
        if tree["to"] == "uuid":
            return Typed(uuid(sub(tree["cast"]).column), "text")
        if tree["to"] not in CASTS:
            raise Refused(f"a cast to {tree['to']!r} is not allowed")
        return Typed(sub(tree["cast"]).column.cast(CASTS[tree["to"]]), family(CASTS[tree["to"]]))
    if keys in ({"case"}, {"case", "else"}) and tree["case"] and all(isinstance(b, dict) and set(b) == {"when", "then"} for b in tree["case"]):
        branches = [(_want(sub(b["when"]), "truth", "when"), sub(b["then"])) for b in tree["case"]]
        last = sub(tree.get("else", {"value": None}))
        out = F
        for when, then in branches:
            out = out.when(when, then.column)
        return Typed(out.otherwise(last.column), _same([then.family for _, then in branches] + [last.family]))
    if keys == {"is_null"}:
        return Typed(sub(tree["is_null"]).column.isNull(), "truth")
    if keys == {"not"}:
        return Typed(~_want(sub(tree["not"]), "truth", "not"), "truth")
    if len(keys) == 1:
        return _operator(next(iter(keys)), next(iter(tree.values())), sub)
    raise Refused(f"{sorted(keys)} are no expression")


def _call(name: str, args: list[Typed]) -> Typed:
    if name == "coalesce":
        if not args:
            raise Refused("coalesce takes at least one argument")
        return Typed(F.coalesce(*[a.column for a in args]), _same([a.family for a in args]))
    if name not in SIGNATURES:
        raise Refused(f"function {name!r} is not allowed")
    takes, gives = SIGNATURES[name]
    if len(args) != len(takes):
        raise Refused(f"{name} takes {len(takes)} arguments, not {len(args)}")
    return Typed(safe_call(name, *[_want(a, t, name) for a, t in zip(args, takes)]), gives)


def _operator(name: str, operands, sub) -> Typed:
    if not isinstance(operands, list):
        raise Refused(f"{name!r} is no expression")
    if name in ("and", "or"):
        if len(operands) < 2:
            raise Refused(f"{name} takes at least two operands")
        first, *rest = [_want(sub(o), "truth", name) for o in operands]
        for o in rest:
            first = first & o if name == "and" else first | o
        return Typed(first, "truth")
    if name not in (*ARITHMETIC, *COMPARISONS, "||"):
        raise Refused(f"{name!r} is no expression")
    if len(operands) != 2:
        raise Refused(f"{name} takes two operands")
    a, b = (sub(o) for o in operands)
    if name == "||":
        return Typed(F.concat(_want(a, "text", name), _want(b, "text", name)), "text")
    if name in COMPARISONS:
        _same([a.family, b.family])
        left, right = a.column, b.column
        made = {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}
        return Typed(made[name], "truth")
    left, right = _want(a, "number", name), _want(b, "number", name)
    return Typed({"+": left + right, "-": left - right, "*": left * right, "/": left / right}[name], "number")


def expression(tree, columns: dict[str, str]) -> Column:
    """The column of a tree over columns (name -> Spark type, as in DataFrame.dtypes); Refused if anything in it is not allowed."""
    return typed(tree, columns).column
