"""Column helpers: digests, names, patterns, versions, canonical JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The scalar functions and cast targets that expressions may use.
FUNCTIONS = ("lower", "upper", "trim", "btrim", "ltrim", "rtrim", "length", "substring", "abs", "round", "coalesce")
CASTS = {
    "text": "string",
    "int2": "smallint",
    "int4": "int",
    "int8": "bigint",
    "smallint": "smallint",
    "integer": "int",
    "bigint": "bigint",
    "numeric": "decimal(38,18)",
    "bool": "boolean",
    "boolean": "boolean",
    "date": "date",
    "timestamp": "timestamp_ntz",
    "timestamptz": "timestamp",
}
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def digest(domain: str, *parts: Column) -> Column:
    """SHA-256 of a domain and parts, separated by NUL; a null part counts as empty."""
    return F.sha2(F.concat_ws("\0", F.lit(domain), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def multiset_digest(row: Column) -> Column:
    """An aggregate: SHA-256 of the number of rows and of the sums of four 60-bit lanes of their SHA-256 digests.

    Sums do not depend on order and merge from partial ones, so no group is ever gathered; repeated rows count.
    """
    lanes = [F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(28,0)")) for i in range(4)]
    return F.sha2(F.concat_ws(",", F.count("*").cast("string"), *[F.coalesce(lane.cast("string"), F.lit("0")) for lane in lanes]), 256)


def stable_id(kind: Column, catalog: Column, schema: Column, parent: Column, name: Column) -> Column:
    """kind:24 hex digits, the same wherever a resource of that name is seen."""
    parts = [F.coalesce(p, F.lit("")) for p in (kind, catalog, schema, parent, name)]
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 24))


def qualified(*parts: Column) -> Column:
    """The parts of a name that are not empty, joined by dots."""
    return F.concat_ws(".", *[F.nullif(p, F.lit("")) for p in parts])


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob: * and ? stay within one /-separated part."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + body + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def glob(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(glob_regex(pattern)), F.lit(False))


def transform(c: Column, expression: str) -> Column:
    """value, lower(value), upper(value), btrim(value) or value::type; anything else is refused."""
    forms = {"value": c, "lower(value)": F.lower(c), "upper(value)": F.upper(c), "btrim(value)": F.trim(c)}
    text = re.sub(r"\s+", "", expression.lower())
    if text in forms:
        return forms[text]
    m = re.fullmatch(r"value::(\w+)", text)
    if m and m[1] == "uuid":
        return uuid(c)
    if m and m[1] in CASTS:
        return c.cast(CASTS[m[1]])  # ANSI: a value that cannot be cast is an error, never null
    raise ValueError(f"transform {expression!r} is not allowed")


def uuid(c: Column) -> Column:
    """Lower-case UUID text; anything else is an error."""
    low = F.lower(c.cast("string"))
    return F.when(low.rlike(UUID), low).when(low.isNotNull(), F.raise_error(F.lit("not a uuid")))


def safe_call(name: str, *args: Column) -> Column:
    """An allow-listed scalar function."""
    if name not in FUNCTIONS:
        raise ValueError(f"function {name!r} is not allowed")
    named = {"btrim": F.trim, "substring": F.substr}
    return named.get(name, getattr(F, name, None))(*args)


def sanitized(c: Column) -> Column:
    """Runs of other characters than letters, digits and _ become _; nothing becomes unnamed."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{Nd}_]", "_")
    return F.when(text == "", F.lit("unnamed")).otherwise(text)


def is_digest(c: Column) -> Column:
    return F.coalesce(c.rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))


def version_key(c: Column) -> Column:
    """A struct that orders semantic versions: numbers first, prereleases before their release.

    Numeric identifiers compare as numbers and come before others; a shorter prerelease comes first.
    """
    core = F.regexp_extract(c, r"^v?(\d+)\.(\d+)\.(\d+)", 0)
    numbers = [F.regexp_extract(c, r"^v?(\d+)\.(\d+)\.(\d+)", i).cast("long") for i in (1, 2, 3)]
    pre = F.regexp_extract(c, r"^v?\d+\.\d+\.\d+-([0-9A-Za-z.-]+)", 1)
    parts = F.transform(
        F.filter(F.split(pre, r"\."), lambda x: x != ""),
        lambda x: F.struct(
            (~x.rlike("^[0-9]+$")).cast("int").alias("alpha"),
            F.when(x.rlike("^[0-9]+$"), x.cast("long")).otherwise(F.lit(0)).alias("number"),
            F.when(x.rlike("^[0-9]+$"), F.lit("")).otherwise(x).alias("text"),
        ),
    )
    return F.when(core != "", F.struct(*[n.alias(f"n{i}") for i, n in enumerate(numbers)], (pre == "").cast("int").alias("release"), parts.alias("pre")))

