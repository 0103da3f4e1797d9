"""A normal form of JSON texts of any depth: keys in order, numbers by value, no white space.

Variants keep the fields of an object in the order of their names and decimals without trailing
zeros; what they print otherwise, doubles, is brought to the same form token by token. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRING = r'"(?:[^"\\]++|\\.)*+"'
_NUMBER = r"-?[0-9][0-9.eE+-]*"
_TOKEN = rf'{_STRING}|{_NUMBER}|[^"0-9-]+'
#: A double as variants print it.
_DOUBLE = r"^[-0-9].*(?:E|\.0$)"
#: Numbers of up to so many digits are written out, others with an exponent.
PLAIN = 38


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def number_text(token: Column) -> Column:
    """The one text of a number's value: an integer without a point, a fraction without trailing zeros, or digits and an exponent."""
    part = lambda i: F.regexp_extract(token, r"^-?([0-9]+)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?$", i)
    zero = F.lit(0)

    def from_parts(p: Column) -> Column:
        digits = F.regexp_replace(F.concat(p["whole"], p["fraction"]), "^0+", "")
        return let(F.struct(digits.alias("digits"), F.regexp_replace(digits, "0+$", "").alias("significant"), (F.coalesce(p["exponent"].try_cast("int"), zero) - F.length(p["fraction"])).alias("shift")), from_digits)

    def from_digits(d: Column) -> Column:
        exponent = d["shift"] + F.length(d["digits"]) - F.length(d["significant"])
        return let(F.struct(d["significant"].alias("significant"), exponent.alias("exponent"), F.length(d["significant"]).alias("n")), from_value)

    def from_value(v: Column) -> Column:
        significant, exponent, n = v["significant"], v["exponent"], v["n"]
        whole = F.concat(significant, F.repeat(F.lit("0"), F.greatest(exponent, zero)))
        filled = F.concat(F.repeat(F.lit("0"), F.greatest(1 - exponent - n, zero)), significant)
        at = lambda text: F.length(text) + F.least(exponent, zero)
        fraction = let(filled, lambda text: F.concat(F.substr(text, F.lit(1), at(text)), F.lit("."), F.substr(text, at(text) + 1)))
        text = (
            F.when((exponent >= 0) & (n + exponent <= PLAIN), whole)
            .when((exponent < 0) & (F.greatest(n, -exponent) <= PLAIN), fraction)
            .otherwise(F.concat(significant, F.lit("E"), exponent.cast("string")))
        )
        return F.when(significant == "", "0").otherwise(F.concat(F.when(F.startswith(token, F.lit("-")), "-").otherwise(""), text))

    return let(F.struct(part(1).alias("whole"), part(2).alias("fraction"), part(3).alias("exponent")), from_parts)


def normal_text(text: Column) -> Column:
    """The canonical text of what a variant prints: its doubles are written anew, all else is in that form."""
    def tokens(t: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(0)), lambda x: F.when(x.rlike(_DOUBLE), number_text(x)).otherwise(x)), "")

    return let(text, lambda t: F.when(F.regexp_replace(t, _STRING, '""').rlike(r"[0-9](?:\.0|E)"), tokens(t)).otherwise(t))


def canonical(value: Column) -> Column:
    """The canonical text of a variant; null for null, the text null for a JSON null."""
    return normal_text(F.to_json(value))


def canonical_json(text: Column) -> Column:
    """The canonical text of a JSON text; null for what is no JSON, or repeats a key of an object.

    Key order, white space, escapes and the way a number is written make no difference; the order of arrays does.
    Numbers of more than 38 digits are taken as doubles.
    """
    return canonical(F.try_parse_json(text))


def canonical_or_text(text: Column) -> Column:
    """canonical_json, or for a text that is no JSON, the text itself."""
    return F.coalesce(canonical_json(text), text)


def member(document: Column, key: str) -> Column:
    """The canonical text of a member of a JSON object: strings keep their quotes, so that "1" and 1 differ; null if it is not there."""
    return canonical(F.try_variant_get(F.try_parse_json(document), f"$.{key}", "variant"))


def json_equal(a: Column, b: Column) -> Column:
    """Whether two JSON texts mean the same; texts that are no JSON are compared as they are, nulls are equal."""
    return canonical_or_text(a).eqNullSafe(canonical_or_text(b))


def json_digest(text: Column) -> Column:
    """SHA-256 of the canonical text, or of the text that is no JSON."""
    return F.sha2(canonical_or_text(text), 256)
