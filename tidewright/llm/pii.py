"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass validation (Luhn, octets, calendar, numbering rules) are permuted within
their format by an alternating Feistel network keyed by a secret, so that equal values get equal
pseudonyms in all documents, other values other ones, and a card number stays a valid card number.
Addresses and hexadecimal secrets have no number format; they give way to keyed digests of the same
shape. One regular expression finds the candidates; the text is split at them and put together
again. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import unused

#: The shapes looked for, in order of preference where they begin at the same place.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,63}",
    "secret": r"(?<![0-9A-Za-z])(?=[a-f]*[0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9A-Za-z])",
    "ip": r"(?<![0-9A-Za-z.])\d{1,3}(?:\.\d{1,3}){3}(?![0-9A-Za-z]|\.\d)",
    "date": r"(?<![0-9A-Za-z/-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?!(?!T\d)[0-9A-Za-z/]|-\d)",
    "ssn": r"(?<![0-9A-Za-z-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z]|-\d)",
    "phone": r"(?<![0-9A-Za-z])(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![0-9A-Za-z])",
}
PATTERN = "|".join(f"(?:{p})" for p in SHAPES.values())
ROUNDS = 10


def _long(c: Column) -> Column:
    return c.cast("bigint")


def _prf(key: str, tweak: Column, step: Column, value: Column) -> Column:
    """A keyed 60-bit number."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, step.cast("string"), value.cast("string")), 256)
    return _long(F.conv(F.substring(digest, 1, 15), 16, 10))


def feistel(left: Column, right: Column, m: Column, n: Column, tweak: Column, key: str) -> Column:
    """A struct (l, r): a keyed permutation of the pairs with 0 <= l < m and 0 <= r < n, one for each tweak."""
    start = F.struct(_long(left).alias("l"), _long(right).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        even = F.struct(F.pmod(s["l"] + F.pmod(_prf(key, tweak, i, s["r"]), m), m).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(_prf(key, tweak, i, s["l"]), n), n).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _pow10(n: Column) -> Column:
    return _long(F.rpad(F.lit("1"), n + 1, "0"))


def _digits_of(value: Column, n: Column) -> Column:
    return F.lpad(value.cast("string"), n, "0")


def permuted_digits(digits: Column, tweak: Column, key: str) -> Column:
    """Digits of the same length (2 to 36)."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    out = feistel(F.substr(digits, F.lit(1), a), F.substr(digits, a + 1, n - a), _pow10(a), _pow10(n - a), F.concat(tweak, n.cast("string")), key)
    return F.transform(F.array(out), lambda s: F.concat(_digits_of(s["l"], a), _digits_of(s["r"], n - a)))[0]


def _luhn_sum(digits: Column, odd_from_right: int) -> Column:
    """Luhn's sum; the digits at even (1) or odd (0) distance from the last are doubled."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == odd_from_right, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def luhn_valid(digits: Column) -> Column:
    return _luhn_sum(digits, 1) % 10 == 0


def _only_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _fill(template: Column, digits: Column) -> Column:
    """template with its digits replaced in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(digit, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + digit.cast("int")).alias("at"))

    return F.aggregate(F.split(template, ""), start, put)["out"]


def _card(m: Column, key: str) -> Column:
    """The first digit and the length stay; the check digit follows."""
    digits = _only_digits(m)
    body = F.substr(digits, F.lit(2), F.length(digits) - 2)
    new = F.concat(F.substr(digits, F.lit(1), F.lit(1)), permuted_digits(body, F.concat(F.lit("card"), F.substr(digits, F.lit(1), F.lit(1))), key))
    check = F.pmod(10 - F.pmod(_luhn_sum(new, 0), F.lit(10)), F.lit(10)).cast("string")
    return F.when(luhn_valid(digits), _fill(m, F.concat(new, check)))


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    number = lambda i: F.get(parts, F.lit(i)) * 256 + F.get(parts, F.lit(i + 1))
    out = feistel(number(0), number(2), F.lit(65536), F.lit(65536), F.lit("ip"), key)
    text = lambda s: F.concat_ws(".", *[x.cast("string") for v in (s["l"], s["r"]) for x in (F.shiftright(v, 8), F.pmod(v, F.lit(256)))])
    return F.when(F.forall(parts, lambda x: x < 256), F.transform(F.array(out), text)[0])


def _date(m: Column, key: str) -> Column:
    """A day of the same century. Day and month in a/b/yyyy are read as month/day, else as day/month."""
    iso, us, eu = (F.try_to_date(m, f) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy"))
    day = F.coalesce(iso, us, eu)
    form = F.when(iso.isNotNull(), "yyyy-MM-dd").when(us.isNotNull(), "MM/dd/yyyy").otherwise("dd/MM/yyyy")
    century = F.floor(F.year(day) / 100).cast("int")
    first = F.make_date(century * 100, F.lit(1), F.lit(1))
    at = F.datediff(day, first)
    # a century has 36524 = 92 * 397 or, if its first year is a leap year, 36525 = 75 * 487 days
    leap = century % 4 == 0
    m_, n_ = F.when(leap, 75).otherwise(92), F.when(leap, 487).otherwise(397)
    out = feistel(F.floor(at / n_), at % n_, m_, n_, F.concat(F.lit("date"), century.cast("string")), key)
    moved = F.transform(F.array(out), lambda s: F.date_add(first, (s["l"] * n_ + s["r"]).cast("int")))[0]
    text = F.when(form == "yyyy-MM-dd", F.date_format(moved, "yyyy-MM-dd")).when(form == "MM/dd/yyyy", F.date_format(moved, "MM/dd/yyyy")).otherwise(F.date_format(moved, "dd/MM/yyyy"))
    return F.when(day.isNotNull() & (F.year(day) > 0), text)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substr(m, F.lit(i), F.lit(n)).cast("int") for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas
    out = feistel(index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), F.lit("ssn"), key)

    def text(s: Column) -> Column:
        i = F.floor(s["l"] / 99)
        return F.concat_ws("-", _digits_of(F.when(i >= 665, i + 2).otherwise(i + 1), F.lit(3)), _digits_of(F.pmod(s["l"], F.lit(99)) + 1, F.lit(2)), _digits_of(s["r"] + 1, F.lit(4)))

    return F.when(valid, F.transform(F.array(out), text)[0])


def _phone(m: Column, key: str) -> Column:
    """Another number of the same kind; the shape stays.

    Area and exchange of a real number begin with 2 to 9. One that does not is taken for a phone number only if a country
    code or brackets say so. Each of the four kinds is permuted in itself.
    """
    digits = _only_digits(m)
    own = F.right(digits, F.lit(10))
    area, exchange, line = (F.substr(own, F.lit(i), F.lit(n)).cast("int") for i, n in ((1, 3), (4, 3), (7, 4)))
    low = lambda x: F.when(x < 200, 0).otherwise(200)
    count = lambda x: F.when(x < 200, 200).otherwise(800)
    real = (area >= 200) & (exchange >= 200)
    tweak = F.when(real, "phone").otherwise(F.concat_ws("/", F.lit("phone"), low(area).cast("string"), low(exchange).cast("string")))
    out = feistel((area - low(area)) * count(exchange) + exchange - low(exchange), line, count(area) * count(exchange), F.lit(10_000), tweak, key)
    three = lambda x: _digits_of(x.cast("bigint"), F.lit(3))
    text = lambda s: F.concat(three(F.floor(s["l"] / count(exchange)) + low(area)), three(F.pmod(s["l"], count(exchange)) + low(exchange)), _digits_of(s["r"], F.lit(4)))
    new = F.transform(F.array(out), text)[0]
    marked = m.startswith("+") | F.contains(m, F.lit("("))
    return F.when(real | marked, _fill(m, F.concat(F.substr(digits, F.lit(1), F.length(digits) - 10), new)))


def _email(m: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256)
    return F.concat(F.lit("u"), F.substring(digest, 1, 16), F.lit("@mail.invalid"))


def _secret(m: Column, key: str) -> Column:
    return F.substr(F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), m), 256), F.lit(1), F.length(m))


_NEW = {"email": _email, "secret": _secret, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def shape_of(match: Column) -> Column:
    """Which of the shapes a match of PATTERN has; its length and marks tell them apart."""
    mask = F.translate(match, "123456789", "000000000")
    return (
        F.when(F.contains(match, F.lit("@")), "email")
        .when(F.length(match) >= 32, "secret")
        .when(mask.isin("0000-00-00", "00/00/0000"), "date")
        .when(mask == "000-00-0000", "ssn")
        .when((F.length(F.replace(match, F.lit("."))) == F.length(match) - 3) & ~F.startswith(match, F.lit("+")), "ip")
        .when(F.length(F.replace(mask, F.lit("0"))) <= F.length(mask) - 13, "card")
        .otherwise("phone")
    )


def pseudonym(match: Column, key: str) -> Column:
    """struct (kind, new) of a match; new is null if validation fails."""
    shape, new = shape_of(match), F
    for name, make in _NEW.items():
        new = new.when(shape == name, make(match, key))
    return F.struct(shape.alias("kind"), new.alias("new"))


def pseudonymize(docs: DataFrame, key: str, text: str = "text", counts: tuple[str, str] = ("n_pii", "kinds")) -> DataFrame:
    """docs with the personal data in `text` replaced; more columns n_pii and kinds (map: kind -> count).

    Candidates that fail validation stay. Null texts stay null with no findings; other columns pass
    through, and so do repeated rows. Texts without candidates are not changed. Patterns try a bounded number of ways at each
    place (a domain has 126 labels of 63 characters at most), so a text of any length is searched in bounded stack and linear time. The two columns take
    the place of columns of these names. A text without digits and @ has no candidates and is not
    searched: each shape needs one of them.
    """
    n_pii, kinds_ = counts
    found_, changed_ = unused(docs.withColumns({n_pii: F.lit(0), kinds_: F.lit(0)}), "_found", "_changed")
    none = F.array().cast("array<string>")
    found = F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))).otherwise(none)
    pieces = F.split(F.col(text), PATTERN, -1)
    changed = F.transform(found_, lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("p")))
    valid = F.filter(changed_, lambda c: c["p"]["new"].isNotNull())
    kinds = F.array_distinct(F.transform(valid, lambda c: c["p"]["kind"]))
    per_kind = F.map_from_entries(F.transform(F.array_sort(kinds), lambda k: F.struct(k, F.size(F.filter(valid, lambda c: c["p"]["kind"] == k)))))
    middle = F.transform(changed_, lambda c: F.coalesce(c["p"]["new"], c["old"]))
    zipped = F.arrays_zip(pieces.alias("a"), F.concat(middle, F.array(F.lit(""))).alias("b"))
    whole = F.array_join(F.transform(zipped, lambda z: F.concat(F.coalesce(z["a"], F.lit("")), F.coalesce(z["b"], F.lit("")))), "")
    return (
        docs.withColumn(found_, F.coalesce(found, none))
        .withColumn(changed_, changed)
        .withColumn(n_pii, F.size(valid).cast("long"))
        .withColumn(kinds_, per_kind)
        .withColumn(text, F.when(F.col(n_pii) > 0, whole).otherwise(F.col(text)))
        .drop(found_, changed_)
    )
