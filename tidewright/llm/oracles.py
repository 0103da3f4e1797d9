"""DuckDB SQL of the vector codes and of repaired conversations, by full search and by dynamic programming over rows."""

from __future__ import annotations

_DISTANCE = "list_sum(list_transform(list_zip(p.x, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _assigned(books: str) -> str:
    return f"SELECT p.rid, p.part, min({_DISTANCE} * 64 + b.entry) AS best FROM p JOIN {books} b ON p.part = b.part GROUP BY ALL"


def _moved(books: str, assigned: str) -> str:
    """Entries as the floor of the mean of their parts, unused ones as they were."""
    means = f"""SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY j) AS e FROM
        (SELECT a.part, CAST(a.best % 64 AS BIGINT) AS entry, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM {assigned} a JOIN
            (SELECT rid, part, unnest(x) AS x, unnest(range(len(x))) AS j FROM p) c ON a.rid = c.rid AND a.part = c.part GROUP BY ALL) GROUP BY ALL"""
    return f"SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM {books} b LEFT JOIN ({means}) m ON b.part = m.part AND b.entry = m.entry"


VECTOR_CODES = f"""
WITH raw AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
             WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT rid, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS x FROM raw, (SELECT unnest(range(16)) AS part)),
b0 AS (SELECT part, rid AS entry, x AS e FROM p WHERE rid < 64),
a0 AS ({_assigned("b0")}), b1 AS ({_moved("b0", "a0")}),
a1 AS ({_assigned("b1")}), b2 AS ({_moved("b1", "a1")}),
a2 AS ({_assigned("b2")}),
c AS (SELECT rid, string_agg(lpad(to_hex(best % 64), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS books FROM b2)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, books AS codebooks_sha256 FROM raw JOIN c ON raw.rid = c.rid, h
"""


def _plus(state: str, cost: str, edit: str) -> str:
    """A state's text (ten digits of cost, then the audit) after one more edit; null for a state that cannot be."""
    return f"(lpad(CAST(CAST(substr({state}, 1, 10) AS BIGINT) + {cost} AS VARCHAR), 10, '0') || substr({state}, 11) || '{edit}')"


def _row() -> str:
    """The states [start, s, u, a] after row r from those before it, q."""
    start, s, u, a = (f"q[{i}]" for i in (1, 2, 3, 4))
    stays = "r[2] NOT IN ('b', 'd')"
    more = "(CASE WHEN r[2] = 't' THEN 3 ELSE 0 END)"
    kept = lambda state, x: f"CASE WHEN {stays} AND r[1] = '{x}' THEN {_plus(state, more, 'K')} END"
    other = lambda state: f"CASE WHEN {stays} THEN {_plus(state, more + ' + 3', 'R')} END"
    gone = lambda state: _plus(state, "4", "D")
    to_u = ", ".join(f"{kept(p, 'u')}, {other(p)}" for p in (start, s, a))
    return f"[{gone(start)}, least({gone(s)}, {kept(start, 's')}), least({gone(u)}, {to_u}), least({gone(a)}, {kept(u, 'a')}, {other(u)})]"


def _inserted(states: str) -> str:
    u = f"least(n[3], {', '.join(_plus(f'n[{i}]', '3', 'I') for i in (1, 2, 4))})"
    with_u = f"list_transform([{states}], lambda n: [n[1], n[2], {u}, n[4]])[1]"
    return f"list_transform([{with_u}], lambda n: [n[1], n[2], n[3], least(n[4], {_plus('n[3]', '3', 'I')})])[1]"


_BYTES = "list_transform(string_split(key, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
_CRC32 = f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BYTES}),
    lambda c, ch: list_reduce(list_prepend(xor(c, ch), range(8)), lambda v, i: xor(v >> 1, CAST(3988292384 AS BIGINT) * (v & 1)))), CAST(4294967295 AS BIGINT))"""
_CORE = r"regexp_replace(text, '[\x20\x09-\x0D]+$', '')"
_LAST = "CASE WHEN e[1] = 'D' THEN w[2] WHEN e[1] = 'K' THEN substr(roles[CAST(w[3] AS BIGINT)], 1, 1) WHEN w[2] = 'u' THEN 'a' ELSE 'u' END"
_LINE = """CASE WHEN e[1] = 'D' THEN '' ELSE (CASE WHEN w[4] = '1' THEN chr(10) ELSE '' END) || (CASE WHEN e[1] = 'K' THEN roles[CAST(w[3] AS BIGINT)] WHEN w[2] = 'u' THEN 'assistant' ELSE 'user' END)
    || ':' || (CASE WHEN e[1] = 'I' THEN '' ELSE texts[CAST(w[3] AS BIGINT)] END) END"""

REPAIRED = f"""
WITH r0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
r1 AS (SELECT *, {_CRC32} % 20 AS fault FROM r0),
r2 AS (SELECT *, unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy, CASE fault WHEN 4 THEN 'user' ELSE role0 END AS role,
       CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text0, '.!?', '') ELSE text0 END AS text FROM r1),
r3 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role0, md5(text0), copy) AS place FROM r2),
r4 AS (SELECT *, substr(role, 1, 1) AS x, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before,
       CASE WHEN {_CORE} = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'd' WHEN right({_CORE}, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f FROM r3),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
      count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal, list([x, f] ORDER BY place) AS rows_, list(role ORDER BY place) AS roles, list(text ORDER BY place) AS texts FROM r4 GROUP BY conv_id),
d AS (SELECT *, list_reduce(list_prepend(['0000000000', NULL, '0000000003I', '0000000006II'], rows_), lambda q, r: {_inserted(_row())}) AS states FROM g),
b AS (SELECT *, least(states[1], states[4]) AS best FROM d),
t AS (SELECT *, substr(best, 11) AS audit, list_reduce(list_prepend(['', '0', '1', '0'], list_transform(string_split(substr(best, 11), ''), lambda e: [e])),
      lambda w, e: [w[1] || {_LINE}, {_LAST}, CASE WHEN e[1] = 'I' THEN w[3] ELSE CAST(CAST(w[3] AS BIGINT) + 1 AS VARCHAR) END, CASE WHEN e[1] = 'D' THEN w[4] ELSE '1' END])[1] AS lines FROM b)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(CAST(substr(best, 1, 10) AS BIGINT), 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN t ON c.conv_id IS NOT DISTINCT FROM t.conv_id
"""
