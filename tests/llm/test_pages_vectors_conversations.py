"""Main text of pages, vector codes and repaired conversations against plain versions of them."""

import hashlib
import math
import re
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest
from oracle import DATA
from pyspark.sql import functions as F

from tidewright.llm import convrepair, htmltext, vectorcode
from tidewright.llm import queries as Q

# -- pages -------------------------------------------------------------------------------------------------------------

LONG = "The mill stood by the river for as long as anyone could remember, and its wheel had not turned in years."
OTHER = "Those who came from the next valley said that the weir had been higher once, and the pond behind it deeper."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>Title</title>{head}</head><body>{body}</body></html>"


PAGES = [
    (page(f"<nav><a href=x>Home</a></nav><article><h1>Mill</h1><p>{LONG}<p>{OTHER}</article><footer>&copy; us</footer>"), f"Mill {LONG} {OTHER}"),
    (page(f"<script>var a='</p><article>';</script><main><p>a&amp;b &lt;c&gt; &#233;&nbsp;d\n\n  e<br>f</p><p>{LONG}</p></main><style>p{{}}</style>"), f"a&b <c> é d e f {LONG}"),
    (page(f"<header><h1>Site</h1><p>{OTHER}</p></header><article><header><h2>Head</h2></header><p>{LONG}</p><form><label>Name</label><input></form><div class='comments'><p>{OTHER}</p></div></article>"), f"Head {LONG}"),
    (page(f"<div id=top-nav><ul><li><a>A</a><li><a>B</a></ul></div><div id=content><h1>Mill</h1><p>{LONG}</p><p>{OTHER}</p><div class='ad banner'>{LONG}</div><p>{LONG}</p></div><div class=sidebar><p>{OTHER}</p></div><div class='site-footer'>Imprint</div>"), f"Mill {LONG} {OTHER} {LONG}"),
    (page(f"<article><p><b>bo<i>ld</b></i>er <span class=advert>buy <span>now</span></span>{LONG}<ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>"), f"bolder {LONG} one two x y"),
    (page(f"<div class='cookie-notice'><p>{OTHER} {OTHER}</p></div><article class='post'><p>{LONG}</p><aside>{OTHER}</aside><p>{OTHER}</p><section id='comments'><article class='comment'><p>{LONG}</p></article></section></article>"), f"{LONG} {OTHER}"),
    (page(f"<article><p>{LONG}</p><div role='navigation'>no</div><p hidden>no</p><p style='display: none'>no</p><noscript>no</noscript><!-- no --></article>"), LONG),
    (f"<p>{LONG}<p>{OTHER}", f"{LONG} {OTHER}"),
    ("plain text &amp; no tags", "plain text & no tags"),
    ("<nav>only a menu</nav>", ""),
    ("", ""),
    (None, ""),
    (page("<article><h1>T</h1></article>"), "T"),
    (f"<article><p>{LONG}</p><p>cut off <a href='x", f"{LONG} cut off"),
    (page(f"<form id=aspnet><article><p>{LONG}</p></article></form>"), LONG),
]


@pytest.mark.parametrize("html, text", PAGES)
def test_main_text(html, text):
    assert htmltext.main_text(html) == text


def test_references_and_cuts_anywhere(monkeypatch):
    """The piece size changes nothing."""
    for html, text in PAGES:
        for size in (1, 7, 64):
            monkeypatch.setattr(htmltext, "PIECE", size)
            assert htmltext.main_text(html) == text


@pytest.mark.parametrize("atom", ["<", "<div>", "</p>", "<b>", "&", "&#x", "<!--", "<a href='", "<p class=ad>", "x ", "<article>", "<li>", "<form>"])
def test_long_pages_end(atom):
    html = page(f"<article><p>{LONG}</p></article>") + atom * (300_000 // len(atom))
    assert LONG in htmltext.main_text(html) or atom in ("<article>",)


def test_extract_rows(spark):
    rows = [(i, f"u{i}", h) for i, (h, _) in enumerate(PAGES)] + [(0, "u0", PAGES[0][0]), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(2))
    found = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in htmltext.extract(df).collect()), key=str)
    wanted = [(i, u, PAGES[i][1] if i is not None else "") for i, u, _ in rows]
    assert found == sorted(((i, u, t, len(t)) for i, u, t in wanted), key=str)
    assert htmltext.extract(df.limit(0)).count() == 0


def test_op11_whole_table(spark):
    """The pages' articles by a plain expression over the marks these pages have."""
    import html

    rows = {r["page_id"]: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    found = Q.op11_html_extraction(spark, DATA).collect()
    assert sorted(r["page_id"] for r in found) == sorted(rows)
    for r in found:
        body = re.search(r"<article>(.*?)</article>", rows[r["page_id"]]["html"], re.S)[1]
        wanted = " ".join(html.unescape(re.sub("<[^>]*>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", body))).split())
        assert (r["url"], r["text"], r["n_chars"]) == (rows[r["page_id"]]["url"], wanted, len(wanted))


# -- vectors -----------------------------------------------------------------------------------------------------------


def plain_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    """Full search in Python's integers over rows(id, vector, label)."""
    kept = [(i, v, la) for i, v, la in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=1) // parts) * parts
    kept = [(i, v, la, [math.floor(scale * x) for x in v] + [0] * (width - len(v))) for i, v, la in kept]
    d = width // parts
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[s[3][p * d : p * d + d] for s in seeds] for p in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = defaultdict(list)
            for r in kept:
                x = r[3][p * d : p * d + d]
                own[nearest(book, x)[1]].append(x)
            books[p] = [[sum(c) // len(c) for c in zip(*own[i])] if own[i] else e for i, e in enumerate(book)]
    out, totals = [], defaultdict(int)
    for i, _, la, x in kept:
        found = [nearest(b, x[p * d : p * d + d]) for p, b in enumerate(books)]
        out.append([i, "".join(f"{e:02x}" for _, e in found), sum(s for s, _ in found), la])
        totals[la] += out[-1][2]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, c, e, totals[la], digest) for i, c, e, la in out), key=str)


def found_codes(df):
    codes, books = vectorcode.compress(df)
    digest = vectorcode.codebooks_sha256(books)
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], digest) for r in vectorcode.with_label_error(codes).collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_op12_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    found = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in Q.op12_vector_codes(spark, DATA).collect()), key=str)
    assert found == plain_codes(rows)


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(300, 32)), 2).astype(np.float32).tolist()
    rows = [(i, v, i % 3 if i % 5 else None) for i, v in enumerate(vectors)]
    rows += [(7, vectors[7], 1), (7, vectors[8], 1), (None, vectors[9], None), (400, None, 1), (401, [float("nan")] * 32, 1), (402, [None] * 32, 1), (403, [float("inf")] * 32, 1)]
    rows += [(500 + i, vectors[0], 2) for i in range(200)] + [(800, [-0.001] * 32, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("error", F.lit(1)).withColumn("code", F.lit("x")).withColumn("key", F.lit(0))
    assert found_codes(df) == plain_codes(rows)
    few = rows[:5]
    assert found_codes(spark.createDataFrame(few, SCHEMA)) == plain_codes(few)
    ragged = [*few, (1000, [1.0, 2.0], 1), (1001, [0.5] * 37, 1), (1002, [], None)]
    assert found_codes(spark.createDataFrame(ragged, SCHEMA)) == plain_codes(ragged)
    large = [*rows[:100], (2000, [3.0e9] * 32, 1), (2001, [-2.0e6] * 32, 1)]
    assert found_codes(spark.createDataFrame(large, SCHEMA)) == plain_codes(large)
    assert found_codes(df.limit(0)) == []
    assert vectorcode.compress(spark.createDataFrame([(1, [3.0e38] * 16, 1), (2, [0.0] * 16, 1)], SCHEMA), entries=1)[0].count() == 2


def test_balls_are_whole():
    rng = np.random.default_rng(5)
    for points in (rng.integers(-50, 50, (3000, 4)), np.zeros((500, 2), np.int64), rng.integers(0, 2, (700, 3)), np.arange(1, dtype=np.int64)[:, None]):
        t = vectorcode.Balls(points)
        assert sorted(t.order.tolist()) == list(range(len(points)))
        own = points[t.order]
        for i in range(len(t.lo)):
            inside = own[t.lo[i] : t.hi[i]]
            assert (t.sums[i] == inside.sum(axis=0)).all() and (t.pivots[i] == inside.sum(axis=0) // len(inside)).all()
            assert np.sqrt(((inside - t.pivots[i]) ** 2).sum(axis=1)).max() <= t.radius[i]
            if t.left[i] >= 0:
                assert (t.lo[t.left[i]], t.hi[t.left[i]], t.hi[t.right[i]]) == (t.lo[i], t.lo[t.right[i]], t.hi[i])


# -- conversations -----------------------------------------------------------------------------------------------------


def plain_repair(rows):
    """Rows of one conversation after damage, in order, by a search over suffixes."""
    initials, faults, seen = [], [], set()
    illegal = 0
    for role, text in rows:
        core = text.strip(" \t\n\v\f\r")
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        illegal += bool(initials) and initials[-1] + role[:1] not in ("su", "ua", "au")
        initials.append(role[:1])
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    # from the last row to the first: the least (cost, audit, lines) from each state
    after = {p: (0, "", ()) for p in ("", "a")}

    def with_insertions(level):
        for _ in range(3):
            for p in follows:
                for q in follows[p]:
                    if q != "s" and q in level:
                        c, a, lines = level[q]
                        new = (c + 3, "I" + a, ({"u": "user:", "a": "assistant:"}[q], lines))
                        if p not in level or new[:2] < level[p][:2]:
                            level[p] = new
        return level

    after = with_insertions(after)
    for (role, text), x, fault in reversed(list(zip(rows, initials, faults))):
        level = {}
        for p in follows:
            options = []
            if p in after:
                c, a, lines = after[p]
                options.append((c + 4, "D" + a, lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                for q in follows[p]:
                    if q in after:
                        c, a, lines = after[q]
                        if q == x:
                            options.append((c + more, "K" + a, (f"{role}:{text}", lines)))
                        if q != "s":
                            options.append((c + more + 3, "R" + a, ({"u": "user", "a": "assistant"}[q] + f":{text}", lines)))
            if options:
                level[p] = min(options, key=lambda o: o[:2])
        after = with_insertions(level)
    cost, audit, lines = after[""]
    out = []
    while lines:
        out.append(lines[0])
        lines = lines[1]
    counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    if not rows:
        cost, audit, out = 0, "", []
    return (*counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain_report(rows):
    """Of conversations(conv_id, turn, role, text), with damage."""
    by = defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        by[c].append((t is not None, t or 0, role, hashlib.md5(text.encode()).hexdigest(), text, zlib.crc32(key.encode()) % 20))
    out = []
    for c, own in by.items():
        kept, turns = [], []
        for known, t, role, _, text, fault in sorted(own):
            if fault == 0:
                continue
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            for _ in range(2 if fault == 3 else 1):
                kept.append(("user" if fault == 4 else role, text))
                turns += [t] if known else []
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *plain_repair(kept)))
    return sorted(out, key=str)


def found_report(df):
    return sorted((tuple(r) for r in convrepair.repair(convrepair.damaged(df)).report.collect()), key=str)


CONV = "conv_id long, turn long, role string, text string"


def test_op13_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in Q.op13_conversation_repair(spark, DATA).collect()), key=str) == plain_report(rows)


def odd_conversations():
    import random

    rng = random.Random(4)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "user", "assistant"], ["Yes.", "No", " \n", None, "Why? ", " ", "Yes.", "a\x0b", "So be it!"]
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(roles), rng.choice([*texts, f"Line {c}."])) for c in range(60) for _ in range(rng.randrange(1, 12))]
    rows += [(None, t, "user", "Hm.") for t in range(4)] + rows[:10]
    return rows + [(777, t, rng.choice(roles[:2]), f"Row {t % 1500}." if t % 7 else "Same") for t in range(9000)]


def test_odd_conversations(spark):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, CONV).repartition(3).withColumn("part", F.lit(1)).withColumn("n", F.lit(2)).withColumn("cells", F.lit(3))
    assert found_report(df) == plain_report(rows)
    assert found_report(df.limit(0)) == []


def test_repaired_rows_give_the_digest(spark):
    rows = odd_conversations()[:-8000]
    found = convrepair.repair(convrepair.damaged(spark.createDataFrame(rows, CONV)))
    by = defaultdict(list)
    for r in sorted(found.rows().collect(), key=lambda r: (r["part"], r["seq"], r["place"])):
        by[r["conv_id"]].append(r)
    for r in found.report.collect():
        own = by[r["conv_id"]]
        assert hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in own).encode()).hexdigest() == r["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][:1] for x in own))
        assert "".join(x["edit"] for x in own) == r["audit"].replace("D", "")


@cache
def spans_cell(text, i, j):
    """All splits of a span, as a textbook parser tries them."""
    if j - i == 1:
        return tuple(sorted(convrepair.row_cell(text[i], "").items()))
    out = {}
    for k in range(i + 1, j):
        for key, value in convrepair.joined(dict(spans_cell(text, i, k)), dict(spans_cell(text, k, j))).items():
            convrepair.least(out, key, value)
    return tuple(sorted(out.items()))


@pytest.mark.parametrize("text", ["suauua", "aaaa", "uuauas", "xsxuau", "auauau"])
def test_one_split_is_as_good_as_all(text):
    assert dict(spans_cell(text, 0, len(text))) == convrepair.parse([convrepair.row_cell(c, "") for c in text])
