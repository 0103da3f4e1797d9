"""Nulls, blanks, ties, repeated rows, long texts, empty tables and clashing names."""

import re

import numpy as np
import pytest
from conftest_documents import rows_of
from pyspark.sql import functions as F

import corpus_pipeline
from tidewright.llm import decontaminate, fingerprint, linededup, packing, pii, quality, shard, simhash, substring, tokencount
from tidewright.llm.queries import tokenizer_file

BENCHMARK = [(1, "The river ran past the old mill, and nobody in the village could say when"), (2, "no such words"), (3, None), (4, "..."), (5, "one")]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame(BENCHMARK, "item_id long, text string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i != 15), 0) for i in range(16)] + [(3, None, None), (None, 1, 0), (15, 0, 1)], LABELS)


def n_rows(docs):
    return docs.count()


OPERATORS = {
    "op1": lambda d, b, la: decontaminate.contamination(d, b),
    "op2": lambda d, b, la: fingerprint.edited_likeness(d),
    "op2_fingerprints": lambda d, b, la: fingerprint.fingerprints(d),
    "op3": lambda d, b, la: substring.remove_repeated(d),
    "op4": lambda d, b, la: quality.quality_scores(d, la),
    "op5": lambda d, b, la: shard.shard_rows(d),
    "op6": lambda d, b, la: simhash.near_duplicates(d),
    "op7": lambda d, b, la: tokencount.token_counts(d, tokenizer_file()),
    "op8": lambda d, b, la: packing.packed_pieces(d, tokenizer_file()).filter("start = 0"),
    "op9": lambda d, b, la: linededup.drop_boilerplate(d, host="source"),
    "op10": lambda d, b, la: pii.pseudonymize(d, "key"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_per_row(docs, odd, nothing, benchmark, labels, name):
    run = OPERATORS[name]
    expected = sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    assert sorted(str(r["doc_id"]) for r in run(docs, benchmark, labels).collect()) == expected
    assert sorted(str(r["doc_id"]) for r in run(odd, benchmark, labels).collect()) == expected
    assert run(nothing, benchmark, labels).count() == 0
    assert run(docs, benchmark.limit(0), labels.limit(0)).count() == len(expected)


def test_stages_on_odd_and_empty_tables(spark, odd, nothing, benchmark, labels, tmp_path):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, str(tmp_path))
            assert name == "packing" or found.columns == docs.columns
            assert found.count() <= max(docs.count(), 10_000)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_op1_values(docs, benchmark):
    found = by_id(decontaminate.contamination(docs, benchmark))
    assert (found[0]["n_hit"], found[0]["items"]) == (15, ["1"])
    assert (found[9]["n_words"], found[9]["n_hit"], found[9]["items"]) == (1, 1, ["5"])
    assert (found[6]["n_words"], found[6]["n_hit"], found[6]["items"]) == (0, 0, [])
    assert found[None]["n_hit"] == 15
    kept = {r["doc_id"] for r in decontaminate.decontaminate(docs, benchmark).collect()}
    assert {0, 1, 2, 3, 9, 10}.isdisjoint(kept) and {4, 6, 7, 8} <= kept


def test_op1_beyond_the_bound_in_place(docs, benchmark, monkeypatch):
    rows = sorted(map(str, decontaminate.contamination(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "MAX_IN_PLACE", 3)
    monkeypatch.setattr(decontaminate, "SLOTS", 1 << 16)
    assert sorted(map(str, decontaminate.contamination(docs, benchmark).collect())) == rows


def test_op2_sketches():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 5000, 6000)]
    a, b = " ".join(words[:4000]).encode(), " ".join(words[1000:5000]).encode()
    sa, sb = fingerprint.sketches([a, b])
    true = lambda x, y: len(x & y) / len(x | y)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b)]
    assert abs(fingerprint.resemblance(sa, sb) - true(*sets)) < 0.13
    assert abs(fingerprint.containment(sa, sb) - len(sets[0] & sets[1]) / len(sets[0])) < 0.2
    assert abs(fingerprint.distinct_shingles(sa) / len(sets[0]) - 1) < 0.3
    both = fingerprint.merge(sa, sb)
    assert (both == np.union1d(*[np.unique(x) for x in (sa, sb)])[: fingerprint.K]).all()
    assert (fingerprint.decode(fingerprint.encode(sa)) == sa).all()
    empty, one = fingerprint.sketches([b"", b"one"])
    assert len(empty) == 0 and len(one) == 1 and fingerprint.resemblance(empty, empty) == 1.0 and fingerprint.resemblance(empty, one) == 0.0


def test_op2_single_row_is_its_own_next(spark):
    r = fingerprint.edited_likeness(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert (r["n_chars"], r["near_next"]) == (8, 1.0)


def test_op3_values(docs):
    rows = rows_of(docs, substring.remove_repeated(docs))
    assert all(r["n_removed"] == 0 for r in rows[0]) and all(r["n_removed"] == r["n_words"] for r in rows[1])
    near = rows[2][0]
    assert 0 < near["n_removed"] < near["n_words"] and "weir" in near["kept"].split()
    assert rows[3][0]["kept"] == "Menu"
    assert rows[None][0]["n_removed"] == 0  # a null id is neither earlier nor later


def test_op3_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 30, 400)]
    rows = []
    for i in range(60):
        a = int(rng.integers(0, 380))
        own = [f"x{i}_{j}" for j in range(int(rng.integers(0, 20)))]
        rows.append((int(i * 7 % 60), " ".join(own + base[a : a + int(rng.integers(5, 60))] + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = {}
    for d, t in sorted(rows):
        w = t.split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    for r in substring.remove_repeated(docs).collect():
        w = dict(rows)[r["doc_id"]].split()
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < r["doc_id"] for j in range(i, i + 13)}
        assert r["kept"] == " ".join(x for j, x in enumerate(w) if j not in gone)


def test_op4_needs_no_labels(docs, labels):
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert (np.diff(y) > 0).all() and y.tolist() == [0.0, 0.5, 1.0] and x.tolist() == [1.0, 2.5, 4.0]


def test_op5_splits_only_groups_that_do_not_fit(spark):
    rows = [(i, "same" if i < 300 else f"pair {i // 2}") for i in range(900)]
    found = shard.shard_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes, places = {}, {}
    for r in found:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + 1
        places.setdefault(dict(rows)[r["doc_id"]], set()).add(r["shard"])
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(found) == 900
    big = places.pop("same")
    assert len(big) <= 7  # of 16; 300 rows need 6 shards
    assert np.mean([len(p) == 1 for p in places.values()]) > 0.6  # every row is linked and no shard has room to spare
    spare = shard.shard_rows(spark.createDataFrame([*rows, *((i, f"single {i}") for i in range(900, 1500))], "doc_id long, text string")).collect()
    pairs = {}
    for r in spare:
        if 300 <= r["doc_id"] < 900:
            pairs.setdefault(r["doc_id"] // 2, set()).add(r["shard"])
    assert all(len(p) == 1 for p in pairs.values())


@pytest.mark.parametrize("group_rows", [2048, 8])
def test_op6_trie_links_all(spark, monkeypatch, group_rows):
    monkeypatch.setattr(simhash, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(simhash, "LEAF_PAIRS", 4)
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(s) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False)) for s in seeds for _ in range(12)}
    rows = [(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps]
    roots = simhash.components(simhash.near_links(spark.createDataFrame(rows, "fp long"), 4)).collect()
    found = {r["node"]: r["root"] for r in roots}
    parent = {f: f for (f,) in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a,) in rows:
        for (b,) in rows:
            if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {f: find(f) for (f,) in rows} == {f: found.get(f, f) for (f,) in rows}


def test_op6_keeps_one_of_each_group(docs):
    kept = [r["doc_id"] for r in simhash.one_of_each_group(docs).collect()]
    assert len(kept) == len(set(kept))
    assert {4, 5, 9, 11, 12, 14, 15} <= set(kept) and not {0, 1} <= set(kept)


def test_op7_all_settled_characters_split_as_in_the_library():
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for code in range(0x2100):
        ch = chr(code)
        if tokencount._SETTLED.fullmatch(ch):
            s = f"a{ch}1 {ch}. {ch} {ch}{ch}b\n{ch}'s  {ch}"
            assert tokencount._SETTLED_PATTERN.findall(s) == [s[i:j] for _, (i, j) in split(s)], hex(code)


def test_op7_odd_texts(docs):
    tokenizer = tokencount.load(tokenizer_file())
    for r in tokencount.token_counts(docs, tokenizer_file()).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r["n_tokens"] == len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)


def test_op7_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokencount, "MEMORY", 50)
    encoder = tokencount.Encoder(tokenizer_file(), tokencount.whole_tokens(tokenizer_file()))
    texts = [" ".join(f"zq{i % 7}vw{'abcdefghij'[i % 10]}x{'klmnopqrst'[i // 10 % 10]}" for i in range(k, k + 30)) for k in range(0, 3000, 20)]
    expected = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    found = [np.frombuffer(x, "<u4").tolist() for t in texts for x in encoder.ids([t])]
    assert found == expected and len(encoder.known) < len(encoder.whole) + 50 + 100


def test_op8_windows():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 400, 3000):
        sizes = [int(x) for x in rng.integers(1, 1025, n)]
        windows = packing.pack(sizes)
        assert sorted(i for w in windows for i in w) == list(range(n))
        assert all(sum(sizes[i] for i in w) <= 1024 for w in windows)
        # the count rises just while a window is too full: the least count that holds is not passed by far
        assert len(windows) <= sum(sizes) / 1024 * 1.05 + 2
    for sizes, k, best in (([5, 4, 3, 3, 3], 2, ([8, 10], [9, 9])), ([8, 7, 6, 5, 4], 3, ([8, 11, 11], [9, 10, 11])), ([1], 3, ([1],)), ([], 2, ([],))):
        windows = packing.differencing(sizes, k)
        assert sorted(i for _, w in windows for i in w) == list(range(len(sizes)))
        assert [s for s, _ in windows] == sorted(sum(sizes[i] for i in w) for _, w in windows) and [s for s, _ in windows] in best


def test_op8_merges_as_a_plain_version_does():
    """The lists of differencing against dense partitions of k windows."""
    rng = np.random.default_rng(5)

    def plain(sizes, k):
        parts = [([0] * (k - 1) + [s], i) for i, s in enumerate(sizes)]
        serial = len(sizes)
        while len(parts) > 1:
            parts.sort(key=lambda p: (p[0][0] - p[0][-1], p[1]))
            (a, _), (b, _) = parts[:2]
            parts[:2] = [(sorted(x + y for x, y in zip(a, reversed(b))), serial)]
            serial += 1
        return [s for s in parts[0][0] if s]

    for n, k in ((2, 2), (7, 3), (20, 4), (60, 25), (90, 11)):
        sizes = [int(x) for x in rng.integers(1, 1000, n)]
        assert [s for s, _ in packing.differencing(sizes, k)] == plain(sizes, k)


def test_op8_no_document_that_fits_is_cut(docs):
    """Short documents are whole, whatever the number of windows; long ones are full windows and pieces of the rest."""
    for r in packing.packed_pieces(docs, tokenizer_file()).collect():
        assert r["length"] in (r["doc_tokens"], 1024) or r["doc_tokens"] > 1024 and r["length"] <= packing.PIECE
    for total in (1, 5, 1023, 1024, 1025, 2047, 2048, 3000):
        found = packing.spans(total)
        assert [a for a, _ in found] == np.cumsum([0, *[n for _, n in found]])[:-1].tolist() and sum(n for _, n in found) == total
        assert len(found) == 1 or total > 1024


def test_op8_ids_are_the_library_s(spark):
    """Every vocabulary string, alone and in pairs, and texts of odd characters."""
    path = tokenizer_file()
    whole = tokencount.whole_tokens(path)
    ids_of, library = tokencount.text_ids(path, whole), tokencount.load(path)
    words = sorted(whole)
    rng = np.random.default_rng(3)
    pairs = ["".join(words[i] for i in rng.integers(0, len(words), 3)) for _ in range(20_000)]
    odd = ["", " ", "\u00a0x\u2003y", "<|endoftext|>", "a<|endoftext|> b", "日本語 text", "naïve café", "x" * 5000, " " * 5000 + "y", "\t\n \n\nA'S 's", "١٢٣", "e\u0301"]
    for texts in (words, pairs, odd):
        assert ids_of(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_op8_merge_order_is_the_files(tmp_path):
    """By ascending id, each longer string comes from the pair that the file merges."""
    import json

    path = tokenizer_file()
    ranks, spec = tokencount.byte_ranks(path), json.load(open(path))
    by_id = {v: k for k, v in ranks.items()}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    vocabulary = spec["model"]["vocab"]
    for a, b in pairs:
        whole = by_id[vocabulary[a + b]]
        parts = [bytes([x]) for x in whole]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert parts == [by_id[vocabulary[a]], by_id[vocabulary[b]]]
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "other.json").write_text(json.dumps(spec))
    assert tokencount.byte_ranks(str(tmp_path / "other.json")) is None


def test_op8_pieces_cover_all(docs):
    rows = packing.packed_pieces(docs, tokenizer_file()).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 6) == 1
    assert sum(r["length"] for r in rows if r["doc_id"] == 11) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 11)


def test_op9_drops_by_the_ratio_alone(spark):
    rows = [(i, "h", "menu\nfoot\n") for i in range(5)] + [(i, "h", f"menu\n\ntext {i}") for i in range(5, 10)] + [(10, None, None), (11, "small", "menu\nonce"), (12, "small", "menu"), (13, "one", "menu")]
    found = by_id(linededup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, host string, text string")))
    assert (found[0]["text"], found[0]["n_dropped"]) == ("", 2)
    assert (found[7]["text"], found[7]["n_dropped"]) == ("\ntext 7", 1) and found[10]["text"] is None
    assert (found[11]["text"], found[12]["text"], found[13]["text"]) == ("once", "", "menu")


def test_op10_formats(docs):
    found = rows_of(docs, pii.pseudonymize(docs, "key"))
    text = found[11][0]["text"]
    m = re.fullmatch(r"Call \+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{4} \d{4} \d{4} \d{4}), born (19\d\d-\d\d-\d\d), from (\d+\.\d+\.\d+\.\d+) by (\S+@\S+)", text)
    assert m and found[11][0]["n_pii"] == 5 and found[11][1]["text"] == text
    card = m[4].replace(" ", "")
    assert card != "4111111111111111" and card[0] == "4"
    assert sum(int(c) if i % 2 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(card)) % 10 == 0
    assert found[12][0]["text"] == f"4111111111111112 is no card and 1987-13-45 no date; again {m[4]}"
    other = rows_of(docs, pii.pseudonymize(docs, "other key"))
    assert other[11][0]["text"] != text and found[6][0]["text"] is None


@pytest.mark.parametrize("atom", ["a.", "a-", "x@", "@", "1 ", "1-", "1.", "1", "a", "1/", "(1", "a@b.", "1234 ", "10.", "f1"])
def test_op10_long_runs_end(spark, atom):
    """Texts of a megabyte of one thing, each after something that begins a match."""
    texts = [head + atom * (1_000_000 // len(atom)) for head in ("", "x@", "a@b.c", "10.1.")]
    rows = pii.pseudonymize(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "key").collect()
    assert len(rows) == 4 and all(r["text"] == texts[r["doc_id"]] for r in rows if not r["n_pii"])


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))


def plain_pseudonym(kind, m, key):
    """What a match becomes, in Python's integers; None if it is not valid."""
    import datetime
    import hashlib

    sha = lambda *parts: hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()

    def feistel(left, right, m, n, tweak):
        for i in range(pii.ROUNDS):
            if i % 2 == 0:
                left = (left + int(sha(key, tweak, i, right)[:15], 16)) % m
            else:
                right = (right + int(sha(key, tweak, i, left)[:15], 16)) % n
        return left, right

    digits = re.sub(r"\D", "", m)
    fill = lambda new: re.sub(r"\d", lambda _, it=iter(new): next(it), m)
    if kind == "email":
        return f"u{sha(key, 'email', m.lower())[:16]}@mail.invalid"
    if kind == "secret":
        return sha(key, "secret", m)[: len(m)]
    if kind == "ip":
        a = [int(x) for x in m.split(".")]
        if max(a) > 255:
            return None
        x, y = feistel(a[0] * 256 + a[1], a[2] * 256 + a[3], 65536, 65536, "ip")
        return f"{x >> 8}.{x & 255}.{y >> 8}.{y & 255}"
    if kind == "date":
        for form in ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y"):
            try:
                day = datetime.datetime.strptime(m, form).date()
                break
            except ValueError:
                continue
        else:
            return None
        century = day.year // 100
        first = datetime.date(century * 100, 1, 1)
        mm, nn = (75, 487) if century % 4 == 0 else (92, 397)
        x, y = feistel((day - first).days // nn, (day - first).days % nn, mm, nn, f"date{century}")
        moved = first + datetime.timedelta(x * nn + y)
        return f"{moved.year:04}-{moved.month:02}-{moved.day:02}" if "-" in m else (f"{moved.month:02}/{moved.day:02}/{moved.year:04}" if form == "%m/%d/%Y" else f"{moved.day:02}/{moved.month:02}/{moved.year:04}")
    if kind == "ssn":
        area, group, serial = int(m[:3]), int(m[4:6]), int(m[7:])
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        x, y = feistel((area - 2 if area > 666 else area - 1) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
        i = x // 99
        return f"{i + 2 if i >= 665 else i + 1:03}-{x % 99 + 1:02}-{y + 1:04}"
    if kind == "phone":
        own = digits[-10:]
        area, exchange = int(own[:3]), int(own[3:6])
        if (area < 200 or exchange < 200) and "(" not in m and not m.startswith("+"):
            return None
        (a0, an), (e0, en) = ((0, 200) if x < 200 else (200, 800) for x in (area, exchange))
        x, y = feistel((area - a0) * en + exchange - e0, int(own[6:]), an * en, 10_000, "phone" if a0 and e0 else f"phone/{a0}/{e0}")
        return fill(f"{digits[:-10]}{x // en + a0:03}{x % en + e0:03}{y:04}")
    if luhn(digits) % 10:
        return None
    body, n = digits[1:-1], len(digits) - 2
    a = n // 2
    x, y = feistel(int(body[:a]), int(body[a:]), 10**a, 10 ** (n - a), f"card{digits[0]}{n}")
    new = f"{digits[0]}{x:0{a}}{y:0{n - a}}"
    return fill(new + str(-luhn(new + "0") % 10))


def plain_pii(text, key):
    import regex

    kinds, out, at = {}, [], 0
    for m in regex.finditer("|".join(f"(?P<{k}>{p})" for k, p in pii.SHAPES.items()).replace(r"\1", r"(?P=g1)").replace(r"\2", r"(?P=g2)").replace("([ -])\\d{4}(?P=g1)", "(?P<g1>[ -])\\d{4}(?P=g1)").replace("([ -])\\d{6}(?P=g2)", "(?P<g2>[ -])\\d{6}(?P=g2)"), text, regex.ASCII):
        kind = next(k for k in pii.SHAPES if m.group(k) is not None)
        new = plain_pseudonym(kind, m.group(0), key)
        if new is not None:
            kinds[kind] = kinds.get(kind, 0) + 1
        out += [text[at : m.start()], m.group(0) if new is None else new]
        at = m.end()
    return "".join(out) + text[at:], kinds


def test_op10_brute_force(spark):
    rng = np.random.default_rng(11)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    card = lambda n: (lambda d: d + str(-luhn(d + "0") % 10))(str(rng.integers(1, 10)) + digits(n - 2))
    texts = [
        "at 2024-01-15T10:00:00Z, 2024-01-15Tea, 2024-01-15, 02/29/2000, 31/12/1999, 02/30/2000, 1900-02-29, 2024-01-155, 0000-01-01",
        "mail a.b+c@d-e.example.co.uk, x@y.com-z, x@y.z9.com. x@-.aa <q@w.museum> @a.bc a@b a@b.c1",
        "+1 (743) 555-3824, (143) 555-3824, 743-155-3824, 743.555 3824, +1.743-555-3824, 555-12-3456, 000-12-3456, 666-12-3456, 900-12-3456, 123-45-6789",
        "1.2.3.4 256.1.1.1 1.2.3.4.5 01.02.03.004 v1.2.3.4",
        f"{'ab12' * 8} {'a' * 40} {'0f' * 32} {'ab12' * 9}",
    ]
    for _ in range(60):
        c = card(16)
        texts.append(f"{card(13)} {card(19)} {c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]} {c[:4]} {c[4:8]} {c[8:12]} {c[12:]} {digits(16)} {rng.integers(1, 300)}.{rng.integers(0, 256)}.1.9 {digits(3)}-{digits(2)}-{digits(4)} ({digits(3)}) {digits(3)}-{digits(4)} {digits(4)}-{digits(2)}-{digits(2)} {digits(2)}/{digits(2)}/{digits(4)}")
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: (r["text"], r["kinds"], r["n_pii"]) for r in pii.pseudonymize(df, "key").collect()}
    for i, t in enumerate(texts):
        text, kinds = plain_pii(t, "key")
        assert found[i] == (text, kinds, sum(kinds.values())), t[:300]
    assert {k for t in texts for k in plain_pii(t, "key")[1]} == set(pii.SHAPES)


def test_op10_is_a_permutation(spark):
    df = spark.range(100).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("d"))
    assert df.select(pii.permuted_digits(F.col("d"), F.lit("t"), "key").alias("p")).distinct().count() == 100
    days = spark.range(36524).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    moved = days.select(pii._date(F.col("d"), "key").alias("p"))
    assert moved.distinct().count() == 36524 and moved.filter("p < '1900-01-01' or p > '1999-12-31'").count() == 0


def test_op1_decides_by_row(spark, benchmark):
    """Rows with a null doc_id are judged as others are, and rows that share a doc_id each by their own text."""
    hit, clean = BENCHMARK[0][1], "words that no item has at all"
    rows = [(None, hit), (None, clean), (1, hit), (1, clean), (2, None), (3, ""), (4, clean), (4, clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = decontaminate.decontaminate(docs, benchmark).collect()
    assert sorted(kept, key=str) == sorted([r for r in map(tuple, rows) if r[1] != hit], key=str)


def test_op6_blocks_grow_with_the_table(spark, monkeypatch):
    assert [simhash.blocks_for(n, 4) for n in (0, 10**6, 10**8, 10**11)] == [(5, 1), (5, 1), (6, 2), (7, 3)]
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 62, 40)
    rows = [int(b) ^ sum(1 << int(i) for i in rng.choice(60, int(rng.integers(0, 5)), replace=False)) for b in base for _ in range(6)]
    rows = sorted(set(rows))
    df = spark.createDataFrame([(r,) for r in rows], "fp long")
    expected = sorted(str(r) for r in simhash.components(simhash.near_links(df, 4)).collect())
    monkeypatch.setattr(simhash, "GROUP_ROWS", 4)
    for blocks, exact in ((5, 1), (6, 2), (7, 3)):
        assert sorted(str(r) for r in simhash.components(simhash.near_links(df, 4, blocks, exact)).collect()) == expected


def test_op2_sketches_merge_over_parts(spark):
    """DataFrame merges and estimates against numpy over whole texts."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(vocabulary[i] for i in rng.integers(0, 300, n)) for n in (0, 3, 40, 400, 400, 900, 900, 1500)]
    rows = [(i, t, "abc"[i % 3]) for i, t in enumerate(texts)] + [(99, None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    sketched = fingerprint.fingerprints(docs).join(docs.select("doc_id", "part"), "doc_id")
    found = {r["part"]: [h + (1 << 63) for h in r["hashes"]] for r in fingerprint.merged_sketches(sketched, ["part"]).collect()}
    expected = {}
    for _, t, part in rows:
        expected[part] = fingerprint.merge(expected.get(part, np.zeros(0, np.uint64)), fingerprint.sketches([(t or "").encode()])[0])
    assert found == {k: v.tolist() for k, v in expected.items()}
    merged = fingerprint.merged_sketches(sketched, ["part"])
    pairs = merged.select(F.col("part").alias("x"), F.col("hashes").alias("a")).join(merged.select(F.col("part").alias("y"), F.col("hashes").alias("b")), F.lit(True))
    for r in fingerprint.estimates(pairs, "a", "b").collect():
        a, b = expected[r["x"]], expected[r["y"]]
        assert r["resemblance"] == pytest.approx(fingerprint.resemblance(a, b))
        assert r["containment"] == pytest.approx(fingerprint.containment(a, b))
        assert r["distinct_a"] == pytest.approx(fingerprint.distinct_shingles(a))


def test_op2_near_next_brute_force(spark):
    """near_next and near_edited by exact shingle sets, where sketches hold all shingles."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 6, n)) for n in rng.integers(0, 60, 30)]
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)

    def likeness(x, y):
        a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (x.split(), y.split()))
        return len(a & b) / len(a | b) if a | b else 1.0

    for r in fingerprint.edited_likeness(docs).collect():
        t, other = texts[r["doc_id"] // 3], texts[(r["doc_id"] // 3 + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 4] + other[: len(t) // 4]
        assert r["near_next"] == pytest.approx(likeness(t, other)) and r["near_edited"] == pytest.approx(likeness(t, edited))


def test_op4_against_numpy(spark):
    """The fit on partition sums against one numpy fit over all rows."""
    import zlib

    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["lorem", "ipsum", "dolor", "!!", "$$$", "A1"], int(rng.integers(1, 80)))) for _ in range(400)]
    truth = [int(t.count("$$$") * 5 < len(t.split())) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, q) for i, q in enumerate(truth)], "doc_id long, quality int")
    found = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels).collect()}

    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    x = quality.statistics(np.frombuffer("".join(texts).encode(), np.uint8), offsets)
    y, apart = np.array(truth, float), np.array([zlib.crc32(f"apart {i}".encode()) % 4 == 0 for i in range(400)])
    known = np.zeros(400, bool)
    known[ids] = True
    mean, scale = x[known].mean(0), x[known].std(0) + quality.LEAST_SCALE
    r = np.random.default_rng(quality.SEED)
    k, m = x.shape[1], quality.FEATURES
    w, b = r.normal(size=(k, m)) / (quality.WIDTH * np.sqrt(k)), r.uniform(0, 2 * np.pi, m)
    z = np.column_stack([np.sqrt(2 / m) * np.cos(np.clip((x - mean) / scale, -quality.CLIP, quality.CLIP) @ w + b), np.ones(400)])
    fit = z[known & ~apart]
    beta = np.linalg.solve(fit.T @ fit + quality.RIDGE * known.sum() * np.eye(m + 1) / (m + 1), fit.T @ y[known & ~apart])
    raw, rest = z @ beta, known & apart
    at = np.clip((raw[rest] + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1).astype(int)
    n, s, c = (np.bincount(at, v, quality.BINS) for v in (np.ones(rest.sum()), y[rest], raw[rest]))
    steps = quality.isotonic(c[n > 0] / n[n > 0], s[n > 0] / n[n > 0], n[n > 0])
    expected = np.clip(np.interp(raw, *steps), 0, 1)
    assert [found[i] for i in range(400)] == pytest.approx(expected.tolist(), abs=1e-6)
