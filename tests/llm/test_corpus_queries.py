"""The registered queries against SQL, the libraries and brute force on whole tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from oracle import DATA, connect, differences

import corpus_pipeline
from tidewright.llm import queries as Q
from tidewright.llm import tokencount


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    rows, ours, theirs = differences(Q.queries()[name](spark, DATA), connect(), Q.oracle_sql()[name])
    assert rows and (ours, theirs) == ([], [])


def shingles(text, k):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_op2(spark, texts):
    found = {r["doc_id"]: r for r in Q.op2_fingerprint(spark, DATA).collect()}
    order = sorted(texts)
    errors = []
    for i, d in enumerate(order):
        own, following = texts[d], texts[order[(i + 1) % len(order)]]
        q = len(own) // 4
        edited = own[: len(own) - q] + following[:q]
        r = found[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(own, 5), shingles(edited, 5)
        errors.append(r["near_edited"] - len(a & b) / max(1, len(a | b)))
        assert 0 <= r["near_next"] <= 1
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_op4(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = Q.op4_quality(spark, "/root/testdata/sf0.01").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    judged = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y, _ in judged if y], [s for s, y, _ in judged if not y]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert np.mean([y == p for _, y, p in judged]) > 0.95


def test_op5(spark, texts):
    rows = Q.op5_sharding(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]].encode()) + 1, zlib.crc32(texts[r["doc_id"]].encode())) for r in rows)
    groups = defaultdict(set)
    for r in rows:
        groups[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(g) == 1 for g in groups.values())


def simhash(text):
    w = text.encode().lower().split()
    parts = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op6(spark, texts):
    found = {r["doc_id"]: r for r in Q.op6_simhash(spark, DATA).collect()}
    fps = {d: simhash(t) for d, t in texts.items()}
    assert {d: f"{f:016x}" for d, f in fps.items()} == {d: r["fingerprint"] for d, r in found.items()}
    parent = {d: d for d in fps}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {d: find(d) for d in fps} == {d: r["component_id"] for d, r in found.items()}


@pytest.fixture(scope="module")
def ids(texts):
    tokenizer = tokencount.load(Q.tokenizer_file())
    return {d: e.ids for d, e in zip(texts, tokenizer.encode_batch(list(texts.values()), add_special_tokens=False))}


def test_op7(spark, texts, ids):
    rows = Q.op7_token_counts(spark, DATA).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows} == {d: (len(t.encode()), len(ids[d]), len(ids[d]) > 1024) for d, t in texts.items()}


def check_packing(rows, ids):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(ids)
    for d, own in pieces.items():
        whole, at = [*ids[d], 0], 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(whole))
            assert r["ids_crc32"] == zlib.crc32(np.array(whole[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(whole)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 1024
    return 1 - sum(r["length"] for r in rows) / 1024 / len(sequences)


def test_op8(spark, ids):
    assert check_packing(Q.op8_packing(spark, DATA).collect(), ids) < 0.02


def test_op10(spark, texts):
    import re

    rows = {r["doc_id"]: r for r in Q.op10_pii(spark, DATA).collect()}
    assert set(rows) == set(texts)
    for d, r in rows.items():
        if not r["n_pii"]:
            assert r["text"] == texts[d]
        # addresses, phones and secrets of the input are gone
        for pattern in (r"[\w.]+@[\w.]+", r"\+1 \(\d{3}\) 555-\d{4}", r"\b[0-9a-f]{40}\b"):
            assert not set(re.findall(pattern, texts[d])) & set(re.findall(pattern, r["text"]))


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept; the classifier's own decision is taken as given."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    outputs, columns = [docs.toPandas()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        outputs.append(docs.toPandas())
        assert name == "packing" or docs.columns == columns
    start, quality, lines, near, clean, packed = outputs
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    rejected = set(start["doc_id"]) - set(quality["doc_id"])
    assert np.mean([labels[d] == 0 for d in rejected if d in labels]) > 0.9 and rejected

    # lines
    totals = Counter(quality["source"])
    held = Counter((s, line) for s, t in zip(quality["source"], quality["text"]) for line in {x.strip(" ") for x in t.split("\n")} if line)
    boiler = {k for k, n in held.items() if n >= 2 and n > 0.1 * totals[k[0]]}
    expected = {}
    for d, s, t in zip(quality["doc_id"], quality["source"], quality["text"]):
        expected[d] = "\n".join(x for x in t.split("\n") if not x.strip(" ") or (s, x.strip(" ")) not in boiler)
    assert dict(zip(lines["doc_id"], lines["text"])) == expected

    # near copies: one document of each group of texts similar by 0.8 or more
    sets = {d: shingles(t.lower(), 5) for d, t in expected.items()}
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    roots = {d for d in sets if find(d) == d}
    assert roots <= set(near["doc_id"])
    assert len(set(near["doc_id"]) - roots) <= 0.05 * (len(sets) - len(roots))  # candidates are found with high recall

    # benchmark
    words = lambda t: "".join(ch if ch.isalnum() and ch.isascii() or ord(ch) > 127 else " " for ch in t.lower()).split()
    windows = set()
    for t in spark.read.parquet(f"{DATA}/benchmark.parquet").toPandas()["text"]:
        w = words(t)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    hit = {d for d, t in zip(near["doc_id"], near["text"]) if any(tuple(w[i : i + 10]) in windows for w in [words(t)] for i in range(len(w) - 9))}
    assert set(clean["doc_id"]) == set(near["doc_id"]) - hit and hit

    tokenizer = tokencount.load(Q.tokenizer_file())
    check_packing([r.asDict() for r in docs.collect()], {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in zip(clean["doc_id"], clean["text"])})
    assert len(packed)
