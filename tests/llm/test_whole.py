"""Operators of the pipeline do the whole job, not what a cut leaves of it."""

from itertools import combinations

import numpy as np

from tidewright.llm import simhash
from tidewright.llm.common import mix


def family(copies, words=404, edits=8, seed=1):
    """An original and copies of a Jaccard index of about 0.82 with it, and of 0.68 with one another."""
    rng = np.random.default_rng(seed)
    original = [f"w{x}" for x in rng.integers(0, 1 << 40, words)]
    texts = [" ".join(original)]
    for i in range(copies):
        text = list(original)
        for at in rng.choice(np.arange(5, words - 5, 5), edits, replace=False):
            text[at] = f"c{i}x{at}"
        texts.append(" ".join(text))
    return texts


def groups_of_candidates(texts, max_bits=14, blocks=12, exact=2, max_total=28):
    """The number of groups when every candidate pair is verified."""
    sets = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    halves = [np.array([simhash.majority(f(h)) for h in sets], np.uint64) for f in (lambda h: h, mix)]
    bounds = np.linspace(0, 64, blocks + 1).astype(int).tolist()
    masks = [np.uint64(((1 << z) - 1) ^ ((1 << a) - 1)) for a, z in zip(bounds, bounds[1:])]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        apart = [h[i] ^ h[i + 1 :] for h in halves]
        bits = [np.bitwise_count(x).astype(int) for x in apart]
        near = sum(bits) <= max_total
        near &= np.any([(b <= max_bits) & (sum(((x & m) == 0).astype(int) for m in masks) >= exact) for x, b in zip(apart, bits)], axis=0)
        for j in (np.flatnonzero(near) + i + 1).tolist():
            a, b = find(i), find(j)
            if a != b:
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
                    root[max(a, b)] = min(a, b)
    return sum(r == i for i, r in enumerate(root))


def test_near_dedup_verifies_candidates_behind_failed_ones(spark):
    texts = family(300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert simhash.one_of_each_group(docs).count() == groups_of_candidates(texts)


def test_near_dedup_goes_on_until_no_candidate_is_left(spark, monkeypatch):
    texts = family(150, seed=2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(simhash, "ROUNDS", (1, None))
    assert simhash.one_of_each_group(docs).count() == groups_of_candidates(texts)


def test_nearest_links_are_those_of_either_end():
    links = np.array(list(combinations(range(5), 2)))
    distance = np.arange(len(links))[::-1]
    for most in (1, 2, 9):
        ranked = [sorted(np.flatnonzero((links == x).any(1)), key=lambda i: distance[i])[:most] for x in range(5)]
        assert np.flatnonzero(simhash.nearest_links(links, distance, most)).tolist() == sorted(set().union(*ranked))
