"""Word hashes, and what rests on them: no text is taken for another."""

import numpy as np
import pytest
import xxhash
from conftest_documents import rows_of

from tidewright.llm import fingerprint, substring
from tidewright.llm.common import mix, shingles, word_hashes


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def hashed(*texts, seed=0):
    parts = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return word_hashes(np.frombuffer(b"".join(parts), np.uint8), offsets, seed)


def one(word, seed=0):
    """A word's hash without numpy."""
    raw, full = word.encode(), (1 << 64) - 1
    if len(raw) > 64:
        return xxhash.xxh3_64_intdigest(raw, seed)
    step = lambda x: int(mix(np.array([x & full], np.uint64))[0])
    h = step(len(raw) ^ (seed + 1) * 0x9E3779B97F4A7C15)
    for i in range(0, len(raw), 8):
        h = step(h * 0xD6E8FEB86659FD93 ^ int.from_bytes(raw[i : i + 8], "little"))
    return h


def test_words_are_hashed_one_by_one():
    words = ["a", "ab", "abcdefgh", "abcdefghi", "x" * 16, "x" * 63, "x" * 64, "x" * 65, "y" * 3000, "é", "日本", "a"]
    for seed in (0, 1):
        h, first = hashed(" ".join(words[:5]), "", "\n\t".join(words[5:]) + " ", " ", seed=seed)
        assert h.tolist() == [one(w, seed) for w in words] and first.tolist() == [0, 5, 5, 12, 12]


@pytest.mark.parametrize("n", [16, 64, 256, 1024, 4096])
def test_words_that_polynomials_confuse(n):
    h, _ = hashed(" ".join([thue_morse(n), thue_morse(n, "b", "a"), thue_morse(n)]))
    assert h[0] == h[2] != h[1]
    words = np.array([one(x) for x in thue_morse(n)], np.uint64)
    other = np.array([one(x) for x in thue_morse(n, "b", "a")], np.uint64)
    assert shingles(words, 16)[0] != shingles(other, 16)[0]


def test_op3_and_op2_tell_such_words_apart(spark):
    six = "one two three four five six"
    texts = [f"{six} {thue_morse(1024)} {six}", f"{six} {thue_morse(1024, 'b', 'a')} {six}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r[0]["n_removed"] for _, r in sorted(rows_of(docs, substring.remove_repeated(docs)).items())] == [0, 0]
    assert len({r["fingerprint"] for r in fingerprint.fingerprints(docs).collect()}) == 2


def test_op3_levels():
    assert substring.levels(13) == [4, 8, 13]
    assert substring.levels(1) == [1] and substring.levels(4) == [1, 2, 4] and substring.levels(50) == [13, 26, 50]


@pytest.mark.parametrize("width", [1, 2, 5, 13, 16])
def test_op3_any_width(spark, width):
    rng = np.random.default_rng(width)
    passages = [[f"w{x}" for x in rng.integers(0, 40, n)] for n in rng.integers(1, 60, 12)]
    texts = [" ".join(sum((passages[i] for i in rng.integers(0, 12, 4)), [])) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    first, expected = {}, {}
    for d, t in enumerate(texts):
        w = t.split()
        windows = [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]
        gone = {i + k for i, x in enumerate(windows) if first.get(x, d) < d for k in range(width)}
        expected[d] = " ".join(x for i, x in enumerate(w) if i not in gone)
        for x in windows:
            first.setdefault(x, d)
    assert {r["doc_id"]: r["kept"] for r in substring.remove_repeated(docs, width).collect()} == expected
