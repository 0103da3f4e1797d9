"""Helpers of the tests."""

from collections import defaultdict


def rows_of(docs, result):
    """Rows of a result by doc_id; repeated documents have several."""
    out = defaultdict(list)
    for r in result.collect():
        out[r["doc_id"]].append(r)
    return out
