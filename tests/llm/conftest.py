import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(__file__), os.path.dirname(os.path.dirname(__file__))]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "The river ran past the old mill, and nobody in the village could say when the wheel had stopped turning; it had been still for longer than any of them had lived there"


def documents():
    """Nulls, blanks, ties, repeated rows, near copies and a very long text."""
    words = PROSE.split()
    long = " ".join(f"{w}{i % 97}" for i in range(3000) for w in words[:10])
    texts = [
        PROSE,
        PROSE,
        PROSE.replace("wheel", "weir"),
        PROSE + "\n" + "Menu",
        "Menu\nA page about rivers and mills\nwith lines",
        "Menu\nAnother page, of wheels",
        None,
        "",
        "   \n\t ",
        "one",
        "one",
        "Call +1 (743) 555-3824 or 4111 1111 1111 1111, born 1987-03-14, from 10.20.30.40 by a.b@example.com",
        "4111111111111112 is no card and 1987-13-45 no date; again 4111 1111 1111 1111",
        "ÀÉÎ öäü   日本語 <|endoftext|> 'S",
        long,
        "WIN!!! $$$ %%% ### BUY!! NOW!! $$$ &&& *** WIN!!! $$$",
    ]
    rows = [(i, t, "en", f"s{i % 2}" if i % 5 else None, len(t) if t else 0) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[11], (None, PROSE + " for ever", None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(docs):
    """The documents with more columns, named as things inside the operators are."""
    from pyspark.sql import functions as F

    names = ["score", "_row_hash", "_d", "_h", "_host", "_hashes", "_all", "_kept", "_dropped", "n_lines", "_found", "_changed", "word", "key", "h", "fp", "spots", "n", "part", "_quality"]
    return docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
