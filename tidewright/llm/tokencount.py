"""Token counts of a byte-level BPE, with a whole-token shortcut.

Pre-tokens are split by the pattern of the tokenizer. The driver proves once, with the library,
which strings of the vocabulary are a single pre-token and encode alone as one token; a pre-token
among these counts as one. Only the rest is merged by the library, each distinct one once while it
stays in a task's bounded memory. A pre-token's tokens do not depend on what stands around it, so
counts add up exactly. Texts with a special string, or with characters on which the pattern engine
and the library might differ, are encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import CHUNK_BYTES

#: Fixed value: the pre-token pattern of this family of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct merged pre-tokens that a worker keeps, from task to task.
MEMORY = 600_000
WORDS_AT_ONCE = 2000

#: Characters whose classes are the same in every Unicode version since 3.0: printable ASCII with the usual
#: white space, and Latin letters with their punctuation. On these, the standard library's engine, with the
#: letters and numbers among them listed, gives the same pre-tokens in half the time.
_SETTLED = re.compile(r"[\t\n\r\x20-\x7E\xA1-\xFFĀ-Ƞ‐-‧]*")
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-Ƞ", "0-9²³¹¼-¾"
_SETTLED_PATTERN = re.compile(PATTERN.replace(r"^\s\p{L}\p{N}", rf"^\s{_LETTERS}{_NUMBERS}").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", f"[{_NUMBERS}]"))


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def whole_tokens(path: str) -> dict[str, int]:
    """The strings of the vocabulary that are one pre-token and that the library encodes alone as one token."""
    tokenizer = load(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    find = regex.compile(PATTERN).findall
    ids = range(tokenizer.get_vocab_size(with_added_tokens=False))
    texts = tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False)
    candidates = [t for t in texts if t and t not in special and "�" not in t and find(t) == [t]]
    encoded = tokenizer.encode_batch(candidates, add_special_tokens=False)
    return {t: e.ids[0] for t, e in zip(candidates, encoded) if len(e.ids) == 1}


class Encoder:
    """ids of texts as little-endian 32-bit integers."""

    def __init__(self, path: str, whole: dict[str, int]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = load(path)
        self.whole = {k: v.to_bytes(4, "little") for k, v in whole.items()}
        self.known = dict(self.whole)
        self.once: set[str] = set()
        self.find = _SETTLED_PATTERN.findall
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)  # a character stands for a byte
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.lengths[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def settled(self, text: str) -> bool:
        return _SETTLED.fullmatch(text) is not None and not any(s in text for s in self.special)

    def merge(self, texts: list[str]) -> list[bytes]:
        fast = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in fast]

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Ids of blank-led words. Set side by side they split into the same words, so they are merged as a few
        texts, whose tokens are dealt out again by their lengths in bytes."""
        out = []
        groups = [words[i : i + WORDS_AT_ONCE] for i in range(0, len(words), WORDS_AT_ONCE)]
        texts = ["".join(g) for g in groups]
        for group, text, found in zip(groups, texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            sizes = map(len, group) if text.isascii() else (len(w.encode()) for w in group)
            ends, wanted = np.cumsum(self.lengths[ids]), np.cumsum(np.fromiter(sizes, np.int64, len(group)))
            cuts = np.searchsorted(ends, wanted)
            if (ends[cuts] != wanted).any():
                raise ValueError("tokens do not end where words do")
            bounds = [0, *(4 * (cuts + 1)).tolist()]
            whole = ids.tobytes()
            out += [whole[a:z] for a, z in zip(bounds, bounds[1:])]
        return out

    def learn(self, new: set[str]) -> None:
        words = [p for p in new if p[0] == " " and p[1:].isalpha()]
        rest = list(new.difference(words))
        self.known.update(zip(words, self.merge_words(words)))
        self.known.update(zip(rest, self.merge(rest)))

    def forget(self) -> None:
        """Drops what only one call of ids() has met; all, if that is too little."""
        for piece in self.once:
            del self.known[piece]
        self.once = set()
        if len(self.known) > len(self.whole) + 0.8 * MEMORY:
            self.known = dict(self.whole)

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; call it with about a megabyte of text, or one long text."""
        pieces = [self.find(t) if self.settled(t) else None for t in texts]
        distinct = set().union(*(p for p in pieces if p is not None))
        self.once.difference_update(self.once.intersection(distinct))
        if len(self.known) > len(self.whole) + MEMORY:
            self.forget()
        new = distinct.difference(self.known)
        self.learn(new)
        self.once |= new
        odd = iter(self.merge([t for t, p in zip(texts, pieces) if p is None]))
        known = self.known.__getitem__
        return [next(odd) if p is None else b"".join(map(known, p)) for p in pieces]


_encoders: dict[str, Encoder] = {}


def encoder(path: str, whole: dict[str, int]) -> Encoder:
    """The worker's encoder for a file, with the pre-tokens that earlier tasks have merged."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, whole)
    return _encoders[path]


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary of a byte-level tokenizer file as bytes, if merging by ascending id is what its merges say.

    That holds if nothing changes a text before it is split by PATTERN, if merges stand in the order of
    the ids that they make, and if each longer string is made by just one merge: the pair of lowest
    rank is then the pair of lowest id.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    odd = spec.get("normalizer") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges")
    if not plain or odd:
        return None
    # a byte that is printable in Latin-1 stands for itself, the others for the characters from 256 on
    itself = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    byte_of = {chr(b): b for b in itself} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)).difference(itself)))}
    special = {t["content"] for t in spec["added_tokens"]}
    vocabulary = {k: v for k, v in model["vocab"].items() if k not in special}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    made = [vocabulary["".join(pair)] for pair in pairs]
    ranks = {bytes(byte_of[c] for c in k): v for k, v in vocabulary.items()}
    longer = sorted(v for k, v in ranks.items() if len(k) > 1)
    return ranks if made == longer and longer[0] > max(v for k, v in ranks.items() if len(k) == 1) else None


_text_ids: dict[str, Callable] = {}


def text_ids(path: str, whole: dict[str, int]) -> Callable[[list[str]], list[list[int]]]:
    """A function that gives the ids of each of some texts, the library's, by a second engine where both agree.

    Texts of settled characters without special strings are encoded by tiktoken over the file's own
    vocabulary, if byte_ranks allows it and every string that the engine takes whole is in `whole`,
    which the library has proven. All else is encoded by the library.
    """
    if path not in _text_ids:
        library = load(path)
        special = [t.content for t in library.get_added_tokens_decoder().values()]
        ranks = byte_ranks(path)
        taken = regex.compile(PATTERN).fullmatch
        if ranks is not None:
            texts = (b.decode(errors="replace") for b in ranks)
            if any(t not in whole and "\ufffd" not in t and taken(t) for t in texts):
                ranks = None
        engine = ranks and tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(texts: list[str]) -> list[list[int]]:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
            settled = [engine is not None and _SETTLED.fullmatch(t) is not None and not any(s in t for s in special) for t in texts]
            odd = [t for t, s in zip(texts, settled) if not s]
            rest = iter(library.encode_batch_fast(odd, add_special_tokens=False) if odd else [])
            return [engine.encode_ordinary(t) if s else next(rest).ids for t, s in zip(texts, settled)]

        _text_ids[path] = encode
    return _text_ids[path]


def parts(texts: list[str], limit: int = CHUNK_BYTES):
    """Ranges of texts of about `limit` characters, or of a single text."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row of docs(doc_id, text) by the tokenizer file at `path`.

    Null and empty texts have no tokens. Special strings inside texts are single tokens, the
    library's default; none is added. Repeated rows come out as often; other columns are not read.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, whole.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [len(x) // 4 for i, j in parts(texts) for x in own.ids(texts[i:j])]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
