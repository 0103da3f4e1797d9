"""Repair of conversations: the cheapest edits after which roles follow a grammar.

Roles are read by their initials, and what is wanted is (s?(ua)+)?. For the interval parser this
grammar is put into Chomsky normal form: a nonterminal [p,q] stands for edits after which the roles have
gone from p to q (p and q: 0 for the start, or the last role's initial); [p,r] -> [p,q] [q,r] joins
neighbouring spans, and [p,q] -> edit covers a row. A cell of a span holds the least (cost, audit) of each
nonterminal. Insertions cover no row; their closure is part of every row's cell. Spans are combined
bottom-up by length, 1, 2, 4, ...: since the nonterminals allow any split, one split of a span finds
what all would. The least audit is found cell by cell, because of two audits of the same rows and cost neither
begins the other.

Rows are range-partitioned and sorted, so that a conversation of any length lies in as many tasks as it
takes. Conversations that end within a task are parsed there; of others each task parses its own spans,
and only cells meet.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import shared_folder, shuffle_partitions

Cell = dict[tuple[str, str], tuple[int, str]]

#: Which initials may follow, where a conversation may end, costs of the edits.
FOLLOWS = {"0": "su", "s": "u", "u": "a", "a": "u"}
ENDS = "0a"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = ("su", "ua", "au")
ROLE = {"u": "user", "a": "assistant"}
BLANK = r"[\x20\x09-\x0D]"
#: Rows and characters of a span at most, but for a longer row alone.
SPAN_ROWS, SPAN_CHARS = 2048, 1 << 23
_SPACE = "\x20\t\n\x0b\x0c\r"


def least(cell: Cell, key: tuple[str, str], value: tuple[int, str]) -> None:
    if key not in cell or value < cell[key]:
        cell[key] = value


def joined(a: Cell, b: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: Cell = {}
    for (p, q), (cost, audit) in a.items():
        for r in "0sua":
            other = b.get((q, r))
            if other is not None:
                least(out, (p, r), (cost + other[0], audit + other[1]))
    return out


def _insertions() -> Cell:
    """Nothing, or one after the other of the roles that may be inserted; the closure under joining."""
    out: Cell = {(p, p): (0, "") for p in FOLLOWS}
    for p, after in FOLLOWS.items():
        for q in after:
            if q in ROLE:
                least(out, (p, q), (INSERT, "I"))
    while (more := joined(out, out)) != out:
        out = more
    return out


INSERTIONS = _insertions()


def row_cell(initial: str, fault: str) -> Cell:
    """The cell of one row with insertions around it; fault: b(lank), d(uplicate), t(runcated) or none."""
    edits: Cell = {(p, p): (DELETE, "D") for p in FOLLOWS}
    if fault not in ("b", "d"):
        more = TRUNCATED if fault == "t" else 0
        for p, after in FOLLOWS.items():
            for q in after:
                if q == initial:
                    least(edits, (p, q), (more, "K"))
                if q in ROLE:
                    least(edits, (p, q), (REROLE + more, "R"))
    return joined(joined(INSERTIONS, edits), INSERTIONS)


_ROW_CELLS: dict[tuple[str, str], Cell] = {}


def _row_cell(initial: str, fault: str) -> Cell:
    key = (initial if initial in ("s", "u", "a") else "", fault)
    if key not in _ROW_CELLS:
        _ROW_CELLS[key] = row_cell(*key)
    return _ROW_CELLS[key]


def parse(cells: list[Cell]) -> Cell:
    """The cell of all the spans in a row, combined pairwise by length."""
    while len(cells) > 1:
        cells = [joined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else INSERTIONS


def best(cell: Cell) -> tuple[int, str]:
    return min(cell[("0", q)] for q in ENDS if ("0", q) in cell)


def replay(audit: str, initials: list[str], last: str = "0") -> Iterator[tuple[str, int | None]]:
    """(role's initial, row or None if inserted) of what edits leave of rows; K keeps its row's own role."""
    row = 0
    for edit in audit:
        if edit == "K":
            last = initials[row]
            yield last, row
        elif edit == "R":
            last = "a" if last == "u" else "u"
            yield last, row
        elif edit == "I":
            last = "a" if last == "u" else "u"
            yield last, None
        row += edit != "I"


def fault_of(text: str) -> str:
    """b or t of a text by itself, or nothing."""
    core = text.rstrip(_SPACE)
    if not core:
        return "b"
    return "" if core[-1] in ".!?" else "t"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present, tie: the rows with every twentieth dropped, emptied, cut, repeated or given role user.

    crc32 of conv_id:turn modulo 20 decides: 0 drops a row (it stays with present = false, so that its conversation is known),
    1 empties its text, 2 removes .!? from it, 3 repeats it, 4 sets its role to user. Nulls count as one space. tie
    orders rows of one turn: by role and text as they were.
    """
    one = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"), fault.alias("fault"))
    rows = rows.withColumn("tie", F.concat_ws("\0", "role", F.md5("text")))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") != 0).alias("present"), "tie")


SPAN = (
    "part int, seq long, whole boolean, roles array<string>, texts array<string>, turn_min long, turn_max long, turns long, first_turn long, last_turn long"
)
CELLS = "array<struct<p: string, q: string, cost: long, audit: string>>"
RESULTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _spans(rows: DataFrame, id: str) -> DataFrame:
    """Runs of sorted rows(id, turn, role, text, present): a row for each conversation in a task, or more if it is long."""
    kind = dict(rows.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        seq, size, key, begun = 0, 0, None, False
        pieces = 0  # spans of the present conversation that are out already
        turns: list = []
        roles: list[str] = []
        texts: list[str] = []
        waiting: list[tuple] = []
        conversations = 0

        def take(last: bool) -> tuple:
            nonlocal seq, size, turns, roles, texts
            seq += 1
            known = [t for t in turns if t is not None]
            distinct = sum(a != b for a, b in zip(known, [None, *known]))
            # the first and the last conversation of a task may go on in others
            whole = last and not pieces and conversations > 1
            row = (key, part, seq, whole, roles, texts, min(known, default=None), max(known, default=None), distinct, known[0] if known else None, known[-1] if known else None)
            size, turns, roles, texts = 0, [], [], []
            return row

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found))
            ids = pa.array(columns[0], id_type)
            types = [pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns[1:], types)]], [id, "part", "seq", "whole", "roles", "texts", "turn_min", "turn_max", "turns", "first_turn", "last_turn"])

        id_type, held = pa.int64(), 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for k, turn, role, text, present in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or k != key:
                    if begun:
                        held += size
                        waiting.append(take(True))
                    key, begun, pieces = k, True, 0
                    conversations += 1
                if present:
                    turns.append(turn)
                    roles.append(role)
                    texts.append(text)
                    size += len(text) + 1
                    if len(turns) >= SPAN_ROWS or size >= SPAN_CHARS:
                        held += size
                        waiting.append(take(False))
                        pieces += 1
                if held >= SPAN_CHARS or len(waiting) >= 4096:
                    yield batch_of(waiting)
                    waiting, held = [], 0
        if begun:
            row = take(True)
            waiting.append((*row[:3], False, *row[4:]))
        if waiting:
            yield batch_of(waiting)

    return rows.select(id, "turn", "role", "text", "present").mapInArrow(run, f"`{id}` {kind}, {SPAN}")


def _parsed(spans: DataFrame, id: str) -> DataFrame:
    """spans with faults, first and last initials, counts and cells. again: places (in the span) of rows seen earlier, null in whole conversations."""
    kind = dict(spans.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for roles, texts, again in zip(*(batch.column(i).to_pylist() for i in (4, 5, 11))):
                initials, faults = [r[:1] for r in roles], [fault_of(t) for t in texts]
                seen: set = set()
                repeated = set(again or ())
                for i, row in enumerate(zip(roles, texts)):
                    if again is None and row in seen or i in repeated:
                        faults[i] = faults[i] if faults[i] == "b" else "d"
                    if again is None:
                        seen.add(row)
                cell = parse([_row_cell(i, f) for i, f in zip(initials, faults)])
                illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
                out.append(("\0".join(initials), len(initials), *(faults.count(f) for f in "bdt"), illegal, [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in sorted(cell.items())]))
            columns = list(zip(*out)) or [[]] * 7
            cells = pa.list_(pa.struct([("p", pa.string()), ("q", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))
            types = [pa.string(), *[pa.int64()] * 5, cells]
            names = [*batch.schema.names[:-1], "initials", "n", "blank", "duplicate", "truncated", "illegal", "cells"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, t) for c, t in zip(columns, types)]], names)

    schema = f"`{id}` {kind}, {SPAN}, initials string, n long, blank long, duplicate long, truncated long, illegal long, cells {CELLS}"
    return spans.mapInArrow(run, schema)


def _chosen(parsed: DataFrame, id: str) -> DataFrame:
    """A row for each span: its last role before, its part of the edits; a conversation's last span has its counts too."""
    kind = dict(parsed.dtypes)[id]
    names = ["part", "seq", "turn_min", "turn_max", "turns", "first_turn", "last_turn", "initials", "n", "blank", "duplicate", "truncated", "illegal", "cells"]
    payload = [c for c in ("roles", "texts") if c in parsed.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if group and group[0][id] != row[id]:
                    yield settled(group, batch.schema.field(0).type)
                    group = []
                group.append(row)
            kept_type = batch.schema.field(0).type
        if group:
            yield settled(group, kept_type)

    def settled(group: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
        cell = parse([{(c["p"], c["q"]): (c["cost"], c["audit"]) for c in g["cells"]} for g in group if g["n"]])
        total = {k: sum(g[k] for g in group) for k in ("n", "turns", "blank", "duplicate", "truncated", "illegal")}
        cost, audit = best(cell) if total["n"] else (0, "")
        known = [g for g in group if g["first_turn"] is not None]
        distinct = total["turns"] - sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:]))
        gaps = max(g["turn_max"] for g in known) - min(g["turn_min"] for g in known) + 1 - distinct if known else 0
        rows, at, last, before = [], 0, "0", None
        for i, g in enumerate(group):
            own = g["initials"].split("\0") if g["n"] else []
            if own and before is not None:
                total["illegal"] += before + own[0] not in LEGAL
            before = own[-1] if own else before
            end, left = at, len(own)
            while end < len(audit) and (left or i == len(group) - 1):
                left -= audit[end] != "I"
                end += 1
            edits = audit[at:end]
            state = last
            for last, _ in replay(edits, own, state):
                pass
            final = i == len(group) - 1
            counts = (gaps, *(total[k] for k in ("blank", "duplicate", "truncated", "illegal")), cost, audit) if final else (None,) * 7
            rows.append((g[id], g["part"], g["seq"], state, edits, final, *counts, *(g[c] for c in payload)))
            at = end
        columns = list(zip(*rows))
        types = [id_type, pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_(), *[pa.int64()] * 6, pa.string(), *[pa.list_(pa.string())] * len(payload)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [id, "part", "seq", "before", "edits", "final", *RESULTS, *payload])

    schema = f"`{id}` {kind}, part int, seq long, before string, edits string, final boolean, {COUNTS}" + "".join(f", {c} array<string>" for c in payload)
    return parsed.select(id, *names, *payload).mapInArrow(run, schema)


def _lines(row: dict) -> list[tuple[str, str, str]]:
    """(role, text, edit) of the rows that a span's edits leave."""
    initials = [r[:1] for r in row["roles"]]
    kinds = [e for e in row["edits"] if e != "D"]
    out = []
    for edit, (initial, i) in zip(kinds, replay(row["edits"], initials, row["before"])):
        out.append((row["roles"][i] if edit == "K" else ROLE[initial], "" if i is None else row["texts"][i], edit))
    return out


class Repair:
    """The outcome of `repair`: `report`, a row for each conversation, and `rows()`, the repaired conversations."""

    def __init__(self, whole: DataFrame, split: DataFrame, id: str) -> None:
        self._whole, self._split, self._id = whole, split, id

    def rows(self) -> DataFrame:
        """id, part, seq, place (in this order), role, text, edit (K, R or I) of the rows that are left or inserted."""
        id, kind = self._id, dict(self._whole.dtypes)[self._id]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [id, "part", "seq", "place", "role", "text", "edit"]
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    found = _lines(row.to_pylist()[0])
                    same = lambda c: pa.concat_arrays([row.column(c)] * len(found)) if found else row.column(c).slice(0, 0)  # noqa: B023, E731
                    columns = list(zip(*found)) or [[]] * 3
                    yield pa.RecordBatch.from_arrays([same(0), same(1), same(2), pa.array(range(len(found)), pa.int64()), *[pa.array(c, pa.string()) for c in columns]], names)

        wanted = [id, "part", "seq", "before", "edits", "roles", "texts"]
        return self._whole.select(*wanted).unionByName(self._split.select(*wanted)).mapInArrow(run, f"`{id}` {kind}, part int, seq long, place long, role string, text string, edit string")

    @property
    def report(self) -> DataFrame:
        """id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

        The digest is of role:text of the repaired rows, joined by newlines. A conversation in several spans is hashed in
        order, a span at a time.
        """
        id, kind = self._id, dict(self._whole.dtypes)[self._id]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            digest, any_line = hashlib.sha256(), False
            for batch in batches:
                out = []
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    for role, text, _ in _lines(row):
                        digest.update(f"{chr(10) if any_line else ''}{role}:{text}".encode())
                        any_line = True
                    if row["final"]:
                        out.append((i, digest.hexdigest()))
                        digest, any_line = hashlib.sha256(), False
                own = batch.take(pa.array([i for i, _ in out], pa.int64()))
                columns = [own.column(id), *[own.column(n) for n in RESULTS], pa.array([d for _, d in out], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [id, *RESULTS, "repaired_sha256"])

        split = self._split.repartition(id).sortWithinPartitions(id, "part", "seq")
        schema = f"`{id}` {kind}, {COUNTS}, repaired_sha256 string"
        return self._whole.mapInArrow(run, schema).unionByName(split.mapInArrow(run, schema))


def repair(conversations: DataFrame, id: str = "conv_id") -> Repair:
    """The cheapest repair of each conversation of conversations(id, turn, role, text; more columns: present, tie).

    Rows are taken by turn (nulls first), ties by `tie` or else by role and text. A row's first fault counts: blank (white space
    only), duplicate (role and text seen earlier), truncated (its end is none of .!?). Kept rows cost nothing, another role
    3, deletion 4 (blank rows and duplicates must go), an inserted empty row 3, truncated rows that stay 3 each. Of the
    cheapest edits the ASCII-least ones in order are taken; K, R, D and I stand for them.

    Null roles and texts count as one space, a null id is a conversation of its own, and a role that begins with none of
    s, u, a is never kept. Rows with present = false only make their conversation known: one without other rows has zeros, no edits
    and the digest of nothing. An empty table gives no rows. Other columns are not read. Duplicates within a conversation of several spans
    are found by MD5. Sorted spans, and the cells of those that are no whole conversation, are written to the shared folder once.
    """
    one = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    tie = F.col("tie") if "tie" in conversations.columns else F.concat_ws("\0", one("role"), F.md5(one("text")))
    present = F.col("present") if "present" in conversations.columns else F.lit(True)
    rows = conversations.select(F.col(id), F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"), present.alias("present"), tie.alias("tie"))
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/conversations-{uuid.uuid4().hex}"
    # rows that are equal in all may be parted too: a hot key is spread by the row's own number
    ordered = rows.withColumn("own", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(spark), id, "turn", "tie", "own").sortWithinPartitions(id, "turn", "tie", "own")
    _spans(ordered, id).write.parquet(f"{folder}/spans")
    spans = spark.read.parquet(f"{folder}/spans")
    # rows of conversations that lie in several spans: which were seen in the span before, or an earlier one
    split = spans.filter(~F.col("whole"))
    each = split.select(id, "part", "seq", F.posexplode(F.arrays_zip("roles", F.transform("texts", F.md5).alias("hash"))).alias("i", "r")).select(id, F.col("r.roles").alias("role"), F.col("r.hash").alias("hash"), F.struct("part", "seq", "i").alias("at"))
    first = each.groupBy(id, "role", "hash").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col(id).alias("_id"), F.col("role").alias("_role"), F.col("hash").alias("_hash"), "first")
    again = each.join(first, each[id].eqNullSafe(first["_id"]) & (each["role"] == first["_role"]) & (each["hash"] == first["_hash"])).filter("at > first")
    places = again.groupBy(F.col("at.part").alias("part"), F.col("at.seq").alias("seq")).agg(F.collect_list("at.i").alias("again"))
    marked = split.join(places, ["part", "seq"], "left").withColumn("again", F.coalesce("again", F.array().cast("array<int>")))
    whole = spans.filter("whole").withColumn("again", F.lit(None).cast("array<int>"))
    _parsed(marked.select(*spans.columns, "again"), id).drop("roles", "texts").write.parquet(f"{folder}/cells")
    cells = spark.read.parquet(f"{folder}/cells").repartition(id).sortWithinPartitions(id, "part", "seq")
    settled = _chosen(cells, id).join(split.select("part", "seq", "roles", "texts"), ["part", "seq"])
    settled = settled.select(id, *[c for c in settled.columns if c != id])
    return Repair(_chosen(_parsed(whole.select(*spans.columns, "again"), id), id), settled, id)
