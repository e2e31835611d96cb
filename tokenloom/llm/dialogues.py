"""Conversation structure repair (12): one sorted stream a conversation, cheapest edits by dynamic programming.

Rows are dealt by conversation and sorted by turn; ``mapInArrow`` walks them (it
is ``mapInPandas`` without the step that makes doubles of nullable longs) and
carries its state across Arrow batches. That state is a handful of values: for
each state of the grammar ``(s?(ua)+)?`` the least cost, the place of its edits
among those of the other states, and the running SHA-256 of its repaired text.
Backpointers are four bytes a row; beyond ``SPILL`` bytes they go to a file
of the task and are read back from the end, so a conversation of any length
needs bounded memory but for its audit. A hash of a whole text is made in order,
so one conversation is one task's stream; texts pass through it, none is kept.

Which texts a conversation has had before is a sum over (conversation, digest),
added up before it is shuffled; the stream keeps no set.

Edits: Keep (0, the role must fit), Rerole to user or assistant (3), Delete (4,
the only one for blank and repeated rows), Insert an empty user or assistant
(3); a truncated row that stays costs 3 more. Of equal costs the least audit
string wins. Two edit strings that reach the same row and state at the same cost
are never one the start of the other, so comparing what was chosen so far is
enough, and the order of the four states' strings is all that must be kept.

Defined cases: null role and text count as one blank; an empty role fits
nowhere; rows of one turn are ordered by role and text; null turns come first
and do not count as gaps; null conv_ids are one conversation; gaps beyond a
long are the largest long; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPILL = 8 << 20
_BLANK = " \t\n\x0b\x0c\r"
_LONG = (1 << 63) - 1
# states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant
_NEXT = (2, 2, 3, 2)
_NAMES = {2: "user", 3: "assistant"}
_LETTERS = "DIKR"
_LEGAL = {"su", "ua", "au"}


class Backpointers:
    """A stack of four bytes a row, the older part in a file."""

    def __init__(self, limit: int = SPILL):
        self.limit, self.held, self.file = limit, bytearray(), None

    def push(self, four: bytes) -> None:
        self.held += four
        if len(self.held) >= self.limit:
            if self.file is None:
                self.file = tempfile.TemporaryFile()  # of this task only; gone when it ends
            self.file.write(self.held)
            self.held = bytearray()

    def backwards(self) -> Iterator[bytes]:
        while True:
            for i in range(len(self.held) - 4, -1, -4):
                yield bytes(self.held[i : i + 4])
            end = self.file.tell() if self.file else 0
            if not end:
                break
            start = max(0, end - (self.limit + 3) // 4 * 4)
            self.file.seek(start)
            self.held = bytearray(self.file.read(end - start))
            self.file.seek(start)
        if self.file:
            self.file.close()


def _line(sha, first: bool, role: str, text: str):
    sha = sha.copy()
    sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
    return sha


class Repair:
    """The cheapest edits of one conversation, row by row.

    ``base`` has for each state (cost, rank of its edit string, SHA-256) after the last row.
    """

    def __init__(self, limit: int = SPILL):
        self.base = {0: (0, 0, hashlib.sha256())}
        self.back = Backpointers(limit)

    def _nodes(self) -> dict[int, tuple]:
        """State -> (cost, rank, inserts, base state) with the best inserts after the last row."""
        nodes = {}
        for state, (cost, rank, _) in self.base.items():
            at, inserts = state, ""
            while len(inserts) < 3:
                found = (cost + INSERT * len(inserts), rank, inserts, state)
                if at not in nodes or found < nodes[at]:
                    nodes[at] = found
                at, inserts = _NEXT[at], inserts + "I"
        return nodes

    def _inserted(self, state: int, inserts: str):
        """SHA-256 of a base with its inserts, and whether it is still empty."""
        sha, empty = self.base[state][2], state == 0
        for _ in inserts:
            state = _NEXT[state]
            sha, empty = _line(sha, empty, _NAMES[state], ""), False
        return sha, empty

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        found: dict[int, tuple] = {}
        extra = TRUNCATED if truncated else 0
        for state, (cost, rank, inserts, base) in self._nodes().items():
            to = _NEXT[state]
            edits = [(state, "D", DELETE)]
            if not must_go:
                edits.append((to, "R", REROLE + extra))
                if state == 0 and role[:1] == "s":
                    edits.append((1, "K", KEEP + extra))
                elif role[:1] == _NAMES[to][0]:
                    edits.append((to, "K", KEEP + extra))
            for end, letter, price in edits:
                new = (cost + price, rank, inserts + letter, base)
                if end not in found or new < found[end]:
                    found[end] = new
        order = {end: i for i, end in enumerate(sorted(found, key=lambda e: found[e][1:3]))}
        base, pointers = {}, bytearray(4)
        for end, (cost, _, edits, start) in found.items():
            sha, empty = self._inserted(start, edits[:-1])
            if edits[-1] != "D":
                sha = _line(sha, empty, role if edits[-1] == "K" else _NAMES[end], text)
            base[end] = (cost, order[end], sha)
            pointers[end] = start << 4 | (len(edits) - 1) << 2 | _LETTERS.index(edits[-1])
        self.base = base
        self.back.push(pointers)

    def end(self) -> tuple[int, str, str]:
        """Cost, audit and SHA-256 of the repaired conversation."""
        nodes = self._nodes()
        cost, _, inserts, state = min(nodes[s] for s in (0, 3) if s in nodes)
        sha, _ = self._inserted(state, inserts)
        reverse = bytearray(inserts.encode())
        for four in self.back.backwards():
            state, code = four[state] >> 4, four[state]
            reverse += _LETTERS[code & 3].encode() + b"I" * (code >> 2 & 3)
        return cost, reverse[::-1].decode(), sha.hexdigest()


def _tied(turns: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Rows with ``again`` (the text was there in an earlier turn); a marker row for each of ``ids``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))
    repeats = rows.groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    repeats = repeats.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), F.col("first.turn").alias("first"), F.lit(True).alias("found"))
    again = F.coalesce(F.col("found"), F.lit(False)) & ~F.col("first").eqNullSafe(F.col("turn"))
    out = rows.join(repeats, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    out = out.select("conv_id", F.lit(False).alias("marker"), "turn", "role", "text", again.alias("again"))
    if ids is not None:
        marks = ids.select("conv_id").distinct()
        nothing = [F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("again", "boolean"))]
        out = out.unionByName(marks.select("conv_id", F.lit(True).alias("marker"), *nothing))
    return out


def _dealt(rows: DataFrame, *first: str) -> DataFrame:
    order = [F.asc_nulls_first("conv_id"), *[F.desc(c) for c in first], F.asc_nulls_first("turn"), "role", "text"]
    return rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*order)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _examine(rows: Iterator[tuple], limit: int = SPILL) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit and hash of one sorted conversation."""
    repair, before = Repair(limit), None
    low = high = None
    turns = blank = duplicate = truncated = illegal = 0
    for _, marker, turn, role, text, again in rows:
        if marker:
            continue
        now = (turn, role, text)
        if turn is not None and (before is None or turn != before[0]):
            low, high, turns = turn if low is None else low, turn, turns + 1
        if before is not None and before[1][:1] + role[:1] not in _LEGAL:
            illegal += 1
        body = text.strip(_BLANK)
        is_blank = not body
        is_again = not is_blank and (again or now == before)
        is_cut = not is_blank and not is_again and body[-1] not in ".!?"
        blank, duplicate, truncated = blank + is_blank, duplicate + is_again, truncated + is_cut
        repair.row(role, text, is_blank or is_again, is_cut)
        before = now
    gaps = 0 if low is None else min(high - low + 1 - turns, _LONG)
    return gaps, blank, duplicate, truncated, illegal, *repair.end()


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row a conversation: its faults, the cost and audit of its cheapest repair, the hash of the repaired text.

    ``ids`` names conversations to report even if they have no rows.
    """
    small_batches(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, schema, held = [], None, 0

        def keyed() -> Iterator[tuple]:
            nonlocal schema
            for batch in batches:
                schema = batch.schema
                yield from _rows([batch])

        def block() -> pa.RecordBatch:
            columns = list(zip(*out))
            types = [schema.field(0).type, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", *_COUNTS, "audit", "repaired_sha256"])

        for conv, rows in groupby(keyed(), key=lambda r: r[0]):
            out.append((conv, *_examine(rows)))
            held += 200 + len(out[-1][-2])
            if held >= 1 << 20:
                yield block()
                out, held = [], 0
        if out:
            yield block()

    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    return _dealt(_tied(turns, ids), "marker").mapInArrow(walk, schema)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text, edit, turn (null: inserted); deleted rows are gone."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    audits = materialise(repair(turns), "conversation-audits").select("conv_id", "audit")
    rows = _tied(turns, None).drop("marker", "again").withColumn("audit", F.lit(None).cast("string"))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("text", "string"))]
    dealt = _dealt(rows.unionByName(audits.select("conv_id", *nothing, "audit")).withColumn("marker", F.col("audit").isNotNull()), "marker")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place, last = "", 0, 0, 0, None
        for batch in batches:
            out = []

            def inserts(conv: object) -> None:
                nonlocal at, state, place
                while at < len(audit) and audit[at] == "I":
                    state = _NEXT[state]
                    out.append((conv, place, _NAMES[state], "", "I", None))
                    at, place = at + 1, place + 1

            for conv, turn, role, text, given, marker in _rows([batch]):
                if marker:
                    inserts(last)
                    audit, at, state, place, last = given, 0, 0, 0, conv
                    continue
                inserts(conv)
                edit, at = audit[at], at + 1
                if edit != "D":
                    state = 1 if edit == "K" and role[:1] == "s" else _NEXT[state]
                    out.append((conv, place, role if edit == "K" else _NAMES[state], text, edit, turn))
                    place += 1
            if out:
                yield _block(out, batch.schema.field(0).type)
        out = []
        while at < len(audit):
            state = _NEXT[state]
            out.append((last, place, _NAMES[state], "", "I", None))
            at, place = at + 1, place + 1
        if out:
            yield _block(out, batch.schema.field(0).type)

    return dealt.mapInArrow(apply, f"conv_id {kind}, place long, role string, text string, edit string, turn long")


def _block(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["conv_id", "place", "role", "text", "edit", "turn"])


def damage(turns: DataFrame) -> DataFrame:
    """Faults chosen by crc32 of ``conv_id:turn`` modulo 20: 0 drops, 1 empties, 2 takes ``.!?``, 3 doubles, 4 sets role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    copies = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    return turns.select(
        "conv_id", "turn", F.when(code == 4, "user").otherwise(text("role")).alias("role"),
        F.when(code == 1, "").when(code == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    ).drop("copy")
