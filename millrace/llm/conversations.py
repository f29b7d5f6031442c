"""Repair of conversations whose turns are missing, blank, repeated, cut off or out of order.

Each row becomes one character of a signature (role and fault). A distinct signature is solved once, by recursion with
memory; its audit, one letter for each edit, is joined back and replayed over the rows.

The edits drive four states (begin, after system, after user, after assistant). A signature is solved for each state it may
begin and end in, so that a conversation of any length is cut into blocks that are solved apart and folded in order. Audits
of one block all end with the edit of its last row, hence none is the start of another, and the least audit of a whole
conversation is made of the least ones of its blocks.

Cases: rows of one conversation are taken by turn (nulls first), then role, then the digest of role and text; rows equal
in all of these are interchangeable. A null role or text counts as one space, a null conversation as one of its own. Texts
are read whole, an empty table gives no rows, other columns are ignored. A conversation's audit is one string, so
it has fewer than 2^31 edits; its rows are streamed, never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
ROLES = "suao"
#: Characters of a signature, each for system, user, assistant and other roles.
FINE, TRUNCATED, BLANK, DUPLICATE = "suao", "SUAO", "0123", "4567"
#: Rows of a block at most, which bounds the depth of the recursion.
BLOCK = 256
#: Signatures (of blocks and of what is left of them) that a task remembers.
MEMORY = 50_000

BEGIN, SYSTEM, USER, ASSISTANT = range(4)
#: State -> (edits inserted, state after them).
INSERTS = {BEGIN: (("", BEGIN), ("I", USER), ("II", ASSISTANT)), SYSTEM: (("", SYSTEM), ("I", USER), ("II", ASSISTANT)), USER: (("", USER), ("I", ASSISTANT)), ASSISTANT: (("", ASSISTANT), ("I", USER))}
#: State at the end -> edits that complete the conversation.
TAIL = {BEGIN: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
KEEPS = {("s", BEGIN): SYSTEM, ("u", BEGIN): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
COUNTERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _next_role(state: int) -> int:
    return ASSISTANT if state == USER else USER


@lru_cache(MEMORY)
def solve(signature: str, state: int) -> tuple[tuple[int, str] | None, ...]:
    """For each state at the end the cheapest (cost, audit) that leads there, ties ASCII-least; None where nothing does."""
    if not signature:
        return tuple((0, "") if end == state else None for end in range(4))
    row, rest = signature[0], signature[1:]
    found: list[tuple[int, str] | None] = [None] * 4
    for inserted, at in INSERTS[state]:
        choices = [(3, "D", at)]
        if row in FINE or row in TRUNCATED:
            cut = int(row in TRUNCATED)
            choices.append((2 + cut, "R", _next_role(at)))
            if (kept := KEEPS.get((row.lower(), at))) is not None:
                choices.append((cut, "K", kept))
        for cost, edit, after in choices:
            for end, tail in enumerate(solve(rest, after)):
                if tail is not None:
                    way = (cost + 2 * len(inserted) + tail[0], inserted + edit + tail[1])
                    if found[end] is None or way < found[end]:
                        found[end] = way
    return tuple(found)


def role_of(row: str) -> str:
    return ROLES[next(kind.index(row) for kind in (FINE, TRUNCATED, BLANK, DUPLICATE) if row in kind)]


def faults(signature: str) -> tuple[int, int, int, int]:
    """(blank, duplicate, truncated, illegal) of a signature."""
    roles = "".join(map(role_of, signature))
    illegal = sum(roles[i : i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))
    return tuple(sum(row in kind for row in signature) for kind in (BLANK, DUPLICATE, TRUNCATED)) + (illegal,)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage of the exercise: by crc32 of ``conv_id:turn`` modulo 20 a row is
    dropped (0 copies), emptied, loses its ``.!?``, is repeated (2 copies) or becomes the user's."""
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault = F.crc32(key) % 20
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def _same(role: Column, text: Column) -> Column:
    """Tells role and text apart."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, same, piece, signature) of damaged rows: blocks of conversations, in the order of these columns."""
    end = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    fault = F.when(end == "", "blank").when(end.isin(".", "!", "?"), "fine").otherwise("truncated")
    head = F.substring("role", 1, 1)
    kind = F.when(head.isin("s", "u", "a"), head).otherwise("o")
    told = rows.where("copies > 0").select("conv_id", "turn", "role", _same(F.col("role"), F.col("text")).alias("same"), kind.alias("kind"), fault.alias("fault"), "copies")
    told = told.groupBy("conv_id", "turn", "role", "same", "kind", "fault").agg(F.sum("copies").alias("copies"))
    again = told.where("fault != 'blank'").groupBy(F.col("conv_id").alias("c"), F.col("same").alias("s")).agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
    told = told.join(again, told.conv_id.eqNullSafe(again.c) & (told.same == again.s), "left")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    place = F.instr(F.lit(ROLES), F.col("kind"))
    letter = lambda of: F.substring(F.lit(of), place, 1)
    first = F.when(F.col("fault") == "blank", letter(BLANK)).when(later, letter(DUPLICATE)).when(F.col("fault") == "truncated", letter(TRUNCATED)).otherwise(letter(FINE))
    more = F.when(F.col("fault") == "blank", letter(BLANK)).otherwise(letter(DUPLICATE))
    order = ["conv_id", "turn", "role", "same"]
    told = told.select(*order, first.alias("first"), more.alias("more"), "copies")
    schema = told.select(*order, F.lit(0).alias("piece"), F.lit("").alias("signature")).schema
    return told.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_encoded, schema)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order -> blocks of at most BLOCK rows of one conversation, each under the place of its first row."""
    place, conv, held = None, None, ""
    for batch in batches:
        out = []
        for c, turn, role, same, first, more, copies in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if place is not None and (c != conv or len(held) >= BLOCK):
                out.append((*place, held))
                place, held = None, ""
            conv, piece = c, 0
            if place is None:
                place = (c, turn, role, same, piece)
            room = min(copies, BLOCK - len(held))
            held, copies = held + first + more * (room - 1), copies - room
            while copies:
                out.append((*place, held))
                piece, room = piece + 1, min(copies, BLOCK)
                place, held, copies = (c, turn, role, same, piece), more * room, copies - room
        fields = [batch.schema.field(i) for i in range(4)] + [pa.field("piece", pa.int32()), pa.field("signature", pa.string())]
        if out:
            yield _batch(out, fields)
    if place is not None:
        yield _batch([(*place, held)], fields)


def _batch(rows: list[tuple], fields: list[pa.Field]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], [f.name for f in fields])


SOLVED = "signature string, counts array<bigint>, ends string, costs array<bigint>, audits array<string>"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(0).to_pylist()
        tables = [[way for state in range(4) for way in solve(s, state)] for s in names]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()), pa.array([faults(s) for s in names], pa.list_(pa.int64())), pa.array([role_of(s[0]) + role_of(s[-1]) for s in names]),
                pa.array([[w and w[0] for w in t] for t in tables], pa.list_(pa.int64())), pa.array([[w and w[1] for w in t] for t in tables], pa.list_(pa.string())),
            ],
            ["signature", "counts", "ends", "costs", "audits"],
        )


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Solved blocks, in order -> (conv_id, blank, duplicate, truncated, illegal, cost, audit) of each conversation."""
    conv, ways, counts, last = None, None, None, ""

    def closed():
        cost, audit = min((w[0] + 2 * len(TAIL[end]), "".join(w[1]) + TAIL[end]) for end, w in enumerate(ways) if w)
        return (conv, *counts, cost, audit)

    for batch in batches:
        out = []
        for c, more, ends, costs, audits in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "counts", "ends", "costs", "audits")), strict=True):
            if ways is None or c != conv:
                if ways is not None:
                    out.append(closed())
                conv, ways, counts, last = c, [(0, []), None, None, None], [0, 0, 0, 0], ""
            counts = [a + b for a, b in zip(counts, more, strict=True)]
            counts[3] += bool(last) and last + ends[0] not in ("su", "ua", "au")
            last, after = ends[1], [None] * 4
            for end in range(4):
                reached = [(w[0] + costs[4 * s + end], w[1], audits[4 * s + end]) for s, w in enumerate(ways) if w and costs[4 * s + end] is not None]
                if len(least := [r for r in reached if r[0] == min(x[0] for x in reached)]) > 1:
                    least = [min(least, key=lambda r: "".join(r[1]) + r[2])]
                if least:
                    after[end] = (least[0][0], [*least[0][1], least[0][2]])
            ways = after
        kinds = [batch.schema.field("conv_id")] + [pa.field(n, pa.int64()) for n in COUNTERS[1:]] + [pa.field("audit", pa.string())]
        if out:
            yield _batch(out, kinds)
    if ways is not None:
        yield _batch([closed()], kinds)


def audits(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of damaged rows, those included
    that no row is left of."""
    blocks = scratch.save(signatures(rows), "blocks")
    solved = blocks.select("signature").distinct().mapInArrow(_solved, SOLVED)
    order = ["conv_id", "turn", "role", "same", "piece"]
    joined = blocks.join(solved, "signature").select(*order, "counts", "ends", "costs", "audits")
    kinds = ", ".join(f"{n} bigint" for n in COUNTERS[1:])
    folded = joined.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_folded, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {kinds}, audit string")
    turn = F.when(F.col("copies") > 0, F.col("turn"))
    gaps = rows.groupBy(F.col("conv_id").alias("c")).agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps"))
    both = gaps.join(folded, gaps.c.eqNullSafe(folded.conv_id), "left")
    return both.select(F.col("c").alias("conv_id"), "gaps", *(F.coalesce(n, F.lit(0)).alias(n) for n in COUNTERS[1:]), F.coalesce("audit", F.lit("")).alias("audit"))


class _Replay:
    """The state of one conversation while its audit is applied to its rows."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, BEGIN

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, _next_role(self.state)
            yield "user" if self.state == USER else "assistant", ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = KEEPS[role[:1], self.state]
            yield role, text
        elif edit == "R":
            self.state = _next_role(self.state)
            yield "user" if self.state == USER else "assistant", text


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit before its rows, in order, in one task, which reads them as a stream."""
    of = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("same"), F.lit("").alias("text"), F.lit(0).alias("copies"), *COUNTERS, "audit")
    held = rows.where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", _same(F.col("role"), F.col("text")).alias("same"), "text", "copies", *(F.lit(None).cast("long").alias(n) for n in COUNTERS), F.lit(None).cast("string").alias("audit"))
    return of.unionByName(held).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "same")


def replayed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, places from 0."""

    def run(batches):
        replay, place = None, 0
        for batch in batches:
            out = []
            for conv, kind, _, role, _, text, copies, *_, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    out += [(before, place + i, *x) for i, x in enumerate(replay.inserted())] if replay else []
                    replay, place, before = _Replay(audit), 0, conv
                for _ in range(copies):
                    new = list(replay.row(role, text))
                    out += [(conv, place + i, *x) for i, x in enumerate(new)]
                    place += len(new)
            fields = [batch.schema.field(0), pa.field("place", pa.int64()), pa.field("role", pa.string()), pa.field("text", pa.string())]
            if out:
                yield _batch(out, fields)
        if replay and (out := [(before, place + i, *x) for i, x in enumerate(replay.inserted())]):
            yield _batch(out, fields)

    return _with_audits(rows, found).mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place long, role string, text string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of audits with repaired_sha256, the digest of the repaired ``role:text`` lines, joined by newlines."""

    def run(batches):
        replay, seen, digest, lines = None, None, None, 0

        def add(new):
            nonlocal lines
            for role, text in new:
                digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1

        for batch in batches:
            out = []
            for conv, kind, _, role, _, text, copies, *counters, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    if replay:
                        add(replay.inserted())
                        out.append((*seen, digest.hexdigest()))
                    replay, seen, digest, lines = _Replay(audit), (conv, *counters, audit), hashlib.sha256(), 0
                for _ in range(copies):
                    add(replay.row(role, text))
            fields = [batch.schema.field(0)] + [pa.field(n, pa.int64()) for n in COUNTERS] + [pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())]
            if out:
                yield _batch(out, fields)
        if replay:
            add(replay.inserted())
            yield _batch([(*seen, digest.hexdigest())], fields)

    kinds = ", ".join(f"{n} bigint" for n in COUNTERS)
    return _with_audits(rows, found).mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {kinds}, audit string, repaired_sha256 string")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the damaged table with its faults, its cheapest repair and the digest of what that gives."""
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    scratch = Scratch(spark, "op13")
    found = scratch.save(audits(rows, scratch), "audits")
    scratch.drop_others("audits")
    return digests(rows, found)
