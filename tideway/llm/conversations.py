"""Repair of conversations' structure at least cost: a scan of min-plus matrices over (cost, audit).

A repaired conversation is empty, or its role initials are ``s?(ua)+``. Four
states say what a beginning of it may be followed by: BEGIN, after s, after u,
after a. Each turn is a 4 x 4 matrix: entry (i, j) is the cheapest way to get
from i to j with this turn kept (0), given the role user or assistant (2) or
deleted (3), truncated turns that stay costing 1 more, and with any inserted
turns (2 each) before it, whose closure is one more matrix. An element is
(cost, audit), the audit the initials of the edits; addition is the smaller
element, multiplication adds costs and joins audits. Two audits of the same
turns that cost the same are never one the beginning of the other, as what
follows could only be inserts, which cost. So the order of audits survives
joining, multiplication distributes over the minimum, and products may be taken
in any grouping.

Turns are dealt by ranges of (conv_id, turn, role, hash of the text) and sorted,
so a conversation of any length is spread over tasks. A header before each
conversation and a marker at the first place of each message (a count of hashes,
combined before its shuffle) travel through the same sort; a turn without a
marker is a duplicate. A conversation that ends within its task is solved there.
The others leave segments of at most SEGMENT turns, whose matrices and counts are
multiplied in a tree: those of one task first, then those of FAN_IN neighbours,
level by level. Their repaired text is then hashed, segment by segment, in one
stream, as SHA-256 has no other way; the stream holds the audit and one segment.

Edge cases: a null role or text is one space, a null conv_id is a conversation,
null turns come first; turns of one number stand by role, then by the SHA-256 of
their text; repeated rows are duplicates; a role's initial is its first
character, and a role that is none of s, u and a cannot stay; empty and very long
texts are taken whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.common import batch, collapsed, cut, small_batches

BEGIN, S, U, A = range(4)
#: What the edits cost.
RENAME, DELETE, INSERT, STAYS_CUT = 2, 3, 2, 1
#: Turns and bytes of a segment at most, and neighbours that meet in one product.
SEGMENT, SEGMENT_BYTES, FAN_IN = 4_096, 8 << 20, 16

LEGAL = frozenset(("su", "ua", "au"))
INITIALS = {"s": 0, "u": 1, "a": 2}
#: The kinds of turns: initial (s, u, a, other), plus 4 if truncated; GONE must be deleted.
GONE = 8

Element = tuple[int, bytes] | None
Matrix = tuple[tuple[Element, ...], ...]


def matrix(entries: dict[tuple[int, int], Element]) -> Matrix:
    return tuple(tuple(entries.get((i, j)) for j in range(4)) for i in range(4))


def times(x: Matrix, y: Matrix) -> Matrix:
    columns = tuple(zip(*y, strict=True))
    return tuple(tuple(min(((a[0] + b[0], a[1] + b[1]) for a, b in zip(row, col, strict=True) if a and b), default=None) for col in columns) for row in x)


IDENTITY = matrix({(i, i): (0, b"") for i in range(4)})
#: Where a turn with the role user or assistant leads from each state.
NEXT = {BEGIN: U, S: U, U: A, A: U}


def closure() -> Matrix:
    """Any number of inserts: as many products as there are states, beyond which no way is cheaper."""
    one = matrix({(i, i): (0, b"") for i in range(4)} | {(i, j): (INSERT, b"I") for i, j in NEXT.items()})
    return reduce(times, [one] * 4)


CLOSED = closure()


def turn(kind: int) -> Matrix:
    """Inserts, then one turn."""
    ways = {(i, i): (DELETE, b"D") for i in range(4)}
    if kind != GONE:
        initial, more = kind % 4, STAYS_CUT if kind >= 4 else 0
        ways |= {(i, j): (RENAME + more, b"R") for i, j in NEXT.items()}
        kept = {0: {BEGIN: S}, 1: {BEGIN: U, S: U, A: U}, 2: {U: A}, 3: {}}[initial]
        ways |= {(i, j): (more, b"K") for i, j in kept.items()}
    return times(CLOSED, matrix(ways))


TURNS = tuple(turn(k) for k in range(GONE + 1))


@lru_cache(maxsize=50_000)
def _few(kinds: bytes) -> Matrix:
    return reduce(times, [TURNS[k] for k in kinds], IDENTITY)


def tree(parts: list[Matrix]) -> Matrix:
    """The product of the matrices, neighbours first."""
    while len(parts) > 1:
        parts = [times(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else IDENTITY


def product(kinds: bytes) -> Matrix:
    return tree([_few(kinds[i : i + 8]) for i in range(0, len(kinds), 8)])


def best(whole: Matrix) -> tuple[int, bytes]:
    """The cheapest way from BEGIN to an end: nothing, or after an a."""
    row = times(whole, CLOSED)[BEGIN]
    return min(x for x in (row[BEGIN], row[A]) if x)


@lru_cache(maxsize=100_000)
def _solved(kinds: bytes) -> tuple[int, bytes]:
    return best(product(kinds))


def solved(kinds: bytes) -> tuple[int, bytes]:
    """(cost, audit) of a whole conversation; those of short ones are remembered."""
    return _solved(kinds) if len(kinds) <= 64 else best(product(kinds))


class Edits:
    """Applies an audit to turns, in order and in any number of pieces."""

    def __init__(self, audit: bytes):
        self.audit, self.at, self.state = audit, 0, BEGIN

    def made(self) -> str:
        self.state = NEXT[self.state]
        return "user" if self.state == U else "assistant"

    def turns(self, roles: list[str], texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """(role, text) of what the turns become, inserted ones before them."""
        for role, text in zip(roles, texts, strict=True):
            yield from self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit == 0x4B:  # K
                self.state = S + INITIALS[role[0]]
                yield role, text
            elif edit == 0x52:  # R
                yield self.made(), text

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == 0x49:  # I
            self.at += 1
            yield self.made(), ""


class Sum:
    """What the turns of a run count to; sums of neighbouring runs add up."""

    NAMES = ("blank", "duplicate", "truncated", "illegal", "n_turns", "first_turn", "last_turn", "first_initial", "last_initial")

    def __init__(self, blank=0, duplicate=0, truncated=0, illegal=0, n_turns=0, first_turn=None, last_turn=None, first_initial=None, last_initial=None):
        self.blank, self.duplicate, self.truncated, self.illegal, self.n_turns = blank, duplicate, truncated, illegal, n_turns
        self.first_turn, self.last_turn, self.first_initial, self.last_initial = first_turn, last_turn, first_initial, last_initial

    def add(self, turn: int | None, initial: str) -> None:
        if self.first_initial is None:
            self.first_initial = initial
        elif self.last_initial + initial not in LEGAL:
            self.illegal += 1
        self.last_initial = initial
        if turn is not None and turn != self.last_turn:
            self.n_turns, self.last_turn = self.n_turns + 1, turn
            self.first_turn = turn if self.first_turn is None else self.first_turn

    def __add__(self, other: Sum) -> Sum:
        met = self.last_initial is not None and other.first_initial is not None and self.last_initial + other.first_initial not in LEGAL
        same = self.last_turn is not None and self.last_turn == other.first_turn
        return Sum(
            self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated, self.illegal + other.illegal + met, self.n_turns + other.n_turns - same,
            other.first_turn if self.first_turn is None else self.first_turn, self.last_turn if other.last_turn is None else other.last_turn,
            other.first_initial if self.first_initial is None else self.first_initial, self.last_initial if other.last_initial is None else other.last_initial,
        )

    def row(self) -> list:
        return [getattr(self, n) for n in self.NAMES]

    @property
    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.n_turns


_COUNTS = [("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64())]
_SUM = [*_COUNTS, ("n_turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string())]
_WAYS = [("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.binary()))]
_MESSAGES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_DONE = [("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("place", pa.int64()), ("messages", _MESSAGES)]
_SCANNED = pa.schema([("conv_id", pa.int64()), ("whole", pa.bool_()), ("part", pa.int32()), ("seq", pa.int64()), *_SUM, *_WAYS, ("kinds", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), *_DONE])
_SUM_DDL = "blank long, duplicate long, truncated long, illegal long, n_turns long, first_turn long, last_turn long, first_initial string, last_initial string"
_DONE_DDL = "cost long, audit string, repaired_sha256 string, place long, messages array<struct<role: string, text: string>>"
_SCANNED_DDL = f"conv_id long, whole boolean, part int, seq long, {_SUM_DDL}, costs array<long>, audits array<binary>, kinds binary, roles array<string>, texts array<string>, {_DONE_DDL}"
_TREE = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), *_SUM, *_WAYS])
_TREE_DDL = f"conv_id long, part int, seq long, {_SUM_DDL}, costs array<long>, audits array<binary>"


def stored(m: Matrix) -> tuple[list[int | None], list[bytes | None]]:
    """A matrix as two lists; audits of long runs repeat themselves, and are packed."""
    flat = [x for row in m for x in row]
    return [x and x[0] for x in flat], [x and zlib.compress(x[1], 1) for x in flat]


def restored(costs: list[int | None], audits: list[bytes | None]) -> Matrix:
    flat = [None if c is None else (c, zlib.decompress(a)) for c, a in zip(costs, audits, strict=True)]
    return tuple(tuple(flat[i : i + 4]) for i in range(0, 16, 4))


class Run:
    """The turns of one conversation, or of a piece of it, as they come."""

    def __init__(self, conv_id: int | None, headed: bool):
        self.conv_id, self.headed, self.seq = conv_id, headed, 0
        self.clear()

    def clear(self) -> None:
        self.sum, self.kinds, self.roles, self.texts, self.size = Sum(), bytearray(), [], [], 0

    def add(self, turn, role: str, text: str, blank: bool, truncated: bool, first: bool) -> None:
        kind = GONE
        if blank:
            self.sum.blank += 1
        elif not first:
            self.sum.duplicate += 1
        else:
            self.sum.truncated += truncated
            kind = INITIALS.get(role[:1], 3) + 4 * truncated
        self.sum.add(turn, role[:1])
        self.kinds.append(kind)
        self.roles.append(role)
        self.texts.append(text if kind != GONE else None)
        self.size += len(text) + 32 if kind != GONE else 32

    def segment(self, part: int) -> tuple:
        row = (self.conv_id, False, part, self.seq, *self.sum.row(), *stored(product(bytes(self.kinds))), bytes(self.kinds), self.roles, self.texts, *[None] * 5)
        self.seq += 1
        self.clear()
        return row

    def finished(self, part: int, messages: bool) -> tuple:
        cost, audit = solved(bytes(self.kinds))
        edits = Edits(audit)
        said = [*edits.turns(self.roles, self.texts), *edits.inserted()]
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        return (self.conv_id, True, part, 0, *self.sum.row(), *[None] * 5, cost, audit.decode(), sha, 0, [{"role": r, "text": t} for r, t in said] if messages else None)


def _scan(messages: bool):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, first, rows, held = TaskContext.get().partitionId(), None, False, [], 0
        for b in batches:
            for conv_id, header, mark, turn, role, text, blank, truncated, copies in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                if header:
                    if run:
                        held += run.size
                        rows.append(run.finished(part, messages) if run.headed and not run.seq else run.segment(part))
                    run, first = Run(conv_id, True), False
                elif mark:
                    first = True
                else:
                    run = run or Run(conv_id, False)
                    for _ in range(copies):
                        run.add(turn, role, text, blank, truncated, first)
                        first = False
                        if len(run.kinds) >= SEGMENT or run.size >= SEGMENT_BYTES:
                            held += run.size
                            rows.append(run.segment(part))
                            if held >= SEGMENT_BYTES:
                                yield batch(_SCANNED, *zip(*rows, strict=True))
                                rows, held = [], 0
            if rows:
                yield batch(_SCANNED, *zip(*rows, strict=True))
                rows, held = [], 0
        if run:
            yield batch(_SCANNED, *zip(run.segment(part), strict=True))

    return work


def _joined(last: bool):
    def work(rows: pa.Table) -> pa.Table:
        at = sorted(rows.to_pylist(), key=lambda r: (r["part"], r["seq"]))
        total = reduce(Sum.__add__, [Sum(*(r[n] for n in Sum.NAMES)) for r in at])
        ways = tree([restored(r["costs"], r["audits"]) for r in at])
        if last:
            ways = matrix({(BEGIN, BEGIN): best(ways)})
        row = (at[0]["conv_id"], at[0]["part"] // FAN_IN, at[0]["part"] % FAN_IN, *total.row(), *stored(ways))
        return pa.Table.from_batches([batch(_TREE, *([x] for x in row))])

    return work


def tree_of(segments: DataFrame) -> DataFrame:
    """One row for each conversation of the segments: its sums, and its cost and audit as the first entries of costs and audits."""
    rows = segments.select(*_TREE.names)
    parts = segments.agg(F.max("part")).first()[0]
    while parts:  # a level divides part by FAN_IN and leaves the rest as the place among neighbours
        rows, parts = rows.groupBy("conv_id", "part").applyInArrow(_joined(False), _TREE_DDL), parts // FAN_IN
    return rows.groupBy("conv_id").applyInArrow(_joined(True), _TREE_DDL)


_FINISHED = pa.schema([("conv_id", pa.int64()), *_COUNTS, ("gaps", pa.int64()), *_DONE])
_FINISHED_DDL = f"conv_id long, blank long, duplicate long, truncated long, illegal long, gaps long, {_DONE_DDL}"


def _stream(messages: bool):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, total, edits, sha, place = None, None, None, None, 0

        def told(turns: Iterable[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
            nonlocal place
            out = list(turns)
            for k, (r, t) in enumerate(out, place):
                sha.update((f"\n{r}:{t}" if k else f"{r}:{t}").encode())
            if out and messages:
                yield batch(_FINISHED, *([x] for x in (head["conv_id"], *[None] * 8, place, [{"role": r, "text": t} for r, t in out])))
            place += len(out)

        def ended() -> Iterator[pa.RecordBatch]:
            if head:
                yield from told(edits.inserted())
                yield batch(_FINISHED, *([x] for x in (head["conv_id"], *total.row()[:4], total.gaps, head["costs"][0], edits.audit.decode(), sha.hexdigest(), None, None)))

        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if r["costs"]:
                    yield from ended()
                    head, total, edits, sha, place = r, Sum(*(r[n] for n in Sum.NAMES)), Edits(zlib.decompress(r["audits"][0])), hashlib.sha256(), 0
                else:
                    yield from told(edits.turns(r["roles"], r["texts"]))
        yield from ended()

    return work


def dealt(rows: DataFrame) -> DataFrame:
    """Turns, headers and markers in the order of the scan; rows(conv_id, turn, role, text) have no null role or text."""
    every = rows.select("conv_id").distinct().selectExpr("conv_id", "true AS header", "false AS mark", "0L AS chunk")
    text = F.col("text")
    turns = collapsed(rows.where("stays").select("conv_id", "turn", "role", "text", "twice")).withColumns({
        "copies": F.col("copies") * F.when(F.col("twice"), 2).otherwise(1), "header": F.lit(False), "mark": F.lit(False), "hash": F.unhex(F.sha2(text, 256)),
        "blank": ~text.rlike(r"[^\x20\x09-\x0D]"), "truncated": ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"),
    }).drop("twice")
    marks = turns.groupBy("conv_id", "role", "hash").agg(F.min("turn").alias("turn"), F.bool_or(F.col("turn").isNull()).alias("none"))
    marks = marks.selectExpr("conv_id", "role", "hash", "CASE WHEN NOT none THEN turn END AS turn", "false AS header", "true AS mark", "0L AS chunk")
    order = [F.asc_nulls_first("conv_id"), F.desc("header"), F.asc_nulls_first("turn"), F.col("role"), F.col("hash"), F.col("chunk")]
    both = turns.unionByName(marks, allowMissingColumns=True).unionByName(every, allowMissingColumns=True)
    return both.repartitionByRange(*order).sortWithinPartitions(*order, F.desc("mark")).select("conv_id", "header", "mark", "turn", "role", "text", "blank", "truncated", "copies")


def damaged(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, stays, twice): the faults that crc32 of conv_id:turn, modulo 20, puts in."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    code, role, text = F.crc32(F.concat(said[0], F.lit(":"), said[1]).cast("binary")) % 20, said[2], said[3]
    new = F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(code == 4, "user").otherwise(role).alias("role"), new.alias("text"), (code != 0).alias("stays"), (code == 3).alias("twice"))


def undamaged(rows: DataFrame) -> DataFrame:
    said = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *said, F.lit(True).alias("stays"), F.lit(False).alias("twice"))


def solve(rows: DataFrame, messages: bool = False) -> DataFrame:
    """conv_id, counts, cost, audit, repaired_sha256 of every conversation; with ``messages`` also rows of place and messages, which have no cost."""
    spark = rows.sparkSession
    small_batches(spark)
    scanned = cut(dealt(rows).mapInArrow(_scan(messages), _SCANNED_DDL))
    gaps = F.when(F.col("first_turn").isNull(), 0).otherwise(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns")).cast("long").alias("gaps")
    whole = scanned.where("whole").select("conv_id", "blank", "duplicate", "truncated", "illegal", gaps, *(n for n, _ in _DONE))
    segments = scanned.where("not whole")
    if segments.isEmpty():
        return whole
    parts = segments.select(*_TREE.names, "roles", "texts").withColumns({"costs": F.lit(None).cast("array<long>"), "audits": F.lit(None).cast("array<binary>")})
    heads = tree_of(segments).withColumns({"part": F.lit(-1), "seq": F.lit(0).cast("long")})
    rows = parts.unionByName(heads, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return whole.unionByName(rows.mapInArrow(_stream(messages), _FINISHED_DDL))


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place, role, text of the repaired conversations of rows(conv_id, turn, role, text)."""
    found = solve(undamaged(rows), messages=True).where("messages is not null").select("conv_id", "place", F.posexplode("messages").alias("k", "m"))
    return found.select("conv_id", (F.col("place") + F.col("k")).alias("place"), "m.role", "m.text")


def digest(rows: DataFrame) -> DataFrame:
    """The repair of damaged rows: one row for each conversation of the table."""
    return solve(damaged(rows)).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
