"""Conversation structure repair: cheapest edits by divide and conquer over four-state cost vectors.

A repaired conversation is ``(s?(ua)+)?`` in role initials, so four states tell what may
follow: at the start, after system, after user, after assistant. A row, a block of rows and
a block of blocks are the same thing, a transfer: for every pair of states the least cost of
getting from one to the other and the rank of its least audit. Forward and backward vectors
meet in the middle of a list of transfers, the audit-least of the cheapest crossings is
kept, and both halves are solved alike, in space linear in the list.

Rows are dealt by ranges of (conversation, turn, ...), so a conversation with most of the
rows lies in many partitions, each of which cuts its part into blocks of bounded size. Only
transfers of blocks, never their rows, meet in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pickwright.llm.common import stored

#: A block holds at most so many rows, and ends with the row that brings it to so many characters of text.
BLOCK_ROWS, BLOCK_CHARS = 1024, 1 << 22
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
NEVER = 1 << 60
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: State after an insert, by state, and inserts that end a conversation in that state.
AFTER_INSERT, TO_END = (2, 2, 3, 2), (0, 2, 1, 0)
WHITE = " \t\n\x0b\x0c\r"
ROLE = {2: "user", 3: "assistant"}


def kept_state(state: int, initial: str) -> int | None:
    """The state after a row with this initial, or None where it may not follow."""
    if initial == "s":
        return 1 if state == 0 else None
    if initial == "u":
        return 2 if state != 2 else None
    return 3 if initial == "a" and state == 2 else None


def edits_of(initial: str, fault: int) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after): cost and edits of a row, inserts before it included; of equal costs the ASCII-least edits."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    extra = CUT if fault == TRUNCATED else 0
    for before in range(4):
        state, inserts = before, 0
        while inserts < 3:
            ways = [(state, DELETE, "D")]
            if fault not in (BLANK, DUPLICATE):
                ways.append((AFTER_INSERT[state], REROLE + extra, "R"))
                kept = kept_state(state, initial)
                if kept is not None:
                    ways.append((kept, extra, "K"))
            for after, cost, edit in ways:
                way = (INSERT * inserts + cost, "I" * inserts + edit)
                best[before, after] = min(best.get((before, after), (NEVER, "")), way)
            state, inserts = AFTER_INSERT[state], inserts + 1
    return best


SAME = tuple(tuple((0, 0) if p == r else (NEVER, 0) for r in range(4)) for p in range(4))


class Solver:
    """Vectors and transfers, with the steps that were met before; one is made in each task."""

    def __init__(self):
        self.rows: dict = {}
        self.ahead: dict = {}
        self.behind: dict = {}

    def row(self, initial: str, fault: int) -> tuple:
        """(edits, transfer) of a row; all initials that fit nowhere are alike."""
        key = (initial if initial in ("s", "u", "a") else "", fault)
        if key not in self.rows:
            edits = edits_of(*key)
            rank = {e: k for k, e in enumerate(sorted({e for _, e in edits.values()}))}
            table = tuple(tuple((edits[p, r][0], rank[edits[p, r][1]]) if (p, r) in edits else (NEVER, 0) for r in range(4)) for p in range(4))
            self.rows[key] = edits, table
        return self.rows[key]

    def forward(self, vector: tuple, table: tuple) -> tuple:
        """((cost, rank) by state after, less their least cost; that cost). Ranks order the least audits of the four states."""
        key = (vector, table)
        if key not in self.ahead:
            if len(self.ahead) > 1 << 15:
                self.ahead.clear()
            ways = [min((vector[p][0] + table[p][r][0], vector[p][1], table[p][r][1]) for p in range(4)) for r in range(4)]
            ways = [w if w[0] < NEVER else (NEVER, 0, 0) for w in ways]
            order = {w: k for k, w in enumerate(sorted({w[1:] for w in ways}))}
            least = min(w[0] for w in ways)
            self.ahead[key] = tuple((w[0] - least if w[0] < NEVER else NEVER, order[w[1:]]) for w in ways), least
        return self.ahead[key]

    def backward(self, vector: tuple, table: tuple) -> tuple:
        """Costs by state before, less their least; only differences matter for the choice of a crossing."""
        key = (vector, table)
        if key not in self.behind:
            if len(self.behind) > 1 << 15:
                self.behind.clear()
            costs = [min(min(table[p][r][0] + vector[r], NEVER) for r in range(4)) for p in range(4)]
            least = min(costs)
            self.behind[key] = tuple(c - least if c < NEVER else NEVER for c in costs)
        return self.behind[key]

    def over(self, tables: list[tuple], start: int) -> tuple:
        """(vector, cost) after ``tables`` from state ``start``."""
        vector, total = SAME[start], 0
        for table in tables:
            vector, more = self.forward(vector, table)
            total += more
        return vector, total

    def joined(self, tables: list[tuple]) -> tuple:
        """The transfer of a list of transfers."""
        made = []
        for start in range(4):
            vector, total = self.over(tables, start)
            made.append(tuple((c + total, k) if c < NEVER else (NEVER, 0) for c, k in vector))
        return tuple(made)

    def crossings(self, tables: list[tuple], start: int, end: int) -> list[int]:
        """The state after each of ``tables`` on the audit-least of the cheapest ways from ``start`` to ``end``."""
        found: list[int] = []

        def solve(lo: int, hi: int, a: int, b: int) -> None:
            if hi - lo == 1:
                found.append(b)
                return
            mid = (lo + hi) // 2
            vector, _ = self.over(tables[lo:mid], a)
            rest = tuple(0 if s == b else NEVER for s in range(4))
            for k in range(hi - 1, mid - 1, -1):
                rest = self.backward(rest, tables[k])
            state = min(range(4), key=lambda s: (vector[s][0] + rest[s], vector[s][1]))
            solve(lo, mid, a, state)
            solve(mid, hi, state, b)

        if tables:
            solve(0, len(tables), start, end)
        return found

    def end(self, table: tuple) -> tuple[int, int]:
        """(state, cost) of the audit-least cheapest whole conversation."""
        state = min(range(4), key=lambda s: (table[0][s][0] + INSERT * TO_END[s], table[0][s][1]))
        return state, table[0][state][0] + INSERT * TO_END[state]

    def edited(self, rows: list[tuple[str, str, int]], start: int, end: int, last: bool) -> tuple[str, list[dict]]:
        """Audit and repaired rows of a block of rows (role, text, fault); ``last`` ends the conversation."""
        known = [self.row(role[:1], fault) for role, _, fault in rows]
        states = self.crossings([t for _, t in known], start, end)
        audit, repaired, state = [], [], start
        for (role, text, _), (edits, _), after in zip(rows, known, states, strict=True):
            audit.append(edits[state, after][1])
            for edit in audit[-1]:
                if edit != "D":
                    state = AFTER_INSERT[state] if edit in "IR" else after
                    repaired.append({"role": role if edit == "K" else ROLE[state], "text": "" if edit == "I" else text})
            state = after
        for _ in range(TO_END[state] if last else 0):
            state = AFTER_INSERT[state]
            audit.append("I")
            repaired.append({"role": ROLE[state], "text": ""})
        return "".join(audit), repaired


def fault_of(text: str, seen: bool) -> int:
    left = text.rstrip(WHITE)
    if not left:
        return BLANK
    return DUPLICATE if seen else FINE if left[-1] in ".!?" else TRUNCATED


STATS = ["n_rows", "blank", "duplicate", "truncated", "illegal"]


class Part:
    """A run of rows of one conversation: counts, turns at its edges, roles at its edges."""

    def __init__(self):
        self.n_rows = self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.first_turn = self.last_turn = self.first_role = self.last_role = None

    def add(self, turn, role: str, fault: int) -> None:
        one = Part()
        one.n_rows, one.blank, one.duplicate, one.truncated = 1, int(fault == BLANK), int(fault == DUPLICATE), int(fault == TRUNCATED)
        one.first_role = one.last_role = role[:1]
        if turn is not None:
            one.first_turn, one.last_turn, one.n_turns = turn, turn, 1
        self.join(one)

    def join(self, other: Part) -> None:
        """``other`` follows; turns never fall."""
        if self.n_rows and other.n_rows:
            self.illegal += (self.last_role + other.first_role) not in ("su", "ua", "au")
        self.n_turns += other.n_turns - (other.n_turns > 0 and self.n_turns > 0 and self.last_turn == other.first_turn)
        if other.n_turns:
            self.first_turn = other.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = other.last_turn
        if other.n_rows:
            self.first_role = other.first_role if not self.n_rows else self.first_role
            self.last_role = other.last_role
        for name in STATS:
            setattr(self, name, getattr(self, name) + getattr(other, name))

    def gaps(self) -> int:
        return self.last_turn - self.first_turn + 1 - self.n_turns if self.n_turns else 0

    @staticmethod
    def of(row: dict) -> Part:
        made = Part()
        made.__dict__.update({k: row[k] for k in made.__dict__})
        return made


COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
TURNS = "array<struct<role: string, text: string>>"
EDGES = "n_rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, n_turns bigint, first_turn bigint, last_turn bigint, first_role string, last_role string"


def _counts(part: Part, cost: int) -> dict:
    return {"gaps": part.gaps(), "blank": part.blank, "duplicate": part.duplicate, "truncated": part.truncated, "illegal": part.illegal, "cost": cost}


def _flat(table: tuple) -> dict:
    return {"costs": [c for line in table for c, _ in line], "ranks": [k for line in table for _, k in line]}


def _table(row: dict) -> tuple:
    pairs = list(zip(row["costs"], row["ranks"], strict=True))
    return tuple(tuple(pairs[4 * p : 4 * p + 4]) for p in range(4))


def _batches(rows: Iterable[dict], schema: pa.Schema, chars: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most 512 rows; a large row closes its batch."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(t["text"]) for name in ("rows", "repaired") for t in (row.get(name) or []))
        if len(held) == 512 or size > chars:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _each(df: DataFrame, schema: T.StructType, fn: Callable[[Solver, dict], Iterable[dict]]) -> DataFrame:
    """Rows that ``fn`` makes of every row; each task has its own solver."""
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver()
        yield from _batches((made for batch in batches for i in range(batch.num_rows) for made in fn(solver, batch.slice(i, 1).to_pylist()[0])), kinds)

    return df.mapInArrow(run, schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows in order as (conversation, turn, role, text, seen before); text None: the conversation has a row that was dropped."""
    marked = last = None
    for batch in batches:
        for conv, turn, role, code, kind, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            key = (conv, turn, role, code)
            if kind == 0:
                marked = key
            elif kind == 1:
                yield conv, turn, role, text, key in (marked, last)
                last = key
            else:
                yield conv, None, "", None, False


def _cut(part: int, batches: Iterator[pa.RecordBatch], most_rows: int, most_chars: int) -> Iterator[dict]:
    """A sorted partition as pieces: whole repaired conversations, and blocks and segments of those that may go on elsewhere.

    The first and the last conversation of a partition may have rows in others. So may one of
    more than a block; all others are solved on the spot.
    """
    solver = Solver()
    conv = None
    begun = first = False
    rows: list[tuple[str, str, int]] = []
    here, whole, size, seq, tables = Part(), Part(), 0, 0, []

    def block() -> dict:
        nonlocal rows, here, size, seq
        table = solver.joined([solver.row(role[:1], fault)[1] for role, _, fault in rows])
        tables.append(table)
        whole.join(here)
        made = {"conv_id": conv, "what": "block", "part": part, "seq": seq, **_flat(table), "rows": [{"role": a, "text": b, "fault": c} for a, b, c in rows]}
        rows, here, size, seq = [], Part(), 0, seq + 1
        return made

    def close(is_last: bool) -> Iterator[dict]:
        nonlocal rows, here, whole, size, seq, tables
        if first or is_last or seq:
            yield block()
            yield {"conv_id": conv, "what": "segment", "part": part, "seq": seq, **_flat(solver.joined(tables)), **whole.__dict__}
        else:
            table = solver.joined([solver.row(role[:1], fault)[1] for role, _, fault in rows])
            state, cost = solver.end(table)
            audit, repaired = solver.edited(rows, 0, state, True)
            yield {"conv_id": conv, "what": "whole", **_counts(here, cost), "audit": audit, "repaired": repaired}
        rows, here, whole, size, seq, tables = [], Part(), Part(), 0, 0, []

    for key, turn, role, text, seen in _read(batches):
        if not begun or key != conv:
            if begun:
                yield from close(False)
            first, begun, conv = not begun, True, key
        if text is None:
            continue
        if len(rows) >= most_rows or size >= most_chars:
            yield block()
        fault = fault_of(text, seen)
        here.add(turn, role, fault)
        rows.append((role, text, fault))
        size += len(text)
    if begun:
        yield from close(True)


def repair(turns: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Pieces of repaired conversations: conv_id, ``piece`` (from 0), ``pieces``, counts, ``cost``, ``audit`` and ``repaired`` rows of the piece.

    ``turns``: conv_id, turn, role, text and optionally ``gone``, true for a row that is only there to name its
    conversation. Null role and text are one space; a null conv_id is a conversation. Rows go by turn, nulls
    first; ties by role, then md5 of the text. A row is a duplicate where role and text came earlier. A conversation
    without rows has one empty piece. One of up to a block of rows is one piece, unless it lies at a partition's edge.
    A role that begins with none of s, u, a fits nowhere as it is, an empty one either. An empty table has no rows;
    other columns are ignored.
    """
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    plain = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"))
    coded = plain.withColumn("code", F.unhex(F.md5(F.col("text").cast("binary"))))
    # keys only: a place where role and text repeat an earlier turn gets a marker that sorts before its rows
    places = coded.where("not gone").select("conv_id", "turn", "role", "code").distinct()
    order = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    firsts = places.groupBy("conv_id", "role", "code").agg(F.min(order).alias("least"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("code").alias("k"), "least")
    later = places.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("code") == F.col("k"))).where(order > F.col("least"))
    key = ["conv_id", "turn", "role", "code"]
    marks = later.select(*key, F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"))
    own = coded.select(
        "conv_id", "turn", "role", F.when(~F.col("gone"), F.col("code")).alias("code"), F.when(F.col("gone"), 2).otherwise(1).alias("kind"), F.when(~F.col("gone"), F.col("text")).alias("text")
    )
    sorted_ = own.unionByName(marks).repartitionByRange(*key).sortWithinPartitions(*key, "kind")
    fields = T.StructType([T.StructField("conv_id", turns.schema["conv_id"].dataType), *T._parse_datatype_string(
        f"what string, part int, seq int, cost bigint, gaps bigint, {EDGES}, audit string, repaired {TURNS}, rows array<struct<role: string, text: string, fault: int>>, costs array<bigint>, ranks array<int>"
    )])
    kinds = to_arrow_schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_cut(TaskContext.get().partitionId(), batches, block_rows, block_chars), kinds)

    cuts = stored(sorted_.mapInArrow(cut, fields), "conversations")
    counts = [c.split()[0] for c in COUNTS.split(", ")]
    whole = cuts.where("what = 'whole'").select("conv_id", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), *counts, "audit", "repaired")
    return whole.unionByName(_open(cuts, fields, counts))


def _open(cuts: DataFrame, fields: T.StructType, counts: list[str]) -> DataFrame:
    """Pieces of the conversations that are cut. Segments of a conversation are as many as partitions that hold it, blocks of a segment as fit a partition."""
    own = T.StructType([fields["conv_id"]])
    segments = cuts.where("what = 'segment'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "costs", "ranks", *[c.split()[0] for c in EDGES.split(", ")]))).alias("parts"))

    def between(solver: Solver, row: dict) -> Iterator[dict]:
        parts, total, before, state = row["parts"], Part(), 0, 0
        for p in parts:
            total.join(Part.of(p))
        tables = [_table(p) for p in parts]
        end, cost = solver.end(solver.joined(tables))
        pieces = sum(p["seq"] for p in parts)
        for k, (p, after) in enumerate(zip(parts, solver.crossings(tables, 0, end), strict=True)):
            yield {"conv_id": row["conv_id"], "in_part": p["part"], "first_piece": before, "pieces": pieces, "start": state, "stop": after, "closes": k == len(parts) - 1, **_counts(total, cost)}
            before, state = before + p["seq"], after

    told = T.StructType([*own, *T._parse_datatype_string(f"in_part int, first_piece int, pieces int, start int, stop int, closes boolean, {COUNTS}")])
    ends = _each(segments, told, between).withColumnRenamed("conv_id", "c")
    blocks = cuts.where("what = 'block'").select("conv_id", "part", "seq", "costs", "ranks")
    in_parts = blocks.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "costs", "ranks"))).alias("blocks"))
    met = in_parts.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("in_part"))).drop("c", "in_part")

    def inside(solver: Solver, row: dict) -> Iterator[dict]:
        state, made = row["start"], row["blocks"]
        for b, after in zip(made, solver.crossings([_table(b) for b in made], state, row["stop"]), strict=True):
            last = row["closes"] and b["seq"] == len(made) - 1
            yield {"conv_id": row["conv_id"], "in_part": row["part"], "at": b["seq"], "piece": row["first_piece"] + b["seq"], "pieces": row["pieces"], "start": state, "stop": after, "closes": last, **{c: row[c] for c in counts}}
            state = after

    placed = T.StructType([*own, *T._parse_datatype_string(f"in_part int, at int, piece int, pieces int, start int, stop int, closes boolean, {COUNTS}")])
    states = _each(met, placed, inside).withColumnRenamed("conv_id", "c")
    texts = cuts.where("what = 'block'").select("conv_id", "part", "seq", "rows")
    ready = texts.join(states, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("in_part")) & (F.col("seq") == F.col("at"))).drop("c", "in_part", "at", "part", "seq")

    def edit(solver: Solver, row: dict) -> Iterator[dict]:
        audit, repaired = solver.edited([(r["role"], r["text"], r["fault"]) for r in row["rows"]], row["start"], row["stop"], row["closes"])
        yield {"conv_id": row["conv_id"], "piece": row["piece"], "pieces": row["pieces"], **{c: row[c] for c in counts}, "audit": audit, "repaired": repaired}

    out = T.StructType([*own, *T._parse_datatype_string(f"piece int, pieces int, {COUNTS}, audit string, repaired {TURNS}")])
    return _each(ready, out, edit)


def text_of(repaired: Column) -> Column:
    """``role:text`` lines of repaired rows."""
    return F.array_join(F.transform(repaired, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def digests(pieces: DataFrame) -> DataFrame:
    """A row per conversation: its counts, whole ``audit`` and ``repaired_sha256``.

    The digest of a conversation in several pieces is inherently sequential: its pieces, one row each, stream in
    order through one hash, so the task holds one of them at a time.
    """
    counts = [c.split()[0] for c in COUNTS.split(", ")]
    pieces = stored(pieces.select("conv_id", "piece", "pieces", *counts, "audit", F.when(F.col("pieces") == 1, F.sha2(text_of(F.col("repaired")), 256)).alias("digest"), F.when(F.col("pieces") > 1, text_of(F.col("repaired"))).alias("lines")), "pieces")
    one = pieces.where("pieces = 1").select("conv_id", *counts, "audit", F.col("digest").alias("repaired_sha256"))
    several = pieces.where("pieces > 1").select("conv_id", "piece", "pieces", *counts, "audit", "lines")
    names = one.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, seen, state = [], False, hashlib.sha256()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["piece"] == 0:
                    audit, seen, state = [], False, hashlib.sha256()
                audit.append(row["audit"])
                if row["lines"]:
                    state.update(("\n" * seen + row["lines"]).encode())
                    seen = True
                if row["piece"] == row["pieces"] - 1:
                    yield pa.RecordBatch.from_pylist([{**{n: row[n] for n in names[:-2]}, "audit": "".join(audit), "repaired_sha256": state.hexdigest()}], kinds)

    kinds = to_arrow_schema(one.schema)
    return one.unionByName(several.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(run, one.schema))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by crc32 of ``conv_id:turn`` modulo 20; a dropped row stays as ``gone``."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    made = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault"))
    hurt = made.select(
        "conv_id", "turn",
        F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fault") == 0).alias("gone"),
        F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
    )
    return hurt.select("conv_id", "turn", "role", "text", "gone", F.explode("copies").alias("copy")).drop("copy")
