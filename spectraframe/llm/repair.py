"""Repair of conversations' structure: the cheapest edits after which roles read `(s?(ua)+)?`, by a rank-compressed dynamic programme.

A conversation's rows are layers. Between two layers there are four states: nothing yet, or the last role's initial. An edit of a row
is a macro: up to two inserted turns, then the row kept, given another role, or deleted. Macros end with the row's own edit, so their codes
are prefix-free, and so are the audits (codes end to end) of any two ways to one layer: which of them is less is settled where they
first differ, whatever follows. So a state needs no audit but the rank of its audit among the layer's, which follows from the
parent's rank and the macro's; each layer keeps parent pointers, and only the winner's audit is spelled, backwards. Runs
longer than two insertions never win: two in a row change nothing but at the end, behind a first `s`.

Rows are sorted over all tasks, so a long conversation is cut into chunks wherever a task ends, or after `CHUNK_ROWS` rows or
`CHUNK_CHARS` characters. A conversation that lies inside a task in one chunk is repaired at once. Of the others, each chunk is
solved for all four states before it; sixteen costs and ranks a chunk are then put together in order, and chunks are spelled with
their states known. Their digest is made by one task, in order, a batch at a time.

Faults, a row's first one: blank (no character but [\\x20\\x09-\\x0D]), duplicate (role and text seen earlier in the conversation),
truncated (its last other character is not one of [.!?]). Blank and duplicate rows are deleted.

Defined cases: a null role or text is one space; rows without conversation id are one conversation; turns that are null come first; rows
of one turn are ordered by role, then by the SHA-256 of the text, equal ones stand together; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_sized, small_batches, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs
CHUNK_ROWS, CHUNK_CHARS = 4096, 1 << 22
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
CODES = sorted("I" * n + edit for n in range(3) for edit in "DKR")
_LEGAL = {"su", "ua", "au"}
_LAST = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")
_TURN = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what an added or changed turn is
_NAME = {USER: "user", ASSISTANT: "assistant"}
_ENDING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def _kept(state: int, initial: str) -> int | None:
    """The state after a kept row."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    return _TURN[state] if _NAME[_TURN[state]][0] == initial else None


@functools.cache
def _edits(initial: str, fault: str) -> list[tuple[int, int, int, int]]:
    """(state, code, cost, next state) of all macros of a row."""
    out = []
    for state in range(4):
        for k, code in enumerate(CODES):
            now = state
            for _ in code[:-1]:
                now = _TURN[now]
            cost, edit = INSERT * (len(code) - 1), code[-1]
            if edit == "D":
                after, cost = now, cost + DELETE
            elif fault in ("blank", "duplicate"):
                continue
            else:
                after = _TURN[now] if edit == "R" else _kept(now, initial)
                cost += (REROLE if edit == "R" else KEEP) + TRUNCATED * (fault == "truncated")
            if after is not None:
                out.append((state, k, cost, after))
    return out


class Paths:
    """The best ways through some rows from one state: by last state the cost, and the rank of the audit; parents of each layer."""

    def __init__(self, rows: list[tuple[str, str]], start: int):
        """rows: (initial, fault)."""
        self.cost, self.rank = {start: 0}, {start: 0}
        self.parents: list[dict[int, tuple[int, int]]] = []
        for initial, fault in rows:
            best: dict[int, tuple[int, int, int, int]] = {}
            for state, code, cost, after in _edits(initial, fault):
                if state in self.cost:
                    way = (self.cost[state] + cost, self.rank[state], code, state)
                    if after not in best or way < best[after]:
                        best[after] = way
            order = {way: k for k, way in enumerate(sorted({way[1:3] for way in best.values()}))}
            self.cost = {s: way[0] for s, way in best.items()}
            self.rank = {s: order[way[1:3]] for s, way in best.items()}
            self.parents.append({s: (way[3], way[2]) for s, way in best.items()})

    def codes(self, end: int) -> list[str]:
        out = []
        for layer in reversed(self.parents):
            end, code = layer[end]
            out.append(CODES[code])
        return out[::-1]


def ending(cost: dict[int, int], rank: dict[int, int]) -> tuple[int, int]:
    """(cost, state) of the best end, closing turns included."""
    return min((c + INSERT * len(_ENDING[s]), rank[s], s) for s, c in cost.items())[::2]


def repaired(rows: list[tuple[str, str]], codes: list[str], start: int, closing: str = "") -> list[str]:
    """The lines `role:text` that the edits give; rows: (role, text)."""
    out, state = [], start

    def add(text: str) -> None:
        nonlocal state
        state = _TURN[state]
        out.append(f"{_NAME[state]}:{text}")

    for (role, text), code in zip(rows, codes, strict=True):
        for _ in code[:-1]:
            add("")
        if code[-1] == "R":
            add(text)
        elif code[-1] == "K":
            state = _kept(state, role[:1])
            out.append(f"{role}:{text}")
    for _ in closing:
        add("")
    return out


def fault_of(text: str, seen: bool) -> str:
    last = _LAST.search(text)
    return "blank" if not last else "duplicate" if seen else "" if last[0] in ".!?" else "truncated"


_COUNTS = ("blank", "duplicate", "truncated")


def _counted(rows: list[tuple], faults: list[str]) -> dict:
    """What a chunk says of itself; rows: (turn, role, text)."""
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    found = {k: faults.count(k) for k in _COUNTS} | {"illegal": sum(a + b not in _LEGAL for a, b in pairwise(initials))}
    return found | {"low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)), "first": initials[0], "last": initials[-1]}


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_CHUNK = "part int, seq int, low long, high long, turns long, first string, last string, costs array<long>, ranks array<long>, roles array<string>, texts array<string>, faults array<string>"


def _whole(rows: list[tuple], faults: list[str]) -> dict:
    """The result of a conversation in one chunk."""
    own = _counted(rows, faults)
    paths = Paths([(r[1][:1], f) for r, f in zip(rows, faults, strict=True)], NOTHING)
    cost, end = ending(paths.cost, paths.rank)
    codes = paths.codes(end)
    lines = repaired([r[1:] for r in rows], codes, NOTHING, _ENDING[end])
    return {k: own[k] for k in (*_COUNTS, "illegal")} | {"gaps": _gaps(own["low"], own["high"], own["turns"]), "cost": cost, "audit": "".join(codes) + _ENDING[end], "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def _part(rows: list[tuple], faults: list[str], part: int, seq: int) -> dict:
    """A chunk for all states before it: cost and rank by 4 * state before + state after, -1 where there is no way."""
    kinds = [(r[1][:1], f) for r, f in zip(rows, faults, strict=True)]
    paths = [Paths(kinds, s) for s in range(4)]
    table = [[(p.cost if k == 0 else p.rank).get(e, -1) for p in paths for e in range(4)] for k in range(2)]
    return _counted(rows, faults) | {"part": part, "seq": seq, "costs": table[0], "ranks": table[1], "roles": [r[1] for r in rows], "texts": [r[2] for r in rows], "faults": faults}


def _chunks(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (conv, turn, role, text, copies, seen), sorted, to results of whole conversations and chunks of the others. Those at either end
    of a task can go on in another."""
    part, seq = TaskContext.get().partitionId(), 0
    conv, edge = None, True  # edge: nothing of another conversation came before in this task
    rows: list[tuple] = []
    faults: list[str] = []
    chars, cut = 0, False
    out: list[dict] = []

    def flush(more: bool) -> None:
        """more: this conversation may have other rows behind."""
        nonlocal rows, faults, chars, cut, seq
        if rows and (more or edge or cut):
            out.append({"conv": conv} | _part(rows, faults, part, seq))
            seq += 1
        elif rows:
            out.append({"conv": conv} | _whole(rows, faults))
        rows, faults, chars, cut = [], [], 0, more

    started = False
    for batch in batches:
        for r in batch.to_pylist():
            if not started or r["conv"] != conv:
                flush(False)
                edge, started, conv = not started, True, r["conv"]
            for k in range(r["copies"]):
                if len(rows) >= CHUNK_ROWS or chars > CHUNK_CHARS:
                    flush(True)
                rows.append((r["turn"], r["role"], r["text"]))
                faults.append(fault_of(r["text"], r["seen"] or k > 0))
                chars += len(r["text"])
        yield pa.RecordBatch.from_pylist(out, schema)
        out = []
    flush(True)
    yield pa.RecordBatch.from_pylist(out, schema)


def _joined(chunks: list[dict]) -> list[dict]:
    """A conversation's chunks in order, with the state before and after each; the first one with the result's numbers."""
    cost, rank, parents = {NOTHING: 0}, {NOTHING: 0}, []
    for c in chunks:
        best: dict[int, tuple] = {}
        for s in cost:
            for e in range(4):
                if c["costs"][4 * s + e] >= 0:
                    way = (cost[s] + c["costs"][4 * s + e], rank[s], c["ranks"][4 * s + e], s)
                    best[e] = min(best.get(e, way), way)
        order = {way: k for k, way in enumerate(sorted({way[1:3] for way in best.values()}))}
        cost, rank = {e: way[0] for e, way in best.items()}, {e: order[way[1:3]] for e, way in best.items()}
        parents.append({e: way[3] for e, way in best.items()})
    total, end = ending(cost, rank)
    lows, highs = ([c[k] for c in chunks if c[k] is not None] for k in ("low", "high"))
    shared = sum(a == b for a, b in zip(lows[1:], highs[:-1], strict=True))  # a turn that two chunks have
    found = {k: sum(c[k] for c in chunks) for k in (*_COUNTS, "illegal")}
    found["illegal"] += sum(a["last"] + b["first"] not in _LEGAL for a, b in pairwise(chunks))
    found |= {"cost": total, "gaps": _gaps(min(lows, default=None), max(highs, default=None), sum(c["turns"] for c in chunks) - shared)}
    out, closing = [], _ENDING[end]
    for c, up in zip(reversed(chunks), reversed(parents), strict=True):
        out.append({"part": c["part"], "seq": c["seq"], "start": up[end], "end": end, "closing": closing} | found)
        end, closing = up[end], ""
    return out


def _spelled(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Chunks in order, with their states, to a row a conversation; the texts of a batch are there at a time."""
    now, found, audit, digest, empty, started = None, {}, [], hashlib.sha256(), True, False

    def result() -> list[dict]:
        return [{"conv": now} | found | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}] if started else []

    for batch in batches:
        out = []
        for c in batch.to_pylist():
            if not started or c["conv"] != now:
                out += result()
                now, found, audit, digest, empty, started = c["conv"], {k: c[k] for k in ("gaps", *_COUNTS, "illegal", "cost")}, [], hashlib.sha256(), True, True
            codes = Paths([(role[:1], f) for role, f in zip(c["roles"], c["faults"], strict=True)], c["start"]).codes(c["end"])
            audit.append("".join(codes) + c["closing"])
            for line in repaired(list(zip(c["roles"], c["texts"], strict=True)), codes, c["start"], c["closing"]):
                digest.update(("" if empty else "\n").encode() + line.encode())
                empty = False
        yield pa.RecordBatch.from_pylist(out, schema)
    yield pa.RecordBatch.from_pylist(result(), schema)


def _arrow(df_schema: str, kind: str) -> pa.Schema:
    """The Arrow schema of `conv` and columns named in DDL."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(f"conv {kind}, {df_schema}"))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation."""
    small_batches(turns.sparkSession, 2000)
    kind = turns.select(conv_col).schema[0].dataType.simpleString()
    space = F.lit(" ")
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, space).alias("role"), F.coalesce(text_col, space).alias("text"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("digest", F.sha2("text", 256))
    name = F.col("conv").cast("string")
    rows = written(rows.withColumn("same", F.concat(F.coalesce(F.length(name), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(name, F.lit("")), "role", "digest")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = written(rows.groupBy("same").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")))
    marked = join_sized(rows, firsts, ["same"], "n", rows.count()).withColumn("seen", ~place.eqNullSafe(F.col("earliest")))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    ordered = marked.select("conv", "turn", "role", "text", "copies", "seen", "digest").repartitionByRange(*order).sortWithinPartitions(*order).drop("digest")
    schema = f"conv {kind}, {RESULT}, {_CHUNK}"
    arrow, arrow_result = _arrow(f"{RESULT}, {_CHUNK}", kind), _arrow(RESULT, kind)
    states = f"part int, seq int, start int, end int, closing string, {RESULT.split(', audit')[0]}"
    arrow_states = _arrow(states, kind).remove(0)
    pieces = written(ordered.mapInArrow(lambda batches: _chunks(batches, arrow), schema))
    open_ = pieces.where("seq IS NOT NULL")

    def fold(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(_joined(sorted(table.to_pylist(), key=lambda c: (c["part"], c["seq"]))), arrow_states)

    chosen = open_.drop("roles", "texts", "faults", "audit", "repaired_sha256").groupBy("conv").applyInArrow(fold, states)  # a row a chunk
    ready = open_.select("conv", "part", "seq", "roles", "texts", "faults").join(chosen, ["part", "seq"])
    spelled = ready.repartition("conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(lambda batches: _spelled(batches, arrow_result), f"conv {kind}, {RESULT}")
    return pieces.where("seq IS NULL").select("conv", *arrow_result.names[1:]).unionByName(spelled)


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text) with the faults that the CRC-32 of `conv:turn`, modulo 20, gives them: 0 drops the row, 1 empties its
    text, 2 takes its [.!?], 3 repeats it, 4 makes it a user's. Nulls are one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, space).alias("role"), F.coalesce(text_col, space).alias("text"), (F.crc32(key) % 20).alias("way"))
    way, text = F.col("way"), F.col("text")
    text = F.when(way == 1, "").when(way == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.array_repeat(F.lit(0), F.when(way == 3, 2).otherwise(1).cast("int"))
    return rows.where(way > 0).select("conv", "turn", F.when(way == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies)).drop("col")


def repaired_conversations(original: DataFrame, turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """`repair` of turns (conv, turn, role, text), with a row for each conversation of the original table."""
    convs = original.select(F.col(conv_col).alias("c")).distinct()
    out = convs.join(repair(turns, "conv"), F.col("c").eqNullSafe(F.col("conv")), "left")
    zero = F.lit(0).cast("long")
    numbers = [F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("c").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
