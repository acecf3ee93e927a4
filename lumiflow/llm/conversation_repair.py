"""Repair of conversation structure as a lightest derivation, by Knuth's agenda.

Deductions.  An item (i, state) says that the first i rows of a conversation have been edited into roles after which the
grammar ``(s?(ua)+)?`` is in ``state``; its weight is (cost, audit), audit being the edits' initials.  Edits are deductions from one item to another: Keep,
Rerole to user or assistant, Delete, Insert a user or assistant without text.  Each adds to the cost and appends a letter, so its weight function is superior (never below its
antecedent) and monotone, and the agenda can finalise the smallest item it holds, until a goal item (all rows, grammar satisfied) comes out.
Two audits of one item differ before either ends (edits decide the state), so appending keeps their order.

Long conversations.  The rows of a block of ``BLOCK`` give, for each state before them, the lightest item of each state after them; (block, before, after) items of two
neighbouring blocks are the antecedents of one deduction that joins them, so blocks are derived apart and joined in pairs.

Plan.  One shuffle sorts rows by conversation and turn over ranges, so a conversation of any size is spread evenly.  What lies inside a range is solved there, row by row.  The first and
last conversation of each range may go on in the next (two a partition at most, all large ones among them): these are numbered, flagged and derived by blocks, and only the hash of the
repaired text, which is sequential by its nature, reads a conversation in one task, as a stream of rendered blocks.

Defined cases: null roles and texts are one space, as are nulls in the damage key; a null conv_id is a conversation; turns that
are null come first; rows of one turn are ordered by role and text; repeated rows are duplicates; a conversation that lost all rows has zeros, an empty audit and the
hash of the empty string; an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored

#: States of the grammar: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
GOALS = (START, ASSISTANT)
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAMES = {"u": "user", "a": "assistant"}
#: Costs of edits, and of leaving a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
FAULTS = ("", "blank", "duplicate", "truncated")
BLOCK = 512
_LEGAL = {"su", "ua", "au"}
#: Stands for the initial of an empty role.
_NONE = "\0"
#: Text that a task holds of one conversation; a longer one is left to the blocks.
HELD = 64_000_000
_EMPTY = hashlib.sha256(b"").hexdigest()

Item = tuple[int, str]


def _code(initial: str, fault: int) -> str:
    """One letter for a row: what it can be kept as, and d if it must go; capital if truncated."""
    if fault in (1, 2):
        return "d"
    kept = initial if initial in MOVES else "x"
    return kept.upper() if fault == 3 else kept


def _edits(code: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that consume a row."""
    yield "D", DELETE, state
    if code == "d":
        return
    more = TRUNCATED if code.isupper() else 0
    if (to := MOVES.get(code.lower(), {}).get(state)) is not None:
        yield "K", more, to
    for role in NAMES:
        if (to := MOVES[role].get(state)) is not None:
            yield "R", REROLE + more, to


def agenda(codes: str, state: int, goals: tuple[int, ...], first: bool) -> dict[int, Item]:
    """Lightest (cost, audit) of the items (all rows, goal) from (no row, ``state``); of the first goal alone if ``first``."""
    n, found, done = len(codes), {}, set()
    queue: list[tuple[int, str, int, int]] = [(0, "", 0, state)]
    while queue and len(found) < len(goals):
        cost, audit, i, s = heapq.heappop(queue)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == n and s in goals:
            found[s] = (cost, audit)
            if first:
                break
        for role in NAMES:
            if (to := MOVES[role].get(s)) is not None and (i, to) not in done:
                heapq.heappush(queue, (cost + INSERT, audit + "I", i, to))
        if i < n:
            for letter, more, to in _edits(codes[i], s):
                if (i + 1, to) not in done:
                    heapq.heappush(queue, (cost + more, audit + letter, i + 1, to))
    return found


@lru_cache(maxsize=4096)
def spans(codes: str) -> dict[tuple[int, int], Item]:
    """(state before, state after) -> lightest item of a block."""
    return {(s, t): item for s in range(4) for t, item in agenda(codes, s, tuple(range(4)), False).items()}


def joined(left: dict, right: dict) -> dict:
    """Items of two neighbouring blocks from those of each."""
    out: dict[tuple[int, int], Item] = {}
    for (s, m), (cost, audit) in left.items():
        for t in range(4):
            if (r := right.get((m, t))) is not None and (cost + r[0] < (old := out.get((s, t), (float("inf"), "")))[0] or (cost + r[0] == old[0] and audit + r[1] < old[1])):
                out[s, t] = (cost + r[0], audit + r[1])
    return out


def lightest(blocks: list[dict]) -> Item:
    """Goal item of a conversation of the items of its blocks, joined in pairs."""
    while len(blocks) > 1:
        blocks = [joined(*blocks[i : i + 2]) if i + 1 < len(blocks) else blocks[i] for i in range(0, len(blocks), 2)]
    return min(blocks[0][START, t] for t in GOALS if (START, t) in blocks[0]) if blocks else (0, "")


@lru_cache(maxsize=65_536)
def _short(codes: str) -> Item:
    return min(agenda(codes, START, GOALS, True).values())


def repair(codes: str) -> Item:
    """(cost, audit) of the cheapest edits, of several the least audit in ASCII."""
    return _short(codes) if len(codes) <= BLOCK else lightest([spans(codes[i : i + BLOCK]) for i in range(0, len(codes), BLOCK)])


def rendered(rows: list[tuple[str, str]], audit: str, state: int) -> tuple[list[str], int, int]:
    """(``role:text`` of the repaired rows, state after them, edits used), of as many edits as ``rows`` need, and the inserts behind them."""
    out, at, used = [], 0, 0
    for letter in audit:
        if at == len(rows) and letter != "I":
            break
        used += 1
        if letter == "I" or letter == "R":
            role = "a" if state == USER else "u"
            out.append(f"{NAMES[role]}:{rows[at][1] if letter == 'R' else ''}")
            state = MOVES[role][state]
        elif letter == "K":
            out.append(f"{rows[at][0]}:{rows[at][1]}")
            state = MOVES[rows[at][0][:1]][state]
        at += letter != "I"
    return out, state, used


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage, with ``dropped``, ``blank`` and ``cut``; dropped rows stay as marks of their conversation."""
    space = F.lit(" ")
    h = F.crc32(F.encode(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)), "UTF-8")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    text = F.when(F.col("h").isin(0, 1), "").when(F.col("h") == 2, F.translate(text, ".!?", "")).otherwise(text)
    out = rows.select("conv_id", "turn", "role", "text", h.alias("h")).select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(F.col("h") == 4, "user").otherwise(role).alias("role"), text.alias("text"), "h")
    out = out.select("conv_id", "turn", "role", "text", (F.col("h") == 0).alias("dropped"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1))).alias("copy")).drop("copy")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return out.withColumns({"blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "cut": ~ended})


def _ranged(rows: DataFrame, *more: Column) -> DataFrame:
    """Sorted by conversation and turn over even ranges."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), *more]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def _summary(conv_kind: str) -> str:
    return f"conv_id {conv_kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))


def solved(rows: list[tuple]) -> tuple:
    """gaps to repaired_sha256 of the rows (turn, role, text, blank, cut) of one conversation, in order."""
    seen, faults = set(), []
    for _, role, text, blank, cut in rows:
        faults.append(1 if blank else 2 if (role, text) in seen else 3 if cut else 0)
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    cost, audit = repair("".join(map(_code, initials, faults)))
    lines = rendered([r[1:3] for r in rows], audit, START)[0]
    return (_gaps([r[0] for r in rows]), *(faults.count(k) for k in (1, 2, 3)), _illegal(initials), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _inside(rows: DataFrame) -> DataFrame:
    """Solved conversations, and the first and last of each range as marks (``open``)."""
    kind = rows.schema["conv_id"].dataType

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, own, size, left = None, None, [], 0, True
        for batch in batches:
            if schema is None:
                fields = [pa.field(n, t) for n, t in zip(("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "open"), (*[pa.int64()] * 6, pa.string(), pa.string(), pa.bool_()), strict=True)]
                schema = pa.schema([pa.field("conv_id", batch.column(0).type), *fields])
            out = []
            for conv, turn, role, text, dropped, blank, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or held[0] != conv:
                    if held is not None:
                        out.append((held[0], *([None] * 8), True) if left else (held[0], *solved(own), False))
                        left = False
                    held, own, size = (conv,), [], 0
                size += 100 + len(text)
                left = left or size > HELD  # the first of a range is left to the blocks, whatever it has
                if left:
                    own = []
                elif not dropped:
                    own.append((turn, role, text, blank, cut))
            if out:
                yield _batch(out, schema)
        if held is not None:
            yield _batch([(held[0], *([None] * 8), True)], schema)

    return rows.mapInArrow(solve, f"{_summary(kind.simpleString())}, open boolean")


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows of long conversations with their fault, range, and place in it; of equal rows the one that is no duplicate comes first."""
    from pyspark.sql import Window

    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(F.col("blank"), 1).when(again, 2).when(F.col("cut"), 3).otherwise(0)
    kind, size = rows.schema["conv_id"].dataType.simpleString(), BLOCK

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            places = pa.array(range(at, at + n), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int64()), places, pa.array([x // size for x in range(at, at + n)], pa.int64())], names=[*batch.schema.names, "part", "place", "block"])
            at += n

    return _ranged(rows.select("conv_id", "turn", "role", "text", fault.alias("fault")), F.col("fault") == 2).mapInArrow(number, f"conv_id {kind}, turn long, role string, text string, fault int, part long, place long, block long")


def _derived(rows: DataFrame) -> DataFrame:
    """A row for each block of a conversation: its counts, initials and lightest items."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def derive(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        turns, initials, faults = t["turn"].to_pylist(), t["initial"].to_pylist(), t["fault"].to_pylist()
        items = spans("".join(map(_code, initials, faults)))
        known = [x for x in turns if x is not None]
        one = {"conv_id": t["conv_id"][0].as_py(), "part": t["part"][0].as_py(), "block": t["block"][0].as_py(), "low": min(known, default=None), "high": max(known, default=None), "turns": len(set(known))}
        one |= {name: faults.count(k) for k, name in enumerate(FAULTS) if name} | {"initials": "".join(x or _NONE for x in initials)}
        one |= {"states": [4 * s + e for s, e in items], "costs": [c for c, _ in items.values()], "audits": [a for _, a in items.values()]}
        types = [t.schema.field("conv_id").type, *[pa.int64()] * 8, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
        return pa.table({k: pa.array([v], x) for (k, v), x in zip(one.items(), types, strict=True)})

    small = rows.select("conv_id", "turn", F.substr("role", F.lit(1), F.lit(1)).alias("initial"), "fault", "part", "place", "block")
    return small.groupBy("conv_id", "part", "block").applyInArrow(derive, f"conv_id {kind}, part long, block long, low long, high long, turns long, blank long, duplicate long, truncated long, initials string, states array<long>, costs array<long>, audits array<string>")


def _pieces(audit: str, blocks: list[str]) -> Iterator[tuple[str, int]]:
    """(edits, state before them) of each block, of the edits of a conversation and the initials of its blocks."""
    at, state = 0, START
    for initials in blocks:
        begin, before, i = at, state, 0
        while at < len(audit) and (i < len(initials) or audit[at] == "I"):
            if audit[at] != "D":
                state = MOVES[initials[i] if audit[at] == "K" else "a" if state == USER else "u"][state]
            i += audit[at] != "I"
            at += 1
        yield audit[begin:at], before


def _chosen(blocks: DataFrame) -> DataFrame:
    """Per block its edits and the state before them, and in each conversation's first row its counts, cost and audit (null in others)."""
    kind = blocks.schema["conv_id"].dataType.simpleString()

    def choose(t: pa.Table) -> pa.Table:
        rows = t.sort_by([("part", "ascending"), ("block", "ascending")]).to_pylist()
        cost, audit = lightest([{divmod(s, 4): (c, a) for s, c, a in zip(r["states"], r["costs"], r["audits"], strict=True)} for r in rows])
        lows, highs = ([r[k] for r in rows if r[k] is not None] for k in ("low", "high"))
        # a turn on both sides of a cut counts once
        turns = sum(r["turns"] for r in rows) - sum(a["high"] is not None and a["high"] == b["low"] for a, b in zip(rows, rows[1:], strict=False))
        whole = {"gaps": max(highs) - min(lows) + 1 - turns if lows else 0} | {k: sum(r[k] for r in rows) for k in FAULTS[1:]}
        whole |= {"illegal": _illegal("".join(r["initials"] for r in rows)), "cost": cost, "audit": audit}
        pieces, states = zip(*_pieces(audit, [r["initials"] for r in rows]), strict=True)
        columns = {k: [r[k] for r in rows] for k in ("conv_id", "part", "block")} | {"piece": pieces, "state": states} | {k: [v] + [None] * (len(rows) - 1) for k, v in whole.items()}
        types = [t.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 7, pa.string()]
        return pa.table({k: pa.array(v, x) for (k, v), x in zip(columns.items(), types, strict=True)})

    return blocks.groupBy("conv_id").applyInArrow(choose, f"conv_id {kind}, part long, block long, piece string, state long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _hashed(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): blocks are rendered apart, then hashed as a stream in order."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def render(left: pa.Table, right: pa.Table) -> pa.Table:
        t = left.sort_by("place")
        own = list(zip(t["role"].to_pylist(), t["text"].to_pylist(), strict=True))
        piece = right["piece"][0].as_py() if right.num_rows else ""
        lines = rendered(own, piece, right["state"][0].as_py())[0]
        keys = {c: t[c].slice(0, 1) for c in ("conv_id", "part", "block")}
        return pa.table(keys | {"body": pa.array(["\n".join(lines) if lines else None], pa.string())})

    blocks = rows.groupBy("conv_id", "part", "block").cogroup(pieces.groupBy("conv_id", "part", "block")).applyInArrow(render, f"conv_id {kind}, part long, block long, body string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sha, begun, kind = None, None, False, None
        for batch in batches:
            kind, out = batch.column(0).type, []
            for conv, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held is None or held[0] != conv:
                    if held is not None:
                        out.append((held[0], sha.hexdigest()))
                    held, sha, begun = (conv,), hashlib.sha256(), False
                if body is not None:
                    sha.update((("\n" if begun else "") + body).encode())
                    begun = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out])], names=["conv_id", "repaired_sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], kind), pa.array([sha.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").select("conv_id", "body").mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")


def _open(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The conversations of ``marks``, derived by blocks."""
    own = marks.withColumnRenamed("conv_id", "__conv")
    mine = rows.where("not dropped").join(own, F.col("conv_id").eqNullSafe(F.col("__conv")), "left_semi")
    numbered = stored(_numbered(mine), "rows")
    chosen = stored(_chosen(_derived(numbered)), "edits")
    hashed = _hashed(numbered, chosen.select("conv_id", "part", "block", "piece", "state")).withColumnRenamed("conv_id", "__hashed")
    whole = chosen.where("cost is not null").drop("part", "block", "piece", "state")
    out = own.join(whole, F.col("__conv").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").join(hashed, F.col("__conv").eqNullSafe(F.col("__hashed")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *FAULTS[1:], "illegal", "cost")]
    return out.select(F.col("__conv").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_EMPTY)).alias("repaired_sha256"))


def repaired_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, of its rows after damage."""
    own = damaged(rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")))
    inside = stored(_inside(_ranged(own)), "conversations")
    marks = stored(inside.where("open").select("conv_id").distinct(), "marks")
    return inside.where("not open").drop("open").unionByName(_open(own, marks))
