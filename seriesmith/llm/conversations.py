"""Conversation structure repair: the cheapest edits that give roles the form ``(system? (user assistant)+)?``.

A forward Viterbi pass goes over the turns of a conversation with four grammar states (nothing yet,
after system, after user, after assistant) and carries for each the least (cost, audit string). Before
a turn, and at the end, the layer is closed: from each state at most two insertions are followed, as
more only come back to a state at a higher cost.

A conversation may hold a large share of all rows, so it is cut into pieces of consecutive turns,
which range partitions and PIECE rows bound. A piece is solved for each state it may be entered in;
what leaves it is a 4 x 4 table of (cost, audit). One small row a piece then chooses the states between
pieces: costs to go backwards, then forwards, ties by the audits. That is exact: audits of one piece
from one state end in a turn's edit and use up the same turns, so none is a prefix of another and the
first that differs decides. Audits are chosen in the table of pieces and edits applied piece by piece.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmith.llm.common import join_dealt, materialize, read_table

#: Rows of a piece.
PIECE = 4096
#: Pieces of at most so many rows are remembered by a task, so many of them.
REMEMBERED_ROWS, REMEMBERED = 64, 20_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
#: Where a role leads, by the initials of roles; everything else must be deleted or given another role.
_KEPT = {(START, "s"): AFTER_SYSTEM, (START, "u"): AFTER_USER, (AFTER_SYSTEM, "u"): AFTER_USER, (AFTER_USER, "a"): AFTER_ASSISTANT, (AFTER_ASSISTANT, "u"): AFTER_USER}
#: Where a user's or assistant's turn leads from a state: only one of the two fits.
_NEXT = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
_ROLES = {AFTER_USER: "user", AFTER_ASSISTANT: "assistant"}
#: What a state still needs at the end.
_TAIL = ("", "II", "I", "")
_LEGAL = ("su", "ua", "au")
NO_WAY = 1 << 60
SOUND, BLANK, DUPLICATE, CUT = range(4)

Layer = dict[int, tuple[int, str]]


def _offer(layer: Layer, state: int, cost: int, audit: str) -> None:
    if state not in layer or (cost, audit) < layer[state]:
        layer[state] = (cost, audit)


def _closed(layer: Layer) -> Layer:
    out = dict(layer)
    for state, (cost, audit) in layer.items():
        for _ in range(2):
            state, cost, audit = _NEXT[state], cost + INSERT, audit + "I"
            _offer(out, state, cost, audit)
    return out


def _after_turn(layer: Layer, initial: str, fault: int) -> Layer:
    out: Layer = {}
    for state, (cost, audit) in _closed(layer).items():
        _offer(out, state, cost + DELETE, audit + "D")
        if fault not in (BLANK, DUPLICATE):
            more = cost + (TRUNCATED if fault == CUT else 0)
            if (state, initial) in _KEPT:
                _offer(out, _KEPT[state, initial], more + KEEP, audit + "K")
            _offer(out, _NEXT[state], more + REROLE, audit + "R")
    return out


def solve(symbols: str, entries: tuple[int, ...]) -> dict[int, Layer]:
    """For each entry state, the least (cost, audit) by the state in which the turns are left.

    ``symbols`` has two characters a turn: the role's initial and the digit of its fault. The layer
    that is returned is not closed.
    """
    out = {}
    for entry in entries:
        layer: Layer = {entry: (0, "")}
        for k in range(0, len(symbols), 2):
            layer = _after_turn(layer, symbols[k], int(symbols[k + 1]))
        out[entry] = layer
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations with faults put in by crc32 of ``conv_id:turn``: the input of the query.

    Nulls count as one space in the key, the role and the text; a null turn stays one for the order.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    kept = rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return kept.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat("turn", F.col("times"))).alias("again")).drop("again")


_ORDER = ["conv", "turn", "role", "head", "h1", "tie"]


def _faults(rows: DataFrame) -> DataFrame:
    """Rows with their place in the conversation's order and their first fault."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    held = rows.select(F.struct("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    held = held.withColumns({"head": F.substring("text", 1, 64), "h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text"), "tie": F.monotonically_increasing_id()})
    held = materialize(held, "conversations")  # ties keep their numbers whoever reads them
    said = ["conv", "role", "h1", "h2"]
    first = held.groupBy(*said).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("turn", "tie")).alias("first")).where("n > 1").drop("n")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    again = F.col("first").isNotNull() & (F.col("first.tie") != F.col("tie"))
    fault = F.when(blank, BLANK).when(again, DUPLICATE).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(SOUND)
    return join_dealt(held, first, said, "left").withColumn("fault", fault.cast("int")).select(*_ORDER, "text", "fault")


def _cut(piece_rows: int):
    """Numbers the rows of pieces, and adds one row of sums and tables for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, remembered = TaskContext.get().partitionId(), functools.lru_cache(REMEMBERED)(solve)
        conv, piece, symbols, begins = None, -1, [], False
        turns, seen = [], False
        batch = None

        def summary():
            text = "".join(symbols)
            entries = (START,) if begins else (START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT)
            table = (remembered if len(symbols) <= REMEMBERED_ROWS else solve)(text, entries)
            costs, ranks, audits = [NO_WAY] * 16, [0] * 16, [None] * 16
            for entry, layer in table.items():
                for rank, (audit, state, cost) in enumerate(sorted((a, s, c) for s, (c, a) in layer.items())):
                    costs[4 * entry + state], ranks[4 * entry + state], audits[4 * entry + state] = cost, rank, audit
            initials, faults = text[::2], [int(x) for x in text[1::2]]
            known = [t for t in turns if t is not None]
            return {
                "first": initials[0],
                "last": initials[-1],
                "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
                "blank": faults.count(BLANK),
                "duplicate": faults.count(DUPLICATE),
                "truncated": faults.count(CUT),
                "lo": min(known, default=None),
                "hi": max(known, default=None),
                "turns": len(set(known)),
                "costs": costs,
                "ranks": ranks,
                "audits": audits,
            }

        def closed(last):
            conv_type = last.column(0).type
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], conv_type), *(pa.array([x], pa.int32()) for x in (pid, piece, -1)), pa.array([None], pa.int64()), pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([summary()], _SUMMARY_ARROW)], _NAMES
            )

        for batch in batches:
            convs, turn, roles, faults = (batch.column(k).to_pylist() for k in (0, 1, 2, 4))
            pieces, at, start = [], [], 0
            for k, (c, t, r, f) in enumerate(zip(convs, turn, roles, faults)):
                if not seen or c != conv or len(symbols) == piece_rows:
                    if symbols:
                        if k > start:
                            yield _rows(batch, start, k, pid, pieces, at)
                        pieces, at, start = [], [], k
                        yield closed(batch)
                    begins, conv, piece, symbols, turns, seen = seen and c != conv, c, piece + 1, [], [], True
                pieces.append(piece)
                at.append(len(symbols))
                symbols.append((r[:1] or " ") + str(f))
                turns.append(t)
            if batch.num_rows > start:
                yield _rows(batch, start, batch.num_rows, pid, pieces, at)
        if symbols:
            yield closed(batch)

    return run


_SUMMARY = "struct<first string, last string, illegal long, blank long, duplicate long, truncated long, lo long, hi long, turns long, costs array<long>, ranks array<int>, audits array<string>>"
_SUMMARY_ARROW = pa.struct(
    [("first", pa.string()), ("last", pa.string()), *((x, pa.int64()) for x in ("illegal", "blank", "duplicate", "truncated", "lo", "hi", "turns")), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("audits", pa.list_(pa.string()))]
)
_NAMES = ["conv", "pid", "piece", "k", "turn", "role", "text", "summary"]


def _rows(batch: pa.RecordBatch, a: int, b: int, pid: int, pieces: list, at: list) -> pa.RecordBatch:
    conv, turn, role, text, _ = (x.slice(a, b - a) for x in batch.columns)
    n = b - a
    return pa.RecordBatch.from_arrays([conv, pa.array([pid] * n, pa.int32()), pa.array(pieces, pa.int32()), pa.array(at, pa.int32()), turn, role, text, pa.nulls(n, _SUMMARY_ARROW)], _NAMES)


def _states(pieces: list[dict]) -> list[tuple[int, int]]:
    """Entry and exit state of each piece on the cheapest way through all, ties by the least audit."""
    go = [INSERT * len(tail) for tail in _TAIL]
    togo = [go]
    for p in reversed(pieces):
        go = [min(p["costs"][4 * s + t] + go[t] for t in range(4)) for s in range(4)]
        togo.append(go)
    togo.reverse()
    state, out = START, []
    for p, after in zip(pieces, togo[1:]):
        _, _, t = min((p["costs"][4 * state + t] + after[t], p["ranks"][4 * state + t], t) for t in range(4) if p["costs"][4 * state + t] < NO_WAY)
        out.append((state, t))
        state = t
    return out


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by conversation and piece; of one conversation a few numbers a piece are held."""

    def chosen(conv_type, conv, held):
        states = _states(held)
        before = [None, *held]
        joint = [int(b is not None and b["last"] + p["first"] not in _LEGAL) for b, p in zip(before, held)]
        high, shared = None, []
        for p in held:
            shared.append(int(p["lo"] is not None and p["lo"] == high))
            high = p["hi"] if p["hi"] is not None else high
        tails = [*[""] * (len(held) - 1), _TAIL[states[-1][1]]]
        return pa.RecordBatch.from_arrays(
            [pa.array([conv] * len(held), conv_type), *(pa.array([p[x] for p in held], pa.int32()) for x in ("pid", "piece")), *(pa.array(x, pa.int32()) for x in zip(*states)), pa.array(joint, pa.int64()), pa.array(shared, pa.int64()), pa.array(tails)],
            ["conv", "pid", "piece", "entry", "exit", "joint", "shared", "tail"],
        )

    conv, held = None, []
    for batch in batches:
        names = batch.schema.names[1:]
        for c, *values in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
            if held and c != conv:
                yield chosen(batch.column(0).type, conv, held)
                held = []
            conv = c
            held.append(dict(zip(names, values)))
    if held:
        yield chosen(batch.column(0).type, conv, held)


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by piece, its audit first."""
    audit, at, state, tail, left = "", 0, START, "", 0
    for batch in batches:
        out: list = []
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for conv, pid, piece, k, turn, role, text, entry, end in zip(*columns):
            if k < 0:
                audit, at, state, tail = text, 0, entry, end
                left = len(audit) - audit.count("I")
            j = at
            while k >= 0:
                edit = audit[at]
                at += 1
                if edit in "IR":
                    state = _NEXT[state]
                if edit == "I":
                    out.append((conv, pid, piece, at, None, "I", _ROLES[state], ""))
                    continue
                if edit == "K":
                    state = _KEPT[state, role[:1]]
                if edit != "D":
                    out.append((conv, pid, piece, at, turn, edit, role if edit == "K" else _ROLES[state], text))
                left -= 1
                break
            if not left:
                for j in range(len(tail)):
                    state = _NEXT[state]
                    out.append((conv, pid, piece, at + 1 + j, None, "I", _ROLES[state], ""))
                tail = ""
        types = [batch.column(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
        some = list(zip(*out)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(some, types)], ["conv", "pid", "piece", "at", "turn", "edit", "role", "text"])


class Repaired:
    """What ``repair`` finds: ``report``, one row a conversation, and ``turns``, the repaired rows."""

    def __init__(self, report: DataFrame, turns: DataFrame):
        self.report, self.turns = report, turns


def repair(rows: DataFrame, piece_rows: int = PIECE) -> Repaired:
    """The repair of conversations with columns conv_id, turn, role, text; others are not read.

    Turns are taken in order, a null one first, ties by role and text; repeated rows
    follow each other. A null role or text is one space. The first fault of a row counts: blank, then
    duplicate (its role and text came before), then truncated (its last character other than white
    space is none of ``.!?``). Blank and duplicate rows go. A role whose initial is none of s, u, a
    cannot stay. The cheapest audit is chosen, of those the least by ASCII. A null conv_id is a conversation.

    ``report``: conv (a struct of conv_id), gaps, blank, duplicate, truncated, illegal, cost, audit.
    ``turns``: conv, pid, piece, at (their order), turn (null where inserted), edit, role, text.
    """
    conv_type = rows.select(F.struct("conv_id").alias("conv")).schema["conv"].dataType.simpleString()
    ordered = _faults(rows).repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select("conv", "turn", "role", "text", "fault")
    cut = materialize(ordered.mapInArrow(_cut(piece_rows), f"conv {conv_type}, pid int, piece int, k int, turn long, role string, text string, summary {_SUMMARY}"), "conversations")
    pieces = cut.where("summary is not null").select("conv", "pid", "piece", "summary.*")
    few = pieces.select("conv", "pid", "piece", "first", "last", "lo", "hi", "costs", "ranks").repartition("conv").sortWithinPartitions("conv", "pid", "piece")
    chosen = few.mapInArrow(_choose, f"conv {conv_type}, pid int, piece int, entry int, exit int, joint long, shared long, tail string")
    pick = lambda c: F.element_at(c, 4 * F.col("entry") + F.col("exit") + 1)
    solved = pieces.join(chosen.drop("conv"), ["pid", "piece"]).withColumns({"cost": pick("costs"), "audit": pick("audits")})
    solved = materialize(solved.drop("costs", "ranks", "audits"), "conversations")
    gaps = F.coalesce(F.max("hi") - F.min("lo") + 1 - (F.sum("turns") - F.sum("shared")), F.lit(0)).cast("long")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pid", "piece", F.concat("audit", "tail").alias("audit")))), lambda x: x["audit"]), "")
    report = solved.groupBy("conv").agg(
        gaps.alias("gaps"), *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")], (F.sum("illegal") + F.sum("joint")).alias("illegal"), F.sum(F.col("cost") + INSERT * F.length("tail")).alias("cost"), whole.alias("audit")
    )
    both = cut.where("summary is null").select("conv", "pid", "piece", "k", "turn", "role", "text", F.lit(None).cast("int").alias("entry"), F.lit(None).cast("string").alias("tail"))
    both = both.unionByName(solved.select("conv", "pid", "piece", F.lit(-1).alias("k"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), "entry", "tail"))
    edited = both.repartition("pid", "piece").sortWithinPartitions("pid", "piece", "k")
    turns = edited.mapInArrow(_edit, f"conv {conv_type}, pid int, piece int, at int, turn long, edit string, role string, text string")
    return Repaired(report, turns)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the newline-joined ``role:text`` of each conversation, whose rows come in order, read as a stream."""
    conv, digest = None, None
    for batch in batches:
        out = []
        for c, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if digest is None or c != conv:
                if digest is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], batch.column(0).type), pa.array([x[1] for x in out], pa.string())], ["conv", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], batch.column(0).type), pa.array([digest.hexdigest()])], ["conv", "repaired_sha256"])


def digests(turns: DataFrame) -> DataFrame:
    """conv, repaired_sha256. A digest is sequential, so a conversation's text passes through one task, as a stream."""
    kind = turns.schema["conv"].dataType.simpleString()
    ordered = turns.repartition("conv").sortWithinPartitions("conv", "pid", "piece", "at").select("conv", "role", "text")
    return ordered.mapInArrow(_digest, f"conv {kind}, repaired_sha256 string")


def repair_report(conversations: DataFrame, found: Repaired) -> DataFrame:
    """One row for every conv_id of ``conversations``; those without rows in ``found`` have zeros and empty texts."""
    ids = conversations.select(F.struct("conv_id").alias("conv")).distinct()
    out = ids.join(found.report, "conv", "left").join(digests(found.turns), "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    empty: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv.conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def op11_conversations(spark, sf_dir) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    return repair_report(rows, repair(damaged(rows)))
