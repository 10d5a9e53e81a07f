"""Conversation repair against plain evaluators: every audit tried, order, faults, pieces, odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from seriesmith.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, conv string, pid int, tie string"
SPACES = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_faults(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        bare = text.rstrip(SPACES)
        fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
        out.append(fault)
        seen.add((role, text))
    return out


def every_audit(rows, faults):
    """The least (cost, audit, repaired) by trying all edits, with at most two insertions in a row."""
    best = None
    for inserts in itertools.product(*[[(), ("u",), ("a",), ("u", "a"), ("a", "u")]] * (len(rows) + 1)):
        if sum(map(len, inserts)) > len(rows) + 2:
            continue
        for edits in itertools.product("KuaD", repeat=len(rows)):
            cost, audit, said = 2 * sum(map(len, inserts)), "", []
            if any(edit != "D" and fault in (1, 2) for edit, fault in zip(edits, faults)):
                continue
            for k, new in enumerate(inserts):
                audit += "I" * len(new)
                said += [("user" if x == "u" else "assistant", "") for x in new]
                if k < len(rows):
                    edit, (_, _, role, text), fault = edits[k], rows[k], faults[k]
                    audit += "R" if edit in "ua" else edit
                    cost += {"K": 0, "D": 3}.get(edit, 2) + (fault == 3 and edit != "D")
                    if edit != "D":
                        said.append((role if edit == "K" else "user" if edit == "u" else "assistant", text))
            if GRAMMAR.match("".join(r[:1] or "?" for r, _ in said)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, said)
    return best


def backwards(rows, faults):
    """The same by costs to go and the least edit that keeps to them."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    end = {"": 0, "a": 0, "u": 2, "s": 4}
    togo = [end]
    for (_, _, role, _), fault in reversed(list(zip(rows, faults))):
        nxt, now = togo[-1], {}
        for s in end:
            ways = [3 + nxt[s]]
            if fault not in (1, 2):
                kept = step.get((s, role[:1]))
                ways += [2 + (fault == 3) + nxt[after[s]]] + ([(fault == 3) + nxt[kept]] if kept else [])
            now[s] = min(ways)
        for _ in range(3):
            now = {s: min(now[s], 2 + now[after[s]]) for s in now}
        togo.append(now)
    togo.reverse()
    state, k, audit, cost, said = "", 0, "", togo[0][""], []
    while k < len(rows) or state in "us" and state:
        if k == len(rows):
            edit = "I"
        else:
            role, fault, nxt = rows[k][2], faults[k], togo[k + 1]
            want, edit = togo[k][state], None
            if 3 + nxt[state] == want:
                edit = "D"
            elif 2 + togo[k][after[state]] == want:
                edit = "I"
            elif fault not in (1, 2) and (state, role[:1]) in step and (fault == 3) + nxt[step[state, role[:1]]] == want:
                edit = "K"
            else:
                edit = "R"
        audit += edit
        if edit in "IR":
            state = after[state]
            said.append(("user" if state == "u" else "assistant", "" if edit == "I" else rows[k][3]))
        elif edit == "K":
            state = step[state, rows[k][2][:1]]
            said.append(rows[k][2:])
        k += edit != "I"
    return cost, audit, said


def expected(original, rows, solver):
    out = {}
    for conv in {r[0] for r in original}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults = plain_faults(mine)
        cost, audit, said = solver(mine, faults)
        turns = {r[1] for r in mine} - {None}
        initials = [r[2][:1] for r in mine]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(faults.count(k) for k in (1, 2, 3)),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest(),
        )
    return out


def reported(spark, original, damage=False, **options):
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in original], SCHEMA)
    rows = conversations.damaged(frame) if damage else frame
    got = conversations.repair_report(frame, conversations.repair(rows, **options)).collect()
    return {r["conv_id"]: tuple(r)[1:] for r in got}


TEXTS = ["Yes.", "no", "", " \t", "Well?", "so. \n", "x" * 80 + "a", "x" * 80 + "b."]


def some(n, most, seed, roles=("system", "user", "assistant", "assistant", "user", "tool", "")):
    rng = random.Random(seed)
    return [(c, t, rng.choice(roles), rng.choice(TEXTS)) for c in range(n) for t in range(rng.randrange(1, most))]


def test_every_audit_and_costs_to_go_agree():
    rng = random.Random(3)
    for _ in range(25):
        rows = [(1, t, rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(TEXTS)) for t in range(rng.randrange(0, 4))]
        faults = plain_faults(rows)
        assert every_audit(rows, faults) == backwards(rows, faults), rows


def test_small_conversations(spark):
    rows = some(300, 9, 1)
    assert reported(spark, rows) == expected(rows, rows, backwards)


@pytest.mark.parametrize("piece", [1, 2, 7])
def test_pieces_change_nothing(spark, piece):
    rows = some(20, 60, 2) + [(-1, t, "user", "Yes.") for t in range(150)] + [(-2, 5, "assistant", f"T{t}") for t in range(150)]
    assert reported(spark, rows, piece_rows=piece) == expected(rows, rows, backwards)


def test_one_long_conversation_over_many_partitions(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"Say {rng.randrange(3000)}{rng.choice(['.', ''])}") for t in range(6000)]
    assert reported(spark, rows, piece_rows=500) == expected(rows, rows, backwards)


def test_damage_nulls_repeats_and_lost_conversations(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3, 10**12, -4]), rng.choice([None, 0, 1, 2, 9]), rng.choice([None, "user", "assistant", "system"]), rng.choice([None, *TEXTS])) for _ in range(200)]
    rows += [(c, 0, "user", "Hello.") for c in range(100, 160)]  # some lose their only row
    got = reported(spark, rows, damage=True)
    assert got == expected(rows, plain_damage(rows), backwards)
    assert any(x == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for x in got.values())


def test_empty_table(spark):
    assert reported(spark, [], damage=True) == {}


def test_repaired_turns_are_whole(spark):
    rows = some(50, 9, 8)
    turns = conversations.repair(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)).turns
    said = turns.groupBy("conv.conv_id").agg(F.sort_array(F.collect_list(F.struct("pid", "piece", "at", "role", "edit", "turn"))).alias("all")).collect()
    for r in said:
        assert GRAMMAR.match("".join(x["role"][0] for x in r["all"]))
        assert all((x["turn"] is None) == (x["edit"] == "I") for x in r["all"])


def test_query_on_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.op11_conversations(spark, sf).collect()}
    assert got == expected(rows, plain_damage(rows), backwards)
