"""Conversation repair against a search over all edits in plain Python."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

from gradeloom.llm import conversation_repair as cr
from gradeloom.llm.conversation_repair import repair_conversations, repair_damaged, repaired_turns
from gradeloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\f\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = " " if conv is None else str(conv)
        draw = zlib.crc32(f"{name}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


def best(rows):
    """Least ``(cost, audit)`` and the turns left, over all ways to the form."""

    @lru_cache(None)
    def go(i, state, inserted):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        if inserted < 3:
            r = "u" if "u" in follows else "a"
            cost, audit, left = go(i, r, inserted + 1)
            found.append((3 + cost, "I" + audit, (("user:" if r == "u" else "assistant:"),) + left))
        if i < len(rows):
            role, text, fault = rows[i]
            cost, audit, left = go(i + 1, state, 0)
            found.append((4 + cost, "D" + audit, left))
            if fault in (0, 3):
                more = 3 if fault == 3 else 0
                if role[:1] and role[:1] in follows:
                    cost, audit, left = go(i + 1, role[:1], 0)
                    found.append((more + cost, "K" + audit, (f"{role}:{text}",) + left))
                r = "u" if "u" in follows else "a"
                cost, audit, left = go(i + 1, r, 0)
                found.append((3 + more + cost, "R" + audit, (f"{'user' if r == 'u' else 'assistant'}:{text}",) + left))
        return min(found) if found else (10**9, "", ())

    return go(0, "", 0)


def expected(ids, rows):
    out = {}
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, marked, counts = set(), [], [0, 0, 0, 0]
        for _, _, role, text in own:
            solid = text.strip(SPACES)
            fault = 1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0
            seen.add((role, text))
            if marked and marked[-1][0][:1] + role[:1] not in ("su", "ua", "au"):
                counts[3] += 1
            if fault:
                counts[fault - 1] += 1
            marked.append((role, text, fault))
        turns = {r[1] for r in own if r[1] is not None}
        cost, audit, left = best(tuple(marked))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *counts, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()), left
    return out


def random_rows():
    rng = random.Random(11)
    rows = []
    for conv in [None, *range(150)]:
        texts = ["Yes.", "No", "", " \t\n", None, "Why?", "a\u0085", "é!", "It is. \n"] + [f"text {k}." for k in range(6)]
        for turn in range(rng.randint(1, 9)):
            turn = rng.choice([turn, turn, turn, None, turn * 2, 0])
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    rows += rows[:20]
    rows += [(500, k, "tool", f"t{k}.") for k in range(7)] + [(501, 1, "assistant", "x.")]
    dropped = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "gone.")], dropped


def test_repair_is_the_cheapest(spark):
    rows, dropped = random_rows()
    schema = "conv_id long, turn long, role string, text string, kind string, audit string, name string"
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema).repartition(5)
    want = expected({r[0] for r in rows}, damaged(rows))
    got = {r[0]: tuple(r[1:]) for r in repair_damaged(table).collect()}
    assert got == {k: v[0] for k, v in want.items()}
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    plain = {r[0]: tuple(r[1:]) for r in repair_conversations(table).collect()}
    whole = expected({r[0] for r in rows}, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    assert plain == {k: v[0] for k, v in whole.items()}
    turns = {}
    for r in sorted(repaired_turns(table).collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.place)):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert turns == {k: list(v[1]) for k, v in whole.items() if v[1]}
    empty = spark.createDataFrame([], schema)
    assert repair_damaged(empty).collect() == [] == repaired_turns(empty).collect()


def test_query_equals_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected({r[0] for r in rows}, damaged(rows))
    assert {r[0]: tuple(r[1:]) for r in QUERIES["op12_conversation_repair"](spark, SF).collect()} == {k: v[0] for k, v in want.items()}


def test_long_conversations_leave_memory(monkeypatch):
    monkeypatch.setattr(cr, "HELD", 64)
    sys.setrecursionlimit(20000)
    rng = random.Random(2)
    for roles in (["tool"] * 301, [rng.choice(["user", "assistant", "system", "tool"]) for _ in range(300)]):
        now = cr.Conversation(cr.Steps())
        faults = [rng.choice([0, 0, 0, 1, 3]) for _ in roles]
        for k, (role, fault) in enumerate(zip(roles, faults, strict=True)):
            now.add(k, role, f"t{k}.", 3 * "sua".find(role[0]) + (1 if fault == 1 else 2 if fault == 3 else 0) if role[0] in "sua" else 9 + (1 if fault == 1 else 2 if fault == 3 else 0), fault)
        assert now.trace.blocks == 4 and len(now.steps.made) < 2000
        cost, audit, left = best(tuple((r, f"t{k}.", f) for k, (r, f) in enumerate(zip(roles, faults, strict=True))))
        assert now.result()[5:] == (cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
