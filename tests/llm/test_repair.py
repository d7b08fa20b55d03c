"""Conversation repair against a plain search over all cheapest edits."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ripplegraph.llm import common, queries, repair

SMALL = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"
ROW = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """rows: (role, text, must be deleted, truncated). (cost, audit, lines) of the least (cost, audit)."""
    steps = {0: 2, 1: 2, 2: 3, 3: 2}
    keeps = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    name = {2: "user", 3: "assistant"}
    far = (10**9, "", ())

    def inserted(base):
        for _ in range(4):
            base = {s: min(base[s], (5 + base[steps[s]][0], "I" + base[steps[s]][1], (name[steps[s]] + ":", *base[steps[s]][2]))) for s in base}
        return base

    best = inserted({0: (0, "", ()), 1: far, 2: far, 3: (0, "", ())})
    for role, text, gone, cut in reversed(rows):
        base = {}
        for s in range(4):
            found = [(2 + best[s][0], "D" + best[s][1], best[s][2])]
            if not gone:
                t = steps[s]
                found.append((1 + 5 * cut + best[t][0], "R" + best[t][1], (f"{name[t]}:{text}", *best[t][2])))
                if (k := keeps.get((role[:1], s))) is not None:
                    found.append((5 * cut + best[k][0], "K" + best[k][1], (f"{role}:{text}", *best[k][2])))
            base[s] = min(found)
        best = inserted(base)
    return best[0]


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        here = convs.setdefault(conv, [])
        show = lambda v: " " if v is None else str(v)
        fault = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        here += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = set()
    for conv, here in convs.items():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked, n = set(), [], [0, 0, 0]
        for _, role, text in here:
            blank, again, cut = not text.strip(WHITE), (role, text) in seen, text.rstrip(WHITE)[-1:] not in tuple(".!?")
            seen.add((role, text))
            cut = cut and not blank and not again
            n = [n[0] + blank, n[1] + (again and not blank), n[2] + cut]
            marked.append((role, text, blank or again, cut))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        turns = {t for t, _, _ in here if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, lines = cheapest(marked) if here else (0, "", ())
        out.add((conv, gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def noise(seed, convs, longest):
    rng = random.Random(seed)
    out = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Sure! ", "", " \t", None, "Why?", "ok", f"T{rng.randint(0, 99)}.", "é…", "a\nb."])
            out.append((c, rng.choice([t, t, t, t + 3, None]), role, text))
    return out


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in common.read(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op13_repair(spark, SMALL)) == brute(rows)


def test_random_conversations_and_blocks(spark, monkeypatch):
    rows = noise(1, 120, 9) + [(1000, t, r, x) for _, t, r, x in noise(2, 1, 1) + noise(3, 12, 9)] + [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (2000, 5, "user", "x" * 200_000 + ".")]
    df = spark.createDataFrame(rows, ROW)
    want = brute(rows)
    assert rows_of(repair.damaged_and_repaired(df.withColumn("costs", F.lit(1)).withColumn("block", F.lit("x")))) == want
    monkeypatch.setattr(repair.repair, "__defaults__", (3000,))  # blocks of two or three rows: conversations go over many
    assert rows_of(repair.damaged_and_repaired(df.repartition(3))) == want


def test_one_long_conversation(spark, monkeypatch):
    rows = [(7, t, r, x) for t, (_, _, r, x) in enumerate(noise(5, 300, 9))]
    df = spark.createDataFrame(rows, ROW)
    monkeypatch.setattr(repair.repair, "__defaults__", (100_000,))
    assert rows_of(repair.damaged_and_repaired(df)) == brute(rows)


def test_paths_of_least_audit():
    after = np.array([[0, 10, 5, 0]])
    # two user turns: the second goes to the assistant (R); assistant first: D or R, then what follows decides
    cost, state, _, _, _, letter = repair.walk(np.array([2, 2]), np.zeros(2, bool), np.zeros(2, np.int64), np.array([0]), after, np.array([0]))
    assert (cost[0], state[0], bytes(repair.LETTERS[letter])) == (1, 3, b"KR")
    cost, _, _, _, _, letter = repair.walk(np.array([3, 2, 3]), np.zeros(3, bool), np.zeros(3, np.int64), np.array([0]), after, np.array([0]))
    assert (cost[0], bytes(repair.LETTERS[letter])) == (2, b"DKK")


def test_empty_and_lost_conversations(spark):
    df = spark.createDataFrame([], ROW)
    assert rows_of(repair.damaged_and_repaired(df)) == set()
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = rows_of(repair.damaged_and_repaired(spark.createDataFrame([(lost, 0, "user", "Hi.")], ROW)))
    assert got == {(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
