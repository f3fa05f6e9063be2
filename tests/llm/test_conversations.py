"""Conversation repair against brute force: every audit up to a bound, every row."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetlog.llm import common as C
from packetlog.llm import conversations as V

ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                     T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("score", T.IntegerType())])
WHITE = " \t\n\x0b\f\r"
COST = {"K": 0, "R": 2, "D": 3, "I": 2}


def damage(rows):
    """[(turn, role, text)] of one conversation after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        out += [(turn, role, text)] * (2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        if not bare:
            out.append("B")
        elif (role, text) in seen:
            out.append("D")
        else:
            out.append("-" if bare[-1] in ".!?" else "T")
        seen.add((role, text))
    return out


def legal(initials):
    rest = initials[1:] if initials.startswith("s") else initials
    return initials == "" or rest != "" and rest == "ua" * (len(rest) // 2)


def cheapest(rows):
    """(cost, audit, repaired rows) by trying all edits, cost by cost."""
    marks, n = faults(rows), len(rows)
    best = None
    stack = [(0, 0, "", ())]
    bound = 3 * n
    while stack:
        i, cost, audit, done = stack.pop()
        if cost > bound or best and cost > best[0]:
            continue
        if i == n:
            if legal("".join(r[:1] or "-" for r, _ in done)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, done)
        if len(done) < n + 3:
            for role in ("user", "assistant"):
                stack.append((i, cost + 2, audit + "I", done + ((role, ""),)))
        if i < n:
            _, role, text = rows[i]
            stack.append((i + 1, cost + 3, audit + "D", done))
            if marks[i] not in "BD":
                more = marks[i] == "T"
                stack.append((i + 1, cost + more, audit + "K", done + ((role, text),)))
                for other in ("user", "assistant"):
                    stack.append((i + 1, cost + 2 + more, audit + "R", done + ((other, text),)))
    return best


def expected(conv, rows):
    rows = damage(rows)
    marks = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, done = cheapest(rows)
    whole = "\n".join(f"{r}:{t}" for r, t in done)
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, marks.count("B"), marks.count("D"), marks.count("T"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(whole.encode()).hexdigest())


def dynamic(rows):
    """(cost, audit) by a table over rows and states, for long conversations."""
    marks = faults(rows)
    ahead = {0: 2, 1: 2, 2: 3, 3: 2}

    def inserted(table):
        for _ in range(4):
            for q, (c, a) in list(table.items()):
                new = (c + 2, a + "I")
                if new < table.get(ahead[q], (10 ** 9, "")):
                    table[ahead[q]] = new
        return table

    table = {0: (0, "")}
    for (_, role, _), mark in zip(rows, marks):
        nxt = {}
        for q, (c, a) in inserted(table).items():
            steps = [(q, 3, "D")]
            if mark not in "BD":
                t = mark == "T"
                steps.append((ahead[q], 2 + t, "R"))
                to = {"s": 1 if q == 0 else None, "u": 2 if q != 2 else None, "a": 3 if q == 2 else None}.get(role[:1])
                if to is not None:
                    steps.append((to, int(t), "K"))
            for p, w, letter in steps:
                nxt[p] = min(nxt.get(p, (10 ** 9, "")), (c + w, a + letter))
        table = nxt
    table = inserted(table)
    return min(table[q] for q in (0, 3) if q in table)


def made(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        conv = None if conv == 3 else conv
        for k in range(rng.randint(1, longest)):
            turn = None if rng.random() < 0.05 else k + rng.randint(0, 2) * (rng.random() < 0.3)
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "no", "What? ", "fine!\n", "", " \t", None, "Well . . .", f"text {k}.", f"text {k}"])
            rows.append((conv, turn, role, text, 1))
    return rows


def collected(spark, rows):
    return {r["conv_id"]: tuple(r) for r in V.reports(V.damaged(spark.createDataFrame(rows, ROWS))).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = made(seed, 60, 4)
    rows += [(1000 + k, t, "user", "Hi.", 1) for k in range(3) for t in (1, 1, 2)]
    got = collected(spark, rows)
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[:4])
    assert got.keys() == by.keys()
    for conv, own in by.items():
        assert got[conv] == expected(conv, own), conv


def test_blocks_give_the_same(spark, monkeypatch):
    rows = made(7, 12, 90)
    whole = collected(spark, rows)
    monkeypatch.setattr(V, "BLOCK_BITS", 2)
    monkeypatch.setattr(V, "FAN_BITS", 2)
    assert collected(spark, rows) == whole
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[:4])
    for conv, own in by.items():
        assert whole[conv][6:8] == dynamic(damage(own)), conv


def test_search_against_all_paths():
    rng = random.Random(5)
    for n in range(6):
        for _ in range(25):
            rows = [(rng.choice("suax"), rng.choice("-TBD")) for _ in range(n)]
            for start, tail in itertools.product(range(4), (False, True)):
                for ends in ((0,), (1,), (2,), (3,), (0, 3)):
                    assert V.shortest(rows, start, ends, tail) == paths(rows, start, ends, tail)


def paths(rows, start, ends, tail):
    best, stack = None, [(0, start, 0, "")]
    while stack:
        i, q, cost, audit = stack.pop()
        if cost > 3 * len(rows) + 8:
            continue
        if i == len(rows) and q in ends and (best is None or (cost, audit) < best):
            best = (cost, audit)
        stack += [(j, p, cost + w, audit + letter) for w, letter, j, p in V._forward(rows, tail, i, q)]
    return best


def test_repaired_rows_and_edges(spark):
    rows = [(5, 0, "user", "Hi.", 1), (5, 1, "tool", "Hello.", 1), (6, None, None, None, 1)]
    plain = spark.createDataFrame(rows, ROWS).drop("score").withColumn("gone", F.lit(False))
    got = [tuple(r) for r in V.repaired(plain).orderBy("conv_id", "place").collect()]
    assert got == [(5, 1, "K", "user", "Hi."), (5, 2, "R", "assistant", "Hello.")]
    assert V.reports(plain.limit(0)).collect() == []
    none = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = collected(spark, [(none, 0, "user", "x", 1)])
    assert got[none] == (none, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_very_long_text(spark):
    text = "word " * 200_000
    got = V.repaired(spark.createDataFrame([(1, 0, "user", text, 1), (1, 1, "assistant", "Yes.", 1)], ROWS)).collect()
    assert sorted(r["text"] for r in got) == sorted([text, "Yes."])


def test_whole_table(spark):
    table = C.table(spark, "/root/testdata/sf0.01", "conversations")
    got = {r["conv_id"]: tuple(r) for r in V.op13_conversation_repair(spark, "/root/testdata/sf0.01").collect()}
    by = {}
    for r in table.collect():
        by.setdefault(r["conv_id"], []).append((r["conv_id"], r["turn"], r["role"], r["text"]))
    assert got.keys() == by.keys()
    for conv, own in by.items():
        assert got[conv][6:8] == dynamic(damage(own))
        if len(own) <= 4:
            assert got[conv] == expected(conv, own)
