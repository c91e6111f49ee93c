import hashlib
import itertools
import random
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from granary.llm import conversations as c

SPACES = " \t\n\x0b\x0c\r"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(x for x in text if x not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def solve(rows):
    """The cheapest edits by trying all, the least audit among them; rows of (role, text, fault)."""

    @cache
    def best(i, state):
        """(cost, audit, output roles and rows) to the end; inserts are tried two deep, which more never beats."""
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if i < len(rows):
            role, _, fault = rows[i]
            cost, audit, out = best(i + 1, state)
            found.append((cost + 3, "D" + audit, out))
            extra = fault == "truncated"
            if fault not in ("blank", "duplicate"):
                if role[:1] in NEXT[state] and role[:1]:
                    cost, audit, out = best(i + 1, NEXT[state][role[:1]])
                    found.append((cost + extra, "K" + audit, ((role, i), *out)))
                for to in ("user", "assistant"):
                    if to[0] in NEXT[state]:
                        cost, audit, out = best(i + 1, NEXT[state][to[0]])
                        found.append((cost + extra + 2, "R" + audit, ((to, i), *out)))
        found += inserted(i, state, 2)
        return min(found)

    def inserted(i, state, deep):
        found = []
        for to in ("user", "assistant"):
            if deep and to[0] in NEXT[state]:
                after = NEXT[state][to[0]]
                for cost, audit, out in [*plain(i, after), *inserted(i, after, deep - 1)]:
                    found.append((cost + 2, "I" + audit, ((to, None), *out)))
        return found

    def plain(i, state):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if i < len(rows):
            role, _, fault = rows[i]
            steps = [(3, "D", state, None)]
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                steps += [(extra, "K", NEXT[state][role[:1]], role)] if role[:1] and role[:1] in NEXT[state] else []
                steps += [(extra + 2, "R", NEXT[state][to[0]], to) for to in ("user", "assistant") if to[0] in NEXT[state]]
            for more, letter, after, kept in steps:
                cost, audit, out = best(i + 1, after)
                found.append((cost + more, letter + audit, ((kept, i), *out) if kept else out))
        return found

    return best(0, "")


def expected(rows, is_damaged=False):
    out = []
    order = lambda v: (v is not None, v or 0)
    groups = {}
    for r in rows if is_damaged else damage(rows):
        groups.setdefault(r[0], []).append(r)
    for conv in {r[0] for r in rows}:
        have = sorted(groups.get(conv, []), key=lambda r: (order(r[1]), hashlib.md5(f"{len(r[2])}:{r[2]}:{r[3]}".encode()).digest()))
        turns, seen, marked = [r[1] for r in have if r[1] is not None], set(), []
        for _, _, role, text in have:
            bare = text.strip(SPACES)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        count = lambda f: sum(m[2] == f for m in marked)  # noqa: B023, E731
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, kept = solve(marked)
        text = "\n".join(f"{role}:{'' if i is None else marked[i][1]}" for role, i in kept)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def chats(seed, convs=120, longest=12):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant"] * 6 + ["system", None, "tool", "", "aide"]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No!", "What?", "well", " \n", "", None, "é. ", "Yes.", f"{turn}."])
            rows.append((conv, rng.choice([turn, turn, turn * 2, None]), role, text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seq int")


@pytest.mark.parametrize("block", [4096, 1, 2, 3])
def test_rows_equal_brute_force(spark, monkeypatch, block):
    """All conversations, whole and cut into blocks, whose costs and paths must meet at every cut."""
    monkeypatch.setattr(c, "BLOCK", block)
    rows = chats(block)
    got = sorted(map(tuple, c.report(frame(spark, rows).repartition(3)).collect()), key=repr)
    assert got == expected(rows)
    assert {x for r in got for x in r[7]} == set("DIKR")


def test_a_long_conversation_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", 64)
    rows = [(7, *r[1:]) for r in chats(3, 200)][:700]
    rows = [(7, i, r[2], f"{i} {r[3]}" if i % 5 else r[3]) for i, r in enumerate(rows)]
    got = [tuple(r) for r in c.report(frame(spark, rows)).collect()]
    assert got == expected(rows)


def test_damage(spark):
    rows = chats(1)
    got = c.damaged(frame(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, damage(rows)))


def test_conversations_without_rows(spark):
    gone = next(n for n in range(1000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    got = [tuple(r) for r in c.report(frame(spark, [(gone, 0, "user", "Hi.")])).collect()]
    assert got == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert c.report(frame(spark, [])).count() == 0


def test_many_equal_rows_are_split(spark):
    """One row repeated by the thousand: all but the first are duplicates; no part of the sort holds them all."""
    rows = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("Hi.").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered, found, _ = c.repair(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tuple(found.groupBy().sum("duplicate", "cost").first()) == (2999, 2999 * 3 + 2)
    assert ordered.select(F.shiftright("seq", 33)).distinct().count() > 1
