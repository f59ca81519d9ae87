import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from gridsquall.llm.conversations import START, cheapest, damaged, repair_report, repaired_turns, search

LEGAL = re.compile(r"(s?(ua)+)?\Z")
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = {}
    for c, t, role, text in rows:
        mine = out.setdefault(c, [])
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        mine += [] if k == 0 else [(t, role, text)] * (2 if k == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(SPACE)
        out.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def follow(rows, fault, audit):
    """The repaired turns and cost of an audit string, or None if it does not fit."""
    out, cost, left = [], 0, list(zip(rows, fault, strict=True))
    for e in audit:
        need = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if e == "I":
            out.append((need, ""))
            cost += 5
            continue
        if not left:
            return None
        (_, role, text), f = left.pop(0)
        if e == "D":
            cost += 2
            continue
        if f in ("b", "d"):
            return None
        cost += (e == "R") + 5 * (f == "t")
        out.append((need if e == "R" else role, text))
    return None if left or not LEGAL.match("".join(r[:1] or "?" for r, _ in out)) else (cost, out)


def brute(rows, fault):
    """All audit strings with up to three inserted turns."""
    best = None
    for letters in product("DKR", repeat=len(rows)):
        for places in product(range(4), repeat=len(rows) + 1):
            if sum(places) <= 3:
                audit = "".join("I" * p + e for p, e in zip(places, letters, strict=False)) + "I" * places[-1]
                got = follow(rows, fault, audit)
                if got and (best is None or (got[0], audit) < best):
                    best = (got[0], audit)
    return best


def dynamic(rows, fault):
    """The same by a table over (rows, state) of least (cost, string)."""
    ways = {"": (0, "")}
    step = {"": "su", "s": "u", "u": "a", "a": "u"}

    def insert(ways):
        for _ in range(3):
            for s, (g, a) in list(ways.items()):
                to = "a" if s == "u" else "u"
                if to not in ways or ways[to] > (g + 5, a + "I"):
                    ways[to] = (g + 5, a + "I")
        return ways

    for (_, role, _), f in zip(rows, fault, strict=True):
        new = {}

        def put(s, g, a, new=new):
            if s not in new or new[s] > (g, a):
                new[s] = (g, a)

        for s, (g, a) in insert(ways).items():
            put(s, g + 2, a + "D")
            if f not in ("b", "d"):
                extra = 5 * (f == "t")
                if role[:1] and role[:1] in step[s]:
                    put(role[:1], g + extra, a + "K")
                put("a" if s == "u" else "u", g + 1 + extra, a + "R")
        ways = new
    return min(v for s, v in insert(ways).items() if s in ("", "a"))


def expected(rows):
    out = {}
    for c, v in damage(rows).items():
        f = faults(v)
        turns = [t for t, _, _ in v if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in v]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = dynamic(v, f)
        check, repaired = follow(v, f, audit)
        assert check == cost
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        out[c] = (gaps, f.count("b"), f.count("d"), f.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
        out[c, "turns"] = repaired
    return out


def code(rows, fault):
    return bytes({"s": 1, "u": 2, "a": 3}.get(r[:1], 0) | {"": 0, "b": 1, "d": 2, "t": 3}[f] << 2 for (_, r, _), f in zip(rows, fault, strict=True))


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", "User"]


def test_the_search_against_all_strings():
    rng = random.Random(0)
    for _ in range(60):
        rows = [(k, rng.choice(ROLES), "x.") for k in range(rng.randint(0, 4))]
        f = [rng.choice(["", "", "t", "b", "d"]) for _ in rows]
        assert brute(rows, f) == cheapest(code(rows, f)) == dynamic(rows, f)


@pytest.mark.parametrize("block", [1, 2, 5])
def test_blocks_give_the_same_cost_and_string(block):
    rng = random.Random(block)
    for _ in range(300):
        rows = [(k, rng.choice(ROLES), "x.") for k in range(rng.randint(0, 40))]
        f = [rng.choice(["", "", "", "t", "b", "d"]) for _ in rows]
        assert cheapest(code(rows, f), block) == dynamic(rows, f) == search(code(rows, f), START, (0, None, None, 0), True)[:2]


def table(seed, n=120):
    rng = random.Random(seed)
    text = lambda: rng.choice(["Yes.", "No!", "what?", "cut off", "", " \n", "é.\n", ". x", "Yes. ", "…"]) + rng.choice(["", "", str(rng.randrange(3)) + "."])
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 5, 9, 30])):
            rows.append((c, t * rng.choice([1, 1, 2]), rng.choice(ROLES[:5] * 4 + ROLES), text()))
    rows += [(None, None, None, None), (None, None, "user", "a."), (None, 3, "assistant", None), (7, None, "user", "q?"), (7, None, "assistant", "r."), (-1, None, None, None)]
    rows += [(5, 2, "user", "same."), (5, 2, "user", "same."), (500, 1, "user", "x" * 200_000)]
    rng.shuffle(rows)
    return rows


def run(spark, rows, **held):
    df = spark.createDataFrame([(*r, k, "z") for k, r in enumerate(rows)], "conv_id long, turn long, role string, text string, cost int, gone string").drop("gone")
    report = {r[0]: tuple(r)[1:] for r in repair_report(damaged(df), **held).collect()}
    turns = {}
    for r in repaired_turns(damaged(df), **held).orderBy("conv_id", "pos").collect():
        assert r.pos == len(turns.setdefault(r.conv_id, []))
        turns[r.conv_id].append((r.role, r.text))
    return report, turns


@pytest.mark.parametrize("held", [{}, {"held_rows": 4}, {"held_rows": 1, "held_chars": 1}])
def test_whole_tables(spark, held):
    rows = table(len(held))
    want = expected(rows)
    report, turns = run(spark, rows, **held)
    assert report == {k: v for k, v in want.items() if not isinstance(k, tuple)}
    assert all(turns.get(k, []) == want[k, "turns"] for k in report)


def test_one_long_conversation_is_spread_over_tasks(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(ROLES[:5]), rng.choice(["Fine.", "cut", ""]) + str(rng.randrange(400)) + rng.choice([".", ""])) for t in range(6000)] + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    want = expected(rows)
    report, _ = run(spark, rows)
    assert report == {k: v for k, v in want.items() if not isinstance(k, tuple)}


def test_dropped_conversations_and_empty_tables(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    report, turns = run(spark, [(gone, 0, "user", "x.")])
    assert report == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and turns == {}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair_report(damaged(empty)).count() == 0 and repaired_turns(empty).count() == 0
