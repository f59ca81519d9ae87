import bisect
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridsquall.llm.packing import PARTS, best_configuration, grouped_plan, pack_documents, plan_packing
from gridsquall.llm.queries import vocabulary


def check_plan(hist, capacity):
    rows, bins = plan_packing(hist, capacity)
    fill, seen = {}, Counter()
    for n, first, count, s, off in rows.tolist():
        for i in range(count):
            fill.setdefault(s + i, []).append((off, n))
            seen[n, first + i] += 1
    assert seen == Counter({(n, i): 1 for n, c in hist.items() for i in range(c)})
    for own in fill.values():
        at = 0
        for off, n in sorted(own):
            assert off == at
            at += n
        assert at <= capacity
    assert set(fill) == set(range(bins))
    return bins


def best_fit_decreasing(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(room, n)
        r = room.pop(k) - n if k < len(room) else capacity - n
        bisect.insort(room, r)
    return len(room)


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_complete_and_tight(seed):
    rng = np.random.default_rng(seed)
    n = np.clip(rng.lognormal(4 + seed * 0.4, 1.0, 4000).astype(int), 1, 512)
    hist = dict(Counter(n.tolist()))
    bins = check_plan(hist, 512)
    assert bins <= best_fit_decreasing(n.tolist(), 512) * 1.005 + 1


@pytest.mark.parametrize("part", PARTS)
def test_each_bound_of_large_lengths_is_near_the_total(part):
    rng = np.random.default_rng(part)
    n = np.clip(rng.lognormal(5.5, 1.2, 20_000).astype(int), 1, 2048)
    hist = {int(k): int(c) for k, c in zip(*np.unique(n, return_counts=True), strict=True)}
    _, bins = grouped_plan(hist, 2048, 40, 2048 // part + 1)
    least = max(-(-int(n.sum()) // 2048), int((n > 1024).sum()))
    assert least <= bins <= 1.04 * least + 2
    assert plan_packing(hist, 2048)[1] <= bins


def test_small_plans():
    assert check_plan({}, 10) == 0
    assert check_plan({10: 3}, 10) == 3
    assert check_plan({1: 25}, 10) == 3
    assert check_plan({6: 4, 4: 4}, 10) == 4
    assert check_plan({5: 1}, 10) == 1
    assert check_plan({7: 1000, 3: 1000}, 10) == 1000


def test_knapsack_against_brute_force():
    rng = random.Random(0)
    for _ in range(20):
        sizes = np.array(rng.sample(range(2, 12), 3))
        value = np.array([rng.random() for _ in sizes])
        best = max(a * value[0] + b * value[1] + c * value[2] for a in range(9) for b in range(9) for c in range(9) if a * sizes[0] + b * sizes[1] + c * sizes[2] <= 16)
        got, counts = best_configuration(value, sizes, 16)
        assert abs(got - best) < 1e-9 and abs(counts @ value - best) < 1e-9 and counts @ sizes <= 16


def test_pack_documents(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["ab", "the", "é"]) for _ in range(rng.randrange(1, 300)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "z q " * 3000), (None, "null id"), (0, rows[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, length int, piece int")
    got = pack_documents(docs, vocabulary("byte_bpe_50k.json"), capacity=128, with_ids=True).collect()
    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x in rows}
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        raw = np.array(own, "<u4").tobytes()
        assert bytes(r.ids) == raw and r.ids_crc32 == zlib.crc32(raw)
        assert (len(ids[r.doc_id]) > 128) == any(x.piece > 0 for x in got if x.doc_id == r.doc_id)
    assert sum(r.length for r in got) == sum(len(ids[d]) for d, _ in rows)
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in fill.values():
        at = 0
        for off, n in sorted(own):
            assert off == at
            at += n
        assert at <= 128
    assert pack_documents(docs.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0
