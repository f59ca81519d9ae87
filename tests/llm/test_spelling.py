import random
import re
import zlib
from collections import Counter

import pytest

from gridsquall.llm.spelling import near_words, spelling_variants, thinned_words


def words_of(docs, least_count=3):
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1 :]
            if len(run) >= 5:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= least_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(count):
    near = {w: [v for v in count if v != w and one_edit(w, v)] for w in count}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-count[v], v.encode()), default=None)
        form[w] = best if best is not None and count[best] >= 2 * count[w] else None
    out = set()
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None))
    return out


def got(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("most", [2, 4, 48])
def test_against_all_pairs(spark, most):
    rng = random.Random(most)
    letters = "abeéÿ"
    count = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 8))): rng.randint(3, 60) for _ in range(500)}
    for w in list(count)[:120]:
        k = rng.randrange(len(w) + 1)
        for v in (w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :]):
            if v:
                count.setdefault(v, rng.randint(3, 200))
    df = spark.createDataFrame(list(count.items()), "word string, n long").repartition(3)
    assert got(spelling_variants(df, most=most)) == brute(count)
    pairs = {(r.a, r.b) for r in near_words(df, most).collect()}
    assert pairs == {(a, b) for a in count for b in count if a.encode() < b.encode() and one_edit(a, b)}


def test_a_crowded_block_is_subdivided_without_loss(spark):
    """Hundreds of words that share their first half, and their last."""
    rng = random.Random(1)
    tails = {"".join(rng.choice("abcd") for _ in range(6)) for _ in range(400)}
    count = {f"gemein{t}": 3 for t in tails} | {f"{t}schaft": 4 for t in tails}
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    assert got(spelling_variants(df, most=8)) == brute(count)


def test_runs_letters_lost_and_counts(spark):
    rng = random.Random(2)
    vocabulary = ["Straße", "STRASSE", "straßen", "cafés", "CafÉS", "naive", "naïve", "na×ve", "abcde", "abcdf", "łabcdef", "word", "x" * 300, "x" * 299]
    docs = [(i, " ".join(rng.choice(vocabulary) + rng.choice(["", ".", "-", "1"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs += [(None, "abcde abcde abcde"), (7, None), (8, ""), (8, "abcde"), (8, "abcde")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n long")
    count = {r.word: r.n for r in thinned_words(df).collect()}
    assert count == words_of(docs)
    assert any(len(w) == 298 for w in words_of(docs, 1)) or "x" * 299 in count
    assert got(spelling_variants(thinned_words(df))) == brute(count)


def test_chains_ties_and_empty_tables(spark):
    count = {"abcde": 3, "abcdf": 6, "abcff": 12, "abfff": 24, "afcde": 6, "zzzzz": 5}
    r = {x[0]: x for x in got(spelling_variants(spark.createDataFrame(list(count.items()), "word string, n long")))}
    assert r["abcde"][1:3] == ("abcdf", "abfff") and r["afcde"][1] is None and r["zzzzz"][1:3] == (None, "zzzzz")
    assert got(spelling_variants(spark.createDataFrame([], "word string, n long"))) == set()
    assert thinned_words(spark.createDataFrame([], "doc_id long, text string")).count() == 0
