import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridsquall.llm import language as L

SOUNDS = {"en": ["the", "ing", "th", "and", "er"], "de": ["sch", "ung", "der", "ü", "ein"], "es": ["ción", "ll", "os", "ñ", "que"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.mark.parametrize("first", [[0, 0, 5, 170, 171, 400], [0, 400], [0, 64, 128, 193, 400]])
def test_posteriors_against_plain_forward_backward(first):
    rng = np.random.default_rng(0)
    e, t = rng.normal(size=(400, 3)), rng.normal(size=(3, 3))
    got = L.posteriors(e, t, np.array(first))
    for a, b in zip(first[:-1], first[1:], strict=True):
        al, be, v = [], [], np.ones(3)
        for i in range(a, b):
            v = (v @ np.exp(t)) * np.exp(e[i])
            v /= v.sum()
            al.append(v)
        v = np.ones(3)
        for i in range(b - 1, a - 1, -1):
            be.append(v)
            v = np.exp(t) @ (np.exp(e[i]) * v)
            v /= v.sum()
        for i, q in enumerate(np.array(al) * np.array(be)[::-1] if b > a else []):
            assert np.allclose(got[a + i], q / q.sum())


def test_transition_gradient_against_differences():
    rng = np.random.default_rng(4)
    first, k = [0, 0, 5, 40, 140], 3
    e, t, gold = rng.normal(size=(140, k)), rng.normal(size=(k, k)), rng.integers(0, k, 140)

    def log_likelihood(t):
        total = 0.0
        for a, b in zip(first[:-1], first[1:], strict=True):
            if a == b:
                continue
            free, own = np.full(k, 1 / k), 0.0
            for i in range(a, b):
                free = (free @ np.exp(t)) * np.exp(e[i])
                total -= np.log(free.sum())
                free /= free.sum()
                own += e[i, gold[i]] + (t[gold[i - 1], gold[i]] if i > a else np.log(np.exp(t[:, gold[i]]).mean()))
            total += own
        return total

    p, forward = L.forward_backward(e, t, np.array(first))
    seen = np.eye(k)[gold]
    got = L.pair_counts(seen, seen, t, np.array(first)) - L.pair_counts(p, forward, t, np.array(first))
    for i in range(k):
        for j in range(k):
            d = np.zeros((k, k))
            d[i, j] = 1e-5
            assert np.isclose(got[i, j], (log_likelihood(t + d) - log_likelihood(t - d)) / 2e-5, atol=1e-5)


def test_words_of_switched_text():
    rng = random.Random(1)
    langs = [rng.choice(sorted(SOUNDS)) for _ in range(200)]
    f = L.fit([text(rng, y, 40) for y in langs], langs)
    a, b = text(rng, "de", 30), text(rng, "es", 30)
    w, p = L.label_words(pa.array([a + " " + b]), f)
    got = [f.labels[k] for k in p.argmax(1)]
    assert sum(g == y for g, y in zip(got, ["de"] * 30 + ["es"] * 30, strict=True)) > 57
    assert np.diag(f.trans).min() > f.trans[~np.eye(3, dtype=bool)].max()


def test_held_out_accuracy_and_edges(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, y, rng.randrange(3, 60)), y) for i in range(400) for y in [rng.choice(sorted(SOUNDS))]]
    odd = [(900, None, "en"), (901, "", None), (902, "12 34 !!", "en"), (903, text(rng, "de", 30_000), None), (None, "the", None), (905, "_—_", "en")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows + odd], "doc_id long, text string, lang string, score double")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    f = L.train_language(docs, held_out=fold)
    out = L.predict_language(docs, f)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows) + len(odd)
    assert {got[i].lang_pred for i in (900, 901, 902, 905)} == {"und"} and got[903].lang_pred == "de"
    held = [r.doc_id for r in docs.filter(fold & F.col("lang").isNotNull() & (F.col("doc_id") < 900)).collect()]
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert L.predict_language(docs.limit(0), f).count() == 0
    none = L.train_language(docs.limit(0))
    assert {r.lang_pred for r in L.predict_language(docs, none).collect()} == {"und"}
