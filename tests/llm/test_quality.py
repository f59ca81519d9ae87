import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridsquall.llm import quality as Q
from gridsquall.llm import textnum


def test_words_and_hashes_against_python():
    texts = ["The cat. the CAT", "", None, "é ça\nx", "  lead", "trail  ", "a" * 1000, "no1 2way"]
    w = textnum.read(pa.array(texts).slice(0), textnum.LETTERS)
    raw = w.codes.tobytes()
    got = [[raw[a:z] for a, z in zip(w.start[i:j], w.end[i:j], strict=True)] for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
    table = bytes(int(c) or 32 for c in textnum.LETTERS)
    assert got == [(t or "").encode().translate(table).split() for t in texts]
    flat = [x for t in got for x in t]
    assert len(set(w.of_words().tolist())) == len(set(flat))
    sliced = textnum.read(pa.array(["skip", *texts]).slice(1), textnum.LETTERS)
    assert sliced.of_words().tolist() == w.of_words().tolist()


def test_score_is_every_pairwise_interaction():
    rng = np.random.default_rng(0)
    m = Q.Machine(0.3, rng.normal(size=Q.FEATURES).astype(np.float32), rng.normal(size=(Q.FEATURES, 3)).astype(np.float32))
    starts, index, value = Q.features(pa.array(["some words here some", "", None]))
    for k, got in enumerate(m.score(starts, index, value)):
        i, x = index[starts[k] : starts[k + 1]], value[starts[k] : starts[k + 1]]
        z = m.bias + float(m.w[i] @ x)
        z += sum(float(m.v[i[a]] @ m.v[i[b]]) * x[a] * x[b] for a in range(len(i)) for b in range(a + 1, len(i)))
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-4


def corpus(spark, n=600):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = " ".join(word() for _ in range(rng.randrange(5, 80)))
        docs.append((i, text if good else rng.choice([text.upper() + "!!", text.replace(" ", " | "), (text[:20] + "\n") * 9]), 1.5))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    fold = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    m = Q.train_quality(docs, labels, held_out=fold)
    got = Q.score_quality(docs, m).join(labels, "doc_id").filter(fold).select("score", "quality").collect()
    assert len(got) > 80
    assert np.mean([(r.score >= 0.5) == bool(r.quality) for r in got]) > 0.97
    again = Q.train_quality(docs.repartition(3), labels.repartition(2), held_out=fold)
    assert np.array_equal(m.v, again.v)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n"), (4, "word " * 40_000), (None, "x"), (4, "word"), (4, "word")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (4, None), (None, 0), (3, 1)], "doc_id long, quality int")
    m = Q.train_quality(docs, labels)
    rows = Q.score_quality(docs, m).collect()
    assert Counter(r.doc_id for r in rows) == Counter([1, 2, 3, 4, 4, 4, None])
    assert all(0 <= r.score <= 1 for r in rows)
    assert Q.score_quality(docs.limit(0), m).count() == 0
    none = Q.train_quality(docs, labels.limit(0))
    assert {r.score for r in Q.score_quality(docs, none).collect()} == {0.5}


def test_repeated_ids_and_the_bound_of_features(spark):
    docs, labels = corpus(spark, 200)
    m = Q.train_quality(docs, labels)
    again = Q.train_quality(docs.unionByName(docs).unionByName(docs.filter("doc_id < 50")), labels)
    assert np.array_equal(m.v, again.v) and np.array_equal(m.w, again.w)
    assert not Q.train_quality(docs, labels, max_features=0).v.any()
    assert Q.train_quality(docs, labels, max_features=2000).v.any()
