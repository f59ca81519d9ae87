import random

from gridsquall.llm.queries import vocabulary
from gridsquall.llm.wordpiece import LongestMatch, count_tokens, marked_pieces


def greedy(word, initial, inner):
    at, n, most = 0, 0, max(map(len, initial | inner))
    while at < len(word):
        pool = inner if at else initial
        size = next((k for k in range(min(most, len(word) - at), 0, -1) if word[at : at + k] in pool), 0)
        if not size:
            return 0
        at, n = at + size, n + 1
    return n


def test_counts_against_greedy_search():
    rng = random.Random(0)
    text = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    for _ in range(60):
        initial = {text(rng.randrange(1, 6)) for _ in range(rng.randrange(1, 15))}
        inner = {text(rng.randrange(1, 6)) for _ in range(rng.randrange(0, 25))}
        m = LongestMatch(initial, inner)
        for _ in range(150):
            w = text(rng.randrange(1, 14))
            assert m.count(w) == greedy(w, initial, inner), (w, initial, inner)


def test_table(spark):
    initial, inner = marked_pieces(vocabulary("piece_bpe_32k.model"))
    rows = [(1, "hello world, unbelievable"), (2, None), (3, ""), (4, " \n"), (5, "x" * 50_000), (6, "日本語 \x00"), (None, "a"), (1, "b")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n_words int")
    got = [tuple(r) for r in count_tokens(docs, LongestMatch(initial, inner)).collect()]
    a, b = set(initial), set(inner)
    want = []
    for i, t in rows:
        c = [greedy(w, a, b) for w in (t or "").split()]
        want.append((i, len(c), sum(x or 1 for x in c), c.count(0)))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert count_tokens(docs.limit(0), LongestMatch(initial, inner)).count() == 0
