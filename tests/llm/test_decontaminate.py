import hashlib
import random
import re

from gridsquall.llm.decontaminate import Windows, find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, width):
    wins = [(i, tuple(w[k : k + width])) for i, t in items if (w := WORD.findall((t or "").translate(LOW))) for k in range(max(1, len(w) - width + 1))]
    out = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        hit, ids = set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    ids.add(str(i))
        out[d] = (len(w), len(hit), sorted(ids))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["Aa", "b", "É", "c9", "dd"])
    docs = [(i, " ".join(word() for _ in range(rng.randrange(40))) + rng.choice(["", "!", "\n"])) for i in range(150)]
    docs += [(900, None), (901, ""), (902, "... \n"), (903, "x" * 200_000), (904, docs[0][1])]
    items = [(i, "-".join(word() for _ in range(rng.choice([0, 1, 2, 3, 4, 7])))) for i in range(2, 14)] + [(30, None), (2, "aa")]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (64_000_000, 100):
        got = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in find_contamination(d, b, width=4, block_bytes=block).collect()}
        assert got == brute(docs, items, 4)
    assert find_contamination(d.limit(0), b).count() == 0
    assert find_contamination(d, b.limit(0)).filter("contaminated").count() == 0


def test_spans_are_in_the_original(spark):
    text = "Ünder — The QUICK\tbrown,fox! jumps"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = spark.createDataFrame([(5, "quick brown fox")], "item_id long, text string")
    r = find_contamination(d, b, width=3).first()
    assert [text[s.start : s.end] for s in r.spans] == ["QUICK\tbrown,fox"]
    assert r.n_hit == 3 and hashlib.sha256(b"5").hexdigest()


def test_words_of_several_digits():
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(20_000)]
    items = [(str(i), " ".join(rng.choice(vocabulary) for _ in range(120))) for i in range(100)]
    windows = Windows(items, 10)
    assert windows.digits.shape[1] == 2 and len(windows.sizes) == 100 * 111
    part = items[7][1].split()[30:50]
    words = [w.encode() for w in ["x", *vocabulary[:5], *part, vocabulary[3], "y", *part[:9]]]
    found: set[str] = set()
    hit = windows.scan(words, None, found)
    assert found == {"7"} and hit.tolist() == [False] * 6 + [True] * 20 + [False] * 11
    assert windows.scan([b"x"] * 50, None, set()) is None
