import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gridsquall.llm.rules import BASE_RULES, COUNTS, RULES, Rule, cascade, judge, measure, order_rules, plan_cascade


def brute(text):
    """The counts and the verdict, by plain loops over one text."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    hit = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)}
    n, chars, symbols = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text))
    upper, letters, bangs = len(re.findall("[A-Z]", text)), sum(c.isascii() and c.isalpha() or c > "\x7f" for c in text), text.count("!")
    base = n < 50 or 100 * len(hit) > 50 * n
    bad = base or 5 * symbols > n or 2 * upper > letters or 10 * bangs > 3 * n or 2 * dup > len(lines) or chars > 12 * n or 2 * chars < 5 * n
    return (n, chars, symbols, dup, len(hit), base, not bad)


def texts():
    rng = random.Random(3)
    syllables = ["an", "the", "éau", "tion", "ß", "re", "日本", "or"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda n: "".join(word() + rng.choice([" ", " ", " ", ".\n", "\t", " \r\n"]) for _ in range(n))
    out = [prose(rng.randint(0, 150)) for _ in range(60)]
    out += [prose(80).upper(), prose(80).replace(" ", "$$ "), prose(80).replace(" ", "! "), (prose(6).replace("\n", " ") + "\n") * 30, "x" * 900 + " " + prose(60), "a b c " * 60, "a " * 70]
    out += [None, "", " \n\t", "\n\nword\nword\n", "one", "two words", "\x00 \x00 \x00 " * 20, "same line\nsame line \nsame line", prose(4000), "y" * 300_000, "\n" * 5000 + prose(70)]
    return out + out[:3]


def test_counts_and_verdicts_against_loops(spark):
    ts = texts()
    df = spark.createDataFrame([(k, t, k % 2 == 0, "x") for k, t in enumerate(ts)], "doc_id long, text string, kept boolean, n_words string")
    got = judge(df, plan_cascade(df), counts=True)
    assert got.columns == ["doc_id", *COUNTS, "base_failed", "kept", "rejected_by"]
    for r in got.collect():
        assert tuple(r[1:8]) == brute(ts[r.doc_id]), (r, (ts[r.doc_id] or "")[:80])
        assert (r.rejected_by is None) == r.kept


def test_the_order_changes_the_work_only(spark):
    ts = texts()
    rng = random.Random(4)
    rules = list(RULES)
    want = cascade(pa.array(ts, pa.string()), rules) < 0
    for _ in range(8):
        rng.shuffle(rules)
        first = cascade(pa.array(ts, pa.string()), rules)
        assert (first < 0).tolist() == want.tolist()


def test_rules_are_ordered_by_rejections_per_second():
    rules = tuple(Rule(n, lambda t: None) for n in "abcd")
    rejected = np.array([[1, 1, 1, 0, 0], [1, 1, 1, 1, 0], [0, 0, 0, 1, 0], [0, 0, 0, 0, 0]], bool)
    # b rejects most but is slow; after a only one text is left for b and c, and c is cheaper
    assert order_rules(rules, np.array([1.0, 3.0, 0.5, 0.1]), rejected) == ["a", "c", "d", "b"]
    seen = []
    spy = (Rule("all", lambda t: seen.append(len(t)) or np.ones(len(t), bool)), Rule("never", lambda t: seen.append(-1) or np.zeros(len(t), bool)))
    assert cascade(pa.array(["a", "b"]), list(spy)).tolist() == [0, 0] and seen == [2]


@pytest.mark.parametrize("sample", [0, 1, 50])
def test_any_bound_on_the_sample_plans_all_rules(spark, sample):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts())], "doc_id long, text string")
    assert sorted(plan_cascade(df, sample=max(1, sample), sample_bytes=sample * 1000)) == sorted(r.name for r in RULES)


def test_empty_tables_null_ids_and_other_types(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert plan_cascade(empty) == [r.name for r in RULES] and judge(empty, plan_cascade(empty)).count() == 0
    df = spark.createDataFrame([(None, "some text"), ("a", None), ("a", None)], "doc_id string, text string")
    rows = judge(df, [r.name for r in BASE_RULES]).collect()
    assert [(r.doc_id, r.kept, r.rejected_by) for r in rows] == [(None, False, "few words"), ("a", False, "few words"), ("a", False, "few words")]
    seconds, rejected = measure(RULES, [])
    assert seconds.tolist() == [0.0] * len(RULES) and rejected.shape == (len(RULES), 0)
