"""Quality rules as a short-circuit cascade, the most rejections for the least work first.

A rule looks at a batch of texts and says which it rejects.  ``plan_cascade`` measures every
rule on a bounded sample: what it costs a byte and which texts it rejects.  Rules are then
ordered greedily: the next is the one that rejects the most of what the rules before it have
left, per second of work.  ``judge`` runs the cascade over all whole texts; a rule only sees
the texts that passed the rules before it, so costly rules see few.  A text is kept if no
rule rejects it, which does not depend on the order; only the work does.

Counts are those of the whole text, taken over NumPy arrays of a run of texts at a time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsquall.llm import textnum
from gridsquall.llm.common import least_hashes, runs

#: Texts of the sample that the cascade is planned on, and their bytes.
SAMPLE, SAMPLE_BYTES = 1_000, 4_000_000
#: ASCII white space parts words; other bytes stay.  A zero byte takes a value that UTF-8 never has.
BY_BLANKS = np.array([255 if c == 0 else 0 if c in textnum.SPACES else c for c in range(256)], np.uint8)
SYMBOL = np.array([chr(c) in "#*$%&|<>" for c in range(256)])
UPPER = np.array([65 <= c <= 90 for c in range(256)])
LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
NEWLINE, BANG = 10, 33
WINDOW = textnum.mix(np.arange(1, 4, dtype=np.uint64) * np.uint64(textnum.BASE)) | np.uint64(1)


class Texts:
    """A run of texts, with the counts that rules ask for; each is taken once, when first asked for."""

    def __init__(self, col: pa.Array):
        self.col = col
        self.words = textnum.read(col, BY_BLANKS)

    def __len__(self) -> int:
        return len(self.col)

    def total(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes each text has."""
        s = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return np.diff(s[self.words.offsets])

    def by_text(self, at: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        """Sums of values (or counts) by the text number ``at``."""
        return np.bincount(at, values, len(self)).astype(np.int64)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words.first)

    @cached_property
    def word_chars(self) -> np.ndarray:
        w = self.words
        return self.total((w.codes != 0) & ((w.raw & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.total(SYMBOL[self.words.raw])

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self.total(UPPER[self.words.raw])

    @cached_property
    def n_letters(self) -> np.ndarray:
        w = self.words
        return self.total(LETTER[w.raw] & ((w.raw & 0xC0) != 0x80))

    @cached_property
    def n_bangs(self) -> np.ndarray:
        return self.total(self.words.raw == BANG)

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """The text number and hash of every line that has a word."""
        w = self.words
        cut = np.flatnonzero(w.raw == NEWLINE)
        start = np.unique(np.concatenate((w.offsets[:-1], cut + 1)))
        start = start[start < len(w.raw)]
        end = np.append(start[1:], len(w.raw))
        some = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
        start, end = start[some], end[some]
        end = end - (w.raw[end - 1] == NEWLINE)
        return np.searchsorted(w.offsets, start, "right") - 1, textnum.stretch_hashes(w.raw, start, end)

    @cached_property
    def n_lines(self) -> np.ndarray:
        return self.by_text(self._lines[0])

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        at, h = self._lines
        key = textnum.mix(h + at.astype(np.uint64) * np.uint64(textnum.BASE))
        _, first = np.unique(key, return_index=True)
        return self.n_lines - self.by_text(at[first])

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        w = self.words
        owner = w.owner()
        if len(owner) < 3:
            return np.zeros(len(self), np.int64)
        h = textnum.stretch_hashes(w.raw, w.start, w.end)
        window = h[:-2] * WINDOW[0] + h[1:-1] * WINDOW[1] + h[2:] * WINDOW[2]
        at = np.flatnonzero(owner[:-2] == owner[2:])
        key = textnum.mix(window[at] + owner[at].astype(np.uint64) * np.uint64(textnum.BASE))
        _, place, count = np.unique(key, return_inverse=True, return_counts=True)
        again = at[count[place] > 1]
        hit = np.zeros(len(owner), bool)
        for k in range(3):
            hit[again + k] = True
        return self.by_text(owner[hit])


@dataclass(frozen=True)
class Rule:
    """A name, and which texts of a run it rejects."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


#: The rules that every text must have passed, whatever the others say.
BASE_RULES = (
    Rule("few words", lambda t: t.n_words < 50),
    Rule("repeated words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
#: All rules.  Clean prose stays far from each bound; comparisons are of whole numbers.
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda t: 5 * t.n_symbols > t.n_words),
    Rule("capitals", lambda t: 2 * t.n_upper > t.n_letters),
    Rule("exclamation marks", lambda t: 10 * t.n_bangs > 3 * t.n_words),
    Rule("repeated lines", lambda t: 2 * t.n_dup_lines > t.n_lines),
    Rule("word length", lambda t: (t.word_chars > 12 * t.n_words) | (2 * t.word_chars < 5 * t.n_words)),
)


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> list[str]:
    """The names of the rules in the order to run them, measured on a bounded sample.

    The sample is that of the least hashes of id and text: at most ``sample`` texts of at most
    ``sample_bytes`` bytes together (a longer text is passed over).  Without any text, rules
    come in the order given.
    """
    key = F.xxhash64(F.col(id_col).cast("string"), text_col)
    sized = docs.select(key.alias("h"), F.octet_length(text_col).alias("n")).filter("n > 0")
    taken, left = [], sample_bytes
    for r in least_hashes(sized, "h", sample, "n").collect():
        if r.n <= left:
            taken.append(r.h)
            left -= r.n
    texts = sorted({r[0] for r in docs.filter(key.isin(taken)).select(text_col).limit(sample).collect()}) if taken else []
    return order_rules(rules, *measure(rules, texts))


def measure(rules: tuple[Rule, ...], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Seconds that each rule takes on the texts, and which texts it rejects (a row for each rule)."""
    seconds, rejected = np.zeros(len(rules)), np.zeros((len(rules), len(texts)), bool)
    for k, rule in enumerate(rules if texts else ()):
        tries = []
        for _ in range(3):
            t = Texts(pa.array(texts, pa.string()))
            began = time.thread_time()
            rejected[k] = rule.rejects(t)
            tries.append(time.thread_time() - began)
        seconds[k] = min(tries)
    return seconds, rejected


def order_rules(rules: tuple[Rule, ...], seconds: np.ndarray, rejected: np.ndarray) -> list[str]:
    """The next rule rejects the most of what is left, per second; of rules that reject nothing the cheapest is first."""
    left, open_, order = np.ones(rejected.shape[1], bool), list(range(len(rules))), []
    while open_:
        best = max(open_, key=lambda k: ((rejected[k] & left).sum() / max(seconds[k], 1e-9), -seconds[k], -k))
        open_.remove(best)
        order.append(rules[best].name)
        left &= ~rejected[best]
    return order


def cascade(col: pa.Array, rules: list[Rule]) -> np.ndarray:
    """The number of the first rule that rejects each text, -1 for texts that pass.

    Texts that are out leave the run once they are a quarter of it, so that the rules that
    follow do not count them.
    """
    out = np.full(len(col), -1)
    rows, texts = np.arange(len(col)), Texts(col)
    for k, rule in enumerate(rules):
        bad = rule.rejects(texts) & (out[rows] < 0)
        out[rows[bad]] = k
        left = out[rows] < 0
        if 4 * left.sum() <= 3 * len(rows):
            rows = rows[left]
            if not len(rows):
                break
            texts = Texts(col.take(pa.array(rows)))
    return out


#: The counts that ``judge`` gives on request.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, order: list[str], rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """``id, kept, rejected_by`` for every row of ``docs``, by the cascade in the given order.

    With ``counts`` also ``COUNTS`` and ``base_failed``; those are taken over every whole text.
    A null text counts as empty, which the rule on few words rejects.  Repeated rows and null
    ids are rows of their own; an empty table gives no rows; other columns are not read.
    """
    named = {r.name: r for r in rules}
    chain = [named[n] for n in order]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 1):
            col = batch.column(1)
            first = cascade(col, chain)
            found = [batch.column(0)]
            if counts:
                t = Texts(col)
                found += [pa.array(getattr(t, c), pa.int64()) for c in COUNTS]
                found.append(pa.array(np.logical_or.reduce([r.rejects(t) for r in BASE_RULES])))
            by = pa.array([order[k] if k >= 0 else None for k in first.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*found, pa.array(first < 0), by], names=names)

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    names = ["i", *(COUNTS if counts else ()), *(("base_failed",) if counts else ()), "kept", "rejected_by"]
    kinds = [rows.schema["i"].dataType.simpleString(), *(["bigint"] * len(COUNTS) if counts else []), *(["boolean"] if counts else []), "boolean", "string"]
    out = rows.mapInArrow(work, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))
    return out.withColumnRenamed("i", id_col)
