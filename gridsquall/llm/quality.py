"""Document quality by a factorisation machine.

Features of a whole text: hashed words with their share of the text, and binned
statistics of its structure (case, marks, repetition, line and word lengths) and size.
Score: ``sigmoid(b + sum w x + 1/2 sum_f ((sum v_f x)^2 - sum v_f^2 x^2))``, which is
every pairwise interaction in time linear in the features.

The model is fitted on the driver to at most ``max_train`` labelled documents, those
with the smallest hash of their id, on whole texts; their features come from the
executors.  Scoring reads every document.

Defined results: a null, empty or word-free text is scored on its statistics alone;
repeated rows get equal scores; documents without a label, or with a null label, are
not learned from; with no labelled document every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsquall.llm import textnum
from gridsquall.llm.common import kept, least_hashes, runs

WORD_BITS = 15
BINS = 24
STATS = ("upper", "exclaim", "bar", "digit", "other_marks", "high_bytes", "long_words", "short_words", "distinct", "repeated_lines", "line_length", "word_length", "words", "sentences", "word_marks", "top_word")
FEATURES = (1 << WORD_BITS) + BINS * len(STATS)


def share(value: np.ndarray, total: np.ndarray) -> np.ndarray:
    return value / np.maximum(total, 1)


def binned(x: np.ndarray) -> np.ndarray:
    """Shares from 0 to 1 in bins that are fine near both ends."""
    odds = np.log((x + 0.002) / (1.002 - x))
    return np.clip(np.floor((odds + 6.3) / 12.6 * (BINS - 1)) + 1, 0, BINS - 1).astype(np.int64) * (x > 0)


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, feature numbers and values of each text of a column."""
    w = textnum.read(col, textnum.LETTERS)
    n, o = len(col), w.offsets
    size = np.diff(o)

    def tally(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask)))
        return (c[o[1:]] - c[o[:-1]]).astype(float)

    raw, owner = w.raw, w.owner()
    words = np.diff(w.first).astype(float)
    length = w.end - w.start
    per = lambda v: np.bincount(owner, v, n)
    upper, letters = (raw >= 65) & (raw <= 90), ((raw | 32) >= 97) & ((raw | 32) <= 122)
    newline = raw == 10
    marks = (w.codes == 0) & (raw > 32)
    # distinct words and their counts in each text
    h = w.of_words()
    key = np.lexsort((h, owner))
    hs, ow = h[key], owner[key]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ow[1:] != ow[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(hs))).astype(float)
    who, kind = ow[at], hs[at]
    top = np.zeros(n)
    np.maximum.at(top, who, count)
    # repeated lines
    cut = np.concatenate((o[:-1], np.flatnonzero(newline) + 1))
    cut = np.unique(cut[cut < len(raw)])
    line_of = np.searchsorted(o, cut, "right") - 1
    line_end = np.append(cut[1:], len(raw)) if len(cut) else cut
    lh = w.hashes(cut, line_end - newline[line_end - 1])
    order = np.lexsort((lh, line_of))
    same = (lh[order][1:] == lh[order][:-1]) & (line_of[order][1:] == line_of[order][:-1])
    lines = np.bincount(line_of, minlength=n).astype(float)
    again = np.bincount(line_of[order][1:][same], minlength=n).astype(float)
    log_bin = lambda v, step: np.clip(np.floor(np.log1p(v) / step), 0, BINS - 1).astype(np.int64)
    stats = np.stack(
        [
            binned(share(tally(upper), tally(letters))),
            binned(share(tally(raw == 33), size)),
            binned(share(tally(raw == 124), size)),
            binned(share(tally((raw >= 48) & (raw <= 57)), size)),
            binned(share(tally(marks & (raw != 33) & (raw != 124) & (raw != 46) & (raw != 44)), size)),
            binned(share(tally(raw >= 128), size)),
            binned(share(per(length > 8), words)),
            binned(share(per(length <= 3), words)),
            binned(share(np.bincount(who, minlength=n), words)),
            binned(share(again, lines)),
            log_bin(share(size, lines), 0.5),
            log_bin(share(per(length), words), 0.15),
            log_bin(words, 0.5),
            binned(share(tally(raw == 46), words).clip(0, 1)),
            binned(share(tally(marks), words).clip(0, 1)),
            binned(share(top, words)),
        ],
        1,
    )
    index = (1 << WORD_BITS) + np.arange(len(STATS)) * BINS + stats
    value = share(np.sqrt(count), np.sqrt(words)[who])
    rows = np.concatenate((who, np.repeat(np.arange(n), len(STATS))))
    index = np.concatenate(((kind >> np.uint64(64 - WORD_BITS)).astype(np.int64), index.ravel()))
    value = np.concatenate((value, np.full(n * len(STATS), 1.0)))
    order = np.argsort(rows, kind="stable")
    return np.searchsorted(rows[order], np.arange(n + 1)), index[order], value[order]


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray  # features x rank

    def raw(self, starts: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and the sums of ``v x`` by text."""
        vx = self.v[index] * value[:, None].astype(np.float32)
        both = np.concatenate((vx, vx * vx, (self.w[index] * value)[:, None].astype(np.float32)), 1)
        k = self.v.shape[1]
        s = np.add.reduceat(both, starts[:-1], 0).astype(float) if len(starts) > 1 else np.zeros((0, 2 * k + 1))
        return self.bias + s[:, -1] + 0.5 * (s[:, :k] ** 2 - s[:, k : 2 * k]).sum(1), s[:, :k]

    def score(self, starts: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(starts, index, value)[0], -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], rank: int = 8, epochs: int = 12, rate: float = 0.05, seed: int = 7) -> Machine:
    """Adagrad on log loss over (feature numbers, values, label) rows, in batches of 64."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(FEATURES, np.float32), (rng.standard_normal((FEATURES, rank)) * 0.02).astype(np.float32))
    if not rows:
        m.v[:] = 0
        return m
    mean = np.clip(np.mean([r[2] for r in rows]), 0.01, 0.99)
    m.bias = float(np.log(mean / (1 - mean)))
    gw, gv = np.full(FEATURES, 1e-3, np.float32), np.full((FEATURES, rank), 1e-3, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 64):
            own = [rows[i] for i in order[lo : lo + 64]]
            starts = np.concatenate(([0], np.cumsum([len(r[0]) for r in own])))
            index, value = np.concatenate([r[0] for r in own]), np.concatenate([r[1] for r in own])
            z, sums = m.raw(starts, index, value)
            err = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - np.array([r[2] for r in own])
            each = np.repeat(np.arange(len(own)), np.diff(starts))
            uniq, inverse = np.unique(index, return_inverse=True)
            e = (err[each] / len(own) ** 0.5 * value).astype(np.float32)
            dw = np.bincount(inverse, e, len(uniq)) + 1e-4 * m.w[uniq]
            grad = e[:, None] * (sums[each] - self_part(m.v[index], value))
            dv = np.stack([np.bincount(inverse, grad[:, f], len(uniq)) for f in range(rank)], 1) + 1e-3 * m.v[uniq]
            gw[uniq] += dw * dw
            gv[uniq] += dv * dv
            m.w[uniq] -= rate * dw / np.sqrt(gw[uniq])
            m.v[uniq] -= 0.4 * rate * dv / np.sqrt(gv[uniq])
            m.bias -= 0.02 * float(err.mean())
    return m


def self_part(v: np.ndarray, value: np.ndarray) -> np.ndarray:
    return v * value[:, None]


def train_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 6000, max_features: int = 8_000_000, held_out=None) -> Machine:
    """Fits on the labelled rows outside the fold: at most ``max_train`` ids, in the order of a hash.

    Of rows with one id, that with the least text hash is taken.  A row whose features do
    not fit into what is left of ``max_features`` numbers is passed over.
    """
    fold = held_out if held_out is not None else F.lit(False)
    lab = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("double").alias("y")).filter(F.col("y").isNotNull() & F.col("i").isNotNull())
    lab = lab.withColumn(id_col, F.col("i")).filter(~fold).groupBy("i").agg(F.max("y").alias("y"))
    few = least_hashes(lab.withColumn("h", F.xxhash64("i")), "h", max_train, "i")
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(few), "i").select("h", "t", "y")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 1):
            s, index, value = features(batch.column(1))
            cut = [(index[a:z].astype(np.int32), value[a:z].astype(np.float32)) for a, z in zip(s[:-1], s[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(a) for a, _ in cut], pa.int64()), pa.array([a.tobytes() for a, _ in cut], pa.binary()), pa.array([v.tobytes() for _, v in cut], pa.binary()), batch.column(2)], names=["h", "n", "a", "v", "y"])

    text = F.xxhash64("t")
    once = rows.groupBy("h", "y").agg(F.min(text).alias("th")).join(rows, ["h", "y"]).filter(text.eqNullSafe(F.col("th"))).dropDuplicates(["h"])
    made = kept(once.select("h", "t", "y").mapInArrow(work, "h long, n long, a binary, v binary, y double"), "features")
    left, chosen = max_features, []
    for r in made.select("h", "n").orderBy("h").collect():  # ``max_train`` pairs of numbers
        if r.n <= left:
            left -= r.n
            chosen.append(r.h)
    sample = sorted((r.a, r.v, r.y) for r in made.filter(F.col("h").isin(chosen)).select("a", "v", "y").collect())
    return fit([(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32), y) for a, v, y in sample])


def score_quality(docs: DataFrame, machine: Machine, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``id, score`` of every document; with ``keep`` all columns of ``docs`` and the score."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs if keep else docs.select(id_col, text_col)
    at = rows.columns.index(text_col)
    out = [f for f in rows.schema if keep or f.name != text_col]
    places = [rows.columns.index(f.name) for f in out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", score double"
    names = [f.name for f in out] + ["score"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in runs(batches, at):
            s = m.score(*features(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*(batch.column(p) for p in places), pa.array(s)], names=names)

    return rows.mapInArrow(work, schema)
