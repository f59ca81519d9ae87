"""Language of code-switched text by a linear-chain conditional random field.

Each word has a label.  Emission scores add up learned weights of hashed features:
the word itself (lexicon), its first and last two and three bytes (affixes), and every
two- and three-byte gram inside it.  Transition scores are learned, too.  Posterior
label probabilities of all words come from forward-backward, and a text's language is
the label with the largest posterior sum.

Forward-backward runs over a whole batch at once: texts are cut into blocks of
``BLOCK`` words, each block's product of potential matrices is built side by side, the
block boundaries are passed along, and the posteriors inside all blocks follow side by
side.  So a very long text costs as many array steps as a short one, plus one for each
of its blocks.

Training texts are made code-switched by putting runs of words of several languages
together, so transitions between labels are seen.  The model is fitted on the driver
to at most ``max_train`` documents, those with the smallest hash of their id.

Defined results: ``und`` with score 0 for a null text or one without a letter; a text
of letters only between other characters is labelled as usual; with nothing to learn
from, every text is ``und``; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsquall.llm import textnum
from gridsquall.llm.common import least_hashes, runs

BITS, BLOCK = 17, 64
MASK = np.uint64((1 << BITS) - 1)
#: Digits part words too: only letters and other characters beyond ASCII tell languages.
TABLE = np.array([0 if 48 <= c <= 57 else int(textnum.LETTERS[c]) for c in range(256)], np.uint8)


def gram_slots(w: textnum.Words, n: int) -> np.ndarray:
    """The weight row of the ``n``-byte gram at each byte (only those inside a word count)."""
    if len(w.raw) < n:
        return np.zeros(0, np.int64)
    h = np.full(len(w.raw) - n + 1, np.uint64(n * 77))
    for k in range(n):
        h = h * np.uint64(1_000_003) + w.codes[k : len(w.raw) - n + 1 + k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)


def whole_slots(w: textnum.Words) -> list[np.ndarray]:
    """The weight rows of each word's lexicon and affix features."""
    a, z = w.start, w.end
    out = [w.of_words()]
    for n in (2, 3):
        out.append(textnum.mix(w.hashes(a, np.minimum(a + n, z)) + np.uint64(n)))
        out.append(textnum.mix(w.hashes(np.maximum(z - n, a), z) + np.uint64(10 + n)))
    return [(h & MASK).astype(np.int64) for h in out]


def gram_range(w: textnum.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word, the first gram of ``n`` bytes and one past its last."""
    return w.start, np.maximum(w.end - n + 1, w.start)


def emissions(w: textnum.Words, weights: np.ndarray) -> np.ndarray:
    """Words x labels scores."""
    e = np.zeros((len(w.start), weights.shape[1]))
    for slots in whole_slots(w):
        e += weights[slots]
    for n in (2, 3):
        g = gram_slots(w, n)
        c = np.zeros((len(g) + 1, weights.shape[1]))
        np.cumsum(weights[g], 0, out=c[1:])
        a, z = gram_range(w, n)
        ok = z > a
        e[ok] += (c[z[ok]] - c[a[ok]]) / np.sqrt(z[ok] - a[ok])[:, None]
    return e


def posteriors(e: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Label probabilities of each word, by forward-backward in every text at once.

    ``first`` holds the number of each text's first word, and the number of words.  Before
    a text's first word stands one of no content, whose label is free.
    """
    return forward_backward(e, trans, first)[0]


def forward_backward(e: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word the label probabilities given its whole text, and given the words up to it."""
    n, k = e.shape
    if not n:
        return e, e
    pot = np.exp(e - e.max(1, keepdims=True))
    step = np.exp(trans - trans.max())
    words = np.diff(first)
    blocks = -(-words // BLOCK)
    base = np.concatenate(([0], np.cumsum(blocks)))
    total = int(base[-1])
    text = np.repeat(np.arange(len(words)), blocks)
    start = first[text] + (np.arange(total) - base[text]) * BLOCK
    size = np.minimum(BLOCK, first[text + 1] - start)
    order = np.argsort(-size, kind="stable")  # so that the blocks still running come first
    start, size = start[order], size[order]
    live = np.searchsorted(-size, -np.arange(BLOCK), "left")  # blocks of more than t words
    unit = lambda x: x / x.sum(tuple(range(1, x.ndim)), keepdims=True)
    # product over each block of step * diag(potential), scaled
    prod = np.repeat(np.eye(k)[None], total, 0)
    for t in range(int(size[0])):
        m = live[t]
        prod[:m] = unit((prod[:m] @ step) * pot[start[:m] + t][:, None, :])
    by_place = np.empty(total, np.int64)
    by_place[order] = np.arange(total)
    # what comes into each block from the left and from the right
    left, right = np.full((total, k), 1.0 / k), np.full((total, k), 1.0 / k)
    longest = int(blocks.max())
    many = np.argsort(-blocks, kind="stable")
    count = np.searchsorted(-blocks[many], -np.arange(longest), "left")
    for j in range(1, longest):
        own = base[many[: count[j]]] + j
        left[by_place[own]] = unit(np.einsum("bi,bij->bj", left[by_place[own - 1]], prod[by_place[own - 1]]))
    for j in range(longest - 2, -1, -1):
        own = base[many[: count[j + 1]]] + j
        right[by_place[own]] = unit(np.einsum("bij,bj->bi", prod[by_place[own + 1]], right[by_place[own + 1]]))
    alpha = np.empty((n, k))
    a = left.copy()
    for t in range(int(size[0])):
        m = live[t]
        a[:m] = unit((a[:m] @ step) * pot[start[:m] + t])
        alpha[start[:m] + t] = a[:m]
    forward = alpha.copy()
    b = right
    for t in range(int(size[0]) - 1, -1, -1):
        m = live[t]
        at = start[:m] + t
        now = b[:m].copy()
        b[:m] = unit((pot[at] * now) @ step.T)
        alpha[at] = unit(alpha[at] * now)
    return alpha, forward


def pair_counts(p: np.ndarray, forward: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Expected number of each pair of neighbouring labels, where word ``t`` has the label
    probabilities ``p[t]``: a predecessor's share is what it gives to the forward sum."""
    if not len(p):
        return np.zeros_like(trans)
    before = np.concatenate((np.zeros((1, p.shape[1])), forward[:-1]))
    before[first[:-1][np.diff(first) > 0]] = 1.0 / p.shape[1]
    step = np.exp(trans - trans.max())
    return step * (before.T @ (p / (before @ step)))


@dataclass
class Field:
    labels: list[str]
    weights: np.ndarray  # feature rows x labels
    trans: np.ndarray


def fit(texts: list[str], langs: list[str], *, epochs: int = 4, rate: float = 0.15, seed: int = 5) -> Field:
    """Adagrad on the log likelihood of code-switched word sequences made from the texts."""
    labels = sorted(set(langs))
    k = len(labels)
    f = Field(labels, np.zeros((1 << BITS, k), np.float32), np.zeros((k, k)))
    if not k:
        return f
    rng = np.random.default_rng(seed)
    cut = str.maketrans({c: " " for c in map(chr, range(128)) if not TABLE[ord(c)]})
    pools = {lang: [] for lang in labels}
    for t, lang in zip(texts, langs, strict=True):
        words = t.translate(cut).split()
        pools[lang] += [words[i : i + 12] for i in range(0, len(words), 12)]
    spans = [(p, labels.index(lang)) for lang in labels for p in pools[lang] if p]
    gw, gt = np.full_like(f.weights, 1e-2), np.full((k, k), 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(spans))
        for lo in range(0, len(order), 512):
            own = [spans[i] for i in order[lo : lo + 512]]
            seqs = []  # two of three sequences go on in the same language, the third switches
            for i in range(0, len(own) - 2, 3):
                seqs += [[own[i], own[i + 1]], [own[i + 2]]]
            seqs = seqs or [own]
            w = textnum.read(pa.array([" ".join(x for p, _ in s for x in p) for s in seqs]), TABLE)
            gold = np.array([y for s in seqs for p, y in s for _ in p])
            if len(gold) != len(w.start):
                raise ValueError("words differ")
            p, forward = forward_backward(emissions(w, f.weights), f.trans, w.first)
            err = p.copy()
            err[np.arange(len(gold)), gold] -= 1
            rows, grads = [], []
            for slots in whole_slots(w):
                rows.append(slots)
                grads.append(err)
            for n in (2, 3):
                g = gram_slots(w, n)
                a, z = gram_range(w, n)
                each = np.repeat(np.arange(len(a)), z - a)
                at = np.arange(len(each)) - np.repeat(np.cumsum(z - a) - (z - a), z - a) + np.repeat(a, z - a)
                rows.append(g[at])
                grads.append(err[each] / np.sqrt(z - a)[each][:, None])
            row, grad = np.concatenate(rows), np.concatenate(grads)
            uniq, inverse = np.unique(row, return_inverse=True)
            d = np.stack([np.bincount(inverse, grad[:, c], len(uniq)) for c in range(k)], 1) / np.sqrt(len(gold)) + 1e-4 * f.weights[uniq]
            gw[uniq] += d * d
            f.weights[uniq] -= rate * d / np.sqrt(gw[uniq])
            # transitions: expected pairs less those of the labels seen
            seen = np.eye(k)[gold]
            dt = pair_counts(p, forward, f.trans, w.first) - pair_counts(seen, seen, f.trans, w.first)
            dt /= np.sqrt(len(gold))
            gt += dt * dt
            f.trans -= 0.3 * rate * dt / np.sqrt(gt)
    return f


def train_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = 1200, max_bytes: int = 4_000_000, held_out=None) -> Field:
    """Fits on at most ``max_train`` whole documents of ``max_bytes`` in all, outside the fold.

    They are taken in the order of a hash; one that does not fit into what is left of
    ``max_bytes`` is passed over.  Sizes are looked at before any text is fetched.
    """
    fold = held_out if held_out is not None else F.lit(False)
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(fold, F.lit(False)))
    some = rows.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("y"), F.octet_length(text_col).alias("n"))
    left, chosen = max_bytes, set()
    for r in least_hashes(some.select("h", "n"), "h", max_train, "n").collect():  # at most ``max_train`` pairs of numbers
        if r.n <= left and r.h not in chosen:
            left -= r.n
            chosen.add(r.h)
    got = sorted((r.h, r.t, r.y) for r in some.filter(F.col("h").isin(sorted(chosen))).dropDuplicates(["h"]).collect())
    return fit([t for _, t, _ in got], [y for _, _, y in got])


def label_words(col: pa.Array, field: Field) -> tuple[textnum.Words, np.ndarray]:
    """The words of each text and their label probabilities."""
    w = textnum.read(col, TABLE)
    return w, posteriors(emissions(w, field.weights), field.trans, w.first)


def predict_language(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text", und: str = "und") -> DataFrame:
    """``id, lang_pred, score, shares``: the label, its mean posterior, and that of every label."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    key = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        k = len(f.labels)
        for batch in runs(batches, 1, 2_000_000):
            col = batch.column(1)
            n = len(col)
            lettered = np.asarray(pc.match_substring_regex(col.fill_null(""), r"\p{L}"))
            if k:
                w, p = label_words(col, f)
                owner = w.owner()
                s = np.stack([np.bincount(owner, p[:, c], n) for c in range(k)], 1)
                s /= np.maximum(np.diff(w.first), 1)[:, None]
                best = s.argmax(1)
                ok = lettered & (np.diff(w.first) > 0)
                lang = [f.labels[b] if o else und for b, o in zip(best, ok, strict=True)]
                score = np.where(ok, np.clip(s[np.arange(n), best], 0, 1), 0.0)
                shares = [[{"lang": f.labels[c], "share": float(x[c])} for c in range(k)] if o else [] for x, o in zip(s, ok, strict=True)]
            else:
                lang, score, shares = [und] * n, np.zeros(n), [[]] * n
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(shares, kind)], names=[id_col, "lang_pred", "score", "shares"])

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {key}, lang_pred string, score double, shares array<struct<lang:string,share:double>>")
