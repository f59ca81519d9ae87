"""Benchmark decontamination with one Aho-Corasick automaton.

Words are lower-cased (A-Z only) and cut at every other ASCII character.  A window
is ``width`` consecutive words of a benchmark item; an item of fewer words is one
window.  All windows go into one automaton, so each text is scanned once, however
many items there are.  Its alphabet are the words of the items, so a window takes
a few nodes for each of its ``width`` words; any other word of a text leads to the root.

Defined results: a null or word-free text has no words and no hits; a null or
word-free item has no window; repeated items and rows count by themselves; a null
``item_id`` adds hits but no item.  Only the named columns are read, so other
columns may have any name.

The automaton is built from broadcast item texts.  Their total size is measured
first; beyond ``block_bytes`` the items are dealt into several automata, which a
task builds and uses one after another, for ``HELD`` bytes of text each time.  A window
takes about a kilobyte, 4 MB of items (some 650,000 windows) about 0.7 GB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsquall.llm.common import runs

#: Lower-cases A-Z and turns every ASCII character but letters and digits into a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


#: Digits that words are written with inside the automaton.
DIGITS = 128
#: Bytes of text that are held for one turn of several automata.
HELD = 64_000_000


def folded_words(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def item_windows(text: str | None, width: int) -> list[list[bytes]]:
    w = folded_words(text or "")
    return [w[i : i + width] for i in range(max(1, len(w) - width + 1))] if w else []


class Windows:
    """The automaton of all windows of the items; a value is the number of a distinct window.

    A node's ways out are searched one by one, so a word is written as a few digits, those
    of each place with letters of their own: no node has more than ``DIGITS`` ways, and no
    occurrence begins inside a word.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        import ahocorasick

        self.items = [i for i, _ in items]
        windows = [item_windows(text, width) for _, text in items]
        names = sorted({x for own in windows for w in own for x in w})
        self.letters = {w: k + 1 for k, w in enumerate(names)}  # 0: any other word
        places = 1
        while DIGITS**places <= len(names):
            places += 1
        n = np.arange(len(names) + 1)[:, None]
        self.digits = n // DIGITS ** np.arange(places) % DIGITS + DIGITS * np.arange(places)
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.sizes: list[int] = []
        self.owners: list[list[int]] = []
        for i, own in enumerate(windows):
            for w in own:
                key = tuple(self.digits[[self.letters[x] for x in w]].ravel().tolist())
                k = self.auto.get(key, len(self.sizes))
                if k == len(self.sizes):
                    self.auto.add_word(key, k)
                    self.sizes.append(len(w))
                    self.owners.append([i])
                elif self.owners[k][-1] != i:
                    self.owners[k].append(i)
        self.least = min(self.sizes, default=0)
        if self.sizes:
            self.auto.make_automaton()

    def scan(self, words: list[bytes], hit: np.ndarray | None, found: set[str]) -> np.ndarray | None:
        """Marks the words inside occurrences and collects the items; ``hit`` is made on first use."""
        if len(words) < self.least or not self.sizes:
            return hit
        letter = self.letters.get
        w = np.array([letter(x, 0) for x in words])
        edge = np.flatnonzero(np.diff(np.concatenate(([False], w > 0, [False])).astype(np.int8)))
        places, seen = self.digits.shape[1], set()
        for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # runs of words that items have
            if z - a < self.least:
                continue
            for end, k in self.auto.iter(tuple(self.digits[w[a:z]].ravel().tolist())):
                hit = np.zeros(len(words), bool) if hit is None else hit
                last = a + end // places + 1
                hit[last - self.sizes[k] : last] = True
                seen.add(k)
        found.update(self.items[i] for k in seen for i in self.owners[k] if self.items[i] is not None)
        return hit


def held(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Lists of batches whose texts add up to about ``limit`` bytes."""
    own, size = [], 0
    for batch in batches:
        own.append(batch)
        size += int(pa.compute.sum(pa.compute.binary_length(batch.column(column))).as_py() or 0)
        if size >= limit:
            yield own
            own, size = [], 0
    if own:
        yield own


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last character of each word in the original text."""
    raw = text.encode()
    word = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return chars[edge[::2]], chars[edge[1::2]]


def hit_spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as character offsets into the original text."""
    a, b = word_spans(text)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return [{"start": int(a[i]), "end": int(b[j - 1])} for i, j in zip(edge[::2], edge[1::2], strict=True)]


def item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> list:
    """The items as broadcasts of at most about ``block_bytes`` each."""
    spark = items.sparkSession
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // block_bytes))
    return [spark.sparkContext.broadcast([tuple(r) for r in rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()]) for b in range(n)]


def find_contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, block_bytes: int = 4_000_000, keep: bool = False) -> DataFrame:
    """Per document: words, hit words, the items found, and the hit spans of the original text.

    Columns: the id, ``n_words``, ``n_hit``, ``item_ids`` (sorted strings), ``spans``
    (array of start/end character offsets), ``contaminated``.  With ``keep``, all columns
    of ``docs`` come first; none may have one of these names.
    """
    blocks = item_blocks(items, item_id, item_text, block_bytes)
    rows = docs if keep else docs.select(id_col, text_col)
    at = rows.columns.index(text_col)
    first = [f for f in rows.schema if keep or f.name == id_col]
    places = [rows.columns.index(f.name) for f in first]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in first) + ", n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>, contaminated boolean"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = Windows(blocks[0].value, width) if len(blocks) == 1 else None
        for own in held(runs(batches, at), at, 0 if once else HELD):
            texts = [b.column(at).fill_null("").to_pylist() for b in own]
            hits: list[list[np.ndarray | None]] = [[None] * len(t) for t in texts]
            ids: list[list[set[str]]] = [[set() for _ in t] for t in texts]
            sizes = [[0] * len(t) for t in texts]
            for block in blocks:
                windows = once or Windows(block.value, width)
                for j, part in enumerate(texts):
                    for k, t in enumerate(part):
                        w = folded_words(t)
                        sizes[j][k] = len(w)
                        hits[j][k] = windows.scan(w, hits[j][k], ids[j][k])
            for j, batch in enumerate(own):
                n_hit = [0 if h is None else int(h.sum()) for h in hits[j]]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(p) for p in places),
                        pa.array(sizes[j], pa.int64()),
                        pa.array(n_hit, pa.int64()),
                        pa.array([sorted(x) for x in ids[j]], pa.list_(pa.string())),
                        pa.array([[] if h is None else hit_spans(t, h) for t, h in zip(texts[j], hits[j], strict=True)], span),
                        pa.array([n > 0 for n in n_hit], pa.bool_()),
                    ],
                    names=[f.name for f in first] + ["n_words", "n_hit", "item_ids", "spans", "contaminated"],
                )

    return rows.mapInArrow(work, schema)
