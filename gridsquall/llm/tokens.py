"""Token ids of whole texts with a public tokenizer, at the cost of its distinct chunks.

Both vocabularies first cut a text into pieces that are encoded each for itself.  A piece
never runs from a visible character over a space or a line end, from an ASCII letter over
ASCII punctuation but the apostrophe, or over a single line end between visible characters.
A text may be cut at all these places.  Its chunks are told apart by a 64-bit hash of their
bytes; every distinct chunk is encoded once by the ``tokenizers`` library, and a text's ids
are its chunks' ids put together.  The ids equal those of one call on the whole text; tests
compare the two.  Texts that hold a special token's string are encoded in one call.

Many chunks go to the library in one call with a separator between them, whose ids no
chunk has: a line end, or, where the tokenizer drops white space, a private character.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridsquall.llm import textnum

#: Chunks put together for one call, and bytes of text that are looked up at once.
JOINED, WINDOW = 2048, 1_000_000
SPACE, LINE = 32, 10
BLANK = np.array([c in (*range(9, 14), *range(28, 33)) for c in range(256)])
VISIBLE = np.array([33 <= c <= 126 for c in range(256)])
LETTER = np.array([c < 128 and chr(c).isalpha() for c in range(256)])
PUNCTUATION = VISIBLE & ~LETTER & np.array([not 48 <= c <= 57 and c != 39 for c in range(256)])
#: First bytes of characters among which are white space or the private separator.
SPECIAL_LEADS = np.array([c in (0xC2, 0xE1, 0xE2, 0xE3, 0xEE) for c in range(256)])
SAME_CASE = np.arange(256, dtype=np.uint8)
LOWER_CASE = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def chunk_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the chunks of texts, whose bytes follow each other in ``raw``, begin."""
    if not len(raw):
        return np.zeros(0, np.int64)
    at = np.flatnonzero((raw == SPACE) | (raw == LINE))
    at = at[at > 0]
    before = raw[at - 1]
    lead2, lead3 = raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
    at = at[VISIBLE[before] | ((before >= 128) & ~SPECIAL_LEADS[lead2] & ~SPECIAL_LEADS[lead3])]
    cut = np.zeros(len(raw), bool)
    cut[1:] = PUNCTUATION[raw[1:]] & LETTER[raw[:-1]]
    cut[at] = True
    lines = at[raw[at] == LINE]
    lines = lines[lines + 1 < len(raw)]
    cut[lines[VISIBLE[raw[lines + 1]]] + 1] = True
    cut[offsets[:-1][offsets[:-1] < len(raw)]] = True
    return np.flatnonzero(cut)


class ChunkEncoder:
    """Encodes string columns to unsigned 32-bit ids, remembering at most about ``remember`` chunks."""

    def __init__(self, path: str, remember: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.separator, self.separator_ids = next((s, ids) for s in ("\n", "\n\ue000\n") if len(ids := self._call([s])[0]))
        a, b = self._call(["A", "a"])
        self.codes = LOWER_CASE if np.array_equal(a, b) else SAME_CASE
        self.remember = remember
        self._forget()

    def _forget(self) -> None:
        self.keys, self.start, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _call(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, chunks: list[bytes]) -> list[np.ndarray]:
        """The ids of chunks without white space behind their first character."""
        ids = self._call([self.separator.encode().join(chunks).decode("utf-8", "replace")])[0]
        k = len(self.separator_ids)
        hit = np.ones(max(0, len(ids) - k + 1), bool)
        for j, s in enumerate(self.separator_ids):
            hit &= ids[j : len(hit) + j] == s
        at = np.flatnonzero(hit)
        if len(at) != len(chunks) - 1:
            return self._call([c.decode("utf-8", "replace") for c in chunks])
        return [ids[a:z] for a, z in zip([0, *(at + k).tolist()], [*at.tolist(), len(ids)], strict=True)]

    def _learn(self, keys: np.ndarray, chunks: list[bytes], alone: np.ndarray) -> None:
        order = np.argsort(alone, kind="stable")
        plain = int((~alone).sum())
        own = [chunks[k] for k in order.tolist()]
        found: list[np.ndarray] = []
        for i in range(0, plain, JOINED):
            found += self._together(own[i : min(i + JOINED, plain)])
        for i in range(plain, len(own), JOINED):
            found += self._call([c.decode("utf-8", "replace") for c in own[i : i + JOINED]])
        count = np.array([len(x) for x in found], np.int64)
        total = int(count.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(self.used + 2 * total, np.uint32)))
        self.pool[self.used : self.used + total] = np.concatenate(found)
        start = self.used + np.cumsum(count) - count
        self.used += total
        keys = keys[order]
        sort = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[sort])
        self.keys, self.start, self.count = np.insert(self.keys, at, keys[sort]), np.insert(self.start, at, start[sort]), np.insert(self.count, at, count[sort])

    def _window(self, raw: np.ndarray, starts: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks that begin at ``starts``, and how many each has."""
        ends = np.append(starts[1:], len(raw))
        key = textnum.stretch_hashes(self.codes[raw], starts, ends)
        distinct, first, place = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > self.remember:
            self._forget()
        at = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool) if not len(self.keys) else self.keys[np.minimum(at, len(self.keys) - 1)] != distinct
        if new.any():
            odd = BLANK[raw] | SPECIAL_LEADS[raw]
            odd[starts[raw[starts] == SPACE]] = False
            odds = np.concatenate(([0], np.cumsum(odd)))
            f = first[new]
            a, z = starts[f], ends[f]
            data = raw.tobytes()
            self._learn(distinct[new], [data[i:j] for i, j in zip(a.tolist(), z.tolist(), strict=True)], (odds[z] > odds[a]) | whole[f] | (z - a == 1) & BLANK[raw[a]])
            at = np.searchsorted(self.keys, distinct)
        start, count = self.start[at][place], self.count[at][place]
        ends = np.cumsum(count)
        return self.pool[np.arange(ends[-1]) + np.repeat(start - (ends - count), count)], count

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and where each text's ids begin, and the end; null counts as empty."""
        raw, offsets = textnum.flat(col)
        starts = chunk_starts(raw, offsets)
        whole = np.zeros(len(starts), bool)
        special = np.zeros(len(col), bool)
        for s in self.specials:
            special |= np.asarray(pc.match_substring(col, s).fill_null(False))
        if special.any():  # one chunk for each such text
            text = np.searchsorted(offsets, starts, "right") - 1
            stay = ~special[text] | (starts == offsets[text])
            starts, whole = starts[stay], special[text][stay]
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        lo = 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + WINDOW)))
            base, end = int(starts[lo]), int(starts[hi]) if hi < len(starts) else len(raw)
            i, n = self._window(raw[base:end], starts[lo:hi] - base, whole[lo:hi])
            ids.append(i)
            counts.append(n)
            lo = hi
        total = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        return np.concatenate(ids), total[np.searchsorted(starts, offsets)]

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """The little-endian ids of each text."""
        ids, bounds = self.encode(pa.array(texts, pa.string()))
        return [ids[a:z].astype("<u4").tobytes() for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def worker_encoder(path: str) -> ChunkEncoder:
    """The encoder of a Python worker: what one task has learned serves the worker's next tasks."""
    return ChunkEncoder(path)
