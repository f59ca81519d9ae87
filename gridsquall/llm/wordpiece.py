"""Token counts by greedy longest match, in time linear in the text.

The vocabulary's pieces form a trie with one root for the start of a word and one for
its continuation.  Where the trie ends, a node's failure link leads to the node of the
text that is still open, and its stored number says how many pieces that closes.  So
each character is looked at once, pieces are counted and never built, and nothing is
searched backwards.  Words of a batch are counted once for each distinct word.

Defined results: words are cut at white space; a word that pieces can't cover counts as
one unknown piece; null, empty and blank texts have no words and no pieces; repeated rows
are counted each.  Only the named columns are read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from gridsquall.llm.common import runs

START, INNER, NONE = 0, 1, -1
#: Node numbers and code points share one dictionary key.
WIDE = 0x110000


class LongestMatch:
    """Counts of greedy longest-match pieces."""

    def __init__(self, initial: Iterable[str], inner: Iterable[str]):
        self.step: dict[int, int] = {}
        whole = [False, False]
        for root, pieces in ((START, initial), (INNER, inner)):
            for piece in pieces:
                node = root
                for c in piece:
                    key = node * WIDE + ord(c)
                    if key not in self.step:
                        self.step[key] = len(whole)
                        whole.append(False)
                    node = self.step[key]
                if piece:
                    whole[node] = True
        self.fail, self.popped = [NONE] * len(whole), [0] * len(whole)
        below: list[list[tuple[int, int]]] = [[] for _ in whole]
        for key, child in self.step.items():
            below[key // WIDE].append((key % WIDE, child))
        queue = deque((START, INNER))
        while queue:  # by depth, so shorter texts are ready before
            node = queue.popleft()
            for c, child in below[node]:
                if whole[child]:
                    self.fail[child], self.popped[child] = INNER, 1
                else:
                    at, n = self.fail[node], self.popped[node]
                    while at != NONE and at * WIDE + c not in self.step:
                        n += self.popped[at]
                        at = self.fail[at]
                    if at != NONE:
                        self.fail[child], self.popped[child] = self.step[at * WIDE + c], n
                queue.append(child)

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if they can't cover it."""
        step, fail, popped = self.step, self.fail, self.popped
        node = total = 0
        for c in map(ord, word):
            while (after := step.get(node * WIDE + c)) is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = after
        while node != INNER:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return 0
        return total


def marked_pieces(path: str, mark: str = "▁") -> tuple[list[str], list[str]]:
    """Word-initial and inner pieces of a SentencePiece model, by its word mark."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return [p[len(mark) :] for p in pieces if p.startswith(mark) and p != mark], [p for p in pieces if mark not in p]


def count_tokens(docs: DataFrame, automaton: LongestMatch, *, id_col: str = "doc_id", text_col: str = "text", remember: int = 500_000) -> DataFrame:
    """Per document: ``n_words``, ``n_tokens`` (an unknown word is one) and ``n_unknown``."""
    sent = docs.sparkSession.sparkContext.broadcast((automaton.step, automaton.fail, automaton.popped))
    key = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = LongestMatch((), ())
        match.step, match.fail, match.popped = sent.value
        known: dict[str, int] = {}
        for batch in runs(batches, 1):
            words = [(t or "").split() for t in batch.column(1).to_pylist()]
            distinct = set().union(*words)
            if len(known) > remember:
                known.clear()
            for w in distinct - known.keys():
                known[w] = match.count(w)
            counts = [list(map(known.__getitem__, w)) for w in words]
            unknown = [c.count(0) for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, words), pa.int64()), pa.array([sum(c) + u for c, u in zip(counts, unknown, strict=True)], pa.int64()), pa.array(unknown, pa.int64())], names=[id_col, "n_words", "n_tokens", "n_unknown"])

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {key}, n_words long, n_tokens long, n_unknown long")
