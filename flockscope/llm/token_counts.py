"""Operator 1 - greedy word-piece token counts by a linear automaton.

The vocabulary (pieces that begin a word, pieces that continue one) becomes a
trie with two roots. Every node gets a failure link, to the node where matching
goes on once the longest pieces are taken off its string, and the number of
pieces that this takes off. Walking a word's characters then adds popped counts
along failure links: each character is read once, no piece is ever cut out or
looked up, and the total is the number of greedy longest-match pieces.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from flockscope.llm.common import kept_schema, with_text
from flockscope.llm.wordarrays import LONGEST_KEPT

NOWHERE = -1


class PieceCounter:
    """Counts greedy longest-match pieces of words; remembers up to ``most`` words."""

    def __init__(self, begin: Iterable[str], inside: Iterable[str], most: int = 400_000):
        self.next: list[dict[str, int]] = [{}, {}]  # node 0 begins words, node 1 continues them
        piece_end = [False, False]
        for root, pieces in ((0, begin), (1, inside)):
            for piece in filter(None, pieces):
                node = root
                for c in piece:
                    node = self.next[node].setdefault(c, len(self.next))
                    if node == len(self.next):
                        self.next.append({})
                        piece_end.append(False)
                piece_end[node] = True
        self.fail, self.popped = [NOWHERE] * len(self.next), [0] * len(self.next)
        queue = deque([0, 1])
        while queue:  # parents before children; a failure link leads to a shorter string
            node = queue.popleft()
            for c, child in self.next[node].items():
                queue.append(child)
                if piece_end[child]:
                    self.fail[child], self.popped[child] = 1, 1
                    continue
                back, taken = self.fail[node], self.popped[node]
                while back != NOWHERE and c not in self.next[back]:
                    taken += self.popped[back]
                    back = self.fail[back]
                if back != NOWHERE:
                    self.fail[child], self.popped[child] = self.next[back][c], taken
        self.most, self.known = most, {}

    def count(self, word: str) -> int:
        """Pieces of a word, or 0 if greedy matching gets stuck (an unknown word)."""
        node, total, nxt, fail, popped = 0, 0, self.next, self.fail, self.popped
        for c in word:
            while (step := nxt[node].get(c)) is None:
                if fail[node] == NOWHERE:
                    return 0
                total += popped[node]
                node = fail[node]
            node = step
        while node > 1:
            if fail[node] == NOWHERE:
                return 0
            total += popped[node]
            node = fail[node]
        return total

    def text(self, text: str | None) -> tuple[int, int, int]:
        """``(words, tokens, unknown words)`` of a text; an unknown word is one token."""
        words = text.encode("utf-8").split() if text else []
        known, unknown, tokens = self.known, 0, 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = self.count(w.decode("utf-8"))
                if len(w) <= LONGEST_KEPT:
                    if len(known) >= self.most:
                        known.clear()
                    known[w] = n
            if n:
                tokens += n
            else:
                unknown += 1
        return len(words), tokens + unknown, unknown


def read_pieces(model_path: str, mark: str = "▁") -> tuple[list[str], list[str]]:
    """Pieces that begin and that continue words, from a piece model's vocabulary.

    Control, unknown and byte pieces are left out; ``mark`` shows a word begin.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())
             if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return ([p[1:] for p in names if p.startswith(mark) and mark not in p[1:] and p != mark],
            [p for p in names if mark not in p])


@lru_cache(maxsize=2)
def _counter(begin: tuple[str, ...], inside: tuple[str, ...]) -> PieceCounter:
    return PieceCounter(begin, inside)


def _count_batches(pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(*pieces.value)
        for b in batches:
            found = [counter.text(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], *[pa.array([f[i] for f in found], pa.int64()) for i in range(3)]],
                [*b.schema.names[:-1], "n_words", "n_tokens", "n_unknown"])
    return run


def token_counts(docs: DataFrame, begin: Iterable[str], inside: Iterable[str], text_col: str = "text",
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_words``, ``n_tokens``, ``n_unknown`` of every row.

    Words are runs of characters other than space and TAB .. CR. The vocabulary
    (a fixed size) is broadcast. Null, empty and blank texts count 0. A word
    that greedy matching cannot cover is one unknown token. A text of any length
    is counted in one pass over its words; there are no ties, greedy matching is
    unique. Repeated rows are counted one by one; an empty table gives an empty
    result. A ``keep`` column named like a result column comes back as
    ``kept_<name>``.
    """
    pieces = docs.sparkSession.sparkContext.broadcast((tuple(begin), tuple(inside)))
    slim = with_text(docs, keep, text_col, ("n_words", "n_tokens", "n_unknown"))
    return slim.mapInArrow(_count_batches(pieces), kept_schema(slim, "n_words long, n_tokens long, n_unknown long"))
