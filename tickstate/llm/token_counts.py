"""Greedy word-piece token counts with a linear longest-match automaton.

The vocabulary is a trie with one root for pieces that open a word and one for
pieces that continue it. A node's failure link leads to the trie node that is
left after its longest matches are popped, and the number of popped tokens is
stored with the link, so a word is counted in one pass without building pieces.

A word is a run of non-space characters. What becomes of a character that no
piece spells is set by ``unknown``: ``bytes`` counts one token per UTF-8 byte,
``character`` one token, and the word goes on behind it; ``word`` makes the whole
word one unknown token. ``n_unknown`` counts the words with such a character.
Defined results: null or blank text counts 0; repeated rows are counted each; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickstate.llm.common import slices, small_batches, texts

OPEN = "▁"
UNKNOWN = 1 << 40
_CACHED_WORDS, _CACHED_LENGTH = 250_000, 64
# tokens of a character that no piece spells; a whole word is one token where no rule is named
UNSPELLED = {
    "bytes": lambda c: len(c.encode("utf-8", "surrogatepass")),
    "character": lambda c: 1,
    "word": None,
}


class Automaton:
    """Trie edges, failure links and popped-token counts; 0 opens a word, 1 continues it.

    Popped unspelled characters are counted in units of ``UNKNOWN``.
    """

    def __init__(self, opening: Iterable[str], continuing: Iterable[str], unknown: str = "word"):
        self.unknown = unknown
        unspelled = UNSPELLED[unknown]
        self.edges: list[dict[str, int]] = [{}, {}]
        final = {1: False}
        for root, pieces in ((0, opening), (1, continuing)):
            for piece in pieces:
                node = root
                for c in piece:
                    node = self.edges[node].setdefault(c, len(self.edges))
                    if node == len(self.edges):
                        self.edges.append({})
                if node != root:
                    final[node] = True
        self.failure = [-1] * len(self.edges)
        self.popped = [0] * len(self.edges)
        queue = deque((parent, c, node) for parent in (0, 1) for c, node in self.edges[parent].items())
        while queue:
            parent, c, node = queue.popleft()
            if final.get(node):
                self.failure[node], self.popped[node] = 1, 1
            elif unspelled and parent < 2:
                self.failure[node], self.popped[node] = 1, UNKNOWN + unspelled(c)
            else:
                at, count = self.failure[parent], self.popped[parent]
                while at >= 0 and c not in self.edges[at]:
                    if unspelled and at == 1:
                        self.failure[node], self.popped[node] = 1, count + UNKNOWN + unspelled(c)
                        break
                    count += self.popped[at]
                    at = self.failure[at]
                if at >= 0 and c in self.edges[at]:
                    self.failure[node], self.popped[node] = self.edges[at][c], count
            queue.extend((node, d, child) for d, child in self.edges[node].items())

    def length(self, word: str) -> int:
        """Tokens of one word, plus ``UNKNOWN`` if pieces do not spell all of it."""
        edges, failure, popped = self.edges, self.failure, self.popped
        unspelled = UNSPELLED[self.unknown]
        node, count = 0, 0
        for c in word:
            following = edges[node].get(c)
            while following is None:
                if unspelled and node < 2:
                    count += UNKNOWN + unspelled(c)
                    following = 1
                    break
                count += popped[node]
                node = failure[node]
                if node < 0:
                    return UNKNOWN + 1
                following = edges[node].get(c)
            node = following
        while node != 1:
            count += popped[node]
            node = failure[node]
            if node < 0:
                return UNKNOWN + 1
        return count if count < UNKNOWN else UNKNOWN + count % UNKNOWN


class Lengths(dict):
    """Word lengths, remembered for a bounded number of short words."""

    def __init__(self, automaton: Automaton, prefix: str = OPEN):
        self.automaton, self.prefix = automaton, prefix

    def __missing__(self, word: str) -> int:
        count = self.automaton.length(self.prefix + word)
        if len(word) <= _CACHED_LENGTH:
            if len(self) >= _CACHED_WORDS:
                self.clear()
            self[word] = count
        return count


def sentencepiece_pieces(path: str) -> tuple[list[str], list[str]]:
    """Word-opening and continuing pieces of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(i) for i in range(model.vocab_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    opening = [p for p in pieces if p.startswith(OPEN) and OPEN not in p[1:]]
    return opening, [p for p in pieces if OPEN not in p]


def sentencepiece_unknown(path: str) -> str:
    """How a SentencePiece model file counts a character that no piece spells."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return "bytes" if any(model.is_byte(i) for i in range(model.vocab_size())) else "character"


def word_piece_counts(
    docs: DataFrame, opening: Iterable[str], continuing: Iterable[str], *, most_pieces: int = 1_000_000,
    unknown: str = "word",
) -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` of every whole text.

    The broadcast automaton is bounded by ``most_pieces`` vocabulary entries.
    """
    opening, continuing = list(opening), list(continuing)
    if len(opening) + len(continuing) > most_pieces:
        raise ValueError(f"vocabulary exceeds {most_pieces} pieces")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(opening, continuing, unknown))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(shared.value)
        for batch in slices(batches):
            rows = [t.split() for t in batch.column("text").to_pylist()]
            words = np.fromiter(map(len, rows), np.int64, len(rows))
            sums = [divmod(sum(map(lengths.__getitem__, r)), UNKNOWN) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words), pa.array([n for _, n in sums], pa.int64()),
                 pa.array([u for u, _ in sums], pa.int64())],
                names=["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
