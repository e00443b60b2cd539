"""Operator 1: token counts by a linear longest-match automaton.

The vocabulary is a trie of first pieces and, under a second root, of pieces that go on within a word. Greedy longest
match of a word walks it. Where a node has no edge for the next character, its failure link leads to the node that holds
what is left after the greedy match's tokens are taken off the front, and a number precomputed beside the link says how
many tokens that takes off. So each character is read once, links are followed at most as often as characters are read,
and the number of tokens comes without building a piece.

The bare word-begin piece is the empty first piece: where no longer one fits, it counts one token and the inner pieces go
on from the word's first character. A character that no inner piece begins with at its place counts a token for each of
its UTF-8 bytes where the vocabulary has those bytes. Only without that, a word that no sequence of greedy pieces covers
counts as one unknown token. Words are runs of letters, digits and other
characters between white space, where each punctuation mark is a word of its own; a bounded cache keeps the counts of
white-space separated chunks.

Cases: a null or empty text, or one of white space, has no words and no tokens. Repeated rows give repeated results. An
empty table gives an empty result. A word of any length is counted whole. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kindred.llm.common import chunks, kept, slices

#: Chunks whose counts a worker keeps, none of more characters than ``LONG``; a full cache is emptied.
CHUNKS, LONG = 500_000, 64


class Automaton:
    """Counts greedy longest-match pieces. ``first``: pieces that begin a word, "" for the bare begin; ``inner``: pieces
    that go on within it, single bytes as ``bytes``."""

    def __init__(self, first: list[str], inner: list[str | bytes]):
        self._bytes = {p[0] for p in inner if isinstance(p, bytes)}
        inner = [p for p in inner if isinstance(p, str)]
        self.edges: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        self.inner_root = 1
        for root, pieces in ((0, first), (1, inner)):
            for piece in pieces:
                at = root
                for c in piece:
                    if c not in self.edges[at]:
                        self.edges[at][c] = len(self.edges)
                        self.edges.append({})
                        ends.append(False)
                    at = self.edges[at][c]
                ends[at] = at > 1
        # A character that stands for its bytes is a piece of as many tokens; those of no piece at all are met in count().
        weight: dict[int, int] = {}
        for c in {c for piece in (*first, *inner) for c in piece}:
            at = self.edges[self.inner_root].get(c)
            if (at is None or not ends[at]) and (spelled := self._spelled(c)):
                if at is None:
                    at = self.edges[self.inner_root][c] = len(self.edges)
                    self.edges.append({})
                    ends.append(False)
                ends[at], weight[at] = True, spelled
        n = len(self.edges)
        self.link, self.popped = [-1] * n, [0] * n
        if "" in first:
            self.link[0], self.popped[0] = self.inner_root, 1
        # Level by level: a node's link needs those of shorter strings only.
        queue = deque([0, 1])
        while queue:
            at = queue.popleft()
            for c, to in self.edges[at].items():
                queue.append(to)
                if ends[to]:
                    self.link[to], self.popped[to] = self.inner_root, weight.get(to, 1)
                    continue
                up, taken = self.link[at], self.popped[at]
                while up >= 0 and c not in self.edges[up]:
                    taken += self.popped[up]
                    up = self.link[up]
                if up >= 0:
                    self.link[to], self.popped[to] = self.edges[up][c], taken
        self._splits = regex.compile(r"[\p{P}\p{S}]|[^\s\p{P}\p{S}]+").findall
        self._known: dict[str, tuple[int, int, int]] = {}

    def _spelled(self, c: str) -> int:
        """Tokens of a character as bytes, 0 where the vocabulary lacks one of them."""
        own = c.encode()
        return len(own) if self._bytes.issuperset(own) else 0

    def count(self, word: str) -> int | None:
        """Tokens of a word; None where greedy matching fails."""
        edges, link, popped = self.edges, self.link, self.popped
        at = n = 0
        for c in word:
            while (to := edges[at].get(c)) is None:
                if at == self.inner_root and (spelled := self._spelled(c)):
                    n, to = n + spelled, at
                    break
                n += popped[at]
                at = link[at]
                if at < 0:
                    return None
            at = to
        while at != self.inner_root:
            if at < 0:
                return None
            n += popped[at]
            at = link[at]
        return n

    def chunk(self, text: str) -> tuple[int, int, int]:
        """Words, tokens and unknown tokens of a chunk."""
        counts = [self.count(w) for w in self._splits(text)]
        unknown = sum(c is None for c in counts)
        return len(counts), sum(c or 0 for c in counts) + unknown, unknown

    def text(self, text: str) -> tuple[int, int, int]:
        known = self._known
        words = tokens = unknown = 0
        for c in chunks(text):
            found = known.get(c)
            if found is None:
                if len(known) >= CHUNKS:
                    known.clear()
                found = self.chunk(c)
                if len(c) <= LONG:
                    known[c] = found
            words += found[0]
            tokens += found[1]
            unknown += found[2]
        return words, tokens, unknown


def sentencepiece_vocabulary(path: str) -> tuple[list[str], list[str | bytes]]:
    """First and inner pieces from a SentencePiece model: those with and without the mark of a word's begin, the bare mark
    as "" and bytes as ``bytes``."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    first, inner, single = [], [], []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        if model.is_control(k) or model.is_unknown(k):
            continue
        if model.is_byte(k):
            single.append(bytes([int(piece[3:-1], 16)]))
        elif piece.startswith("▁"):
            first.append(piece[1:])
        else:
            inner.append(piece)
    return [p for p in first if "▁" not in p], [*(p for p in inner if "▁" not in p), *single]


def automaton(first: list[str], inner: list[str | bytes]) -> Automaton:
    """One automaton a worker and vocabulary; its cache outlives a task."""
    return kept(hashlib.sha256(repr((first, inner)).encode()).hexdigest(), lambda: Automaton(first, inner))


def token_counts(docs: DataFrame, first: list[str], inner: list[str | bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of every row. The vocabulary is sent to each executor once."""
    sent = docs.sparkSession.sparkContext.broadcast((first, inner))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(*sent.value)
        for batch, column in slices(batches):
            rows = [own.text(t) for t in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")


def greedy(word: str, first: set[str], inner: set[str | bytes]) -> int | None:
    """The same by trying every length, longest first; for tests."""
    at = n = 0
    while at < len(word):
        pieces = inner if n else first
        for to in range(len(word), at, -1):
            if word[at:to] in pieces:
                at, n = to, n + 1
                break
        else:
            own = [bytes([b]) for b in word[at].encode()]
            if not n and "" in first:
                n = 1
            elif n and inner.issuperset(own):
                at, n = at + 1, n + len(own)
            else:
                return None
    return n
