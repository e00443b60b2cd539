"""Operator 10: BPE encoding and decoding by a prefix-sharing trie of the distinct words.

BPE gives a prefix of a word an encoding whose last token is the only vocabulary token that (a) ends the prefix and
(b) stands next to the last token of the shorter prefix's encoding without the merges joining them otherwise. So one
last token a trie node is enough: the distinct words of a batch are sorted, which is the depth-first order of their
trie, a stack holds the nodes of the current path, and each new node looks its last token up from the nodes above it.
Words that share a prefix share its nodes. An encoding is read back along the last tokens.

A slice of texts is cut into words as arrays of bytes: each byte has a class, a word begins where the class changes, and
Arrow finds the distinct ones. A bounded cache maps a word to its ids, so only new words reach the trie. A run between
blanks that holds a character whose treatment depends on the version of Unicode, or a special token, is cut by the library.

Cases: a null or empty text has no ids. Repeated rows give repeated results. An empty table gives an empty result.
Only the named columns are read, so other columns may have any names. A text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.normalizers import Sequence
from tokenizers.pre_tokenizers import WhitespaceSplit

from kindred.llm.common import kept, slices, utf8

#: Bounds of a worker's caches: words and their bytes (a generation of two), pairs of tokens. Full ones are emptied.
WORDS, HELD, PAIRS = 80_000, 16 << 20, 500_000
#: Widths of the matrices that words are merged in, and the rank of no merge.
WIDTHS, NONE = (0, 4, 6, 8, 10, 12, 16, 24, 64), np.int32(2**31 - 1)
#: Classes of bytes. A run between blanks that holds an odd one is left to the library.
BLANK, LETTER, NUMBER, OTHER, ODD = range(5)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The class and the lower case of each character below U+10000. All that versions of Unicode may treat differently,
    that normalisation may change or whose lower case has another length is odd."""
    kind, lower = np.full(1 << 16, ODD, np.uint8), np.arange(1 << 16, dtype=np.uint16)
    for c in [*range(0x80), *range(0xA1, 0x130), *range(0x131, 0x180), *range(0x2010, 0x2028)]:
        x, low = chr(c), chr(c).lower()
        if len(low) == 1 and len(low.encode()) == len(x.encode()):
            kind[c] = LETTER if regex.match(r"\p{L}", x) else NUMBER if regex.match(r"\p{N}", x) else OTHER
            lower[c] = ord(low)
    kind[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    return kind, lower


_KIND, _LOW = _tables()
_BYTE_KIND = np.where(np.arange(256) < 0x80, _KIND[:256], ODD).astype(np.uint8)
_BYTE_LOW = np.where(np.arange(256) < 0x80, _LOW[:256], np.arange(256)).astype(np.uint8)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


class WordBpe:
    """A tokenizers file whose model is BPE over byte symbols with a suffix on a word's last symbol."""

    def __init__(self, source: str, by_matrix: bool = False):
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for x in spec["added_tokens"]:
            mixed = len({int(_KIND[min(ord(c), 0xFFFF)]) for c in x["content"]} - {BLANK}) > 1 and not re.search(r"\s", x["content"])
            if not mixed or any(x.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")):
                raise ValueError(f"an added token of this kind is not supported: {x['content']!r}")
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        library = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "model": model | {"vocab": {}, "merges": []}}))
        self._normalizer, self._pre = library.normalizer, library.pre_tokenizer
        names = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]

        symbols = byte_symbols()
        self._byte = {ord(s): b for b, s in enumerate(symbols)}
        self._symbol = dict(enumerate(symbols))
        self._words: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}
        self._held = 0
        self._base_inner = [self.vocab[s] for s in symbols]
        self._base_last = [self.vocab[s + self.suffix] for s in symbols]
        self._by_matrix = by_matrix
        if by_matrix:
            self._source, self._model = source, None
            merges = sorted((self.vocab[a] << 32 | self.vocab[b], rank, self.vocab[a + b]) for rank, (a, b) in enumerate(model["merges"]))
            self._merge_keys, self._merge_ranks, self._merge_results = (np.array(x, t) for x, t in zip(zip(*merges, strict=True), (np.int64, np.int32, np.int32), strict=True))
            self._inner_of, self._last_of = np.array(self._base_inner, np.int32), np.array(self._base_last, np.int32)
            self.vocab = {}
            return
        # By the bytes of a token: its id within a word, and at a word's end.
        self.inner: dict[bytes, int] = {}
        self.last: dict[bytes, int] = {}
        self._parts: dict[int, tuple[int, ...]] = {}
        made: dict[str, tuple[bytes, bool]] = {}
        for b, s in enumerate(symbols):
            made[s], made[s + self.suffix] = (bytes([b]), False), (bytes([b]), True)
        self._merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            made[a + b] = (made[a][0] + made[b][0], made[b][1])
            self._merge[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        for s, (own, ends) in made.items():
            (self.last if ends else self.inner)[own] = self.vocab[s]
            self._parts[self.vocab[s]] = tuple([self._base_inner[x] for x in own[:-1]] + [(self._base_last if ends else self._base_inner)[own[-1]]])
        self.longest = max(map(len, [*self.inner, *self.last]))
        self._pair: dict[int, bool] = {}
        self._suffixes()

    def merged(self, ids: list[int]) -> list[int]:
        """BPE as defined: the merge of lowest rank first, the leftmost of equals."""
        ids = list(ids)
        while True:
            found = min(((m[0], k) for k in range(len(ids) - 1) if (m := self._merge.get((ids[k], ids[k + 1])))), default=None)
            if not found:
                return ids
            k = found[1]
            ids[k : k + 2] = [self._merge[ids[k], ids[k + 1]][1]]

    def _fits(self, left: int, right: int) -> bool:
        """Whether BPE gives just these two tokens for their symbols (left -1: just the one)."""
        parts = [] if left < 0 else [left]
        ok = self.merged([x for t in [*parts, right] for x in self._parts[t]]) == [*parts, right]
        if len(self._pair) > PAIRS:
            self._pair.clear()
        self._pair[left << 32 | right] = ok
        return ok

    def _suffixes(self) -> None:
        """An automaton over bytes whose state knows the tokens within a word that end here, longest first."""
        goto: list[dict[int, int]] = [{}]
        own = [-1]
        for token in self.inner:
            at = 0
            for c in token:
                if c not in goto[at]:
                    goto[at][c] = len(goto)
                    goto.append({})
                    own.append(-1)
                at = goto[at][c]
            own[at] = len(token)
        self._fail, self._ends = [0] * len(goto), [()] * len(goto)
        queue = deque([(0, b"")])
        while queue:
            at, text = queue.popleft()
            for c, to in goto[at].items():
                up = self._fail[at]
                while at and up and c not in goto[up]:
                    up = self._fail[up]
                self._fail[to] = goto[up].get(c, 0) if at else 0
                longer = text + bytes([c])
                self._ends[to] = (((self.inner[longer], own[to]),) if own[to] > 0 else ()) + self._ends[self._fail[to]]
                queue.append((to, longer))
        self._goto = goto
        self._step: dict[int, int] = {}

    def _next(self, at: int, c: int) -> int:
        up = at
        while up and c not in self._goto[up]:
            up = self._fail[up]
        self._step[at << 8 | c] = to = self._goto[up].get(c, 0)
        return to

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of distinct non-empty words, as little-endian unsigned 32-bit integers."""
        if self._by_matrix:
            return self._merged_words(words)
        out: dict[bytes, bytes] = {}
        last, known, fits, longest, step, ends = self.last.get, self._pair.get, self._fits, self.longest, self._step.get, self._ends
        # The path of trie nodes: the last token of the prefix that ends there, where that token begins, and the state
        # that knows which tokens end there.
        token, begin, state, before = [-1], [0], [0], b""
        for w in sorted(words):
            n = len(w)
            top = min(n - 1, len(token) - 1)
            if before[:top] != w[:top]:
                k = 0
                while before[k] == w[k]:
                    k += 1
                top = k
            del token[top + 1 :], begin[top + 1 :], state[top + 1 :]
            at = state[top]
            for i in range(top + 1, n):
                c = w[i - 1]
                to = step(at << 8 | c)
                at = self._next(at, c) if to is None else to
                for t, size in ends[at]:
                    p = token[i - size]
                    ok = known(p << 32 | t)
                    if fits(p, t) if ok is None else ok:
                        token.append(t)
                        begin.append(i - size)
                        state.append(at)
                        break
                else:
                    raise ValueError(f"no token ends the prefix {w[:i]!r}")
            for j in range(max(0, n - longest), n):
                t = last(w[j:n])
                if t is not None:
                    p = token[j]
                    ok = known(p << 32 | t)
                    if fits(p, t) if ok is None else ok:
                        break
            else:
                raise ValueError(f"no token ends the word {w!r}")
            ids = [t]
            while j:
                ids.append(token[j])
                j = begin[j]
            ids.reverse()
            out[w] = struct.pack(f"<{len(ids)}I", *ids)
            before = w
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of the merge of each pair, a large one where there is none or a token is missing (-1), and its result."""
        key = a.astype(np.int64) << 32 | b
        k = np.minimum(np.searchsorted(self._merge_keys, key), len(self._merge_keys) - 1)
        return np.where((self._merge_keys[k] == key) & (a >= 0) & (b >= 0), self._merge_ranks[k], NONE), k

    def _merged_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The same by BPE's definition on matrices, for jobs that need ids and no trie: a row a word, one merge a row and
        round. Very long words go to the library."""
        out: dict[bytes, bytes] = {}
        for low, high in zip(WIDTHS[:-1], WIDTHS[1:], strict=True):
            fitting = [w for w in words if low < len(w) <= high]
            for s in range(0, len(fitting), 20_000):
                own = fitting[s : s + 20_000]
                size = np.fromiter(map(len, own), np.int64, len(own))
                ends = np.cumsum(size)
                flat = np.frombuffer(b"".join(own), np.uint8)
                row = np.repeat(np.arange(len(own)), size)
                token = np.full((len(own), high), -1, np.int32)
                token[row, np.arange(len(flat)) - (ends - size)[row]] = self._inner_of[flat]
                token[np.arange(len(own)), size - 1] = self._last_of[flat[ends - 1]]
                rank, to = self._ranks(token[:, :-1], token[:, 1:])
                live = np.arange(len(own))
                column = np.arange(high)
                while len(live):
                    at = rank.argmin(axis=1)
                    some = rank[np.arange(len(live)), at] < NONE
                    if not some.all():
                        live, at, rank, to = live[some], at[some], rank[some], to[some]
                        if not len(live):
                            break
                    every = np.arange(len(live))
                    mine = token[live]
                    # What stands right of the merged pair moves one place left.
                    mine[:, :-1] = np.where(column[:-1] > at[:, None], mine[:, 1:], mine[:, :-1])
                    mine[:, -1] = -1
                    mine[every, at] = self._merge_results[to[every, at]]
                    token[live] = mine
                    rank[:, :-1] = np.where(column[:-2] > at[:, None], rank[:, 1:], rank[:, :-1])
                    to[:, :-1] = np.where(column[:-2] > at[:, None], to[:, 1:], to[:, :-1])
                    rank[:, -1] = NONE
                    # The pairs on both sides of the new token.
                    left, right = np.maximum(at - 1, 0), np.minimum(at, high - 2)
                    rank[every, right], to[every, right] = self._ranks(mine[every, right], mine[every, right + 1])
                    rank[every, left], to[every, left] = self._ranks(mine[every, left], mine[every, left + 1])
                filled = token >= 0
                data, cut = memoryview(token[filled]).cast("B"), np.concatenate([[0], 4 * np.cumsum(filled.sum(axis=1))]).tolist()
                out.update(zip(own, [bytes(data[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], strict=True))
        for w in words:
            if len(w) > WIDTHS[-1]:
                if self._model is None:
                    self._model = Tokenizer.from_str(self._source)
                    self._model.normalizer, self._model.pre_tokenizer = Sequence([]), WhitespaceSplit()
                out[w] = np.array(self._model.encode(w.decode("latin-1").translate(self._symbol), add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def _pieces(self, chunk: str) -> list[bytes]:
        """The words of a run between blanks, by the library."""
        return [bytes(self._byte[ord(c)] for c in x) for x, _ in self._pre.pre_tokenize_str(self._normalizer.normalize_str(chunk))]

    def _ids(self, found: list[bytes], odd: set[int]) -> list[bytes]:
        """The ids of distinct words; ``odd`` has the places of whole runs between blanks. Of two generations of the
        cache, the older one goes when the newer is full."""
        if len(self._words) > WORDS or self._held > HELD:
            self._words, self._older, self._held = {}, self._words, 0
        new, old = self._words, self._older
        parts: dict[int, list] = {}
        for k in odd:
            chunk = found[k].decode()
            split = self._special.split(chunk) if self._special else [chunk]
            parts[k] = [self.special[x] if x in self.special else self._pieces(x) for x in split if x]
        words = found if not odd else [w for k, w in enumerate(found) if k not in odd] + [w for p in parts.values() for x in p if not isinstance(x, int) for w in x]
        missing = []
        for w in words:
            if w not in new:
                if (known := old.get(w)) is None:
                    missing.append(w)
                else:
                    new[w] = known
        if missing:
            made = self.encode_words(list(set(missing)) if odd else missing)
            self._held += sum(map(len, made)) + sum(map(len, made.values()))
            new.update(made)
        if not odd:
            return list(map(new.__getitem__, found))
        return [b"".join(struct.pack("<I", x) if isinstance(x, int) else b"".join(map(new.__getitem__, x)) for x in parts[k]) if k in odd else new[w] for k, w in enumerate(found)]

    def _cut(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts one after the other that begin at ``at``: the bytes in lower case, where words begin, which bytes are
        no blanks, and where the runs begin that the library has to cut (their bytes stay as they are)."""
        n = len(data)
        kind, low = _BYTE_KIND[data], _BYTE_LOW[data]
        number = np.zeros(0, np.int64)
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            size = data[lead]
            two, three = lead[size < 0xE0], lead[(size >= 0xE0) & (size < 0xF0)]
            c = (data[two].astype(np.int32) & 31) << 6 | data[two + 1] & 63
            kind[two] = kind[two + 1] = _KIND[c]
            number = two[_KIND[c] == NUMBER] + 1
            c = _LOW[c]
            low[two], low[two + 1] = 0xC0 | c >> 6, 0x80 | c & 63
            c = (data[three].astype(np.int32) & 15) << 12 | (data[three + 1].astype(np.int32) & 63) << 6 | data[three + 2] & 63
            kind[three] = kind[three + 1] = kind[three + 2] = _KIND[c]
        before = np.empty(n, np.uint8)
        before[1:] = kind[:-1]
        first = at[:-1][at[:-1] < n]
        before[first] = BLANK
        filled = kind != BLANK
        begins = (kind != before) & filled
        begins |= kind == NUMBER
        begins[number] = False  # the second byte of one
        # An apostrophe that begins a run of other characters takes these letters with it.
        quote = np.flatnonzero((low == 0x27) & (before != OTHER))
        if len(quote):
            fresh = np.zeros(n + 3, bool)
            fresh[first] = True
            fresh[n:] = True
            after = np.concatenate([low, np.zeros(3, np.uint8)])
            c, d = after[quote + 1], after[quote + 2]
            one = np.isin(c, np.frombuffer(b"stmd", np.uint8)) & ~fresh[quote + 1]
            both = (((c == 0x72) | (c == 0x76)) & (d == 0x65) | (c == 0x6C) & (d == 0x6C)) & ~fresh[quote + 1] & ~fresh[quote + 2]
            begins[quote[one | both] + 1] = False
            ends = np.concatenate([quote[one] + 2, quote[both] + 3])
            ends = ends[ends < n]
            begins[ends] = filled[ends]
        strange = np.flatnonzero(kind == ODD)
        raw = data.tobytes() if self.special else b""
        for x in self.special:
            k = raw.find(own := x.encode())
            while k >= 0:
                strange = np.append(strange, k)
                k = raw.find(own, k + 1)
        if not len(strange):
            return low, begins, filled, strange
        chunk = np.flatnonzero(filled & (before == BLANK))
        which = np.unique(np.searchsorted(chunk, strange, side="right") - 1)
        stop = np.empty(n + 1, bool)
        stop[:n], stop[n] = ~filled, True
        stop[first] = True
        stops = np.flatnonzero(stop)
        starts = chunk[which]
        for s, e in zip(starts.tolist(), stops[np.searchsorted(stops, starts, side="right")].tolist(), strict=True):
            begins[s + 1 : e] = False
            low[s:e] = data[s:e]
        return low, begins, filled, starts

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        data, at = utf8(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        if not len(data):
            return [b""] * (len(at) - 1)
        low, begins, filled, odd = self._cut(data, at)
        starts = np.flatnonzero(begins)
        own = low[filled]
        ends = np.append(np.flatnonzero(begins[filled]), len(own))
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(own)]).dictionary_encode()
        strange = set(pc.unique(coded.indices.take(pa.array(np.searchsorted(starts, odd)))).to_pylist()) if len(odd) else set()
        of, words = coded.dictionary.buffers()[1:]
        words, of = words.to_pybytes(), np.frombuffer(of, np.int64, len(coded.dictionary) + 1).tolist()
        distinct = self._ids([words[a:b] for a, b in zip(of[:-1], of[1:], strict=True)], strange)
        upto = np.cumsum(np.fromiter(map(len, distinct), np.int64, len(distinct))) // 4
        ids = pa.LargeListArray.from_arrays(np.concatenate([[0], upto]), np.frombuffer(b"".join(distinct), np.uint32)).take(coded.indices)
        place, values = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy()).cast("B")
        cut = (4 * place[np.searchsorted(starts, at)]).tolist()
        return [bytes(values[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def decode(self, ids: bytes) -> str:
        """The text of ids as the library gives it for a file without a decoder: the tokens, a space between any two."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(source: str, by_matrix: bool = False) -> WordBpe:
    """One encoder a worker and vocabulary; its caches outlive a task."""
    return kept(f"{hashlib.sha256(source.encode()).hexdigest()} {by_matrix}", lambda: WordBpe(source, by_matrix))


def vocabulary(path: str) -> str:
    """The file's content, read on the driver: executors get it with the plan and need no such file (about 2 MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoded(docs: DataFrame, path: str, make: Callable[[WordBpe, pa.RecordBatch, list[bytes]], pa.RecordBatch], schema: str, id_col: str = "doc_id", text_col: str = "text", by_matrix: bool = False) -> DataFrame:
    """Rows that ``make`` derives from batches of (id, text) with their ids."""
    source = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(source.value, by_matrix)
        for batch, column in slices(batches, limit=2 << 20):
            yield make(own, batch, own.encode(column))

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<long>) of each row."""

    def make(own: WordBpe, batch: pa.RecordBatch, ids: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return encoded(docs, path, make, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<long>", id_col, text_col)


def decode(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids array<long>); null ids count as none."""
    source = ids.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(source.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.decode(np.asarray(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text, for each row."""

    def make(own: WordBpe, batch: pa.RecordBatch, ids: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids], pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return encoded(docs, path, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
