"""What the operators share: tables that cut lineage, Arrow batches of bounded size, word hashes over whole texts."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kindred.tables import cut as materialize
from kindred.tables import drop, scratch, write

__all__ = ["drop", "materialize", "scratch", "write"]

#: Bytes of text that a Python worker turns into arrays at a time. A single longer text makes a batch of its own.
SLICE_BYTES = 2 << 20
T = TypeVar("T")
_kept: dict[str, object] = {}


def kept(key: str, make: Callable[[], T]) -> T:
    """What a Python worker keeps between tasks for one operator; another operator's goes first, as workers outlive stages."""
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    if _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def strings(column: pa.Array) -> pa.Array:
    """A string array without nulls; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches cut so that each holds ``limit`` bytes of text, or one longer text; with them that column without nulls."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = strings(batch.column(batch.schema.get_field_index(text)))
        ends = offsets(column)[1:]
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else offsets(column)[0]
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at), column.slice(at, to - at)
            at = to


def offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (one more entry for the end)."""
    at = offsets(column)
    if at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


_rng = np.random.Generator(np.random.PCG64(20_240_817))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_power: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
POSITION = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits under which close inputs part."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power[0]) < n:
        with np.errstate(over="ignore"):
            for k, p in enumerate((_P, pow(_P, -1, 2**64))):
                x = np.full(n, p, np.uint64)
                x[0] = 1
                _power[k] = np.cumprod(x, dtype=np.uint64)
    return _power[0][:n], _power[1]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words, which are runs of bytes other than 0x20 and 0x09 to 0x0D within a text."""
    n = len(data)
    word = np.zeros(n + 1, bool)
    np.logical_not(_SPACE[data], out=word[:n])
    first = np.zeros(n + 1, bool)
    first[at] = True  # a text begins, or the last one ends
    before = np.empty(n + 1, bool)
    before[0], before[1:] = False, word[:n]
    starts = np.flatnonzero(word[:n] & (first[:n] | ~before[:n]))
    ends = np.flatnonzero(before & (first | ~word))
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A to Z lower-cased, and the number of the text that each belongs to."""
    data, at = utf8(column)
    starts, ends, doc = word_spans(data, at)
    if not len(starts):
        return np.zeros(0, np.uint64), doc
    power, inverse = _powers(len(data))
    with np.errstate(over="ignore"):
        value = _BYTE[_LOWER[data]] * power
        value[_SPACE[data]] = 0
        return mix(np.add.reduceat(value, starts) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(_P)), doc


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``words`` words.

    A text of fewer words has one shingle, the whole sequence; a text without words has none."""
    h, doc = word_hashes(column)
    n, total = len(column), len(h)
    count = np.bincount(doc, minlength=n) if total else np.zeros(n, np.int64)
    end = np.cumsum(count)
    begin = end - count
    with np.errstate(over="ignore"):
        if total >= words:
            x = np.zeros(total - words + 1, np.uint64)
            for k in range(words):
                x += h[k : total - words + 1 + k] * POSITION[k]
            x = mix(x)
        out = []
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            if e - b >= words:
                s = np.sort(x[b : e - words + 1])
                keep = np.empty(len(s), bool)
                keep[:1] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                out.append(s[keep])
            elif e > b:
                short = (h[b:e] * POSITION[: e - b]).sum(dtype=np.uint64) + POSITION[63] * np.uint64(e - b)
                out.append(mix(np.array([short], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


_ODD = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")


def chunks(text: str) -> list[str]:
    """The runs of characters that aren't Unicode white space."""
    return [x for x in _WHITE.split(text) if x] if _ODD.search(text) else text.split()
