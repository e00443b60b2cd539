"""Operator 8: best-fit packing by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits in one sequence. The program asks for the fewest configurations that
cover the histogram. Multiplicative weights solve it: each round, a knapsack dynamic program finds the configuration of
the highest price, its lengths become cheaper as they are covered, and the average of the rounds is the fractional
solution; the prices prove a lower bound on the way. It is rounded down to whole configurations, and best fit packs the
pieces that are left, still on the histogram: first into the room that configurations leave, then into new sequences.

Only the histogram reaches the driver, at most ``capacity`` numbers however many documents there are, and the plan that
returns, a few entries a configuration, has a size bounded by the capacity and the rounds. Ranks of pieces of a length
are counted within the partition that cut them and shifted by sums over (length, partition), so no task sorts a length.

Cases: a null or empty text is the end token alone. Repeated rows and repeated ids are packed as often as they occur. An
empty table gives an empty result. A text of any length is cut into full pieces, none is dropped. Only the named columns
are read, so other columns may have any names.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm.bpe import WordBpe, encoded
from kindred.llm.common import materialize

#: Rounds of the linear program, and how strongly a round changes the prices.
ROUNDS, RATE = 120, 0.08


def knapsack(price: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """How often each length is in the configuration of the highest total price, and that price. Lengths may repeat."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    for c in range(int(lengths[0]), capacity + 1):
        n = int(np.searchsorted(lengths, c, side="right"))
        value = best[c - lengths[:n]] + price[:n]
        k = int(value.argmax())
        if value[k] > best[c - 1]:
            best[c], taken[c] = value[k], k
        else:
            best[c] = best[c - 1]
    counts = np.zeros(len(lengths), np.int64)
    c = capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            counts[taken[c]] += 1
            c -= int(lengths[taken[c]])
    return counts, float(best[capacity])


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS, rate: float = RATE) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Configurations with their fractional numbers, and a lower bound on the number of sequences."""
    price = lengths / capacity
    bound = float(demand @ price)
    found: dict[bytes, list] = {}
    for _ in range(rounds):
        counts, value = knapsack(price, lengths, capacity)
        bound = max(bound, float(demand @ price) / value)
        found.setdefault(counts.tobytes(), [counts, 0])[1] += 1
        # A length is covered too often where the number in the configuration, times the bound, exceeds its demand.
        gain = np.clip(bound * counts / demand, 0, 8) - 1
        price = price * np.exp(-rate * gain)
        price /= float(demand @ price) / bound
    return [(c, bound * n / rounds) for c, n in found.values()], bound


@dataclass
class Plan:
    """Where the r-th piece of a length goes: entry k holds ranks ``start[k]`` to the next entry's of that length."""

    length: np.ndarray
    start: np.ndarray
    each: np.ndarray  # pieces of the length in one sequence of the entry
    sequence: np.ndarray  # of the entry's first one
    offset: np.ndarray
    sequences: int
    bound: float


def plan(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, rate: float = RATE) -> Plan:
    """Packs a histogram of lengths 1 to ``capacity`` into sequences of ``capacity``."""
    items = sorted((k, n) for k, n in histogram.items() if n)
    if items and not 1 <= items[0][0] <= items[-1][0] <= capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    left = dict(items)
    # A bin is (room, [(length, how many), ...], how many such bins).
    bins: list[tuple[int, list[tuple[int, int]], int]] = []
    bound = 0.0
    if full := left.pop(capacity, 0):
        bins.append((0, [(capacity, 1)], full))
    if left:
        lengths = np.array(sorted(left), np.int64)
        demand = np.array([left[x] for x in lengths.tolist()], np.float64)
        found, bound = fractional(lengths, demand, capacity, rounds, rate)
        for counts, share in sorted(found, key=lambda x: (-x[1], x[0].tobytes())):
            own = [(int(lengths[k]), int(counts[k])) for k in np.flatnonzero(counts)]
            times = min([int(share + 0.5), *(left[x] // n for x, n in own)])
            if times:
                bins.append((capacity - sum(x * n for x, n in own), own, times))
                for x, n in own:
                    left[x] -= n * times
    # Best fit, longest first, on classes of like bins.
    rooms: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    for room, own, times in bins:
        rooms.setdefault(room, []).append((own, times))
    for x in sorted(left, reverse=True):
        n = left[x]
        fitting = [r for r in rooms if r >= x]
        heapq.heapify(fitting)
        while n:
            if fitting:
                room = heapq.heappop(fitting)
                own, times = rooms[room].pop()
                if rooms[room]:
                    heapq.heappush(fitting, room)
                else:
                    del rooms[room]
            else:
                room, own, times = capacity, [], -(-n // (capacity // x))
            used = min(room // x, max(1, n // times))
            here = min(times, n // used)
            if here < times:
                rooms.setdefault(room, []).append((own, times - here))
                if own and room not in fitting:
                    heapq.heappush(fitting, room)
                elif not own:
                    rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room]
            rest = room - used * x
            rooms.setdefault(rest, []).append(([*own, (x, used)], here))
            n -= used * here
            if rest >= x and rest not in fitting:
                heapq.heappush(fitting, rest)
    rows: list[tuple[int, int, int, int, int]] = []
    next_rank: dict[int, int] = {}
    total = 0
    for room in sorted(rooms):
        for own, times in rooms[room]:
            at = 0
            for x in sorted({x for x, _ in own}, reverse=True):
                n = sum(m for y, m in own if y == x)
                rows.append((x, next_rank.get(x, 0), n, total, at))
                next_rank[x] = next_rank.get(x, 0) + n * times
                at += n * x
            total += times
    rows.sort()
    columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 5
    return Plan(*columns, total, max(bound + full, sum(k * n for k, n in items) / capacity))


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """The pieces of all documents, with the partition that cut each and its rank there among pieces of its length."""
    tail = int(end).to_bytes(4, "little")

    def make(own: WordBpe, batch: pa.RecordBatch, ids: list[bytes]) -> pa.RecordBatch:
        task = TaskContext.get()
        now = (task.stageId(), task.partitionId(), task.taskAttemptId())
        if getattr(own, "_task", None) != now:
            own._task, own._seen = now, np.zeros(capacity + 1, np.int64)
        doc, piece, start, length, crc, rank = [], [], [], [], [], []
        for d, x in zip(batch.column(0).to_pylist(), ids, strict=True):
            x += tail
            for k, at in enumerate(range(0, len(x), 4 * capacity)):
                part = x[at : at + 4 * capacity]
                n = len(part) // 4
                doc.append(d)
                piece.append(k)
                start.append(at // 4)
                length.append(n)
                crc.append(zlib.crc32(part))
                rank.append(own._seen[n])
                own._seen[n] += 1
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([doc, piece, start, length, crc, [now[1]] * len(doc), rank], kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return encoded(docs, path, make, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long", by_matrix=True)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    cut = materialize(pieces(docs, path, capacity, end))
    # One row for each length that a partition has: the pieces of that length in partitions before it.
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = materialize(counts.select("length", "part", "n", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")))
    whole = plan({int(r["length"]): int(r["n"]) for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity, rounds)
    sent = docs.sparkSession.sparkContext.broadcast(whole)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = sent.value
        first = np.searchsorted(p.length, np.arange(capacity + 2))
        # Within a length, starts ascend; the key orders lengths first.
        for f in frames:
            length, rank = f["length"].to_numpy(), f["before"].to_numpy() + f["rank"].to_numpy()
            k = np.empty(len(f), np.int64)
            for x in np.unique(length):
                own = length == x
                k[own] = first[x] + np.searchsorted(p.start[first[x] : first[x + 1]], rank[own], side="right") - 1
            copy, slot = np.divmod(rank - p.start[k], p.each[k])
            yield f[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=p.sequence[k] + copy, offset=p.offset[k] + slot * length)

    # A row for each length of each partition: at most ``capacity`` numbers a partition. The optimizer may broadcast it while
    # it is small; beyond that the join's shuffle is on (length, part), which no length or partition fills alone.
    ranked = cut.join(before.select("length", "part", "before"), ["length", "part"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "before").mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
