"""Operator 2: exact top-k search by inner product, in three phases with a uniform threshold.

The components are cut into ``lists`` groups, and each partition of rows has a list of partial scores for each group;
a row's score is the sum of its partial scores.

1. Each partition gathers, for every query, the best entries of each of its lists, with their whole scores. The k-th
   best of all those is a safe cutoff: k rows reach it.
2. The cutoff is sent to all partitions. A row that reaches it has a partial score of at least the cutoff divided by the
   number of lists in one list or more, whatever the signs, so only such entries are collected.
3. The collected rows' scores are resolved exactly; those below the cutoff go, and the k best of the rest are the result.

Queries come in blocks of ``block`` rows, which bounds what is sent to the executors and back, however many there are;
each block's result is appended to a table, which is what the search returns.
Scores are whole numbers and exact: doubles are used only where every sum fits in 53 bits, else 64-bit integers.

Cases: a vector that is null or holds a null or non-finite component takes no part, as query or candidate.
Vectors whose components, scaled, reach 2^28 are scored in whole numbers of any size, and only a pair whose score itself
exceeds 64 bits is left out. A query meets only vectors of its own length. Ties
go to the smaller id. A row meets every other id; rows that repeat the query's id count as the query itself. Of repeated
ids among queries one row is taken, the least by its components. Empty tables give an empty result. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm.common import drop, materialize, scratch, write

K, LISTS, BLOCK = 10, 4, 1024
#: Rows that are scored at a time.
STRIP = 2048
LIMIT = float(1 << 28)


def whole(vector: Column, scale: float = 1024.0) -> Column:
    """floor(scale * x) of each component x, as doubles that hold whole numbers; null for a vector that takes no part."""
    # From 2^52 on a double is whole already, and floor() would end at 64 bits.
    one = lambda y: F.when(F.abs(y) < F.lit(2.0**52), F.floor(y).cast("double")).otherwise(y)
    scaled = F.transform(vector, lambda x: one(x.cast("double") * F.lit(scale)))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * F.lit(scale) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & fine, scaled)


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a batch, by the vectors' length."""
    ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    at = vectors.offsets.to_numpy()
    size = np.diff(at)
    flat = vectors.values.to_numpy(zero_copy_only=False)
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        for k in range(0, len(rows), STRIP):
            own = rows[k : k + STRIP]
            x = flat[at[own][:, None] + np.arange(d)]
            large = _large(x)
            for part in (~large, large) if large.any() else (~large,):
                if part.any():
                    yield ids[own[part]], x[part]


def _large(x: np.ndarray) -> np.ndarray:
    return np.abs(x).max(axis=1, initial=0) >= LIMIT


def _asked(queries: dict, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The queries of a length, those with large components apart."""
    names, q = queries[d]
    large = _large(q)
    for part in (~large, large):
        if part.any():
            yield names[part], q[part]


def _exact(q: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(query's row, vector's row, score) of the pairs whose score fits in 64 bits, by Python's whole numbers."""
    right = [[int(v) for v in r] for r in x.tolist()]
    for i, r in enumerate(q.tolist()):
        left = [int(v) for v in r]
        for j, other in enumerate(right):
            score = sum(map(mul, left, other))
            if -(2**63) <= score < 2**63:
                yield i, j, score


def _partial(q: np.ndarray, x: np.ndarray, lists: int) -> list[np.ndarray]:
    """Partial scores of all queries (rows) and vectors (columns) for each group of components."""
    d = q.shape[1]
    if not d or np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * d >= 2.0**53:
        q, x = q.astype(np.int64), x.astype(np.int64)
    edges = np.linspace(0, d, lists + 1).astype(int)
    return [q[:, a:b] @ x[:, a:b].T for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _gather(sent: Broadcast, k: int, lists: int):
    """Phase 1: for every query the k best of the entries that a partition's lists put first, with whole scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, best = sent.value, {}
        for batch in batches:
            for ids, x in _arrays(batch):
                if x.shape[1] not in queries:
                    continue
                for names, q in _asked(queries, x.shape[1]):
                    if _large(q[:1])[0] or _large(x[:1])[0]:
                        for i, j, score in _exact(q, x):
                            name = int(names[i])
                            if ids[j] != name:
                                best[name] = sorted([*best.get(name, []), (score, int(ids[j]))], key=lambda e: (-e[0], e[1]))[:k]
                        continue
                    parts = _partial(q, x, lists)
                    total = sum(parts[1:], parts[0])
                    n = min(k + 1, len(ids))  # one more, as the query itself may be there
                    for i, name in enumerate(names.tolist()):
                        first = np.unique(np.concatenate([np.argpartition(-p[i], n - 1)[:n] for p in parts]))
                        first = first[ids[first] != name]
                        entries = [*best.get(name, []), *((int(s), v) for s, v in zip(total[i, first].tolist(), ids[first].tolist(), strict=True))]
                        entries.sort(key=lambda e: (-e[0], e[1]))
                        best[name] = entries[:k]
        rows = [(q, int(s), i) for q, own in best.items() for s, i in own]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["query_id", "score", "vec_id"])

    return run


def _collect(sent: Broadcast, cutoff: dict[int, int], k: int, lists: int):
    """Phases 2 and 3 within a partition: entries that reach the uniform threshold, then the rows that reach the cutoff."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        for batch in batches:
            for ids, x in _arrays(batch):
                if x.shape[1] not in queries:
                    continue
                for names, q in _asked(queries, x.shape[1]):
                    need = np.array([cutoff.get(n, -(2**63)) for n in names.tolist()], np.int64)
                    if _large(q[:1])[0] or _large(x[:1])[0]:
                        found = list(_exact(q, x))
                        i, j, score = (np.array([f[c] for f in found], np.int64) for c in range(3))
                    else:
                        parts = _partial(q, x, lists)
                        share = np.floor(need / lists) if parts[0].dtype == np.float64 else need // lists
                        reach = parts[0] >= share[:, None]
                        for p in parts[1:]:
                            reach |= p >= share[:, None]
                        i, j = np.nonzero(reach)
                        score = sum((p[i, j] for p in parts[1:]), parts[0][i, j])
                    keep = (score >= need[i]) & (ids[j] != names[i])
                    i, j, score = i[keep], j[keep], score[keep]
                    # No partition needs to send more than its own k best of a query.
                    order = np.lexsort((ids[j], ~score.astype(np.int64), i))
                    i, j, score = i[order], j[order], score[order]
                    rank = np.arange(len(i)) - np.searchsorted(i, i)
                    top = rank < k
                    yield pa.RecordBatch.from_arrays([pa.array(names[i[top]].astype(np.int64)), pa.array(ids[j[top]].astype(np.int64)), pa.array(score[top].astype(np.int64))], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K, lists: int = LISTS, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows of ``vectors`` that score highest for each row of ``queries``."""
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].alias("vec_id"), whole(vectors[vector_col], scale).alias("v")).filter("v IS NOT NULL AND vec_id IS NOT NULL")
    asked = queries.select(queries[id_col].alias("query_id"), whole(queries[vector_col], scale).alias("v")).filter("v IS NOT NULL AND query_id IS NOT NULL").groupBy("query_id").agg(F.min("v").alias("v"))
    asked, path, after = materialize(asked), scratch(spark), None
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    while True:
        # The next block by id: at most ``block`` vectors reach the driver.
        own = (asked if after is None else asked.filter(F.col("query_id") > F.lit(after))).orderBy("query_id").limit(block).collect()
        if not own:
            break
        after = own[-1]["query_id"]
        by: dict[int, list] = {}
        for r in own:
            by.setdefault(len(r["v"]), []).append(r)
        sent = spark.sparkContext.broadcast({d: (np.array([r["query_id"] for r in g], np.int64), np.array([r["v"] for r in g], np.float64).reshape(len(g), d)) for d, g in by.items()})
        local = rows.mapInArrow(_gather(sent, k, lists), "query_id long, score long, vec_id long")
        ranked = local.withColumn("r", F.row_number().over(best))
        cutoff = {r["query_id"]: r["score"] for r in ranked.filter(F.col("r") == k).select("query_id", "score").collect()}
        found = rows.mapInArrow(_collect(sent, cutoff, k, lists), "query_id long, vec_id long, score long")
        # Each block's result is written, so neither plans nor what was sent pile up with the queries.
        write(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), path)
        sent.unpersist()
    drop(asked)
    if after is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)


def brute(vectors: pd.DataFrame, queries: pd.DataFrame, k: int = K) -> list[tuple[int, int, int, int]]:
    """The same in plain Python, for tests."""

    def ints(v):
        return None if v is None or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(1024 * float(x))) for x in v]

    rows = [(i, x) for i, v in zip(vectors["vec_id"], vectors["embedding"], strict=True) if (x := ints(v)) is not None]
    out = []
    for i, v in zip(queries["vec_id"], queries["embedding"], strict=True):
        if (q := ints(v)) is not None:
            own = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in rows if j != i and len(x) == len(q))
            out += [(int(i), r + 1, int(j), -s) for r, (s, j) in enumerate(own[:k])]
    return out
