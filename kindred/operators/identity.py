"""Persistent identities: prototypes, their moving averages, and the cascade that resolves a vector.

Prototypes are rows (person_id, seq, vector, count, created_at, updated_at, label); seq keeps the order of insertion.
Operators that read a frozen snapshot are joins. Those in which each step sees the one before it run as one fold over the
clusters and the noise of a run, in one task by definition; everything that can be done before the fold is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kindred import tables
from kindred.config import Prototypes
from kindred.functions import vectors as V
from kindred.operators import neighbors

SCHEMA = "person_id string, seq int, vector array<double>, count long, created_at double, updated_at double, label string"


def unit(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, np.float64)
    return v / (np.sqrt(float(v @ v)) + V.EPSILON)


def person(number: int | Column) -> str | Column:
    return F.format_string("person_%04d", number) if isinstance(number, Column) else f"person_{number:04d}"


def ema(first: Column, rest: Column, alpha: float) -> Column:
    """The prototype after the vectors of ``rest`` in order: each moves it by ``alpha`` and it is made a unit vector again."""
    step = lambda v, e: V.l2_normalize(F.zip_with(v, e, lambda a, b: F.lit(1 - alpha) * a + F.lit(alpha) * b))
    return F.aggregate(rest, V.doubles(first), step)


def learned(rows: DataFrame, key: str, order: str, alpha: float) -> DataFrame:
    """(key, vector, n): the prototype of each key, begun by its first vector and moved by the others in order.

    The fold of a key is sequential by definition; its rows come sorted and in batches, and only its prototype is held."""
    kind = rows.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, v, n, done = None, None, 0, []
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), neighbors.matrix(b.column(1)) if b.num_rows else (), strict=True):
                if n and k == name:
                    v, n = unit((1 - alpha) * v + alpha * x), n + 1
                    continue
                if n:
                    done.append((name, v, n))
                name, v, n = k, x, 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], to_arrow_type(kind)), pa.array([d[1] for d in done], pa.list_(pa.float64())), pa.array([d[2] for d in done], pa.int64())], [key, "vector", "n"])
                done = []
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([name], to_arrow_type(kind)), pa.array([v], pa.list_(pa.float64())), pa.array([n], pa.int64())], [key, "vector", "n"])

    dealt = rows.select(key, F.col(order).alias("o"), V.doubles(F.col("embedding")).alias("v")).repartition(key).sortWithinPartitions(key, "o", "v").select(key, "v")
    return dealt.mapInArrow(run, f"`{key}` {kind.simpleString()}, vector array<double>, n long")


def match(points: DataFrame, prototypes: DataFrame, threshold: float) -> DataFrame:
    """(id, person_id, score) for every point: the nearest prototype's id where its similarity reaches ``threshold``; the
    score is the best similarity also where none does, and 0 without prototypes."""
    refs = prototypes.select(F.col("person_id").alias("ref"), F.col("seq").cast("long").alias("seq"), "vector")
    found = neighbors.nearest(points.select("id", "embedding"), refs)
    joined = points.select("id").join(found, "id", "left")
    return joined.select("id", F.when(F.col("similarity") >= threshold, F.col("ref")).alias("person_id"), F.coalesce("similarity", F.lit(0.0)).alias("score"))


def resolve(points: DataFrame, prototypes: DataFrame, threshold: float, verdicts: DataFrame | None = None) -> DataFrame:
    """(id, person_id, score, source) by classifier, then prototype, then unknown.

    ``verdicts``: (id, person_id, confidence) of a classifier, null person where it abstains; a verdict for a person who
    is no longer known doesn't count."""
    near = match(points, prototypes, threshold)
    if verdicts is None:
        return near.withColumn("source", F.when(F.col("person_id").isNotNull(), "prototype").otherwise("unknown"))
    known = verdicts.filter("person_id IS NOT NULL").join(prototypes.select("person_id"), "person_id", "left_semi").select("id", F.col("person_id").alias("said"), "confidence")
    both = near.join(known, "id", "left")
    return both.select(
        "id", F.coalesce("said", "person_id").alias("person_id"), F.coalesce("confidence", "score").alias("score"), F.when(F.col("said").isNotNull(), "classifier").when(F.col("person_id").isNotNull(), "prototype").otherwise("unknown").alias("source")
    )


def appended(prototypes: DataFrame, new: DataFrame, next_number: int, now: float) -> DataFrame:
    """``prototypes`` with rows (vector, count, ord) of ``new`` as new persons, numbered on from ``next_number`` in order."""
    last = prototypes.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("s"))
    rows = tables.numbered(new, "k", "ord").withColumn("k", F.col("k").cast("int")).crossJoin(F.broadcast(last))
    made = rows.select(
        person(F.col("k") + F.lit(next_number)).alias("person_id"), (F.col("s") + F.col("k")).cast("int").alias("seq"), V.l2_normalize(F.col("vector")).alias("vector"), F.col("count").cast("long").alias("count"),
        F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), F.lit(None).cast("string").alias("label"),
    )
    return prototypes.unionByName(made)


def updated(prototypes: DataFrame, person_id: str, vector: list[float], alpha: float, now: float) -> DataFrame:
    """``prototypes`` with one moved towards ``vector``; KeyError where the person isn't known."""
    own = F.col("person_id") == person_id
    if prototypes.filter(own).isEmpty():
        raise KeyError(person_id)
    moved = ema(F.col("vector"), F.array(F.lit([float(x) for x in vector])), alpha)
    return prototypes.withColumns({"vector": F.when(own, moved).otherwise(F.col("vector")), "count": F.when(own, F.col("count") + 1).otherwise(F.col("count")), "updated_at": F.when(own, F.lit(now)).otherwise(F.col("updated_at"))})


def labelled(prototypes: DataFrame, person_id: str, label: str | None) -> DataFrame:
    """Sets or clears a label; KeyError where the person isn't known."""
    if prototypes.filter(F.col("person_id") == person_id).isEmpty():
        raise KeyError(person_id)
    return prototypes.withColumn("label", F.when(F.col("person_id") == person_id, F.lit(label).cast("string")).otherwise(F.col("label")))


def without(prototypes: DataFrame, gone: DataFrame) -> DataFrame:
    """``prototypes`` but the persons of ``gone``. Numbers aren't used again; faces keep their person."""
    return prototypes.join(gone.select("person_id"), "person_id", "left_anti").select(prototypes.columns)


def cluster_persons(rows: DataFrame) -> DataFrame:
    """``rows`` with person_id from the cluster's number, for runs without prototypes; null for noise."""
    return rows.withColumn("person_id", F.when(F.col("cluster_id") >= 0, F.concat(F.lit("cluster_"), F.col("cluster_id").cast("string"))))


class Book:
    """Prototypes in the memory of the one task that folds: match, move, add."""

    def __init__(self, rows: list[tuple], threshold: float, alpha: float, next_number: int, now: float):
        self.rows = [list(r) for r in rows]
        self.threshold, self.alpha, self.next, self.now = threshold, alpha, next_number, now
        self.m = np.array([r[2] for r in rows], np.float64) if rows else None

    def match(self, e: np.ndarray) -> tuple[int | None, float]:
        if self.m is None:
            return None, 0.0
        s = self.m @ e
        k = int(s.argmax())
        return (k if s[k] >= self.threshold else None), float(s[k])

    def move(self, k: int, e: np.ndarray) -> str:
        self.m[k] = unit((1 - self.alpha) * self.m[k] + self.alpha * e)
        self.rows[k][2], self.rows[k][3], self.rows[k][5] = self.m[k], self.rows[k][3] + 1, self.now
        return self.rows[k][0]

    def place(self, who: str | None) -> int | None:
        """Where a person stands, None where nobody of that name is known."""
        return next((k for k, r in enumerate(self.rows) if r[0] == who), None) if who is not None else None

    def add(self, e: np.ndarray, count: int) -> str:
        v = unit(e)
        seq = max((r[1] for r in self.rows), default=-1) + 1
        self.rows.append([person(self.next), seq, v, count, self.now, self.now, None])
        self.m = v[None].copy() if self.m is None else np.vstack([self.m, v])
        self.next += 1
        return self.rows[-1][0]


def absorb(centers: DataFrame, noise: DataFrame, prototypes: DataFrame, cfg: Prototypes, next_number: int, now: float, match_all: bool = False) -> DataFrame:
    """Clusters and then noise against the prototypes, each step seeing what the earlier ones learned.

    ``centers``: (cluster_id, vector, n), ascending; a match moves the prototype once, else a new person begins with the
    cluster's size. ``noise``: (id, embedding), in order of id, with a classifier's verdict (said, confidence) where it has
    these columns; a verdict for a person who is known moves that person's prototype, else a match moves the matched one,
    else the row stays unknown (or begins a person of its own where ``match_all``). Returns rows of kind cluster (key,
    person_id, score), noise (key, person_id, score), prototype (person_id and the other columns) and next (key: the
    number of the next new person).

    The fold is sequential by definition. It reads one centroid a cluster and the noise; members of clusters stay out."""
    if "said" not in noise.columns:
        noise = noise.withColumns({"said": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    steps = (
        prototypes.select(F.lit(0).alias("kind"), F.col("seq").cast("long").alias("k"), "vector", "person_id", "count", "created_at", "updated_at", "label")
        .unionByName(centers.select(F.lit(1).alias("kind"), F.col("cluster_id").cast("long").alias("k"), "vector", F.col("n").alias("count")), allowMissingColumns=True)
        .unionByName(noise.select(F.lit(2).alias("kind"), F.col("id").cast("long").alias("k"), V.doubles(F.col("embedding")).alias("vector"), F.lit(1).cast("long").alias("count"), "said", "confidence"), allowMissingColumns=True)
    )
    threshold, alpha = cfg.match_threshold, cfg.ema_alpha

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, book = [], None

        def start() -> Book:
            return Book([(r.person_id, int(r.k), r.vector, int(r.count_), r.created_at, r.updated_at, r.label) for r in held], threshold, alpha, next_number, now)

        for f in frames:
            out = []
            for r in f.rename(columns={"count": "count_"}).itertuples(index=False):
                if r.kind == 0:
                    held.append(r)
                    continue
                book = book or start()
                e = np.asarray(r.vector, np.float64)
                k, score = book.place(r.said), r.confidence
                if k is None:
                    k, score = book.match(e)
                if k is not None:
                    who = book.move(k, e)
                elif r.kind == 1 or match_all:
                    who = book.add(e, int(r.count_))
                else:
                    who = None
                out.append(("cluster" if r.kind == 1 else "noise", int(r.k), who, score))
            if out:
                yield pd.DataFrame([(*r, None, None, None, None, None) for r in out], columns=COLUMNS, dtype=object)
        book = book or start()
        kept = [("prototype", r[1], r[0], None, r[2], r[3], r[4], r[5], r[6]) for r in book.rows] + [("next", book.next, *[None] * 7)]
        yield pd.DataFrame(kept, columns=COLUMNS, dtype=object)

    # The fold alone is one task; what it reads is made by as many as there are.
    return steps.repartition(1).sortWithinPartitions("kind", "k").mapInPandas(run, "kind string, key long, person_id string, score double, vector array<double>, count long, created_at double, updated_at double, label string")


COLUMNS = ["kind", "key", "person_id", "score", "vector", "count", "created_at", "updated_at", "label"]


def prototypes_of(folded: DataFrame) -> DataFrame:
    return folded.filter("kind = 'prototype'").select("person_id", F.col("key").cast("int").alias("seq"), "vector", "count", "created_at", "updated_at", "label")


def next_of(folded: DataFrame) -> int:
    """The number of the next new person after a fold."""
    return int(folded.filter("kind = 'next'").first()["key"])


def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
