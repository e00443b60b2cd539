"""Tracks of detections: overlap first, then likeness, then age; and what a finished track amounts to.

One tracker a source, in order of frames. Rows are (source, frame_idx, id, bbox, embedding, quality); a frame without
detections is a row with a null id, as age counts processed frames."""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.config import Tracker
from kindred.functions import vectors as V
from kindred.operators.identity import unit

#: Likeness by which a detection continues a track that it doesn't overlap.
LIKE = 0.55


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of all boxes of ``a`` (rows) and ``b`` (columns)."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.maximum(high - low, 0).prod(axis=2)
    area = lambda r: (r[:, 2] - r[:, 0]) * (r[:, 3] - r[:, 1])
    return np.where(both > 0, both / (area(a)[:, None] + area(b)[None] - both + 1e-9), 0.0)


@dataclass
class Track:
    number: int
    box: np.ndarray
    first: int
    last: int = 0
    vectors: list = field(default_factory=list)
    qualities: list = field(default_factory=list)
    hits: int = 0
    age: int = 0
    best: float = -1.0
    best_id: int = -1

    def take(self, frame: int, one: int, box: np.ndarray, vector: np.ndarray, quality: float, most: int) -> None:
        self.box, self.last, self.age, self.hits = box, frame, 0, self.hits + 1
        if len(self.vectors) < most:
            self.vectors.append(vector)
            self.qualities.append(quality)
        if quality > self.best:
            self.best, self.best_id = quality, one

    def vector(self) -> np.ndarray:
        q = np.array(self.qualities)
        q = np.ones_like(q) if q.sum() <= 1e-6 else q
        return unit((np.array(self.vectors) * q[:, None]).sum(axis=0) / q.sum())

    def row(self, source: str) -> tuple:
        return (source, self.number, *map(float, self.box), 1.0, self.first, self.last, float(np.mean(self.qualities)), len(self.qualities), self.hits, self.best_id, self.vector().tolist())


class Tracks:
    """The state of one source."""

    def __init__(self, cfg: Tracker):
        self.cfg, self.next, self.active = cfg, 0, []

    def frame(self, frame: int, ids: list[int], boxes: np.ndarray, vectors: np.ndarray, qualities: list[float]) -> tuple[list[int], list[Track]]:
        """The track of each detection of a frame, and the tracks that end with it."""
        got = [-1] * len(ids)
        hit: set[int] = set()

        def give(track: Track, k: int) -> None:
            got[k] = track.number
            hit.add(track.number)
            track.take(frame, ids[k], boxes[k], vectors[k], qualities[k], self.cfg.max_embeddings_per_track)

        if self.active and ids:
            share = overlap(np.array([t.box for t in self.active]), boxes)
            t, k = np.nonzero(share >= self.cfg.iou_threshold)
            for n in np.argsort(-share[t, k], kind="stable"):
                track = self.active[t[n]]
                if track.number not in hit and got[k[n]] < 0:
                    give(track, int(k[n]))
            for track in self.active:
                free = [j for j in range(len(ids)) if got[j] < 0]
                if track.number in hit or not free or not track.vectors:
                    continue
                like = vectors[free] @ track.vector()
                if like.max() >= LIKE:
                    give(track, free[int(like.argmax())])
        for k in range(len(ids)):
            if got[k] < 0:
                track = Track(self.next, boxes[k], frame)
                self.next += 1
                self.active.append(track)
                give(track, k)
        ended = []
        for track in self.active:
            track.age += track.number not in hit
        ended = [t for t in self.active if t.age > self.cfg.max_age]
        self.active = [t for t in self.active if t.age <= self.cfg.max_age]
        return got, [t for t in ended if t.hits >= self.cfg.min_hits]

    def flush(self) -> list[Track]:
        """The confirmed tracks that are still active; none stays."""
        left, self.active = [t for t in self.active if t.hits >= self.cfg.min_hits], []
        return left

    def frames(self, pdf: pd.DataFrame) -> tuple[list[tuple[int, int]], list[Track]]:
        """All frames of rows in order: (id, track) of each detection, and the tracks that ended."""
        found, ended = [], []
        for n, f in pdf.sort_values(["frame_idx", "id"], na_position="first").groupby("frame_idx", sort=True):
            f = f[f["id"].notna()]
            ids = f["id"].astype("int64").tolist()
            boxes = np.array([[b["x1"], b["y1"], b["x2"], b["y2"]] for b in f["bbox"]], np.float64).reshape(-1, 4)
            vectors = np.vstack(f["embedding"]).astype(np.float64) if ids else np.zeros((0, 1))
            got, done = self.frame(int(n), ids, boxes, vectors, f["quality"].astype(float).tolist())
            found += zip(ids, got, strict=True)
            ended += done
        return found, ended

    def dump(self) -> bytes:
        return pickle.dumps((self.next, self.active))

    @classmethod
    def loaded(cls, cfg: Tracker, state: bytes) -> Tracks:
        out = cls(cfg)
        out.next, out.active = pickle.loads(state)  # noqa: S301 - written by dump
        return out


TRACK = "source string, track_id int, x1 double, y1 double, x2 double, y2 double, det_score double, first_frame int, last_frame int, quality double, n_frames int, hits int, best_id long, embedding array<double>"
TRACK_COLUMNS = [c.split()[0] for c in TRACK.split(", ")]


def assigned(detections: DataFrame, cfg: Tracker) -> DataFrame:
    """(source, id, track_id) of every detection, unconfirmed tracks included."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found, _ = Tracks(cfg).frames(pdf)
        return pd.DataFrame(found, columns=["id", "track_id"]).assign(source=pdf["source"].iat[0])[["source", "id", "track_id"]]

    return detections.select("source", "frame_idx", "id", "bbox", "embedding", "quality").groupBy("source").applyInPandas(run, "source string, id long, track_id int")


def tracks(detections: DataFrame, cfg: Tracker) -> DataFrame:
    """One row for each confirmed track of each source; those active at the end count."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = Tracks(cfg)
        _, ended = own.frames(pdf)
        return pd.DataFrame([t.row(pdf["source"].iat[0]) for t in [*ended, *own.flush()]], columns=TRACK_COLUMNS)

    return detections.select("source", "frame_idx", "id", "bbox", "embedding", "quality").groupBy("source").applyInPandas(run, TRACK)


def overlapping(a: DataFrame, b: DataFrame, key: str, least: float = 0.3) -> DataFrame:
    """(i, j, iou) of boxes (id, key, bbox) of both sides with one key whose overlap is ``least`` or more.

    The corners' order is part of the join condition, so only boxes that meet are measured."""
    x = a.select(F.col("id").alias("i"), F.col(key).alias("k"), F.col("bbox").alias("p"))
    y = b.select(F.col("id").alias("j"), F.col(key).alias("k2"), F.col("bbox").alias("q"))
    meets = (F.col("p.x1") < F.col("q.x2")) & (F.col("q.x1") < F.col("p.x2")) & (F.col("p.y1") < F.col("q.y2")) & (F.col("q.y1") < F.col("p.y2"))
    return x.join(y, (F.col("k") == F.col("k2")) & meets).withColumn("iou", V.iou(F.col("p"), F.col("q"))).filter(F.col("iou") >= least).select("i", "j", "iou")


def summarized(rows: DataFrame, most: int = 30) -> DataFrame:
    """What tracks amount to where rows (track_id, frame_idx, quality, embedding, id) know their track already.

    The first ``most`` rows of a track make its vector, weighed by quality; its best row is of all of them."""
    ranked = rows.withColumn("first", F.min("frame_idx").over(_of_track())).withColumn("n", F.row_number().over(_of_track().orderBy("frame_idx")))
    best = rows.groupBy("track_id").agg(F.max_by("id", F.struct("quality", (-F.col("frame_idx")).alias("f"))).alias("best_id"), F.count("*").alias("hits"), F.max("frame_idx").alias("last_frame"))
    capped = ranked.filter(F.col("n") <= most).groupBy("track_id").agg(F.min("first").alias("first_frame"), F.avg("quality").alias("quality"), F.count("*").alias("n_frames"), F.sum("quality").alias("weight"))
    parts = ranked.filter(F.col("n") <= most).select("track_id", "quality", F.posexplode(V.doubles(F.col("embedding"))).alias("i", "x"))
    sums = parts.groupBy("track_id", "i").agg(F.sum(F.col("quality") * F.col("x")).alias("s"), F.avg("x").alias("m"))
    whole = sums.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("i", "s", "m"))).alias("p"))
    joined = capped.join(best, "track_id").join(whole, "track_id")
    mean = F.when(F.col("weight") <= 1e-6, F.transform("p", lambda x: x["m"])).otherwise(F.transform("p", lambda x: x["s"] / F.col("weight")))
    return joined.select("track_id", "first_frame", "last_frame", "quality", "n_frames", "hits", "best_id", V.l2_normalize(mean).alias("embedding"))


def _of_track():
    from pyspark.sql.window import Window

    return Window.partitionBy("track_id")
