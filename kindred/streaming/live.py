"""The stateful operators on streams: the gate over frames, tracks, and faces identified as they come.

Rows of a source must reach its state in order: a micro-batch is sorted by frame, and a frame older than the last one
seen is dropped, as there is no late data in an ordered source."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kindred.config import Acquisition, Tracker
from kindred.operators import clustering
from kindred.operators.acquisition import OUT, Gate
from kindred.operators.tracking import TRACK, TRACK_COLUMNS, Tracks
from kindred.tables import cut, numbered


def gated(frames: DataFrame, cfg: Acquisition) -> DataFrame:
    """A stream's (session, frame_idx, decision, saved_idx), as in batch."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate, last = Gate(cfg), -1
        if state.exists:
            last, kept = state.get
            gate.kept_at, gate.signature, gate.saved, gate.done = pickle.loads(kept)  # noqa: S301 - written below
        out = []
        for r in pd.concat(list(pdfs)).sort_values("frame_idx").itertuples(index=False):
            if r.frame_idx <= last:
                continue
            last = int(r.frame_idx)
            said = gate.decide(r.stream_time, r.sharpness, r.signature, bool(r.has_face))
            if said is not None:
                out.append((r.session, r.frame_idx, said, gate.saved - 1 if said == "kept" else None))
        state.update((last, pickle.dumps((gate.kept_at, None if gate.signature is None else np.asarray(gate.signature), gate.saved, gate.done))))
        yield pd.DataFrame(out, columns=["session", "frame_idx", "decision", "saved_idx"]).astype({"saved_idx": "Int32"})

    rows = frames.select("session", "frame_idx", "stream_time", "sharpness", "signature", "has_face")
    return rows.groupBy("session").applyInPandasWithState(run, OUT, "last long, gate binary", "append", GroupStateTimeout.NoTimeout)


def tracked(detections: DataFrame, cfg: Tracker) -> DataFrame:
    """A stream's (source, id, track_id), as in batch. The state of a source holds its active tracks only."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, own = -1, Tracks(cfg)
        if state.exists:
            last, kept = state.get
            own = Tracks.loaded(cfg, kept)
        pdf = pd.concat(list(pdfs))
        pdf = pdf[pdf["frame_idx"] > last]
        found, _ = own.frames(pdf) if len(pdf) else ([], [])
        state.update((int(pdf["frame_idx"].max()) if len(pdf) else last, own.dump()))
        yield pd.DataFrame(found, columns=["id", "track_id"]).assign(source=key[0])[["source", "id", "track_id"]]

    rows = detections.select("source", "frame_idx", "id", "bbox", "embedding", "quality")
    return rows.groupBy("source").applyInPandasWithState(run, "source string, id long, track_id int", "last long, tracks binary", "append", GroupStateTimeout.NoTimeout)


def ended_tracks(detections: DataFrame, cfg: Tracker) -> DataFrame:
    """A stream's confirmed tracks, each as a row when it ends; a row whose frame_idx is null ends its source, and the
    tracks that are active there end with it. The state of a source holds its active tracks only."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, own = -1, Tracks(cfg)
        if state.exists:
            last, kept = state.get
            own = Tracks.loaded(cfg, kept)
        pdf = pd.concat(list(pdfs))
        over, pdf = bool(pdf["frame_idx"].isna().any()), pdf[pdf["frame_idx"] > last]
        _, ended = own.frames(pdf) if len(pdf) else ([], [])
        last = int(pdf["frame_idx"].max()) if len(pdf) else last
        if over:
            ended = [*ended, *own.flush()]
        state.update((last, own.dump()))
        yield pd.DataFrame([t.row(key[0]) for t in ended], columns=TRACK_COLUMNS)

    rows = detections.select("source", "frame_idx", "id", "bbox", "embedding", "quality")
    return rows.groupBy("source").applyInPandasWithState(run, TRACK, "last long, tracks binary", "append", GroupStateTimeout.NoTimeout)


def faces_from(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that come into a folder; what a camera's process writes there."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder)


class Live:
    """``foreachBatch``: each batch's faces meet the classifier and the prototypes, move them, and are stored; unknown ones
    wait, and every ``every`` frames those waiting are clustered. Noise among them is forgotten and keeps no cluster.

    A frame without faces is a row with a null embedding, and counts. All state is in the stores' pointers: the last batch,
    the frames since the last clustering, and the id up to which nothing waits. A batch that comes again after a crash is
    passed over, or folded from the prototypes that it began with, so it moves them once."""

    def __init__(self, engine, every: int = 100, now: Callable[[], float] = lambda: 0.0):
        self.engine, self.every, self.now = engine, every, now

    def _fold(self, mark: str, value: int, centers: DataFrame, points: DataFrame) -> DataFrame:
        """A fold that is done once for a ``value`` of ``mark``, also where the faces weren't stored after it."""
        e, own = self.engine, self.engine.prototypes.meta()
        again = own.get("mark") == [mark, value]
        base = own.get("base" if again else "parts", [])
        number = own["base_number"] if again else e.prototypes.next_number()
        return e.fold(centers, points, self.now(), e.prototypes.read(base), next_number=number, mark=[mark, value], base=base, base_number=number)

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        e = self.engine
        own = e.faces.meta()
        if own.get("epoch", -1) < epoch:
            rows = cut(batch)
            frames = own.get("frames", 0) + rows.select("source", "frame_idx").distinct().count()
            seen = rows.filter("embedding IS NOT NULL")
            if seen.isEmpty():
                e.faces.note(epoch=epoch, frames=frames)
            else:
                faces = cut(numbered(seen, "n", "source", "frame_idx", "id"))
                folded = self._fold("epoch", epoch, e.spark.createDataFrame([], "cluster_id int, vector array<double>, n long"), faces.select(F.col("n").alias("id"), "embedding"))
                who = folded.filter("kind = 'noise'").select(F.col("key").alias("n"), "person_id")
                e.faces.add(faces.drop("person_id").join(who, "n").drop("n"), self.now(), epoch=epoch, frames=frames)
        if e.faces.meta().get("frames", 0) >= self.every:
            self.drain()

    def drain(self) -> None:
        """Clusters what waits; also at the end of a stream."""
        e, own = self.engine, self.engine.faces.meta()
        last, after = own.get("last_id", 0), own.get("drained", 0)
        ids = e.faces.read().filter((F.col("id") > after) & F.col("person_id").isNull() & F.col("cluster_id").isNull()).select("id", "embedding")
        labels = None if ids.isEmpty() else cut(clustering.clustered(ids, e.cfg.clustering).filter("cluster_id >= 0"))
        if labels is None or labels.isEmpty():
            e.faces.note(frames=0, drained=last)
            return
        folded = self._fold("drained", last, clustering.centroids(labels), labels.filter("false").select("id", "embedding"))
        of = folded.filter("kind = 'cluster'").select(F.col("key").cast("int").alias("cluster_id"), "person_id")
        e.faces.assign(labels.select("id", "cluster_id").join(of, "cluster_id"), frames=0, drained=last)

    def start(self, faces: DataFrame, checkpoint: str, once: bool = False):
        """The running query over a stream of faces; ``once``: only what is there already."""
        writer = faces.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
