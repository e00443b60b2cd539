"""Which frames of a session are kept: interval, then sharpness, then change, then faces.

Whether a frame is kept depends on the last one that was, so a session is one ordered fold. Rows are (session, frame_idx,
stream_time, sharpness, signature, has_face). A frame that is turned down doesn't reset the clock."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.config import Acquisition

#: By how much a pixel must differ to count as changed.
DELTA = 12.0


@dataclass
class Gate:
    """A session's state."""

    cfg: Acquisition
    kept_at: float = -np.inf
    signature: np.ndarray | None = None
    saved: int = 0
    done: bool = False

    def decide(self, time: float, sharpness: float, signature, has_face: bool = True) -> str | None:
        """kept, interval, blurry, unchanged, no_face or stop; None once the session is over."""
        c = self.cfg
        if self.done:
            return None
        if c.max_duration_seconds and time >= c.max_duration_seconds:
            self.done = True
            return "stop"
        if time - self.kept_at < c.interval_seconds:
            return "interval"
        if c.min_blur_variance > 0 and sharpness < c.min_blur_variance:
            return "blurry"
        now = None if signature is None else np.asarray(signature, np.float64)
        if self.signature is not None and now is not None and float((np.abs(now - self.signature) > DELTA).mean()) < c.min_change_fraction:
            return "unchanged"
        if c.face_gate and not has_face:
            return "no_face"
        self.kept_at, self.signature, self.saved = time, now, self.saved + 1
        self.done = bool(c.max_frames and self.saved >= c.max_frames)
        return "kept"


OUT = "session string, frame_idx long, decision string, saved_idx int"


def decided(frames: DataFrame, cfg: Acquisition) -> DataFrame:
    """(session, frame_idx, decision, saved_idx) of every frame up to where its session stops."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gate, out = Gate(cfg), []
        for r in pdf.sort_values("frame_idx").itertuples(index=False):
            said = gate.decide(r.stream_time, r.sharpness, r.signature, bool(r.has_face))
            if said is None:
                break
            out.append((r.session, r.frame_idx, said, gate.saved - 1 if said == "kept" else None))
        return pd.DataFrame(out, columns=["session", "frame_idx", "decision", "saved_idx"]).astype({"saved_idx": "Int32"})

    return frames.select("session", "frame_idx", "stream_time", "sharpness", "signature", "has_face").groupBy("session").applyInPandas(run, OUT)


def kept_by_interval(frames: DataFrame, session: str, time: str, order: str, interval: float) -> DataFrame:
    """(session, order, time) of the frames kept by the interval alone, by built-in functions: a fold over each session's
    sorted times."""
    rows = frames.groupBy(F.col(session).alias("session")).agg(F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.col(order).alias("o")))).alias("s"))
    state = F.struct(F.lit(float("-inf")).alias("last"), F.array().cast("array<struct<t:double,o:bigint>>").alias("kept"))

    def step(acc, x):
        keep = x["t"] - acc["last"] >= interval
        return F.struct(F.when(keep, x["t"]).otherwise(acc["last"]).alias("last"), F.when(keep, F.concat(acc["kept"], F.array(F.struct(x["t"].alias("t"), x["o"].cast("bigint").alias("o"))))).otherwise(acc["kept"]).alias("kept"))

    return rows.select("session", F.explode(F.aggregate("s", state, step)["kept"]).alias("k")).select("session", F.col("k.o").alias(order), F.col("k.t").alias(time))


def counters(decisions: DataFrame) -> DataFrame:
    """A row a session: seen, saved and what was turned down, by reason."""
    n = lambda d: F.count_if(F.col("decision") == d)
    return decisions.groupBy("session").agg(
        F.count("*").alias("frames_seen"), n("kept").alias("frames_saved"), n("interval").alias("skipped_interval"), n("blurry").alias("skipped_blurry"), n("unchanged").alias("skipped_unchanged"), n("no_face").alias("skipped_no_face")
    )


def file_names(decisions: DataFrame) -> DataFrame:
    """(session, frame_idx, file) of the kept frames, numbered as they were saved."""
    return decisions.filter("decision = 'kept'").select("session", "frame_idx", F.format_string("%06d.jpg", "saved_idx").alias("file"))


def with_faces(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """The frames with one detection or more."""
    return frames.join(detections.select("session", "frame_idx"), ["session", "frame_idx"], "left_semi")


def strided(frames: DataFrame, stride: int) -> DataFrame:
    return frames.filter(F.col("frame_idx") % max(1, stride) == 0)
