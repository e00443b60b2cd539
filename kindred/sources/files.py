"""Small files that jobs leave behind: summaries, crops, montages. Written through the file system that Spark uses."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import reports
from kindred.sources.images import Decoder, raw_decoder

Encoder = Callable[[np.ndarray], bytes]


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(content))
    out.close()


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes rows (file, content) below ``folder``; they pass through the driver one partition at a time."""
    n = 0
    for r in rows.select("file", "content").toLocalIterator():
        write_bytes(rows.sparkSession, f"{folder}/{r['file']}", r["content"])
        n += 1
    return n


def write_summary(faces: DataFrame, path: str, **extra) -> dict:
    """The run's summary as JSON: totals, a part a person, and ``extra``, which overrides."""
    people = {r["person"]: {"faces": r["faces"], "sources": r["sources"], "mean_quality": r["mean_quality"]} for r in reports.run_summary(faces).toLocalIterator()}
    out = {**reports.run_totals(faces).first().asDict(), "persons": people, **extra}
    write_bytes(faces.sparkSession, path, json.dumps(out, ensure_ascii=False, indent=2).encode())
    return out


def bmp(image: np.ndarray) -> bytes:
    """An image of three colours, blue first, as an uncompressed file."""
    h, w = image.shape[:2]
    lines = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    lines[:, : w * 3] = image[::-1].reshape(h, w * 3)
    size = 54 + lines.size
    head = b"BM" + size.to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + b"\x01\0\x18\0"
    return head + bytes(24) + lines.tobytes()


def resized(image: np.ndarray, side: int) -> np.ndarray:
    """Nearest pixels of an image at ``side`` by ``side``."""
    y, x = ((np.arange(side) + 0.5) * n / side for n in image.shape[:2])
    return image[y.astype(int)][:, x.astype(int)]


def crops(faces: DataFrame, most: int = 40) -> DataFrame:
    """(file, content) of the crops to show: ``faces`` has id, person_id, quality, frame_idx, crop (an encoded image)."""
    shown = reports.crops(faces.withColumn("has_crop", F.col("crop").isNotNull()), most)
    return shown.join(faces.select("id", "crop"), "id").select(F.concat_ws("/", "person", "file").alias("file"), F.col("crop").alias("content"))


def montages(faces: DataFrame, decode: Decoder = raw_decoder, encode: Encoder = bmp, columns: int = 8, tile: int = 112) -> DataFrame:
    """(file, content): a picture a person of its first crops, row by row. A person has ``columns`` * 4 of them at most."""
    shown = reports.crops(faces.withColumn("has_crop", F.col("crop").isNotNull()), columns * 4)
    placed = reports.montage(shown, columns, 4, tile).join(faces.select("id", "crop"), "id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = np.zeros((int(pdf["y"].max()) + tile, min(len(pdf), columns) * tile, 3), np.uint8)
        for x, y, crop in pdf[["x", "y", "crop"]].itertuples(index=False):
            image = decode(crop)
            if image is not None:
                whole[y : y + tile, x : x + tile] = resized(image, tile)
        return pd.DataFrame([(f"{pdf['person'].iat[0]}.bmp", encode(whole))], columns=["file", "content"])

    return placed.groupBy("person").applyInPandas(run, "file string, content binary")


Reader = Callable[[str], Iterator[np.ndarray]]


def video_frames(files: DataFrame, read: Reader, stride: int, embed: Callable[[np.ndarray, str, int], list[dict]]) -> DataFrame:
    """(source, frame_idx, failed, detections) of each ``stride``-th frame of listed videos (path), counted from 0.

    ``read`` gives a video's frames. A video that can't be read is one row with ``failed`` set, and the others go on. A
    frame without detections is a row too, as trackers count it."""
    kind = "source string, frame_idx int, failed boolean, detections array<struct<det_score:double,bbox:struct<x1:double,y1:double,x2:double,y2:double>,embedding:array<float>>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path in f["path"]:
                rows = []
                try:
                    for k, image in enumerate(read(path)):
                        if k % max(1, stride) == 0:
                            found = [{"det_score": float(d["det_score"]), "bbox": dict(zip(("x1", "y1", "x2", "y2"), map(float, d["bbox"]), strict=True)), "embedding": np.asarray(d["embedding"], np.float32).tolist()} for d in embed(image, path, k)]
                            rows.append((path, k, False, found))
                        if len(rows) >= 200:
                            yield pd.DataFrame(rows, columns=["source", "frame_idx", "failed", "detections"])
                            rows = []
                except OSError:
                    rows.append((path, None, True, []))
                yield pd.DataFrame(rows, columns=["source", "frame_idx", "failed", "detections"], dtype=object)

    return files.select("path").repartition("path").mapInPandas(run, kind)


def detections_of(frames: DataFrame) -> DataFrame:
    """Rows for trackers from :func:`video_frames`: an id a detection, and a null one for a frame without."""
    rows = frames.filter("NOT failed").select("source", "frame_idx", F.posexplode_outer("detections").alias("k", "d"))
    number = F.when(F.col("k").isNotNull(), F.col("frame_idx").cast("long") * 1000 + F.col("k"))
    return rows.select("source", "frame_idx", number.alias("id"), F.col("d.bbox").alias("bbox"), F.col("d.embedding").cast("array<double>").alias("embedding"), F.coalesce("d.det_score", F.lit(0.0)).alias("quality"))
