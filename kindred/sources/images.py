"""Images and frames as rows, and what is measured on their pixels in Arrow batches.

Decoders and embedders are passed in: a function from bytes to an array of height, width and three colours, blue first;
and one from such an array to detections. A file that can't be decoded is a row of the rejected side."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.tables import numbered

IMAGES = ("jpg", "jpeg", "png", "bmp", "webp")
VIDEOS = ("mp4", "avi", "mkv", "mov", "m4v", "webm", "ts")
DETECTION = "source string, frame_idx int, det_score double, bbox struct<x1:double,y1:double,x2:double,y2:double>, landmarks array<struct<x:double,y:double>>, embedding array<float>, blur_var double"


def listed(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = IMAGES) -> DataFrame:
    """(path, frame_idx, content) of all files below ``folder`` with a suffix in any case; frame_idx is the place in the
    order of paths. Raises FileNotFoundError where there is none. Contents are read only where they are used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    own = files.filter(F.lower("path").rlike(r"\.(" + "|".join(suffixes) + ")$"))
    # Paths alone are numbered; contents are joined to them.
    paths = own.select("path")
    if paths.isEmpty():
        raise FileNotFoundError(f"no {'/'.join(suffixes)} files in {folder}")
    order = numbered(paths, "frame_idx", "path").withColumn("frame_idx", F.col("frame_idx").cast("int"))
    return own.join(order, "path").select("path", "frame_idx", "content")


def raw_decoder(content: bytes) -> np.ndarray | None:
    """Uncompressed 24-bit BMP files; None for anything else."""
    if len(content) < 54 or content[:2] != b"BM" or int.from_bytes(content[28:30], "little") != 24 or int.from_bytes(content[30:34], "little"):
        return None
    start, width, height = (int.from_bytes(content[a : a + 4], "little", signed=True) for a in (10, 18, 22))
    row = (width * 3 + 3) // 4 * 4
    if width <= 0 or not height or len(content) < start + row * abs(height):
        return None
    lines = np.frombuffer(content, np.uint8, row * abs(height), start).reshape(abs(height), row)[:, : width * 3]
    return (lines[::-1] if height > 0 else lines).reshape(abs(height), width, 3)


def grey(image: np.ndarray) -> np.ndarray:
    image = np.asarray(image, np.float64)
    return image if image.ndim == 2 else image[..., 0] * 0.114 + image[..., 1] * 0.587 + image[..., 2] * 0.299


def sharpness(image: np.ndarray) -> float:
    """The variance of the Laplacian of the grey image, its border mirrored."""
    g = np.pad(np.rint(grey(image)), 1, mode="reflect")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def signature(image: np.ndarray, side: int = 64) -> np.ndarray:
    """The grey image at ``side`` by ``side``, by bilinear interpolation at pixel centres."""
    g = grey(image)

    def at(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.clip((np.arange(side) + 0.5) * n / side - 0.5, 0, n - 1)
        low = np.floor(x).astype(int)
        return low, np.minimum(low + 1, n - 1), x - low

    (y0, y1, fy), (x0, x1, fx) = at(g.shape[0]), at(g.shape[1])
    top = g[y0][:, x0] * (1 - fx) + g[y0][:, x1] * fx
    low = g[y1][:, x0] * (1 - fx) + g[y1][:, x1] * fx
    return (top * (1 - fy)[:, None] + low * fy[:, None]).ravel()


Decoder = Callable[[bytes], np.ndarray | None]
Embedder = Callable[[np.ndarray, str, int], list[dict]]


def measured(files: DataFrame, decode: Decoder = raw_decoder) -> DataFrame:
    """(path, frame_idx, ok, sharpness, signature) of listed files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, k, content in f[["path", "frame_idx", "content"]].itertuples(index=False):
                image = decode(content)
                rows.append((path, k, image is not None, None if image is None else sharpness(image), None if image is None else signature(image).tolist()))
            yield pd.DataFrame(rows, columns=["path", "frame_idx", "ok", "sharpness", "signature"], dtype=object)

    return files.select("path", "frame_idx", "content").mapInPandas(run, "path string, frame_idx int, ok boolean, sharpness double, signature array<double>")


def detections(files: DataFrame, embed: Embedder, decode: Decoder = raw_decoder, encode: Callable[[np.ndarray], bytes] | None = None) -> DataFrame:
    """The detections on listed files: what ``embed`` finds on each, ``place`` counting them within a file. Pixels stay in
    the batch; where ``encode`` is given, each detection keeps its crop, encoded."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, k, content in f[["path", "frame_idx", "content"]].itertuples(index=False):
                image = decode(content)
                for place, d in enumerate(embed(image, path, int(k)) if image is not None else []):
                    x1, y1, x2, y2 = d["bbox"]
                    box = image[max(0, int(y1)) : max(0, int(y2)), max(0, int(x1)) : max(0, int(x2))]
                    marks = d.get("landmarks")
                    rows.append((path, int(k), float(d["det_score"]), dict(x1=float(x1), y1=float(y1), x2=float(x2), y2=float(y2)), None if marks is None else [dict(x=float(a), y=float(b)) for a, b in marks], np.asarray(d["embedding"], np.float32).tolist(), sharpness(box) if box.size else None, place, encode(box) if encode and box.size else None))
            yield pd.DataFrame(rows, columns=["source", "frame_idx", "det_score", "bbox", "landmarks", "embedding", "blur_var", "place", "crop"], dtype=object)

    return files.select("path", "frame_idx", "content").mapInPandas(run, f"{DETECTION}, place int, crop binary")


def upload_status(uploads: DataFrame, decode: Decoder = raw_decoder) -> DataFrame:
    """(id, status) of uploaded bytes: 200, or 422 where they are empty or can't be decoded."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "status": [200 if c and decode(c) is not None else 422 for c in f["content"]]})

    return uploads.select("id", "content").mapInPandas(run, "id long, status int")


def camera(name: str) -> int | str:
    """A number is a device, anything else an address."""
    return int(name) if name.isdigit() else name


def cameras(name: Column) -> Column:
    """The same for a column: struct(device int, address string), one of them null."""
    number = name.rlike("^[0-9]+$")
    return F.struct(F.when(number, name.cast("int")).alias("device"), F.when(~number, name).alias("address"))
