"""Session manifests: nested JSON, one a session."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "session string, label string, source string, frames_saved long, frames_seen long, duration_seconds double, frames array<struct<file:string,frame_idx:long,stream_time:double,sharpness:double>>, settings map<string,string>"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return bool(found)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row a session below ``folder``; manifests that can't be read are left out, missing fields get their defaults."""
    if not _exists(spark, f"{folder}/*/manifest.json"):
        return spark.createDataFrame([], f"path string, {SCHEMA}")
    rows = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{folder}/*/manifest.json")
    named = rows.withColumn("path", F.col("_metadata.file_path"))
    folder_name = F.element_at(F.split("path", "/"), -2)
    return named.select("path", F.coalesce("session", folder_name).alias("session"), "label", "source", F.coalesce("frames_saved", F.lit(0)).alias("frames_saved"), "frames_seen", F.coalesce("duration_seconds", F.lit(0.0)).alias("duration_seconds"), "frames", "settings")


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """One row: sessions, frames saved by their manifests, and images on disk (.jpg and .png, as written)."""
    sessions = read(spark, folder).agg(F.count("*").alias("sessions"), F.coalesce(F.sum("frames_saved"), F.lit(0)).alias("frames_saved"))
    if _exists(spark, folder):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
        images = files.filter(F.col("path").rlike(r"\.(jpg|png)$")).agg(F.count("*").alias("images"))
    else:
        images = spark.range(1).select(F.lit(0).cast("long").alias("images"))
    return sessions.crossJoin(images)


def write(spark: SparkSession, folder: str, session: str, manifest: dict) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{session}/manifest.json")
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(json.dumps(manifest, ensure_ascii=False, indent=2).encode()))
    out.close()
