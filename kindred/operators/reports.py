"""What a run reports: sizes by cluster and person, crops to show, places in a montage, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The folder of noise and the file names of crops.
NOISE, CROP = "_noise", "%04d_q%.2f_f%d.jpg"
BUCKETS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


def cluster_summary(faces: DataFrame) -> DataFrame:
    return faces.filter("cluster_id IS NOT NULL AND cluster_id >= 0").groupBy("cluster_id", "person_id").agg(F.count("*").alias("n"))


def person_counts(faces: DataFrame) -> DataFrame:
    return faces.filter("person_id IS NOT NULL").groupBy("person_id").agg(F.count("*").alias("faces"))


def persons(prototypes: DataFrame, faces: DataFrame) -> DataFrame:
    """person_id, label, count, stored faces (0 where there is none) and times of every prototype."""
    return prototypes.join(person_counts(faces), "person_id", "left").select("person_id", "label", "count", F.coalesce("faces", F.lit(0).cast("long")).alias("faces"), "created_at", "updated_at")


def person_faces(faces: DataFrame, person_id: str) -> DataFrame:
    """One row: how many faces of a person are stored."""
    return faces.filter(F.col("person_id") == person_id).agg(F.count("*").alias("faces"))


def run_summary(faces: DataFrame, digits: int = 3) -> DataFrame:
    """A row a person or noise: faces, sorted distinct sources, mean quality."""
    return faces.groupBy(F.coalesce("person_id", F.lit(NOISE)).alias("person")).agg(F.count("*").alias("faces"), F.sort_array(F.collect_set("source")).alias("sources"), F.bround(F.avg("quality"), digits).alias("mean_quality"))


def run_totals(faces: DataFrame) -> DataFrame:
    return faces.agg(F.count("*").alias("total_faces"), F.count_distinct("person_id").alias("identities"), F.count_if(F.col("person_id").isNull()).alias("noise_faces"))


def crops(faces: DataFrame, most: int = 40) -> DataFrame:
    """The first ``most`` faces of each person that have a crop, with their file names."""
    person = F.coalesce("person_id", F.lit(NOISE))
    n = F.row_number().over(Window.partitionBy("person").orderBy("id"))
    ranked = faces.filter("has_crop").withColumn("person", person).withColumn("n", n - 1).filter(F.col("n") < most)
    return ranked.select("id", "person", F.col("n").cast("int").alias("n"), F.format_string(CROP, "n", "quality", "frame_idx").alias("file"))


def montage(shown: DataFrame, columns: int = 8, rows: int = 4, tile: int = 112) -> DataFrame:
    """Where each crop stands in its person's montage."""
    return shown.filter(F.col("n") < columns * rows).select("id", "person", (F.floor(F.col("n") / columns) * tile).cast("int").alias("y"), ((F.col("n") % columns) * tile).cast("int").alias("x"))


def histogram(rows: DataFrame, column: str, bounds: list[float] = BUCKETS) -> DataFrame:
    """One row a bound: how many values are no larger, and last how many there are."""
    counted = rows.agg(*(F.count_if(F.col(column) <= b).alias(f"b{k}") for k, b in enumerate(bounds)), F.count(column).alias("all"))
    entries = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)]
    return counted.select(F.explode(F.array(*entries, F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))).alias("r")).select("r.*")


def trainable(faces: DataFrame, least: int) -> DataFrame:
    """(person_id, n) of persons with ``least`` faces or more."""
    return person_counts(faces).filter(F.col("faces") >= least).select("person_id", F.col("faces").alias("n"))
