"""Streams give what batches give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.config import Acquisition, Clustering, Config, Tracker
from kindred.operators import acquisition, tracking
from kindred.plans.jobs import Engine
from kindred.streaming import live


def run(df, tmp_path, name, spark):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_gate_stream(spark, tmp_path):
    rows = [(f"s{k % 3}", k // 3 + 1, (k // 3 + 1) / 10, 100.0, [float(k)] * 4, True) for k in range(60)]
    schema = "session string, frame_idx long, stream_time double, sharpness double, signature array<double>, has_face boolean"
    cfg = Acquisition(interval_seconds=0.5, min_change_fraction=0.0)
    for part in range(3):
        spark.createDataFrame([r for r in rows if (r[1] - 1) // 7 == part], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = run(live.gated(stream, cfg), tmp_path, "gate", spark)
    expected = acquisition.decided(spark.createDataFrame(rows, schema), cfg)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_track_stream(spark, tmp_path):
    rows = [(s, f, 10 * f + k, (100.0 * k + f, 0.0, 100.0 * k + f + 10, 10.0), [float(k), 1.0 - k], 0.5) for s in ("a", "b") for f in range(6) for k in range(2)]
    schema = "source string, frame_idx int, id long, bbox struct<x1:double,y1:double,x2:double,y2:double>, embedding array<double>, quality double"
    for part in range(2):
        spark.createDataFrame([r for r in rows if r[1] // 3 == part], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = run(live.tracked(stream, Tracker()), tmp_path, "tracks", spark)
    expected = tracking.assigned(spark.createDataFrame(rows, schema), Tracker())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_live(spark, tmp_path, identities):
    x, _ = identities
    cfg = Config(clustering=Clustering(algorithm="dbscan", min_cluster_size=4))
    cfg.output.db_path, cfg.prototypes.path, cfg.output.dir = str(tmp_path / "faces"), str(tmp_path / "prototypes"), str(tmp_path / "out")
    e = Engine(spark, cfg)
    job = live.Live(e, every=8)
    schema = "id long, source string, frame_idx int, embedding array<double>"
    job(spark.createDataFrame([(i, "cam", i, [float(v) for v in x[i]]) for i in range(8)], schema), 0)
    assert e.prototypes.read().count() == 1 and e.faces.read().filter("person_id = 'person_0000'").count() == 8
    job(spark.createDataFrame([(i, "cam", i, [float(v) for v in x[i]]) for i in (8, 9, 39)], schema), 1)
    assert e.faces.read().filter("person_id = 'person_0000'").count() == 10 and e.faces.read().filter(F.col("person_id").isNull()).count() == 1
    assert np.linalg.norm(e.prototypes.read().first()["vector"]) > 0.999
    # A batch that comes again changes nothing, also where only the prototypes had been written.
    counts = lambda: sorted((r["person_id"], r["count"]) for r in e.prototypes.read().collect())
    before, batch = counts(), spark.createDataFrame([(i, "cam", i, [float(v) for v in x[i]]) for i in (10, 11)], schema)
    job(spark.createDataFrame([(8, "cam", 8, [0.0] * 512)], schema), 1)
    assert counts() == before and e.faces.read().count() == 11
    add, e.faces.add = e.faces.add, lambda *a, **b: 1 / 0
    with pytest.raises(ZeroDivisionError):
        job(batch, 2)
    e.faces.add = add
    job(batch, 2)
    assert counts() == [(p, n + 2) for p, n in before] and e.faces.read().count() == 13
    # Frames without faces count towards the next clustering.
    frames = e.faces.meta()["frames"]
    job(spark.createDataFrame([(None, "cam", 50, None), (None, "cam", 51, None)], schema), 3)
    assert e.faces.meta()["frames"] == frames + 2 and e.faces.read().count() == 13


def test_ended_tracks(spark, tmp_path):
    rows = [(s, f, 10 * f + k, (100.0 * k + f, 0.0, 100.0 * k + f + 10, 10.0), [float(k), 1.0 - k], 0.5) for s in ("a", "b") for f in range(6) for k in range(2)]
    schema = "source string, frame_idx int, id long, bbox struct<x1:double,y1:double,x2:double,y2:double>, embedding array<double>, quality double"
    for part in range(2):
        spark.createDataFrame([r for r in rows if r[1] // 3 == part], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    spark.createDataFrame([(s, None, None, None, None, None) for s in "ab"], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "p2"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = run(live.ended_tracks(stream, Tracker()), tmp_path, "ended", spark)
    expected = tracking.tracks(spark.createDataFrame(rows, schema), Tracker())
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect())) and got.count() == 4
