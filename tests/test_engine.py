"""Operators on fixtures with known answers."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred import config
from kindred.config import Acquisition, Classifier, Clustering, Config, Prototypes, Quality, Schedule, Tracker
from kindred.functions import clock
from kindred.functions import vectors as V
from kindred.operators import acquisition, classifier, clustering, graphs, identity, neighbors, quality, tracking, trees
from kindred.plans import schedule
from kindred.plans.jobs import Engine
from kindred.sources import images, manifests
from kindred.sources.store import FaceStore


def rows_of(spark, x, truth=None):
    return spark.createDataFrame([(i, [float(v) for v in r], int(truth[i]) if truth is not None else -1) for i, r in enumerate(x)], "id long, embedding array<float>, cluster_id int")


def test_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>").select(V.l2_normalize(F.col("a")).alias("a"), V.l2_normalize(F.col("z")).alias("z"), V.chord(F.lit(1.2)).alias("c"), V.change_fraction(F.col("a"), F.lit([16.0, 4.0])).alias("d")).first()
    assert r["a"] == pytest.approx([0.6, 0.8], abs=1e-7) and r["z"] == [0, 0] and r["c"] == 0 and r["d"] == 0.5


def test_boxes(spark):
    b = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("x1", "y1", "x2", "y2"), strict=True)))
    r = spark.range(1).select(V.iou(b(0, 0, 2, 2), b(0, 0, 2, 2)).alias("same"), V.iou(b(0, 0, 2, 2), b(3, 3, 4, 4)).alias("none"), V.iou(b(0, 0, 2, 2), b(1, 0, 3, 2)).alias("half")).first()
    assert round(r["same"], 6) == 1 and r["none"] == 0 and 0 < r["half"] < 1


def test_quality(spark):
    marks = "array<struct<x:double,y:double>>"
    front, side = [(10.0, 50.0), (90.0, 50.0), (50.0, 60.0)], [(10.0, 50.0), (90.0, 50.0), (85.0, 60.0)]
    box = lambda s: (0.0, 0.0, float(s), float(s))
    faces = spark.createDataFrame(
        [(0, 0.9, box(100), 500.0, front), (1, 0.9, box(100), 0.0, front), (2, 0.9, box(30), 500.0, front), (3, 0.4, box(100), 500.0, None), (4, 0.9, box(100), 500.0, side), (5, 0.9, box(100), None, None)],
        f"id int, det_score double, bbox struct<x1:double,y1:double,x2:double,y2:double>, blur_var double, landmarks {marks}",
    )
    got = {r["id"]: r for r in quality.assessed(faces, Quality()).collect()}
    assert got[0]["ok"] and got[0]["quality"] > 0.5 and got[5]["ok"]
    assert [got[k]["reasons"][0].split("(")[0] for k in (1, 2, 3, 4)] == ["blurry", "too_small", "low_det_score", "profile"]
    assert got[4]["reasons"] == ["profile(asym=15.0)"]
    assert quality.assessed(faces, Quality(enabled=False)).filter("ok AND quality = 1").count() == 6


@pytest.mark.parametrize("name", ["hdbscan", "dbscan", "agglomerative"])
def test_clusters(spark, identities, name):
    x, truth = identities
    out = clustering.clustered(rows_of(spark, x), Clustering(algorithm=name))
    got = {r["id"]: r["cluster_id"] for r in out.collect()}
    assert len({c for c in got.values() if c >= 0}) == 3
    assert all(len({got[i] for i in np.flatnonzero(truth == k).tolist()}) == 1 for k in range(3))
    assert all(got[i] == -1 for i in range(36, 40))


def test_clusters_of_few_and_none(spark):
    few = rows_of(spark, np.eye(3, 8))
    assert [r["cluster_id"] for r in clustering.clustered(few, Clustering(min_cluster_size=5)).collect()] == [-1] * 3
    for name in ("hdbscan", "dbscan", "agglomerative"):
        assert clustering.clustered(few.filter("false"), Clustering(algorithm=name)).count() == 0
    with pytest.raises(ValueError):
        clustering.clustered(few, Clustering(algorithm="other"))


def test_average_linkage_splits_into_components():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    whole = trees.average_labels(x, 0.4)
    d = 1 - x @ x.T
    for k in set(whole.tolist()):
        for j in set(whole.tolist()) - {k}:
            assert d[np.ix_(whole == k, whole == j)].mean() >= 0.4 - 1e-12


def test_reattach(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=512) / 22.6
    x = [base + rng.normal(0, 0.02, 512) for _ in range(6)] + [base + rng.normal(0, 0.05, 512)]
    x = np.array([v / np.linalg.norm(v) for v in x])
    rows = rows_of(spark, x, [0] * 6 + [-1])
    out = clustering.reattach_noise(rows, clustering.centroids(rows), 0.45 if float(x[6] @ x[0]) > 0.55 else 0.8)
    assert out.filter("id = 6").first()["cluster_id"] == 0


def test_prototypes_learn_and_persist(spark, identities):
    x, _ = identities
    centers = spark.createDataFrame([(k, [float(v) for v in x[k * 12]], n) for k, n in ((0, 5), (1, 8))], "cluster_id int, vector array<double>, n long")
    nothing = rows_of(spark, x).filter("false")
    first = identity.absorb(centers, nothing, identity.none(spark), Prototypes(), 0, 1.0).cache()
    assert {r["key"]: r["person_id"] for r in first.filter("kind = 'cluster'").collect()} == {0: "person_0000", 1: "person_0001"}
    known = identity.prototypes_of(first)
    assert {r["person_id"]: r["count"] for r in known.collect()} == {"person_0000": 5, "person_0001": 8}
    noise = rows_of(spark, x).filter("id IN (1, 39)")
    again = identity.absorb(centers, noise, known, Prototypes(ema_alpha=0.5), 2, 2.0).cache()
    assert {r["key"]: r["person_id"] for r in again.filter("kind = 'noise'").collect()} == {1: "person_0000", 39: None}
    after = {r["person_id"]: r for r in identity.prototypes_of(again).collect()}
    assert after["person_0000"]["count"] == 7 and np.linalg.norm(after["person_0000"]["vector"]) == pytest.approx(1, abs=1e-5)
    moved = identity.updated(known, "person_0000", [float(v) for v in x[3]], 0.5, 3.0).filter("person_id = 'person_0000'").first()
    assert np.dot(moved["vector"], x[3]) > np.dot(x[0], x[3])
    with pytest.raises(KeyError):
        identity.updated(known, "person_9999", [0.0], 0.5, 3.0)


def test_tracker():
    t = tracking.Tracks(Tracker(min_hits=2, max_age=3))
    v = np.eye(2)
    for f in range(5):
        t.frame(f, [2 * f, 2 * f + 1], np.array([[f, 0, f + 10, 10], [100 + f, 0, 110 + f, 10]], float), v, [0.5, 0.5])
    assert sorted(x.hits for x in t.flush()) == [5, 5]
    t = tracking.Tracks(Tracker(min_hits=1, max_age=5))
    a, _ = t.frame(0, [0], np.array([[0, 0, 9, 9]], float), v[:1], [1.0])
    b, _ = t.frame(1, [1], np.array([[500, 0, 509, 9]], float), v[:1], [1.0])
    assert a == b
    t, ended = tracking.Tracks(Tracker(min_hits=1, max_age=2)), []
    t.frame(0, [0], np.array([[0, 0, 9, 9]], float), v[:1], [1.0])
    for f in range(1, 5):
        ended += t.frame(f, [], np.zeros((0, 4)), np.zeros((0, 2)), [])[1]
    assert not t.active and len(ended) == 1


def test_tracks_of_sources(spark):
    rows = [(s, f, 10 * f + k, (10.0 * k * 10 + f, 0.0, 10.0 * k * 10 + f + 10, 10.0), [1.0, 0.0] if k else [0.0, 1.0], 0.5) for s in ("a", "b") for f in range(4) for k in range(2)]
    df = spark.createDataFrame(rows, "source string, frame_idx int, id long, bbox struct<x1:double,y1:double,x2:double,y2:double>, embedding array<double>, quality double")
    assert tracking.assigned(df, Tracker()).groupBy("source", "track_id").count().filter("count = 4").count() == 4
    assert tracking.tracks(df, Tracker()).filter("hits = 4 AND n_frames = 4").count() == 4


@pytest.mark.parametrize(
    ("cfg", "n", "signs", "sharp", "expected"),
    [
        (dict(interval_seconds=1, min_change_fraction=0), 30, None, None, {"kept": 3, "interval": 27}),
        (dict(interval_seconds=0, min_blur_variance=45, min_change_fraction=0), 4, None, [90, 0, 0, 90], {"kept": 2, "blurry": 2}),
        (dict(interval_seconds=0, min_change_fraction=0.02), 4, [0, 0, 0, 99], None, {"kept": 2, "unchanged": 2}),
        (dict(interval_seconds=0, min_change_fraction=0, max_frames=5), 20, None, None, {"kept": 5}),
        (dict(interval_seconds=0, min_change_fraction=0, max_duration_seconds=1), 30, None, None, {"kept": 9, "stop": 1}),
    ],
)
def test_gate(spark, cfg, n, signs, sharp, expected):
    rows = [("s", k + 1, (k + 1) / 10, float(sharp[k]) if sharp else 100.0, [float(signs[k] if signs else k)] * 4, True) for k in range(n)]
    df = spark.createDataFrame(rows, "session string, frame_idx long, stream_time double, sharpness double, signature array<double>, has_face boolean")
    got = {r["decision"]: r["count"] for r in acquisition.decided(df, Acquisition(**cfg)).groupBy("decision").count().collect()}
    assert got == expected


def test_clock(spark):
    for text in ("7", "25:00", "abc", "", None):
        with pytest.raises(ValueError):
            clock.parse_hhmm(text)
    times = {"06:59": False, "07:00": True, "11:30": True, "14:59": True, "15:00": False}
    for t, expected in times.items():
        now = datetime.fromisoformat(f"2026-07-01T{t}:00")
        assert schedule.capturing(now, Schedule()) is expected
        r = spark.sql(f"SELECT timestamp'2026-07-01 {t}:00' t").select(clock.in_window(F.col("t"), "07:00", "15:00").alias("x"), clock.in_window(F.col("t"), "08:00", "08:00").alias("e")).first()
        assert r["x"] is expected and r["e"] is False
    night = Schedule(capture_start="22:00", capture_end="06:00")
    assert schedule.capturing(datetime(2026, 7, 1, 23, 30), night) and schedule.capturing(datetime(2026, 7, 1, 3), night)
    assert not schedule.capturing(datetime(2026, 7, 1, 12), night)


def test_supervisor(spark, tmp_path):
    now = [datetime(2026, 7, 1, 8)]
    seen: list = []

    def capture(seconds):
        seen.append(seconds)
        now[0] = datetime(2026, 7, 1, 16)

    fails = [True]

    def analyze():
        if fails and fails.pop():
            raise RuntimeError("no model")
        return {"faces": 1}

    s = schedule.Supervisor(Schedule(), schedule.State(spark, str(tmp_path / "state.json")), capture, analyze, lambda: now[0], lambda _: None)
    assert s.run(4) == ["capture", "analysis_failed", "analysis", "wait"] and seen == [3600]
    assert s.status()["last_analysis_summary"] == {"faces": 1}


def test_classifier(spark, identities):
    x, truth = identities
    named = rows_of(spark, x, truth).filter("cluster_id >= 0").withColumn("person_id", F.format_string("p%d", "cluster_id"))
    model, report = classifier.fit(named, Classifier(max_iter=30))
    assert report.trained and report.classes == ["p0", "p1", "p2"] and report.n_samples == 36
    got = classifier.verdicts(model, named, 0.75).join(named.select("id", F.col("person_id").alias("is_")), "id")
    assert got.filter("person_id = is_").count() == 36
    assert classifier.verdicts(model, named, 1.1).filter("person_id IS NOT NULL").count() == 0
    none, why = classifier.fit(named.filter("cluster_id = 0"), Classifier())
    assert none is None and not why.trained and why.reason
    with pytest.raises(ValueError):
        classifier.fit(named, Classifier(model="svm"))


def test_store(spark, tmp_path):
    store = FaceStore(spark, str(tmp_path / "faces"))
    rows = spark.createDataFrame([(i, "s", i, [1.0, 0.0], c, p) for i, (c, p) in enumerate([(0, "p0"), (0, "p0"), (1, "p1"), (1, "p1"), (-1, None)])], "id long, source string, frame_idx int, embedding array<float>, cluster_id int, person_id string")
    store.add(rows, 1.0)
    assert sorted(r["id"] for r in store.read().collect()) == [1, 2, 3, 4, 5] and store.labelled().count() == 4
    store.assign(store.read().select("id", F.lit(2).alias("cluster_id"), F.lit("px").alias("person_id")))
    assert store.read().filter("cluster_id = 2 AND person_id = 'px'").count() == 5
    assert store.clear() == 5 and store.clear() == 0
    store.add(rows.limit(1), 1.0)
    assert store.read().count() == 1


def bmp(colour):
    width, height = 64, 48
    line = bytes(colour) * width
    line += b"\0" * (-len(line) % 4)
    head = b"BM" + (54 + len(line) * height).to_bytes(4, "little") + b"\0" * 4 + (54).to_bytes(4, "little")
    return head + (40).to_bytes(4, "little") + width.to_bytes(4, "little") + height.to_bytes(4, "little") + b"\x01\0\x18\0" + b"\0" * 24 + line * height


def test_images_end_to_end(spark, tmp_path, identities):
    x, _ = identities
    for k in range(12):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k:02d}.BMP").write_bytes(bmp((k // 4, 0, 0)) if k < 11 else b"BMbroken")
    vectors = [x[0], x[12], x[24]]

    def embed(image, path, frame):
        v = vectors[int(image[0, 0, 0])]
        return [{"bbox": (0, 0, 64, 48), "det_score": 0.9, "embedding": v}]

    cfg = Config(quality=Quality(enabled=False), clustering=Clustering(algorithm="dbscan", min_cluster_size=3))
    cfg.output.db_path, cfg.prototypes.path = str(tmp_path / "faces"), str(tmp_path / "prototypes")
    cfg.output.dir, cfg.api.embedding_dim = str(tmp_path / "out"), 512
    e = Engine(spark, cfg)
    first = e.images(str(tmp_path / "in"), embed)
    assert first["total_faces"] == 11 and first["identities"] == 3 and first["noise_faces"] == 0
    before = {r["person_id"] for r in e.prototypes.read().collect()}
    assert e.images(str(tmp_path / "in"), embed, reset=True)["identities"] == 3
    assert {r["person_id"] for r in e.prototypes.read().collect()} == before == {"person_0000", "person_0001", "person_0002"}
    assert e.recluster()["identities"] == 3 and e.faces.read().count() == 11
    asked = spark.createDataFrame([(1, [float(v) * 17.5 for v in x[1]]), (2, [float(v) for v in x[39]]), (3, [1.0]), (4, [0.0] * 512), (5, [float("nan")] * 512)], "id long, embedding array<double>")
    got = {r["id"]: r for r in e.identify(asked).collect()}
    assert got[1]["status"] == 200 and got[1]["source"] == "prototype" and got[1]["score"] > 0.7 and got[2]["source"] == "unknown"
    assert [got[k]["status"] for k in (3, 4, 5)] == [422] * 3
    e.rename("person_0000", "Ada")
    assert e.persons_table().filter("label = 'Ada'").count() == 1
    e.delete("person_0002")
    assert e.prototypes.read().count() == 2 and e.prototypes.next_number() == 3
    assert e.clusters().count() == 3 and e.metrics().filter("metric = 'faces_detected_total' AND value = 22").count() == 1
    with pytest.raises(FileNotFoundError):
        images.listed(spark, str(tmp_path / "faces"))


def small_engine(spark, tmp_path, **more):
    cfg = Config(quality=Quality(enabled=False), clustering=Clustering(algorithm="dbscan", min_cluster_size=4), **more)
    cfg.output.db_path, cfg.prototypes.path, cfg.output.dir = str(tmp_path / "faces"), str(tmp_path / "prototypes"), str(tmp_path / "out")
    cfg.classifier.path = str(tmp_path / "classifier")
    return Engine(spark, cfg)


def test_numbers_go_on_beyond_9999(spark, tmp_path, identities):
    x, truth = identities
    e = small_engine(spark, tmp_path)
    e.prototypes.write(identity.none(spark), next_number=9999)
    e.clustered(rows_of(spark, x, truth).select("id", "embedding", F.lit("s").alias("source"), F.col("id").cast("int").alias("frame_idx")), now=1.0)
    names = lambda: sorted(r["person_id"] for r in e.prototypes.read().collect())
    assert names() == ["person_10000", "person_10001", "person_9999"] and e.prototypes.next_number() == 10002
    other = [[float(v) for v in np.roll(r, 7)] for r in x[:12]]
    e.clustered(spark.createDataFrame([(k, v, "t", k) for k, v in enumerate(other)], "id long, embedding array<double>, source string, frame_idx int"), now=2.0)
    assert names() == ["person_10000", "person_10001", "person_10002", "person_9999"]


def test_classifier_hits_move_prototypes_in_order(spark, identities):
    x, _ = identities
    known = identity.appended(identity.none(spark), spark.createDataFrame([(0, [float(v) for v in x[0]], 1), (1, [float(v) for v in x[12]], 1)], "ord int, vector array<double>, count long"), 0, 0.0)
    nothing = spark.createDataFrame([], "cluster_id int, vector array<double>, n long")
    said = spark.createDataFrame([(1, [float(v) for v in x[36]], "person_0001", 0.9), (2, [float(v) for v in x[37]], "person_0077", 0.9), (3, [float(v) for v in x[1]], None, 0.1)], "id long, embedding array<double>, said string, confidence double")
    folded = identity.absorb(nothing, said, known, config.Prototypes(match_threshold=0.6), 2, 1.0)
    got = {r["key"]: (r["person_id"], r["score"]) for r in folded.filter("kind = 'noise'").collect()}
    assert got[1] == ("person_0001", 0.9) and got[2][0] is None and got[3][0] == "person_0000"
    after = {r["person_id"]: (r["count"], r["updated_at"]) for r in identity.prototypes_of(folded).collect()}
    assert after == {"person_0000": (2, 1.0), "person_0001": (2, 1.0)} and identity.next_of(folded) == 2
    match_all = identity.absorb(nothing, said.select("id", "embedding"), known, config.Prototypes(match_threshold=0.6), 2, 1.0, match_all=True)
    assert [r["person_id"] for r in match_all.filter("kind = 'noise'").orderBy("key").collect()] == ["person_0002", "person_0003", "person_0000"]


def test_service(spark, tmp_path, identities):
    import json

    from kindred.plans.service import Service

    x, truth = identities
    e = small_engine(spark, tmp_path)
    e.clustered(rows_of(spark, x, truth).select("id", "embedding", F.lit("s").alias("source"), F.col("id").cast("int").alias("frame_idx")), now=1.0)

    def embed(image, path, frame):
        return [{"bbox": (0, 0, 64, 48), "det_score": 0.9, "embedding": x[0]}] if image[0, 0, 0] == 1 else []

    s = Service(e, embed)

    def ask(method, path, body=None):
        status, _, out = s.answer(method, path, body if isinstance(body, bytes) else json.dumps(body).encode())
        return status, json.loads(out)

    vector = [float(v) for v in x[1]]
    assert ask("GET", "/health")[1]["persons_known"] == 3
    before = ask("GET", "/persons/person_0000")[1]["embeddings_absorbed"]
    status, got = ask("POST", "/identify", {"embedding": vector})
    assert status == 200 and got["person_id"] == "person_0000" and got["source"] == "prototype" and not got["committed"]
    assert ask("GET", "/persons/person_0000")[1]["embeddings_absorbed"] == before
    assert ask("POST", "/identify", {"embedding": vector, "commit": True})[1]["committed"] and ask("GET", "/persons/person_0000")[1]["embeddings_absorbed"] == before + 1
    assert ask("POST", "/identify", {"embedding": [float(v) for v in x[39]], "commit": True})[1] | {"score": 0} == {"person_id": None, "label": None, "score": 0, "source": "unknown", "committed": False}
    assert [ask("POST", "/identify", b)[0] for b in ({"embedding": [1.0]}, {"embedding": "x"}, {})] == [422] * 3 and s.answer("POST", "/identify", b"{")[0] == 422
    status, got = ask("POST", "/detect", bmp((1, 2, 3)))
    assert status == 200 and got["faces"][0]["identity"]["person_id"] == "person_0000" and got["rejected"] == 0
    assert ask("POST", "/detect", bmp((0, 2, 3)))[1]["faces"] == [] and ask("POST", "/detect", b"")[0] == 422 and Service(e).answer("POST", "/detect", bmp((1, 2, 3)))[0] == 503
    assert ask("PATCH", "/persons/person_0001", {"label": "Ada"})[1]["label"] == "Ada" and ask("PATCH", "/persons/none", {"label": None})[0] == 404
    assert ask("POST", "/update-prototype", {"person_id": "person_0001", "embedding": vector})[1]["label"] == "Ada"
    assert ask("DELETE", "/persons/person_0002")[1] == {"deleted": "person_0002"} and ask("GET", "/persons/person_0002")[0] == 404
    assert len(ask("GET", "/persons")[1]) == 2 and ask("GET", "/clusters")[1]["total_faces"] == 40 and ask("GET", "/none")[0] == 404
    text = s.answer("GET", "/metrics")[2].decode()
    assert 'identifications_total{source="prototype"} 3' in text and "persons_known 2" in text and 'face_quality_bucket{le="+Inf"} 1' in text
    assert ask("POST", "/retrain-classifier")[1]["trained"]


def test_capture(spark, tmp_path):
    e = small_engine(spark, tmp_path)
    e.cfg.acquisition = config.Acquisition(dir=str(tmp_path / "data"), interval_seconds=1.0, min_blur_variance=0, min_change_fraction=0.0)
    frames = spark.createDataFrame([("a", k + 1, 10.0, bmp((k, 0, 0)) if k != 7 else b"broken") for k in range(30)], "session string, frame_idx long, fps double, content binary")
    assert e.capture(frames, "Anna").first()["frames_saved"] == 3
    assert sorted(p.name for p in (tmp_path / "data" / "a").glob("*.jpg")) == ["000000.jpg", "000001.jpg", "000002.jpg"]
    r = manifests.read(spark, str(tmp_path / "data")).first()
    assert r["label"] == "Anna" and [f["frame_idx"] for f in r["frames"]] == [1, 11, 21] and r["frames_saved"] == 3
    assert manifests.totals(spark, str(tmp_path / "data")).first().asDict() == {"sessions": 1, "frames_saved": 3, "images": 3}


def test_trees_in_rounds_equal_those_of_one_task(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([b + rng.normal(0, 0.25, (30, 16)) for b in rng.normal(size=(4, 16))] + [rng.normal(size=(20, 16))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id long, embedding array<double>").repartition(3)
    tree, edges = trees.spanning_tree(x, 3), clustering.spanning_edges(rows, 3, tile=32).collect()
    assert len(edges) == len(tree) == len(x) - 1 and sum(r["d"] for r in edges) == pytest.approx(sum(d for d, _, _ in tree))
    one, many = ({r["id"]: r["cluster_id"] for r in clustering.hdbscan(rows, 5, 3, whole=n).collect()} for n in (1000, 10))
    assert len(set(one.values())) == len(set(many.values())) == len({(one[k], many[k]) for k in one}) > 3
    near = {(k, j) for k in range(len(x)) for j in range(k + 1, len(x)) if 1 - x[k] @ x[j] <= 0.2}
    assert near == {(r["i"], r["j"]) for r in neighbors.pairs_within(rows, 0.2, tile=8).collect()} == {(r["i"], r["j"]) for r in neighbors.pairs_within(rows, 0.2).collect()}
    refs = rows.filter("id < 50").select(F.col("id").alias("ref"), F.col("id").alias("seq"), "embedding").withColumnRenamed("embedding", "vector")
    assert {(r["id"], r["ref"]) for r in neighbors.nearest(rows, refs, block=7).collect()} == {(r["id"], r["ref"]) for r in neighbors.nearest(rows, refs).collect()} == {(k, int((x[:50] @ x[k]).argmax())) for k in range(len(x))}
    core = {r["id"]: r["core"] for r in neighbors.kth_distance(rows, 3, tile=16).collect()}
    assert all(core[k] == pytest.approx(np.sort(np.sqrt(np.maximum(0, 2 - 2 * x @ x[k])))[2], abs=1e-6) for k in core) and len(core) == len(x)


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(5, 5), (400, 400)]
    df = spark.createDataFrame(links, "a long, b long")
    parent = {k: k for p in links for k in p}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    for small in (0, 10, 1000):
        assert {r["x"]: r["c"] for r in graphs.components(df, small).collect()} == {k: root(k) for k in parent}


def test_average_linkage_by_definition():
    rng = np.random.default_rng(3)
    for n, threshold in ((12, 0.6), (25, 0.5), (30, 0.9)):
        x = rng.normal(size=(n, 4))
        x /= np.linalg.norm(x, axis=1)[:, None]
        groups = [[k] for k in range(n)]
        while len(groups) > 1:
            d, a, b = min(((1 - (x[g] @ x[h].T)).mean(), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
            if d >= threshold:
                break
            groups[a] += groups.pop(b)
        labels = trees.average_labels(x, threshold)
        assert {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels.tolist())} == {frozenset(g) for g in groups}


def grouped(labels):
    """The sets of ids of one label, of a mapping of ids to labels."""
    return {frozenset(k for k, c in labels.items() if c == name) for name in set(labels.values())}


def test_average_linkage_in_rounds_and_of_copies(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 6))
    x = np.concatenate([x, x[:30], x[:30], x[:5]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = rows_of(spark, x).repartition(3)
    whole = grouped(dict(enumerate(trees.average_labels(x, 0.4).tolist())))
    for links in (10**6, 200, 0):
        assert grouped({r["id"]: r["cluster_id"] for r in clustering.agglomerative(rows, 0.4, links=links).collect()}) == whole


def test_average_linkage_looks_at_links_only():
    # A hundred thousand clusters in pairs: a row of distances for each would be ten billion numbers.
    n = 100_000
    x = np.repeat(np.random.default_rng(4).normal(size=(n // 2, 4)), 2, axis=0)
    x /= np.linalg.norm(x, axis=1)[:, None]
    labels = trees.linked_labels(x, np.ones(n), np.arange(0, n, 2), np.arange(1, n, 2), 0.1)
    assert (labels == np.arange(n) // 2).all()


def test_tree_of_many_points_with_copies(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 16))
    x = np.concatenate([x, x[:40], x[:40], x[:40], x[:40], x[:20] + rng.normal(0, 1e-4, (20, 16))])
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).astype(float)
    rows = rows_of(spark, x).repartition(3)
    for k, nearest in ((1, 16), (3, 2)):
        lengths = sorted(r["d"] for r in clustering.spanning_edges(rows, k, tile=64, nearest=nearest).collect())
        assert lengths == pytest.approx([d for d, _, _ in trees.spanning_tree(x, k)], abs=1e-9)
    one, many = ({r["id"]: r["cluster_id"] for r in clustering.hdbscan(rows, 4, 2, whole=n).collect()} for n in (1000, 10))
    assert grouped(one) == grouped(many) and len(set(one.values())) > 30


def test_distances_do_not_depend_on_the_side(spark):
    x = np.random.default_rng(7).normal(size=(700, 61))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = rows_of(spark, x).select("id", "embedding", F.col("id").alias("c"), F.lit(0.0).alias("core"), F.lit(1).alias("size"))
    found = {(r["id"], e["id"]): e["d"] for r in neighbors.closest(rows, rows, 30, 97).collect() for e in r["near"]}
    both = [(d, found[j, i]) for (i, j), d in found.items() if (j, i) in found]
    assert len(both) > 1000 and all(d == e for d, e in both)


def test_store_appends_and_survives_a_torn_pointer(spark, tmp_path):
    store = FaceStore(spark, str(tmp_path / "faces"))
    row = spark.createDataFrame([(0, "s", 0, [1.0, 0.0])], "id long, source string, frame_idx int, embedding array<float>")
    for _ in range(8):
        store.add(row, 1.0)
    assert sorted(r["id"] for r in store.read().collect()) == list(range(1, 9)) and len(store.meta()["parts"]) == 8
    assert len(list((tmp_path / "faces" / "pointers").glob("*.json"))) == store.POINTERS
    (tmp_path / "faces" / "pointers" / "99999999999999999999.json").write_text("{torn")
    assert store.read().count() == 8
    (tmp_path / "faces" / "pointers" / "99999999999999999999.json").unlink()
    store.assign(store.read().select("id", F.lit(1).alias("cluster_id"), F.lit("p").alias("person_id")))
    for _ in range(store.POINTERS):
        store.note(x=1)
    assert len(list((tmp_path / "faces").glob("part-*"))) == 1 and store.labelled().count() == 8


def test_pixels():
    rng = np.random.default_rng(0)
    assert images.sharpness(rng.integers(0, 255, (40, 40, 3))) > 45 and images.sharpness(np.full((40, 40, 3), 128)) == 0
    assert images.signature(np.full((10, 20, 3), 7)).tolist() == pytest.approx([7.0] * 4096)
    assert images.raw_decoder(bmp((1, 2, 3))).shape == (48, 64, 3) and images.raw_decoder(b"") is None
    assert images.camera("0") == 0 and images.camera("rtsp://x") == "rtsp://x"


def test_manifests(spark, tmp_path):
    assert manifests.totals(spark, str(tmp_path / "none")).first().asDict() == {"sessions": 0, "frames_saved": 0, "images": 0}
    for name, n in (("a", 3), ("b", 3)):
        manifests.write(spark, str(tmp_path), name, {"session": name, "label": "Anna", "frames_saved": n})
        for k in range(n):
            (tmp_path / name / f"{k}.jpg").write_bytes(b"x")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "manifest.json").write_text("{not json")
    assert manifests.totals(spark, str(tmp_path)).first().asDict() == {"sessions": 2, "frames_saved": 6, "images": 6}


def test_config(tmp_path):
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "none.yaml"))
    (tmp_path / "c.yaml").write_text("quality: {min_face_size: 5, other: 1}\nnothing: {}\n")
    assert config.load(str(tmp_path / "c.yaml")).quality.min_face_size == 5
    (tmp_path / "e.yaml").write_text("")
    assert config.load(str(tmp_path / "e.yaml")) == config.Config()


def test_files(spark, tmp_path):
    from kindred.sources import files

    rows = [(k, "p" if k < 3 else None, 0.5, k, bmp((k, 0, 0)) if k != 1 else None, f"cam{k % 2}") for k in range(5)]
    faces = spark.createDataFrame(rows, "id long, person_id string, quality double, frame_idx int, crop binary, source string")
    assert files.write_files(files.crops(faces), str(tmp_path / "crops")) == 4
    assert sorted(p.name for p in (tmp_path / "crops" / "p").glob("*.jpg")) == ["0000_q0.50_f0.jpg", "0001_q0.50_f2.jpg"]
    shown = {r["file"]: images.raw_decoder(r["content"]) for r in files.montages(faces).collect()}
    assert shown["p.bmp"].shape == (112, 224, 3) and shown["p.bmp"][0, 112, 0] == 2 and "_noise.bmp" in shown
    out = files.write_summary(faces, str(tmp_path / "summary.json"), run="x")
    assert out["total_faces"] == 5 and out["identities"] == 1 and out["persons"]["p"]["sources"] == ["cam0", "cam1"] and out["run"] == "x"


def test_videos(spark):
    from kindred.sources import files

    def read(path):
        if path == "bad":
            raise OSError(path)
        for k in range(6):
            yield np.full((20, 20, 3), k)

    def embed(image, path, frame):
        return [{"det_score": 0.9, "bbox": (frame, 0, frame + 10, 10), "embedding": [1.0, 0.0]}] if frame != 4 else []

    frames = files.video_frames(spark.createDataFrame([("a",), ("bad",), ("b",)], "path string"), read, 2, embed).cache()
    assert frames.filter("failed").count() == 1 and sorted(r["frame_idx"] for r in frames.filter("source = 'a'").collect()) == [0, 2, 4]
    found = tracking.tracks(files.detections_of(frames), Tracker(min_hits=2)).collect()
    assert sorted((r["source"], r["hits"]) for r in found) == [("a", 2), ("b", 2)]
