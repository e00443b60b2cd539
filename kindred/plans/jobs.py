"""Whole jobs: images, videos, re-clustering, training, and what a service answers."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.config import Config
from kindred.functions import vectors as V
from kindred.operators import acquisition, classifier, clustering, identity, quality, reports, tracking
from kindred.plans.meters import Meters
from kindred.sources import files, images, manifests
from kindred.sources.images import Decoder, Embedder, raw_decoder
from kindred.sources.store import FaceStore, PrototypeStore
from kindred.tables import cut, numbered


@dataclass
class Engine:
    """Stores and settings that jobs share."""

    spark: SparkSession
    cfg: Config

    def __post_init__(self) -> None:
        self.faces = FaceStore(self.spark, self.cfg.output.db_path)
        self.prototypes = PrototypeStore(self.spark, self.cfg.prototypes.path)
        self.model = classifier.load(self.cfg.classifier.path) if self.cfg.classifier.enabled else None
        self.meters = Meters()

    def clustered(self, rows: DataFrame, reset: bool = False, now: float | None = None) -> dict:
        """Clusters accepted rows (id, embedding, ...), gives them persons, stores and reports them; returns the run's totals.

        Below the output folder: summary.json, and of rows with a crop the first of each person and their montages."""
        now = time.time() if now is None else now
        if rows.isEmpty():  # nothing is touched, the store neither
            return {"total_faces": 0, "identities": 0, "noise_faces": 0, "recovered": 0}
        if "quality" not in rows.columns:
            rows = rows.withColumn("quality", F.lit(1.0))
        labels = cut(clustering.clustered(rows, self.cfg.clustering).select("id", "embedding", "cluster_id"))
        persons, recovered = self.persons(labels, now)
        known = cut(rows.drop("cluster_id", "person_id").join(labels.select("id", "cluster_id"), "id").join(persons, "id", "left"))
        if reset:
            self.faces.clear()
        self.faces.add(known.drop("crop", "place"), now)
        out = self.cfg.output
        totals = files.write_summary(known, f"{out.dir}/summary.json", recovered=recovered)
        if out.save_crops and "crop" in known.columns:
            files.write_files(files.crops(known, out.max_crops_per_cluster), f"{out.dir}/crops")
            files.write_files(files.montages(known), f"{out.dir}/montages")
        self.meters.gauges["clusters_total"] = clustering.summary(labels).first()["n_clusters"]
        return {k: v for k, v in totals.items() if k != "persons"}

    def persons(self, labels: DataFrame, now: float) -> tuple[DataFrame, int]:
        """(id, person_id) of labelled rows and how much noise was recognised; prototypes learn and are stored."""
        cfg = self.cfg.prototypes
        if not cfg.enabled:
            return identity.cluster_persons(labels).select("id", "person_id"), 0
        folded = self.fold(clustering.centroids(labels), labels.filter("cluster_id = -1").select("id", "embedding"), now)
        of_cluster = folded.filter("kind = 'cluster'").select(F.col("key").cast("int").alias("cluster_id"), F.col("person_id"))
        of_noise = folded.filter("kind = 'noise' AND person_id IS NOT NULL").select(F.col("key").alias("id"), F.col("person_id"))
        both = labels.select("id", "cluster_id").join(of_cluster, "cluster_id", "left").select("id", "person_id").filter("person_id IS NOT NULL").unionByName(of_noise)
        return both, of_noise.count()

    def fold(self, centers: DataFrame, points: DataFrame, now: float, known: DataFrame | None = None, **meta) -> DataFrame:
        """Clusters and points against the prototypes in order, a classifier's verdicts first; what was learned is stored."""
        if self.model is not None:
            said = classifier.verdicts(self.model, points, self.cfg.classifier.confidence_threshold)
            points = points.join(said.select("id", F.col("person_id").alias("said"), "confidence"), "id", "left")
        known = self.prototypes.read() if known is None else known
        number = meta.pop("next_number", None)
        folded = cut(identity.absorb(centers, points, known, self.cfg.prototypes, self.prototypes.next_number() if number is None else number, now))
        after = identity.prototypes_of(folded)
        self.prototypes.write(after, next_number=identity.next_of(folded), **meta)
        self.meters.gauges["persons_known"] = after.count()
        self.meters.counters["prototype_updates"] += folded.filter("kind IN ('cluster', 'noise') AND person_id IS NOT NULL").count()
        return folded

    def _said(self, points: DataFrame) -> DataFrame | None:
        """Verdicts of the classifier for persons who are still known."""
        if self.model is None:
            return None
        found = classifier.verdicts(self.model, points, self.cfg.classifier.confidence_threshold).filter("person_id IS NOT NULL")
        return cut(found.join(self.prototypes.read().select("person_id"), "person_id", "left_semi").select("id", "person_id", "confidence"))

    def _accepted(self, found: DataFrame) -> tuple[DataFrame, int]:
        """Detections of sufficient quality, and how many were rejected; both are counted."""
        accepted, rejected = quality.split(cut(quality.detected(found, self.cfg.detector.det_score_threshold)), self.cfg.quality)
        n = rejected.count()
        self.meters.counters["faces_rejected"] += n
        for r in accepted.groupBy(F.least(F.ceil(F.col("quality") * 10) / 10, F.lit(1.0)).alias("q")).count().collect():
            self.meters.histograms["face_quality"].observe(float(r["q"] or 0.0), r["count"])
            self.meters.counters["faces_detected"] += r["count"]
        return accepted, n

    def images(self, folder: str, embed: Embedder, decode: Decoder = raw_decoder, reset: bool = False) -> dict:
        found = images.detections(images.listed(self.spark, folder), embed, decode, files.bmp if self.cfg.output.save_crops else None)
        accepted, rejected = self._accepted(found)
        # The order of ids is that of paths and of places in a file, whatever the partitions are.
        rows = cut(numbered(accepted, "id", "source", "frame_idx", "place"))
        return self.clustered(rows, reset) | {"rejected": rejected}

    def videos(self, folder: str, read: files.Reader, embed: Embedder, reset: bool = False) -> dict:
        """The videos below a folder, one vector a track; a video that can't be read is counted, and the others go on."""
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path").filter(F.lower("path").rlike(r"\.(" + "|".join(images.VIDEOS) + ")$"))
        if listed.isEmpty():
            raise FileNotFoundError(f"no videos in {folder}")
        frames = cut(files.video_frames(listed, read, self.cfg.video.frame_stride, embed))
        failed = frames.filter("failed").count()
        return self.tracks(files.detections_of(frames), reset) | {"videos_failed": failed}

    def capture(self, frames: DataFrame, label: str | None = None, decode: Decoder = raw_decoder, embed: Embedder | None = None) -> DataFrame:
        """Frames (session, frame_idx from 1, content; fps where a file has it, else stream_time) through the gate: kept ones
        are written as files, and each session gets its manifest. Returns the sessions' counters."""
        cfg = self.cfg.acquisition
        by = F.concat_ws("#", "session", "frame_idx")
        named = frames.withColumn("path", by)
        measured = images.measured(named, decode).select("path", "sharpness", "signature", "ok")
        time_of = F.col("frame_idx") / F.col("fps") if "fps" in frames.columns else F.col("stream_time").cast("double")
        rows = named.withColumn("at", time_of).join(measured.filter("ok"), "path")
        if cfg.face_gate and embed is not None:
            faced = images.detections(named.select("path", F.col("frame_idx").cast("int").alias("frame_idx"), "content"), embed, decode).select(F.col("source").alias("path")).distinct()
            rows = rows.join(faced.withColumn("has_face", F.lit(True)), "path", "left")
        else:
            rows = rows.withColumn("has_face", F.lit(None).cast("boolean"))
        rows = cut(rows.select(F.col("session").cast("string").alias("session"), F.col("frame_idx").cast("long").alias("frame_idx"), F.col("at").alias("stream_time"), "sharpness", "signature", F.coalesce("has_face", F.lit(not cfg.face_gate)).alias("has_face"), "content"))
        said = cut(acquisition.decided(rows.drop("content"), cfg))
        names = cut(acquisition.file_names(said).join(rows.select("session", "frame_idx", "stream_time", "sharpness", "content"), ["session", "frame_idx"]))
        files.write_files(names.select(F.concat_ws("/", "session", "file").alias("file"), "content"), cfg.dir)
        counted = cut(acquisition.counters(said))
        entry = F.struct("file", "frame_idx", F.bround("stream_time", 3).alias("stream_time"), F.bround("sharpness", 1).alias("sharpness"))
        kept = names.groupBy("session").agg(F.sort_array(F.collect_list(entry)).alias("frames"))
        for r in counted.join(kept, "session", "left").toLocalIterator():
            one = r.asDict(recursive=True)
            manifests.write(self.spark, cfg.dir, one["session"], {**one, "label": label, "frames": one["frames"] or [], "settings": {k: str(v) for k, v in cfg.__dict__.items()}})
        return counted

    def tracks(self, detections: DataFrame, reset: bool = False) -> dict:
        """Videos: detections (source, frame_idx, id, bbox, embedding, quality) to tracks, one vector a track, all clustered at once."""
        found = cut(tracking.tracks(detections, self.cfg.tracker))
        rows = cut(numbered(found, "id", "source", "first_frame", "track_id").select("id", "source", F.col("first_frame").alias("frame_idx"), "track_id", F.struct("x1", "y1", "x2", "y2").alias("bbox"), "det_score", "quality", "embedding"))
        return self.clustered(rows, reset) | {"tracks": rows.count()}

    def recluster(self, now: float | None = None) -> dict:
        """The stored vectors clustered again, against the prototypes; only assignments change."""
        now = time.time() if now is None else now
        rows = self.faces.embeddings()
        if rows.isEmpty():
            return {"faces": 0, "identities": 0, "noise": 0, "recovered": 0}
        labels = cut(clustering.clustered(rows, self.cfg.clustering).select("id", "embedding", "cluster_id"))
        persons, recovered = self.persons(labels, now)
        self.faces.assign(cut(labels.select("id", "cluster_id").join(persons, "id", "left")))
        s = clustering.summary(labels).first()
        return {"faces": s["n"], "identities": s["n_clusters"], "noise": s["n_noise"], "recovered": recovered}

    def train(self) -> classifier.Report:
        model, report = classifier.fit(self.faces.labelled(), self.cfg.classifier)
        if model is not None:
            classifier.save(model, self.cfg.classifier.path)
            self.model = model
            self.meters.gauges["classifier_persons"] = report.n_persons
        self.meters.counters["classifier_trainings"] += report.trained
        return report

    def analysis(self, folder: str, embed: Embedder, decode: Decoder = raw_decoder) -> dict:
        """The nightly job: the whole folder anew, and a classifier after it where the schedule says so."""
        out = self.images(folder, embed, decode, reset=True)
        if self.cfg.schedule.train_after_analysis:
            out["training"] = dict(self.train().__dict__)
        return out

    # A service's answers, as tables.

    def health(self) -> dict:
        return {"status": "ok", "prototypes": self.prototypes.read().count(), "classifier": self.model is not None}

    def identify(self, requests: DataFrame, commit: bool = False, now: float | None = None) -> DataFrame:
        """(id, status, person_id, label, score, source) of requests (id, embedding). Nothing is learned, unless ``commit``:
        then requests are met in order of id, and each one that is recognised moves its prototype."""
        began = time.time()
        checked = cut(requests.select("id", V.doubles(F.col("embedding")).alias("raw"), V.status(F.col("embedding"), self.cfg.api.embedding_dim).alias("status")))
        fine = checked.filter("status = 'ok'").select("id", V.l2_normalize(F.col("raw")).alias("embedding"))
        known, said = self.prototypes.read(), self._said(fine)
        if commit:
            folded = self.fold(self.spark.createDataFrame([], "cluster_id int, vector array<double>, n long"), fine, time.time() if now is None else now)
            found = folded.filter("kind = 'noise'").select(F.col("key").alias("id"), "person_id", "score")
            found = found.join(said.select("id", F.col("person_id").alias("said")), "id", "left") if said is not None else found.withColumn("said", F.lit(None).cast("string"))
            source = F.when(F.col("said") == F.col("person_id"), "classifier").when(F.col("person_id").isNotNull(), "prototype").otherwise("unknown")
            found = found.withColumn("source", source).drop("said")
        else:
            found = identity.resolve(fine, known, self.cfg.prototypes.match_threshold, said)
        found = cut(found.join(known.select("person_id", "label"), "person_id", "left"))
        for r in found.groupBy("source").count().collect():
            self.meters.identifications[r["source"]] += r["count"]
        self.meters.histograms["identify_latency_seconds"].observe(time.time() - began)
        return checked.select("id", F.when(F.col("status") == "ok", 200).otherwise(422).alias("status")).join(found, "id", "left").select("id", "status", "person_id", "label", "score", "source")

    def detect(self, uploads: DataFrame, embed: Embedder | None, decode: Decoder = raw_decoder) -> DataFrame:
        """(id, status, face, bbox, det_score, quality, person_id, score, source) of uploads (id, content): a row a face that
        passes the quality filter; one without a face where there is none; status 422 where the bytes are no image, and 503
        where there is no embedder. Nothing is learned."""
        kind = "id long, status int, face int, bbox struct<x1:double,y1:double,x2:double,y2:double>, det_score double, quality double, person_id string, score double, source string"
        if embed is None:
            return uploads.select("id", F.lit(503).alias("status"), *(F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split(" ", 1)[0]) for c in re.split(", (?=[a-z_]+ )", kind)[2:]))
        status = cut(images.upload_status(uploads, decode))
        own = uploads.join(status.filter("status = 200").select("id"), "id").select(F.col("id").cast("string").alias("path"), F.lit(0).alias("frame_idx"), "content")
        accepted, _ = self._accepted(images.detections(own, embed, decode))
        rows = cut(numbered(accepted, "n", "source", "place"))
        points = rows.select(F.col("n").alias("id"), "embedding")
        found = identity.resolve(points, self.prototypes.read(), self.cfg.prototypes.match_threshold, self._said(points)).withColumnRenamed("source", "by")
        for r in found.groupBy("by").count().collect():
            self.meters.identifications[r["by"]] += r["count"]
        faces = rows.join(found, rows["n"] == found["id"]).select(F.col("source").cast("long").alias("id"), F.col("place").alias("face"), "bbox", "det_score", "quality", "person_id", "score", F.col("by").alias("source"))
        return status.join(faces, "id", "left").select([c.split(" ", 1)[0] for c in re.split(", (?=[a-z_]+ )", kind)])

    def person(self, person_id: str) -> dict:
        """One person's answer; KeyError where the person isn't known."""
        found = self.persons_table().filter(F.col("person_id") == person_id).first()
        if found is None:
            raise KeyError(person_id)
        return found.asDict()

    def persons_table(self) -> DataFrame:
        return reports.persons(self.prototypes.read(), self.faces.read())

    def rename(self, person_id: str, label: str | None) -> None:
        self.prototypes.write(identity.labelled(self.prototypes.read(), person_id, label))

    def delete(self, person_id: str) -> None:
        known = self.prototypes.read()
        gone = known.filter(F.col("person_id") == person_id)
        if gone.isEmpty():
            raise KeyError(person_id)
        self.prototypes.write(identity.without(known, gone), next_number=self.prototypes.next_number())

    def move(self, person_id: str, vector: list[float]) -> None:
        """Moves a person's prototype towards a vector of any length but zero; KeyError where the person isn't known."""
        self.prototypes.write(identity.updated(self.prototypes.read(), person_id, identity.unit(vector).tolist(), self.cfg.prototypes.ema_alpha, time.time()))
        self.meters.counters["prototype_updates"] += 1

    def clusters(self) -> DataFrame:
        return reports.cluster_summary(self.faces.read())

    def metrics(self) -> DataFrame:
        """(metric, label, value) of every series: what is stored now, and what this engine has counted."""
        f = self.faces.read().agg(F.count("*").alias("faces_stored"), F.count("person_id").alias("faces_known"), F.avg("quality").alias("mean_quality")).first().asDict()
        self.meters.gauges["persons_known"] = self.prototypes.read().count()
        rows = [(k, "", None if v is None else float(v)) for k, v in f.items()] + [(name, label, float(v)) for name, label, v in self.meters.rows()]
        return self.spark.createDataFrame(rows, "metric string, label string, value double")
