"""Every query of the engine's own operators by name, and its DuckDB SQL. Tables stand in for faces and frames:

embeddings: id = vec_id, cluster_id = label, person_id from label; events: a session is a user, frames in order of time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.config import Acquisition, Classifier, Clustering, Prototypes, Quality, Tracker
from kindred.functions import clock
from kindred.functions import vectors as V
from kindred.operators import acquisition, clustering, identity, neighbors, quality, reports, tracking
from kindred.operators import classifier as supervised
from kindred.sources import images
from kindred.sources.store import labelled, update_assignments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("cluster_id"))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select(
        "id", "embedding", "cluster_id", F.when(F.col("cluster_id") != 9, identity.person(F.col("cluster_id"))).alias("person_id"), F.concat(F.lit("cam"), (F.col("id") % 3).cast("string")).alias("source"),
        ((F.col("id") % 97) / 97.0).alias("quality"), (F.col("id") % 5 != 0).alias("has_crop"), F.col("id").cast("int").alias("frame_idx"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("frame_idx"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("sharpness"), k.alias("k"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("id") % 20) * 5.0, F.col("cluster_id") * 5.0
    return points(spark, sf_dir).withColumn("bbox", F.struct(x.alias("x1"), y.alias("y1"), (x + 10 + F.col("id") % 7).alias("x2"), (y + 12).alias("y2")))


def label_prototypes(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    c = clustering.centroids(points(spark, sf_dir).filter(where))
    zero = F.lit(0.0)
    return c.select(identity.person(F.col("cluster_id")).alias("person_id"), F.col("cluster_id").alias("seq"), "vector", F.col("n").alias("count"), zero.alias("created_at"), zero.alias("updated_at"), F.lit(None).cast("string").alias("label"))


_E = "e AS MATERIALIZED (SELECT vec_id id, embedding::DOUBLE[] v, label FROM embeddings)"
_CENTERS = """p AS (SELECT label, unnest(generate_series(1, len(v))) i, unnest(v) x FROM e WHERE {where}),
m AS (SELECT label, i, avg(x) m FROM p GROUP BY ALL), s AS (SELECT label, sqrt(sum(m*m)) n FROM m GROUP BY label),
cen AS MATERIALIZED (SELECT m.label, list(m/(n+1e-8) ORDER BY i) v FROM m JOIN s USING (label) GROUP BY m.label)"""
_FACES = """f AS (SELECT vec_id id, label cluster_id, CASE WHEN label <> 9 THEN printf('person_%04d', label) END person_id, 'cam' || (vec_id % 3) source,
(vec_id % 97) / 97.0 quality, vec_id % 5 <> 0 has_crop, vec_id::INT frame_idx FROM embeddings)"""
_BOXES = "b AS (SELECT vec_id id, label, (vec_id%20)*5.0 x1, label*5.0 y1, (vec_id%20)*5.0+10+vec_id%7 x2, label*5.0+12 y2 FROM embeddings)"


@query("SELECT vec_id id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x*x))) / (sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x*x))) + 1e-8), 6) length FROM embeddings")
def normalized(spark, sf_dir):
    return points(spark, sf_dir).select("id", F.round(V.norm(V.l2_normalize(F.col("embedding"))), 6).alias("length"))


@query(f"WITH {_E} SELECT a.id i, b.id j, round(list_inner_product(a.v,b.v),6) + 0.0 cosine, round(sqrt(greatest(0, 2-2*list_inner_product(a.v,b.v))),6) chord FROM e a JOIN e b ON a.id < b.id AND a.label = b.label")
def similarities(spark, sf_dir):
    a, b = (points(spark, sf_dir).select(F.col("id").alias(i), F.col("embedding").alias(v), "cluster_id") for i, v in (("i", "v"), ("j", "w")))
    s = a.join(b, "cluster_id").filter("i < j").select("i", "j", V.dot(F.col("v"), F.col("w")).alias("s"))
    return s.select("i", "j", (F.round("s", 6) + F.lit(0.0)).alias("cosine"), F.round(V.chord(F.col("s")), 6).alias("chord"))


@query(f"WITH {_BOXES}, o AS (SELECT a.id i, b.id j, (least(a.x2,b.x2)-greatest(a.x1,b.x1)) w, (least(a.y2,b.y2)-greatest(a.y1,b.y1)) h, (a.x2-a.x1)*(a.y2-a.y1) pa, (b.x2-b.x1)*(b.y2-b.y1) pb FROM b a JOIN b ON a.label=b.label AND a.id<b.id) SELECT i, j, round(w*h/(pa+pb-w*h+1e-9),6) iou FROM o WHERE w>0 AND h>0 AND w*h/(pa+pb-w*h+1e-9) >= 0.3")
def overlapping_boxes(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return tracking.overlapping(b, b, "cluster_id").filter("i < j").select("i", "j", F.round("iou", 6).alias("iou"))


@query("SELECT vec_id id, least(10+vec_id%7, 12.0)::DOUBLE size FROM embeddings")
def box_sizes(spark, sf_dir):
    return boxes(spark, sf_dir).select("id", V.box_size(F.col("bbox")).alias("size"))


@query("SELECT vec_id id, ((vec_id%20)*5)::INT x1, (label*5)::INT y1, least(((vec_id%20)*5+10+vec_id%7)::INT, 80) x2, least((label*5+12)::INT, 50) y2 FROM embeddings WHERE (vec_id%20)*5 < 80 AND label*5 < 50")
def clamped_boxes(spark, sf_dir):
    c = V.clamped(F.col("bbox"), F.lit(80), F.lit(50))
    return boxes(spark, sf_dir).withColumn("c", c).filter("c IS NOT NULL").select("id", "c.x1", "c.y1", "c.x2", "c.y2")


@query("SELECT event_id id FROM events WHERE event_id % 3 = 0")
def strided_frames(spark, sf_dir):
    return acquisition.strided(frames(spark, sf_dir), 3).select("id")


@query(f"WITH {_FACES} SELECT id, person_id FROM f WHERE person_id IS NOT NULL")
def labelled_faces(spark, sf_dir):
    return labelled(faces(spark, sf_dir)).select("id", "person_id")


@query("WITH n AS (SELECT event_id id, CASE event_id % 3 WHEN 0 THEN (event_id % 1000)::VARCHAR WHEN 1 THEN 'rtsp://cam' || event_id ELSE (event_id % 10)::VARCHAR || 'x' END s FROM events) SELECT id, CASE WHEN regexp_full_match(s, '[0-9]+') THEN s::INT END device, CASE WHEN NOT regexp_full_match(s, '[0-9]+') THEN s END address FROM n")
def cameras(spark, sf_dir):
    n = F.col("id")
    name = F.when(n % 3 == 0, (n % 1000).cast("string")).when(n % 3 == 1, F.concat(F.lit("rtsp://cam"), n.cast("string"))).otherwise(F.concat((n % 10).cast("string"), F.lit("x")))
    return frames(spark, sf_dir).select("id", images.cameras(name).alias("c")).select("id", "c.device", "c.address")


@query("SELECT event_id id, CASE WHEN event_id % 30 < 24 AND event_id % 70 < 60 AND event_id % 7 <> 0 THEN (event_id % 30 * 60 + event_id % 70)::INT END AS minutes FROM events")
def parsed_times(spark, sf_dir):
    n = F.col("id")
    text = F.when(n % 7 == 0, F.lit("noon")).otherwise(F.format_string("%02d:%02d", n % 30, n % 70))
    return frames(spark, sf_dir).select("id", clock.hhmm(text).alias("minutes"))


def _detections(spark, sf_dir):
    """A detection an event: score k/100, a square box of the event's value, sharpness 2k."""
    f = frames(spark, sf_dir)
    side = F.col("sharpness")
    at = lambda x: F.struct(F.lit(x).cast("double").alias("x"), F.lit(50.0).alias("y"))
    return f.select("id", (F.col("k") / 100).alias("det_score"), F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), side.alias("x2"), side.alias("y2")).alias("bbox"), (F.col("k") * 2).alias("blur_var"), F.array(at(0), at(100), F.struct((F.col("k")).alias("x"), F.lit(50.0).alias("y"))).alias("landmarks"))


_DET = "d AS (SELECT event_id id, (props->>'$.k')::DOUBLE/100 det, value size, 2*(props->>'$.k')::DOUBLE blur, (props->>'$.k')::DOUBLE k FROM events), y AS (SELECT *, CASE WHEN least(k,abs(100-k)) < 1e-3 THEN 'inf'::DOUBLE ELSE greatest(k,abs(100-k))/least(k,abs(100-k)) END yaw FROM d)"


@query(f"WITH {_DET} SELECT id, det < 0.6 low_det, size < 60 too_small, blur < 45 blurry, yaw > 2.5 profile, NOT (det < 0.6 OR size < 60 OR blur < 45 OR yaw > 2.5) ok, round((least(1,det)+least(1,size/120)+least(1,blur/90)+CASE WHEN yaw>2.5 THEN 0.3 ELSE 0 END)/CASE WHEN yaw>2.5 THEN 4 ELSE 3 END,9) quality FROM y")
def assessed_quality(spark, sf_dir):
    q = quality.assessed(_detections(spark, sf_dir), Quality())
    has = lambda p: F.exists("reasons", lambda r: r.startswith(p))
    return q.select("id", has("low_det").alias("low_det"), has("too_small").alias("too_small"), has("blurry").alias("blurry"), has("profile").alias("profile"), "ok", F.round("quality", 9).alias("quality"))


@query(f"WITH {_DET} SELECT (NOT (det < 0.6 OR size < 60 OR blur < 45 OR yaw > 2.5)) ok, count(*) n FROM y GROUP BY 1")
def quality_split(spark, sf_dir):
    good, bad = quality.split(_detections(spark, sf_dir), Quality())
    return good.select("ok").unionByName(bad.select("ok")).groupBy("ok").agg(F.count("*").alias("n"))


@query("SELECT event_id id FROM events WHERE (props->>'$.k')::DOUBLE/100 >= 0.5")
def detector_filter(spark, sf_dir):
    return quality.detected(_detections(spark, sf_dir).withColumn("embedding", F.array(F.lit(1.0)))).select("id")


@query("SELECT CASE WHEN len(embedding) <> 64 THEN 'size' WHEN list_sum(list_transform(embedding, lambda x: abs(x))) = 0 THEN 'zero' ELSE 'ok' END status, count(*) n FROM (SELECT embedding FROM embeddings UNION ALL SELECT list_transform(embedding, lambda x: 0::FLOAT) FROM embeddings WHERE label = 0 UNION ALL SELECT embedding[1:10] FROM embeddings WHERE label = 1) GROUP BY 1")
def vector_status(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    zero = e.filter("label = 0").select(F.transform("embedding", lambda x: x * 0).cast("array<float>").alias("embedding"))
    short = e.filter("label = 1").select(F.slice("embedding", 1, 10).alias("embedding"))
    return e.select("embedding").union(zero).union(short).groupBy(V.status(F.col("embedding"), 64).alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {_E}, {_CENTERS.format(where='true')} SELECT label cluster_id, unnest(generate_series(0, len(v)-1))::INT i, round(unnest(v), 6) + 0.0 x FROM cen")
def centroids(spark, sf_dir):
    return clustering.centroids(points(spark, sf_dir)).select("cluster_id", F.posexplode("vector").alias("i", "x")).withColumn("x", F.round("x", 6) + F.lit(0.0))


@query("SELECT vec_id id, CASE WHEN count(*) OVER (PARTITION BY label) < 48 THEN -1 ELSE label END cluster_id FROM embeddings")
def demoted(spark, sf_dir):
    return clustering.demote_small(points(spark, sf_dir), 48).select("id", "cluster_id")


@query("SELECT count(*) n, count(DISTINCT CASE WHEN label >= 5 THEN NULL ELSE label END) n_clusters, count(*) FILTER (label >= 5) n_noise FROM embeddings")
def cluster_counts(spark, sf_dir):
    return clustering.summary(_half_noise(spark, sf_dir))


def _half_noise(spark, sf_dir):
    return points(spark, sf_dir).withColumn("cluster_id", F.when(F.col("cluster_id") >= 5, F.lit(-1)).otherwise(F.col("cluster_id")))


@query(f"WITH {_E}, {_CENTERS.format(where='true')} SELECT id, CASE WHEN 1 - list_inner_product(e.v, cen.v) > 0.85 THEN -1 ELSE label END cluster_id FROM e JOIN cen USING (label)")
def purged(spark, sf_dir):
    p = points(spark, sf_dir)
    return clustering.purge_outliers(p, clustering.centroids(p), 0.85).select("id", "cluster_id")


@query(f"WITH {_E}, {_CENTERS.format(where='label < 5')}, r AS (SELECT e.id, cen.label c, list_inner_product(e.v,cen.v) s, row_number() OVER (PARTITION BY e.id ORDER BY list_inner_product(e.v,cen.v) DESC, cen.label) rn FROM e JOIN cen ON e.label >= 5) SELECT e.id, CASE WHEN e.label < 5 THEN e.label WHEN 1 - s <= 0.70 THEN c ELSE -1 END cluster_id FROM e LEFT JOIN r ON r.id = e.id AND rn = 1")
def reattached(spark, sf_dir):
    p = _half_noise(spark, sf_dir)
    return clustering.reattach_noise(p, clustering.centroids(p), 0.70).select("id", "cluster_id")


_MATCH = f"{_E}, {_CENTERS.format(where='true')}, r AS (SELECT e.id, printf('person_%04d', cen.label) who, list_inner_product(e.v,cen.v) s, row_number() OVER (PARTITION BY e.id ORDER BY list_inner_product(e.v,cen.v) DESC, cen.label) rn FROM e, cen), hit AS (SELECT id, CASE WHEN s >= 0.30 THEN who END person_id, round(s,6) score FROM r WHERE rn = 1)"


@query(f"WITH {_MATCH} SELECT * FROM hit")
def matched(spark, sf_dir):
    return identity.match(points(spark, sf_dir), label_prototypes(spark, sf_dir), 0.30).withColumn("score", F.round("score", 6))


@query(f"WITH {_MATCH} SELECT * FROM hit")
def matched_in_sql(spark, sf_dir):
    refs = label_prototypes(spark, sf_dir).select(F.col("person_id").alias("ref"), F.col("seq").cast("long").alias("seq"), "vector")
    return neighbors.nearest_in_sql(points(spark, sf_dir), refs).select("id", F.when(F.col("similarity") >= 0.30, F.col("ref")).alias("person_id"), F.round("similarity", 6).alias("score"))


@query(f"WITH {_MATCH} SELECT id, person_id, score, CASE WHEN person_id IS NULL THEN 'unknown' ELSE 'prototype' END source FROM hit")
def resolved(spark, sf_dir):
    return identity.resolve(points(spark, sf_dir), label_prototypes(spark, sf_dir), 0.30).withColumn("score", F.round("score", 6))


@query(f"WITH {_MATCH} SELECT hit.id, coalesce(CASE WHEN hit.id % 7 = 0 AND hit.id % 14 <> 0 THEN 'person_0003' END, person_id) person_id, CASE WHEN hit.id % 7 = 0 AND hit.id % 14 <> 0 THEN 0.9 ELSE score END score, CASE WHEN hit.id % 7 = 0 AND hit.id % 14 <> 0 THEN 'classifier' WHEN person_id IS NULL THEN 'unknown' ELSE 'prototype' END source FROM hit")
def cascaded(spark, sf_dir):
    """A verdict every seventh row, every other one of them for a person who isn't known."""
    p = points(spark, sf_dir)
    said = p.filter("id % 7 = 0").select("id", F.when(F.col("id") % 14 == 0, "person_0999").otherwise("person_0003").alias("person_id"), F.lit(0.9).alias("confidence"))
    return identity.resolve(p, label_prototypes(spark, sf_dir), 0.30, said).withColumn("score", F.round("score", 6))


@query(f"WITH {_E} SELECT a.id i, b.id j, round(list_inner_product(a.v,b.v),6) similarity FROM e a JOIN e b ON a.id < b.id AND 1 - list_inner_product(a.v,b.v) <= 0.60")
def near_pairs(spark, sf_dir):
    return neighbors.pairs_within(points(spark, sf_dir), 0.60).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_E}, r AS (SELECT a.id, CASE WHEN a.id = b.id THEN 1.0 ELSE list_inner_product(a.v,b.v) END s FROM e a, e b), k AS (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY s DESC) rn FROM r) SELECT id, round(sqrt(greatest(0, 2-2*s)),6) core FROM k WHERE rn = 3")
def core_distances(spark, sf_dir):
    return neighbors.kth_distance(points(spark, sf_dir), 3).withColumn("core", F.round("core", 6))


@query(f"WITH {_E} SELECT a.id, count(*) n FROM e a JOIN e b ON 1 - list_inner_product(a.v,b.v) <= 0.60 GROUP BY a.id HAVING count(*) >= 2")
def core_points(spark, sf_dir):
    pairs = neighbors.pairs_within(points(spark, sf_dir), 0.60)
    ends = pairs.select(F.explode(F.array("i", "j")).alias("id"))
    return ends.groupBy("id").agg((F.count("*") + 1).alias("n"))


_DBSCAN = """nb AS MATERIALIZED (SELECT a.id i, b.id j FROM e a JOIN e b ON 1 - list_inner_product(a.v,b.v) <= {eps}),
core AS MATERIALIZED (SELECT i FROM nb GROUP BY i HAVING count(*) >= 2),
ce AS MATERIALIZED (SELECT i, j FROM nb WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)),
reach(i,c) AS (SELECT i, i FROM core UNION SELECT ce.j, reach.c FROM reach JOIN ce ON ce.i = reach.i WHERE reach.c < ce.j),
comp AS MATERIALIZED (SELECT i, min(c) c FROM reach GROUP BY i),
lab AS MATERIALIZED (SELECT nb.i id, min(comp.c) c FROM nb JOIN comp ON comp.i = nb.j GROUP BY nb.i),
db AS MATERIALIZED (SELECT e.id, e.v, e.label truth, CASE WHEN lab.c IS NULL THEN -1 ELSE (dense_rank() OVER (ORDER BY lab.c NULLS LAST) - 1)::INT END label FROM e LEFT JOIN lab ON lab.id = e.id)"""


@query(f"WITH RECURSIVE {_E}, {_DBSCAN.format(eps=0.60)} SELECT id, label cluster_id FROM db")
def dbscan(spark, sf_dir):
    return clustering.dbscan(points(spark, sf_dir), 0.60, 2).select("id", "cluster_id")


@query(f"WITH RECURSIVE {_E}, {_DBSCAN.format(eps=0.62)} SELECT label cluster_id, count(*) n FROM db GROUP BY 1")
def dbscan_sizes(spark, sf_dir):
    return clustering.dbscan(points(spark, sf_dir), 0.62, 2).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {_E}, {_DBSCAN.format(eps=0.60)}, ct AS (SELECT label, truth, count(*) n FROM db WHERE label <> -1 GROUP BY ALL), mx AS (SELECT label, max(n) most, sum(n) n FROM ct GROUP BY 1) SELECT round(sum(most)/sum(n),6) purity FROM mx")
def cluster_purity(spark, sf_dir):
    p = points(spark, sf_dir)
    d = clustering.dbscan(p, 0.60, 2).join(p.select("id", F.col("cluster_id").alias("label")), "id")
    return clustering.purity(d).select(F.round("purity", 6).alias("purity"))


def _cen(src: str, out: str) -> str:
    return f"""{out}p AS (SELECT label, unnest(generate_series(1, len(v))) i, unnest(v) x FROM {src} WHERE label <> -1), {out}m AS (SELECT label, i, avg(x) m FROM {out}p GROUP BY ALL),
{out}s AS (SELECT label, sqrt(sum(m*m)) n FROM {out}m GROUP BY label), {out} AS MATERIALIZED (SELECT m.label, list(m/(n+1e-8) ORDER BY i) v FROM {out}m m JOIN {out}s USING (label) GROUP BY m.label)"""


_RECLUSTER = f"""{_E}, {_DBSCAN.format(eps=0.60)}, {{d0}}, {_cen('d0', 'c0')},
q AS MATERIALIZED (SELECT id, d0.v, CASE WHEN c0.v IS NOT NULL AND 1 - list_inner_product(d0.v,c0.v) > 0.35 THEN -1 ELSE d0.label END label FROM d0 LEFT JOIN c0 USING (label)),
{{d1}}, {_cen('d1', 'c1')},
ra AS (SELECT d1.id, c1.label c, list_inner_product(d1.v,c1.v) s, row_number() OVER (PARTITION BY d1.id ORDER BY list_inner_product(d1.v,c1.v) DESC, c1.label) rn FROM d1 JOIN c1 ON d1.label = -1),
fin AS (SELECT d1.id, CASE WHEN d1.label = -1 AND ra.s IS NOT NULL AND 1 - ra.s <= 0.60 THEN ra.c ELSE d1.label END cluster_id FROM d1 LEFT JOIN ra ON ra.id = d1.id AND rn = 1)""".format(
    d0="d0 AS MATERIALIZED (SELECT id, v, CASE WHEN count(*) OVER (PARTITION BY label) < 3 THEN -1 ELSE label END label FROM db)", d1="d1 AS MATERIALIZED (SELECT id, v, CASE WHEN count(*) OVER (PARTITION BY label) < 3 THEN -1 ELSE label END label FROM q)"
)
LOOSE = Clustering(algorithm="dbscan", dbscan_eps=0.60, min_samples=2, min_cluster_size=3, purge_threshold=0.35, reattach_threshold=0.60)


@query(f"WITH RECURSIVE {_RECLUSTER} SELECT id, cluster_id FROM fin")
def recluster(spark, sf_dir):
    return clustering.clustered(points(spark, sf_dir), LOOSE).select("id", "cluster_id")


@query(f"WITH RECURSIVE {_RECLUSTER} SELECT cluster_id, count(*) n FROM fin GROUP BY 1")
def recluster_summary(spark, sf_dir):
    return clustering.clustered(points(spark, sf_dir), LOOSE).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query()
def agglomerative(spark, sf_dir):
    return clustering.agglomerative(points(spark, sf_dir), 0.60).select("id", "cluster_id")


@query()
def hdbscan(spark, sf_dir):
    return clustering.hdbscan(points(spark, sf_dir), 4, 2).select("id", "cluster_id")


@query(f"WITH {_FACES} SELECT cluster_id, person_id, count(*) n FROM f GROUP BY ALL")
def stored_clusters(spark, sf_dir):
    return reports.cluster_summary(faces(spark, sf_dir))


@query(f"WITH {_FACES} SELECT person_id, count(*) faces FROM f WHERE person_id IS NOT NULL GROUP BY 1")
def person_counts(spark, sf_dir):
    return reports.person_counts(faces(spark, sf_dir))


@query(f"WITH {_FACES} SELECT count(*) faces FROM f WHERE person_id = 'person_0003'")
def person_faces(spark, sf_dir):
    return reports.person_faces(faces(spark, sf_dir), "person_0003")


@query(f"WITH {_FACES} SELECT coalesce(person_id,'_noise') person, count(*) faces, array_to_string(list_sort(list(DISTINCT source)), ',') sources, round(avg(quality),6) mean_quality FROM f GROUP BY 1")
def run_summary(spark, sf_dir):
    return reports.run_summary(faces(spark, sf_dir), 6).withColumn("sources", F.array_join("sources", ","))


@query(f"WITH {_FACES} SELECT count(*) total_faces, count(DISTINCT person_id) identities, count(*) FILTER (person_id IS NULL) noise_faces FROM f")
def run_totals(spark, sf_dir):
    return reports.run_totals(faces(spark, sf_dir))


@query(f"WITH {_FACES}, p AS (SELECT DISTINCT printf('person_%04d', label) person_id, count(*) OVER (PARTITION BY label) n FROM embeddings), c AS (SELECT person_id, count(*) k FROM f GROUP BY 1) SELECT p.person_id, NULL::VARCHAR AS label, n AS count, coalesce(k,0) faces FROM p LEFT JOIN c USING (person_id)")
def persons(spark, sf_dir):
    return reports.persons(label_prototypes(spark, sf_dir), faces(spark, sf_dir)).drop("created_at", "updated_at")


@query(f"WITH {_FACES}, r AS (SELECT id, coalesce(person_id,'_noise') person, (row_number() OVER (PARTITION BY coalesce(person_id,'_noise') ORDER BY id) - 1)::INT n FROM f WHERE has_crop) SELECT id, person, n FROM r WHERE n < 12")
def crops(spark, sf_dir):
    return reports.crops(faces(spark, sf_dir), 12).select("id", "person", "n")


@query(f"WITH {_FACES}, r AS (SELECT id, coalesce(person_id,'_noise') person, (row_number() OVER (PARTITION BY coalesce(person_id,'_noise') ORDER BY id) - 1)::INT n FROM f WHERE has_crop) SELECT id, person, ((n // 8) * 112)::INT y, ((n % 8) * 112)::INT x FROM r WHERE n < 32")
def montage(spark, sf_dir):
    return reports.montage(reports.crops(faces(spark, sf_dir)))


@query("SELECT vec_id id, CASE WHEN vec_id % 4 = 0 THEN 77 ELSE label END cluster_id, CASE WHEN vec_id % 4 = 0 THEN CASE WHEN vec_id % 8 = 0 THEN 'person_0077' END WHEN label <> 9 THEN printf('person_%04d', label) END person_id FROM embeddings")
def updated_assignments(spark, sf_dir):
    f = faces(spark, sf_dir)
    new = f.filter("id % 4 = 0").select("id", F.lit(77).alias("cluster_id"), F.when(F.col("id") % 8 == 0, "person_0077").alias("person_id"))
    return update_assignments(f, new).select("id", "cluster_id", "person_id")


@query(f"WITH {_FACES} SELECT person_id, count(*) n FROM f WHERE person_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 50")
def trainable_persons(spark, sf_dir):
    return reports.trainable(faces(spark, sf_dir), 50)


@query("""WITH v AS (SELECT label, list(embedding::DOUBLE[] ORDER BY vec_id) vs, count(*) n FROM embeddings GROUP BY label),
l AS (SELECT label, n, list_reduce(vs, lambda a, x: list_transform(list_zip(a, x), lambda p: (0.9*p[1]+0.1*p[2]) / (sqrt(list_sum(list_transform(list_zip(a, x), lambda q: (0.9*q[1]+0.1*q[2])*(0.9*q[1]+0.1*q[2])))) + 1e-8))) r FROM v)
SELECT label, n, round(r[1],6) + 0.0 AS first, round(r[64],6) + 0.0 AS last, round(list_sum(list_transform(r, lambda x: x*x)),6) AS length FROM l""")
def learned_prototypes(spark, sf_dir):
    p = identity.learned(points(spark, sf_dir).withColumnRenamed("cluster_id", "label"), "label", "id", 0.1)
    return p.select("label", "n", (F.round(F.get("vector", F.lit(0)), 6) + 0.0).alias("first"), (F.round(F.get("vector", F.lit(63)), 6) + 0.0).alias("last"), F.round(V.norm(F.col("vector")) ** 2, 6).alias("length"))


@query("SELECT printf('person_%04d', 20 + (row_number() OVER (ORDER BY label) - 1)) person_id, count(*) n FROM embeddings GROUP BY label")
def added_persons(spark, sf_dir):
    new = clustering.centroids(points(spark, sf_dir)).select("vector", F.col("n").alias("count"), F.col("cluster_id").alias("ord"))
    return identity.appended(identity.none(spark), new, 20, 0.0).select("person_id", F.col("count").alias("n"))


@query("SELECT DISTINCT printf('person_%04d', label) person_id FROM embeddings WHERE label % 3 <> 0")
def deleted_persons(spark, sf_dir):
    p = label_prototypes(spark, sf_dir)
    return identity.without(p, p.filter("seq % 3 = 0")).select("person_id")


@query("SELECT vec_id id, CASE WHEN label < 5 THEN 'cluster_' || label END person_id FROM embeddings")
def persons_of_clusters(spark, sf_dir):
    return identity.cluster_persons(_half_noise(spark, sf_dir)).select("id", "person_id")


_UNIT = "list_transform({0}, lambda x: x / (sqrt(list_inner_product({0}, {0})) + 1e-8))"


@query(f"""WITH RECURSIVE {_E}, {_CENTERS.format(where='label < 5')},
t AS (SELECT 'cluster' kind, cen.label::BIGINT key, cen.v FROM cen UNION ALL SELECT 'noise', id, v FROM e WHERE label >= 5),
z AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY kind, key) n FROM t),
r AS (SELECT 0::BIGINT n, 10 next, NULL::VARCHAR kind, NULL::BIGINT key, NULL::VARCHAR person_id, NULL::DOUBLE score, (SELECT list(v ORDER BY label) FROM cen WHERE label < 3) p, (SELECT list(printf('person_%04d', label) ORDER BY label) FROM cen WHERE label < 3) w
UNION ALL SELECT n, CASE WHEN hit OR kind = 'noise' THEN next ELSE next + 1 END, kind, key, CASE WHEN hit THEN w[pos] WHEN kind = 'cluster' THEN printf('person_%04d', next) END, best,
CASE WHEN hit THEN list_transform(p, lambda q, i: CASE WHEN i = pos THEN {_UNIT.format('moved')} ELSE q END) WHEN kind = 'cluster' THEN list_append(p, {_UNIT.format('v')}) ELSE p END, CASE WHEN NOT hit AND kind = 'cluster' THEN list_append(w, printf('person_%04d', next)) ELSE w END
FROM (SELECT *, list_transform(list_zip(p[pos], v), lambda y: 0.9 * y[1] + 0.1 * y[2]) moved FROM (SELECT *, list_position(sims, best)::INT AS pos, best >= 0.3 hit FROM (SELECT *, list_max(sims) best FROM (SELECT z.n, z.kind, z.key, z.v, r.next, r.p, r.w, list_transform(r.p, lambda q: list_inner_product(q, z.v)) sims FROM r JOIN z ON z.n = r.n + 1)))))
SELECT kind, key, person_id, round(score, 6) score FROM r WHERE n > 0""")
def absorbed(spark, sf_dir):
    p = _half_noise(spark, sf_dir)
    known = label_prototypes(spark, sf_dir, "cluster_id < 3")
    out = identity.absorb(clustering.centroids(p), p.filter("cluster_id = -1"), known, Prototypes(match_threshold=0.3), 10, 0.0)
    return out.filter("kind IN ('cluster', 'noise')").select("kind", "key", "person_id", F.round("score", 6).alias("score"))


@query("""WITH RECURSIVE s AS MATERIALIZED (SELECT user_id, event_id, epoch(ts) t, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) rn FROM events),
k AS (SELECT user_id, event_id, rn, t last, true kept FROM s WHERE rn = 1 UNION ALL SELECT s.user_id, s.event_id, s.rn, CASE WHEN s.t - k.last >= 36000 THEN s.t ELSE k.last END, s.t - k.last >= 36000 FROM k JOIN s ON s.user_id = k.user_id AND s.rn = k.rn + 1)
SELECT user_id::VARCHAR AS session, event_id FROM k WHERE kept""")
def kept_frames(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("t", F.col("ts").cast("double"))
    return acquisition.kept_by_interval(f, "session", "t", "id", 36000.0).select("session", F.col("id").alias("event_id"))


_GATE = """WITH RECURSIVE s AS MATERIALIZED (SELECT user_id, event_id, epoch(ts) t, value, (props->>'$.k')::DOUBLE k, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) rn FROM events),
g AS (SELECT user_id, event_id, rn, CASE WHEN value < 20 THEN NULL ELSE t END last, CASE WHEN value < 20 THEN NULL ELSE k END sig, CASE WHEN value < 20 THEN 'blurry' ELSE 'kept' END decision FROM s WHERE rn = 1
UNION ALL SELECT user_id, event_id, rn, CASE WHEN d = 'kept' THEN t ELSE last END, CASE WHEN d = 'kept' THEN k ELSE sig END, d FROM (SELECT s.user_id, s.event_id, s.rn, s.t, s.k, g.last, g.sig, CASE WHEN g.last IS NOT NULL AND s.t - g.last < 36000 THEN 'interval' WHEN s.value < 20 THEN 'blurry' WHEN g.sig IS NOT NULL AND abs(s.k - g.sig) <= 12 THEN 'unchanged' ELSE 'kept' END d FROM g JOIN s ON s.user_id = g.user_id AND s.rn = g.rn + 1))"""


def _gated(spark, sf_dir, **limits):
    f = frames(spark, sf_dir).withColumn("stream_time", F.col("ts").cast("double"))
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("session").orderBy("stream_time", "id")).cast("long")
    rows = f.withColumn("frame_idx", n).select("session", "frame_idx", "stream_time", "sharpness", F.array("k").alias("signature"), (F.col("k") % 2 == 0).alias("has_face"))
    return acquisition.decided(rows, Acquisition(interval_seconds=36000, min_blur_variance=20, min_change_fraction=0.5, **limits))


@query(_GATE + " SELECT user_id::VARCHAR AS session, rn AS frame_idx, decision FROM g")
def gated_frames(spark, sf_dir):
    return _gated(spark, sf_dir).select("session", "frame_idx", "decision")


@query(_GATE + " SELECT session, frame_idx, CASE WHEN before < 5 THEN decision END decision FROM (SELECT user_id::VARCHAR AS session, rn AS frame_idx, decision, coalesce(sum((decision = 'kept')::INT) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before FROM g) WHERE before < 5")
def stopped_by_count(spark, sf_dir):
    return _gated(spark, sf_dir, max_frames=5).select("session", "frame_idx", "decision")


@query(_GATE + ", f AS (SELECT *, min(rn) FILTER (t0 >= (SELECT median(t) FROM s)) OVER (PARTITION BY user_id) stop FROM (SELECT g.*, s.t t0 FROM g JOIN s USING (user_id, rn))) SELECT user_id::VARCHAR AS session, rn AS frame_idx, CASE WHEN rn = stop THEN 'stop' ELSE decision END decision FROM f WHERE stop IS NULL OR rn <= stop")
def stopped_by_time(spark, sf_dir):
    middle = frames(spark, sf_dir).agg(F.median(F.col("ts").cast("double"))).first()[0]
    return _gated(spark, sf_dir, max_duration_seconds=middle).select("session", "frame_idx", "decision")


@query(_GATE.replace("value < 20 THEN NULL", "value < 20 OR k % 2 = 1 THEN NULL").replace("CASE WHEN value < 20 THEN 'blurry' ELSE", "CASE WHEN value < 20 THEN 'blurry' WHEN k % 2 = 1 THEN 'no_face' ELSE").replace("<= 12 THEN 'unchanged' ELSE", "<= 12 THEN 'unchanged' WHEN s.k % 2 = 1 THEN 'no_face' ELSE") + " SELECT user_id::VARCHAR AS session, rn AS frame_idx, decision FROM g")
def face_gated_frames(spark, sf_dir):
    return _gated(spark, sf_dir, face_gate=True).select("session", "frame_idx", "decision")


@query("SELECT event_id id FROM events WHERE event_id % 4 IN (0, 1)")
def frames_with_faces(spark, sf_dir):
    f = frames(spark, sf_dir)
    found = f.filter("id % 4 < 2").select("session", "frame_idx").union(f.filter("id % 8 = 0").select("session", "frame_idx"))
    return acquisition.with_faces(f, found).select("id")


@query(f"WITH {_FACES}, c AS (SELECT person_id, count(*) n FROM f WHERE person_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 20) SELECT false AS trained, coalesce(sum(n), 0)::BIGINT n_samples, count(*) n_persons, 'need >= 100 persons with >= 20 samples, have ' || count(*) reason FROM c")
def training_report(spark, sf_dir):
    _, r = supervised.fit(faces(spark, sf_dir), Classifier(min_samples_per_person=20, min_persons=100))
    return spark.createDataFrame([(r.trained, r.n_samples, r.n_persons, r.reason)], "trained boolean, n_samples long, n_persons long, reason string")


@query(_GATE + " SELECT user_id::VARCHAR AS session, count(*) frames_seen, count(*) FILTER (decision='kept') frames_saved, count(*) FILTER (decision='interval') skipped_interval, count(*) FILTER (decision='blurry') skipped_blurry, count(*) FILTER (decision='unchanged') skipped_unchanged, 0::BIGINT skipped_no_face FROM g GROUP BY 1")
def gate_counters(spark, sf_dir):
    return acquisition.counters(_gated(spark, sf_dir))


@query(_GATE + " SELECT user_id::VARCHAR AS session, rn AS frame_idx, printf('%06d.jpg', row_number() OVER (PARTITION BY user_id ORDER BY rn) - 1) file FROM g WHERE decision = 'kept'")
def kept_files(spark, sf_dir):
    return acquisition.file_names(_gated(spark, sf_dir))


@query("SELECT event_id id, (hour(ts)*3600+minute(ts)*60+second(ts)) >= 25200 AND (hour(ts)*3600+minute(ts)*60+second(ts)) < 54000 AS by_day, (hour(ts) >= 22 OR hour(ts) < 6) AS by_night FROM events")
def in_windows(spark, sf_dir):
    ts = F.col("ts")
    return frames(spark, sf_dir).select("id", clock.in_window(ts, "07:00", "15:00").alias("by_day"), clock.in_window(ts, "22:00", "06:00").alias("by_night"))


@query("WITH t AS (SELECT event_id id, ts, date_trunc('day', ts)::TIMESTAMP d FROM events), c AS (SELECT *, CASE WHEN ts::TIME >= TIME '07:00' AND ts::TIME < TIME '15:00' THEN d + INTERVAL 15 HOUR ELSE d + INTERVAL 7 HOUR END n, d + INTERVAL 15 HOUR e FROM t) SELECT id, epoch(CASE WHEN n <= ts THEN n + INTERVAL 1 DAY ELSE n END)::BIGINT next_at, epoch(CASE WHEN e > ts THEN e - INTERVAL 1 DAY ELSE e END)::BIGINT ended_at, (id % 2 = 0) OR (ts - INTERVAL 9 HOUR < CASE WHEN e > ts THEN e - INTERVAL 1 DAY ELSE e END) AS due FROM c")
def schedule_times(spark, sf_dir):
    ts = F.col("ts")
    last = F.when(F.col("id") % 2 != 0, ts - F.expr("INTERVAL 9 HOURS"))
    return frames(spark, sf_dir).select("id", clock.next_transition(ts, "07:00", "15:00").cast("long").alias("next_at"), clock.last_window_end(ts, "15:00").cast("long").alias("ended_at"), clock.analysis_due(ts, last, "15:00").alias("due"))


@query("SELECT b::DOUBLE le, count(*) FILTER ((props->>'$.k')::DOUBLE/100 <= b) n FROM events, (VALUES (0.1),(0.2),(0.3),(0.4),(0.5),(0.6),(0.7),(0.8),(0.9),(1.0),('inf'::DOUBLE)) v(b) GROUP BY 1")
def quality_histogram(spark, sf_dir):
    return reports.histogram(frames(spark, sf_dir).withColumn("q", F.col("k") / 100), "q")


def _tracked(spark, sf_dir):
    e = points(spark, sf_dir)
    q = frames(spark, sf_dir).select("id", (F.col("k") / 100).alias("quality"))
    return e.join(q, "id").select("id", F.col("cluster_id").alias("track_id"), F.col("id").cast("int").alias("frame_idx"), "quality", "embedding")


@query("""WITH j AS (SELECT vec_id id, label track_id, embedding::DOUBLE[] v, (props->>'$.k')::DOUBLE/100 q, row_number() OVER (PARTITION BY label ORDER BY vec_id) n FROM embeddings JOIN events ON vec_id = event_id),
c AS (SELECT * FROM j WHERE n <= 30), p AS (SELECT track_id, q, unnest(generate_series(1, len(v))) i, unnest(v) x FROM c), m AS (SELECT track_id, i, sum(q*x)/sum(q) m FROM p GROUP BY ALL), s AS (SELECT track_id, sqrt(sum(m*m)) + 1e-8 n FROM m GROUP BY 1),
t AS (SELECT track_id, min(id)::INT first_frame, max(id)::INT last_frame, count(*) hits, arg_max(id, (q, -id)) best_id FROM j GROUP BY 1), u AS (SELECT track_id, round(avg(q),6) quality, count(*) n_frames FROM c GROUP BY 1)
SELECT t.track_id, first_frame, last_frame, quality, n_frames, hits, best_id, (SELECT round(m/n,6)+0.0 FROM m JOIN s USING (track_id) WHERE i = 1 AND m.track_id = t.track_id) AS x FROM t JOIN u USING (track_id)""")
def track_summaries(spark, sf_dir):
    t = tracking.summarized(_tracked(spark, sf_dir))
    return t.select("track_id", "first_frame", "last_frame", F.round("quality", 6).alias("quality"), "n_frames", "hits", "best_id", (F.round(F.get("embedding", F.lit(0)), 6) + 0.0).alias("x"))


def _stream_of_boxes(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return b.select(F.concat(F.lit("cam"), (F.col("id") % 3).cast("string")).alias("source"), F.floor(F.col("id") / 12).cast("int").alias("frame_idx"), "id", "bbox", V.doubles(F.col("embedding")).alias("embedding"), ((F.col("id") % 97) / 97.0).alias("quality"))


@query()
def track_assignments(spark, sf_dir):
    return tracking.assigned(_stream_of_boxes(spark, sf_dir), Tracker())


@query()
def confirmed_tracks(spark, sf_dir):
    return tracking.tracks(_stream_of_boxes(spark, sf_dir), Tracker()).select("source", "track_id", "first_frame", "last_frame", "hits", "n_frames", "best_id", F.round("quality", 6).alias("quality"))


@query()
def person_classifier(spark, sf_dir):
    f = faces(spark, sf_dir)
    model, _ = supervised.fit(f, Classifier(max_iter=50))
    return supervised.verdicts(model, f, 0.75).withColumn("confidence", F.round("confidence", 4))
