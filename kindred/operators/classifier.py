"""A supervised classifier of persons by Spark's own estimators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.config import Classifier
from kindred.functions import vectors as V
from kindred.operators.reports import trainable


@dataclass
class Report:
    trained: bool
    n_samples: int = 0
    n_persons: int = 0
    classes: list[str] = field(default_factory=list)
    reason: str = ""


def fit(faces: DataFrame, cfg: Classifier) -> tuple[PipelineModel | None, Report]:
    """A model of the persons with enough faces (embedding, person_id), or none and why. Class names are few and go to the driver."""
    if cfg.model not in ("logreg", "mlp"):
        raise ValueError(f"unknown classifier model: {cfg.model}")
    labelled = faces.filter("person_id IS NOT NULL AND embedding IS NOT NULL")
    if labelled.isEmpty():
        return None, Report(False, reason="no labeled samples")
    classes = trainable(labelled, cfg.min_samples_per_person)
    found = sorted((r["person_id"], r["n"]) for r in classes.collect())
    need = max(2, cfg.min_persons)
    if len(found) < need:
        return None, Report(False, sum(k for _, k in found), len(found), reason=f"need >= {need} persons with >= {cfg.min_samples_per_person} samples, have {len(found)}")
    rows = labelled.join(F.broadcast(classes), "person_id", "left_semi").select("person_id", array_to_vector(V.l2_normalize(F.col("embedding"))).alias("features"))
    n = sum(k for _, k in found)
    if cfg.model == "mlp":
        size = len(rows.select("features").first()[0])
        last = MultilayerPerceptronClassifier(layers=[size, cfg.mlp_hidden, len(found)], maxIter=cfg.max_iter, seed=0)
    else:
        last = LogisticRegression(regParam=1 / (cfg.regularization_c * n), elasticNetParam=0.0, standardization=False, maxIter=cfg.max_iter)
    model = Pipeline(stages=[StringIndexer(inputCol="person_id", outputCol="label", stringOrderType="alphabetAsc"), last]).fit(rows)
    return model, Report(True, n, len(found), [p for p, _ in found])


def verdicts(model: PipelineModel | None, points: DataFrame, threshold: float) -> DataFrame:
    """(id, person_id, confidence): the likeliest person, null below the threshold; without a model always null and 0."""
    if model is None:
        return points.select("id", F.lit(None).cast("string").alias("person_id"), F.lit(0.0).alias("confidence"))
    names = model.stages[0].labels
    rows = points.select("id", array_to_vector(V.l2_normalize(F.col("embedding"))).alias("features"))
    p = model.stages[1].transform(rows).select("id", vector_to_array("probability").alias("p"))
    best = F.array_max("p")
    who = F.get(F.array(*map(F.lit, names)), F.array_position("p", best).cast("int") - 1)
    return p.select("id", F.when(best >= threshold, who).alias("person_id"), best.alias("confidence"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel | None:
    """The stored model; None where there is none that can be read."""
    try:
        return PipelineModel.load(path)
    except Exception:  # no model, or one of another version
        return None
