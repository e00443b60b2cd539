"""Quality of detections, as columns: components, reasons, score, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.config import Quality
from kindred.functions import vectors as V

PROFILE_SCORE = 0.3


def detected(faces: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Detections that score ``threshold`` or more and have a vector. Both conditions reach the scan."""
    return faces.filter((F.col("det_score") >= threshold) & F.col("embedding").isNotNull())


def reasons(det: Column, size: Column, blur: Column, yaw: Column, cfg: Quality) -> Column:
    """Codes with the value at fault, in a fixed order; blur and yaw are null where they weren't measured."""
    # The formats of the codes.
    return F.array_compact(
        F.array(
            F.when(det < cfg.min_det_score, F.format_string("low_det_score(%.2f)", det)),
            F.when(size < cfg.min_face_size, F.format_string("too_small(%.0fpx)", size)),
            F.when(blur < cfg.min_blur_variance, F.format_string("blurry(%.0f)", blur)),
            F.when(yaw > cfg.max_yaw_asymmetry, F.format_string("profile(asym=%.1f)", yaw)),
        )
    )


def score(det: Column, size: Column, blur: Column, yaw: Column, cfg: Quality) -> Column:
    """The mean of the components that apply; a frontal face adds none for its yaw."""
    parts = F.array_compact(
        F.array(
            F.least(F.lit(1.0), det.cast("double")),
            F.least(F.lit(1.0), size.cast("double") / F.lit(max(1.0, 2.0 * cfg.min_face_size))),
            F.when(blur.isNotNull(), F.least(F.lit(1.0), blur.cast("double") / F.lit(max(1e-6, 2.0 * cfg.min_blur_variance)))),
            F.when(yaw > cfg.max_yaw_asymmetry, F.lit(PROFILE_SCORE)),
        )
    )
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts)


def assessed(faces: DataFrame, cfg: Quality) -> DataFrame:
    """``faces`` with ok, quality and reasons. Reads det_score, bbox, blur_var and landmarks."""
    if not cfg.enabled:
        return faces.withColumns({"ok": F.lit(True), "quality": F.lit(1.0), "reasons": F.array().cast("array<string>")})
    det, size, blur = F.col("det_score").cast("double"), V.box_size(F.col("bbox")).cast("double"), F.col("blur_var").cast("double")
    yaw = F.when(F.size("landmarks") >= 3, V.yaw_asymmetry(F.col("landmarks")))
    return faces.withColumns({"quality": score(det, size, blur, yaw, cfg), "reasons": reasons(det, size, blur, yaw, cfg)}).withColumn("ok", F.size("reasons") == 0)


def split(faces: DataFrame, cfg: Quality) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected detections, both with their quality."""
    both = assessed(faces, cfg)
    return both.filter("ok"), both.filter("NOT ok")
