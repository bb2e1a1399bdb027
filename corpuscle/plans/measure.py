"""Measurement of image pairs: from per-image pixel sizes to measurement rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.operators.jobs import check_pairs
from corpuscle.operators.measurements import image_metrics, measure_rows


class Measured(NamedTuple):
    measurements: DataFrame
    images: DataFrame  # image updates
    rejected: DataFrame  # jobs with code and side


def measure_pairs(jobs: DataFrame, images: DataFrame, pixels: DataFrame, marker_size_cm: float = 1.0) -> Measured:
    """Measure every job whose two images exist and belong to its user.

    `jobs`: id, user_id, lateral_id, superior_id, peso_g; `images`: id, user_id; `pixels`:
    id, bbox_width_px, bbox_height_px, mask_area_px, manual_scale, corners.
    """
    checked = check_pairs(jobs, images)
    sized = image_metrics(pixels, marker_size_cm)
    detail = F.struct("bbox_width_cm", "bbox_height_cm", "mask_area_cm2", "scale", "warning")
    out = checked.filter(F.col("code") == 200).drop("code", "side")
    for side in ("lateral", "superior"):
        metrics = sized.select(F.col("id").alias(f"{side}_id"), detail.alias(side))
        out = out.join(metrics, f"{side}_id")
    rows = measure_rows(out)
    measurements = rows.select(
        F.col("id").alias("analysis_id"), "user_id", "peso_g", "kvol", "comprimento_cm", "altura_cm", "largura_cm",
        "lateral_id", "superior_id",
        F.array_compact(F.array("lateral.warning", "superior.warning")).alias("warnings"),
    )
    updates = rows.select(
        "id",
        "peso_g",
        F.explode(
            F.array(
                *[F.struct(F.col(f"{side}_id").alias("image_id"), F.col(side).alias("m")) for side in ("lateral", "superior")]
            )
        ).alias("_i"),
    ).select(
        F.col("_i.image_id").alias("id"), F.col("id").alias("analysis_id"), "peso_g",
        F.col("_i.m.scale").alias("fator_conversao"), "_i.m.bbox_width_cm", "_i.m.bbox_height_cm", "_i.m.mask_area_cm2",
        F.lit("done").alias("processing_status"),
    )
    return Measured(measurements, updates, checked.filter(F.col("code") != 200))
