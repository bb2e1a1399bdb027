"""Paired image measurements and the series drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.measures import effective_scale, kvol, to_physical, to_physical_area


def measurements_with_images(measurements: DataFrame, images: DataFrame, columns: tuple[str, ...] = ("id",)) -> DataFrame:
    """Each measurement with its first lateral and first superior image, in one join."""
    picked = F.struct(*columns)

    def first(tag: str):
        is_tag = F.col("tag") == tag
        return F.min_by(F.when(is_tag, picked), F.when(is_tag, F.struct("uploaded_at", "id"))).alias(f"{tag}_image")

    pairs = images.filter(F.col("analysis_id").isNotNull()).groupBy("analysis_id").agg(
        first("lateral"), first("superior")
    )
    return measurements.join(pairs, measurements["id"] == pairs["analysis_id"], "left").drop("analysis_id")


def image_metrics(images: DataFrame, marker_size_cm: float = 1.0) -> DataFrame:
    """Physical sizes of images from pixels: manual_scale or marker corners give the scale.

    Input columns: bbox_width_px, bbox_height_px, mask_area_px, manual_scale, corners.
    """
    scaled = images.withColumn("scale", effective_scale("manual_scale", "corners", marker_size_cm))
    return scaled.select(
        "*",
        to_physical("bbox_width_px", "scale").alias("bbox_width_cm"),
        to_physical("bbox_height_px", "scale").alias("bbox_height_cm"),
        to_physical_area("mask_area_px", "scale").alias("mask_area_cm2"),
        F.when(F.col("scale").isNull(), "no marker and no manual factor: pixel values only").alias("warning"),
    )


def measure_rows(pairs: DataFrame) -> DataFrame:
    """Length and height from the lateral image, width from the superior one, and the index.

    `pairs` has the structs `lateral` and `superior` and the weight `peso_g`.
    """
    out = pairs.select(
        "*",
        F.col("lateral.bbox_width_cm").alias("comprimento_cm"),
        F.col("lateral.bbox_height_cm").alias("altura_cm"),
        F.col("superior.bbox_height_cm").alias("largura_cm"),
    )
    return out.withColumn("kvol", kvol("peso_g", "comprimento_cm", "altura_cm", "largura_cm"))


def metric_series(df: DataFrame, time: str, metrics: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """Long series (keys, metric, time, value) of the non-null values."""
    stack = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    )
    return df.select(*keys, F.col(time).alias("at"), stack.alias("_m")).select(
        *keys, "_m.metric", "at", "_m.value"
    ).filter(F.col("value").isNotNull())


def finished_images(images: DataFrame, tag: str) -> DataFrame:
    return images.filter((F.col("processing_status") == "done") & (F.col("tag") == tag))


def series_with_bounds(series: DataFrame, keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    """Series with minimum, maximum and drawing range of its panel.

    The bounds are aggregated first and joined, so a long panel stays spread.
    """
    bounds = series.groupBy(*keys).agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    span = F.col("max_value") - F.col("min_value")
    return series.join(bounds, list(keys)).withColumn(
        "value_range", F.when(span == 0, 1.0).otherwise(span)
    )
