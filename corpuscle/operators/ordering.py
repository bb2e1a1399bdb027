"""Positions, running sums and top-k that stay spread when one key is huge.

A window partitioned by a key puts all rows of that key into one task. Here the
rows of a key are cut into value ranges of bounded size first (`bucket`, an
expression that grows with the order). Only one total per range meets in the
window over the key; rows meet only those of their own range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_before(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    bucket: Column,
    values: dict[str, Column],
) -> DataFrame:
    """Add per name the sum of its value over all earlier rows of the same key.

    Keys and buckets must not be null. The rows are shuffled once, by key and range; the
    totals of the ranges are summed before their shuffle and join on the same partitioning.
    """
    marked = df.withColumn("_bucket", bucket).withColumns({f"_v_{n}": v for n, v in values.items()})
    totals = marked.groupBy(*keys, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    over_ranges = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(over_ranges), F.lit(0)).alias(f"_o_{n}") for n in values]
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = marked.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in values})
    joined = local.join(offsets, [*keys, "_bucket"]).withColumns(
        {n: F.col(f"_l_{n}") + F.col(f"_o_{n}") for n in values}
    )
    return joined.select(*[c for c in df.columns if c not in values], *values)


def numbered(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str) -> DataFrame:
    """Add `name`: the 0-based, gap-free position of the row within its key."""
    return running_before(df, keys, order, bucket, {name: F.lit(1).cast("bigint")})


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """0-based rank within groups that are bounded by construction (top-k lists)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w) - 1)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per key.

    Spark applies the limit inside every map task before the shuffle, so a hot
    key sends at most k rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).withColumn(
        name, F.col("_rn") - 1
    ).drop("_rn")


def first_appearance(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One row per key: the one with the lowest position (stable de-duplication)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(position)).alias("_first")).select(
        *keys, "_first.*"
    )
