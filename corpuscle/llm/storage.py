"""Disk use of operators that run several jobs."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession

from corpuscle.config import tidy  # noqa: F401

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2500):
    """Long texts reach Python in batches of a few MB, which bounds what a task holds at once. The jobs must end inside."""
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, str(min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)
