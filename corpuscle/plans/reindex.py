"""Reindexing: ingest chosen files again and replace their chunks where that succeeded."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.config import DEFAULTS, Settings
from corpuscle.operators import admin
from corpuscle.plans.ingest import ingest
from corpuscle.plans.models import EmbedFn


class Reindex(NamedTuple):
    chunks: DataFrame  # the whole chunk table after the change
    results: DataFrame  # one row per requested file
    report: DataFrame  # one row


def reindex_files(
    chunks: DataFrame,
    candidates: DataFrame,
    embed: EmbedFn,
    requested: DataFrame | None = None,
    settings: Settings = DEFAULTS,
    batch: str = "1",
    methods=None,
) -> Reindex:
    """Re-chunk the requested files (all when None) from their page candidates.

    The new table is returned; publish it by writing it aside and switching over. Old chunks
    leave only with their successor in place.
    """
    summaries = admin.file_summaries(chunks)
    wanted = requested if requested is not None else summaries.select("original_file_id")
    targets = admin.reindex_targets(wanted, summaries)
    ready = targets.filter(F.col("status") == "ready").select("original_file_id")
    files = summaries.join(ready, "original_file_id", "left_semi").select(
        F.col("original_file_id").alias("file_id"), F.col("original_file_name").alias("file_name"),
        "storage_bucket", "storage_path",
    )
    extra = {"methods": methods} if methods else {}
    fresh = ingest(candidates, files, chunks, embed, settings, force=True, batch=batch, **extra)
    outcome = fresh.report.select(
        F.col("file_id").alias("original_file_id"), F.col("status").alias("_status"), F.col("chunks").alias("_created")
    )
    old = summaries.select("original_file_id", F.col("total_chunks").alias("_old"))
    ok = F.col("_status") == "success"
    results = (
        targets.join(outcome, "original_file_id", "left")
        .join(old, "original_file_id", "left")
        .select(
            "original_file_id",
            "original_file_name",
            F.when(ok, "success").otherwise("failed").alias("status"),
            F.when(ok, "Arquivo reindexado com sucesso")
            .otherwise(F.coalesce("message", "_status", F.lit("Falha na reingestão")))
            .alias("message"),
            F.when(ok, F.col("_created")).otherwise(0).alias("chunks_created"),
            F.when(ok, F.col("_old")).otherwise(0).alias("chunks_removed"),
        )
    )
    table = admin.replace_versions(chunks, fresh.chunks, results)
    return Reindex(table, results, admin.reindex_report(results))
