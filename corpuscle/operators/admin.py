"""Corpus administration: roll-ups, listings, recovery, diagnosis, reindexing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.config import broadcast_if_small, materialize
from corpuscle.operators.ordering import numbered

_RECOVERY_PART = 1000  # chunks per recovered part


def file_summaries(chunks: DataFrame) -> DataFrame:
    """One row per file. Reads neither contents nor vectors.

    The name and the stored object come from the file's first chunk (chunk_index, id).
    """
    active = F.col("deleted_at").isNull()
    ingested = F.coalesce("first_ingested_at", "created_at") if "first_ingested_at" in chunks.columns else F.col("created_at")
    head = F.struct("original_file_name", "storage_bucket", "storage_path")
    out = chunks.groupBy("original_file_id").agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.count_if(active).alias("active_chunks"),
        F.count_if(~active).alias("deleted_chunks"),
        F.max("deleted_at").alias("deleted_at"),
        F.min(F.when(active, ingested)).alias("created_at"),
        F.max(F.when(active, F.col("created_at"))).alias("last_ingested_at"),
        F.min_by(head, F.struct(F.col("chunk_index").isNull(), "chunk_index", "id")).alias("_head"),
    )
    return out.select(
        "original_file_id",
        "_head.*",
        "total_chunks",
        "active_chunks",
        "deleted_chunks",
        "deleted_at",
        "created_at",
        "last_ingested_at",
        F.when(F.col("active_chunks") > 0, "active").otherwise("deleted").alias("status"),
    )


def newest_first(summaries: DataFrame) -> DataFrame:
    return summaries.orderBy(F.desc_nulls_last("last_ingested_at"), "original_file_id")


def _has_object() -> Column:
    return (F.coalesce("storage_bucket", F.lit("")) != "") & (F.coalesce("storage_path", F.lit("")) != "")


def cleanup_preview(summaries: DataFrame) -> DataFrame:
    """What a full cleanup would remove, without removing it."""
    return summaries.agg(
        F.count(F.lit(1)).alias("total_files_processed"),
        F.coalesce(F.sum("total_chunks"), F.lit(0)).alias("total_documents_deleted"),
        F.count_if(_has_object()).alias("total_storage_deleted"),
        F.lit(True).alias("dry_run"),
    )


def listing_order() -> list[Column]:
    return [F.asc_nulls_last(c) for c in ("chunk_index", "page", "created_at")] + [F.asc("id")]


def file_chunks(chunks: DataFrame, file_id: str) -> DataFrame:
    """Chunks of one file in reading order; missing positions last."""
    return chunks.filter(F.col("original_file_id") == file_id).orderBy(*listing_order())


def recover_content(chunks: DataFrame) -> DataFrame:
    """The text of every file from its active chunks, or from all when none is active.

    One row per (file, part, piece): a part is a range of chunk positions (of pages, or all else, where there is no position), and
    a part of many rows, such as chunks without any place, is cut into pieces of `_RECOVERY_PART` rows in its order. So no row of
    the result holds more, however a file was written. The parts and pieces of a file, in order and joined by a
    blank line, are its text. Chunks without a position come after the others.
    """
    active = F.col("deleted_at").isNull()
    any_active = chunks.groupBy("original_file_id").agg(F.bool_or(active).alias("_any"))
    rows = chunks.join(any_active, "original_file_id").filter(active | ~F.col("_any")).select(
        "original_file_id",
        F.col("chunk_index").isNull().alias("unplaced"),
        F.coalesce(F.floor(F.col("chunk_index") / _RECOVERY_PART), F.floor(F.col("page") / _RECOVERY_PART), F.lit(-1)).alias("part"),
        "chunk_index", "page", "created_at", "id", "content",
    )
    keys = ["original_file_id", "unplaced", "part"]
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > _RECOVERY_PART).drop("_n")
    large = broadcast_if_small(materialize(large, "large-parts"), 256)
    small = rows.join(large, keys, "left_anti").withColumn("piece", F.lit(0).cast("bigint"))
    # Rows of large parts are cut by splitters of their whole order; the number of a range is its place in the part.
    ranged = rows.join(large, keys, "left_semi").repartitionByRange(*keys, *listing_order())
    ranged = materialize(ranged.withColumn("_range", F.spark_partition_id()), "large-part-rows")
    cut = numbered(ranged, keys, listing_order(), F.col("_range"), "_at").withColumn("piece", F.floor(F.col("_at") / _RECOVERY_PART))
    ordered = F.array_sort(
        F.collect_list(
            F.struct(
                F.coalesce("chunk_index", F.lit(2**31 - 1)).alias("a"),
                F.coalesce("page", F.lit(2**31 - 1)).alias("b"),
                F.col("created_at").isNull().alias("c"),
                F.col("created_at").alias("d"),
                F.col("id").alias("e"),
                F.col("content").alias("text"),
            )
        )
    )
    return small.unionByName(cut.drop("_range", "_at")).groupBy(*keys, "piece").agg(
        F.array_join(F.transform(ordered, lambda r: r["text"]), "\n\n").alias("content"),
        F.count(F.lit(1)).alias("chunks"),
    ).select(*keys, "piece", "chunks", "content")


def diagnose(summaries: DataFrame) -> DataFrame:
    """From where a file could be recovered. The stored object is that of the file summary."""
    table, storage = F.col("active_chunks") > 0, _has_object()
    return summaries.select(
        "original_file_id",
        "original_file_name",
        "total_chunks",
        "active_chunks",
        "deleted_chunks",
        (F.col("total_chunks") > 0).alias("has_table_data"),
        storage.alias("has_storage"),
        table.alias("recoverable_from_table"),
        storage.alias("recoverable_from_storage"),
        (table & storage).alias("recoverable_from_both"),
        (~table & ~storage).alias("recoverable_from_none"),
    )


def new_files(files: DataFrame, chunks: DataFrame, force: bool = False, file: str = "original_file_id") -> DataFrame:
    """Files that have no chunk yet; all of them when forced."""
    return files if force else files.join(chunks.select(file), file, "left_anti")


def already_ingested(files: DataFrame, chunks: DataFrame, file: str = "original_file_id") -> DataFrame:
    return files.join(chunks.select(file), file, "left_semi")


def reindex_targets(requested: DataFrame, summaries: DataFrame) -> DataFrame:
    """Verdict per requested file: ready, or failed with the reason."""
    known = summaries.select("original_file_id", "original_file_name", "storage_bucket", "storage_path", "total_chunks")
    joined = requested.select("original_file_id").distinct().join(known, "original_file_id", "left")
    message = F.when(F.col("total_chunks").isNull(), "Arquivo não encontrado").when(
        ~_has_object(), "Arquivo original não está no Storage — não é possível reindexar."
    )
    return joined.select(
        "original_file_id",
        "original_file_name",
        F.when(message.isNull(), "ready").otherwise("failed").alias("status"),
        message.alias("message"),
    )


def replace_versions(chunks: DataFrame, new_chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Chunk table after a reindex: files whose new set succeeded get it, all others stay.

    `results`: original_file_id, status. The date of the first ingest moves on to the new rows.
    """
    done = results.filter(F.col("status") == "success").select("original_file_id").distinct()
    first = (
        chunks.join(done, "original_file_id", "left_semi")
        .groupBy("original_file_id")
        .agg(F.min(F.coalesce("first_ingested_at", "created_at")).alias("_first"))
    )
    fresh = (
        new_chunks.join(done, "original_file_id", "left_semi")
        .join(first, "original_file_id", "left")
        .withColumn("first_ingested_at", F.coalesce("_first", "first_ingested_at"))
        .select(*chunks.columns)
    )
    replaced = fresh.select("original_file_id").distinct()
    return chunks.join(replaced, "original_file_id", "left_anti").unionByName(fresh)


def reindex_report(results: DataFrame) -> DataFrame:
    """One row: processed, failed, chunks created, overall status and message."""
    ok = F.col("status") == "success"
    totals = results.agg(
        F.count_if(ok).alias("processed_files"),
        F.count_if(~ok).alias("failed_files"),
        F.coalesce(F.sum(F.when(ok, F.col("chunks_created"))), F.lit(0)).alias("total_chunks_created"),
    )
    done, failed = F.col("processed_files"), F.col("failed_files")
    return totals.withColumn(
        "status",
        F.when(failed == 0, "success").when(done > 0, "partial_failure").otherwise("error"),
    ).withColumn(
        "message",
        F.when((failed == 0) & (done == 0), "Nenhum arquivo para reindexar.")
        .when(failed == 0, F.format_string("%d arquivo(s) reindexado(s) com sucesso.", done))
        .when(done > 0, F.format_string("%d arquivo(s) reindexado(s), %d falha(s).", done, failed))
        .otherwise(F.format_string("Todas as %d reindexações falharam.", failed)),
    )


def backfill_ids(chunks: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Fill missing file ids and names from the metadata; never overwrite a value."""
    out = chunks
    for name in ("original_file_id", "original_file_name"):
        out = out.withColumn(name, F.coalesce(name, F.get_json_object(metadata, f"$.{name}")))
    return out


def where_meta(df: DataFrame, key: str, value: str, metadata: str = "metadata") -> DataFrame:
    return df.filter(F.get_json_object(metadata, f"$.{key}") == value)


def ingest_report(files: DataFrame, existing: DataFrame, quality: DataFrame, valid: DataFrame, before: DataFrame, after: DataFrame, file: str = "file_id") -> DataFrame:
    """Outcome per file, first reason that applies: already_exists, extraction_failed, invalid, success.

    `existing`, `valid`: file ids; `quality`: file, adequate, pages; `before`, `after`: chunks
    before and after the filter.
    """
    n_before = before.groupBy(file).agg(F.count(F.lit(1)).alias("_before"))
    n_after = after.groupBy(file).agg(F.count(F.lit(1)).alias("_after"))
    joined = (
        files.select(file).distinct()
        .join(existing.select(file).distinct().withColumn("_old", F.lit(True)), file, "left")
        .join(quality.select(file, "adequate", F.col("pages").alias("pages_loaded")), file, "left")
        .join(valid.select(file).distinct().withColumn("_valid", F.lit(True)), file, "left")
        .join(n_before, file, "left")
        .join(n_after, file, "left")
    )
    status = (
        F.when(F.col("_old"), "already_exists")
        .when(~F.coalesce("adequate", F.lit(False)), "extraction_failed")
        .when(F.col("_valid").isNull(), "invalid_pdf")
        .otherwise("success")
    )
    stored = F.col("status") == "success"
    chunks_before, chunks = F.coalesce("_before", F.lit(0)), F.coalesce("_after", F.lit(0))
    return joined.withColumn("status", status).select(
        file,
        "status",
        F.coalesce("pages_loaded", F.lit(0)).alias("pages_loaded"),
        F.when(stored, chunks).otherwise(0).alias("chunks"),
        F.when(stored, chunks_before).otherwise(0).alias("chunks_before_filter"),
        F.when(stored, chunks_before - chunks).otherwise(0).alias("chunks_filtered_out"),
    )
