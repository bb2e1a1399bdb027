"""Corpus administration over the chunk table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.corpus import CHUNKING, candidates, embedder
from catalog.fixtures import CHUNKS, chunks, events, sql_ts, table, ts
from catalog.scalars import META, metadata
from corpuscle.operators import admin as ad
from corpuscle.operators import tables as tb
from corpuscle.operators.ordering import numbered
from corpuscle.plans.reindex import reindex_files
from corpuscle.sources.writers import chunk_columns

SUMMARIES = """summaries AS (
  SELECT original_file_id, min_by(original_file_name, id) AS original_file_name,
    arg_min(storage_bucket, coalesce(chunk_index, 1000000000 + id)) AS storage_bucket,
    any_value(storage_path) AS storage_path, count(*) AS total_chunks,
    count(*) FILTER (deleted_at IS NULL) AS active_chunks, count(*) FILTER (deleted_at IS NOT NULL) AS deleted_chunks,
    max(deleted_at) AS deleted_at,
    min(coalesce(first_ingested_at, created_at)) FILTER (deleted_at IS NULL) AS created_at,
    max(created_at) FILTER (deleted_at IS NULL) AS last_ingested_at
  FROM chunks GROUP BY original_file_id)"""


@query("file_summaries", f"""WITH {CHUNKS},{SUMMARIES}
    SELECT original_file_id, original_file_name, storage_bucket, storage_path, total_chunks, active_chunks, deleted_chunks,
      {sql_ts('deleted_at')}, {sql_ts('created_at')}, {sql_ts('last_ingested_at')},
      CASE WHEN active_chunks > 0 THEN 'active' ELSE 'deleted' END AS status FROM summaries""")
def file_summaries(spark, d):
    out = ad.newest_first(ad.file_summaries(chunks(spark, d)))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("deleted_at", "created_at", "last_ingested_at")})


@query("cleanup_preview", f"""WITH {CHUNKS},{SUMMARIES} SELECT count(*) AS total_files_processed, sum(total_chunks)::BIGINT AS total_documents_deleted,
      count(*) FILTER (storage_bucket IS NOT NULL AND storage_path IS NOT NULL) AS total_storage_deleted, true AS dry_run FROM summaries""")
def cleanup_preview(spark, d):
    return ad.cleanup_preview(ad.file_summaries(chunks(spark, d)))


@query("file_chunks", f"""WITH {CHUNKS} SELECT id, row_number() OVER (ORDER BY chunk_index NULLS LAST, page NULLS LAST, created_at NULLS LAST, id) - 1 AS place
    FROM chunks WHERE original_file_id = 'src3'""")
def file_chunks(spark, d):
    """The listing of one file; its order is made visible by a position."""
    rows = ad.file_chunks(chunks(spark, d), "src3")
    stretch = F.struct(F.col("chunk_index").isNull(), F.floor(F.coalesce("chunk_index", "page") / 1000))
    return numbered(rows, ["original_file_id"], ad.listing_order(), stretch, "place").select("id", "place")


@query("recover_content", f"""WITH {CHUNKS}, a AS (SELECT original_file_id, bool_or(deleted_at IS NULL) AS any_active FROM chunks GROUP BY 1)
    , placed AS (SELECT c.*, chunk_index IS NULL AS unplaced, coalesce(chunk_index // 1000, page // 1000) AS part
      FROM chunks c JOIN a USING (original_file_id) WHERE deleted_at IS NULL OR NOT any_active),
    cut AS (SELECT *, (row_number() OVER (PARTITION BY original_file_id, unplaced, part ORDER BY chunk_index, page, created_at, id) - 1) // 1000 AS piece FROM placed)
    SELECT original_file_id, unplaced, part, piece, count(*) AS chunks,
      md5(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index, page, created_at, id)) AS content_hash FROM cut GROUP BY 1, 2, 3, 4""")
def recover_content(spark, d):
    rows = ad.recover_content(chunks(spark, d))
    return rows.select("original_file_id", "unplaced", "part", "piece", "chunks", F.md5("content").alias("content_hash"))


@query("diagnose", f"""WITH {CHUNKS},{SUMMARIES} SELECT original_file_id, original_file_name, total_chunks, active_chunks, deleted_chunks, true AS has_table_data,
      storage_path IS NOT NULL AS has_storage, active_chunks > 0 AS recoverable_from_table, storage_path IS NOT NULL AS recoverable_from_storage,
      active_chunks > 0 AND storage_path IS NOT NULL AS recoverable_from_both, NOT (active_chunks > 0) AND storage_path IS NULL AS recoverable_from_none FROM summaries""")
def diagnose(spark, d):
    return ad.diagnose(ad.file_summaries(chunks(spark, d)))


@query("new_files", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_files(spark, d):
    return ad.new_files(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), file="doc_id")


@query("already_ingested", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def already_ingested(spark, d):
    return ad.already_ingested(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


REQUESTED = "requested AS (SELECT DISTINCT CASE WHEN lang = 'es' THEN source || '-gone' ELSE source END AS original_file_id FROM documents)"


def requested(spark, d):
    name = F.when(F.col("lang") == "es", F.concat("source", F.lit("-gone"))).otherwise(F.col("source"))
    return table(spark, d, "documents").select(name.alias("original_file_id"))


@query("reindex_targets", f"""WITH {CHUNKS},{SUMMARIES},{REQUESTED}
    SELECT original_file_id, s.original_file_name, CASE WHEN s.total_chunks IS NULL OR s.storage_path IS NULL THEN 'failed' ELSE 'ready' END AS status,
      CASE WHEN s.total_chunks IS NULL THEN 'Arquivo não encontrado' WHEN s.storage_path IS NULL THEN 'Arquivo original não está no Storage — não é possível reindexar.' END AS message
    FROM requested LEFT JOIN summaries s USING (original_file_id)""")
def reindex_targets(spark, d):
    return ad.reindex_targets(requested(spark, d), ad.file_summaries(chunks(spark, d)))


NEW = """fresh AS (SELECT doc_id + 1000000 AS id, source AS original_file_id FROM documents WHERE lang = 'en'),
  outcome AS (SELECT DISTINCT source AS original_file_id, length(source) > 4 AS ok FROM documents)"""


@query("replace_versions", f"""WITH {CHUNKS},{NEW}, f AS (
      SELECT original_file_id, min(coalesce(first_ingested_at, created_at)) AS first_at FROM chunks GROUP BY 1),
    r AS (SELECT DISTINCT original_file_id FROM fresh JOIN outcome USING (original_file_id) WHERE ok)
    SELECT id, original_file_id, {sql_ts('first_ingested_at')} FROM chunks WHERE original_file_id NOT IN (SELECT * FROM r)
    UNION ALL
    SELECT id, original_file_id, {sql_ts('first_at')} FROM fresh JOIN r USING (original_file_id) JOIN f USING (original_file_id)""")
def replace_versions(spark, d):
    """English documents as new versions of their sources; sources with a short name fail."""
    rows = chunks(spark, d)
    en = table(spark, d, "documents").filter("lang = 'en'").select("doc_id")
    fresh = (
        rows.join(en.withColumnRenamed("doc_id", "id"), "id", "left_semi")
        .withColumn("id", F.col("id") + 1000000)
        .withColumn("first_ingested_at", F.lit(None).cast("timestamp"))
    )
    status = F.when(F.length("original_file_id") > 4, "success").otherwise("failed")
    results = rows.select("original_file_id").distinct().withColumn("status", status)
    out = ad.replace_versions(rows, fresh, results)
    return out.select("id", "original_file_id", ts("first_ingested_at"))


@query("reindex_report", """WITH t AS (SELECT count(*) FILTER (quality = 1) AS processed_files, count(*) FILTER (quality = 0) AS failed_files,
      sum(CASE WHEN quality = 1 THEN doc_id ELSE 0 END)::BIGINT AS total_chunks_created FROM labels)
    SELECT *, CASE WHEN failed_files = 0 THEN 'success' WHEN processed_files > 0 THEN 'partial_failure' ELSE 'error' END AS status,
      processed_files || ' arquivo(s) reindexado(s), ' || failed_files || ' falha(s).' AS message FROM t""")
def reindex_report(spark, d):
    results = table(spark, d, "labels").select(
        F.when(F.col("quality") == 1, "success").otherwise("failed").alias("status"), F.col("doc_id").alias("chunks_created")
    )
    return ad.reindex_report(results)


@query("reindex_files", f"""WITH {CHUNKS},{SUMMARIES}, w AS (SELECT source, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n,
        len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_matches(w, '^\\d+([.,]\\d+)?$'))) AS num, length(text) AS c FROM documents),
    q AS (SELECT source, count(*) FILTER (n < 20 OR num::DOUBLE / greatest(n, 1) > 0.05)::DOUBLE / count(*) <= 0.5 AS ok FROM w GROUP BY source)
    SELECT original_file_id, original_file_name, CASE WHEN storage_path IS NOT NULL AND ok THEN 'success' ELSE 'failed' END AS status,
      CASE WHEN storage_path IS NOT NULL AND ok THEN total_chunks ELSE 0 END AS chunks_removed
    FROM summaries JOIN q ON q.source = original_file_id""")
def reindex_all(spark, d):
    """Every source chunked again from its documents as pages."""
    rows = chunk_columns(chunks(spark, d, vectors=True))
    pages = table(spark, d, "documents").select(
        F.col("source").alias("file_id"), F.lit("pypdf").alias("method"), F.col("doc_id").alias("page"), "text"
    )
    out = reindex_files(rows, pages, embedder(), settings=CHUNKING)
    return out.results.select("original_file_id", "original_file_name", "status", "chunks_removed")


@query("backfill_ids", f"WITH {META} SELECT doc_id, CASE WHEN n_chars > 800 THEN 'kept' ELSE fid END AS original_file_id, name AS original_file_name FROM named")
def backfill_ids(spark, d):
    n = table(spark, d, "documents").select("doc_id", "n_chars")
    rows = metadata(spark, d).join(n, "doc_id").select(
        "doc_id", "metadata", F.when(F.col("n_chars") > 800, "kept").alias("original_file_id"), F.lit(None).cast("string").alias("original_file_name")
    )
    return ad.backfill_ids(rows).select("doc_id", "original_file_id", "original_file_name")


@query("where_meta", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '69'")
def where_meta(spark, d):
    return ad.where_meta(events(spark, d), "k", "69", "props").select("event_id")


@query("delete_rows", "SELECT doc_id, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS deleted FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_rows(spark, d):
    ids = table(spark, d, "labels").filter("toxic = 1").select("doc_id")
    left, gone = tb.delete_rows(table(spark, d, "documents"), ids, "doc_id")
    return left.select("doc_id").withColumn("deleted", gone.scalar())


@query("rollback_file", f"WITH {CHUNKS} SELECT id FROM chunks WHERE original_file_id NOT IN (SELECT source FROM documents GROUP BY source HAVING max(n_chars) > 20000)")
def rollback_file(spark, d):
    failed = table(spark, d, "documents").groupBy("source").agg(F.max("n_chars").alias("n")).filter("n > 20000")
    return tb.rollback_file(chunks(spark, d), failed.select(F.col("source").alias("original_file_id"))).select("id")
