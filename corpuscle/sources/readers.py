"""Scans: chunk table, files, pages, golden questions, evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions.identity import basename, object_path
from corpuscle.sources import digests

WHOLE = 1 << 26  # bytes of a file that one task reads as one value

CHUNK_SCHEMA = (
    "id string, content string, embedding array<float>, deleted_at timestamp, created_at timestamp, "
    "updated_at timestamp, first_ingested_at timestamp, n_chars int, digit_density double, page int, page_start int, page_end int, "
    "chunk_index bigint, start_index bigint, original_file_id string, original_file_name string, storage_bucket string, "
    "storage_path string, extraction_method string, metadata string"
)

GOLDEN_SCHEMA = (
    "id string, question string, history array<array<string>>, scope string, question_type string, "
    "expected_source_file string, expected_passages array<string>, must_mention array<string>"
)

_RUN_SCHEMA = (
    "run_id string, label string, mode string, k int, llm_expansion boolean, golden_set_version string, "
    "config map<string,string>, cost map<string,string>, summary map<string,string>, "
    "results array<struct<id:string, scope:string, "
    "retrieval:struct<recall:double, top_similarity:double, min_similarity:double, selected_count:int, "
    "context_chars:bigint, selection_reason:string, missed_passages:array<string>, retrieval_seconds:double>, "
    "generation:struct<refused:boolean, skeleton:boolean, refusal_correct:boolean, mention_coverage:double, "
    "citation_precision:double, citation_file_count:int, groundedness:double, answers_question:double, "
    "generation_seconds:double, cited_files:array<string>>>>"
)


def is_live() -> Column:
    """Rows a search may see. Both tests reach the Parquet scan."""
    return F.col("deleted_at").isNull() & F.col("embedding").isNotNull()


def scan_chunks(spark: SparkSession, path: str, live_only: bool = True) -> DataFrame:
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    return chunks.filter(is_live()) if live_only else chunks


def scan_files(spark: SparkSession, path: str, glob: str | None = None, whole: int = WHOLE) -> DataFrame:
    """Files as bytes, with the hash of the bytes as identity.

    Files of over `whole` bytes are hashed at once, stretch by stretch, and their content is only read if it is asked for. Packed ones and
    those with very long lines are hashed as one value like small ones.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    hashed = F.sha2("content", 256).alias("id")
    rows = files.select("*", hashed)
    large = files.filter(F.col("length") > whole).select("path", "length").collect() if digests.available() else []
    if large:
        plain = [(r.path, r.length) for r in large if not digests.PACKED.search(r.path)]
        ids = [x for x in digests.file_digests(spark, plain) if x[1]]
        known = F.broadcast(spark.createDataFrame(ids, "path string, id string"))
        rows = rows.filter(F.col("length") <= whole).unionByName(files.filter(F.col("length") > whole).join(known, "path"))
        as_one = sorted({r.path for r in large} - {path for path, _ in ids})
        if as_one:
            rows = rows.unionByName(reader.load([digests.literal(x) for x in as_one]).select("*", hashed))
    return rows.select(
        "path", "modificationTime", "length", "content", F.col("id").alias("original_file_id"), basename("path").alias("original_file_name")
    )


def with_object_path(files: DataFrame) -> DataFrame:
    return files.withColumn("storage_path", object_path("original_file_id", "original_file_name"))


def split_pages(
    documents: DataFrame, lines_per_page: int = 40, file: str = "file_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """Pages of documents that are one string each: groups of lines, 0-based page."""
    lines = F.split(text, "\n")
    pages = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / lines_per_page).cast("int")),
        lambda p: F.array_join(F.slice(lines, p * lines_per_page + 1, lines_per_page), "\n"),
    )
    return documents.select(file, source, F.posexplode(pages).alias("page", "text"))


def scan_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """One row per (file, page) with its text."""
    return spark.read.format(fmt).schema("file_id string, source string, page int, text string").load(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions, one JSON object per line. Missing lists are empty."""
    raw = spark.read.schema(GOLDEN_SCHEMA).json(path)
    empty = F.array().cast("array<string>")
    return raw.select(
        F.col("id").alias("qid"),
        "question",
        F.coalesce("history", F.array().cast("array<array<string>>")).alias("history"),
        "scope",
        "question_type",
        "expected_source_file",
        F.coalesce("expected_passages", empty).alias("expected_passages"),
        F.coalesce("must_mention", empty).alias("must_mention"),
    )


def _read_run_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_RUN_SCHEMA).option("multiLine", "true").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation runs as one row per question."""
    runs = _read_run_files(spark, path)
    return runs.select("run_id", "label", "mode", F.explode("results").alias("r")).select(
        "run_id", "label", "mode", F.col("r.id").alias("qid"), F.col("r.scope").alias("scope"), "r.retrieval.*", "r.generation.*"
    )


def read_run_values(spark: SparkSession, path: str) -> DataFrame:
    """Config and summary of runs as (run_id, section, name, value), for comparison.

    Runs of the older form keep two settings outside their config.
    """
    runs = _read_run_files(spark, path)
    legacy = F.map_filter(
        F.create_map(
            F.lit("retrieval_k"), F.col("k").cast("string"),
            F.lit("use_llm_expansion"), F.col("llm_expansion").cast("string"),
        ),
        lambda name, v: v.isNotNull() & ~F.coalesce(F.map_contains_key("config", name), F.lit(False)),
    )
    config = F.map_concat(F.coalesce("config", F.create_map().cast("map<string,string>")), legacy)
    with_mode = F.map_concat(
        F.map_filter(config, lambda name, _: name != "mode"), F.create_map(F.lit("mode"), F.col("mode"))
    )
    sections = runs.select(
        "run_id", F.explode(F.create_map(F.lit("config"), with_mode, F.lit("summary"), F.col("summary"))).alias("section", "_m")
    )
    return sections.select("run_id", "section", F.explode("_m").alias("name", "value"))
