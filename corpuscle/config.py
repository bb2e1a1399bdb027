"""Tunable constants. Values are calibrated; change them per corpus, not in code."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    embedding_dimensions: int = 1536
    chunk_size: int = 1200
    chunk_overlap: int = 200
    retrieval_k: int = 40
    retrieval_k_retry: int = 40

    # Context selection thresholds (cosine similarity) and caps.
    strong_similarity: float = 0.65
    refusal_floor: float = 0.53
    absolute_floor: float = 0.45
    relative_margin: float = 0.08
    context_min_chunks: int = 8
    context_max_chunks: int = 16
    context_char_budget: int = 22000
    citation_max_files: int = 3

    companions_enabled: bool = True
    companion_max_total: int = 3
    companion_top_files: int = 3

    hybrid_enabled: bool = False
    rrf_k: int = 60
    discriminative_max_doc_freq: float = 0.20

    multi_query_enabled: bool = False
    multi_query_variants: int = 3

    min_chunk_chars: int = 120
    min_words_per_page: int = 120
    max_isolated_number_ratio: float = 0.05
    max_sparse_page_ratio: float = 0.5
    min_document_chars: int = 50

    history_pairs: int = 10
    history_item_chars: int = 4000

    starvation_chunks: int = 6
    job_stale_seconds: int = 300

    # Upper bound for anything shipped to every executor. A side larger than
    # this takes the shuffled plan instead.
    broadcast_max_bytes: int = 64 * 1024 * 1024


DEFAULTS = Settings()


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it in `spark.checkpoint.dir`.

    A local session (unit tests) may name none and gets a folder that goes when the process ends. On a
    cluster a machine's own folder would hold a part of the rows each, so there the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="corpuscle-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


_open = threading.local()  # per thread the paths of each open `temporary` block, the innermost last


def _blocks() -> list[list[str]]:
    if not hasattr(_open, "blocks"):
        _open.blocks = []
    return _open.blocks


@contextmanager
def temporary(spark: SparkSession):
    """What `scratch_path` and `materialize` name inside goes when the block ends: nothing that is read later may need it."""
    paths: list[str] = []
    _blocks().append(paths)
    try:
        yield
    finally:
        _blocks().pop()
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str, outlives: bool = False) -> str:
    """A fresh path under the shared folder for one written intermediate; `outlives` leaves it to the block around the innermost."""
    unique = spark._jvm.java.util.UUID.randomUUID().toString()
    path = os.path.join(shared_dir(spark), f"{name}-{unique}")
    blocks = _blocks()[: -1 if outlives else None]
    if blocks:
        blocks[-1].append(path)
    return path


def materialize(df, name: str, outlives: bool = False):
    """Write `df` once to the shared folder and read it back.

    Used where one intermediate feeds several branches: the written table cuts
    the lineage and survives the loss of an executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name, outlives)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def configured(spark: SparkSession, name: str, value: str):
    """A setting of the session for the jobs inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def tidy(spark: SparkSession):
    """Shuffle files go as soon as the query that wrote them has ended: what a later job needs is a written table."""
    return configured(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def broadcast_if_small(df, row_bytes: int, settings: Settings = DEFAULTS):
    """`df` marked for broadcast if its rows, counted up to the bound, fit; else unmarked."""
    bound = settings.broadcast_max_bytes // row_bytes
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df
