"""Lexical side: postings, document frequencies, lexical top-k."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.config import DEFAULTS, Settings, broadcast_if_small, materialize
from corpuscle.functions.questions import content_terms
from corpuscle.operators.ordering import top_k

# One matched occurrence weighs 0.1; the score c / (c + 1) then lies in 0..1.
OCCURRENCE_WEIGHT = 0.1
_TERM_ROW_BYTES = 128


def _max_terms(settings: Settings) -> int:
    return settings.broadcast_max_bytes // _TERM_ROW_BYTES


def build_postings(chunks: DataFrame, id_col: str = "id", content: str = "content", fold: bool = False) -> DataFrame:
    """(term, id, tf). All words of a chunk are in one task, so the sum before the
    shuffle already yields the final rows."""
    words = chunks.select(id_col, F.explode(content_terms(content, fold)).alias("term"))
    return words.groupBy("term", id_col).agg(F.count(F.lit(1)).alias("tf"))


TERM_BUCKETS = 256
_SHARES = 8


def _bucket(term: str = "term", buckets: int = TERM_BUCKETS):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_postings(postings: DataFrame, path: str, buckets: int = TERM_BUCKETS, mode: str = "append") -> None:
    """Add postings to a stored index: by bucket of the term, sorted by term, the rows of a frequent term over several files.

    Every ingest batch appends its own files; `hide_postings` takes chunks out again (stored beside, under `path`.hidden).
    """
    id_col = postings.columns[1]
    placed = postings.withColumn("_bucket", _bucket(buckets=buckets)).withColumn("_share", F.pmod(F.xxhash64(id_col), F.lit(_SHARES)))
    ordered = placed.repartition("_bucket", "_share").sortWithinPartitions("_bucket", "term").drop("_share")
    ordered.write.mode(mode).partitionBy("_bucket").parquet(path)


def hide_postings(ids: DataFrame, path: str) -> None:
    """Mark chunks (one column) as deleted or replaced: the index gives them no more."""
    ids.distinct().write.mode("append").parquet(f"{path}.hidden")


def asked_postings(spark: SparkSession, path: str, terms: DataFrame, schema: T.StructType, buckets: int = TERM_BUCKETS, settings: Settings = DEFAULTS) -> DataFrame:
    """The stored postings (of `schema`: term, id, tf) of the asked terms; only the buckets of these terms are read, no text is.

    Hidden chunks are left out; with very many of them the postings found meet them by id.
    """
    asked = materialize(terms.select("term").distinct().withColumn("_bucket", _bucket(buckets=buckets)), "asked-terms")
    wanted = sorted(r[0] for r in asked.select("_bucket").distinct().collect())  # at most `buckets` numbers
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(path)
    found = stored.filter(F.col("_bucket").isin(wanted)).drop("_bucket")
    found = found.join(broadcast_if_small(asked.select("term"), _TERM_ROW_BYTES, settings), "term", "left_semi")
    id_col = schema.names[1]
    try:
        hidden = spark.read.schema(T.StructType([schema[id_col]])).parquet(f"{path}.hidden")
    except AnalysisException:  # nothing was hidden yet
        return found
    return found.join(broadcast_if_small(hidden, 64, settings), id_col, "left_anti").select(*schema.names)


def explode_terms(questions: DataFrame, terms: str = "terms", qid: str = "qid") -> DataFrame:
    return questions.select(qid, F.explode(terms).alias("term"))


def lexical_topk(
    query_terms: DataFrame,
    postings: DataFrame,
    k: int = DEFAULTS.retrieval_k,
    qid: str = "qid",
    id_col: str = "id",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Chunks that hold any query term, best first: qid, id, lexical_score, rank.

    Terms within the broadcast bound: the postings asked for are brought together by chunk,
    once each and not once per question; a chunk's score for every question is then summed
    inside one task, and each task sends on its k best rows per question only. More terms
    than that meet the postings by term, where the planner splits a hot one, and the scores
    meet by (question, chunk).
    """
    terms = query_terms.select(qid, "term")
    if terms.limit(_max_terms(settings) + 1).count() <= _max_terms(settings):
        asked = postings.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
        hits = asked.repartition(F.col(id_col)).join(F.broadcast(terms), "term")
    else:
        hits = postings.join(terms, "term")
    occurrences = hits.groupBy(qid, id_col).agg(F.sum("tf").alias("_n"))
    weight = F.col("_n") * F.lit(OCCURRENCE_WEIGHT)
    scored = occurrences.select(qid, id_col, (weight / (weight + 1)).alias("lexical_score"))
    return top_k(scored, [qid], [F.desc("lexical_score"), F.asc(id_col)], k)


def term_doc_freq(postings: DataFrame, terms: DataFrame, total_docs: DataFrame) -> DataFrame:
    """(term, doc_count, total_docs) for the distinct terms asked for; 0 when absent.

    `total_docs` is a one-row, one-column DataFrame, read as a scalar.
    """
    wanted = terms.select("term").distinct()
    counts = postings.join(wanted, "term", "left_semi").groupBy("term").agg(
        F.count(F.lit(1)).alias("doc_count")
    )
    return (
        wanted.join(counts, "term", "left")
        .withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))
        .withColumn("total_docs", total_docs.scalar())
    )


def has_discriminative_term(
    query_terms: DataFrame, frequencies: DataFrame, max_freq: float = DEFAULTS.discriminative_max_doc_freq, qid: str = "qid"
) -> DataFrame:
    """Per question: does some term occur, in at most `max_freq` of all chunks?"""
    freq = F.col("doc_count") / F.col("total_docs")
    rare = (F.col("total_docs") > 0) & (freq > 0) & (freq <= max_freq)
    return (
        query_terms.join(frequencies.select("term", F.coalesce(rare, F.lit(False)).alias("_rare")), "term")
        .groupBy(qid)
        .agg(F.bool_or("_rare").alias("discriminative"))
    )
