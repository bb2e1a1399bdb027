"""The given tables read as corpus tables, once for Spark and once as SQL.

A document is a chunk, its source is its file; an embedding of the same number is its
vector; a toxic label is a deletion mark. Benchmark items are the questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuscle.config import Settings

# Thresholds for the given vectors, whose best similarities lie between 0.3 and 0.5.
TEST = Settings(
    embedding_dimensions=64,
    strong_similarity=0.43,
    refusal_floor=0.38,
    absolute_floor=0.15,
    relative_margin=0.15,
    hybrid_enabled=True,
)


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose long texts are to be worked on.

    Each given table is one file with one row group, hence one task. Such a file is spread
    over the cores; a table of many files is left as it is.
    """
    df = table(spark, sf_dir, name)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    single = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    return df.repartition(spark.sparkContext.defaultParallelism) if single else df


def ts(column: str):
    """Timestamps are compared as text."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def sql_ts(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {name or column}"


# --- chunks ----------------------------------------------------------------------------------


def chunks(spark: SparkSession, d: str, vectors: bool = False, spread: bool = False) -> DataFrame:
    docs, labels = (texts if spread else table)(spark, d, "documents"), table(spark, d, "labels")
    out = docs.join(labels.select("doc_id", "toxic"), "doc_id", "left")
    created = F.timestamp_add("MINUTE", F.col("doc_id").cast("int"), F.lit("2024-01-01").cast("timestamp"))
    deleted = F.timestamp_add("MINUTE", F.col("doc_id").cast("int"), F.lit("2024-06-01").cast("timestamp"))
    columns = [
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        F.col("n_chars"),
        F.col("source").alias("original_file_id"),
        F.concat("source", F.lit(".txt")).alias("original_file_name"),
        F.when(F.length("source") > 4, "sources").alias("storage_bucket"),
        F.when(F.length("source") > 4, F.concat("source", F.lit(".pdf"))).alias("storage_path"),
        F.when(F.col("toxic") == 1, deleted).alias("deleted_at"),
        created.alias("created_at"),
        F.when(F.col("lang") == "de", F.timestamp_add("DAY", F.lit(-1), created)).alias("first_ingested_at"),
        F.when(F.col("lang") != "es", F.col("doc_id")).alias("chunk_index"),
        F.floor(F.col("doc_id") / 4).cast("int").alias("page"),
        F.floor(F.col("doc_id") / 4).cast("int").alias("page_start"),
        (F.floor(F.col("doc_id") / 4) + F.when(F.col("n_chars") > 3000, 1).otherwise(0)).cast("int").alias("page_end"),
    ]
    if vectors:
        out = out.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
        columns.append(F.col("embedding"))
    return out.select(*columns)


CHUNKS = """
chunks AS (
  SELECT d.doc_id AS id, d.text AS content, d.n_chars, d.source AS original_file_id,
    d.source || '.txt' AS original_file_name,
    CASE WHEN length(d.source) > 4 THEN 'sources' END AS storage_bucket,
    CASE WHEN length(d.source) > 4 THEN d.source || '.pdf' END AS storage_path,
    CASE WHEN l.toxic = 1 THEN TIMESTAMP '2024-06-01' + to_minutes(d.doc_id) END AS deleted_at,
    TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS created_at,
    CASE WHEN d.lang = 'de' THEN TIMESTAMP '2023-12-31' + to_minutes(d.doc_id) END AS first_ingested_at,
    CASE WHEN d.lang <> 'es' THEN d.doc_id END AS chunk_index,
    d.doc_id // 4 AS page, d.doc_id // 4 AS page_start,
    d.doc_id // 4 + CASE WHEN d.n_chars > 3000 THEN 1 ELSE 0 END AS page_end,
    e.embedding
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id
),
live AS (SELECT * FROM chunks WHERE deleted_at IS NULL AND embedding IS NOT NULL)"""


# --- pages -----------------------------------------------------------------------------------


def pages(spark: SparkSession, d: str, lines: int = 5) -> DataFrame:
    from corpuscle.sources.readers import split_pages

    docs = texts(spark, d).withColumnRenamed("doc_id", "file_id")
    return split_pages(docs, lines)


PAGES = """
doc_lines AS (SELECT doc_id AS file_id, source, string_split(text, chr(10)) AS ls FROM documents),
page_rows AS (
  SELECT file_id, source, p AS page, array_to_string(ls[p * 5 + 1 : p * 5 + 5], chr(10)) AS text
  FROM (SELECT *, unnest(generate_series(0, (len(ls) - 1) // 5)) AS p FROM doc_lines)
)"""


# --- questions -------------------------------------------------------------------------------


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("question"), F.col("text").alias("rewritten")
    )


def query_vectors(spark: SparkSession, d: str, variants: int = 3) -> DataFrame:
    """The vectors numbered like the question and the next ones are its variants."""
    q = table(spark, d, "benchmark").select(
        F.col("item_id").alias("qid"), F.explode(F.sequence(F.lit(0), F.lit(variants - 1))).alias("variant")
    )
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return q.withColumn("vec_id", F.col("qid") + F.col("variant")).join(e, "vec_id").drop("vec_id")


def own_rows(spark: SparkSession, d: str, variants: int = 3) -> DataFrame:
    """(qid, id) of the chunks whose vector is the question's own."""
    return query_vectors(spark, d, variants).select("qid", (F.col("qid") + F.col("variant")).alias("id"))


QVECS = """
qvecs AS (
  SELECT b.item_id AS qid, v.variant, e.embedding AS vec
  FROM benchmark b CROSS JOIN (SELECT unnest([0, 1, 2]) AS variant) v
  JOIN embeddings e ON e.vec_id = b.item_id + v.variant
)"""

# Candidates per variant without the question's own vectors, then one row per chunk.
VECTOR_HITS = f"""{QVECS},
sims AS (
  SELECT q.qid, q.variant, c.id,
    round(list_cosine_similarity(q.vec::DOUBLE[], c.embedding::DOUBLE[]), 9) AS similarity
  FROM qvecs q CROSS JOIN live c WHERE c.id NOT BETWEEN q.qid AND q.qid + 2
),
variant_hits AS (
  SELECT * FROM sims
  QUALIFY row_number() OVER (PARTITION BY qid, variant ORDER BY similarity DESC, id) <= 40
),
vector_hits AS (
  SELECT qid, id, similarity, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) - 1 AS rank
  FROM (SELECT qid, id, max(similarity) AS similarity FROM variant_hits GROUP BY qid, id)
)"""

_STOP = "('" + "','".join(__import__("corpuscle.functions.vocab", fromlist=["V"]).LEXICAL_STOPWORDS) + "')"

TERMS = f"""
terms AS (
  SELECT DISTINCT qid, term FROM (
    SELECT item_id AS qid, unnest(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+(?:\\.[0-9]+)*')) AS term
    FROM benchmark
  ) WHERE length(term) >= 2 AND term NOT IN {_STOP}
)"""

POSTINGS = r"""
postings AS (
  SELECT term, id, count(*) AS tf FROM (
    SELECT id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}]+(?:\.[0-9]+)*')) AS term FROM live
  ) GROUP BY term, id
)"""

LEXICAL_HITS = f"""{TERMS},{POSTINGS},
occurrences AS (SELECT qid, id, sum(tf) * 0.1 AS w FROM terms JOIN postings USING (term) GROUP BY qid, id),
lexical_hits AS (
  SELECT qid, id, lexical_score, row_number() OVER (PARTITION BY qid ORDER BY lexical_score DESC, id) - 1 AS rank
  FROM (SELECT qid, id, (w / (w + 1))::DOUBLE AS lexical_score FROM occurrences WHERE id NOT BETWEEN qid AND qid + 2)
  QUALIFY rank < 40
)"""

FUSED = f"""{VECTOR_HITS},{LEXICAL_HITS},
fused AS (
  SELECT qid, id, similarity, lexical_rank, rrf_score,
    row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, late, tie) - 1 AS rank
  FROM (
    SELECT coalesce(v.qid, l.qid) AS qid, coalesce(v.id, l.id) AS id, v.similarity,
      CASE WHEN v.id IS NULL THEN l.rank END AS lexical_rank,
      coalesce(1.0::DOUBLE / (60 + v.rank + 1), 0) + coalesce(1.0::DOUBLE / (60 + l.rank + 1), 0) AS rrf_score,
      (v.id IS NULL) AS late, coalesce(v.rank, l.rank) AS tie
    FROM vector_hits v FULL JOIN lexical_hits l ON v.qid = l.qid AND v.id = l.id
  )
)"""

SELECTED = f"""{FUSED},
s0 AS (
  SELECT f.*, c.n_chars, c.original_file_id, c.original_file_name, c.page_start, c.page_end,
    coalesce(max(CASE WHEN lexical_rank IS NULL THEN similarity END) OVER (PARTITION BY qid), 0) AS top
  FROM fused f JOIN live c USING (id)
),
s1 AS (
  SELECT *, (lexical_rank IS NOT NULL OR similarity >= greatest(0.15, top - 0.15)) AS keep FROM s0 WHERE top >= 0.38
),
s2 AS (
  SELECT *, count(*) FILTER (keep) OVER (PARTITION BY qid) AS kept,
    row_number() OVER (PARTITION BY qid ORDER BY rank) - 1 AS pos FROM s1
),
s3 AS (
  SELECT *, CASE WHEN kept < 8 THEN 'min_fill' ELSE 'relative_window' END AS selection_reason,
    row_number() OVER (PARTITION BY qid ORDER BY rank) - 1 AS position
  FROM s2 WHERE CASE WHEN kept < 8 THEN pos < 8 ELSE keep END
),
chosen AS (
  SELECT * FROM (
    SELECT *, sum(n_chars) OVER (PARTITION BY qid ORDER BY position) AS running FROM s3 WHERE position < 16
  ) WHERE position < 8 OR running <= 22000
),
frequencies AS (
  SELECT term, count(p.id) AS doc_count, (SELECT count(*) FROM live) AS total_docs
  FROM (SELECT DISTINCT term FROM terms) LEFT JOIN postings p USING (term) GROUP BY term
),
coverage AS (
  SELECT qid, bool_or(doc_count > 0 AND doc_count::DOUBLE / total_docs <= 0.2) AS discriminative
  FROM terms JOIN frequencies USING (term) GROUP BY qid
),
top_raw AS (SELECT qid, max(similarity) AS top_similarity_raw, count(*) AS candidate_count FROM vector_hits GROUP BY qid),
uncovered AS (
  SELECT qid FROM top_raw JOIN coverage USING (qid)
  WHERE top_similarity_raw >= 0.38 AND top_similarity_raw < 0.43 AND NOT discriminative
),
selected AS (SELECT * FROM chosen WHERE qid NOT IN (SELECT qid FROM uncovered))"""


# --- measurements ----------------------------------------------------------------------------


def images(spark: SparkSession, d: str) -> DataFrame:
    """Line items as images: one per (order, line), odd lines lateral, even ones superior."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.when(F.max("l_tax") >= 0.07, F.min("l_suppkey")).otherwise(F.col("l_orderkey") % 97).alias("user_id"),
        F.max("l_shipdate").cast("timestamp").alias("uploaded_at"),
        F.max("l_extendedprice").alias("bbox_width_px"),
        (F.max("l_quantity") * 10).alias("bbox_height_px"),
        (F.max("l_quantity") * F.max("l_extendedprice")).alias("mask_area_px"),
        F.max("l_discount").alias("disc"),
        F.max("l_tax").alias("tax"),
        F.max("l_returnflag").alias("flag"),
    )
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("analysis_id"),
        "user_id",
        F.when(F.col("l_linenumber") % 2 == 1, "lateral").otherwise("superior").alias("tag"),
        "uploaded_at",
        "bbox_width_px", "bbox_height_px", "mask_area_px",
        F.when(F.col("disc") > 0.02, 100 + F.col("disc") * 1000).alias("manual_scale"),
        "tax",
        F.when(F.col("flag") == "A", "done").when(F.col("flag") == "N", "processing").otherwise("error").alias("processing_status"),
        F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("storage_path"),
    )


IMAGES = """
images AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS analysis_id,
    CASE WHEN max(l_tax) >= 0.07 THEN min(l_suppkey) ELSE l_orderkey % 97 END AS user_id,
    CASE WHEN l_linenumber % 2 = 1 THEN 'lateral' ELSE 'superior' END AS tag,
    max(l_shipdate) AS uploaded_at, max(l_extendedprice) AS bbox_width_px, max(l_quantity) * 10 AS bbox_height_px,
    max(l_quantity) * max(l_extendedprice) AS mask_area_px,
    CASE WHEN max(l_discount) > 0.02 THEN 100 + max(l_discount) * 1000 END AS manual_scale,
    max(l_tax) AS tax,
    CASE max(l_returnflag) WHEN 'A' THEN 'done' WHEN 'N' THEN 'processing' ELSE 'error' END AS processing_status,
    (CASE WHEN max(l_tax) >= 0.07 THEN min(l_suppkey) ELSE l_orderkey % 97 END)::VARCHAR || '/' || l_orderkey::VARCHAR || '.jpg' AS storage_path
  FROM lineitem GROUP BY l_orderkey, l_linenumber
)"""


def analyses(spark: SparkSession, d: str) -> DataFrame:
    from corpuscle.functions.measures import kvol

    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        (F.col("o_totalprice") / 1000).alias("peso_g"),
        F.when(F.col("o_orderstatus") != "P", F.length("o_orderpriority").cast("double")).alias("comprimento_cm"),
        (F.col("o_custkey") % 17).cast("double").alias("altura_cm"),
        F.lit(3.0).alias("largura_cm"),
    )
    return o.withColumn("kvol", kvol("peso_g", "comprimento_cm", "altura_cm", "largura_cm"))


ANALYSES = """
analyses AS (
  SELECT *, CASE WHEN peso_g <> 0 AND comprimento_cm > 0 AND altura_cm > 0
    THEN round(peso_g / (comprimento_cm * altura_cm * largura_cm), 6) END AS kvol
  FROM (
    SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate AS created_at, o_totalprice / 1000 AS peso_g,
      CASE WHEN o_orderstatus <> 'P' THEN length(o_orderpriority)::DOUBLE END AS comprimento_cm,
      (o_custkey % 17)::DOUBLE AS altura_cm, 3.0::DOUBLE AS largura_cm
    FROM orders
  )
)"""


# --- jobs and events -------------------------------------------------------------------------


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("key"),
        "event_id", "user_id", "event_type", "value", "props",
        F.col("ts").cast("timestamp").alias("ts"),
    )


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a job of the pair (user, the number in its properties)."""
    e = events(spark, d)
    status = (
        F.when(F.col("event_type").isin("click", "signup"), "queued")
        .when(F.col("event_type") == "view", "processing")
        .when(F.col("event_type") == "purchase", "done")
        .otherwise("error")
    )
    return e.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("lateral_id"),
        F.lit(0).cast("bigint").alias("superior_id"),
        status.alias("status"),
        F.col("ts").alias("created_at"),
        F.when(F.col("event_type") == "view", F.timestamp_add("SECOND", F.floor("value").cast("int"), F.col("ts"))).alias("started_at"),
        F.when(F.col("event_type").isin("purchase", "error"), F.col("ts")).alias("finished_at"),
        F.when(F.col("event_type") == "error", F.col("event_type")).alias("error"),
    )


JOBS = """
jobs AS (
  SELECT event_id AS id, user_id, json_extract_string(props, '$.k')::BIGINT AS lateral_id, 0::BIGINT AS superior_id,
    CASE event_type WHEN 'click' THEN 'queued' WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'processing'
      WHEN 'purchase' THEN 'done' ELSE 'error' END AS status,
    ts AS created_at,
    CASE WHEN event_type = 'view' THEN ts + to_seconds(floor(value)::BIGINT) END AS started_at,
    CASE WHEN event_type IN ('purchase', 'error') THEN ts END AS finished_at,
    CASE WHEN event_type = 'error' THEN event_type END AS error
  FROM events
)"""
