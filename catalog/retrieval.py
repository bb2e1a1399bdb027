"""Retrieval: vector and lexical top-k, fusion, selection, companions, citations."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from catalog import ORACLE, query
from catalog.fixtures import (
    CHUNKS, FUSED, LEXICAL_HITS, POSTINGS, QVECS, SELECTED, TERMS, TEST, VECTOR_HITS,
    chunks, own_rows, query_vectors, questions, table,
)
from corpuscle.config import scratch_path
from corpuscle.functions.questions import lexical_terms
from corpuscle.operators import lexical as lx
from corpuscle.operators import selection as sel
from corpuscle.operators.centroids import search_lists, write_lists
from corpuscle.operators.ordering import top_k
from corpuscle.operators.vectors import vector_topk, vector_topk_ann, write_ann_index
from corpuscle.plans.retrieve import contexts, negative_control, query_variants, retrieve
from corpuscle.sources.readers import is_live

def sim():
    return F.round("similarity", 6).alias("similarity")


def live(spark, d):
    return chunks(spark, d, vectors=True).filter(is_live())


def postings(spark, d):
    return lx.build_postings(chunks(spark, d, vectors=True, spread=True).filter(is_live()))


@query(
    "vector_topk",
    f"""WITH {CHUNKS}, sims AS (
      SELECT q.vec_id AS qid, c.id,
        round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS similarity
      FROM embeddings q CROSS JOIN live c)
    SELECT qid, id, round(similarity, 6) AS similarity,
      row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) - 1 AS rank
    FROM sims QUALIFY rank < 40""",
)
def vector_topk_all(spark, d):
    """Every embedding asks for its 40 nearest live chunks."""
    q = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    return vector_topk(q, live(spark, d), 40, settings=TEST).select("qid", "id", sim(), "rank")


@query("vector_topk_ann")
def vector_topk_ann_all(spark, d):
    """The same through the cell index; candidates are approximate."""
    path = scratch_path(spark, "ann-index")
    write_ann_index(live(spark, d).select("id", "embedding"), path)
    q = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    found = vector_topk_ann(q, spark.read.parquet(path), 40, settings=TEST)
    return found.select("qid", "id", sim(), "rank")


@query("vector_topk_passes", ORACLE["vector_topk"])
def vector_topk_passes(spark, d):
    """The same with so small a bound that the queries go in blocks, one pass each."""
    q = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    small = dataclasses.replace(TEST, broadcast_max_bytes=8 * 64 * 150)
    return vector_topk(q, live(spark, d), 40, settings=small).select("qid", "id", sim(), "rank")


@query("vector_topk_ann_exact", "SELECT vec_id AS qid, true AS exact FROM embeddings")
def vector_topk_ann_exact(spark, d):
    """Whatever the index finds has its true similarity, and every query finds as many chunks as it asks for."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"), F.sqrt(dot("embedding", "embedding")).alias("length"))
    found = vector_topk_ann_all(spark, d)
    met = found.join(vectors.select(F.col("vec_id").alias("qid"), F.col("v").alias("q"), F.col("length").alias("q_length")), "qid").join(
        vectors.select(F.col("vec_id").alias("id"), F.col("v").alias("c"), F.col("length").alias("c_length")), "id"
    )
    cosine = dot("q", "c") / (F.col("q_length") * F.col("c_length"))
    enough = min(40, live(spark, d).count())
    right = F.bool_and(F.abs(cosine - F.col("similarity")) < 2e-6) & (F.count(F.lit(1)) == enough)
    checked = met.groupBy("qid").agg(right.alias("exact"))
    asked = vectors.select(F.col("vec_id").alias("qid"))
    return asked.join(checked, "qid", "left").select("qid", F.coalesce("exact", F.lit(False)).alias("exact"))


@query("vector_topk_lists", ORACLE["vector_topk"])
def vector_topk_lists(spark, d):
    """The exact result through the k-means index: lists that cannot hold a nearer chunk are not read."""
    rows = live(spark, d).select("id", "embedding")
    path = scratch_path(spark, "vector-lists")
    write_lists(rows, path)
    q = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    return search_lists(q, path, rows.schema, 40, exact=True, settings=TEST).select("qid", "id", sim(), "rank")


def recall_and_share(spark, rows, q):
    """One row: recall@40 of the approximate search by lists, and the share of all chunks that a question is compared with."""
    path = scratch_path(spark, "vector-lists")
    write_lists(rows, path)
    found = search_lists(q, path, rows.schema, 40, settings=TEST)
    exact = vector_topk(q, rows, 40, settings=TEST).select("qid", "id", F.lit(1).alias("hit"))
    per_question = found.groupBy("qid").agg(F.max("n_read").alias("n_read"))
    hits = exact.join(found.select("qid", "id", F.lit(1).alias("found")), ["qid", "id"], "left")
    recall = hits.agg(F.count("hit").alias("neighbours"), (F.count("found") / F.count("hit")).alias("recall"))
    share = per_question.agg(F.count(F.lit(1)).alias("questions"), F.avg("n_read").alias("read"))
    chunks_n = rows.agg(F.count(F.lit(1)).alias("n"))
    return recall.join(share).join(chunks_n).select("questions", "neighbours", "recall", (F.col("read") / F.col("n")).alias("share"))


@query("vector_lists_recall", "SELECT count(*) AS questions, true AS recalled FROM embeddings")
def vector_lists_recall(spark, d):
    """The given vectors, which have no near neighbours: nine tenths of the 40 nearest are found."""
    q = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    return recall_and_share(spark, live(spark, d).select("id", "embedding"), q).select("questions", (F.col("recall") >= 0.9).alias("recalled"))


@query("vector_lists_clustered", "SELECT count(*) AS questions, true AS recalled, true AS few_read FROM embeddings")
def vector_lists_clustered(spark, d):
    """Every vector drawn to the first one of its label: recall holds while under a third of the chunks is read."""
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("centre"))
    near = e.join(first, "label").select("vec_id", F.zip_with("embedding", "centre", lambda x, c: x + 2 * c).alias("embedding"))
    row = recall_and_share(spark, near.withColumnRenamed("vec_id", "id"), near.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec")))
    return row.select("questions", (F.col("recall") >= 0.9).alias("recalled"), (F.col("share") < 0.3).alias("few_read"))


def variant_hits(spark, d):
    hits = vector_topk(query_vectors(spark, d), live(spark, d), 43, ("qid", "variant"), settings=TEST)
    others = hits.drop("rank").join(own_rows(spark, d), ["qid", "id"], "left_anti")
    return top_k(others, ["qid", "variant"], [F.desc("similarity"), F.asc("id")], 40)


@query("vector_topk_variants", f"""WITH {CHUNKS},{VECTOR_HITS}
    SELECT qid, variant, id, round(similarity, 6) AS similarity,
      row_number() OVER (PARTITION BY qid, variant ORDER BY similarity DESC, id) - 1 AS rank FROM variant_hits""")
def vector_topk_variants(spark, d):
    return variant_hits(spark, d).select("qid", "variant", "id", sim(), "rank")


@query("merge_variants", f"WITH {CHUNKS},{VECTOR_HITS} SELECT qid, id, round(similarity, 6) AS similarity, rank FROM vector_hits")
def merge_variants(spark, d):
    return sel.merge_variants(variant_hits(spark, d).drop("rank", "variant")).select("qid", "id", sim(), "rank")


@query("build_postings", f"WITH {CHUNKS},{POSTINGS} SELECT term, id, tf FROM postings")
def build_postings(spark, d):
    return postings(spark, d)


def terms(spark, d):
    return lx.explode_terms(questions(spark, d).withColumn("terms", lexical_terms("question", "rewritten")))


def lexical_hits(spark, d):
    found = lx.lexical_topk(terms(spark, d), postings(spark, d), 43)
    others = found.drop("rank").join(own_rows(spark, d), ["qid", "id"], "left_anti")
    return top_k(others, ["qid"], [F.desc("lexical_score"), F.asc("id")], 40)


@query("lexical_topk", f"""WITH {CHUNKS},{LEXICAL_HITS}
    SELECT qid, id, round(lexical_score, 6) AS lexical_score, rank FROM lexical_hits""")
def lexical_topk(spark, d):
    return lexical_hits(spark, d).select("qid", "id", F.round("lexical_score", 6).alias("lexical_score"), "rank")


@query("lexical_topk_all", f"""WITH {CHUNKS},{POSTINGS}, q AS (
      SELECT DISTINCT label AS qid, unnest(regexp_extract_all(lower(d.text), '[a-z0-9]+')) AS term
      FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
    w AS (SELECT qid, id, sum(tf) * 0.1 AS w FROM q JOIN postings USING (term) GROUP BY qid, id)
    SELECT qid, id, round((w / (w + 1))::DOUBLE, 6) AS lexical_score,
      row_number() OVER (PARTITION BY qid ORDER BY (w / (w + 1))::DOUBLE DESC, id) - 1 AS rank
    FROM w QUALIFY rank < 40""")
def lexical_topk_all(spark, d):
    """Long queries: each label asks with all words of its documents."""
    docs = table(spark, d, "documents").join(
        table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("qid")), "doc_id"
    )
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))))
    asked = docs.select("qid", words.alias("term")).distinct()
    found = lx.lexical_topk(asked, postings(spark, d), 40)
    return found.select("qid", "id", F.round("lexical_score", 6).alias("lexical_score"), "rank")


def frequencies(spark, d):
    rows = live(spark, d)
    total = rows.agg(F.count(F.lit(1)).alias("total_docs"))
    return lx.term_doc_freq(postings(spark, d), terms(spark, d), total)


@query("term_doc_freq", f"""WITH {CHUNKS},{TERMS},{POSTINGS}
    SELECT term, count(p.id) AS doc_count, (SELECT count(*) FROM live) AS total_docs
    FROM (SELECT DISTINCT term FROM terms) LEFT JOIN postings p USING (term) GROUP BY term""")
def term_doc_freq(spark, d):
    return frequencies(spark, d)


@query("discriminative_terms", f"""WITH {CHUNKS},{SELECTED} SELECT qid, discriminative FROM coverage""")
def discriminative_terms(spark, d):
    return lx.has_discriminative_term(terms(spark, d), frequencies(spark, d), TEST.discriminative_max_doc_freq)


@query("rrf_fuse", f"""WITH {CHUNKS},{FUSED}
    SELECT qid, id, round(similarity, 6) AS similarity, lexical_rank, round(rrf_score, 9) AS rrf_score, rank FROM fused""")
def rrf_fuse(spark, d):
    vector = sel.merge_variants(variant_hits(spark, d).drop("rank", "variant"))
    fused = sel.rrf_fuse(vector, lexical_hits(spark, d))
    return fused.select("qid", "id", sim(), "lexical_rank", F.round("rrf_score", 9).alias("rrf_score"), "rank")


def found(spark, d, settings=TEST):
    rows = chunks(spark, d, vectors=True)
    return retrieve(
        questions(spark, d), query_vectors(spark, d), rows, settings,
        postings(spark, d), exclude=own_rows(spark, d),
    )


@query("retrieve_selected", f"""WITH {CHUNKS},{SELECTED}
    SELECT qid, id, position, round(similarity, 6) AS similarity, lexical_rank, n_chars, selection_reason FROM selected""")
def retrieve_selected(spark, d):
    return found(spark, d).selected.select("qid", "id", "position", sim(), "lexical_rank", "n_chars", "selection_reason")


@query("retrieve_stored", ORACLE["retrieve_selected"])
def retrieve_stored(spark, d):
    """The same through a stored index, written in two ingest batches: the search reads the buckets of the asked terms and no text."""
    rows, path = chunks(spark, d, vectors=True), scratch_path(spark, "postings")
    texts = chunks(spark, d, vectors=True, spread=True).filter(F.col("embedding").isNotNull())
    schema = lx.build_postings(texts).schema
    for half in (0, 1):
        lx.write_postings(lx.build_postings(texts.filter(F.pmod(F.col("id"), F.lit(2)) == half)), path, buckets=16)
    lx.hide_postings(rows.filter(~is_live()).select("id"), path)
    stored = lambda wanted: lx.asked_postings(spark, path, wanted, schema, buckets=16, settings=TEST)
    out = retrieve(questions(spark, d), query_vectors(spark, d), rows, TEST, stored, exclude=own_rows(spark, d))
    return out.selected.select("qid", "id", "position", sim(), "lexical_rank", "n_chars", "selection_reason")


@query("retrieve_trace", f"""WITH {CHUNKS},{SELECTED}, n AS (
      SELECT qid, count(*) AS selected_count, sum(n_chars) AS context_chars FROM selected GROUP BY qid),
    r AS (SELECT qid, any_value(selection_reason) AS reason FROM chosen GROUP BY qid)
    SELECT b.item_id AS qid, coalesce(candidate_count, 0) AS candidate_count,
      round(coalesce(top_similarity_raw, 0), 6) AS top_similarity_raw,
      coalesce(selected_count, 0) AS selected_count, coalesce(context_chars, 0)::BIGINT AS context_chars,
      CASE WHEN reason IS NULL THEN 'refused' WHEN selected_count IS NULL THEN 'refused_no_lexical_coverage'
        ELSE reason END AS selection_reason,
      CASE WHEN top_similarity_raw >= 0.43 THEN 'strong' ELSE 'partial' END AS context_confidence
    FROM benchmark b LEFT JOIN top_raw t ON t.qid = b.item_id LEFT JOIN r ON r.qid = b.item_id
      LEFT JOIN n ON n.qid = b.item_id""")
def retrieve_trace(spark, d):
    return found(spark, d).trace.withColumn("top_similarity_raw", F.round("top_similarity_raw", 6))


@query("retrieve_vector_only", f"""WITH {CHUNKS},{VECTOR_HITS},
    s0 AS (SELECT v.*, c.n_chars, max(similarity) OVER (PARTITION BY qid) AS top FROM vector_hits v JOIN live c USING (id)),
    s1 AS (SELECT *, similarity >= greatest(0.15, top - 0.15) AS keep FROM s0 WHERE top >= 0.38),
    s2 AS (SELECT *, count(*) FILTER (keep) OVER (PARTITION BY qid) AS kept FROM s1),
    s3 AS (SELECT *, CASE WHEN kept < 8 THEN 'min_fill' ELSE 'relative_window' END AS selection_reason,
        row_number() OVER (PARTITION BY qid ORDER BY rank) - 1 AS position
      FROM s2 WHERE CASE WHEN kept < 8 THEN rank < 8 ELSE keep END)
    SELECT qid, id, position, round(similarity, 6) AS similarity, selection_reason FROM (
      SELECT *, sum(n_chars) OVER (PARTITION BY qid ORDER BY position) AS running FROM s3 WHERE position < 16)
    WHERE position < 8 OR running <= 22000""")
def retrieve_vector_only(spark, d):
    """The default mode, without the lexical side."""
    plain = dataclasses.replace(TEST, hybrid_enabled=False)
    return found(spark, d, plain).selected.select("qid", "id", "position", sim(), "selection_reason")


@query("negative_control", f"WITH {CHUNKS},{SELECTED} SELECT qid, id, position FROM selected WHERE position < 1")
def negative_control_k1(spark, d):
    return negative_control(found(spark, d), 1).select("qid", "id", "position")


@query("citations", f"""WITH {CHUNKS},{SELECTED}, p AS (
      SELECT qid, original_file_name AS file, position, unnest(generate_series(page_start, page_end)) AS page FROM selected),
    f AS (SELECT qid, file, min(position) AS first, list_sort(list(DISTINCT page)) AS pages FROM p GROUP BY qid, file)
    SELECT qid, file, array_to_string(pages, ',') AS pages,
      row_number() OVER (PARTITION BY qid ORDER BY first) - 1 AS citation_rank
    FROM f QUALIFY citation_rank < 3""")
def citations(spark, d):
    rows = found(spark, d).selected.withColumn("companion", F.lit(False))
    cited = sel.citations(rows, TEST.citation_max_files)
    return cited.withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query("build_context", f"""WITH {CHUNKS},{SELECTED}
    SELECT qid, string_agg(c.content, chr(10) || chr(10) ORDER BY position) AS context
    FROM selected s JOIN live c USING (id) GROUP BY qid""")
def build_context(spark, d):
    rows = found(spark, d).selected
    return sel.build_context(rows, chunks(spark, d))


# Room for companions: the given documents are long.
ROOMY = dataclasses.replace(TEST, context_char_budget=60000)

# The greedy walk in SQL: per question all candidates by density, one recursion step each.
COMPANIONS = f"""{CHUNKS},{SELECTED},
used AS MATERIALIZED (SELECT qid, greatest(60000 - sum(n_chars), 0) AS budget, max(position) AS last FROM selected GROUP BY qid),
pool AS MATERIALIZED (
  SELECT e.qid, c.id, length(c.content) AS n,
    row_number() OVER (PARTITION BY e.qid
      ORDER BY length(regexp_replace(c.content, '\\P{{Nd}}', '', 'g'))::DOUBLE / greatest(length(c.content), 1) DESC, c.id) AS i
  FROM (SELECT DISTINCT qid, original_file_id FROM selected WHERE position < 3) e JOIN live c USING (original_file_id)
  WHERE NOT EXISTS (SELECT 1 FROM selected s WHERE s.qid = e.qid AND s.id = c.id)
),
walk AS (
  SELECT qid, 0::BIGINT AS i, budget::BIGINT AS remaining, []::BIGINT[] AS picked FROM used
  UNION ALL
  SELECT w.qid, p.i,
    CASE WHEN p.n <= w.remaining AND len(w.picked) < 3 THEN w.remaining - p.n ELSE w.remaining END,
    CASE WHEN p.n <= w.remaining AND len(w.picked) < 3 THEN list_append(w.picked, p.id) ELSE w.picked END
  FROM walk w JOIN pool p ON p.qid = w.qid AND p.i = w.i + 1
),
final AS (SELECT qid, max_by(picked, i) AS picked FROM walk GROUP BY qid)"""


@query("companions", f"""WITH RECURSIVE {COMPANIONS}
    SELECT f.qid, u.last + g AS position, picked[g] AS id
    FROM (SELECT *, unnest(generate_series(1, len(picked))) AS g FROM final) f JOIN used u USING (qid)""")
def companions(spark, d):
    rows = found(spark, d).selected
    extra = sel.add_companions(rows, chunks(spark, d, vectors=True).filter(is_live()), ROOMY)
    return extra.filter("companion").select("qid", "position", "id")


@query("context_with_companions", f"""WITH RECURSIVE {COMPANIONS}, rows AS (
      SELECT qid, position, id FROM selected
      UNION ALL
      SELECT f.qid, u.last + g, picked[g]
      FROM (SELECT *, unnest(generate_series(1, len(picked))) AS g FROM final) f JOIN used u USING (qid))
    SELECT qid, md5(string_agg(c.content, chr(10) || chr(10) ORDER BY position)) AS context_hash, count(*) AS n
    FROM rows JOIN live c USING (id) GROUP BY qid""")
def context_with_companions(spark, d):
    rows = chunks(spark, d, vectors=True)
    used, text = contexts(found(spark, d), rows, settings=ROOMY)
    n = used.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return text.select("qid", F.md5("context").alias("context_hash")).join(n, "qid")


@query("query_variants", """WITH v AS (
      SELECT item_id AS qid, unnest([0, 1, 2, 3]) AS pos,
        unnest([text, '  ' || text, split_part(text, '.', 1), split_part(text, ' ', 1)]) AS text FROM benchmark),
    k AS (SELECT qid, lower(trim(text)) AS key, min(pos) AS pos, min_by(text, pos) AS text FROM v
      WHERE trim(text) <> '' GROUP BY qid, lower(trim(text)))
    SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY pos) - 1 AS variant, text FROM k QUALIFY variant < 3""")
def query_variants_all(spark, d):
    q = questions(spark, d).select(
        "qid", "question", F.concat(F.lit("  "), "question").alias("b"),
        F.split_part("question", F.lit("."), F.lit(1)).alias("c"), F.split_part("question", F.lit(" "), F.lit(1)).alias("e"),
    )
    return query_variants(q, ("question", "b", "c", "e"))


@query("top_files", f"""WITH {CHUNKS},{SELECTED} SELECT DISTINCT qid, original_file_id FROM selected WHERE position < 3""")
def top_files(spark, d):
    return found(spark, d).selected.filter(F.col("position") < 3).select("qid", "original_file_id").distinct()
