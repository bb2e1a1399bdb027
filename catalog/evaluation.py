"""Evaluation of retrieval and answers; batch answering."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from catalog import query
from catalog.corpus import embedder
from catalog.fixtures import CHUNKS, SELECTED, TEST, chunks, table, texts
from catalog.retrieval import found
from catalog.scalars import norm
from corpuscle.config import materialize, scratch_path
from corpuscle.operators import evaluation as ev
from corpuscle.plans import answer as an
from corpuscle.plans.evaluate import evaluate_run
from corpuscle.plans.models import with_embeddings
from corpuscle.sources import readers, writers

# Questions whose number has a label of quality 0 are out of the corpus. A question expects its
# own text and the first line of the document of its number.
GOLDEN = """golden AS (
  SELECT b.item_id AS qid, b.text AS question, CASE WHEN l.quality = 0 THEN 'out_of_corpus' ELSE 'in_corpus' END AS scope,
    d.source || '.txt' AS expected_source_file, b.text AS p0, string_split(d.text, chr(10))[1] AS p1
  FROM benchmark b LEFT JOIN labels l ON l.doc_id = b.item_id JOIN documents d ON d.doc_id = b.item_id),
expected AS (SELECT qid, 0 AS passage_no, p0 AS passage FROM golden UNION ALL SELECT qid, 1, p1 FROM golden)"""


def golden(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("question"))
    first_line = F.get(F.split("text", "\n"), F.lit(0))
    return (
        b.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
        .join(table(spark, d, "documents"), "doc_id")
        .select(
            F.col("doc_id").alias("qid"), "question",
            F.when(F.col("quality") == 0, "out_of_corpus").otherwise("in_corpus").alias("scope"),
            F.concat("source", F.lit(".txt")).alias("expected_source_file"),
            F.array("question", first_line).alias("expected_passages"),
            F.split("text", r"\. ").alias("must_mention"),
            F.when(F.col("quality") == 1, F.array(F.array("question", "text"))).otherwise(F.array().cast("array<array<string>>")).alias("history"),
        )
    )


@query("passages_in_corpus", f"""WITH n AS (SELECT DISTINCT {norm('text')} AS needle FROM benchmark), t AS (SELECT {norm('text')} AS t FROM documents)
    SELECT needle FROM n WHERE EXISTS (SELECT 1 FROM t WHERE contains(t, needle))""")
def passages_in_corpus(spark, d):
    docs = texts(spark, d).select(F.col("text").alias("content"))
    return ev.passages_in_corpus(table(spark, d, "benchmark").select(F.col("text").alias("passage")), docs)


CENSUS = f"""{GOLDEN}, corpus AS (SELECT {norm('text')} AS t FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)),
  missing AS (SELECT qid, passage FROM expected WHERE NOT EXISTS (SELECT 1 FROM corpus WHERE contains(t, {norm('passage')})) AND {norm('passage')} <> '')"""


def others(spark, d):
    """The documents without those that the golden passages were taken from."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    return texts(spark, d).join(b, "doc_id", "left_anti").select(F.col("text").alias("content"))


@query("missing_passages", f"WITH {CENSUS} SELECT qid, passage FROM missing")
def missing_passages(spark, d):
    return ev.missing_passages(golden(spark, d), others(spark, d))


@query("golden_census", f"""WITH {CENSUS} SELECT count(*) AS questions, count(*) FILTER (scope = 'in_corpus') AS in_corpus, count(*) FILTER (scope = 'out_of_corpus') AS out_of_corpus,
      count(*) FILTER (qid IN (SELECT doc_id FROM labels WHERE quality = 1)) AS with_history, (SELECT count(*) FROM expected) AS passages_checked,
      (SELECT count(*) FROM missing) AS passages_missing, (SELECT count(*) FROM missing) = 0 AS valid FROM golden""")
def golden_census(spark, d):
    return ev.golden_census(golden(spark, d), others(spark, d))


RETRIEVAL = f"""{CHUNKS},{SELECTED},{GOLDEN},
found_p AS (SELECT e.qid, e.passage_no, min(s.position) AS rank FROM expected e JOIN selected s USING (qid) JOIN live c USING (id)
  WHERE contains({norm('c.content')}, {norm('e.passage')}) GROUP BY 1, 2),
per_q AS (SELECT e.qid, count(*) AS expected_total, count(f.rank) AS expected_found, min(f.rank) AS first_hit_rank FROM expected e LEFT JOIN found_p f USING (qid, passage_no) GROUP BY 1),
got AS (SELECT qid, count(*) AS n, max(coalesce(similarity, 0)) AS top, min(coalesce(similarity, 0)) AS low, sum(n_chars)::BIGINT AS chars FROM selected GROUP BY 1),
evaluated AS (SELECT g.qid, scope, coalesce(n, 0) AS retrieved_count, coalesce(top, 0) AS top_similarity, coalesce(low, 0) AS min_similarity,
  coalesce(chars, 0) AS context_chars, expected_total, expected_found, expected_found::DOUBLE / expected_total AS recall, first_hit_rank
  FROM golden g JOIN per_q USING (qid) LEFT JOIN got USING (qid))"""


@query("eval_retrieval", f"""WITH {RETRIEVAL} SELECT qid, scope, retrieved_count, round(top_similarity, 6) AS top_similarity, round(min_similarity, 6) AS min_similarity,
    context_chars, expected_total, expected_found, round(recall, 6) AS recall, first_hit_rank, expected_total - expected_found AS missed FROM evaluated""")
def eval_retrieval(spark, d):
    hits = found(spark, d).selected.join(chunks(spark, d).select("id", "content"), "id")
    out = ev.eval_retrieval(golden(spark, d), hits)
    rounded = {c: F.round(c, 6) for c in ("top_similarity", "min_similarity", "recall")}
    return out.withColumns(rounded).withColumn("missed", F.size("missed_passages")).drop("missed_passages")


@query("passage_ranks", f"""WITH {RETRIEVAL} SELECT e.qid, e.passage_no, e.passage, f.rank FROM expected e LEFT JOIN found_p f USING (qid, passage_no)""")
def passage_ranks(spark, d):
    hits = found(spark, d).selected.join(chunks(spark, d).select("id", "content"), "id")
    return ev.passage_ranks(golden(spark, d), hits).select("qid", "passage_no", "passage", "rank")


# Answers: the conversation of the same number; its first two sources are cited.
ANSWERS = f"""talk AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS answer FROM conversations GROUP BY conv_id),
ans AS (SELECT g.*, coalesce(t.answer, '') AS answer, d.source || '.txt' AS c0, 'src3.txt' AS c1, {norm("coalesce(t.answer, '')")} AS n
  FROM golden g LEFT JOIN talk t ON t.conv_id = g.qid JOIN documents d ON d.doc_id = g.qid)"""


def answers(spark, d):
    t = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("qid")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("answer")
    )
    src = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), F.array(F.concat("source", F.lit(".txt")), F.lit("src3.txt"), F.lit("")).alias("cited_files"))
    return golden(spark, d).select("qid").join(t, "qid", "left").join(src, "qid")


@query("eval_generation", f"""WITH {GOLDEN},{ANSWERS} SELECT qid, scope, length(answer) AS answer_chars, n = '' AS refused, CASE WHEN scope = 'out_of_corpus' THEN n = '' ELSE n <> '' END AS refusal_correct,
    2 AS citation_file_count, CASE WHEN expected_source_file = 'src3.txt' THEN 1.0::DOUBLE ELSE 0.5 END AS citation_precision, scope = 'in_corpus' AS has_coverage FROM ans""")
def eval_generation(spark, d):
    out = ev.eval_generation(golden(spark, d), answers(spark, d))
    return out.withColumn("has_coverage", F.col("mention_coverage").isNotNull()).drop("mention_coverage", "skeleton")


# Every document as one evaluated question, with numbers taken from the tables.
RESULTS = """results AS (SELECT 'q' || d.doc_id AS qid, CASE WHEN lang = 'en' THEN 'out_of_corpus' ELSE 'in_corpus' END AS scope,
    CASE WHEN lang <> 'en' THEN (n_chars % 4) / 3.0::DOUBLE END AS recall, (n_chars % 1000) / 1000.0::DOUBLE AS top_similarity, n_chars % 17 AS selected_count, n_chars AS context_chars,
    CASE WHEN n_chars % 1000 < 200 THEN 'refused' ELSE 'relative_window' END AS selection_reason,
    CASE WHEN l.quality IS NOT NULL THEN toxic = 1 END AS refused, CASE WHEN l.quality IS NOT NULL THEN quality = 0 END AS skeleton,
    CASE WHEN l.quality IS NOT NULL THEN (toxic = 1) = (lang = 'en') END AS refusal_correct, n_chars % 4 AS citation_file_count FROM documents d LEFT JOIN labels l USING (doc_id))"""


def results(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    n, en, known = F.col("n_chars"), F.col("lang") == "en", F.col("quality").isNotNull()
    return j.select(
        F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("qid"), F.when(en, "out_of_corpus").otherwise("in_corpus").alias("scope"),
        F.when(~en, (n % 4) / 3.0).alias("recall"), ((n % 1000) / 1000.0).alias("top_similarity"), (n % 17).alias("selected_count"), n.alias("context_chars"),
        F.when(n % 1000 < 200, "refused").otherwise("relative_window").alias("selection_reason"),
        F.when(known, F.col("toxic") == 1).alias("refused"), F.when(known, F.col("quality") == 0).alias("skeleton"),
        F.when(known, (F.col("toxic") == 1) == en).alias("refusal_correct"), F.lit(None).cast("double").alias("mention_coverage"),
        (n % 4).alias("citation_file_count"), F.lit(None).cast("double").alias("citation_precision"),
        F.lit(None).cast("double").alias("groundedness"), F.lit(None).cast("double").alias("answers_question"),
    )


# Every fifth question is a colloquial one, and the labelled ones have grades.
GRADED = f"""{RESULTS}, graded AS (SELECT * REPLACE (CASE WHEN d.doc_id % 5 = 0 THEN 'col-' || d.doc_id ELSE r.qid END AS qid),
    CASE WHEN refused IS NOT NULL AND scope = 'in_corpus' THEN (context_chars % 5) / 4.0::DOUBLE END AS mention_coverage,
    CASE WHEN refused IS NOT NULL AND citation_file_count > 0 THEN (context_chars % 3) / 2.0::DOUBLE END AS citation_precision,
    CASE WHEN refused IS NOT NULL THEN context_chars % 101 END AS groundedness, CASE WHEN refused IS NOT NULL THEN context_chars % 7 END AS answers_question
  FROM results r JOIN documents d ON r.qid = 'q' || d.doc_id)"""


def graded(spark, d):
    n, known = F.col("context_chars"), F.col("refused").isNotNull()
    number = F.expr("cast(substring(qid, 2) as bigint)")
    return results(spark, d).withColumns({
        "qid": F.when(number % 5 == 0, F.concat(F.lit("col-"), number.cast("string"))).otherwise(F.col("qid")),
        "mention_coverage": F.when(known & (F.col("scope") == "in_corpus"), (n % 5) / 4.0),
        "citation_precision": F.when(known & (F.col("citation_file_count") > 0), (n % 3) / 2.0),
        "groundedness": F.when(known, n % 101), "answers_question": F.when(known, n % 7),
    })


@query("summarize", f"""WITH {GRADED}, o AS (SELECT context_chars::DOUBLE AS x, row_number() OVER (ORDER BY context_chars) AS i, count(*) OVER () AS n FROM results),
    p AS (SELECT CASE WHEN max(n) < 20 THEN max(x) ELSE (max(CASE WHEN i = 19 * (n + 1) // 20 THEN x END) * (20 - max(19 * (n + 1) % 20))
        + max(CASE WHEN i = 19 * (n + 1) // 20 + 1 THEN x END) * max(19 * (n + 1) % 20)) / 20 END AS p95 FROM o)
    SELECT count(*) AS questions_total, count(*) FILTER (scope = 'in_corpus') AS questions_in_corpus, count(*) FILTER (scope = 'out_of_corpus') AS questions_out_of_corpus,
      round(avg(recall) FILTER (scope = 'in_corpus'), 3) AS mean_recall, round(avg((recall = 1)::INT) FILTER (scope = 'in_corpus'), 3) AS perfect_recall_rate,
      round(avg(top_similarity), 3) AS mean_top_similarity, round(avg(selected_count), 1) AS mean_selected_chunks,
      round(avg((selected_count <= 6)::INT) FILTER (selection_reason <> 'refused'), 3) AS starvation_rate,
      count(*) FILTER (qid LIKE 'col-%') AS col_questions_total, round(avg(recall) FILTER (qid LIKE 'col-%'), 3) AS col_mean_recall,
      round(avg((recall = 1)::INT) FILTER (qid LIKE 'col-%'), 3) AS col_perfect_recall_rate, round(avg(top_similarity) FILTER (qid LIKE 'col-%'), 3) AS col_mean_top_similarity,
      round(avg((selected_count <= 6)::INT) FILTER (qid LIKE 'col-%'), 3) AS col_starvation_rate,
      round(avg(refusal_correct::INT), 3) AS refusal_correct_rate, round(avg(refused::INT) FILTER (scope = 'out_of_corpus'), 3) AS out_of_corpus_refusal_rate,
      round(avg(groundedness), 1) AS mean_groundedness, round(avg(answers_question), 1) AS mean_answers_question, round(avg(mention_coverage), 3) AS mean_mention_coverage,
      round(avg(skeleton::INT) FILTER (NOT refused), 3) AS skeleton_rate, round(avg(citation_file_count) FILTER (NOT refused), 2) AS citation_file_count_mean,
      round(avg(citation_precision) FILTER (NOT refused), 3) AS citation_precision, round((SELECT p95 FROM p)) AS p95_context_chars FROM graded""")
def summarize(spark, d):
    return ev.summarize(graded(spark, d))


@query("verdict_accuracy", """WITH v AS (SELECT lang AS scope, (CASE WHEN lang = 'en' THEN quality = 0 ELSE quality = 1 END)::INT AS ok FROM documents JOIN labels USING (doc_id)),
    w AS (SELECT CASE WHEN scope = 'en' THEN 'out_of_corpus' ELSE 'in_corpus' END AS scope, ok FROM v)
    SELECT coalesce(scope, 'all') AS scope, count(*) AS questions, sum(ok)::BIGINT AS correct, round(avg(ok), 6) AS accuracy FROM w GROUP BY ROLLUP (scope)""")
def verdict_accuracy(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    rows = j.select(
        F.when(F.col("lang") == "en", "out_of_corpus").otherwise("in_corpus").alias("scope"),
        F.when(F.col("quality") == 0, "insufficient").when(F.col("toxic") == 1, "partial").otherwise("sufficient").alias("verdict"),
    )
    return ev.verdict_accuracy(rows).withColumn("accuracy", F.round("accuracy", 6))


@query("compare_runs", """WITH a AS (SELECT source, count(*)::VARCHAR AS v FROM documents WHERE lang <> 'de' GROUP BY 1),
    b AS (SELECT source, CASE WHEN length(source) = 4 THEN 'n/a' ELSE max(n_chars)::VARCHAR END AS v FROM documents JOIN labels USING (doc_id) GROUP BY 1)
    SELECT source AS name, a.v AS value_a, b.v AS value_b, try_cast(b.v AS DOUBLE) - try_cast(a.v AS DOUBLE) AS delta, a.v IS NOT DISTINCT FROM b.v AS same FROM a FULL JOIN b USING (source)""")
def compare_runs(spark, d):
    docs = table(spark, d, "documents")
    section = F.lit("summary").alias("section")
    a = docs.filter("lang <> 'de'").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    b = docs.join(table(spark, d, "labels"), "doc_id").groupBy(F.col("source").alias("name")).agg(
        F.when(F.length(F.first("source")) == 4, "n/a").otherwise(F.max("n_chars").cast("string")).alias("value")
    )
    return ev.compare_runs(a.select(section, "*"), b.select(section, "*")).drop("section")


@query("run_cost", """WITH u AS (SELECT source AS run_id, CASE lang WHEN 'en' THEN 'gpt-4o' WHEN 'de' THEN 'gpt-4o-mini' WHEN 'fr' THEN 'text-embedding-3-large' ELSE 'unknown' END AS model, n_chars AS i, length(source) AS o FROM documents),
    p AS (SELECT * FROM (VALUES ('gpt-4o', 2.5, 10.0), ('gpt-4o-mini', 0.15, 0.6), ('text-embedding-3-large', 0.13, 0.0)) t(model, pi, po))
    SELECT run_id, count(*) AS calls, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, round(sum((i * coalesce(pi, 0) + o * coalesce(po, 0)) / 1e6)::DOUBLE, 6) AS cost_usd FROM u LEFT JOIN p USING (model) GROUP BY 1""")
def run_cost(spark, d):
    model = F.when(F.col("lang") == "en", "gpt-4o").when(F.col("lang") == "de", "gpt-4o-mini").when(F.col("lang") == "fr", "text-embedding-3-large").otherwise("unknown")
    usage = table(spark, d, "documents").select(
        F.col("source").alias("run_id"), model.alias("model"), F.col("n_chars").alias("input_tokens"), F.length("source").alias("output_tokens")
    )
    return ev.run_cost(usage, ev.price_table(spark)).withColumn("cost_usd", F.round("cost_usd", 6))


@query("embedding_calls", "SELECT source, count(*) * 3 AS retrieval_only, count(*) * 7 AS full_run FROM documents GROUP BY source")
def embedding_calls(spark, d):
    n = F.count(F.lit(1))
    return table(spark, d, "documents").groupBy("source").agg(
        ev.embedding_calls(n, 3, False).alias("retrieval_only"), ev.embedding_calls(n, 3, True).alias("full_run")
    )


@query("mean_latency", "SELECT user_id, round(avg(CASE WHEN event_type = 'error' THEN 0 ELSE value END + CASE WHEN event_type = 'view' THEN value ELSE 0 END), 6) AS mean_latency_seconds FROM events GROUP BY user_id")
def mean_latency(spark, d):
    e = table(spark, d, "events")
    rows = e.select(
        "user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("retrieval_seconds"), F.when(F.col("event_type") == "view", F.col("value")).alias("generation_seconds")
    )
    return ev.mean_latency(rows, ("user_id",)).withColumn("mean_latency_seconds", F.round("mean_latency_seconds", 6))


@query("write_run", f"WITH {RESULTS} SELECT qid, scope, round(recall, 6) AS recall, selected_count FROM results")
def write_run(spark, d):
    """A run written as JSON and read back."""
    path = scratch_path(spark, "runs")
    rows = results(spark, d)
    writers.write_run(rows, ev.summarize(rows), {"retrieval_k": 40}, path, "check")
    back = spark.read.schema("qid string, scope string, recall double, selected_count bigint, run_id string").json(f"{path}/results")
    return back.select("qid", "scope", F.round("recall", 6).alias("recall"), "selected_count")


@query("read_golden", f"""WITH {GOLDEN} SELECT qid::VARCHAR AS qid, question, scope, expected_source_file, p0 AS first_passage,
      (qid IN (SELECT doc_id FROM labels WHERE quality = 1))::INT AS pairs FROM golden""")
def read_golden(spark, d):
    """The golden questions as JSON lines, read back."""
    path = scratch_path(spark, "golden")
    golden(spark, d).withColumn("id", F.col("qid").cast("string")).drop("qid").write.json(path)
    rows = readers.read_golden(spark, path)
    first = F.get("expected_passages", F.lit(0)).alias("first_passage")
    return rows.select("qid", "question", "scope", "expected_source_file", first, F.size("history").alias("pairs"))


def run_parts(results, total, per_part=10000):
    """Rows of a run file (run_id, results, part): a run's results in parts of about `per_part` of the rows, however large the run."""
    one = F.struct(
        F.col("qid").alias("id"), "scope", F.struct("recall", "selected_count").alias("retrieval"), F.struct("refused", "citation_file_count").alias("generation")
    )
    number = F.pmod(F.xxhash64("qid"), F.lit(total // per_part + 1))
    runs = results.groupBy(F.col("source").alias("run_id"), number.alias("number")).agg(F.collect_list(one).alias("results"))
    return runs.select("run_id", "results", F.concat_ws("-", "run_id", "number").alias("part"))


@query("read_runs", f"""WITH {RESULTS} SELECT d.source AS run_id, r.qid, r.scope, round(r.recall, 6) AS recall, r.selected_count, r.refused, r.citation_file_count
    FROM results r JOIN documents d ON r.qid = 'q' || d.doc_id""")
def read_runs(spark, d):
    """A run per source in files of bounded parts, read as a row per question."""
    path = scratch_path(spark, "run-files")
    r = results(spark, d).join(table(spark, d, "documents").select(F.concat(F.lit("q"), "doc_id").alias("qid"), "source"), "qid")
    runs = run_parts(r, table(spark, d, "documents").count())
    runs.write.partitionBy("part").json(path)
    columns = ("run_id", "qid", "scope", F.round("recall", 6).alias("recall"), "selected_count", "refused", "citation_file_count")
    return readers.read_runs(spark, path).select(*columns)


@query("evaluate_run", f"""WITH {RETRIEVAL} SELECT count(*) AS questions_total, round(avg(recall) FILTER (scope = 'in_corpus'), 3) AS mean_recall,
    round(avg(retrieved_count), 1) AS mean_selected_chunks, round(avg(top_similarity), 3) AS mean_top_similarity FROM evaluated""")
def evaluate_run_all(spark, d):
    _, summary = evaluate_run(golden(spark, d), found(spark, d), chunks(spark, d), settings=TEST)
    return summary.select("questions_total", "mean_recall", "mean_selected_chunks", "mean_top_similarity")


# --- answering -------------------------------------------------------------------------------

# The decision rules on every document: its label is the first verdict, its own text the context.
DECIDED = """d0 AS (SELECT doc_id, text AS question, lang, CASE WHEN n_chars > 300 THEN text ELSE '' END AS c1, CASE WHEN lang <> 'fr' THEN text ELSE '' END AS c2,
    CASE WHEN l.quality = 1 THEN 'sufficient' WHEN l.quality = 0 THEN 'insufficient' ELSE 'partial' END AS v1 FROM documents LEFT JOIN labels l USING (doc_id)),
  d1 AS (SELECT *, CASE WHEN c1 = '' THEN 'insufficient' ELSE v1 END AS first FROM d0),
  d2 AS (SELECT *, (first = 'insufficient')::INT AS n, CASE WHEN first = 'insufficient' THEN CASE WHEN c2 = '' THEN 'insufficient' ELSE 'partial' END ELSE first END AS verdict FROM d1),
  d3 AS (SELECT *, CASE WHEN verdict <> 'insufficient' THEN 'generate' ELSE 'give_up' END AS route, CASE WHEN verdict = 'insufficient' THEN '' WHEN n = 1 THEN c2 ELSE c1 END AS context FROM d2)"""


def decided(spark, d):
    j = texts(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    state = j.select(
        "doc_id", F.col("text").alias("question"), "lang", F.when(F.col("lang") == "es", "pt-BR").otherwise("en").alias("language"),
        F.when(F.col("n_chars") > 300, F.col("text")).otherwise("").alias("context_1"), F.when(F.col("lang") != "fr", F.col("text")).otherwise("").alias("context_2"),
        F.when(F.col("quality") == 1, "Sufficient").when(F.col("quality") == 0, "INSUFFICIENT").otherwise("partial").alias("judged_1"),
        F.lit("?").alias("judged_2"), F.lit("strong").alias("confidence_1"), F.lit("partial").alias("confidence_2"),
    )
    return an.decide_context(state)


@query("decide_context", f"WITH {DECIDED} SELECT doc_id, verdict, n AS reformulation_count, route, md5(context) AS context_hash, CASE WHEN n = 1 THEN 'partial' ELSE 'strong' END AS confidence FROM d3")
def decide_context(spark, d):
    return decided(spark, d).select("doc_id", "verdict", "reformulation_count", "route", F.md5("context").alias("context_hash"), "confidence")


@query("grade_answers", f"""WITH {DECIDED}, g AS (SELECT *, CASE WHEN lang = 'de' THEN 'x SEM_RESPOSTA_NO_CONTEXTO' WHEN lang = 'es' THEN 'No data available in the context.' ELSE question || ' 98.76%' END AS gen FROM d3),
    h AS (SELECT *, route = 'give_up' OR lang = 'de' AS refused, lang NOT IN ('de', 'es') AND NOT contains({norm('context')}, '98.76%') AS bad FROM g),
    k AS (SELECT *, (NOT refused AND bad)::INT AS regen, CASE WHEN refused THEN '' WHEN bad THEN question || ' 98.76%' ELSE gen END AS answer FROM h)
    SELECT doc_id, refused, CASE WHEN refused THEN 0 ELSE regen END AS numeric_regen_count, CASE WHEN refused OR lang = 'es' OR NOT bad THEN '' ELSE '98.76%' END AS unsupported FROM k""")
def grade_answers(spark, d):
    generated = (
        F.when(F.col("lang") == "de", F.lit("x SEM_RESPOSTA_NO_CONTEXTO")).when(F.col("lang") == "es", "No data available in the context.")
        .otherwise(F.concat("question", F.lit(" 98.76%")))
    )
    state = decided(spark, d).withColumn("generated", generated).withColumn("regenerated", F.concat("question", F.lit(" 98.76%")))
    out = an.grade_answers(state)
    return out.select(
        "doc_id", (F.col("evaluation") == "REFUSED").alias("refused"), "numeric_regen_count", F.array_join("unsupported_numbers", "|").alias("unsupported")
    )


def judge():
    def call(rows):
        return ["INSUFFICIENT" if len(r["context"]) < 2000 else "SUFFICIENT" for r in rows]

    return call


def generator():
    def call(rows):
        return [r["context"][:200] + (" 12345" if "unsupported" not in r else "") for r in rows]

    return call


@query("answer_questions")
def answer_questions(spark, d):
    """All benchmark questions through both passes, with stand-in models."""
    settings = dataclasses.replace(TEST, embedding_dimensions=16, refusal_floor=0.5, strong_similarity=0.8, absolute_floor=0.3, hybrid_enabled=False)
    embedded = materialize(with_embeddings(chunks(spark, d), embedder()), "embedded")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.lit(None).cast("string").alias("last_question"))
    out = an.answer_questions(q, embedded, embedder(), judge(), generator(), settings)
    cited = out.sources.groupBy("qid").agg(F.count(F.lit(1)).alias("cited_files"))
    return out.answers.join(cited, "qid", "left").select("qid", "verdict", "route", "reformulation_count", "evaluation", "numeric_regen_count", "cited_files")
