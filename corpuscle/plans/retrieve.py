"""Retrieval for a whole table of questions: vectors, words, fusion, gates."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.config import DEFAULTS, Settings, broadcast_if_small, materialize
from corpuscle.functions.questions import lexical_terms
from corpuscle.functions.text import with_folded_accents
from corpuscle.operators import lexical as lx
from corpuscle.operators import selection as sel
from corpuscle.operators.ordering import ranked, top_k
from corpuscle.operators.vectors import vector_topk
from corpuscle.sources.readers import is_live

_PLACE = ("n_chars", "original_file_id", "original_file_name", "page_start", "page_end")


class Retrieval(NamedTuple):
    selected: DataFrame  # qid, id, position, similarity, n_chars, file, pages, selection_reason
    trace: DataFrame  # one row per question


def query_variants(questions: DataFrame, columns: tuple[str, ...], limit: int = DEFAULTS.multi_query_variants, qid: str = "qid") -> DataFrame:
    """(qid, variant, text): distinct formulations, case aside, the first ones win."""
    texts = F.array(*[F.struct(F.lit(i).alias("pos"), F.col(c).alias("text")) for i, c in enumerate(columns)])
    rows = questions.select(qid, F.explode(texts).alias("_v")).select(qid, "_v.*")
    rows = rows.withColumn("_key", F.lower(F.trim("text"))).filter(F.coalesce("_key", F.lit("")) != "")
    first = rows.groupBy(qid, "_key").agg(F.min("pos").alias("pos"), F.min_by("text", "pos").alias("text"))
    kept = top_k(first, [qid], [F.asc("pos")], limit, "variant").select(qid, "variant", "text")
    # A question whose every formulation is blank is still asked as it stands.
    lost = questions.join(kept.select(qid), qid, "left_anti").select(
        qid, F.lit(0).alias("variant"), F.col(columns[0]).alias("text")
    )
    return kept.unionByName(lost)


def _most_per_question(pairs: DataFrame) -> int:
    counts = pairs.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def retrieve(
    questions: DataFrame,
    query_vectors: DataFrame,
    chunks: DataFrame,
    settings: Settings = DEFAULTS,
    postings: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    k: int | None = None,
    exclude: DataFrame | None = None,
) -> Retrieval:
    """Candidates, fusion, selection and gates of all questions in one plan.

    `questions`: qid, question, rewritten; `query_vectors`: qid, variant, vec; `chunks`: the
    chunk table; `postings` is needed for the hybrid search: a table, or a function that reads those of given terms from a
    stored index (`lexical.asked_postings`). `exclude` (qid, id) names rows a
    question must not get. The candidate lists are small (k per question) and written once,
    since selection, gate and trace all read them.
    """
    s, k = settings, k or settings.retrieval_k
    live = chunks.filter(is_live())
    # Excluded rows take places among the first; ask for as many more.
    spare = _most_per_question(exclude) if exclude is not None else 0
    hits = vector_topk(query_vectors, live, k + spare, ("qid", "variant"), settings=s)
    if exclude is not None:
        hits = top_k(
            hits.drop("rank").join(exclude, ["qid", "id"], "left_anti"),
            ["qid", "variant"], [F.desc("similarity"), F.asc("id")], k,
        )
    vector = materialize(sel.merge_variants(hits.drop("rank", "variant")), "vector-hits")

    if s.hybrid_enabled:
        if postings is None:
            raise ValueError("the hybrid search needs postings")
        spelt = with_folded_accents(questions.select("qid", "question", "rewritten"), "question", "rewritten")
        terms = lx.explode_terms(spelt.withColumn("terms", lexical_terms("question", "rewritten")))
        # The postings of the asked terms serve the ranking and the second gate. The rows a
        # search must not see are few, the ones it may see are nearly all.
        wanted = broadcast_if_small(terms.select("term").distinct(), 128, s)
        hidden = chunks.filter(~is_live()).select("id")
        held = postings(terms.select("term").distinct()) if callable(postings) else postings.join(wanted, "term", "left_semi")
        asked = materialize(held.join(hidden, "id", "left_anti"), "asked-postings")
        found = lx.lexical_topk(terms, asked, k + spare, settings=s)
        if exclude is not None:
            found = top_k(
                found.drop("rank").join(exclude, ["qid", "id"], "left_anti"),
                ["qid"], [F.desc("lexical_score"), F.asc("id")], k,
            )
        fused = sel.rrf_fuse(vector, found, s.rrf_k)
    else:
        fused = vector.withColumn("lexical_rank", F.lit(None).cast("int"))

    # A few rows per question against the whole chunk table: the table must not be shuffled.
    fused = broadcast_if_small(materialize(fused, "fused"), 128, s)
    chosen = sel.select_context(live.select("id", *_PLACE).join(fused, "id"), s)
    if s.hybrid_enabled:
        top_raw = vector.groupBy("qid").agg(F.max("similarity").alias("top_similarity_raw"))
        total = live.agg(F.count(F.lit(1)).alias("total_docs"))
        freq = lx.term_doc_freq(asked, terms, total)
        coverage = lx.has_discriminative_term(terms, freq, s.discriminative_max_doc_freq)
        chosen = sel.with_coverage_gate(chosen, top_raw, coverage, s)
    else:
        chosen = chosen.withColumn("uncovered", F.lit(False))
    columns = ["qid", "id", "position", "similarity", "lexical_rank", *_PLACE, "selection_reason", "uncovered"]
    chosen = materialize(chosen.select(*columns), "selected")
    return Retrieval(
        chosen.filter(~F.col("uncovered")).drop("uncovered"), sel.selection_trace(questions, vector, chosen, s)
    )


def contexts(retrieval: Retrieval, chunks: DataFrame, kinds: DataFrame | None = None, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(selected rows with companions, context text per question).

    Companions go only to questions of the kinds that want numbers (`kinds`: qid, question_type).
    """
    rows = retrieval.selected.withColumn("companion", F.lit(False))
    if settings.companions_enabled:
        wanting = retrieval.selected
        if kinds is not None:
            eligible = kinds.filter(F.col("question_type").isin("conceptual", "quantitative")).select("qid")
            wanting = wanting.join(eligible, "qid", "left_semi")
        live = chunks.filter(is_live())
        extra = sel.add_companions(wanting, live, settings).filter("companion")
        place = live.select("id", "original_file_name", "page_start", "page_end")
        extra = broadcast_if_small(materialize(extra, "companions"), 128, settings)
        added = place.join(extra, "id").select(
            "qid", "id", "position", "similarity", F.lit(None).cast("int").alias("lexical_rank"), *_PLACE,
            F.lit("companion").alias("selection_reason"), "companion",
        )
        rows = materialize(rows.unionByName(added), "context-rows")
    return rows, sel.build_context(rows, chunks, settings=settings)


def negative_control(retrieval: Retrieval, k: int) -> DataFrame:
    """The first k rows per question only: metrics must fall on it."""
    return ranked(retrieval.selected, ["qid"], [F.asc("position")], "_r").filter(F.col("_r") < k).drop("_r")
