"""Batch answering: routing by verdict, one reformulation, refusals, numeric checks, grades."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.config import DEFAULTS, Settings, materialize
from corpuscle.functions import answers as A
from corpuscle.functions import questions as Q
from corpuscle.functions.text import with_folded_accents, with_nfkc
from corpuscle.operators.selection import citations
from corpuscle.plans.models import EmbedFn, TextFn, with_embeddings, with_model_text
from corpuscle.plans.retrieve import contexts, query_variants, retrieve


def route(verdict: Column | str, reformulations: Column | str) -> Column:
    v = F.col(verdict) if isinstance(verdict, str) else verdict
    n = F.col(reformulations) if isinstance(reformulations, str) else reformulations
    return F.when(v != "insufficient", "generate").when(n < 1, "reformulate").otherwise("give_up")


def verdict_of(context: Column | str, judged: Column | str) -> Column:
    """No context is insufficient without asking; else the judge's word."""
    c = F.col(context) if isinstance(context, str) else context
    return F.when(F.coalesce(c, F.lit("")) == "", "insufficient").otherwise(A.parse_verdict(judged))


def decide_context(state: DataFrame) -> DataFrame:
    """Choose between the two retrieval passes.

    In: context_1, judged_1, confidence_1 and the same with _2 (null where the second pass
    did not run). Out: context, verdict, confidence, reformulation_count, route.
    """
    first = verdict_of("context_1", "judged_1")
    second = verdict_of("context_2", "judged_2")
    out = state.withColumn("_first", first).withColumn("reformulation_count", F.when(first == "insufficient", 1).otherwise(0))
    again = F.col("_first") == "insufficient"
    out = out.withColumn("verdict", F.when(again, second).otherwise(F.col("_first")))
    out = out.withColumn("route", route("verdict", "reformulation_count"))
    refused = F.col("route") == "give_up"
    return (
        out.withColumn("context", F.when(refused, "").when(again, F.col("context_2")).otherwise(F.col("context_1")))
        .withColumn("confidence", F.when(again, F.col("confidence_2")).otherwise(F.col("confidence_1")))
        .drop("_first")
    )


def grade_answers(state: DataFrame) -> DataFrame:
    """From generated text to the final answer and its grade.

    In: question, language, route, context, generated and, where numbers were unsupported,
    regenerated. Out: answer, evaluation, unsupported_numbers, numeric_regen_count.
    """
    refused = (F.col("route") == "give_up") | A.has_sentinel("generated")
    # All forms come first: what is decided from them must not feed another table step.
    out = _comparable(state, "generated", "regenerated", "context")
    out = out.withColumns({"_asked": F.col("question"), "_plain": F.col("generated"), "_replain": F.col("regenerated")})
    out = with_folded_accents(out, "_asked", "_plain", "_replain")
    out = out.withColumn("_unsupported", A.unsupported_numbers("_generated", "_context"))
    redo = ~refused & (F.size("_unsupported") > 0) & F.col("regenerated").isNotNull()
    refused_again = redo & A.has_sentinel("regenerated")
    out = (
        out.withColumn("_refused", refused | refused_again)
        .withColumn("numeric_regen_count", F.when(redo, 1).otherwise(0))
        .withColumn(
            "answer",
            F.when(F.col("_refused"), A.refusal_message("language"))
            .when(redo, F.col("regenerated"))
            .otherwise(F.col("generated")),
        )
    )
    nothing = F.array().cast("array<string>")
    out = out.withColumn(
        "unsupported_numbers",
        F.when(F.col("_refused"), nothing)
        .when(F.col("numeric_regen_count") == 1, A.unsupported_numbers("_regenerated", "_context"))
        .otherwise(F.col("_unsupported")),
    )
    again = F.col("numeric_regen_count") == 1
    poor = (
        (F.trim(F.coalesce("answer", F.lit(""))) == "")
        | ~A.is_relevant("_asked", F.when(again, F.col("_replain")).otherwise(F.col("_plain")))
        | A.is_skeleton(F.when(again, F.col("_regenerated")).otherwise(F.col("_generated")))
    )
    return out.withColumn(
        "evaluation", F.when(F.col("_refused"), "REFUSED").when(poor, "LOW_QUALITY").otherwise("HIGH_QUALITY")
    ).drop("_unsupported", "_refused", "_generated", "_regenerated", "_context", "_asked", "_plain", "_replain")


def _comparable(df: DataFrame, *columns: str) -> DataFrame:
    """Add `_<column>`: the column in compatibility form, as the checks expect it."""
    return with_nfkc(df.withColumns({f"_{c}": F.col(c) for c in columns}), *[f"_{c}" for c in columns])


def needs_regeneration(state: DataFrame) -> DataFrame:
    """Rows whose generated text cites numbers the context lacks."""
    refused = (F.col("route") == "give_up") | A.has_sentinel("generated")
    compared = _comparable(state, "generated", "context").withColumn("unsupported", A.unsupported_numbers("_generated", "_context"))
    return compared.filter(~refused & (F.size("unsupported") > 0)).drop("_generated", "_context")


class Answers(NamedTuple):
    answers: DataFrame  # qid, answer, evaluation, verdict, confidence, ...
    sources: DataFrame  # qid, file, pages, citation_rank
    trace: DataFrame


def answer_questions(
    questions: DataFrame,
    chunks: DataFrame,
    embed: EmbedFn,
    judge: TextFn,
    generate: TextFn,
    settings: Settings = DEFAULTS,
    postings: DataFrame | None = None,
    condense: TextFn | None = None,
    rewrite: TextFn | None = None,
    paraphrase: TextFn | None = None,
) -> Answers:
    """Answer all questions (qid, question, last_question or null, optionally last_answer).

    `condense` makes a follow-up self-contained, `rewrite` extends a question by synonyms, `paraphrase` says it in
    the terms of the corpus; without them, or where their text is of no use, the fixed rules stand in. With
    `multi_query_enabled` the first retrieval asks in all these forms and keeps each chunk's best similarity; the
    words of all forms are searched.

    The second retrieval sees only questions whose first context was insufficient and is rewritten by rules alone, so
    every model runs once per row that needs it.
    """
    s = settings

    def said(rows: DataFrame, call: TextFn | None, inputs: tuple[str, ...], name: str) -> DataFrame:
        if call is None:
            return rows.select("qid", F.lit(None).cast("string").alias(name))
        return with_model_text(rows.select("qid", *inputs), call, inputs, name).select("qid", name)

    last_answer = F.col("last_answer") if "last_answer" in questions.columns else F.lit(None).cast("string")
    follow_ups = questions.filter(F.col("last_question").isNotNull()).withColumn("last_answer", F.left(F.coalesce(last_answer, F.lit("")), F.lit(500)))
    condensed = said(follow_ups, condense, ("question", "last_question", "last_answer"), "_condensed")
    base = questions.join(condensed, "qid", "left").select(
        "qid",
        "question",
        Q.question_language("question").alias("language"),
        Q.question_type("question").alias("question_type"),
        Q.condense("question", "last_question", "_condensed").alias("retrieval_query"),
    )
    base = materialize(base, "questions")

    def formulated(qs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(questions with `rewritten`, their variants) of the first pass."""
        extended = said(qs, rewrite, ("retrieval_query", "language"), "_extended")
        asked = qs.join(extended, "qid", "left").withColumn("rewritten", Q.accept_expansion("retrieval_query", "_extended", "language")).drop("_extended")
        if not s.multi_query_enabled:
            return asked, query_variants(asked, ("rewritten",), s.multi_query_variants)
        other = said(qs, paraphrase, ("retrieval_query", "language"), "_other")
        forms = asked.join(other, "qid", "left").withColumn("paraphrased", Q.accept_paraphrase("_other"))
        variants = materialize(query_variants(forms, ("retrieval_query", "rewritten", "paraphrased"), s.multi_query_variants), "query-variants")
        ordered = F.array_sort(F.collect_list(F.struct("variant", "text")))
        every = variants.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda v: v["text"]), " ").alias("rewritten"))
        return asked.drop("rewritten").join(every, "qid"), variants

    def one_pass(qs: DataFrame, n: int):
        if n == 1:
            asked, variants = formulated(qs)
        else:
            asked = qs.withColumn("rewritten", Q.expand_for_retry("retrieval_query"))
            variants = query_variants(asked, ("rewritten",), s.multi_query_variants)
        vectors = materialize(with_embeddings(variants, embed, "text", "vec"), "query-vectors")
        asked = asked.withColumn("question", F.col("retrieval_query"))
        found = retrieve(asked, vectors, chunks, s, postings, s.retrieval_k if n == 1 else s.retrieval_k_retry)
        rows, context = contexts(found, chunks, qs.select("qid", "question_type"), s)
        confidence = found.trace.select("qid", F.col("context_confidence").alias(f"confidence_{n}"))
        state = qs.join(context.withColumnRenamed("context", f"context_{n}"), "qid", "left").join(confidence, "qid")
        state = state.withColumn(f"_ask{n}", F.coalesce(f"context_{n}", F.lit("")) != "")
        asked_rows = with_model_text(
            state.filter(f"_ask{n}").select("qid", "retrieval_query", F.col(f"context_{n}").alias("context")),
            judge, ("retrieval_query", "context"), f"judged_{n}",
        ).select("qid", f"judged_{n}")
        state = state.drop(f"_ask{n}").join(asked_rows, "qid", "left")
        return materialize(state, f"pass-{n}"), rows, found.trace

    first, rows_1, trace_1 = one_pass(base, 1)
    again = first.filter(verdict_of("context_1", "judged_1") == "insufficient").select(base.columns)
    second, rows_2, trace_2 = one_pass(again, 2)
    state = decide_context(
        first.join(second.select("qid", "context_2", "confidence_2", "judged_2"), "qid", "left")
    )
    state = state.withColumn(
        "effective_type", Q.effective_type("question_type", F.coalesce("context", F.lit("")))
    )
    state = materialize(state, "routed")
    generated = with_model_text(
        state.filter(F.col("route") == "generate"), generate,
        ("question", "context", "language", "effective_type", "confidence"), "generated",
    )
    correction = needs_regeneration(generated).withColumn("unsupported", F.array_join("unsupported", ", "))
    regenerated = with_model_text(
        correction.select("qid", "question", "context", "language", "effective_type", "confidence", "unsupported"),
        generate, ("question", "context", "language", "effective_type", "confidence", "unsupported"), "regenerated",
    ).select("qid", "regenerated")
    state = (
        state.join(generated.select("qid", "generated"), "qid", "left").join(regenerated, "qid", "left")
    )
    graded = materialize(grade_answers(state), "graded")
    used = graded.filter(F.col("evaluation") != "REFUSED").select("qid", "reformulation_count")
    rows = rows_1.withColumn("_n", F.lit(0)).unionByName(rows_2.withColumn("_n", F.lit(1)))
    cited = rows.join(used, "qid").filter(F.col("_n") == F.col("reformulation_count"))
    trace = trace_1.withColumn("pass", F.lit(1)).unionByName(trace_2.withColumn("pass", F.lit(2)))
    return Answers(graded, citations(cited, s.citation_max_files), trace)
