"""Fusion of ranked lists and the gated choice of context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.config import DEFAULTS, Settings, broadcast_if_small, materialize
from corpuscle.functions.text import digit_density
from corpuscle.operators.ordering import ranked, top_k


def merge_variants(hits: DataFrame, qid: str = "qid", key: str = "id") -> DataFrame:
    """One row per chunk found by several variants: the one of highest similarity."""
    rest = [c for c in hits.columns if c not in (qid, key, "rank")]
    best = hits.groupBy(qid, key).agg(F.max_by(F.struct(*rest), F.col("similarity")).alias("_b"))
    return ranked(best.select(qid, key, "_b.*"), [qid], [F.desc("similarity"), F.asc(key)])


def rrf_fuse(vector: DataFrame, lexical: DataFrame, k: int = DEFAULTS.rrf_k, qid: str = "qid", key: str = "id") -> DataFrame:
    """Reciprocal rank fusion of two top-k lists with 0-based `rank` columns.

    A chunk of both lists keeps its similarity and gets no `lexical_rank`. Equal
    scores keep the order vector list first, each by its rank.
    """
    v = vector.select(qid, key, "similarity", F.col("rank").alias("_vr"))
    l = lexical.select(qid, key, F.col("rank").alias("_lr"))

    def share(rank: str) -> Column:
        return F.coalesce(1.0 / (k + F.col(rank) + 1), F.lit(0.0))

    fused = v.join(l, [qid, key], "full").select(
        qid,
        key,
        "similarity",
        F.when(F.col("_vr").isNull(), F.col("_lr")).alias("lexical_rank"),
        (share("_vr") + share("_lr")).alias("rrf_score"),
        F.col("_vr").isNull().alias("_late"),
        F.coalesce("_vr", "_lr").alias("_tie"),
    )
    order = [F.desc("rrf_score"), F.asc("_late"), F.asc("_tie")]
    return ranked(fused, [qid], order).drop("_late", "_tie")


def select_context(ranked_rows: DataFrame, settings: Settings = DEFAULTS, qid: str = "qid") -> DataFrame:
    """Choose the context of every question from its ranked list (top-k rows per question).

    Input: qid, rank, similarity, n_chars and optionally lexical_rank. Output: the kept
    rows with `position` (0-based) and `selection_reason`. Questions below the refusal
    floor have no rows; `selection_trace` reports them.
    """
    s = settings
    df = ranked_rows
    if "lexical_rank" not in df.columns:
        df = df.withColumn("lexical_rank", F.lit(None).cast("int"))
    per_question = Window.partitionBy(qid)
    by_rank = per_question.orderBy("rank")
    lexical_only = F.col("lexical_rank").isNotNull()
    top = F.coalesce(F.max(F.when(~lexical_only, F.col("similarity"))).over(per_question), F.lit(0.0))
    df = df.withColumn("_top", top).filter(F.col("_top") >= s.refusal_floor)

    floor = F.greatest(F.lit(s.absolute_floor), F.col("_top") - F.lit(s.relative_margin))
    in_window = lexical_only | (F.coalesce(F.col("similarity"), F.lit(0.0)) >= floor)
    df = df.withColumn("_in", in_window)
    df = df.withColumn("_kept", F.sum(F.col("_in").cast("int")).over(per_question))
    filled = F.col("_kept") < s.context_min_chunks
    df = df.withColumn("_pos", F.row_number().over(by_rank) - 1)
    df = df.filter(F.when(filled, F.col("_pos") < s.context_min_chunks).otherwise(F.col("_in")))
    df = df.withColumn("selection_reason", F.when(filled, "min_fill").otherwise("relative_window"))

    df = df.withColumn("position", F.row_number().over(by_rank) - 1).filter(
        F.col("position") < s.context_max_chunks
    )
    running = F.sum("n_chars").over(by_rank.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_running", running).filter(
        (F.col("position") < s.context_min_chunks) | (F.col("_running") <= s.context_char_budget)
    )
    return df.drop("_top", "_in", "_kept", "_pos", "_running")


def with_coverage_gate(
    chosen: DataFrame, top_raw: DataFrame, coverage: DataFrame, settings: Settings = DEFAULTS, qid: str = "qid"
) -> DataFrame:
    """Second gate of the hybrid search: add `uncovered`, true for questions of the middle band
    without a discriminative term.

    `top_raw`: qid, top_similarity_raw; `coverage`: qid, discriminative. Questions without any
    term have no coverage row and pass.
    """
    top = F.col("top_similarity_raw")
    doubtful = (
        top_raw.filter((top >= settings.refusal_floor) & (top < settings.strong_similarity))
        .join(coverage.filter(~F.col("discriminative")), qid, "left_semi")
        .select(qid, F.lit(True).alias("uncovered"))
    )
    return chosen.join(doubtful, qid, "left").withColumn("uncovered", F.coalesce("uncovered", F.lit(False)))


def selection_trace(
    questions: DataFrame, candidates: DataFrame, chosen: DataFrame, settings: Settings = DEFAULTS, qid: str = "qid"
) -> DataFrame:
    """One row per question: candidate count, raw top similarity, selected count, characters, reason.

    `chosen` is the selection with the `uncovered` mark of the second gate.
    """
    cand = candidates.groupBy(qid).agg(
        F.count(F.lit(1)).alias("candidate_count"), F.max("similarity").alias("top_similarity_raw")
    )
    kept = ~F.col("uncovered")
    picked = chosen.groupBy(qid).agg(
        F.first("selection_reason").alias("_reason"),
        F.count_if(kept).alias("selected_count"),
        F.sum(F.when(kept, F.col("n_chars"))).alias("context_chars"),
    )
    out = questions.select(qid).join(cand, qid, "left").join(picked, qid, "left")
    count = F.coalesce("selected_count", F.lit(0))
    return out.select(
        qid,
        F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
        F.coalesce("top_similarity_raw", F.lit(0.0)).alias("top_similarity_raw"),
        count.alias("selected_count"),
        F.coalesce("context_chars", F.lit(0)).alias("context_chars"),
        F.when(F.col("_reason").isNull(), "refused")
        .when(count == 0, "refused_no_lexical_coverage")
        .otherwise(F.col("_reason"))
        .alias("selection_reason"),
        F.when(F.col("top_similarity_raw") >= settings.strong_similarity, "strong")
        .otherwise("partial")
        .alias("context_confidence"),
    )


# --- companions -----------------------------------------------------------------------------


def _banded(rows: DataFrame, keep: int) -> DataFrame:
    """Of rows sorted by file and falling density, those that fewer than `keep` denser rows of their file undercut in length.

    One pass with the `keep` smallest lengths of the current file in memory.
    """
    import heapq

    def scan(frames):
        file, shortest = None, []
        for pdf in frames:
            kept = []
            for f, n in zip(pdf["_file"].tolist(), pdf["_len"].tolist()):
                if f != file:
                    file, shortest = f, []
                if len(shortest) < keep:
                    heapq.heappush(shortest, -n)
                    kept.append(True)
                else:
                    kept.append(n < -shortest[0])
                    if kept[-1]:
                        heapq.heapreplace(shortest, -n)
            yield pdf[kept]

    return rows.mapInPandas(scan, rows.schema)


def companion_candidates(chunks: DataFrame, settings: Settings = DEFAULTS, file_col: str = "original_file_id") -> DataFrame:
    """The rows of a file that any question could ever take as a companion: its skyband over density and length.

    A question excludes at most `context_max_chunks` selected rows and its own earlier picks. A row that as many denser
    rows of no greater length precede can never be chosen: whenever it fits, one of them does. What is left per
    file grows with the logarithm of its rows where the two are unrelated, and depends on no question. Tasks keep the
    band of their own rows before any row is moved; the bands of a file are merged in one sorted pass. Stored `n_chars` and
    `digit_density` are used where the table has them; no text is read then.
    """
    keep = max(settings.context_max_chunks, settings.context_min_chunks) + settings.companion_max_total
    length = F.col("n_chars") if "n_chars" in chunks.columns else F.length("content")
    density = F.col("digit_density") if "digit_density" in chunks.columns else digit_density("content")
    slim = chunks.filter(F.col(file_col).isNotNull() & (length <= settings.context_char_budget)).select(
        F.col(file_col).alias("_file"), "id", length.cast("bigint").alias("_len"), density.cast("double").alias("_density")
    )
    order = [F.asc("_file"), F.desc("_density"), F.asc("id")]
    own = _banded(slim.sortWithinPartitions(*order), keep)
    return _banded(own.repartition("_file").sortWithinPartitions(*order), keep)


def add_companions(
    selected: DataFrame,
    chunks: DataFrame,
    settings: Settings = DEFAULTS,
    qid: str = "qid",
    file_col: str = "original_file_id",
) -> DataFrame:
    """Append up to three data-rich rows of the files of the top three chunks.

    `selected` has qid, id, position, n_chars, similarity and the file column; the result
    adds `companion`. Candidates are taken by digit density; one that does not fit into
    the rest of the character budget is skipped, not a stop. What once did not fit never fits later, so each of the few
    picks is the first fitting row after the one before: a minimum per question. Only the eligible files' chunks are read.
    """
    s = settings
    used = selected.groupBy(qid).agg(F.sum("n_chars").alias("_used"), F.max("position").alias("_last"))
    eligible = (
        selected.filter((F.col("position") < s.companion_top_files) & F.col(file_col).isNotNull())
        .select(qid, F.col(file_col).alias("_file"))
        .distinct()
    )
    files = broadcast_if_small(eligible.select(F.col("_file").alias(file_col)).distinct(), 128, s)
    candidates = companion_candidates(chunks.join(files, file_col, "left_semi"), s, file_col)
    left = F.greatest(F.lit(s.context_char_budget) - F.col("_used"), F.lit(0)).cast("bigint")
    budgets = used.select(qid, left.alias("_left"), "_last")
    place = F.struct((-F.col("_density")).alias("d"), F.col("id"), F.col("_len").alias("n"), F.col("_file").alias("f"))
    pool = eligible.join(candidates, "_file").join(selected.select(qid, "id"), [qid, "id"], "left_anti").select(qid, place.alias("_c"))
    pool = materialize(pool.join(budgets, qid).filter(F.col("_c.n") <= F.col("_left")).select(qid, "_c"), "companion-pool")
    state = budgets.withColumn("_after", F.lit(None).cast(pool.schema["_c"].dataType))
    picks = None
    for i in range(s.companion_max_total):
        open_ = pool.join(state, qid).filter((F.col("_c.n") <= F.col("_left")) & (F.col("_after").isNull() | (F.col("_c") > F.col("_after"))))
        best = open_.groupBy(qid, "_left", "_last").agg(F.min("_c").alias("_c"))
        best = materialize(best.withColumn("_i", F.lit(i)), "companion-picks")
        picks = best if picks is None else picks.unionByName(best)
        state = best.select(qid, (F.col("_left") - F.col("_c.n")).alias("_left"), "_last", F.col("_c").alias("_after"))
    kept = selected.select(qid, "id", "position", "n_chars", "similarity", file_col).withColumn("companion", F.lit(False))
    if picks is None:
        return kept
    picked = picks.select(
        qid,
        F.col("_c.id").alias("id"),
        (F.col("_last") + 1 + F.col("_i")).alias("position"),
        F.col("_c.n").cast(selected.schema["n_chars"].dataType).alias("n_chars"),
        F.lit(0.0).alias("similarity"),
        F.col("_c.f").alias(file_col),
        F.lit(True).alias("companion"),
    )
    return kept.unionByName(picked)


# --- context and citations ------------------------------------------------------------------


def build_context(
    selected: DataFrame, chunks: DataFrame, qid: str = "qid", settings: Settings = DEFAULTS
) -> DataFrame:
    """Contents in order of position, joined by a blank line. The text joins the plan only here."""
    wanted = broadcast_if_small(selected.select(qid, "id", "position"), 128, settings)
    rows = chunks.select("id", "content").join(wanted, "id")
    ordered = F.array_sort(F.collect_list(F.struct("position", "content")))
    return rows.groupBy(qid).agg(
        F.array_join(F.transform(ordered, lambda r: r["content"]), "\n\n").alias("context")
    )


def citations(selected: DataFrame, max_files: int = DEFAULTS.citation_max_files, qid: str = "qid") -> DataFrame:
    """Cited files in order of first appearance with their distinct pages.

    `selected`: qid, position, original_file_name, page_start, page_end, companion.
    A file found only through companions is not cited.
    """
    named = selected.filter(F.coalesce("original_file_name", F.lit("")) != "")
    pages = F.when(
        F.col("page_start").isNotNull(),
        F.filter(
            F.sequence("page_start", F.greatest("page_start", F.coalesce("page_end", "page_start"))),
            lambda p: p <= F.coalesce("page_end", "page_start"),
        ),
    )
    files = named.withColumn("_pages", pages).groupBy(qid, F.col("original_file_name").alias("file")).agg(
        F.min("position").alias("_first"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_pages")))).alias("pages"),
        F.bool_or(~F.col("companion")).alias("_genuine"),
    )
    genuine = files.filter("_genuine")
    return top_k(genuine, [qid], [F.asc("_first")], max_files, "citation_rank").drop("_first", "_genuine")
