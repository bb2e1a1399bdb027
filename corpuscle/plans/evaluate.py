"""One evaluation run over a golden question table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.config import DEFAULTS, Settings, broadcast_if_small, materialize
from corpuscle.operators import evaluation as ev
from corpuscle.plans.retrieve import Retrieval


def evaluate_run(
    golden: DataFrame, retrieval: Retrieval, chunks: DataFrame, answers: DataFrame | None = None, settings: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """(one row per question, one summary row). `answers`: qid, answer, cited_files."""
    kept = broadcast_if_small(retrieval.selected.select("qid", "id", "position", "similarity"), 128, settings)
    texts = chunks.select("id", "content").join(kept, "id")
    found = ev.eval_retrieval(golden, texts)
    trace = retrieval.trace.select("qid", "candidate_count", "top_similarity_raw", "selected_count", "selection_reason")
    rows = found.join(trace, "qid", "left")
    if answers is not None:
        rows = rows.join(ev.eval_generation(golden, answers).drop("scope"), "qid", "left")
    else:
        for name, kind in (
            ("refused", "boolean"), ("skeleton", "boolean"), ("refusal_correct", "boolean"),
            ("mention_coverage", "double"), ("citation_file_count", "int"), ("citation_precision", "double"),
        ):
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    for name in ("groundedness", "answers_question"):
        rows = rows.withColumn(name, F.lit(None).cast("double"))
    rows = materialize(rows, "eval-results")
    return rows, ev.summarize(rows, settings)
