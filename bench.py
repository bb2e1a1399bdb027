"""Headline queries: prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import time

import catalog
from catalog.session import local_session

HEADLINE = (
    "vector_topk",
    "vector_topk_variants",
    "lexical_topk",
    "rrf_fuse",
    "retrieve_selected",
    "citations",
    "file_summaries",
    "assess_extraction",
    "assign_pages",
    "chunk_documents",
    "filter_chunks",
    "normalize_text",
    "unsupported_numbers",
    "golden_census",
    "summarize",
    "measure_pairs",
    "admit_batch",
    "window_counts",
)


def run(spark, name: str, sf_dir: str) -> None:
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    catalog.load()
    # One untimed round over the smallest tables, so that the figures are those of a running
    # session and not of class loading.
    smallest = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm = smallest if os.path.isdir(smallest) else sf_dir
    for name in HEADLINE:
        run(spark, name, warm)
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(spark, name, sf_dir)
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
