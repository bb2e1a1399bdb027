import os

import pytest

import catalog
from catalog.compare import connect, rows_of

DATA = "/root/testdata/sf0.001"

catalog.load()

# One query of each kind; `python -m catalog.compare` runs them all.
SAMPLE = (
    "vector_topk", "lexical_topk", "retrieve_selected", "citations", "companions", "file_summaries", "recover_content", "assess_extraction",
    "assign_pages", "chunk_documents_total", "question_analysis", "unsupported_numbers", "summarize", "grade_answers", "measure_pairs",
    "admit_jobs", "admit_batch", "window_counts",
)


def test_every_check_has_a_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 100


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(DATA):
        assert entry.entry(spark).count() >= 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    cur = connect(DATA).execute(catalog.ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(columns, cur.fetchall())
