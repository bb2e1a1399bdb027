import dataclasses

import pytest

from corpuscle.config import Settings
from corpuscle.operators import lexical as lx
from corpuscle.operators import selection as sel

S = Settings()


def ranked(spark, sims, chars=100, lexical=()):
    """One question; `lexical` positions are rows of the lexical list only."""
    data = [
        ("q", i, i, None if i in lexical else float(s), 0 if i in lexical else None, chars if isinstance(chars, int) else chars[i])
        for i, s in enumerate(sims)
    ]
    return spark.createDataFrame(data, "qid string, id int, rank int, similarity double, lexical_rank int, n_chars int")


def chosen(spark, *args, **kw):
    out = sel.select_context(ranked(spark, *args, **kw), S).orderBy("position").collect()
    return [r.id for r in out], (out[0].selection_reason if out else "refused")


def test_floor(spark):
    assert chosen(spark, []) == ([], "refused")
    assert chosen(spark, [0.529])[1] == "refused"
    assert chosen(spark, [0.53]) == ([0], "min_fill")


@pytest.mark.parametrize("n, want, reason", [(7, 7, "min_fill"), (8, 8, "relative_window"), (16, 16, "relative_window"), (17, 16, "relative_window")])
def test_counts(spark, n, want, reason):
    ids, why = chosen(spark, [0.7] * n)
    assert (len(ids), why) == (want, reason)


def test_min_fill_takes_the_first_of_the_ranking(spark):
    ids, why = chosen(spark, [0.9] * 3 + [0.5] * 20)
    assert ids == list(range(8)) and why == "min_fill"


def test_budget(spark):
    assert len(chosen(spark, [0.7] * 16, chars=[3000] * 16)[0]) == 8
    assert len(chosen(spark, [0.7] * 16, chars=[1000] * 8 + [14001] + [1] * 7)[0]) == 8
    assert len(chosen(spark, [0.7] * 16, chars=[1000] * 8 + [14000] + [1] * 7)[0]) == 9


def test_lexical_rows_have_no_similarity(spark):
    # A lexical hit on top cannot rescue weak vectors, nor be cut by the similarity floor.
    assert chosen(spark, [0, 0.5, 0.5], lexical=(0,))[1] == "refused"
    ids, _ = chosen(spark, [0] + [0.6] * 9, lexical=(0,))
    assert ids == list(range(10))


def test_fusion(spark):
    v = spark.createDataFrame([("q", "a", 0.9, 0), ("q", "b", 0.8, 1)], "qid string, id string, similarity double, rank int")
    l = spark.createDataFrame([("q", "b", 0), ("q", "c", 1), ("q", "d", 2)], "qid string, id string, rank int")
    got = sel.rrf_fuse(v, l).orderBy("rank").collect()
    assert [(r.id, r.similarity, r.lexical_rank) for r in got] == [("b", 0.8, None), ("a", 0.9, None), ("c", None, 1), ("d", None, 2)]
    # Equal scores: the vector row first.
    tie = sel.rrf_fuse(v.limit(1), spark.createDataFrame([("q", "z", 0)], "qid string, id string, rank int")).orderBy("rank").collect()
    assert [r.id for r in tie] == ["a", "z"]


def test_merge_variants(spark):
    hits = spark.createDataFrame([("q", "a", 0.5), ("q", "a", 0.7), ("q", "b", 0.6)], "qid string, id string, similarity double")
    assert [(r.id, r.similarity) for r in sel.merge_variants(hits).orderBy("rank").collect()] == [("a", 0.7), ("b", 0.6)]


def test_coverage_gate(spark):
    picked = spark.createDataFrame([(q, q, 0, 10, "relative_window") for q in ("mid", "mid_ok", "strong", "no_terms")], "qid string, id string, position int, n_chars int, selection_reason string")
    top = spark.createDataFrame([("mid", 0.6), ("mid_ok", 0.6), ("strong", 0.65), ("no_terms", 0.6)], "qid string, top_similarity_raw double")
    terms = spark.createDataFrame([("mid", "fish"), ("mid", "gone"), ("mid_ok", "edge"), ("strong", "fish")], "qid string, term string")
    freq = spark.createDataFrame([("fish", 21, 100), ("gone", 0, 100), ("edge", 20, 100)], "term string, doc_count long, total_docs long")
    cover = lx.has_discriminative_term(terms, freq)
    got = {r.qid: r.uncovered for r in sel.with_coverage_gate(picked, top, cover, S).collect()}
    assert got == {"mid": True, "mid_ok": False, "strong": False, "no_terms": False}


def table_chunk(digits, n):
    return "7" * digits + "x" * (n - digits)


def test_companions(spark):
    selected = spark.createDataFrame(
        [("q", "s0", 0, 100, 0.9, "f1"), ("q", "s1", 1, 100, 0.8, "f2"), ("q", "s2", 2, 100, 0.7, None), ("q", "s3", 3, 100, 0.7, "f9")],
        "qid string, id string, position int, n_chars int, similarity double, original_file_id string",
    )
    chunks = spark.createDataFrame(
        [
            ("s0", "f1", table_chunk(100, 100)), ("big", "f1", table_chunk(990, 1000)), ("c1", "f1", table_chunk(200, 300)),
            ("c2", "f2", table_chunk(150, 300)), ("c3", "f2", table_chunk(100, 300)), ("c4", "f1", table_chunk(10, 50)), ("far", "f9", table_chunk(300, 300)),
        ],
        "id string, original_file_id string, content string",
    )
    s = dataclasses.replace(S, context_char_budget=400 + 700)
    got = sel.add_companions(selected, chunks, s).orderBy("position").collect()
    # The densest does not fit and is skipped; the file below the top three gives nothing.
    assert [(r.id, r.companion) for r in got] == [("s0", False), ("s1", False), ("s2", False), ("s3", False), ("c1", True), ("c2", True), ("c4", True)]
    tight = sel.add_companions(selected, chunks, dataclasses.replace(S, context_char_budget=100))
    assert tight.filter("companion").count() == 0


def test_companion_band_is_small(spark):
    """One file of many lengths: the band stays far below one row per length, and holds exactly the rows that few others beat."""
    import random

    rnd = random.Random(8)
    s = dataclasses.replace(S, context_max_chunks=4, context_min_chunks=2, companion_max_total=3, context_char_budget=10**6)
    rows = [(i, "f", rnd.randrange(1, 10**6), rnd.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, original_file_id string, n_chars int, digit_density double").repartition(5)
    got = {r.id for r in sel.companion_candidates(df, s).collect()}
    ordered = sorted(rows, key=lambda r: (-r[3], r[0]))
    want = {r[0] for i, r in enumerate(ordered) if sum(o[2] <= r[2] for o in ordered[:i]) < 7}
    assert got == want and len(got) < 120


def test_companion_candidates_keep_what_any_question_needs(spark):
    """Brute force over random files: the bounded candidate set gives the same picks."""
    import random

    rnd = random.Random(3)
    s = dataclasses.replace(S, context_max_chunks=4, context_min_chunks=2, companion_max_total=3, context_char_budget=120)
    chunks = [(i, f"f{rnd.randrange(3)}", table_chunk(rnd.randrange(8), rnd.choice([10, 11, 30]))) for i in range(300)]
    selected = []
    for q in range(30):
        for pos, c in enumerate(rnd.sample(chunks, 4)):
            selected.append((q, c[0], pos, len(c[2]), 0.5, c[1]))
    df = sel.add_companions(
        spark.createDataFrame(selected, "qid int, id int, position int, n_chars int, similarity double, original_file_id string"),
        spark.createDataFrame(chunks, "id int, original_file_id string, content string"), s,
    )
    got = {}
    for r in df.filter("companion").orderBy("qid", "position").collect():
        got.setdefault(r.qid, []).append(r.id)
    for q in range(30):
        mine = [r for r in selected if r[0] == q]
        left, files, present, picks = 120 - sum(r[3] for r in mine), {r[5] for r in mine[:3]}, {r[1] for r in mine}, []
        pool = [c for c in chunks if c[1] in files]
        for c in sorted(pool, key=lambda c: (-sum(ch == "7" for ch in c[2]) / len(c[2]), c[0])):
            if len(picks) < 3 and c[0] not in present and len(c[2]) <= max(left, 0):
                picks.append(c[0])
                left -= len(c[2])
        assert got.get(q, []) == picks


def test_citations(spark):
    rows = spark.createDataFrame(
        [
            ("q", 0, "b.pdf", 3, 3, False), ("q", 1, "a.pdf", 1, 2, False), ("q", 2, "b.pdf", 7, None, False), ("q", 3, None, 1, 1, False),
            ("q", 4, "only.pdf", 1, 1, True), ("q", 5, "c.pdf", None, None, False), ("q", 6, "d.pdf", 1, 1, False), ("q", 7, "a.pdf", 2, 4, True), ("q", 8, "c.pdf", 5, 4, False),
        ],
        "qid string, position int, original_file_name string, page_start int, page_end int, companion boolean",
    )
    got = [(r.file, r.pages) for r in sel.citations(rows, 3).orderBy("citation_rank").collect()]
    assert got == [("b.pdf", [3, 7]), ("a.pdf", [1, 2, 3, 4]), ("c.pdf", [])]


def test_context(spark):
    picked = spark.createDataFrame([("q", 2, 0), ("q", 1, 1)], "qid string, id int, position int")
    chunks = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "id int, content string")
    assert sel.build_context(picked, chunks).first().context == "two\n\none"
