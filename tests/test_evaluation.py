import random
import statistics

import pytest

from corpuscle.operators import evaluation as ev


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 37, 100, 199])
def test_exclusive_p95(spark, n):
    rnd = random.Random(n)
    values = [rnd.randrange(50) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v int")
    want = statistics.quantiles(values, n=20)[18] if n >= 20 else max(values)
    assert ev.exclusive_p95(df, "v").first()[0] == pytest.approx(want)


@pytest.mark.parametrize("kind", ["exponents", "hot", "tiny steps"])
def test_order_statistics(spark, kind):
    rnd = random.Random(4)
    values = {
        "exponents": [rnd.choice([-1, 1]) * 10.0 ** rnd.uniform(-300, 300) for _ in range(3000)],
        "hot": [5.0] * 2000 + [rnd.random() for _ in range(1000)],
        "tiny steps": [1.0 + i * 2.0**-52 for i in range(1500)] * 2,
    }[kind]
    rnd.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    ranks = [1, 2, 1500, 1501, 2850, 2851, 3000]
    assert ev.order_statistics(df, "v", ranks) == [sorted(values)[k - 1] for k in ranks]
    want = statistics.quantiles(values, n=20)[18]
    assert ev.exclusive_p95(df, "v").first()[0] == pytest.approx(want)
    assert ev.order_statistics(df.limit(0), "v", [1]) == [None]


GOLDEN = "qid string, scope string, expected_source_file string, expected_passages array<string>, must_mention array<string>, history array<array<string>>"


def golden(spark):
    return spark.createDataFrame(
        [("a", "in_corpus", "f.pdf", ["64,10%", "not there"], ["growth 12"], [["q", "a"]]), ("b", "out_of_corpus", None, [], [], []), ("c", "in_corpus", "g.pdf", ["x"], [], [])], GOLDEN
    )


def test_retrieval(spark):
    hits = spark.createDataFrame([("a", 0, "nothing", 0.9), ("a", 1, "we saw 64.10% here", 0.8), ("a", 2, "64.10% again", None), ("b", 0, "y", 0.7)], "qid string, position int, content string, similarity double")
    got = {r.qid: r for r in ev.eval_retrieval(golden(spark), hits).collect()}
    a = got["a"]
    assert (a.recall, a.first_hit_rank, a.missed_passages, a.top_similarity, a.min_similarity, a.retrieved_count) == (0.5, 1, ["not there"], 0.9, 0.0, 3)
    assert got["b"].recall is None and got["c"].recall == 0.0 and got["c"].retrieved_count == 0


def test_generation(spark):
    answers = spark.createDataFrame([("a", "growth of 12", ["f.pdf", "g.pdf"]), ("b", "", []), ("c", "nao ha dados", ["g.pdf"])], "qid string, answer string, cited_files array<string>")
    got = {r.qid: r for r in ev.eval_generation(golden(spark), answers).collect()}
    assert (got["a"].citation_precision, got["a"].mention_coverage, got["a"].refusal_correct) == (0.5, 1.0, True)
    assert (got["b"].refused, got["b"].refusal_correct, got["b"].mention_coverage, got["b"].citation_precision) == (True, True, None, None)
    assert got["c"].skeleton and not got["c"].refused


def test_census(spark):
    chunks = spark.createDataFrame([("It was 64.10%  exactly",), ("x",)], "content string")
    r = ev.golden_census(golden(spark), chunks).first()
    assert (r.questions, r.in_corpus, r.out_of_corpus, r.with_history, r.passages_checked, r.passages_missing, r.valid) == (3, 2, 1, 1, 3, 1, False)
    assert [tuple(m) for m in ev.missing_passages(golden(spark), chunks).collect()] == [("a", "not there")]


def test_passages_in_several_passes(spark):
    from corpuscle.config import Settings

    chunks = spark.createDataFrame([(f"word{i} tail",) for i in range(20)], "content string").repartition(3)
    wanted = spark.createDataFrame([(f"word{i}",) for i in range(0, 40, 2)], "passage string")
    tiny = Settings(broadcast_max_bytes=30)
    assert {r[0] for r in ev.passages_in_corpus(wanted, chunks, tiny).collect()} == {f"word{i}" for i in range(0, 20, 2)}


def test_passages_over_borders_and_of_few_words(spark):
    """Against plain containment in the joined text of each file."""
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "été", "64.10%", "x", "42", "delta", "ω"]
    files = {f: [" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 30, 60]))) for _ in range(40)] for f in ("f", "g")}
    rows = [(f, i, t) for f, parts in files.items() for i, t in enumerate(parts)] + [(None, None, "alone"), ("h", 3, "left of"), ("h", 5, "a gap")]
    joined = [" ".join(parts) for parts in files.values()] + ["alone", "left of", "a gap"]
    wanted = set()
    for text in joined[:2]:
        for _ in range(120):
            start = rnd.randrange(len(text))
            wanted.add(text[start : start + rnd.choice([1, 2, 3, 5, 12, 60, 250])].strip())
    wanted |= {"never there", "left of a gap", "x" * 9, "beta beta beta beta beta beta beta beta", "é", "0%", "alone"}
    wanted.discard("")
    chunks = spark.createDataFrame(rows, "original_file_id string, chunk_index int, content string").repartition(5)
    passages = spark.createDataFrame([(w,) for w in wanted], "passage string")
    got = {r[0] for r in ev.passages_in_corpus(passages, chunks).collect()}
    assert got == {w for w in wanted if any(w in t for t in joined)}
    plan = ev.passages_in_corpus(passages, chunks)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_summary(spark):
    cols = (
        "qid string, scope string, recall double, top_similarity double, selected_count int, context_chars int, selection_reason string, refused boolean, skeleton boolean, "
        "refusal_correct boolean, mention_coverage double, citation_file_count int, citation_precision double, groundedness double, answers_question double"
    )
    rows = [
        ("col-1", "in_corpus", 1.0, 0.7, 8, 100, "min_fill", False, False, True, 1.0, 2, 0.5, 90.0, 80.0),
        ("x", "in_corpus", 0.5, 0.6, 6, 300, "relative_window", False, True, True, 0.5, 1, 1.0, None, 60.0),
        ("y", "out_of_corpus", None, 0.4, 0, 0, "refused", True, False, True, None, 0, None, None, None),
        ("z", "out_of_corpus", None, 0.6, 0, 0, "refused_no_lexical_coverage", False, False, False, None, 0, None, None, 10.0),
        ("n", "in_corpus", 0.0, 0.5, 9, 200, "min_fill", None, None, None, None, None, None, None, None),
    ]
    s = ev.summarize(spark.createDataFrame(rows, cols)).first()
    assert (s.questions_total, s.questions_in_corpus, s.mean_recall, s.perfect_recall_rate) == (5, 3, 0.5, 0.333)
    assert (s.starvation_rate, s.mean_selected_chunks, s.p95_context_chars) == (0.333, 4.6, 300)
    assert (s.col_questions_total, s.col_mean_recall, s.col_starvation_rate) == (1, 1.0, 0.0)
    assert (s.refusal_correct_rate, s.out_of_corpus_refusal_rate, s.skeleton_rate, s.citation_precision) == (0.75, 0.5, 0.333, 0.75)
    assert (s.mean_groundedness, s.mean_answers_question, s.citation_file_count_mean) == (90.0, 50.0, 1.0)


def test_verdicts(spark):
    df = spark.createDataFrame([("in_corpus", "partial"), ("in_corpus", "insufficient"), ("out_of_corpus", "insufficient"), ("out_of_corpus", "partial")], "scope string, verdict string")
    assert {r.scope: (r.questions, r.correct, r.accuracy) for r in ev.verdict_accuracy(df).collect()} == {"all": (4, 2, 0.5), "in_corpus": (2, 1, 0.5), "out_of_corpus": (2, 1, 0.5)}


def test_cost(spark):
    usage = spark.createDataFrame([("r", "gpt-4o", 1000000, 100000), ("r", "other", 5, 5)], "run_id string, model string, input_tokens long, output_tokens long")
    r = ev.run_cost(usage, ev.price_table(spark)).first()
    assert (r.calls, round(r.cost_usd, 6)) == (2, 3.5)
    assert spark.range(1).select(ev.embedding_calls(28, 3, True)).first()[0] == 196


def test_short_passages_in_slices(spark):
    """Short passages are looked for in slices of a batch, the last one included."""
    assert ev._TEXTS_AT_ONCE < 700
    texts = spark.range(700).coalesce(1).selectExpr("concat('text no', id, 'x here') AS text")
    block = spark.createDataFrame([("no0x",), ("no300x",), ("no699x",), ("no700x",)], "needle string")
    assert {r.needle for r in ev._by_piece(texts, block).collect()} == {"no0x", "no300x", "no699x"}
