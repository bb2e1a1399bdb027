import pytest
from pyspark.sql import functions as F

from corpuscle.functions import text as X


def over(spark, fn, cases):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.r for r in df.select("i", fn("t").alias("r")).collect()}
    for i, (t, want) in enumerate(cases):
        assert got[i] == want, (t, got[i], want)


def test_lines(spark):
    over(spark, X.is_page_number, [("3/12", True), ("  11/12 ", True), ("3/12 x", False), ("", False), ("1-2", False)])
    over(spark, X.is_legal, [("© 2020", True), ("  Copyright me", True), ("ALL RIGHTS RESERVED.", True), ("no copyright", False)])
    over(spark, X.is_editorial, [("1/2", True), ("copyright", True), ("text", False)])


def test_signal(spark):
    over(spark, X.has_signal, [
        ("12 mg", True), ("1.2 ± 0.3", True), ("( 5.5 )", True), ("p < 0.05", True), ("n = 12", True), ("1:10", True),
        ("the results", True), ("control group", True), ("measured value", True), ("Area was 7", True), ("Fig one", True),
        ("see AB now", True), ("100 %", True), ("a ≥ b", True), ("plain words only", False), ("   ", False), ("A\n7", False),
    ])


def test_clean_text(spark):
    over(spark, X.clean_text, [
        ("a\n\n1/3\nCopyright x\nb", "a\nb"), ("  \n ", "  \n "), ("one", "one"), ("1/2", ""), (None, None),
    ])


def test_garbled(spark):
    long = "x" * 100
    over(spark, X.is_garbled, [(None, True), ("short", True), (long, False), (long + "?" * 4, False), (long + "?" * 5, True)])
    over(spark, X.is_context_poor, [("x" * 199, True), ("x" * 200, False), ("x" * 200 + "?" * 20, True), (" " * 300, True)])


def test_normalize(spark):
    over(spark, X.normalize_text, [
        ("  A  b\n", "a b"), ("64,10%", "64.10%"), ("17,000", "17,000"), ("1,26 x 10⁸", "1.26 x 108"),
        ("“q” – ‘r’", "\"q\" - 'r'"), (None, ""), ("1,2,3", "1.2,3"),
    ])


def test_nfkc_only_where_needed(spark):
    df = spark.createDataFrame([("ﬁsh ½",), ("plain",), ("élan",), (None,)], "t string")
    assert [r.t for r in X.with_nfkc(df, "t").collect()] == ["fish 1⁄2", "plain", "élan", None]
    folded = X.with_folded_accents(spark.createDataFrame([("ação",), ("ő",), ("x",)], "t string"), "t")
    assert [r.t for r in folded.collect()] == ["acao", "o", "x"]


def test_numbers(spark):
    over(spark, X.extract_numbers, [
        ("3 groups, 12 fish, 6.4 and 7%", ["12", "6.4", "7%"]), ("64,10% of 1.000", ["64.10%", "1.000"]), ("none", []),
    ])


def test_digit_density(spark):
    over(spark, lambda c: F.round(X.digit_density(c), 4), [("a1b2", 0.5), ("", 0.0), ("x²", 0.5)])


@pytest.mark.parametrize("blank", ["", " \t\n", " "])
def test_blank(spark, blank):
    over(spark, X.is_blank, [(blank, True), (blank + "x", False)])


def test_forms_of_many_texts(spark):
    """A batch is brought to its form in slices, at most so many texts at a time."""
    assert X._TEXTS_AT_ONCE < 700
    df = spark.range(700).coalesce(1).selectExpr("id", "CASE WHEN id % 3 = 0 THEN concat('ő', id) WHEN id % 3 = 1 THEN concat('ﬁ', id) END AS t")
    folded = {r.id: r.t for r in X.with_folded_accents(df, "t").collect()}
    assert folded == {i: (f"o{i}", f"fi{i}", None)[i % 3] for i in range(700)}
