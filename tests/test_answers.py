from pyspark.sql import functions as F

from corpuscle.functions import answers as A
from corpuscle.functions import vocab as V


def test_skeleton(evaluate):
    assert evaluate(A.is_skeleton, "Não há dados.") is True
    assert evaluate(A.is_skeleton, "Não há dados. " + "x" * 400) is False
    assert evaluate(A.is_skeleton, "não há dados ... nao ha dados " + "x" * 400) is True
    assert evaluate(A.is_skeleton, "") is False
    assert evaluate(A.is_skeleton, "A full answer of 64.1 %.") is False


def test_refusal(evaluate):
    assert evaluate(A.is_refusal, "") is True
    assert evaluate(A.is_refusal, "Well. " + V.REFUSAL_MESSAGES["pt-BR"]) is True
    assert evaluate(A.is_refusal, V.REFUSAL_MESSAGES["en"].upper()) is True
    assert evaluate(A.is_refusal, "short") is False
    assert evaluate(A.has_sentinel, "so: " + V.NO_ANSWER_SENTINEL) is True


def test_unsupported_numbers(evaluate):
    assert evaluate(A.unsupported_numbers, "12.5 and 98% and 12.5", "only 12,5 here") == ["98%"]
    # Containment is by substring: 6.4 is found inside 16.40.
    assert evaluate(A.unsupported_numbers, "6.4", "16.40") == []
    assert evaluate(A.unsupported_numbers, "3 groups", "") == []


def test_mention_coverage(spark):
    df = spark.createDataFrame(
        [("growth of 64,10% in ponds", ["64.10% growth", "absent marker"]), ("x", []), ("x", ["a b"]), (None, ["ponds"])],
        "a string, p array<string>",
    )
    assert [r[0] for r in df.select(A.mention_coverage("a", "p")).collect()] == [0.5, 1.0, 0.0, 0.0]


def test_relevance(evaluate):
    assert evaluate(A.is_relevant, "Qual o indice volumetrico?", "O índice é 3") is True
    assert evaluate(A.is_relevant, "Which species survive?", "nothing here") is False
    assert evaluate(A.is_relevant, "o que é?", "tanto faz") is True


def test_parsing(evaluate):
    assert evaluate(A.parse_verdict, "Insufficient - partial") == "insufficient"
    assert evaluate(A.parse_verdict, "partial, sufficient") == "partial"
    assert evaluate(A.parse_verdict, "sufficient") == "sufficient"
    assert evaluate(A.parse_verdict, "??") == "partial"
    assert evaluate(A.parse_score, "85/100") == 851
    assert evaluate(A.parse_score, "none") is None
    assert evaluate(A.parse_score_clamped, "85/100") == 85
    assert evaluate(A.parse_score_clamped, "250") == 100


def test_significant_tokens(evaluate):
    assert evaluate(A.significant_tokens, "The Growth was 6,4 cm") == ["growth", "6.4"]


def test_bound_value_is_shared(spark):
    from corpuscle.functions.text import bind

    df = spark.range(3).select(bind(F.col("id") + 1, lambda v: v * v).alias("r"))
    assert [r.r for r in df.collect()] == [1, 4, 9]
