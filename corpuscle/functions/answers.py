"""Answer checks: refusals, empty skeletons, grounding of numbers, coverage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscle.functions import vocab as V
from corpuscle.functions.text import (
    any_of, bind, col, extract_numbers, fold_accents, normalize_text, strip, text_array,
)


def count_occurrences(text: Column, needles) -> Column:
    """Non-overlapping occurrences of fixed strings in a bound text."""
    return F.aggregate(
        text_array(needles),
        F.lit(0),
        lambda n, needle: n
        + ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int"),
    )


def is_skeleton(answer: Column | str) -> Column:
    """Formally structured answers that only say that there is no data."""

    def check(text: Column) -> Column:
        short = F.length(text) < V.SKELETON_SHORT_CHARS
        return (F.length(text) > 0) & bind(
            count_occurrences(text, V.SKELETON_MARKERS), lambda hits: (hits >= 2) | ((hits >= 1) & short)
        )

    return bind(normalize_text(answer), check)


def refusal_message(language: Column | str) -> Column:
    return F.when(col(language) == "pt-BR", F.lit(V.REFUSAL_MESSAGES["pt-BR"])).otherwise(
        F.lit(V.REFUSAL_MESSAGES["en"])
    )


def is_refusal(answer: Column | str) -> Column:
    known = [" ".join(m.lower().split()) for m in V.REFUSAL_MESSAGES.values()]
    return bind(
        normalize_text(answer), lambda text: (F.length(text) == 0) | any_of([text.contains(m) for m in known])
    )


def has_sentinel(answer: Column | str) -> Column:
    return F.coalesce(col(answer).contains(V.NO_ANSWER_SENTINEL), F.lit(False))


def unsupported_numbers(answer: Column | str, context: Column | str) -> Column:
    """Distinct numbers of the answer, in order, that the context does not contain."""
    numbers = F.array_distinct(extract_numbers(answer))
    return bind(normalize_text(context), lambda known: F.filter(numbers, lambda n: ~known.contains(n)))


def significant_tokens(c: Column | str) -> Column:
    tokens = F.regexp_extract_all(normalize_text(c), F.lit(V.TOKEN_PATTERN), F.lit(0))
    return F.filter(tokens, lambda t: t.rlike(r"\p{Nd}") | (F.length(t) > 4))


def mention_coverage(answer: Column | str, points: Column | str) -> Column:
    """Share of points of which at least 60 % of the tokens occur in the answer."""
    points = F.coalesce(col(points), F.array().cast("array<string>"))

    def covered(text: Column, tokens: Column) -> Column:
        hits = F.size(F.filter(tokens, lambda t: text.contains(t)))
        return (F.size(tokens) > 0) & (hits / F.greatest(F.size(tokens), F.lit(1)) >= 0.6)

    token_lists = F.transform(points, significant_tokens)
    share = bind(
        normalize_text(answer),
        lambda text: F.size(F.filter(token_lists, lambda tokens: covered(text, tokens))) / F.greatest(F.size(token_lists), F.lit(1)),
    )
    return F.when(F.size(points) == 0, F.lit(1.0)).otherwise(share)


def relevant_words(question: Column | str) -> Column:
    """Question words longer than four characters that are no stop words."""
    words = F.filter(F.split(strip(question), r"(?U)\s+"), lambda w: F.length(w) > 4)
    bare = F.transform(words, lambda w: F.btrim(F.lower(w), F.lit(V.RELEVANCE_EDGE_MARKS)))
    return F.filter(bare, lambda w: ~F.array_contains(text_array(V.RELEVANCE_STOPWORDS), w))


def is_relevant(question: Column | str, answer: Column | str) -> Column:
    """Some significant word of the question occurs in the answer, Latin accents aside.

    For letters of any script bring both through `with_folded_accents` first.
    """
    words = F.transform(relevant_words(question), lambda w: F.lower(_ascii(fold_accents(w))))
    said = F.lower(_ascii(fold_accents(F.coalesce(col(answer), F.lit("")))))
    return bind(words, lambda ws: (F.size(ws) == 0) | bind(said, lambda text: F.exists(ws, lambda w: text.contains(w))))


def _ascii(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x{00}-\x{7F}]", "")


def parse_verdict(raw: Column | str) -> Column:
    """Judge text to sufficient / partial / insufficient; unclear text is partial."""
    text = F.upper(F.coalesce(col(raw), F.lit("")))
    return (
        F.when(text.contains("INSUFFICIENT"), "insufficient")
        .when(text.contains("PARTIAL"), "partial")
        .when(text.contains("SUFFICIENT"), "sufficient")
        .otherwise("partial")
    )


def parse_score(raw: Column | str) -> Column:
    """First three digits of everything numeric in the text; null when there is none."""
    digits = F.left(F.regexp_replace(col(raw), r"\P{Nd}", ""), F.lit(3))
    return F.when(F.length(digits) > 0, digits).cast("int")


def parse_score_clamped(raw: Column | str) -> Column:
    """First number of the text, held within 0..100."""
    first = F.regexp_extract(col(raw), r"\p{Nd}{1,9}", 0)
    return F.least(F.when(F.length(first) > 0, first).cast("int"), F.lit(100))
