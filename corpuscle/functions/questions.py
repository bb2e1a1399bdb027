"""Question analysis: language, type, rewriting, lexical terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscle.functions import vocab as V
from corpuscle.functions.text import any_of, bind, col, fold_accents, is_context_poor, text_array


def count_contained(text: Column, phrases) -> Column:
    """How many of the phrases occur in a bound text."""
    return F.size(F.filter(text_array(phrases), lambda p: text.contains(p)))


def question_language(question: Column | str) -> Column:
    q = col(question)
    accents = F.when(q.rlike(V.LANGUAGE_PT_ACCENTS), 2).otherwise(0)

    def decide(low: Column) -> Column:
        pt = count_contained(low, V.LANGUAGE_PT_WORDS) + accents
        return F.when(pt >= count_contained(low, V.LANGUAGE_EN_WORDS), "pt-BR").otherwise("en")

    return bind(F.lower(q), decide)


def question_type(question: Column | str) -> Column:
    def counts(low: Column) -> Column:
        opening = any_of([low.startswith(p) for p in V.CONCEPTUAL_OPENINGS]).cast("int")
        return F.struct(
            count_contained(low, V.QUANTITATIVE_PHRASES).alias("quantitative"),
            (count_contained(low, V.CONCEPTUAL_PHRASES) + opening).alias("conceptual"),
            count_contained(low, V.COMPARATIVE_PHRASES).alias("comparative"),
            count_contained(low, V.METHODOLOGICAL_PHRASES).alias("methodological"),
        )

    def decide(n: Column) -> Column:
        return (
            F.when((n["comparative"] > 0) & (n["comparative"] >= n["methodological"]), "comparative")
            .when(n["methodological"] > 0, "methodological")
            .when((n["quantitative"] > 0) & (n["quantitative"] > n["conceptual"]), "quantitative")
            .otherwise("conceptual")
        )

    return bind(bind(F.lower(col(question)), counts), decide)


def effective_type(kind: Column | str, context: Column | str) -> Column:
    kind = col(kind)
    return F.when((kind == "quantitative") & is_context_poor(context), "conceptual").otherwise(kind)


def rewrite_query(question: Column | str, language: Column | str) -> Column:
    """Append the other language's words for the three known rule groups."""
    q, lang = col(question), col(language)
    pt, en = lang == "pt-BR", lang == "en"

    def suffixes(low: Column) -> Column:
        restricted = count_contained(low, V.RESTRICTION_TERMS) > 0
        rules = [
            F.when(pt & (count_contained(low, V.SPECIES_PT) == len(V.SPECIES_PT)), V.SPECIES_LATIN_SUFFIX)
            .when(en & (count_contained(low, V.SPECIES_EN) > 0), V.SPECIES_PT_SUFFIX),
            F.when(restricted & pt, V.RESTRICTION_EN_SUFFIX).when(restricted & en, V.RESTRICTION_PT_SUFFIX),
            F.when(pt & low.contains(V.METABOLISM_PT), " " + V.METABOLISM_EN)
            .when(en & low.contains(V.METABOLISM_EN), " " + V.METABOLISM_PT),
        ]
        return F.concat(*[F.coalesce(r, F.lit("")) for r in rules])

    return F.trim(F.concat(q, bind(F.lower(q), suffixes)))


def expand_for_retry(question: Column | str) -> Column:
    """The rule rewrite plus the domain's fixed terms, where they are missing."""
    plain, accented = V.RETRY_COMMON_SUFFIX.split()

    def extend(base: Column) -> Column:
        low = F.lower(base)
        common = F.when(~low.contains(plain) & ~low.contains(accented), V.RETRY_COMMON_SUFFIX).otherwise("")
        latin = F.when(~low.contains(V.SPECIES_EN[0]), V.SPECIES_LATIN_SUFFIX).otherwise("")
        return F.trim(F.concat(base, common, latin))

    return bind(rewrite_query(question, question_language(question)), extend)


def accept_expansion(question: Column | str, model_text: Column | str, language: Column | str) -> Column:
    """Use the model's expansion only if it extends the question; else the rule rewrite."""
    q, text = col(question), col(model_text)
    fits = (F.length(text) > F.length(q)) & F.lower(text).contains(F.lower(F.left(q, F.lit(20))))
    return F.when(fits, text).otherwise(rewrite_query(q, language))


def accept_paraphrase(model_text: Column | str) -> Column:
    text = F.trim(F.btrim(F.trim(col(model_text)), F.lit('"')))
    return F.when(F.length(text) >= 5, text)


def condense(question: Column | str, last_question: Column | str, model_text: Column | str) -> Column:
    """Self-contained form of a follow-up; without history the question itself."""
    q, last = col(question), col(last_question)
    text = F.btrim(F.trim(col(model_text)), F.lit('"'))
    return (
        F.when(last.isNull(), q)
        .when(F.length(text) >= 5, text)
        .otherwise(F.trim(F.concat_ws(" ", last, q)))
    )


def lexical_terms(question: Column | str, rewritten: Column | str) -> Column:
    """Distinct query terms in order of appearance, accents folded, stop words out."""
    both = F.lower(F.concat_ws(" ", col(question), col(rewritten)))
    folded = fold_accents(both)
    tokens = F.regexp_extract_all(folded, F.lit(V.LEXICAL_TOKEN_PATTERN), F.lit(0))
    kept = F.filter(tokens, lambda t: (F.length(t) >= 2) & ~F.array_contains(text_array(V.LEXICAL_STOPWORDS), t))
    return F.array_distinct(kept)


def content_terms(content: Column | str, fold: bool = False) -> Column:
    """Word tokens of a chunk. Accents stay unless `fold` is set."""
    low = F.lower(F.coalesce(col(content), F.lit("")))
    if fold:
        low = fold_accents(low)
    return F.regexp_extract_all(low, F.lit(V.CONTENT_TOKEN_PATTERN), F.lit(0))
