"""Quality rules whose thresholds come from the corpus: quantile sketches per language and source, then a join.

The signals of a text are whole numbers. Their sketch is a histogram of geometric bins (seven leading bits of the
value, so a quantile is at most 1/64 off): sketches of parts add up to the sketch of the whole, which is what the
partial aggregation does before its shuffle. A group (language, source) reads its fences from its own sketch; a group of
fewer than `MIN_GROUP` documents from the sketch of its language, and that one, if small too, from all documents.

A fence is `FENCE` quartile ranges beyond the quartile, each range at least the signal's own resolution, so that
where most documents agree a small deviation is no outlier. Only DataFrame functions are used; per group and signal
there is one row a bin, and documents meet one row of fences each.

Defined cases: a null text has no words and fails the base rule, as an empty one does; null languages and sources are
groups of their own; rows with equal ids are judged one by one; an empty table gives an empty result. Columns of
the input named like a result do not matter: the result has the columns listed in `judge`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.config import broadcast_if_small, materialize
from corpuscle.functions.text import bind

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MIN_GROUP = 200
FENCE = 3
# Signal: which sides are fenced, and the least quartile range that counts, in units of the signal.
SIGNALS = {
    "word_length": ("both", 60),  # hundredths of a character
    "symbol_rate": ("high", 200),  # symbols per 10,000 words
    "capital_rate": ("high", 300),  # capitals per 10,000 characters of words
    "mark_rate": ("high", 300),  # exclamation marks per 10,000 words
    "dup_line_rate": ("high", 1500),  # repeated lines per 10,000 lines
    "repeat_rate": ("high", 300),  # repeated words per 10,000 words
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def repeat_words(words: Column, width: int = 5) -> Column:
    """Words that stand in a window of `width` words which the text holds twice or more.

    Windows are compared by 64-bit hashes. Only a text with an equal pair is looked at further: sorted (hash, place)
    pairs show the repeated places, and the words covered are the steps between them, none over the width.
    """

    def hashes(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - width)
        return F.when(F.size(w) >= width, F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(p: Column) -> Column:
            twin = lambda x, i: (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"])
            hit = lambda x, i: F.coalesce(twin(x, i), F.get(p, i - 1)["h"] == x["h"], F.get(p, i + 1)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(p, hit), lambda x: x["i"]))

        def steps(at: Column) -> Column:
            gaps = F.transform(at, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - x, F.lit(width))))
            return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

        return bind(bind(pairs, repeated), steps)

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("bigint"))

    return F.coalesce(bind(words, lambda w: bind(hashes(w), count)), F.lit(0).cast("bigint"))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and the signals of every text."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def counts(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
        of_lines = bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
        of_words = bind(words_of(t), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("rep")))
        return F.struct(
            of_words.alias("w"), of_lines.alias("l"), F.length(t).alias("chars"),
            _without(t, SPACE_CHARS).alias("word_chars"), _without(t, SYMBOLS).alias("plain"),
            _without(t, CAPITALS).alias("low"), _without(t, "!").alias("calm"),
        )

    seen = docs.select("doc_id", "lang", "source", bind(text, counts).alias("c"))
    base = seen.select(
        "doc_id", "lang", "source", F.col("c.w.n").cast("bigint").alias("n_words"), F.col("c.word_chars").cast("bigint").alias("word_chars"),
        (F.col("c.chars") - F.col("c.plain")).cast("bigint").alias("n_symbols"), F.col("c.l.dup").cast("bigint").alias("n_dup_lines"),
        F.col("c.w.rep").cast("bigint").alias("n_repeat_words"), F.col("c.l.n").cast("bigint").alias("n_lines"),
        (F.col("c.chars") - F.col("c.low")).cast("bigint").alias("n_capitals"), (F.col("c.chars") - F.col("c.calm")).cast("bigint").alias("n_marks"),
    )
    per = lambda part, scale, whole: F.expr(f"{part} * {scale} div greatest({whole}, 1L)")
    return base.withColumns(
        {
            "word_length": per("word_chars", 100, "n_words"),
            "symbol_rate": per("n_symbols", 10000, "n_words"),
            "capital_rate": per("n_capitals", 10000, "word_chars"),
            "mark_rate": per("n_marks", 10000, "n_words"),
            "dup_line_rate": per("n_dup_lines", 10000, "n_lines"),
            "repeat_rate": per("n_repeat_words", 10000, "n_words"),
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        }
    )


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, signal, bin, docs): the mergeable histograms of all signals."""
    pairs = F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).alias("value")) for n in SIGNALS])
    values = measured.select("lang", "source", F.explode(pairs).alias("s")).select("lang", "source", "s.signal", "s.value")
    shift = "greatest(0, length(bin(value)) - 7)"
    return values.groupBy("lang", "source", "signal", F.expr(f"{shift} * 64L + shiftright(value, {shift})").alias("bin")).agg(
        F.count(F.lit(1)).alias("docs")
    )


def bin_top(bin_: str) -> Column:
    """The largest value of a bin."""
    shift = f"cast(greatest({bin_} div 64 - 1, 0L) as int)"
    return F.expr(f"shiftleft({bin_} - 64L * {shift} + 1L, {shift}) - 1L")


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and signal: docs, q1 and q3 of the merged sketches."""
    merged = sketches.groupBy(*keys, "signal", "bin").agg(F.sum("docs").alias("docs"))
    group = Window.partitionBy(*keys, "signal")
    running = merged.withColumn("reached", F.sum("docs").over(group.orderBy("bin"))).withColumn("n", F.sum("docs").over(group))
    at = lambda q: F.min(F.when(F.col("reached") * 4 >= F.col("n") * q, bin_top("bin")))
    return running.groupBy(*keys, "signal").agg(F.first("n").alias("docs"), at(1).alias("q1"), at(3).alias("q3"))


def fences(sketches: DataFrame) -> DataFrame:
    """One row per (lang, source): a low and a high fence per signal."""
    levels = [quartiles(sketches, k) for k in (["lang", "source"], ["lang"], [])]
    own, by_lang, overall = (x.select(*[F.col(c).alias(f"{c}_{i}") for c in x.columns]) for i, x in enumerate(levels))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    joined = own.join(by_lang, same("lang_0", "lang_1") & (F.col("signal_0") == F.col("signal_1"))).join(
        F.broadcast(overall), F.col("signal_0") == F.col("signal_2")  # one row a signal
    )
    level = lambda q: F.when(F.col("docs_0") >= MIN_GROUP, F.col(f"{q}_0")).when(F.col("docs_1") >= MIN_GROUP, F.col(f"{q}_1")).otherwise(F.col(f"{q}_2"))
    least = F.coalesce(*[F.when(F.col("signal_0") == n, F.lit(r)) for n, (_, r) in SIGNALS.items()])
    spread = F.greatest(level("q3") - level("q1"), least)
    return (
        joined.select("lang_0", "source_0", "signal_0", (level("q1") - FENCE * spread).alias("low"), (level("q3") + FENCE * spread).alias("high"))
        .groupBy(F.col("lang_0").alias("_lang"), F.col("source_0").alias("_source"))
        .agg(
            *[
                F.max(F.when(F.col("signal_0") == n, F.col(side))).alias(f"{n}_{side}")
                for n, (sides, _) in SIGNALS.items()
                for side in (("low", "high") if sides == "both" else (sides,))
            ]
        )
    )


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept, and the signals that lie beyond their fence (`failed`)."""
    measured = materialize(measure(docs), "quality-signals")
    limits = broadcast_if_small(fences(sketch(measured)), 256)
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")))
    beyond = {}
    for name, (sides, _) in SIGNALS.items():
        high = F.col(name) > F.col(f"{name}_high")
        beyond[name] = (F.col(name) < F.col(f"{name}_low")) | high if sides == "both" else high
    failed = F.array_compact(F.array(*[F.when(b, F.lit(n)) for n, b in beyond.items()]))
    return joined.withColumn("failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), F.array_join("failed", ",").alias("failed"),
    )
