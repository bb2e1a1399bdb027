"""Text expressions: cleaning, signals, normalisation, numbers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import vocab as V

# Characters that compatibility normalisation leaves alone: ASCII, Latin-1 letters,
# typographic quotes, dashes and the ellipsis-free euro sign.
_STABLE_UNDER_NFKC = r"^[\x{00}-\x{7F}\x{C0}-\x{FF}\x{2013}\x{2014}\x{2018}\x{2019}\x{201C}\x{201D}\x{20AC}]*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once per row.

    An expression that stands inside a lambda is evaluated for every element, and one that
    stands behind an OR is not shared with its other uses; a lambda variable is.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_array(texts) -> Column:
    """Constant array of texts."""
    quoted = ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in texts)
    return F.expr(f"array({quoted})")


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col(c), F.lit(V.WHITESPACE))


def is_blank(c: Column | str) -> Column:
    return ~col(c).rlike(r"(?U)\S")


# --- lines and chunks ------------------------------------------------------------------


def is_page_number(c: Column | str) -> Column:
    return col(c).rlike(V.PAGE_NUMBER_PATTERN)


def is_legal(c: Column | str) -> Column:
    return F.lower(strip(c)).rlike(V.LEGAL_PATTERN)


def is_editorial(c: Column | str) -> Column:
    return is_page_number(c) | is_legal(c)


def has_signal(c: Column | str) -> Column:
    """True when any rule sees data in the text (units, ratios, headers, ...)."""
    patterns = [_unicode_fold(p) for p in V.SIGNAL_PATTERNS_STRIPPED] + [_BY_LINE + V.CAPITAL_THEN_DIGIT_PATTERN]
    by_word = bind(F.lower(col(c)), lambda low: F.exists(text_array(V.SIGNAL_WORDS), lambda w: low.contains(w)))
    by_pattern = bind(strip(c), lambda text: any_of([text.rlike(p) for p in patterns]))
    return ~is_blank(c) & (by_word | by_pattern)


# Start at the first capital of a line only: each line is then read once.
_BY_LINE = r"(?md)^[^A-Z\n]*"


def _unicode_fold(pattern: str) -> str:
    return pattern.replace("(?i)", "(?iu)", 1)


def is_noise_line(line: Column) -> Column:
    return is_blank(line) | is_page_number(line) | is_legal(line)


def clean_text(c: Column | str) -> Column:
    """Drop blank, page-number and legal lines; a blank text stays as it is."""
    c = col(c)
    kept = F.filter(F.split(c, "\n"), lambda line: ~is_noise_line(line))
    return F.when(is_blank(c), c).otherwise(F.array_join(kept, "\n"))


def is_garbled(c: Column | str) -> Column:
    """Too short, or too many '?' left by undecodable characters."""
    c = F.coalesce(col(c), F.lit(""))
    length = F.length(c)
    marks = length - F.length(F.replace(c, F.lit("?"), F.lit("")))
    return (length < V.GARBLED_MIN_CHARS) | (marks / F.greatest(length, F.lit(1)) > V.GARBLED_MAX_RATIO)


def is_context_poor(c: Column | str) -> Column:
    c = F.coalesce(col(c), F.lit(""))
    return (F.length(strip(c)) < V.POOR_CONTEXT_MIN_CHARS) | is_garbled(c)


def digit_density(c: Column | str) -> Column:
    """Share of digits, superscripts and subscripts included."""
    c = col(c)
    digits = F.regexp_count(c, F.lit(r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}-\x{2079}\x{2080}-\x{2089}]"))
    return digits / F.greatest(F.length(c), F.lit(1))


# --- normalisation ------------------------------------------------------------------------


_TEXTS_AT_ONCE = 256  # texts of an Arrow batch that are Python strings at a time


def _unicode_form(form: str):
    @F.arrow_udf("string")
    def normalise(s):
        import unicodedata

        import pyarrow as pa

        out = []
        for at in range(0, len(s), _TEXTS_AT_ONCE):
            some = s.slice(at, _TEXTS_AT_ONCE)
            if some.null_count < len(some):
                some = pa.array([x if x is None else unicodedata.normalize(form, x) for x in some.to_pylist()], s.type)
            out.append(some)
        return pa.concat_arrays(out) if out else s

    return normalise


def with_nfkc(df: DataFrame, *columns: str) -> DataFrame:
    """Bring columns to compatibility form, once per table.

    The JVM has no such function. Texts that the form cannot change are passed
    to Arrow as nulls, so only the unusual ones are copied to Python. The column
    expressions below expect this form.
    """
    form = _unicode_form("NFKC")
    for name in columns:
        unstable = F.when(~F.col(name).rlike(_STABLE_UNDER_NFKC), F.col(name))
        df = df.withColumn(name, F.coalesce(form(unstable), F.col(name)))
    return df


def with_normal_form(df: DataFrame, **columns: str) -> DataFrame:
    """Add per name the comparison form of another column, compatibility form included."""
    copied = df.withColumns({name: F.col(source) for name, source in columns.items()})
    return with_nfkc(copied, *columns).withColumns({name: normalize_text(name) for name in columns})


def with_folded_accents(df: DataFrame, *columns: str) -> DataFrame:
    """Remove the diacritics of any script; see `fold_accents` for Latin letters alone."""
    form = _unicode_form("NFKD")
    for name in columns:
        latin = fold_accents(name)
        rest = F.when(~latin.rlike(r"^[\x{00}-\x{7F}]*$"), F.col(name))
        df = df.withColumn(name, F.coalesce(F.regexp_replace(form(rest), r"\p{M}", ""), latin))
    return df


def fold_accents(c: Column | str) -> Column:
    """Remove the diacritics of Latin letters."""
    return F.translate(col(c), V.ACCENTED, V.UNACCENTED)


def normalize_text(c: Column | str) -> Column:
    """Comparison form: quotes, dashes, superscripts, decimal comma, spaces, case."""
    c = F.translate(
        F.coalesce(col(c), F.lit("")),
        V.TYPOGRAPHIC_MARKS + V.SUPERSCRIPT_DIGITS,
        V.PLAIN_MARKS + V.PLAIN_DIGITS,
    )
    c = F.regexp_replace(c, r"(\p{Nd}),(\p{Nd}{1,2})(?![\p{L}\p{N}_])", "$1.$2")
    c = F.regexp_replace(c, r"(?U)\s+", " ")
    return F.lower(F.trim(c))


def extract_numbers(c: Column | str, normalized: bool = False) -> Column:
    """Numbers worth checking: with a decimal point, a percent sign or two digits."""
    text = col(c) if normalized else normalize_text(c)
    found = F.regexp_extract_all(text, F.lit(V.NUMBER_PATTERN), F.lit(0))
    return F.filter(
        found,
        lambda n: n.contains(".")
        | n.contains("%")
        | (F.length(F.regexp_replace(n, r"\P{Nd}", "")) >= 2),
    )
