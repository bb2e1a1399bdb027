"""Conversation turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.config import DEFAULTS
from corpuscle.operators.ordering import top_k


def recent_turns(
    turns: DataFrame, pairs: int = DEFAULTS.history_pairs, max_chars: int = DEFAULTS.history_item_chars, conversation: str = "conv_id"
) -> DataFrame:
    """The turns of the last pairs (a question and its answer) of every conversation, each cut to its maximal length."""
    cut = turns.withColumn("text", F.left("text", F.lit(max_chars)))
    return top_k(cut, [conversation], [F.desc("turn")], 2 * pairs, "_back").drop("_back")


def trim_history(history: Column | str, keep: int = DEFAULTS.history_pairs, max_chars: int = DEFAULTS.history_item_chars) -> Column:
    """The same for a history held as an array of pairs: last pairs, two texts each, empty ones dropped."""
    h = F.col(history) if isinstance(history, str) else history
    n = F.size(h)
    last = F.slice(h, F.greatest(n - keep + 1, F.lit(1)), F.lit(keep))
    pairs = F.transform(
        F.coalesce(last, F.array().cast("array<array<string>>")),
        lambda pair: F.transform(
            F.filter(F.slice(pair, 1, 2), lambda t: t.isNotNull()), lambda t: F.left(t, F.lit(max_chars))
        ),
    )
    return F.filter(pairs, lambda pair: F.size(pair) > 0)


def with_last_turn(turns: DataFrame, conversation: str = "conv_id", role: str = "role", bucket: int = 1000) -> DataFrame:
    """Add `last_text`: the text of the same role's turn before this one.

    The turn before is looked up inside ranges of turns; only the last turn of a range meets
    the next range, so a conversation of any length stays spread.
    """
    marked = turns.withColumn("_bucket", F.floor(F.col("turn") / bucket))
    keys = [conversation, role]
    inside = Window.partitionBy(*keys, "_bucket").orderBy("turn")
    tails = marked.groupBy(*keys, "_bucket").agg(F.max_by("text", "turn").alias("_tail"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    carried = tails.select(*keys, "_bucket", F.lag("_tail").over(across).alias("_carried"))
    local = marked.withColumn("_first", F.row_number().over(inside) == 1).withColumn("_lag", F.lag("text").over(inside))
    joined = local.join(carried, [*keys, "_bucket"])
    return joined.withColumn("last_text", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag"))).drop(
        "_bucket", "_first", "_lag", "_carried"
    )
