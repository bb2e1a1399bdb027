"""Connected components of a link table, by repeated stars.

Each round links every node to the smallest node it knows (large star: its larger neighbours; small star: its smaller ones
and itself), until nothing changes: then each node hangs on the smallest node of its component. Minima are aggregated before
their shuffle and meet the links by a join, so a node with very many links is no group in one task. Rounds grow with
the logarithm of the longest path; each is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.config import materialize


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(a, b) links between numbers -> (node, component): the smallest node of the component, for every other node in it."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    links = materialize(links, "links")
    before = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = materialize(large.distinct(), "links")
        small = large.join(_least(large), "a").select("a", "b", "m")
        tied = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l"))
        links = materialize(tied.select("l.*").filter("a <> b").distinct(), "links")
