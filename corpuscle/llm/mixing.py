"""Mixing sources to target weights: exact block quotas, split among output shards by a tree of hypergeometric draws.

Every document belongs to a permuted block of its source: a hash of its id gives the block and the place in it. A
source's quota is whole passes over all its blocks plus as many blocks, in order, as bring its words nearest to the
target; in the last of them a cut-off key ends the draw, so the error is at most half a document. The block draws of
all sources are then split among the shards: a binary tree halves the shards, and at each node the left half gets a
multivariate hypergeometric share of every source's draws. Shards take disjoint runs of a source's permuted draws and
order their documents by hash.

Only DataFrame and SQL functions are used. Per source one row, per block one; documents meet the plan by (source,
block), so a source with a third of all rows is spread over its blocks.

Defined cases: a null text has size 0; a null source is a source of its own (the last); a null id hashes as an empty
text; rows with equal ids are drawn together; an empty table gives an empty mix. Columns named like the results are
overwritten in the result, other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.config import broadcast_if_small, materialize
from corpuscle.operators.ordering import running_before

WORD = r"[^\x20\x09-\x0D]+"
DOCS_PER_BLOCK = 512


def word_count(text: Column) -> Column:
    """Number of words of the text, 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    blank_ends = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0) + F.when(
        (F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1
    ).otherwise(0)
    return (F.size(parts) - blank_ends).cast("bigint")


def permutation_key(doc_id: Column, seed: int) -> Column:
    """60 bits of a hash of the id: the place in the permuted order."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("bigint")


def targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Add `target` to (source, source_size): `share` of all sizes by weight, none above `cap` times its source.

    The excess over a cap goes to the others by weight until none is above. Capped are the sources with the smallest
    size per weight, so the level that all others reach follows from running sums over that order. Sources are few
    (one row each), which one task can order.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sources.withColumn("_weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    weighed = weighed.withColumn("_cap", F.col("source_size") * F.lit(cap))
    filling = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (
        F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    ) / F.sum("_weight").over(after)
    levelled = weighed.withColumn("_level", level)
    # The first source whose level stays below its cap sets the level of all; later rows have lower ones.
    reached = F.max(F.when(F.col("_level") * F.col("_weight") < F.col("_cap"), F.col("_level"))).over(everything)
    target = F.least(F.col("_cap"), F.coalesce(F.col("_weight") * reached, F.col("_cap")))
    return levelled.withColumn("target", target).select("source", "source_size", "n_docs", "target")


# One draw of a hypergeometric count by inverse distribution: `hits` of `total` marked, `drawn` taken, `u` in [0, 1).
# Twelve deviations and thirty around the mean hold all but what a double can tell from nothing; the weights follow
# from each other by their ratio, first for their sum, then up to the share `u` of it.
_RATIO = "(((x.hits - k) * cast(x.drawn - k as double)) / ((k + 1D) * (x.total - x.hits - x.drawn + k + 1D)))"
_STEP = f"a.w * {_RATIO}"


def _draw(total: str, hits: str, drawn: str, u: str) -> str:
    """SQL of one draw; lambda variables hold the operands so that each is computed once."""
    operands = f"named_struct('total', {total}, 'hits', {hits}, 'drawn', {drawn}, 'u', {u})"
    mean = "x.hits * cast(x.drawn as double) / x.total"
    spread = f"sqrt(greatest(0D, {mean} * (1 - x.hits / cast(x.total as double)) * (x.total - x.drawn) / greatest(1L, x.total - 1)))"
    support = (
        f"named_struct('lo', greatest(0L, x.drawn - (x.total - x.hits), cast(floor({mean} - 12 * {spread} - 30) as bigint)), "
        f"'hi', least(x.hits, x.drawn, cast(ceil({mean} + 12 * {spread} + 30) as bigint)))"
    )
    # The weight of k comes before the step to k + 1.
    mass = f"aggregate(sequence(r.lo, r.hi), named_struct('w', 1D, 's', 0D), (a, k) -> named_struct('w', {_STEP}, 's', a.s + a.w), a -> a.s)"
    pick = (
        "aggregate(sequence(r.lo, r.hi), named_struct('w', 1D, 's', 0D, 'pick', cast(null as bigint)), (a, k) -> "
        f"named_struct('w', {_STEP}, 's', a.s + a.w, 'pick', coalesce(a.pick, if(a.s + a.w > x.u * m, k, cast(null as bigint)))), a -> a.pick)"
    )
    drawn_count = f"get(transform(array({support}), r -> get(transform(array({mass}), m -> coalesce({pick}, r.hi)), 0)), 0)"
    return f"get(transform(array({operands}), x -> if(x.total = 0, 0L, {drawn_count})), 0)"


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, draws) -> (source, shard, first, beyond): disjoint runs of each source's draws, one a shard.

    A node of the tree is one row with the draws left to it of every source; a level splits each node's row in two,
    so the table never has more rows than shards and no row more than one entry a source.
    """
    entries = F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "draws")))
    nodes = quotas.groupBy().agg(entries.alias("own")).withColumns({"shard": F.lit(0), "width": F.lit(shards)})
    u = f"pmod(xxhash64({seed}, shard, width, coalesce(s.source, ''), s.last), 4503599627370496L) / 4503599627370496D"
    while shards > 1:
        left = "cast(width div 2 as int)"
        total = "aggregate(own, 0L, (a, s) -> a + s.draws)"
        # Along the sources: what of the node's draws and of the left half's room is still open.
        step = f"""aggregate(own, named_struct('open', {total}, 'room', {total} * {left} div width, 'got', cast(array() as array<bigint>)), (a, s) ->
          get(transform(array({_draw("a.open", "s.draws", "a.room", u)}), h ->
            named_struct('open', a.open - s.draws, 'room', a.room - h, 'got', concat(a.got, array(h)))), 0), a -> a.got)"""
        split = nodes.withColumn("_got", F.expr(f"if(width > 1, {step}, null)"))
        halves = F.expr(
            f"""if(width > 1, array(
              named_struct('shard', shard, 'width', {left},
                'own', zip_with(own, _got, (s, h) -> named_struct('last', s.last, 'source', s.source, 'draws', h))),
              named_struct('shard', shard + {left}, 'width', width - {left},
                'own', zip_with(own, _got, (s, h) -> named_struct('last', s.last, 'source', s.source, 'draws', s.draws - h)))),
              array(named_struct('shard', shard, 'width', width, 'own', own)))"""
        )
        nodes = split.select(F.explode(halves).alias("n")).select("n.own", "n.shard", "n.width")
        shards = (shards + 1) // 2
    leaves = nodes.select("shard", F.explode("own").alias("s")).select("shard", "s.source", "s.draws")
    runs = Window.partitionBy("source").orderBy("shard")
    return leaves.withColumn("beyond", F.sum("draws").over(runs)).select(
        "source", "shard", (F.col("beyond") - F.col("draws")).alias("first"), "beyond"
    )


def mixture_plan(sized: DataFrame, seed: int = 11, shards: int = 8, share: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """Sources with targets, and the draws: (source, block, copy, shard, max_key) over (source, size, key) rows."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = materialize(
        targets(totals, share)
        .withColumn("n_blocks", F.ceil(F.col("n_docs") / DOCS_PER_BLOCK).cast("bigint"))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")),
        "mix-sources",
    )
    few = broadcast_if_small(sources, 256)
    placed = sized.join(few, sized["source"].eqNullSafe(few["source"])).drop(few["source"])
    placed = placed.withColumn("block", F.pmod("key", "n_blocks"))
    blocks = placed.groupBy("source", "block").agg(
        F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("n_blocks", "passes", "rest")]
    )
    # Null is no key for the running sums, so the source is marked beside its name.
    keyed = blocks.withColumns({"_null": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))})
    summed = materialize(
        running_before(keyed, ["_null", "_source"], [F.col("block")], F.floor(F.col("block") / 4096), {"before": F.col("words")}), "mix-blocks"
    )
    # The block in which a source's words reach the rest: its documents are drawn up to a key.
    edge = summed.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    edge = broadcast_if_small(edge.select("source", "block", "before", "rest"), 128)
    inner = (
        sized.join(few.select("source", "n_blocks"), sized["source"].eqNullSafe(few["source"])).drop(few["source"])
        .withColumn("block", F.pmod("key", "n_blocks")).alias("d")
        .join(edge.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.block") == F.col("e.block")))
        .groupBy("d.source", "d.block", "key").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    )
    within = Window.partitionBy("source", "block").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("size") / 2
    cuts = inner.withColumn("_reached", reached).filter(F.col("_reached") <= F.col("rest"))
    cuts = cuts.groupBy("source", "block").agg(F.max("key").alias("max_key"))
    full = (F.col("before") + F.col("words") <= F.col("rest")) & (F.col("rest") > 0)
    drawn = summed.alias("s").join(
        cuts.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")) & (F.col("s.block") == F.col("c.block")), "left"
    ).select("s.*", F.when(full, F.lit((1 << 60) - 1)).otherwise(F.col("c.max_key")).alias("max_key"))
    everything = F.transform(F.sequence(F.lit(1), F.col("passes")), lambda c: F.struct(c.cast("int").alias("copy"), F.lit((1 << 60) - 1).alias("max_key")))
    copies = F.concat(
        F.when(F.col("passes") > 0, everything).otherwise(F.array().cast("array<struct<copy:int,max_key:bigint>>")),
        F.when(
            F.col("max_key").isNotNull(), F.array(F.struct((F.col("passes") + 1).cast("int").alias("copy"), F.col("max_key").alias("max_key")))
        ).otherwise(F.array().cast("array<struct<copy:int,max_key:bigint>>")),
    )
    draws = drawn.withColumn("_c", F.explode(copies)).select("_null", "_source", "source", "block", "_c.copy", "_c.max_key")
    # Draws in permuted order: pass by pass, in each by a hash of the block.
    turn = F.pmod(F.xxhash64(F.lit(seed), "copy", "block"), F.lit(1 << 40))
    ordered = draws.withColumn("_turn", turn).withColumn("_range", F.col("copy") * 256 + F.floor(F.col("_turn") / (1 << 32)))
    ordered = running_before(
        ordered, ["_null", "_source"], [F.col("_turn"), F.col("block")], F.col("_range"), {"place": F.lit(1).cast("bigint")}
    )
    quotas = draws.groupBy("source").agg(F.count(F.lit(1)).alias("draws"))
    runs = broadcast_if_small(split_quotas(quotas, shards, seed), 128)
    plan = ordered.alias("o").join(
        runs.alias("r"), F.col("o.source").eqNullSafe(F.col("r.source")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("beyond"))
    ).select("o.source", "block", "copy", "shard", "max_key")
    return sources, materialize(plan, "mix-plan")


def mix(docs: DataFrame, seed: int = 11, shards: int = 8, share: float = 1.5) -> DataFrame:
    """The mix: every drawn document once per copy, with `copy`, `shard` and `shuffle_key` (its place in the shard)."""
    sized = materialize(
        docs.select("source", word_count(F.col("text")).alias("size"), permutation_key(F.col("doc_id"), seed).alias("key")), "mix-sizes"
    )
    sources, plan = mixture_plan(sized, seed, shards, share)
    few = broadcast_if_small(sources.select(F.col("source").alias("_s"), "n_blocks"), 256)
    kept = docs.drop("copy", "shard", "shuffle_key")
    placed = kept.withColumn("_key", permutation_key(F.col("doc_id"), seed))
    placed = placed.join(few, placed["source"].eqNullSafe(F.col("_s"))).withColumn("_block", F.pmod("_key", "n_blocks"))
    draws = broadcast_if_small(plan.select(F.col("source").alias("_p"), "block", "copy", "shard", "max_key"), 128)
    hit = placed["source"].eqNullSafe(F.col("_p")) & (F.col("_block") == F.col("block")) & (F.col("_key") <= F.col("max_key"))
    order = F.xxhash64(F.lit(seed), "_key", "copy")
    return placed.join(draws, hit).withColumn("shuffle_key", order).select(*kept.columns, "copy", "shard", "shuffle_key")


def words_taken(docs: DataFrame, seed: int = 11, shards: int = 8, share: float = 1.5) -> DataFrame:
    """Every document with its size, its source's size and target, and the words that the mix takes of it."""
    sized = materialize(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), permutation_key(F.col("doc_id"), seed).alias("key")), "mix-sizes"
    )
    sources, plan = mixture_plan(sized, seed, shards, share)
    few = broadcast_if_small(sources.select(F.col("source").alias("_s"), "source_size", "target", "n_blocks"), 256)
    placed = sized.join(few, sized["source"].eqNullSafe(F.col("_s"))).withColumn("_block", F.pmod("key", "n_blocks"))
    # One row a block: the keys up to which its copies reach.
    reach = plan.groupBy("source", "block").agg(F.collect_list("max_key").alias("_reach"))
    reach = broadcast_if_small(reach.select(F.col("source").alias("_p"), F.col("block").alias("_b"), "_reach"), 128)
    hit = placed["source"].eqNullSafe(F.col("_p")) & (F.col("_block") == F.col("_b"))
    copies = F.size(F.filter(F.coalesce("_reach", F.array().cast("array<bigint>")), lambda m: m >= F.col("key")))
    return placed.join(reach, hit, "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("bigint").alias("taken")
    )
