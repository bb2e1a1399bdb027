"""Offline evaluation: retrieval and answer metrics, summaries, run comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.config import DEFAULTS, Settings, materialize
from corpuscle.functions import vocab as V
from corpuscle.functions.answers import is_refusal, is_skeleton, mention_coverage
from corpuscle.functions.text import bind, with_nfkc, with_normal_form


# --- passages --------------------------------------------------------------------------------


def passage_ranks(golden: DataFrame, hits: DataFrame, qid: str = "qid") -> DataFrame:
    """Per expected passage the first retrieved position that contains it, or null.

    `hits`: qid, position, content, the few chunks selected per question. The join is on
    the question; the containment test filters inside it. A blank passage is in every chunk.
    """
    wanted = golden.select(qid, F.posexplode("expected_passages").alias("passage_no", "passage"))
    wanted = with_normal_form(wanted, _needle="passage")
    texts = with_normal_form(hits.select(qid, "position", "content"), _text="content").drop("content")
    met = wanted.join(texts, qid).filter(F.contains("_text", "_needle"))
    first = met.groupBy(qid, "passage_no").agg(F.min("position").alias("rank"))
    return wanted.drop("_needle").join(first, [qid, "passage_no"], "left")


def eval_retrieval(golden: DataFrame, hits: DataFrame, qid: str = "qid") -> DataFrame:
    """Recall, first hit, missed passages, similarities and counts per question."""
    ranks = passage_ranks(golden, hits, qid).groupBy(qid).agg(
        F.count(F.lit(1)).alias("_expected"),
        F.count("rank").alias("_found"),
        F.min("rank").alias("first_hit_rank"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("rank").isNull(), F.struct("passage_no", "passage")))),
            lambda p: p["passage"],
        ).alias("missed_passages"),
    )
    got = hits.groupBy(qid).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.coalesce("similarity", F.lit(0.0))).alias("_top"),
        F.min(F.coalesce("similarity", F.lit(0.0))).alias("_min"),
        F.sum(F.length("content")).alias("_chars"),
    )
    out = golden.select(qid, "scope").join(ranks, qid, "left").join(got, qid, "left")
    expected, found = F.coalesce("_expected", F.lit(0)), F.coalesce("_found", F.lit(0))
    return out.select(
        qid,
        "scope",
        F.coalesce("_n", F.lit(0)).alias("retrieved_count"),
        F.coalesce("_top", F.lit(0.0)).alias("top_similarity"),
        F.coalesce("_min", F.lit(0.0)).alias("min_similarity"),
        F.coalesce("_chars", F.lit(0)).alias("context_chars"),
        expected.alias("expected_total"),
        found.alias("expected_found"),
        F.when(expected > 0, found / F.greatest(expected, F.lit(1))).alias("recall"),
        "first_hit_rank",
        F.coalesce("missed_passages", F.array().cast("array<string>")).alias("missed_passages"),
    )


def eval_generation(golden: DataFrame, answers: DataFrame, qid: str = "qid") -> DataFrame:
    """Answer metrics per question. `answers`: qid, answer, cited_files array."""
    joined = golden.select(qid, "scope", "expected_source_file", "must_mention").join(answers, qid)
    joined = with_nfkc(joined.withColumn("_said", F.col("answer")), "_said")
    refused = is_refusal("_said")
    outside = F.col("scope") == "out_of_corpus"
    cited = F.filter(F.coalesce("cited_files", F.array().cast("array<string>")), lambda f: F.coalesce(f, F.lit("")) != "")
    out = joined.withColumn("refused", refused).withColumn("_cited", cited)
    n = F.size("_cited")
    hits = F.size(F.filter("_cited", lambda f: f == F.col("expected_source_file")))
    return out.select(
        qid,
        "scope",
        F.length(F.coalesce("answer", F.lit(""))).alias("answer_chars"),
        "refused",
        (~F.col("refused") & is_skeleton("_said")).alias("skeleton"),
        F.when(outside, F.col("refused")).otherwise(~F.col("refused")).alias("refusal_correct"),
        F.when(~outside, mention_coverage("_said", "must_mention")).alias("mention_coverage"),
        n.alias("citation_file_count"),
        F.when((F.coalesce("expected_source_file", F.lit("")) != "") & (n > 0), hits / F.greatest(n, F.lit(1))).alias(
            "citation_precision"
        ),
    )


# --- summary ---------------------------------------------------------------------------------


_RANGES = 1024


def order_statistics(values: DataFrame, column: str, ranks: list[int]) -> list[float]:
    """The values at the given 1-based places in ascending order.

    A pass counts the rows of `_RANGES` equal ranges between the least and the greatest value; the next one looks only into
    a range that holds a wanted place, until all values in it are equal. Only the counts of the ranges come here.
    """
    rows = values.select(F.col(column).cast("double").alias("_x")).filter("_x is not null")

    def within(low: float, high: float, before: int, wanted: list[int]) -> dict[int, float]:
        place = F.width_bucket("_x", F.lit(low), F.lit(high), F.lit(_RANGES))
        ranges = (
            rows.filter(F.col("_x").between(low, high)).groupBy(place.alias("range"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high")).orderBy("range").collect()
        )
        out: dict[int, float] = {}
        for r in ranges:
            inside = [k for k in wanted if before < k <= before + r["n"]]
            if inside:
                out |= dict.fromkeys(inside, r["low"]) if r["low"] == r["high"] else within(r["low"], r["high"], before, inside)
            before += r["n"]
        return out

    low, high = rows.agg(F.min("_x"), F.max("_x")).first()
    if low is None:
        return [None] * len(ranks)
    found = dict.fromkeys(ranks, low) if low == high else within(low, high, 0, sorted(set(ranks)))
    return [found[k] for k in ranks]


def exclusive_p95(values: DataFrame, column: str, name: str = "p95") -> DataFrame:
    """95th percentile by the exclusive method; below 20 values the maximum. One row."""
    narrow = materialize(values.select(F.col(column).cast("double").alias("_x")).filter("_x is not null"), "percentile")
    n, most = narrow.agg(F.count(F.lit(1)), F.max("_x")).first()
    result = most
    if n >= 20:
        # The cut point lies between the order statistics j and j + 1.
        j, d = divmod(19 * (n + 1), 20)
        low, high = order_statistics(narrow, "_x", [j, j + 1])
        result = (low * (20 - d) + high * d) / 20
    return values.sparkSession.range(1).select(F.lit(result).cast("double").alias(name))


def summarize(results: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row of run metrics from one row per question.

    Columns read: qid, scope, recall, top_similarity, selected_count, context_chars,
    selection_reason, and, where answers were made: refused, skeleton, refusal_correct,
    mention_coverage, citation_file_count, citation_precision, groundedness,
    answers_question. Counts are paired with their own question; questions refused for
    want of lexical cover are no starved ones.
    """
    inside, outside = F.col("scope") == "in_corpus", F.col("scope") == "out_of_corpus"
    colloquial = F.col("qid").cast("string").startswith("col-")
    answered = F.col("refused").isNotNull()
    given = answered & ~F.col("refused")
    taken = F.col("selected_count").isNotNull() & ~F.coalesce(
        F.col("selection_reason").startswith("refused"), F.lit(False)
    )

    def mean(condition: Column, value, digits: int) -> Column:
        v = F.col(value) if isinstance(value, str) else value
        return F.round(F.avg(F.when(condition, v.cast("double"))), digits)

    perfect = F.when(F.col("recall").isNotNull(), F.col("recall") == 1.0)
    starved = F.col("selected_count") <= settings.starvation_chunks
    row = results.agg(
        F.count(F.lit(1)).alias("questions_total"),
        F.count_if(inside).alias("questions_in_corpus"),
        F.count_if(outside).alias("questions_out_of_corpus"),
        mean(inside, "recall", 3).alias("mean_recall"),
        mean(inside, perfect, 3).alias("perfect_recall_rate"),
        mean(F.lit(True), "top_similarity", 3).alias("mean_top_similarity"),
        mean(F.lit(True), "selected_count", 1).alias("mean_selected_chunks"),
        mean(taken, starved, 3).alias("starvation_rate"),
        F.count_if(colloquial).alias("col_questions_total"),
        mean(colloquial, "recall", 3).alias("col_mean_recall"),
        mean(colloquial, perfect, 3).alias("col_perfect_recall_rate"),
        mean(colloquial, "top_similarity", 3).alias("col_mean_top_similarity"),
        mean(colloquial, starved, 3).alias("col_starvation_rate"),
        mean(answered, "refusal_correct", 3).alias("refusal_correct_rate"),
        mean(answered & outside, "refused", 3).alias("out_of_corpus_refusal_rate"),
        mean(answered, "groundedness", 1).alias("mean_groundedness"),
        mean(answered, "answers_question", 1).alias("mean_answers_question"),
        mean(answered, "mention_coverage", 3).alias("mean_mention_coverage"),
        mean(given, "skeleton", 3).alias("skeleton_rate"),
        mean(given, "citation_file_count", 2).alias("citation_file_count_mean"),
        mean(given, "citation_precision", 3).alias("citation_precision"),
    )
    p95 = exclusive_p95(results, "context_chars")
    return row.withColumn("p95_context_chars", F.round(p95.scalar()))


def verdict_matches(verdict: Column | str, scope: Column | str) -> Column:
    v = F.col(verdict) if isinstance(verdict, str) else verdict
    s = F.col(scope) if isinstance(scope, str) else scope
    return F.when(s == "out_of_corpus", v == "insufficient").otherwise(v.isin("sufficient", "partial"))


def verdict_accuracy(results: DataFrame) -> DataFrame:
    """Share of expected verdicts, per scope and (scope 'all') over everything."""
    match = verdict_matches("verdict", "scope").cast("int")
    return (
        results.rollup("scope")
        .agg(
            F.count(F.lit(1)).alias("questions"),
            F.sum(match).alias("correct"),
            F.avg(match).alias("accuracy"),
            F.grouping("scope").alias("_all"),
        )
        .withColumn("scope", F.when(F.col("_all") == 1, "all").otherwise(F.col("scope")))
        .drop("_all")
    )


# --- golden set ------------------------------------------------------------------------------


ANCHOR_WORDS = 3
# Bytes of the piece by which a passage without an anchor is looked for.
PIECE_BYTES = 4
_ANCHORS_AT_ONCE = 50_000


def with_borders(chunks: DataFrame, reach: int) -> DataFrame:
    """(text) of all chunks, normalised, and of the borders between chunks n and n + 1 of a file: `reach` characters on either side.

    A chunk shorter than the reach takes the end of its predecessor along, again and again until the reach is full, so what
    spans several short chunks is found too. Chunks without a file or position have no borders.
    """
    file, index = "original_file_id", "chunk_index"
    if file not in chunks.columns or index not in chunks.columns:
        return with_normal_form(chunks.select("content"), text="content").select("text")
    texts = materialize(with_normal_form(chunks.select(file, F.col(index).cast("bigint").alias(index), "content"), text="content").drop("content"), "chunk-texts")
    placed = texts.filter(F.col(file).isNotNull() & F.col(index).isNotNull())
    own = placed.select(file, index, F.right("text", F.lit(reach)).alias("own"), (F.length("text") < reach).alias("short"))
    before = materialize(own.select(file, index, F.col("own").alias("end"), F.col("short").alias("open")), "chunk-ends")
    while not before.filter("open").isEmpty():
        # Only short chunks wait for their predecessor; each round brings one more chunk into reach.
        earlier = before.select(file, (F.col(index) + 1).alias(index), F.col("end").alias("earlier"), F.col("open").alias("more"))
        waiting = before.filter("open").select(file, index).distinct().join(own, [file, index])
        came = waiting.join(earlier, [file, index], "left").select(file, index, F.right(F.concat_ws(" ", "earlier", "own"), F.lit(reach)).alias("end"), "more")
        # An end is complete once it is full, or its predecessor's is, or there is none.
        came = came.withColumn("open", F.coalesce("more", F.lit(False)) & (F.length("end") < reach)).drop("more")
        before = materialize(before.filter("not open").unionByName(came), "chunk-ends")
    heads = placed.select(file, (F.col(index) - 1).alias(index), F.left("text", F.lit(reach)).alias("head"))
    borders = before.join(heads, [file, index]).select(F.concat_ws(" ", "end", "head").alias("text"))
    return texts.select("text").unionByName(borders)


def passages_in_corpus(passages: DataFrame, chunks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The passages (column `passage`, not blank) that some chunk, or two neighbouring ones together, contain, all normalised.

    A text that contains a passage holds its inner words whole: three of them are its anchor. Texts are probed for the hashes of their
    runs of three words, and only hits become rows, which then look for the whole passage. Passages without so many
    inner words are looked for by a piece of a few bytes in the same manner. Either kind goes in blocks of a bounded size, one pass each.
    """
    needles = with_normal_form(passages.select("passage").distinct(), needle="passage").select("needle").filter(F.col("needle") != "").distinct()
    needles = materialize(needles, "needles")
    longest = needles.agg(F.max(F.length("needle"))).first()[0]
    if not longest:
        return needles
    texts = materialize(with_borders(chunks, longest), "passage-texts")
    words = F.split("needle", " ")
    run = F.xxhash64(*[F.get(words, F.lit(1 + i)) for i in range(ANCHOR_WORDS)])
    anchored = needles.withColumn("anchor", F.when(F.size(words) >= ANCHOR_WORDS + 2, run))
    found = needles.limit(0)
    for part, search in ((anchored.filter(F.col("anchor").isNotNull()), _by_anchor), (anchored.filter(F.col("anchor").isNull()), _by_piece)):
        n, size = part.agg(F.count(F.lit(1)), F.sum(F.octet_length("needle") + 64)).first()
        passes = max(-(-(size or 0) // settings.broadcast_max_bytes), -(-n // _ANCHORS_AT_ONCE))
        for i in range(passes):
            block = part.filter(F.pmod(F.xxhash64("needle"), F.lit(passes)) == i)
            found = found.unionByName(search(texts, block))
    return found.distinct()


def _by_anchor(texts: DataFrame, block: DataFrame) -> DataFrame:
    anchors = ",".join(str(r[0]) for r in block.select("anchor").distinct().collect())  # a block is bounded

    def runs(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - ANCHOR_WORDS)
        return F.when(F.size(w) >= ANCHOR_WORDS, F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(ANCHOR_WORDS)])))

    wanted = F.split(F.lit(anchors), ",").cast("array<bigint>")
    hits = texts.select("text", F.array_intersect(bind(F.split("text", " "), runs), wanted).alias("_hits")).filter(F.size("_hits") > 0)
    met = hits.select("text", F.explode("_hits").alias("anchor")).join(F.broadcast(block), "anchor")
    return met.filter(F.contains("text", "needle")).select("needle").distinct()


_TEXTS_AT_ONCE = 256  # texts that a task looks through together


def _by_piece(texts: DataFrame, block: DataFrame) -> DataFrame:
    """Passages of a few words: a task compares all runs of bytes in its texts with one run of each passage, then looks for the passage at hits."""
    by_piece: dict[int, dict[int, list[bytes]]] = {}
    for row in block.select("needle").collect():  # a block is bounded
        data = row[0].encode()
        size = min(PIECE_BYTES, len(data))
        pieces = [data[i : i + size] for i in range(len(data) - size + 1)]
        # Digits, signs and non-ASCII letters are rarer in prose than its small letters and spaces.
        piece = min(pieces, key=lambda p: (sum(97 <= c <= 122 or c == 32 for c in p), p))
        by_piece.setdefault(size, {}).setdefault(int.from_bytes(piece, "little"), []).append(data)

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        keys = {size: np.sort(np.fromiter(pieces, np.uint32, len(pieces))) for size, pieces in by_piece.items()}
        seen = set()
        # A text takes some thirty times its bytes here, so a batch goes in slices.
        for batch in (b.slice(at, _TEXTS_AT_ONCE) for b in batches for at in range(0, b.num_rows, _TEXTS_AT_ONCE)):
            texts = [t.encode() for t in batch.column(0).to_pylist()]
            data = np.frombuffer(b"".join(texts), np.uint8)
            ends = np.cumsum([len(t) for t in texts])
            for size, wanted in keys.items():
                if len(data) < size:
                    continue
                run = data[: len(data) - size + 1].astype(np.uint32)
                for i in range(1, size):
                    run |= data[i : len(data) - size + 1 + i].astype(np.uint32) << np.uint32(8 * i)
                near = np.minimum(np.searchsorted(wanted, run), len(wanted) - 1)
                at = np.flatnonzero(wanted[near] == run)
                # One look per text and piece; runs over the end of a text find nothing in it.
                pairs = np.unique(np.stack((np.searchsorted(ends, at, "right"), run[at].astype(np.int64)), 1), axis=0) if len(at) else ()
                for row, piece in pairs:
                    seen.update(n for n in by_piece[size][int(piece)] if n not in seen and n in texts[row])
        yield pa.RecordBatch.from_arrays([pa.array([n.decode() for n in seen], pa.string())], ["needle"])

    return texts.mapInArrow(scan, "needle string").distinct()


def missing_passages(golden: DataFrame, chunks: DataFrame, qid: str = "qid", settings: Settings = DEFAULTS) -> DataFrame:
    """Expected passages that no chunk contains: the golden set measures nothing there. Blank ones are in any chunk."""
    wanted = golden.select(qid, F.explode("expected_passages").alias("passage"))
    found = passages_in_corpus(wanted, chunks, settings)
    named = with_normal_form(wanted, needle="passage").filter(F.col("needle") != "")
    return named.join(found, "needle", "left_anti").select(qid, "passage")


def golden_census(golden: DataFrame, chunks: DataFrame, qid: str = "qid", settings: Settings = DEFAULTS) -> DataFrame:
    """One row: questions per scope, with history, passages checked and missing, verdict."""
    missing = missing_passages(golden, chunks, qid, settings).agg(F.count(F.lit(1)).alias("n"))
    out = golden.agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(F.col("scope") == "in_corpus").alias("in_corpus"),
        F.count_if(F.col("scope") == "out_of_corpus").alias("out_of_corpus"),
        F.count_if(F.size("history") > 0).alias("with_history"),
        F.sum(F.greatest(F.size("expected_passages"), F.lit(0))).alias("passages_checked"),
    )
    return out.withColumn("passages_missing", missing.scalar()).withColumn("valid", F.col("passages_missing") == 0)


# --- runs ------------------------------------------------------------------------------------


def compare_runs(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("section", "name")) -> DataFrame:
    """Union of the keys of two runs with both values and, for numbers, the difference.

    Inputs: section ('config' or 'summary'), name, value (text).
    """
    left = a.select(*keys, F.col("value").alias("value_a"))
    right = b.select(*keys, F.col("value").alias("value_b"))
    x, y = F.expr("try_cast(value_a AS double)"), F.expr("try_cast(value_b AS double)")
    return left.join(right, list(keys), "full").select(
        *keys, "value_a", "value_b", (y - x).alias("delta"), F.col("value_a").eqNullSafe(F.col("value_b")).alias("same")
    )


def embedding_calls(questions: int | Column, variants: int, full: bool) -> Column:
    per_question = variants + (variants + 1 if full else 0)
    return (F.lit(questions) if isinstance(questions, int) else questions) * per_question


def price_table(spark) -> DataFrame:
    return spark.createDataFrame(V.MODEL_PRICES, "model string, input_usd double, output_usd double")


def run_cost(usage: DataFrame, prices: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Calls, tokens and cost per run. `usage`: model, input_tokens, output_tokens."""
    cost = (
        F.col("input_tokens") * F.coalesce("input_usd", F.lit(0.0))
        + F.col("output_tokens") * F.coalesce("output_usd", F.lit(0.0))
    ) / 1e6
    return usage.join(prices, "model", "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(cost).alias("cost_usd"),
    )


def mean_latency(results: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    seconds = F.coalesce("retrieval_seconds", F.lit(0.0)) + F.coalesce("generation_seconds", F.lit(0.0))
    return results.groupBy(*keys).agg(F.avg(seconds).alias("mean_latency_seconds"))
