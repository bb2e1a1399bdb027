"""Near duplicates by the Jaccard similarity of word shingles: minhash bands find candidates, whole sets decide.

A text is the set of its shingles of `size` words (runs without white space, A-Z lowered). Texts agree on a minhash as often as
their sets overlap; `BANDS` bands of `ROWS` minhashes each miss a pair of similarity 0.8 once in ten thousand. Equal sets are one
entry with their smallest id. The entries of a band's bucket are held against its smallest id first, and what is verified joins
them to groups. Then every other pair of a bucket whose two sides are in different groups is held against each other: a byte of
each minhash (`LIKELY` of them must agree, which a pair of 0.8 fails once in millions) rules most out, whole sets decide the rest.
So many alike give as many pairs as they are, and no link of a bucket is lost. A bucket of more than `BLOCK` entries is
cut into blocks that meet two by two, each in a task. Where very many share a bucket but not a group this is quadratic in time.
Every link is verified by the common shingles of both sets; components join the links.

Defined cases: null, empty and blank texts have the same empty set; fewer words than a shingle make one shingle; rows with a null
id are kept; one row of each id is kept; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.config import materialize
from corpuscle.llm.arrays import flat, lowered, mix, prefix_hashes, sliding, slices, span_hashes, spans
from corpuscle.llm.components import components

BANDS = 24
ROWS = 5
SEED = 42
LIKELY = 72
BLOCK = 4096
CELLS = 1 << 17  # pairs of entries that a task compares at once


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per stretch of texts: the hashes of their distinct shingles, sorted within each text, and how many each text has."""
    data, offsets = flat(column)
    for start, end in slices(offsets):
        own = lowered(data[offsets[start] : offsets[end]])
        borders = offsets[start : end + 1] - offsets[start]
        begins, ends = spans((own != 32) & ((own - np.uint8(9)) > 4), borders)
        words = span_hashes(prefix_hashes(own), begins, ends)
        first = np.searchsorted(begins, borders)
        n_words = np.diff(first)
        runs = sliding(words, size)
        at = np.arange(len(runs))
        row = np.repeat(np.arange(end - start), n_words)
        whole = row[: len(runs)] == row[size - 1 :][: len(runs)]
        short = np.flatnonzero((n_words > 0) & (n_words < size))
        # Fewer words than a shingle: their sequence is the one shingle.
        few = [mix(np.uint64(n_words[t]) + sliding(words[first[t] : first[t + 1]], int(n_words[t]))) for t in short.tolist()]
        rows = np.concatenate((row[at[whole]], short))
        hashes = np.concatenate([runs[whole], *few])
        order = np.lexsort((hashes, rows))
        rows, hashes = rows[order], hashes[order]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        yield hashes[fresh], np.bincount(rows[fresh], minlength=end - start)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, whole, n, bands, marks): a hash of the set, its size, the band keys and a byte of each minhash of every text."""
    a = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) + np.uint64(SEED)) | np.uint64(1)
    b = mix(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wholes, sizes, keys, bytes_of = [], [], [], []
            for hashes, n in shingle_sets(batch.column("text"), size):
                some = np.flatnonzero(n)
                starts = (np.cumsum(n) - n)[some]
                whole = np.zeros(len(n), np.uint64)
                band = np.zeros((len(n), BANDS), np.uint64)
                marks = np.zeros((len(n), BANDS * ROWS), np.uint8)
                if len(some):
                    whole[some] = mix(np.add.reduceat(mix(hashes), starts))
                    for k in range(BANDS):
                        key = np.full(len(some), k, np.uint64)
                        for i in range(k * ROWS, (k + 1) * ROWS):
                            least = np.minimum.reduceat(hashes * a[i] + b[i], starts)
                            marks[some, i] = mix(least).astype(np.uint8)
                            key = mix(key + least)
                        band[some, k] = key
                wholes.append(whole)
                sizes.append(n)
                keys.append(band)
                bytes_of.append(marks)
            whole, n, band, marks = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (wholes, sizes, keys, bytes_of))
            # Fixed size in the buffer, plain binary for Spark.
            packed = pa.BinaryArray.from_buffers(
                pa.binary(), len(n), [None, pa.py_buffer((np.arange(len(n) + 1) * BANDS * ROWS).astype(np.int32)), pa.py_buffer(marks.astype(np.uint8).tobytes())]
            )
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(band.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(whole.view(np.int64)), pa.array(n.astype(np.int64)), lists, packed], ["doc_id", "whole", "n", "bands", "marks"])

    return docs.mapInArrow(run, "doc_id bigint, whole bigint, n bigint, bands array<bigint>, marks binary")


def verified(docs: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """(a, b) of the pairs whose sets have a similarity of at least 0.8; `docs` has one row of each id."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(shingle_sets(batch.column("text"), size))
            hashes, n = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))], ["id", "s"])

    sets = materialize(docs.join(wanted, F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(run, "id bigint, s array<bigint>"), "shingle-sets")
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    alike = 9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))
    return materialize(met.filter(alike).select("a", "b"), "shingle-links")


def _head_pairs(rows: DataFrame) -> DataFrame:
    """Each entry of a bucket with the bucket's smallest id, where the sizes allow 0.8; `rows` has each bucket's `head`."""
    fits = (F.col("first") != F.col("head.first")) & (5 * F.least("n", "head.n") >= 4 * F.greatest("n", "head.n"))
    return rows.filter(fits).select(F.col("first").alias("a"), F.col("head.first").alias("b")).distinct()


def _likely(n: np.ndarray, group: np.ndarray, block: np.ndarray, marks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, sorted by size, of different groups whose minhashes mostly agree; of two blocks only pairs across."""
    two = block[0] != block[-1] or (block != block[0]).any()
    until = np.searchsorted(n, 5 * n // 4, "right")
    start = 0
    while start < len(n):
        end = start + 1
        while end < len(n) and (end + 1 - start) * (until[end] - start) <= CELLS:
            end += 1
        x, y = np.arange(start, end), np.arange(start + 1, until[end - 1])
        met = (y[None, :] > x[:, None]) & (y[None, :] < until[x][:, None]) & (group[x][:, None] != group[y][None, :])
        if two:
            met &= block[x][:, None] != block[y][None, :]
        i, j = np.nonzero(met)
        i, j = x[i], y[j]
        alike = np.zeros(len(i), bool)
        for k in range(0, len(i), CELLS):
            alike[k : k + CELLS] = (marks[i[k : k + CELLS]] == marks[j[k : k + CELLS]]).sum(1) >= LIKELY
        yield i[alike], j[alike]
        start = end


def _other_pairs(rows: DataFrame, entries: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """Likely pairs of a bucket without its smallest id, between entries that are in different groups yet."""
    rest = rows.filter(F.col("first") != F.col("head.first")).select("key", "first", "n")
    rest = rest.join(groups, F.col("first") == F.col("node"), "left").select("key", "first", "n", F.coalesce("component", "first").alias("group"))
    rest = materialize(rest, "shingle-rest")
    mixed = rest.groupBy("key").agg(F.count(F.lit(1)).alias("_m"), F.min("group").alias("_lo"), F.max("group").alias("_hi")).filter("_lo < _hi")
    blocks = F.ceil(F.col("_m") / block)
    own = rest.join(mixed.select("key", blocks.alias("_blocks")), "key").withColumn("block", F.pmod(F.xxhash64("first"), F.col("_blocks")))
    met = own.withColumn("_with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
    # A block meets itself once and every other one.
    met = met.select("key", F.least("block", "_with").alias("i"), F.greatest("block", "_with").alias("j"), "first", "n", "group", "block")
    met = met.join(entries.select("first", "marks"), "first")
    names = ["first", "n", "group", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        last = None

        def pairs(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            first, n, group, own, marks = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(first) > 1:
                for x, y in _likely(n, group, own, marks):
                    if len(x):
                        a, b = np.maximum(first[x], first[y]), np.minimum(first[x], first[y])
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], 1)
            columns = [batch.column(c).to_numpy() for c in names]
            packed = batch.column("marks").cast(pa.large_binary())
            offsets = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1]
            columns.append(np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, BANDS * ROWS))
            cuts = np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                this = tuple(at[start].tolist())
                if held and this != last:
                    yield from pairs(held)
                    held = []
                last = this
                held.append([c[start:end].copy() for c in columns])
        if held:
            yield from pairs(held)

    ordered = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n")
    return ordered.select("key", "i", "j", *names, "marks").mapInArrow(run, "a bigint, b bigint")


def one_each(docs: DataFrame) -> DataFrame:
    """One row of each id, the one with the least text; rows without an id stay."""
    if docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs
    by_id = Window.partitionBy("doc_id").orderBy("text")
    known = docs.filter(F.col("doc_id").isNotNull()).withColumn("_copy", F.row_number().over(by_id)).filter("_copy = 1").drop("_copy")
    return materialize(known.unionByName(docs.filter(F.col("doc_id").isNull())), "shingle-once")


def links(docs: DataFrame, size: int = 5, block: int = BLOCK) -> DataFrame:
    """(a, b): links between ids that connect all documents whose sets are equal or alike; `docs` has one row of each id."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull())
    marked = materialize(sketches(own, size), "shingle-sketches")
    least = F.min_by(F.struct("bands", "marks"), "doc_id").alias("_s")
    entries = marked.groupBy("whole", "n").agg(least, F.min("doc_id").alias("first")).select("whole", "n", "first", "_s.*")
    entries = materialize(entries, "shingle-entries")
    rows = materialize(entries.filter("n > 0").select("first", "n", F.explode("bands").alias("key")), "shingle-bands")
    heads = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_many"), F.min(F.struct("first", "n")).alias("head")).filter("_many > 1")
    rows = materialize(rows.join(heads.select("key", "head"), "key"), "shingle-buckets")
    near = materialize(_head_pairs(rows), "shingle-pairs")
    found = verified(own, near, size)
    others = _other_pairs(rows, entries, components(found), block).distinct().join(near, ["a", "b"], "left_anti")
    found = found.union(verified(own, materialize(others, "shingle-pairs"), size))
    copies = marked.join(entries.select("whole", "n", "first"), ["whole", "n"]).filter("doc_id <> first")
    return found.union(copies.select(F.col("doc_id").alias("a"), F.col("first").alias("b")))


def keep_first(docs: DataFrame, size: int = 5, also: DataFrame | None = None) -> DataFrame:
    """The documents whose id is the smallest of their group; `also` has further links (a, b) between ids, which groups follow too."""
    docs = one_each(docs)
    found = links(docs, size)
    gone = components(found if also is None else found.union(also)).select(F.col("node").alias("_gone"))
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
