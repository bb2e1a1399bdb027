"""Near duplicates by SimHash: fingerprints of word shingles, linked where few bits differ, and the groups that links form.

A fingerprint bit is set if it is set in over half the hashes of a text's shingles. Fingerprints that differ in at most
`radius` bits are found by a hierarchical index. Its upper nodes are masked bit patterns: the bits are cut into
radius + 1 masks, and fingerprints within the radius agree on all bits of at least one, so only those that share a node are
compared. A node of more than `NODE` fingerprints gets lower nodes in the same way, by masks of the bits still open; after `LEVELS`
levels so few bits are open that a node cannot grow further. Inside a node the fingerprints are sorted by Gray rank, which
brings near ones together, and packed into a tree: each group of eight keeps the bits that all its members share, less
what stands above it. A search adds up differences on the way down and leaves a group as soon as they exceed the radius.

Equal fingerprints are one entry with their smallest id, so a group of exact copies costs one row. A node sends a spanning forest of
its links, never all pairs. Components of the links join them across nodes.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; fewer words than a
shingle make one shingle; rows with a null id are in the group of their fingerprint's links; repeated rows get equal results;
other columns of the input do not matter to `groups` and are kept by `keep_first`, which leaves rows without an id alone and
keeps one row of each id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.config import broadcast_if_small, materialize
from corpuscle.llm.components import components

SHINGLE = 3
RADIUS = 3
NODE = 4096
LEVELS = 5
FAN = 8
FRONTIER = 1 << 20
SEED = 42


# --- fingerprints -----------------------------------------------------------------------


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every shingle of the words of a text, A-Z lowered, joined by a blank."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every text as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text"))
            fps = np.fromiter((fingerprint(shingle_hashes(t, shingle)) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return ids.mapInArrow(run, "doc_id bigint, fp bigint")


# --- the index --------------------------------------------------------------------------


def masks_of(open_bits: int, parts: int) -> list[int]:
    """The open bits cut into so many masks."""
    bits = [b for b in range(64) if open_bits >> b & 1]
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def gray_rank(fp: Column) -> Column:
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _tree(fps: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From the members up: (first child, shared bits, their pattern) per node of each level, until every group is one node."""
    ends = np.append(starts[1:], len(fps))
    levels = [(np.arange(len(fps) + 1), np.full(len(fps), ~np.uint64(0)), fps)]
    while (ends - starts).max(initial=1) > 1:
        per = (ends - starts + FAN - 1) // FAN
        new_ends = np.cumsum(per)
        new_starts = new_ends - per
        group = np.repeat(np.arange(len(starts)), per)
        first = starts[group] + (np.arange(new_ends[-1]) - new_starts[group]) * FAN
        _, shared, pattern = levels[-1]
        every = np.bitwise_and.reduceat(shared & pattern, first) | np.bitwise_and.reduceat(shared & ~pattern, first)
        levels.append((np.append(first, ends[-1]), every, np.bitwise_and.reduceat(pattern, first) & every))
        starts, ends = new_starts, new_ends
    return levels


def _links(fps: np.ndarray, starts: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group within the radius, searched from every row through the tree of its group."""
    levels = _tree(fps, starts)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(fps))))
    sizes = np.diff(np.append(starts, len(fps)))[group]
    reach = np.cumsum(sizes)
    at = 0
    while at < len(fps):
        until = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + FRONTIER, "right")))
        row = np.arange(at, until)
        node = group[row]
        first, shared, pattern = levels[-1]
        gone = np.bitwise_count((fps[row] ^ pattern[node]) & shared[node]).astype(np.int64)
        keep = gone <= radius
        row, node, gone = row[keep], node[keep], gone[keep]
        for depth in range(len(levels) - 1, 0, -1):
            above = levels[depth][1]
            first = levels[depth][0]
            _, shared, pattern = levels[depth - 1]
            n = first[node + 1] - first[node]
            parent = np.repeat(np.arange(len(node)), n)
            child = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[node][parent]
            row, gone, node = row[parent], gone[parent], node[parent]
            # What the node above has counted is not counted again.
            gone = gone + np.bitwise_count((fps[row] ^ pattern[child]) & shared[child] & ~above[node])
            keep = gone <= radius
            if depth == 1:
                keep &= child < row
            row, node, gone = row[keep], child[keep], gone[keep]
        if len(levels) > 1:
            yield row, node
        at = until


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row that each row is linked to, over any number of links."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            x, y = root[a], root[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
    return root


def links(entries: DataFrame, radius: int = RADIUS, node: int = NODE) -> DataFrame:
    """(fp, first) of distinct fingerprints -> (a, b): links between `first` ids that connect all within the radius."""
    parts = radius + 1
    rows = entries.withColumns({"path": F.lit(0), "key": F.lit(0).cast("bigint")})
    leaves = None
    open_bits = [(1 << 64) - 1]
    for level in range(LEVELS + 1):
        masks = [m for bits in open_bits for m in masks_of(bits, parts)]
        table = F.array(*[F.lit(_signed(m)) for m in masks])
        below = F.col("path") * parts
        step = F.explode(F.sequence(below, below + parts - 1))
        rows = rows.select("fp", "first", "key", step.alias("path"))
        rows = rows.withColumn("key", F.xxhash64("key", "path", F.col("fp").bitwiseAND(F.get(table, F.col("path")))))
        open_bits = [bits & ~m for bits in open_bits for m in masks_of(bits, parts)]
        if level == LEVELS or min(b.bit_count() for b in open_bits) < 2 * parts:
            leaves = rows if leaves is None else leaves.union(rows)
            break
        rows = materialize(rows, "simhash-nodes")
        large = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > node).select("key"), "simhash-large")
        if large.isEmpty():
            leaves = rows if leaves is None else leaves.union(rows)
            break
        large = broadcast_if_small(large, 32)
        small = rows.join(large, "key", "left_anti")
        leaves = small if leaves is None else leaves.union(small)
        rows = rows.join(large, "key", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def forest(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            key, fps, first = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("key", "fp", "first"))
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            root = _forest(len(key), _links(fps.view(np.uint64), starts, radius))
            tied = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(first[tied]), pa.array(first[root[tied]])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))  # all but the last node of the batch is whole
            if cut:
                yield forest([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield forest(held)

    ordered = leaves.withColumn("rank", gray_rank(F.col("fp"))).repartition("key").sortWithinPartitions("key", "rank")
    return ordered.select("key", "fp", "first").mapInArrow(run, "a bigint, b bigint")


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id that links reach from each document."""
    marked = materialize(fingerprints(docs, shingle), "fingerprints")
    # An entry needs a number of its own: its smallest id. Fingerprints of rows without any id stand alone.
    entries = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-entries")
    joined = components(links(entries.filter(F.col("first").isNotNull()), radius))
    entries = entries.join(joined, F.col("first") == F.col("node"), "left")
    entries = entries.select(F.col("fp").alias("_fp"), F.coalesce("component", "first").alias("component_id"))
    return marked.join(entries, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def later_ids(found: DataFrame) -> DataFrame:
    """(doc_id) of `groups` that is not the smallest of its group."""
    return found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()


def keep_first(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents whose id is the smallest of their group."""
    found = materialize(groups(docs, shingle, radius).filter(F.col("doc_id").isNotNull()), "simhash-groups")
    kept = docs.join(later_ids(found), "doc_id", "left_anti").select(*docs.columns)
    if found.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    by_id = Window.partitionBy("doc_id").orderBy("text")
    numbered = kept.filter(F.col("doc_id").isNotNull()).withColumn("_copy", F.row_number().over(by_id)).filter("_copy = 1").drop("_copy")
    return numbered.unionByName(kept.filter(F.col("doc_id").isNull()))
