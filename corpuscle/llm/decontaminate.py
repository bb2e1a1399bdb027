"""Benchmark decontamination by greedy string tiling.

Texts are compared as lower-cased words (runs of letters, digits and marks of any script; single characters in scripts without blanks). A document that shares a run of `SEED` words with a
test item is a candidate; tiling then marks the longest matches first, each word once on either side, until no match of `SEED`
words is left. Matches come from rolling hashes of `SEED` words: runs of equal ones on a diagonal are the maximal matches, and
a match that runs into marked words is cut and put back. Passages count in any order, so a reordered item is caught. A
document leaks an item when the tiles cover at least `THRESHOLD` of the item's words.

The benchmark is read in blocks of about `BLOCK_CHARS` characters, which is the bound on what is broadcast; each block is one
pass over the documents, without a shuffle. A pair of document and item is tiled only if the words that shared runs touch
could reach the threshold, which no tiling exceeds.

Defined cases: a null text has no words; items of fewer than `SEED` words match nothing (they cannot be told from
chance); repeated documents and items each give their own rows; an empty benchmark leaks nothing; other columns of the
input do not matter and are kept by `clean`.
"""

from __future__ import annotations

import functools
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.arrays import flat, in_words, prefix_hashes, rows_of, slices, sliding, span_hashes, spans

SEED = 5
THRESHOLD = 0.8
BLOCK_CHARS = 8 << 20
SEPARATOR, LETTER, ALONE = 0, 1, 2
# Thai, Lao, Myanmar, Khmer, kana and ideographs: each character is a word.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
    (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF),
)


@functools.cache
def _kinds() -> np.ndarray:
    """Per code point: SEPARATOR, LETTER (letters, digits and their marks), or ALONE in scripts without blanks."""
    kinds = np.fromiter((unicodedata.category(chr(c))[0] in "LNM" for c in range(0x110000)), np.uint8, 0x110000)
    for first, last in UNSPACED:
        kinds[first : last + 1] *= np.uint8(ALONE)
    return kinds


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in a row, and the n + 1 offsets of the texts in them."""
    low = [t.lower() for t in texts]
    joined = "".join(low)
    offsets = np.cumsum([0, *map(len, low)])
    # A character of ASCII has the same hash either way.
    if joined.isascii():
        data = np.frombuffer(joined.encode(), np.uint8)
        starts, ends = spans(in_words(data), offsets)
    else:
        data = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _kinds()[data]
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == ALONE)
        cut[offsets] = True
        starts, ends = np.flatnonzero(cut[:-1] & (kind != SEPARATOR)), np.flatnonzero(cut[1:] & (kind != SEPARATOR)) + 1
    return span_hashes(prefix_hashes(data), starts, ends), np.searchsorted(starts, offsets)


def tile(pattern: np.ndarray, text: np.ndarray, seed: int = SEED) -> list[tuple[int, int, int]]:
    """(place in pattern, place in text, words) of the tiles of two word sequences, longest first."""
    own, other = sliding(pattern, seed), sliding(text, seed)
    at = np.flatnonzero(np.isin(other, own))
    order = np.argsort(own, kind="stable")
    low = np.searchsorted(own[order], other[at], "left")
    n = np.searchsorted(own[order], other[at], "right") - low
    t = np.repeat(at, n)
    p = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    if not len(t):
        return []
    along = np.lexsort((t, t - p))
    t, p = t[along], p[along]
    fresh = np.flatnonzero(np.concatenate(([True], (np.diff(t) != 1) | (np.diff(p) != 1))))
    lengths = np.diff(np.append(fresh, len(t))) + seed - 1
    queue = [(-int(k), int(a), int(b)) for k, a, b in zip(lengths, p[fresh], t[fresh], strict=True)]
    heapq.heapify(queue)
    used_p, used_t, tiles = np.zeros(len(pattern), bool), np.zeros(len(text), bool), []
    while queue:
        k, a, b = heapq.heappop(queue)
        busy = used_p[a : a - k] | used_t[b : b - k]
        if not busy.any():
            used_p[a : a - k] = used_t[b : b - k] = True
            tiles.append((a, b, -k))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([True], busy, [True]))))
        for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if y - x >= seed:
                heapq.heappush(queue, (x - y, a + x, b + x))
    return tiles


class Items:
    """The test items of one block, with an index of their word runs."""

    def __init__(self, ids: list[int], texts: list[str], seed: int = SEED, threshold: float = THRESHOLD):
        self.ids, self.seed, self.threshold = ids, seed, threshold
        hashes, offsets = words(texts)
        self.words = [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        runs = sliding(hashes, seed)
        at = np.arange(len(runs))
        row = rows_of(at, offsets) if len(at) else at
        whole = at + seed <= offsets[row + 1] if len(at) else np.zeros(0, bool)
        order = np.argsort(runs[whole], kind="stable")
        self.runs, self.run_item = runs[whole][order], row[whole][order]
        self.run_place = (at - offsets[row])[whole][order] if len(at) else at
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.runs & np.uint64(len(self.bits) - 1)] = True

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, covered words, tiles) of the leaks."""
        if not len(self.runs):
            return
        hashes, offsets = words(texts)
        runs = sliding(hashes, self.seed)
        at = np.flatnonzero(self.bits[runs & np.uint64(len(self.bits) - 1)])
        at = at[np.isin(runs[at], self.runs)]
        row = rows_of(at, offsets)
        inside = at + self.seed <= offsets[row + 1]
        at, row = at[inside], row[inside]
        for text in np.unique(row).tolist():
            shared = np.unique(runs[at[row == text]])
            low, high = np.searchsorted(self.runs, shared, "left"), np.searchsorted(self.runs, shared, "right")
            hits = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
            for item in np.unique(self.run_item[hits]).tolist():
                size = len(self.words[item])
                reach = np.zeros(size + 1, np.int64)
                places = self.run_place[hits[self.run_item[hits] == item]]
                np.add.at(reach, places, 1)
                np.add.at(reach, places + self.seed, -1)
                if np.count_nonzero(np.cumsum(reach)[:-1]) < self.threshold * size:
                    continue
                tiles = tile(self.words[item], hashes[offsets[text] : offsets[text + 1]], self.seed)
                covered = sum(k for _, _, k in tiles)
                if covered >= self.threshold * size:
                    yield text, item, covered, len(tiles)


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[Items]:
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(total // block_chars) + 1
    for k in range(n):
        part = benchmark.filter((F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) & F.col("text").isNotNull()).select("item_id", "text")
        rows = part.orderBy("item_id", "text").collect()  # about block_chars characters
        if rows:
            yield Items([r["item_id"] for r in rows], [r["text"] for r in rows])


def _scan(batch: pa.RecordBatch, items: Items) -> Iterator[tuple[int, int, int, int]]:
    texts = batch.column("text")
    offsets = flat(texts)[1]
    for start, end in slices(offsets):
        for text, item, covered, tiles in items.matches([t or "" for t in texts.slice(start, end - start).to_pylist()]):
            yield start + text, item, covered, tiles


def leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, n_words, covered, tiles) of every document and item that the tiles cover enough of."""
    out = None
    for items in _blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = cloudpickle.loads(shared.value)
            for batch in batches:
                ids, found = batch.column("doc_id").to_pylist(), list(_scan(batch, own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[t] for t, *_ in found], pa.int64()), pa.array([own.ids[i] for _, i, *_ in found], pa.int64()),
                     pa.array([len(own.words[i]) for _, i, *_ in found], pa.int64()), pa.array([c for *_, c, _ in found], pa.int64()),
                     pa.array([n for *_, n in found], pa.int64())],
                    ["doc_id", "item_id", "n_words", "covered", "tiles"],
                )

        part = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
            run, "doc_id bigint, item_id bigint, n_words bigint, covered bigint, tiles bigint"
        )
        out = part if out is None else out.unionByName(part)
    empty = docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, n_words bigint, covered bigint, tiles bigint")
    return empty if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that leak no item, all columns kept."""
    for items in _blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = cloudpickle.loads(shared.value)
            for batch in batches:
                kept = np.ones(batch.num_rows, bool)
                kept[[t for t, *_ in _scan(batch, own)]] = False
                yield batch.filter(pa.array(kept))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
