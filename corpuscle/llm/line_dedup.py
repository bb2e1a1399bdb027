"""Line deduplication by an exact set-similarity join: a line goes if an earlier one is alike.

A line is the set of its words (runs of letters and digits, A-Z lowered). Lines of Jaccard similarity of at least 0.8 to an
earlier line, by (doc_id, line number) of the input, are removed, whether or not that one is removed itself. Lines without a
word stay.

Equal sets of a batch settle at once: only the earliest line of each goes on. Words are ordered by rarity; two similar
sets share a word among their first n - ceil(0.8 n) + 1. Words seen once in the corpus match nothing and give no key; a word in
more than `HOT` lines is no key alone but with two further words of the longer prefix, in which similar sets share three. So a
key of one word has at most `HOT` lines. The rows of many keys travel together: a task sends its rows by bucket of the key, a
bucket's columns as stretches of numbers in one row, and whole buckets are compared.

Of the equal sets of a key the earliest line stands for all. The others lie in order of length, and each meets only longer ones
that its length and the key's place in it let be similar. Length, position and a parity bitmap of the words (the bits in
which two differ are a lower bound on the words in which they differ; 64 bits, 256 for `LONG` words and more) leave few
pairs. Each line takes earlier ones, nearest in length first, until `FIRST` of them are well within the bound or `WEAK` in all,
and if none of these is verified a second round takes all. Equal sets need no verification (a hash of the
whole set travels along); it counts the common words of both lines of the others.

Rarity is read off a table of 2^22 counters (a fixed size, whatever the corpus), added up over all lines. Counters that
words share make a word look more frequent, which costs speed and no result, as any one order does for the filter. Words are
64-bit hashes in the verification, their leading 36 bits and rarity elsewhere.

Defined cases: null or empty texts have no lines to remove; rows with a null doc_id take no part and stay as they are;
repeated rows stand at the same place, none is the later one, and lose the same lines; one line may lose all its
document's text, which is then empty; other columns of the input stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.config import broadcast_if_small, materialize
from corpuscle.llm.arrays import flat, in_words, lowered, mix, prefix_hashes, rows_of, slices, span_hashes, spans
from corpuscle.llm.storage import small_batches, tidy

COUNTER_BITS = 22
COUNTER_BLOCK = 1 << 16
HOT = 50000
FIRST = 4
WEAK = 32
LONG = 64
AT_ONCE = 1 << 17  # rows that a task compares at a time
MIN_BUCKET_BITS, MAX_BUCKET_BITS = 12, 16
FEW_KEYS = 1 << 20

_TOKEN = np.uint64((1 << 44) - 1)


def rarity_class(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of sixteenths of a doubling, in a byte."""
    return np.minimum(255, np.rint(8 * np.log2(1.0 + counts))).astype(np.uint8)


ONCE, HOT_CLASS = rarity_class(np.array([1, HOT]))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """Per stretch of texts: hashes of the words, the row and the line number in its text of each word, the ids."""
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        for start, end in slices(offsets):
            own = lowered(data[offsets[start] : offsets[end]])
            borders = offsets[start : end + 1] - offsets[start]
            starts, ends = spans(in_words(own), borders)
            hashes = span_hashes(prefix_hashes(own), starts, ends)
            breaks = np.flatnonzero(own == 10)
            row = rows_of(starts, borders)
            passed = np.repeat(np.arange(len(breaks) + 1), np.diff(np.concatenate(([0], np.searchsorted(starts, breaks), [len(starts)]))))
            line = passed - np.searchsorted(breaks, borders[:-1])[row] if len(starts) else starts
            yield hashes, row, line, batch.slice(start, end - start)


def count_words(docs: DataFrame) -> np.ndarray:
    """The counters of all words of all texts, as rarity classes; every task sends the blocks of its own table."""
    blocks = (1 << COUNTER_BITS) // COUNTER_BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << COUNTER_BITS, np.int64)
        held: list[np.ndarray] = []

        def pour() -> None:
            if held:
                table[:] += np.bincount(np.concatenate(held), minlength=len(table))
                held.clear()

        for hashes, *_ in _chunks(batches):
            held.append((hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64))
            if len(held) == 16:
                pour()
        pour()
        table = table.astype(np.uint32)
        used = [b for b in range(blocks) if table[b * COUNTER_BLOCK : (b + 1) * COUNTER_BLOCK].any()]
        for b in used:
            part = table[b * COUNTER_BLOCK : (b + 1) * COUNTER_BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                part = np.frombuffer(counts.as_buffer(), np.uint32).astype(np.uint64)
                sums[b] = sums[b] + part if b in sums else part
        for b, part in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([rarity_class(part).tobytes()], pa.binary())], ["block", "classes"]
            )

    parts = docs.mapInArrow(count, "block int, counts binary").repartition("block")
    classes = np.zeros(1 << COUNTER_BITS, np.uint8)
    for r in parts.mapInArrow(add, "block int, classes binary").collect():  # 4 MB in all
        classes[r["block"] * COUNTER_BLOCK : (r["block"] + 1) * COUNTER_BLOCK] = np.frombuffer(r["classes"], np.uint8)
    return classes


def line_keys(tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, place of the key's first word) of all lines; tokens lie by line in order of rarity."""
    line = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(tokens)) - starts[line]
    prefix = sizes - (4 * sizes + 4) // 5 + 1
    rare = (tokens >> np.uint64(36)).astype(np.uint8)
    asked = (place < prefix[line]) & (sizes[line] >= 4) & (rare > ONCE)
    alone = asked & (rare < HOT_CLASS)
    lines, keys, places = [line[alone]], [mix(tokens[alone])], [place[alone]]
    hot = np.flatnonzero(asked & (rare >= HOT_CLASS))
    if len(hot):
        # Three words of the prefix that is longer by two: the hot one and every two behind it.
        room = (np.minimum(sizes, prefix + 2)[line] - place)[hot]
        for gap in range(1, int(room.max())):
            for far in range(gap + 1, int(room.max())):
                fits = hot[room > far]
                if not len(fits):
                    break
                lines.append(line[fits])
                keys.append(mix(mix(mix(tokens[fits]) + tokens[fits + gap]) + tokens[fits + far]))
                places.append(place[fits])
    return np.concatenate(lines), np.concatenate(keys), np.concatenate(places)


def _lines(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """Lines with words of some megabytes of text at a time: doc, line, set hash a, size n, and their words by rarity."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def whole():
        doc, line, a, n, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
        return {"doc": doc, "line": line, "a": a, "n": n, "tokens": tokens}

    for hashes, row, number, batch in _chunks(batches):
        if not len(row):
            continue
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        fresh = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(number) != 0))))
        dense = np.repeat(np.arange(len(fresh)), np.diff(np.append(fresh, len(row)))).astype(np.uint64)
        token = (table[(hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(36)) | (hashes & np.uint64((1 << 36) - 1))
        for first in range(0, len(fresh), 1 << 20):
            last = min(first + (1 << 20), len(fresh))
            part = slice(fresh[first], fresh[last] if last < len(fresh) else len(row))
            keyed = np.sort(((dense[part] - np.uint64(first)) << np.uint64(44)) | token[part])
            keyed = keyed[np.concatenate(([True], keyed[1:] != keyed[:-1]))]
            line, tokens = keyed >> np.uint64(44), keyed & _TOKEN
            starts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
            words = fresh[first:last]
            held.append((ids[row[words]], number[words], mix(np.add.reduceat(mix(tokens), starts)), np.diff(np.append(starts, len(tokens))), tokens))
            size += len(tokens)
        if size > 700_000:
            yield whole()
            held, size = [], 0
    if held:
        yield whole()


_ROW = {"key": np.int64, "doc": np.int64, "line": np.int32, "n": np.int32, "place": np.uint16, "bits": np.uint64, "a": np.uint64}


def bucket_bits(classes: np.ndarray) -> int:
    """Buckets, as a power of two, of about 2^16 rows each where a sixth of the words counted gives a key."""
    words = float((np.exp2(classes / 8.0) - 1).sum())
    return int(np.clip(np.ceil(np.log2(1 + words / 6)) - 16, MIN_BUCKET_BITS, MAX_BUCKET_BITS))


def _binary(data: np.ndarray, borders: np.ndarray) -> pa.Array:
    """The stretches of an array between the borders as a binary column."""
    offsets = (borders * data.itemsize * (data.size // len(data) if len(data) else 1)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(borders) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _packed(held: list[dict[str, np.ndarray]], bits: int) -> pa.RecordBatch:
    """One row a bucket: its rows' columns as stretches of numbers. A bitmap is in `bits` for short lines, in `wide` for long ones."""
    rows = {c: np.concatenate([x[c] for x in held]) for c in _ROW}
    long_ = rows["n"] >= LONG
    at = np.cumsum(long_) - 1  # a long line's place in `wide`
    wide = np.concatenate([x["wide"] for x in held])
    bucket = (rows["key"].view(np.uint64) >> np.uint64(64 - bits)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, long_ = bucket[order], long_[order]
    fresh = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    borders = np.append(fresh, len(bucket))
    longs = np.concatenate(([0], np.cumsum(long_)))[borders]
    columns = [pa.array(bucket[fresh])]
    columns += [_binary(rows[c][order], borders) for c in _ROW if c != "bits"]
    columns += [_binary(rows["bits"][order[~long_]], borders - longs), _binary(wide[at[order[long_]]], longs)]
    return pa.RecordBatch.from_arrays(columns, ["bucket", *(c for c in _ROW if c != "bits"), "bits", "wide"])


def _flat(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row a key."""
    long_ = rows["n"] >= LONG
    offsets = np.concatenate(([0], np.cumsum(np.where(long_, 32, 0)))).astype(np.int32)
    valid = pa.py_buffer(np.packbits(long_, bitorder="little"))
    wide = pa.Array.from_buffers(pa.binary(), len(long_), [valid, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows["wide"]))])
    columns = [pa.array(rows[c].astype(np.int32) if c == "place" else rows[c].view(np.int64) if c in ("bits", "a") else rows[c]) for c in _ROW]
    return pa.RecordBatch.from_arrays([*columns, wide], [*_ROW, "wide"])


def _keyed(x: dict[str, np.ndarray], asked: np.ndarray | None) -> dict[str, np.ndarray]:
    """A row per key of each line: key, doc, line, n, place, bits, a; and `wide`, the wide bitmaps of the long lines' rows alone.

    Lines whose set the stretch has earlier are settled; they stand with n = 0 under a key of their own. `asked` tells by a
    key's leading bits which ones are of interest; settled lines are left out then.
    """
    doc, line, a, n, tokens = (x[c] for c in ("doc", "line", "a", "n", "tokens"))
    order = np.lexsort((line, doc, n, a))
    again = np.concatenate(([False], (a[order][1:] == a[order][:-1]) & (n[order][1:] == n[order][:-1])))
    first = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))]
    copy = np.zeros(len(order), bool)
    copy[order] = again & ((doc[order] != doc[first]) | (line[order] != line[first]))
    kept = np.repeat(~copy, n)
    live, tokens = np.flatnonzero(~copy), tokens[kept]
    starts = np.cumsum(n[live]) - n[live]
    at, keys, places = line_keys(tokens, starts, n[live])
    # Sets too small for a similar one but themselves have themselves as their key.
    small = np.flatnonzero(n[live] < 4)
    at, keys, places = np.concatenate((at, small)), np.concatenate((keys, mix(a[live][small]))), np.concatenate((places, np.zeros(len(small), np.int64)))
    gone = np.flatnonzero(copy)
    if asked is not None:
        gone = gone[:0]
        hit = asked[(keys >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
        at, keys, places = at[hit], keys[hit], places[hit]
        used = np.zeros(len(live), bool)
        used[at] = True
        tokens = tokens[np.repeat(used, n[live])]
        at, live = (np.cumsum(used) - 1)[at], live[used]
        starts = np.cumsum(n[live]) - n[live]
    spread = mix(tokens)
    bit = np.uint64(1) << (spread & np.uint64(63))
    bits = np.bitwise_xor.reduceat(bit, starts) if len(starts) else bit
    lane = (spread >> np.uint64(6)) & np.uint64(3)
    wide = np.stack([np.bitwise_xor.reduceat(np.where(lane == np.uint64(i), bit, np.uint64(0)), starts) if len(starts) else bit for i in range(4)], axis=1)
    row = live[at]
    own = mix(doc[gone].view(np.uint64) * np.uint64(31) + line[gone].astype(np.uint64))
    none = np.zeros(len(gone), np.int64)
    return {
        "key": np.concatenate((keys, own)).view(np.int64), "doc": np.concatenate((doc[row], doc[gone])).astype(np.int64),
        "line": np.concatenate((line[row], line[gone])).astype(np.int32), "n": np.concatenate((n[row], none)).astype(np.int32),
        # A place cut at 65535 is a weaker filter, no wrong one.
        "place": np.concatenate((np.minimum(places, 65535), none)).astype(np.uint16),
        "bits": np.concatenate((bits[at], none.astype(np.uint64))), "a": np.concatenate((a[row], a[gone])), "wide": wide[at[n[row] >= LONG]],
    }


def dealt(docs: DataFrame, classes: np.ndarray, asked: np.ndarray | None = None) -> DataFrame:
    """The rows of `_keyed` of all lines: in buckets of keys, many rows in one, or a row a key if only some keys are asked for."""
    shared = docs.sparkSession.sparkContext.broadcast((classes.tobytes(), None if asked is None else asked.tobytes()))
    bits = bucket_bits(classes)
    enough = min(1 << 20, max(1 << 17, 32 << bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, wanted = (np.frombuffer(x, np.uint8) if x else None for x in shared.value)
        held, size = [], 0
        for x in _lines(batches, table):
            rows = _keyed(x, None if wanted is None else wanted.view(bool))
            if wanted is not None:
                yield _flat(rows)
                continue
            held.append(rows)
            size += len(rows["key"])
            if size >= enough:
                yield _packed(held, bits)
                held, size = [], 0
        if size:
            yield _packed(held, bits)
        pa.default_memory_pool().release_unused()

    if asked is not None:
        return docs.mapInArrow(run, "key bigint, doc bigint, line int, n int, place int, bits bigint, a bigint, wide binary")
    return docs.mapInArrow(run, "bucket int, key binary, doc binary, line binary, n binary, place binary, a binary, bits binary, wide binary")


PAIR, MORE, SAME = 0, 1, 2
_CUT = (1 << 15) - 1  # longer lines count as lines of one length


def _near(rows: dict[str, np.ndarray], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(later row, earlier row, status) of rows whose keys are all there, in any order.

    The status is SAME for equal sets; MORE where a line has as many candidates as asked for and there may be others.
    Of equal sets of a key the earliest line stands for all. The others are compared in order of length, each with those one,
    two, three, ... behind it, as far as its length and the place of its key let a longer line be similar.
    """
    order = np.argsort(rows["key"])
    key = rows["key"][order]
    group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64))))
    lengths = np.minimum(rows["n"][order], _CUT).astype(np.int64)
    inner = np.argsort((group << 43) | (lengths << 28) | (rows["a"][order] >> np.uint64(36)).astype(np.int64))
    order, key, lengths, group = order[inner], key[inner], lengths[inner], group[inner]
    n, a, doc, line = (rows[c][order] for c in ("n", "a", "doc", "line"))
    equal = np.concatenate(([False], (key[1:] == key[:-1]) & (n[1:] == n[:-1]) & (a[1:] == a[:-1])))
    out = [[], [], []]
    if equal.any():
        run = np.cumsum(~equal)
        mates = np.flatnonzero(equal | np.append(equal[1:], False))
        mates = mates[np.lexsort((line[mates], doc[mates], run[mates]))]
        head = np.concatenate(([True], run[mates][1:] != run[mates][:-1]))
        earliest = mates[np.maximum.accumulate(np.where(head, np.arange(len(mates)), 0))]
        # Equal sets have all keys in common; one at their first word tells it.
        tells = (rows["place"][order[mates]] == 0) & ((doc[mates] != doc[earliest]) | (line[mates] != line[earliest]))
        out[0].append(order[mates[tells]])
        out[1].append(order[earliest[tells]])
        out[2].append(np.ones(int(tells.sum()), bool))
        stands = ~equal
        stands[mates] = head
        keep = np.flatnonzero(stands)
        order, lengths, group, n, a, doc, line = (x[keep] for x in (order, lengths, group, n, a, doc, line))
    n, place, bits = n.astype(np.int64), rows["place"][order].astype(np.int64), rows["bits"][order]
    weak = first * WEAK // FIRST
    found = np.where(rows["wanted"][order], 0, weak)
    # The longest line that shares enough words behind the key's place.
    most = 9 * (n - place) // 4 - n
    most = np.where(lengths < _CUT, most, np.maximum(most, n))  # beyond the cut a longer line may come first
    base = (group << 15) | lengths
    row = np.flatnonzero(most >= n)
    reach = np.searchsorted(base, (group[row] << 15) | np.minimum(most[row], _CUT), "right") - 1 - row
    gap = 0
    while True:
        gap += 1
        if gap <= 8 or gap % 4 == 0:
            open_ = reach >= gap
            row, reach = row[open_], reach[open_]
            own_bits, own_n = bits[row], n[row]
        if not len(row):
            break
        other = np.minimum(row + gap, len(n) - 1)
        apart = np.bitwise_count(own_bits ^ bits[other]).astype(np.int64)
        hit = np.flatnonzero((9 * apart <= own_n + n[other]) & (reach >= gap))
        if not len(hit):
            continue
        x, y, apart = row[hit], other[hit], apart[hit]
        swap = (doc[x] > doc[y]) | ((doc[x] == doc[y]) & (line[x] > line[y]))
        x, y = np.where(swap, x, y), np.where(swap, y, x)  # x is later
        both = n[x] + n[y]
        needed = (4 * both + 8) // 9
        long_ = np.flatnonzero((n[x] >= LONG) & (n[y] >= LONG))
        if len(long_):
            apart[long_] = np.bitwise_count(rows["wide"][rows["at"][order[x[long_]]]] ^ rows["wide"][rows["at"][order[y[long_]]]]).sum(1, dtype=np.int64)
        room = np.minimum(n[x] - place[x], n[y] - place[y])
        same = (a[x] == a[y]) & (n[x] == n[y])
        # Where not even one word may differ only equal sets are similar.
        alike = same | ((n[x] >= 4) & (n[y] >= 4) & (both > 2 * needed) & (room >= needed) & (both - 2 * needed >= apart))
        alike &= ((doc[x] != doc[y]) | (line[x] != line[y])) & (found[x] < weak)
        x, y, same, strong = x[alike], y[alike], same[alike], (2 * apart <= both - 2 * needed)[alike]
        # A strong candidate counts as much as several weak ones; equal sets end the search.
        found[x] += np.where(same, 1 << 62, np.where(strong, WEAK // FIRST, 1))
        out[0].append(order[x])
        out[1].append(order[y])
        out[2].append(same)
    cut_short = np.zeros(len(rows["key"]), bool)
    cut_short[order] = found >= weak
    later, earlier, same = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
    return later, earlier, np.where(same.astype(bool), SAME, np.where(cut_short[later], MORE, PAIR))


def _numbers(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and how many each row has; nulls have none."""
    column = column.fill_null(b"") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype), np.diff(offsets) // np.dtype(dtype).itemsize


def _unpacked(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The rows of a batch of `dealt`; `unit` is what keeps a key's rows together, `at` a long line's place in `wide`."""
    if "bucket" in batch.schema.names:
        rows = {c: _numbers(batch.column(c), kind)[0] for c, kind in _ROW.items()}
        rows["unit"] = np.repeat(batch.column("bucket").to_numpy(), _numbers(batch.column("key"), np.int64)[1])
        rows["wanted"] = np.ones(len(rows["key"]), bool)
    else:
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*_ROW, "wanted")}
        rows |= {"unit": rows["key"], "a": rows["a"].view(np.uint64), "bits": rows["bits"].view(np.uint64)}
    rows["wide"] = _numbers(batch.column("wide"), np.uint64)[0].reshape(-1, 4)
    long_ = rows["n"] >= LONG
    if "bucket" in batch.schema.names:
        bits = np.zeros(len(long_), np.uint64)
        bits[~long_], bits[long_] = rows["bits"], np.bitwise_xor.reduce(rows["wide"], axis=1)
        rows["bits"] = bits
    rows["at"] = np.cumsum(long_) - 1
    return rows


def candidates(rows: DataFrame, first: int = FIRST) -> DataFrame:
    """(doc_id, line, other_doc, other_line, status, key): pairs of lines of one key that no filter rules out.

    The key is given for the status MORE, 0 elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(doc, line, other_doc, other_line, status, key):
            return pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(line), pa.array(other_doc), pa.array(other_line), pa.array(status, pa.int32()), pa.array(key, pa.int64())],
                ["doc_id", "line", "other_doc", "other_line", "status", "key"],
            )

        def pairs(group: dict[str, np.ndarray]) -> pa.RecordBatch:
            later, earlier, status = _near(group, first)
            cut_short = np.where(status == MORE, group["key"][later], 0)
            return out(group["doc"][later], group["line"][later], group["doc"][earlier], group["line"][earlier], status, cut_short)

        def pieces(group: dict[str, np.ndarray], end: int) -> Iterator[pa.RecordBatch]:
            """The rows before `end`, in stretches of whole buckets or keys."""
            start = 0
            while start < end:
                cut = end
                if end - start > AT_ONCE:
                    cut = int(np.searchsorted(group["unit"][:end], group["unit"][start + AT_ONCE], "right"))
                yield pairs({c: x if c == "wide" else x[start:cut] for c, x in group.items()})
                start = cut

        def joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
            start = np.cumsum([0] + [len(p["wide"]) for p in parts])
            return {c: np.concatenate([p[c] + s if c == "at" else p[c] for p, s in zip(parts, start, strict=False)]) for c in parts[0]}

        held: list[dict[str, np.ndarray]] = []
        size, enough = 0, AT_ONCE
        for batch in batches:
            own = _unpacked(batch)
            done = own["n"] == 0
            if done.any():
                doc, line = own["doc"][done], own["line"][done]
                yield out(doc, line, doc, line, np.full(len(doc), SAME), np.zeros(len(doc)))
                own = {c: x if c == "wide" else x[~done] for c, x in own.items()}
            if not len(own["key"]):
                continue
            held.append(own)
            size += len(own["key"])
            if size >= enough:
                group = joined(held)
                # All but the last bucket or key is whole.
                cut = int(np.searchsorted(group["unit"], group["unit"][-1], "left"))
                yield from pieces(group, cut)
                rest = {c: x if c == "wide" else x[cut:] for c, x in group.items()}
                low = int((group["n"][:cut] >= LONG).sum())
                held = [rest | {"wide": rest["wide"][low:].copy(), "at": rest["at"] - low}]
                size -= cut
                enough = max(AT_ONCE, 2 * size)
        if size:
            group = joined(held)
            yield from pieces(group, size)
        pa.default_memory_pool().release_unused()

    unit = "bucket" if "bucket" in rows.columns else "key"
    ordered = rows.repartition(unit).sortWithinPartitions(unit)
    return ordered.mapInArrow(run, "doc_id bigint, line int, other_doc bigint, other_line int, status int, key bigint")


def line_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, line, words): the word hashes of the lines asked for."""
    lists = wanted.groupBy("doc_id").agg(F.collect_set("line").alias("lines"))  # at most the lines of a text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, row, number, batch in _chunks(batches):
            ids, lines = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("lines").to_pylist()
            fresh = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(number) != 0)))) if len(row) else row
            asked = [set(x) for x in lines]
            ends = np.append(fresh[1:], len(row))
            hit = [(int(row[s]), int(number[s]), hashes[s:e]) for s, e in zip(fresh.tolist(), ends.tolist(), strict=True) if number[s] in asked[row[s]]]
            words = [np.unique(h).view(np.int64) for *_, h in hit]
            offsets = np.cumsum([0] + [len(w) for w in words]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[[r for r, *_ in hit]] if hit else [], pa.int64()), pa.array([k for _, k, _ in hit], pa.int32()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(words) if words else np.zeros(0, np.int64)))],
                ["doc_id", "line", "words"],
            )

    return docs.select("doc_id", "text").join(lists, "doc_id").mapInArrow(run, "doc_id bigint, line int, words array<bigint>")


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, line) of the later lines of the pairs that are similar."""
    wanted = pairs.select("doc_id", "line").union(pairs.select("other_doc", "other_line")).distinct()
    words = materialize(line_words(docs, wanted), "line-words")
    other = words.select(F.col("doc_id").alias("other_doc"), F.col("line").alias("other_line"), F.col("words").alias("other_words"))
    met = pairs.join(words, ["doc_id", "line"]).join(other, ["other_doc", "other_line"])
    alike = 9 * F.size(F.array_intersect("words", "other_words")) >= 4 * (F.size("words") + F.size("other_words"))
    return met.filter(alike).select("doc_id", "line").distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, removed): per document that loses lines their numbers, from 0, in order."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    place = ["doc_id", "line"]
    with tidy(docs.sparkSession), small_batches(docs.sparkSession):
        classes = count_words(docs)
        found = materialize(candidates(dealt(docs, classes).withColumn("wanted", F.lit(True))), "line-pairs")
        gone = found.filter(F.col("status") == SAME).select(*place).distinct()
        pairs = found.filter(F.col("status") != SAME).join(gone, place, "left_anti")
        pairs = materialize(pairs, "line-open")
        alike = materialize(verified(docs, pairs.drop("status", "key").distinct()), "line-matches")
        more = pairs.filter(F.col("status") == MORE).select(*place, "key").distinct().join(alike, place, "left_anti")
        more = materialize(more, "line-more")
        if not more.isEmpty():
            # Only the keys whose search was cut short are dealt again; few of them let the tasks leave out nearly all others.
            distinct = materialize(more.select("key").distinct(), "line-keys")
            hits = np.ones(1 << COUNTER_BITS, bool)
            if distinct.count() <= FEW_KEYS:
                hits[:] = False
                hits[(distinct.toArrow().column("key").to_numpy().view(np.uint64) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)] = True
            keys = broadcast_if_small(distinct, 64)
            asked = broadcast_if_small(more.select(F.col("doc_id").alias("doc"), "line", F.lit(True).alias("wanted")).distinct(), 64)
            again = dealt(docs, classes, hits).join(keys, "key", "left_semi")
            marked = again.join(asked, ["doc", "line"], "left").fillna(False, ["wanted"])
            rest = candidates(marked, first=1 << 40).filter(F.col("status") != SAME).drop("status", "key").distinct()
            alike = alike.union(materialize(verified(docs, materialize(rest, "line-rest")), "line-matches"))
    return gone.union(alike).distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("removed"))


def dedup(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """`docs` without the removed lines in `text`; `drop_emptied` leaves out documents that lose all their words."""
    gone = removed_lines(docs).withColumnRenamed("removed", "_removed").withColumnRenamed("doc_id", "_doc")
    left = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("_removed"))
    text = F.array_join(F.transform(left, lambda i: F.get(F.col("_parts"), i)), "\n")
    joined = docs.join(gone, F.col("doc_id") == F.col("_doc"), "left").withColumn("_parts", F.split("text", "\n"))
    out = joined.withColumn("text", F.when(F.col("_removed").isNull(), F.col("text")).otherwise(text))
    if drop_emptied:
        out = out.filter(F.col("_removed").isNull() | F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"))
    return out.select(*docs.columns)
