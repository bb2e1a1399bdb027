"""Token ids in compressed shards: Re-Pair grammars with expansion lengths for random access.

`write_tokens` tokenises texts, closes each with an end id and lays them in ascending id order into shards. Inside a shard
the frequent pairs of neighbouring symbols are replaced by new symbols, round by round, until no pair is frequent, a round
gains little, or the symbols no longer fit 16 bits (32 for larger vocabularies); no pair crosses the end of a document. A shard is one row of a
Parquet table: document ids, tokens and symbols per document, the rules (two symbols each), the length to which each rule
expands, and the symbols. `read_tokens` decodes all documents; `read_range` decodes any run of token positions and
expands only the symbols that cover it.

Re-Pair takes the most frequent pair first. Here a round takes all pairs down to a 64th of the most frequent one's
count at once; where two of them overlap the more frequent one wins, and in a run of one symbol every second pair. Counts
are exact and of the whole shard.

Texts are cut at ASCII white space, which the tokenizer drops, so each distinct word of a stretch is tokenised once. That
holds for a tokenizer that drops white space and splits there, as the given one does; `by_word=False` tokenises whole texts.

Memory: a task holds one shard of about `SHARD_TOKENS` ids, or one document if that is longer. Texts are shuffled once, by
ranges of (id, hash of the text, random number), so a repeated id or text is no one task's load. Only splitters reach the driver.

Defined cases: a null or empty text is its end id alone; a null id comes first; rows of one id follow each other by a hash
of the text, and repeated rows stay; an empty table gives no shard; other columns of the input do not matter.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.config import broadcast_if_small, materialize
from corpuscle.llm.arrays import flat, slices
from corpuscle.llm.storage import small_batches
from corpuscle.operators.ordering import running_before

SHARD_TOKENS = 5 << 19
PARTITION_BYTES = 64 << 20
# A rule pays for itself (two symbols and a length) after a few uses; below this the gain is not worth a round.
LEAST_USES = 32
# Rounds end with one that shortens a shard by less than this share.
LEAST_GAIN = 0.01
ROUND_RATIO = 64
_STRETCH = 1 << 20
_CACHED_WORDS = 1 << 18
_TABLE_BITS = 18
# Marks that compose with ASCII letters, and the sign that special tokens hold.
_CASE_MATTERS = "[\u0300-\u036f]|\\|"
# Latin letters; that with a dot above is two characters in lower case. No two of them compose.
_LATIN = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"


class WordTokens:
    """Token ids of texts, each distinct word tokenised once while it is remembered."""

    def __init__(self, tokenizer_file: str, by_word: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.by_word = by_word
        self.plain, self.small, self.seen_as = self._letters()
        self._forget()

    def _letters(self) -> tuple[bool, re.Pattern | None, dict[int, str]]:
        """Whether a run of small ASCII letters reaches the model as it is, so that such words can be given to the model itself;
        and the Latin letters of which a run is one piece too, with what the model sees for each."""
        normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        if self.tokenizer.pre_tokenizer is None:
            return False, None, {}
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str
        one = lambda text, seen: [p for p, _ in pieces(normal(text))] == [seen]
        ascii_ = "abcdefghijklmnopqrstuvwxyz"
        seen_as = {}
        for c in filter(re.compile(f"[{_LATIN}]").match, map(chr, range(0x61, 0x250))):
            found = pieces(normal(c)) if len(normal(c)) == 1 else []
            if len(found) == 1:
                seen_as[ord(c)] = found[0][0]
        letters = "".join(map(chr, seen_as))
        if not letters or not one(letters, letters.translate(seen_as)):
            return one(ascii_, ascii_), None, {}
        return one(ascii_, ascii_), re.compile(f"[{re.escape(letters)}]+"), seen_as

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.ids, self.ends = array("I"), array("q")

    def _append(self, words: list[str], ids: list[int], ends: list[int]) -> None:
        base = len(self.ids)
        self.places.update(zip(words, range(len(self.ends), len(self.ends) + len(words)), strict=True))
        self.ids.extend(ids)
        self.ends.extend([base + e for e in ends])

    def _learn_one_by_one(self, words: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        self._append(words, list(chain.from_iterable(found)), list(accumulate(map(len, found))))

    def _learn(self, words: list[str]) -> None:
        """Words of letters only are one piece each, so many go in one call, told apart by the piece number."""
        small, joined, others = [], [], []
        for w in words:
            if not w.isalpha():
                others.append(w)
            elif (self.plain and w.isascii() and w.islower()) or (self.small and self.small.fullmatch(w)):
                small.append(w)
            else:
                joined.append(w)
        self._learn_one_by_one(others)
        tokenize, seen_as, ids, ends = self.tokenizer.model.tokenize, self.seen_as, [], []
        for w in small:
            ids += [token.id for token in tokenize(w if w.isascii() else w.translate(seen_as))]
            ends.append(len(ids))
        self._append(small, ids, ends)
        for start in range(0, len(joined), 1000):
            some = joined[start : start + 1000]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            pieces = np.array(found.word_ids, np.int64)
            if not len(pieces) or pieces[-1] != len(some) - 1:  # lower case may add a mark, which is a piece of its own
                self._learn_one_by_one(some)
            else:
                self._append(some, found.ids, np.searchsorted(pieces, np.arange(1, len(some) + 1)).tolist())

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the n + 1 offsets of the texts in them."""
        if not self.by_word:
            found = [e.ids for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), np.concatenate(([0], np.cumsum(lengths)))
        # Fewer distinct words: lower case is the tokenizer's own step, but comes after composition of marks and after its
        # special tokens; stops after a Latin letter and before white space are a piece of their own.
        data, offsets = flat(texts)  # from offset zero: ascii_lower misreads slices
        texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets.copy()), pa.py_buffer(data))
        texts = pc.if_else(pc.match_substring_regex(texts, _CASE_MATTERS), texts, pc.ascii_lower(texts))
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, f"([{_LATIN}])([.,;:!?]+)(\\s|$)", r"\1 \2\3"))
        distinct = words.flatten().dictionary_encode()
        offsets = np.asarray(words.offsets) - words.offsets[0].as_py()
        values = distinct.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.places) > _CACHED_WORDS:
            self._forget()  # frequent words are soon known again
        self._learn([w for w in values if w not in self.places])
        place = np.fromiter(map(self.places.__getitem__, values), np.int64, len(values))
        ends, known = np.array(self.ends, np.int64), np.array(self.ids, np.uint32)
        lengths, begins = np.diff(ends, prepend=0)[place], np.concatenate(([0], ends))[place]
        at = distinct.indices.to_numpy()
        ends = np.cumsum(lengths[at])
        total = int(ends[-1]) if len(ends) else 0
        ids = known[np.arange(total) + np.repeat(begins[at] - (ends - lengths[at]), lengths[at])]
        return ids, np.concatenate(([0], ends))[offsets]


@lru_cache(maxsize=1)
def _word_tokens(tokenizer_file: str, by_word: bool) -> WordTokens:
    """One for all tasks of a Python worker, one after the other: it need not read its file and learn its words again."""
    return WordTokens(tokenizer_file, by_word)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where a new value starts in sorted keys."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


def _pairs(symbols: np.ndarray, start: int, end: int) -> np.ndarray:
    wide = np.uint32 if symbols.dtype == np.uint16 else np.uint64
    return symbols[start:end].astype(wide) << wide(8 * symbols.dtype.itemsize) | symbols[start + 1 : end + 1]


def pair_counts(symbols: np.ndarray, closed: np.ndarray, step: int = 1 << 23) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of neighbouring symbols, where the first is not `closed`, and how often each occurs."""
    keys, counts = [], []
    for start in range(0, len(symbols) - 1, step):
        end = min(len(symbols) - 1, start + step)
        part = np.sort(_pairs(symbols, start, end)[~closed[start:end]])
        if len(part):
            first = _runs(part)
            keys.append(part[first])
            counts.append(np.diff(np.append(first, len(part))))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(keys) == 1:
        return keys[0], counts[0]
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    first = _runs(keys[order])
    return keys[order][first], np.add.reduceat(counts[order], first)


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)


def _apart(pairs: np.ndarray) -> np.ndarray:
    """Of pairs by falling count, those that have a slot of the look-up table for themselves; the others wait for a round."""
    return np.sort(np.unique(_slots(pairs), return_index=True)[1])


def _places(symbols: np.ndarray, closed: np.ndarray, pairs: np.ndarray, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Where the given pairs (each with its own slot) occur, and which of them."""
    table = np.zeros(1 << _TABLE_BITS, np.int32)
    table[_slots(pairs)] = np.arange(len(pairs))
    at, which = [], []
    for start in range(0, len(symbols) - 1, step):
        end = min(len(symbols) - 1, start + step)
        keys = _pairs(symbols, start, end)
        near = table[_slots(keys)]
        hit = np.flatnonzero((pairs[near] == keys) & ~closed[start:end])
        at.append((hit + start).astype(np.int32))
        which.append(near[hit])
    return np.concatenate(at), np.concatenate(which)


def _settle(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of occurrences that overlap (neighbouring places), which are replaced: the lower rank wins."""
    follows = np.concatenate(([False], at[1:] == at[:-1] + 1))
    # One rank next to itself is a run of one symbol: every second place counts, from the left.
    same = follows & np.concatenate(([False], rank[1:] == rank[:-1]))
    index = np.arange(len(at), dtype=np.int32)
    since = index - np.maximum.accumulate(np.where(same, np.int32(0), index))
    open_ = np.flatnonzero(since % 2 == 0).astype(np.int32)
    del follows, same, index, since
    taken = []
    # Chains of ever better ranks settle from their ends; what is open after these steps waits for the next round.
    for _ in range(32):
        if not len(open_):
            break
        place, r = at[open_], rank[open_]
        joined = place[1:] == place[:-1] + 1
        before, after = np.concatenate(([False], joined)), np.concatenate((joined, [False]))
        wins = (~before | (r < np.concatenate(([0], r[:-1])))) & (~after | (r < np.concatenate((r[1:], [0]))))
        taken.append(open_[wins])
        gone = wins.copy()
        gone[1:] |= wins[:-1] & joined
        gone[:-1] |= wins[1:] & joined
        open_ = open_[~gone]
    return np.sort(np.concatenate(taken)) if taken else np.zeros(0, np.int32)


def compress(symbols: np.ndarray, closed: np.ndarray, vocabulary: int, least: int = LEAST_USES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, closed, rules) after Re-Pair; rule i stands for symbol vocabulary + i. The arrays given are used up."""
    limit = int(np.iinfo(symbols.dtype).max) + 1
    half = 8 * symbols.dtype.itemsize
    rules: list[np.ndarray] = []
    free = vocabulary
    while free < limit and len(symbols) > 1:
        keys, counts = pair_counts(symbols, closed)
        if not len(keys) or counts.max() < least:
            break
        chosen = np.flatnonzero(counts >= max(least, counts.max() // ROUND_RATIO))
        chosen = chosen[np.argsort(-counts[chosen], kind="stable")][: limit - free]
        pairs = keys[chosen]
        pairs = pairs[_apart(pairs)]
        at, which = _places(symbols, closed, pairs)
        wins = _settle(at, which)
        at, which = at[wins], which[wins]
        paid = np.bincount(which, minlength=len(pairs)) >= max(2, least // 2)
        if not paid.any():
            break
        names = (np.cumsum(paid) - 1 + free).astype(symbols.dtype)
        kept = paid[which]
        at, which = at[kept], which[kept]
        symbols[at] = names[which]
        closed[at] = closed[at + 1]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, closed = symbols[stay], closed[stay]
        found = pairs[paid]
        rules.append(np.stack((found >> found.dtype.type(half), found & found.dtype.type((1 << half) - 1)), 1).astype(symbols.dtype))
        free += len(found)
        if len(at) < LEAST_GAIN * len(symbols):
            break
    return symbols, closed, np.concatenate(rules) if rules else np.zeros((0, 2), symbols.dtype)


def expansion_lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    lengths: list[int] = []
    for a, b in rules.tolist():
        lengths.append((1 if a < vocabulary else lengths[a - vocabulary]) + (1 if b < vocabulary else lengths[b - vocabulary]))
    return np.array(lengths, np.uint32)


class Decoder:
    """Expands symbols of one shard. Rules are laid out once, later ones from the earlier ones they are made of."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, vocabulary: int):
        self.lengths = np.concatenate((np.ones(vocabulary, np.int64), lengths.astype(np.int64)))
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.laid = np.zeros(int(self.lengths.sum()), np.uint32)
        self.laid[:vocabulary] = np.arange(vocabulary)
        begins, sizes = self.begins.tolist(), self.lengths.tolist()
        for i, (a, b) in enumerate(rules.tolist(), vocabulary):
            at, middle = begins[i], begins[i] + sizes[a]
            self.laid[at:middle] = self.laid[begins[a] : begins[a] + sizes[a]]
            self.laid[middle : middle + sizes[b]] = self.laid[begins[b] : begins[b] + sizes[b]]

    def expand(self, symbols: np.ndarray, step: int = 1 << 19) -> np.ndarray:
        out = []
        for start in range(0, len(symbols), step):
            part = symbols[start : start + step]
            sizes = self.lengths[part]
            ends = np.cumsum(sizes)
            out.append(self.laid[np.arange(ends[-1]) + np.repeat(self.begins[part] - (ends - sizes), sizes)])
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def between(self, symbols: np.ndarray, first: int, beyond: int) -> np.ndarray:
        """Ids at the positions first to beyond (exclusive) of the expansion; only the symbols over them are expanded."""
        ends = np.cumsum(self.lengths[symbols])
        low, high = np.searchsorted(ends, first, "right"), np.searchsorted(ends, beyond, "left") + 1
        skip = first - int(ends[low] - self.lengths[symbols[low]]) if low < len(ends) else 0
        return self.expand(symbols[low:high])[skip : skip + beyond - first]


_PAYLOAD = "n_tokens bigint, vocabulary int, lengths array<bigint>, widths array<bigint>, rules binary, spans binary, symbols binary"


def _schema(id_type: str) -> str:
    return f"shard bigint, ids array<{id_type}>, {_PAYLOAD}"


def write_tokens(
    docs: DataFrame, path: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", by_word: bool = True,
    partition_bytes: int = PARTITION_BYTES, shard_tokens: int = SHARD_TOKENS, least: int = LEAST_USES,
) -> None:
    """Write `docs` (an id and `text`) as token shards under `path`. The tokenizer file must be at that place on every executor."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spread = rows.withColumn("_tie", F.xxhash64("text")).withColumn("_even", F.rand(7))
    keys = ["id", "_tie", "_even"]
    # One partition per `partition_bytes`: the number follows the data, not a setting.
    ordered = spread.repartitionByRange(total // partition_bytes + 1, *keys).sortWithinPartitions(*keys).select("id", "text")
    id_type = ordered.schema["id"].dataType.simpleString()

    def pack(ids: list[pa.Array], lengths: np.ndarray, symbols: np.ndarray, vocabulary: int, number: int) -> pa.RecordBatch:
        symbols = symbols.astype(np.uint16 if vocabulary < 1 << 16 else np.uint32)
        closed = np.zeros(len(symbols), bool)
        closed[np.cumsum(lengths) - 1] = True
        n_tokens = len(symbols)
        symbols, closed, rules = compress(symbols, closed, vocabulary, least)
        ends = np.flatnonzero(closed)
        column = pa.concat_arrays(ids)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()), one(column), pa.array([n_tokens], pa.int64()), pa.array([vocabulary], pa.int32()),
                one(pa.array(lengths, pa.int64())), one(pa.array(np.diff(ends, prepend=-1), pa.int64())),
                pa.array([rules.tobytes()], pa.binary()), pa.array([expansion_lengths(rules, vocabulary).tobytes()], pa.binary()),
                pa.array([symbols.tobytes()], pa.binary()),
            ],
            ["shard", "ids", "n_tokens", "vocabulary", "lengths", "widths", "rules", "spans", "symbols"],
        )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _word_tokens(tokenizer_file, by_word)
        vocabulary = max(tokens.tokenizer.get_vocab_size(), end_id + 1)
        number = TaskContext.get().partitionId() << 32  # shards of a partition are numbered on from here
        ids: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            texts = batch.column("text")
            sizes = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))))
            for start, end in slices(sizes, _STRETCH):
                found, offsets = tokens(texts.slice(start, end - start))
                parts.append(np.insert(found, offsets[1:], end_id).astype(np.uint16 if vocabulary < 1 << 16 else np.uint32))
                lengths.append(np.diff(offsets) + 1)
                ids.append(batch.column("id").slice(start, end - start))
                held += len(parts[-1])
                if held >= shard_tokens:
                    yield pack(ids, np.concatenate(lengths), np.concatenate(parts), vocabulary, number)
                    ids, lengths, parts, held, number = [], [], [], 0, number + 1
            pa.default_memory_pool().release_unused()  # what a batch took is not kept beside the JVM's heap
        if held:
            yield pack(ids, np.concatenate(lengths), np.concatenate(parts), vocabulary, number)

    with small_batches(docs.sparkSession):
        ordered.mapInArrow(encode, _schema(id_type)).write.parquet(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards, each with `first`: the number of tokens in all shards before it."""
    table = spark.read.parquet(path)
    narrow = table.select("shard", "n_tokens").withColumn("_all", F.lit(0))
    # Numbers grow by partition: a range of them is one bucket, so even millions of shards meet in several tasks.
    firsts = running_before(narrow, ["_all"], [F.col("shard")], F.shiftright("shard", 42), {"first": F.col("n_tokens")})
    # One number a shard; the shards themselves stay where they are.
    return table.join(broadcast_if_small(materialize(firsts.select("shard", "first"), "shard-firsts"), 32), "shard")


def _decoder(row: dict) -> tuple[Decoder, np.ndarray]:
    kind = np.uint16 if row["vocabulary"] < 1 << 16 else np.uint32
    rules = np.frombuffer(row["rules"], kind).reshape(-1, 2)
    return Decoder(rules, np.frombuffer(row["spans"], np.uint32), row["vocabulary"]), np.frombuffer(row["symbols"], kind)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Every document: id, start (tokens of all documents before it), n_tokens, tokens (little-endian unsigned 32-bit ids)."""
    table = shards(spark, path)
    id_type = table.schema["ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("vocabulary", "first")}
                row |= {n: batch.column(n)[i].as_buffer() for n in ("rules", "spans", "symbols")}
                decoder, symbols = _decoder(row)
                ids, lengths, widths = (batch.column(n)[i].values for n in ("ids", "lengths", "widths"))
                n = lengths.to_numpy()
                starts = np.concatenate(([0], np.cumsum(n)))
                ends = np.concatenate(([0], np.cumsum(widths.to_numpy())))
                for low, high in slices(starts, 1 << 20):
                    tokens = decoder.expand(symbols[ends[low] : ends[high]])
                    offsets = pa.py_buffer((4 * (starts[low : high + 1] - starts[low])).tobytes())
                    data = pa.Array.from_buffers(pa.large_binary(), high - low, [None, offsets, pa.py_buffer(tokens.tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(low, high - low), pa.array(starts[low:high] + row["first"]), pa.array(n[low:high]), data.cast(pa.binary())],
                        [id_col, "start", "n_tokens", "tokens"],
                    )

    return table.mapInArrow(decode, f"`{id_col}` {id_type}, start bigint, n_tokens bigint, tokens binary")


def read_range(spark: SparkSession, path: str, first: int, beyond: int) -> DataFrame:
    """The ids at token positions first to beyond (exclusive): a row per shard that holds some, (start, tokens)."""
    table = shards(spark, path).filter((F.col("first") < beyond) & (F.col("first") + F.col("n_tokens") > first))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                decoder, symbols = _decoder(row)
                low, high = max(first, row["first"]), min(beyond, row["first"] + row["n_tokens"])
                tokens = decoder.between(symbols, low - row["first"], high - row["first"]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([tokens], pa.list_(pa.int64()))], ["start", "tokens"])

    wanted = table.select("first", "n_tokens", "vocabulary", "rules", "spans", "symbols")
    return wanted.mapInArrow(decode, "start bigint, tokens array<bigint>")
