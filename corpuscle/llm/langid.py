"""Language identification by n-gram filters that answer for all languages at once.

Every letter of a lower-cased text gives one n-gram: the character before it, itself and the two after it, other
characters counting as one blank. The n-grams that a language uses often enough (`MIN_RATE`, and at least `MIN_SHARE`
of the rate in the language that uses it most) go into a Bloom filter stored bit-sliced: a slot holds one bit per
language, so three look-ups and two ANDs return the mask of all languages that hold the n-gram. A text's hits per
language are popcounts of its masks by bit, less what the filter's false positives explain.

The filters are fitted on up to `SAMPLE` labelled documents per language, chosen by a hash of the id; they hold at most
1 / MIN_RATE n-grams a language, whatever the corpus. Prediction is one pass over the texts, without a shuffle.

Defined cases: a text that is null or has no letter is `und` with score 0, as is any text where nothing was learned;
documents without a language are not learned from; equal hits go to the language that sorts first; repeated rows are
scored one by one; other columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.arrays import mix, slices

SAMPLE = 4000
MIN_RATE = 1e-5
MIN_SHARE = 0.1
SLOT_BITS = 20
PROBES = 3
UNKNOWN = "und"

_FACTORS = np.random.default_rng(3).integers(1, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)
_TABLE = np.fromiter((chr(i).isalpha() for i in range(0x3000)), bool, 0x3000)


def letters(codes: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter: by table, and for the rarer ones by asking for each that occurs."""
    high = codes >= len(_TABLE)
    out = _TABLE[np.where(high, 0, codes)]
    if high.any():
        found, place = np.unique(codes[high], return_inverse=True)
        out[high] = np.fromiter((chr(c).isalpha() for c in found.tolist()), bool, len(found))[place]
    return out


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts in a row, and the n + 1 offsets of the texts in them."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(("\0\0" + "\0\0".join(lowered) + "\0\0").encode("utf-32-le"), np.uint32)
    is_letter = letters(codes)
    codes = np.where(is_letter, codes, 0).astype(np.uint64)
    at = np.flatnonzero(is_letter)
    hashes = mix(codes[at - 1] * _FACTORS[0] + codes[at] * _FACTORS[1] + codes[at + 1] * _FACTORS[2] + codes[at + 2] * _FACTORS[3])
    ends = np.cumsum([0] + [len(t) + 2 for t in lowered])
    return hashes, np.searchsorted(at, ends + 1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        offsets = np.cumsum([0] + [len(t or "") for t in texts])
        for start, end in slices(offsets):
            yield batch.slice(start, end - start), [t or "" for t in texts[start:end]]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


class Filters:
    """The bit-sliced filters of all languages."""

    def __init__(self, languages: list[str], grams: list[np.ndarray], slot_bits: int = SLOT_BITS):
        width = next(d for d in (8, 16, 32, 64) if len(languages) <= d) if len(languages) <= 64 else None
        if width is None:
            raise ValueError("a slot holds up to 64 languages")
        self.languages = languages
        self.slot_bits = slot_bits
        self.slots = np.zeros(1 << slot_bits, f"uint{width}")
        for i, own in enumerate(grams):
            for at in self.probes(own):
                np.bitwise_or.at(self.slots, at, self.slots.dtype.type(1 << i))
        ones = np.array([np.count_nonzero(self.slots >> self.slots.dtype.type(i) & self.slots.dtype.type(1)) for i in range(len(languages))])
        self.false_rate = (ones / (1 << slot_bits)) ** PROBES

    def probes(self, hashes: np.ndarray) -> list[np.ndarray]:
        low = np.uint64((1 << self.slot_bits) - 1)
        return [(hashes >> np.uint64(i * self.slot_bits)) & low for i in range(PROBES)]

    def languages_of(self, hashes: np.ndarray) -> np.ndarray:
        """Per n-gram the mask of the languages that hold it."""
        first, *rest = self.probes(hashes)
        masks = self.slots[first]
        for at in rest:
            masks &= self.slots[at]
        return masks

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams per text, and per text and language the share of them that the language holds."""
        hashes, offsets = ngrams(texts)
        masks = self.languages_of(hashes)
        n = np.diff(offsets)
        out = np.zeros((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            bit = masks >> masks.dtype.type(i) & masks.dtype.type(1)
            running = np.concatenate(([0], np.cumsum(bit, dtype=np.int64)))
            hits = running[offsets[1:]] - running[offsets[:-1]]
            out[:, i] = (hits / np.maximum(n, 1) - self.false_rate[i]) / max(1e-9, 1 - self.false_rate[i])
        return n, np.clip(out, 0, 1)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Filters:
    """Filters from the rows of `docs` that have a language and are not held out."""
    known = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Filters([], [])
    bound = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(min(1.0, sample / n) * (1 << 30)))) for k, n in counts.items()])
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) <= bound).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _chunks(batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                grams, n = np.unique(ngrams([t for t, x in zip(texts, langs, strict=True) if x == lang])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    used = chosen.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rated = used.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("lang"))).filter(F.col("rate") >= MIN_RATE)
    often = rated.withColumn("most", F.max("rate").over(Window.partitionBy("gram"))).filter(F.col("rate") >= MIN_SHARE * F.col("most"))
    table = often.select("lang", "gram").toArrow()  # at most 1 / MIN_RATE rows a language
    langs, grams = np.array(table["lang"].to_pylist(), object), table["gram"].to_numpy().view(np.uint64)
    languages = sorted(counts)
    return Filters(languages, [np.sort(grams[langs == x]) for x in languages])


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """`docs` with lang_pred and score (the share of a text's n-grams that its language holds)."""
    kept = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(filters))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = cloudpickle.loads(shared.value)
        names = np.array([*f.languages, UNKNOWN], object)
        for batch, texts in _chunks(batches):
            best, value = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            if f.languages:
                n, shares = f.shares(texts)
                best = np.where(n > 0, shares.argmax(1), best)
                value = np.where(n > 0, shares.max(1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best].tolist(), pa.string()), pa.array(value)], [*batch.schema.names, "lang_pred", "score"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(score, f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled rows that are not held out, predict all."""
    return predict(docs, fit(docs))
