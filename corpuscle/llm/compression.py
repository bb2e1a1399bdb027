"""Quality by compression: a text is like the good or the bad examples as the dictionary of either packs it better.

Two zstandard dictionaries are trained on pieces of good and of bad labelled texts. A text is compressed in pieces of
`PIECE` bytes, all of them, with both; the difference of the two sizes over their sum is what a logistic curve turns
into a score. How far a text packs at all shifts the curve (its share and the square of it): a text that repeats itself packs to
next to nothing with either dictionary, which their difference alone cannot show. The curve is fitted on labelled texts
that no dictionary has seen. Fitting takes up to `PER_CLASS` documents of either
label, chosen by a hash of the id, and of those that feed a dictionary a window of `WINDOW` characters at a hashed place; it
happens on the driver within that bound. Scoring is one pass over the texts without a shuffle.

Defined cases: a null text scores as an empty one, whose difference is zero; labels other than 0 and 1, null ids and
ids with two labels are not learned from; where one label has no document all texts score the share of good labels (or
0.5 without any); repeated rows are scored one by one; other columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.operators.ordering import top_k

PER_CLASS = 2000
WINDOW = 2000
DICTIONARY = 96 * 1024
PIECE = 2048
LEVEL = 3


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


class Classifier:
    """Dictionaries of the good and the bad, and the curve that turns a difference into a score."""

    def __init__(self, good: bytes, bad: bytes, level: float = 0.0):
        self.good, self.bad, self.level, self.slopes = good, bad, level, np.zeros(3)

    def _packers(self) -> list:
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0
        )
        out = []
        for content in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(compression_params=params)
            out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)
        return out

    def signals(self, texts: list[bytes]) -> np.ndarray:
        """Per text (bad size - good size) / both (positive is good), the packed share of its bytes, and its square."""
        out = np.zeros((len(texts), 3))
        if not (self.good and self.bad):
            return out
        good, bad = self._packers()
        for i, text in enumerate(texts):
            pieces = [text[k : k + PIECE] for k in range(0, len(text), PIECE)]
            a, b = sum(len(good(p)) for p in pieces), sum(len(bad(p)) for p in pieces)
            share = (a + b) / (2 * max(1, len(text)))
            out[i] = (b - a) / max(1, a + b), share, share * share
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.level + self.signals(texts) @ self.slopes, -30, 30)))

    def calibrate(self, signals: np.ndarray, labels: np.ndarray) -> None:
        """Logistic fit by Newton steps, with a small pull to zero so that separable labels stay finite."""
        middle, scale = signals.mean(0), np.maximum(signals.std(0), 1e-6)
        x = np.column_stack((np.ones(len(labels)), (signals - middle) / scale))
        pull = np.array([1e-6, 1e-1, 1e-1, 1e-1])
        w = np.zeros(4)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
            w += np.linalg.solve(hessian, x.T @ (labels - p) - pull * w)
        self.slopes = w[1:] / scale
        self.level = float(w[0] - middle @ self.slopes)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Classifier:
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    single = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
    single = single.filter(F.col("quality") == F.col("_most")).select("doc_id", "quality", F.xxhash64(F.lit(9), "doc_id").alias("turn"))
    chosen = F.broadcast(top_k(single, ["quality"], [F.col("turn"), F.col("doc_id")], per_class, "place"))  # two times per_class rows
    found = docs.select("doc_id", "text").join(chosen, "doc_id").filter(F.col("text").isNotNull())
    start = F.pmod("turn", F.greatest(F.lit(1), F.length("text") - WINDOW)) + 1
    teach = found.filter(F.col("place") % 2 == 0).select("quality", "turn", F.substring("text", start, F.lit(WINDOW)).alias("piece")).collect()
    by_label = {k: [r["piece"].encode() for r in sorted(teach, key=lambda r: (r["turn"], r["piece"])) if r["quality"] == k] for k in (0, 1)}
    share = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).agg(F.avg("quality")).first()[0]
    prior = float(np.clip(0.5 if share is None else share, 0.001, 0.999))
    out = Classifier(*[_dictionary(by_label[k]) for k in (1, 0)], level=float(np.log(prior / (1 - prior))))
    check = score(found.filter(F.col("place") % 2 == 1).select("quality", "text"), out, raw=True).select("quality", "score").collect()
    if out.good and out.bad and len({r["quality"] for r in check}) == 2:
        labels_of, signals = (np.array([r[c] for r in check], float) for c in ("quality", "score"))
        # The sample holds both labels in shares of its own; the level moves back to the shares of all labels.
        out.calibrate(signals, labels_of)
        seen = labels_of.mean()
        out.level += float(np.log(prior / (1 - prior)) - np.log(seen / (1 - seen)))
    return out


def _dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary; too few pieces to train on serve as they are."""
    size = min(DICTIONARY, sum(map(len, pieces)) // 4)
    try:
        return zstandard.train_dictionary(size, pieces, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(pieces)[:DICTIONARY]


def score(docs: DataFrame, classifier: Classifier, raw: bool = False) -> DataFrame:
    """`docs` with `score`; with `raw` the signals behind it instead."""
    kept = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(classifier))

    kind = pa.list_(pa.float64()) if raw else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cloudpickle.loads(shared.value)
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text")]
            values = own.signals(texts).tolist() if raw else own.scores(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, kind)], [*batch.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, score {'array<double>' if raw else 'double'}")
