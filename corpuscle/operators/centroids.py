"""Vector search through an index of k-means lists.

Every chunk is stored in the list of its nearest centroid, with the angle between the two. A search takes all queries in two rounds:
first the nearest lists of each query, until they hold a few times k chunks; the k-th similarity found then rules out
every other list whose chunks cannot come close enough, and only the rest is compared. In both, blocks of queries meet blocks of chunks. Centroids are fitted on a bounded sample,
but every chunk is in the index, and similarities are exact.

Two bounds are offered. The exact one follows from the triangle inequality: a chunk is no nearer to the query than the difference of
their angles to the centroid, so nothing is lost. The likely one takes the part of a chunk that its centroid does not explain
(its residual) to lie in a random direction, as it does in many dimensions, and allows for `slack` standard deviations of the best chunk.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.config import DEFAULTS, Settings, materialize
from corpuscle.operators.ordering import top_k
from corpuscle.operators.vectors import paired_topk

SAMPLE_ROWS = 100_000
MOST_LISTS = 4096
# The first lists of a query hold so many times k chunks.
FIRST_SHARE = 2
SLACK = -1.0
# Rounding of cosines and angles, so that a bound never cuts off an equal chunk.
_EPSILON = 1e-7


@dataclass(frozen=True)
class Lists:
    """Centroids (unit length) with the size of each list, its mean and its largest angle."""

    centroids: np.ndarray
    sizes: np.ndarray
    mean_angle: np.ndarray
    max_angle: np.ndarray

    def probes(self, cosines: np.ndarray, worst: np.ndarray, exact: bool, slack: float) -> np.ndarray:
        """Per query and list, whether it may hold a chunk better than the query's `worst` similarity."""
        angles = np.arccos(cosines)
        if exact:
            return np.cos(np.maximum(0, angles - self.max_angle)) >= worst[:, None] - _EPSILON
        dimensions = self.centroids.shape[1]
        # The best of n random directions lies about sqrt(2 ln n) deviations out.
        reach = (np.sqrt(2 * np.log(np.maximum(self.sizes, 2))) + slack) / math.sqrt(dimensions)
        likely = cosines * np.cos(self.mean_angle) + np.minimum(reach, 1) * np.sin(angles) * np.sin(self.mean_angle)
        return np.minimum(likely, np.cos(np.maximum(0, angles - self.max_angle))) >= worst[:, None] - _EPSILON

    def nearest(self, cosines: np.ndarray, rows: int) -> np.ndarray:
        """Per query the nearest lists that hold `rows` chunks together."""
        order = np.argsort(-cosines, axis=1, kind="stable")
        held = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        out = np.zeros(cosines.shape, bool)
        np.put_along_axis(out, order, held < rows, axis=1)
        return out


def list_count(chunks: int) -> int:
    """About the square root of the number of chunks, 1 to `MOST_LISTS`."""
    return max(1, min(MOST_LISTS, round(math.sqrt(chunks))))


def fit_centroids(chunks: DataFrame, vector: str = "embedding", lists: int | None = None, sample: int = SAMPLE_ROWS, seed: int = 7) -> np.ndarray:
    """Centroids of up to `sample` chunks, chosen by a hash of their vectors; the fit is a Spark job and only the centroids come here."""
    usable = chunks.filter(F.exists(vector, lambda x: x != 0)).select(F.col(vector).cast("array<double>").alias("v"))
    n = usable.count()
    if not n:
        return np.zeros((0, 1))
    step = math.ceil(n / sample)
    chosen = usable.filter(F.pmod(F.xxhash64("v"), F.lit(step)) == 0) if step > 1 else usable
    vectors = materialize(chosen, "sample").select(array_to_vector("v").alias("features"))
    model = KMeans(k=lists or list_count(n), distanceMeasure="cosine", seed=seed, maxIter=10, initSteps=2).fit(vectors)
    centers = np.array(model.clusterCenters())
    return centers / np.linalg.norm(centers, axis=1, keepdims=True)


def assigned(chunks: DataFrame, centroids: np.ndarray, vector: str = "embedding") -> DataFrame:
    """Chunks that have a direction, with `list` and `angle`."""
    shared = chunks.sparkSession.sparkContext.broadcast(centroids)  # MOST_LISTS rows at most

    @F.pandas_udf("list int, angle double")
    def place(vectors):
        import numpy as np
        import pandas as pd

        if not len(vectors):
            return pd.DataFrame({"list": pd.Series([], dtype="int32"), "angle": pd.Series([], dtype="float64")})
        m = np.vstack(vectors.to_numpy()).astype("float64")
        cosines = (m / np.linalg.norm(m, axis=1, keepdims=True)) @ shared.value.T
        nearest = cosines.argmax(axis=1)
        return pd.DataFrame({"list": nearest.astype("int32"), "angle": np.arccos(np.clip(cosines[np.arange(len(m)), nearest], -1, 1))})

    usable = chunks.filter(F.exists(vector, lambda x: x != 0))
    return usable.withColumn("_place", place(vector)).select(*[c for c in chunks.columns if c not in ("list", "angle")], "_place.list", "_place.angle")


def write_lists(
    chunks: DataFrame, path: str, vector: str = "embedding", id_col: str = "id", lists: int | None = None, sample: int = SAMPLE_ROWS, seed: int = 7
) -> None:
    """Fit, assign and store: chunks under `path`/chunks by list, one row per list under `path`/lists."""
    spark = chunks.sparkSession
    centroids = fit_centroids(chunks, vector, lists, sample, seed)
    # A large list is written by several tasks, each of a share of its ids.
    spread = assigned(chunks, centroids, vector).withColumn("_part", F.pmod(F.xxhash64(id_col), F.lit(4)))
    spread.repartition("list", "_part").drop("_part").write.mode("overwrite").partitionBy("list").parquet(f"{path}/chunks")
    stats = read_chunks(spark, path, chunks.schema).groupBy("list").agg(F.count(F.lit(1)).alias("size"), F.avg("angle").alias("mean"), F.max("angle").alias("most"))
    rows = [(i, json.dumps(c.tolist())) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(rows, "list int, centroid string")
    named.join(stats, "list", "left").fillna(0).write.mode("overwrite").parquet(f"{path}/lists")


def read_chunks(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    fields = [f for f in schema.fields if f.name not in ("list", "angle")]
    return spark.read.schema(T.StructType([*fields, T.StructField("angle", T.DoubleType()), T.StructField("list", T.IntegerType())])).parquet(f"{path}/chunks")


def read_lists(spark: SparkSession, path: str) -> Lists:
    rows = spark.read.parquet(f"{path}/lists").orderBy("list").collect()  # MOST_LISTS at most
    column = lambda name: np.array([r[name] for r in rows], float)
    centroids = np.array([json.loads(r["centroid"]) for r in rows]) if rows else np.zeros((0, 1))
    return Lists(centroids, column("size"), column("mean"), column("most"))


def _marks(own, numbers):
    """Bit rows of the lists a query asks for -> marks of those lists for a slice of queries."""
    import numpy as np

    packed = np.stack([np.frombuffer(x, "uint8") for x in own.to_pylist()])
    return lambda rows: np.unpackbits(packed[rows], axis=1)[:, numbers].astype(bool)


def search_lists(
    queries: DataFrame,
    path: str,
    chunk_schema: T.StructType,
    k: int = DEFAULTS.retrieval_k,
    keys: tuple[str, ...] = ("qid",),
    query_vector: str = "vec",
    id_col: str = "id",
    vector: str = "embedding",
    exact: bool = False,
    slack: float = SLACK,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Per query the k chunks of highest cosine similarity through the index: keys, id, similarity, rank, n_read.

    `n_read` is the number of chunks the query was compared with. With `exact` the result is that of the exact search.
    Nothing but the centroids is broadcast, whatever the bound of `settings`.
    """
    spark = queries.sparkSession
    keys = list(keys)
    lists = read_lists(spark, path)
    chunks = read_chunks(spark, path, chunk_schema).select(F.col(id_col).alias("_id"), F.col(vector).alias("_cv"), "list")
    id_type = chunk_schema[id_col].dataType
    final = T.StructType([
        *[queries.schema[key] for key in keys], T.StructField(id_col, id_type), T.StructField("similarity", T.DoubleType()),
        T.StructField("rank", T.IntegerType()), T.StructField("n_read", T.LongType()),
    ])
    q = queries.filter(F.exists(query_vector, lambda x: x != 0)).select(*keys, F.col(query_vector).alias("_qv"))
    q = materialize(q.withColumn("_row", F.monotonically_increasing_id()), "queries")
    n, n_chunks = q.count(), int(lists.sizes.sum())
    if not n or not n_chunks:
        return spark.createDataFrame([], final)
    shared = spark.sparkContext.broadcast(lists)  # MOST_LISTS rows at most
    out = T.StructType([T.StructField("_row", T.LongType()), T.StructField(id_col, id_type), T.StructField("similarity", T.DoubleType())])
    order = [F.desc("similarity"), F.asc(id_col)]

    def asked(rows: DataFrame, first_round: bool) -> DataFrame:
        """Rows with `_probe`, the lists to compare as bits, and `n_read`, the chunks in them; `_before` are those of the first round."""

        @F.pandas_udf("probe binary, n_read bigint")
        def probe(vectors, worst, before):
            import numpy as np
            import pandas as pd

            own = shared.value
            bits, sizes = [], []
            m = np.vstack(vectors.to_numpy()).astype("float64") if len(vectors) else np.zeros((0, own.centroids.shape[1]))
            for start in range(0, len(m), 1024):
                part = m[start : start + 1024]
                cosines = np.clip(part / np.linalg.norm(part, axis=1, keepdims=True) @ own.centroids.T, -1, 1)
                if first_round:
                    marks = own.nearest(cosines, FIRST_SHARE * k)
                else:
                    done = np.stack([np.frombuffer(x, "uint8") for x in before[start : start + 1024]])
                    done = np.unpackbits(done, axis=1, count=len(own.sizes)).astype(bool)
                    marks = own.probes(cosines, worst.to_numpy()[start : start + 1024], exact, slack) & ~done & (own.sizes > 0)
                bits += [row.tobytes() for row in np.packbits(marks, axis=1)]
                sizes.append((marks @ own.sizes).astype("int64"))
            return pd.DataFrame({"probe": bits, "n_read": np.concatenate(sizes) if sizes else np.zeros(0, "int64")})

        return rows.withColumn("_p", probe("_qv", "_worst", "_before")).select("_row", "_qv", F.col("_p.probe").alias("_probe"), F.col("_p.n_read").alias("n_read"))

    def compared(rows: DataFrame) -> DataFrame:
        probed = rows.select("_row", "_qv", "_probe")
        return paired_topk(probed, chunks, k, ["_row"], id_col, out, n, n_chunks, lists.centroids.shape[1], "list", "_probe", _marks)

    never = F.lit(float("-inf"))
    first = materialize(asked(q.withColumns({"_worst": never, "_before": F.lit(b"")}), True), "probes")
    found = materialize(top_k(compared(first), ["_row"], order, k).drop("rank"), "near")
    reached = found.groupBy("_row").agg(F.count(F.lit(1)).alias("_n"), F.min("similarity").alias("_w"))
    bounded = first.withColumnRenamed("_probe", "_before").join(reached, "_row", "left").withColumn("_worst", F.when(F.col("_n") >= k, F.col("_w")).otherwise(never))
    more = materialize(asked(bounded, False), "probes")
    rest = compared(more.filter("n_read > 0"))
    best = top_k(found.unionByName(rest), ["_row"], order, k)
    read = first.select("_row", "n_read").join(more.select("_row", F.col("n_read").alias("_more")), "_row")
    labels = q.select("_row", *keys).join(read, "_row").select("_row", *keys, (F.col("n_read") + F.col("_more")).alias("n_read"))
    return best.join(labels, "_row").select(*keys, id_col, "similarity", F.col("rank").cast("int").alias("rank"), "n_read")
