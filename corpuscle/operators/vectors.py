"""Exact and approximate vector top-k.

Similarities are dense matrix products, which SQL expressions cannot do at speed,
so each task multiplies Arrow batches with numpy and keeps its k best rows per
query. No pair of rows ever leaves a task except those k.

Few queries are broadcast and the chunks stay where they are. More are cut into blocks, as the
chunks are, and every pair of blocks meets in a task (`paired_topk`): its memory is that of two blocks and k rows per query of one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.config import DEFAULTS, Settings
from corpuscle.operators.ordering import top_k

# Similarities are rounded before ranking, so that equal vectors tie whatever the
# batch they were multiplied in; ties go to the lower id.
SIMILARITY_DIGITS = 9
_QUERIES_PER_PRODUCT = 512
# Bytes that a result row of the broadcast search takes in a task while lists are merged.
_ROW_BYTES = 200
# Bytes of the vectors in a block of queries and in one of chunks, and the queries below which a block is not cut for more tasks.
_QUERY_BLOCK = 16 << 20
_CHUNK_BLOCK = 32 << 20
_LEAST_QUERIES = 2048
# Queries and chunks of one product, and the candidates a query may have before they are ranked.
_TILE = 1024
_PIECE = 4096
_WAITING = 48
# The approximate search chooses its radius so that a sample of so many queries and chunks reaches this recall.
RECALL = 0.92
_SAMPLE_QUERIES = 256
_SAMPLE_CHUNKS = 20000


def _best_rows(k: int, digits: int, radius: int | None):
    """Kernel: the k best (query, id, similarity) rows of one block pair.

    The parts are closures, which travel to the tasks by value.
    """

    def sortable(ids):
        values = ids.to_numpy()
        return values.astype(str) if values.dtype == object else values

    def matrix(vectors):
        import numpy as np

        m = np.vstack(vectors.to_numpy()).astype("float64")
        norms = np.linalg.norm(m, axis=1)
        return m, norms

    def keep_best(q, ids, sims):
        import numpy as np

        order = np.lexsort((ids, -sims, q))
        q, ids, sims = q[order], ids[order], sims[order]
        starts = np.r_[0, np.flatnonzero(np.diff(q)) + 1] if len(q) else np.array([], dtype=int)
        lengths = np.diff(np.r_[starts, len(q)])
        position = np.arange(len(q)) - np.repeat(starts, lengths)
        mask = position < k
        return q[mask], ids[mask], sims[mask]

    def best_of(queries, q_rows, ids, m):
        import numpy as np

        found = []
        for start in range(0, len(q_rows), _QUERIES_PER_PRODUCT):
            rows = q_rows[start : start + _QUERIES_PER_PRODUCT]
            sims = np.round(queries[rows] @ m.T, digits)
            floor = np.partition(sims, -k, axis=1)[:, -k] if sims.shape[1] > k else np.full(len(rows), -np.inf)
            at, cols = np.nonzero(sims >= floor[:, None])
            found.append((rows[at], ids[cols], sims[at, cols]))
        return found

    def score(queries, q_cells, ids, vectors, cells):
        import numpy as np

        m, norms = matrix(vectors)
        usable = norms > 0
        m, ids = m[usable] / norms[usable, None], ids[usable]
        if radius is None:
            found = best_of(queries, np.arange(len(queries)), ids, m)
        else:
            # Only the queries that probe a cell are multiplied with its chunks.
            cells, found = cells[usable], []
            for cell in np.unique(cells):
                asking = np.flatnonzero(np.bitwise_count(q_cells ^ cell) <= radius)
                own = cells == cell
                found += best_of(queries, asking, ids[own], m[own])
        if not found:
            return np.array([], dtype="int64"), ids[:0], np.array([])
        return keep_best(*(np.concatenate(part) for part in zip(*found)))

    return matrix, sortable, keep_best, score


def vector_topk(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = DEFAULTS.retrieval_k,
    keys: tuple[str, ...] = ("qid",),
    query_vector: str = "vec",
    id_col: str = "id",
    vector: str = "embedding",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Per query the k chunks of highest cosine similarity: keys, id, similarity, rank.

    Rows without a vector, or with a zero one, have no similarity and are left out.
    """
    return _topk(queries, chunks, k, keys, query_vector, id_col, vector, settings, None, None)


def _topk(queries, chunks, k, keys, query_vector, id_col, vector, settings, cell, radius):
    keys = list(keys)
    # A cell column has the same name on both sides; the exact search has none.
    cell_cols = [cell] if cell else []
    q = queries.filter(F.col(query_vector).isNotNull()).select(
        *keys, F.col(query_vector).alias("_qv"), *cell_cols
    )
    c = chunks.filter(F.col(vector).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(vector).alias("_cv"), *cell_cols
    )
    out = T.StructType(
        [queries.schema[key] for key in keys]
        + [
            T.StructField(id_col, chunks.schema[id_col].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    # The queries and what a task keeps for them must fit the bound; else blocks of both sides meet.
    size = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_qv")).alias("length")).first()
    length = size["length"] or 1
    if size["n"] * (8 * length + _ROW_BYTES * k) <= settings.broadcast_max_bytes:
        best = _scan_with_shared_queries(q.toPandas(), c, k, keys, id_col, out, cell, radius)
    else:
        probes = None if cell is None else lambda own, numbers: lambda rows: _near_cells(own, numbers, radius, rows)
        best = paired_topk(q, c, k, keys, id_col, out, size["n"], c.count(), length, cell, cell, probes)
    return top_k(best, keys, [F.desc("similarity"), F.asc(id_col)], k)


def _near_cells(own, numbers, radius, rows):
    import numpy as np

    return np.bitwise_count(own.to_numpy().astype("int64")[rows, None] ^ numbers[None, :]) <= radius


def _block_search(k: int, digits: int):
    """Kernel: the k best chunks of every query of a block pair.

    A product in single precision finds the candidates, with a margin above its error; their similarities are
    then taken in double precision, so the result is that of the exact product. The parts are closures, as above.
    """

    def matrix(column):
        """(vectors, lengths, rows) of the rows that have a direction."""
        import numpy as np

        column = column.combine_chunks()
        m = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
        norms = np.sqrt(np.einsum("ij,ij->i", m, m, dtype="float64"))
        usable = np.flatnonzero(norms > 0)
        return (m, norms, usable) if len(usable) == len(m) else (m[usable], norms[usable], usable)

    def unit(m, norms):
        import numpy as np

        out = np.empty(m.shape, "float32")
        for a in range(0, len(m), 1 << 14):
            out[a : a + (1 << 14)] = m[a : a + (1 << 14)] / norms[a : a + (1 << 14), None]
        return out

    def without_copies(m, numbers, rank):
        """The rows without those that k equal vectors of lower rank precede."""
        import numpy as np

        words = np.ascontiguousarray(m).view("uint32").reshape(len(m), -1)
        mixed = numbers.astype("uint64")
        for j in range(words.shape[1]):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + words[:, j]
            mixed ^= mixed >> np.uint64(29)
        order = np.lexsort((rank, mixed))
        fresh = np.ones(len(m), bool)
        alike = np.flatnonzero(mixed[order][1:] == mixed[order][:-1])
        same = (words[order[alike]] == words[order[alike + 1]]).all(1) & (numbers[order[alike]] == numbers[order[alike + 1]])
        fresh[alike[same] + 1] = False
        begins = np.flatnonzero(fresh)
        place = np.arange(len(m)) - np.repeat(begins, np.diff(np.append(begins, len(m))))
        return np.sort(order[place < k])

    def exact(queries, q_norms, chunks, c_norms, q, c):
        import numpy as np

        out = np.empty(len(q))
        for a in range(0, len(q), 1 << 14):
            x, y = q[a : a + (1 << 14)], c[a : a + (1 << 14)]
            product = np.einsum("ij,ij->i", queries[x].astype("float64"), chunks[y].astype("float64"))
            out[a : a + (1 << 14)] = product / (q_norms[x] * c_norms[y])
        return np.round(out, digits)

    def pieces(borders, mask):
        """(from, to, asking rows or None for all) over the segments, runs of those that all rows ask for as one."""
        import numpy as np

        every, some = mask.all(0), mask.any(0)
        at, last = 0, len(borders) - 1
        while at < last:
            until = at + 1
            if every[at]:
                while until < last and every[until]:
                    until += 1
            if some[at]:
                who = None if every[at] else np.flatnonzero(mask[:, at])
                for low in range(borders[at], borders[until], _PIECE):
                    yield low, min(low + _PIECE, borders[until]), who
            at = until

    def search(queries, q_norms, chunks, c_norms, rank, borders, asked):
        """Per tile of queries: (query row, chunk row, similarity). `chunks` stand by segment, `asked` tells a tile's segments."""
        import numpy as np

        margin = 2 * (queries.shape[1] + 8) * 2.0**-23
        c32 = unit(chunks, c_norms)
        for start in range(0, len(queries), _TILE):
            own, own_norms = queries[start : start + _TILE], q_norms[start : start + _TILE]
            x, n = unit(own, own_norms), len(own)
            mask = np.ones((n, len(borders) - 1), bool) if asked is None else asked(slice(start, start + _TILE))
            floor = np.full(n, -np.inf)
            held = np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)
            waiting, wait = [], 0

            def merge():
                q, c = (np.concatenate(p) for p in zip(*waiting, strict=True))
                sims = exact(own, own_norms, chunks, c_norms, q, c)
                near = sims >= floor[q]
                q, c, sims = (np.concatenate((h, p[near])) for h, p in zip(held, (q, c, sims), strict=True))
                order = np.lexsort((rank[c], -sims, q))
                q, c, sims = q[order], c[order], sims[order]
                first = np.searchsorted(q, np.arange(n))
                place = np.arange(len(q)) - first[q]
                last = place == k - 1
                floor[q[last]] = sims[last]
                best = place < k
                return q[best], c[best], sims[best]

            for low, high, who in pieces(borders, mask):
                part = x if who is None else x[who]
                sims = part @ c32[low:high].T
                least = (floor if who is None else floor[who]) - margin
                fresh = np.flatnonzero(least == -np.inf)
                if len(fresh) and high - low > k:
                    least[fresh] = np.partition(sims[fresh], -k, axis=1)[:, -k] - margin
                hits = np.flatnonzero(sims >= least.astype("float32")[:, None])
                if not len(hits):
                    continue
                q, c = np.divmod(hits, high - low)
                waiting.append((q if who is None else who[q], c + low))
                wait += len(hits)
                if wait > _WAITING * n or 4 * len(fresh) > n:
                    held = merge()
                    waiting, wait = [], 0
            if waiting:
                held = merge()
            yield held[0] + start, held[1], held[2]

    return matrix, without_copies, search


def paired_topk(queries, chunks, k, keys, id_col, out, n_queries, n_chunks, length, segment=None, extra=None, probes=None):
    """The k best chunks per query of every block pair; blocks are dealt by hash, so that equal keys, lists or cells do not meet in one.

    `queries` has the keys, `_qv` and `extra`; `chunks` has `_id`, `_cv` and `segment`. With `probes`, a query is compared only with the
    segments it asks for: probes(extra column, segment numbers) gives a function from a slice of queries to (query, segment) marks.
    """
    spark = queries.sparkSession
    rows = lambda block: max(1, block // (4 * length))
    chunk_blocks = max(1, math.ceil(n_chunks / rows(_CHUNK_BLOCK)))
    spread = min(math.ceil(2 * spark.sparkContext.defaultParallelism / chunk_blocks), math.ceil(n_queries / _LEAST_QUERIES))
    query_blocks = max(1, math.ceil(n_queries / rows(_QUERY_BLOCK)), spread)
    pairs = query_blocks * chunk_blocks
    matrix, without_copies, search = _block_search(k, SIMILARITY_DIGITS)
    schema = out

    def meet(left, right):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        q, q_norms, q_rows = matrix(left.column("_qv"))
        c, c_norms, c_rows = matrix(right.column("_cv"))
        if not len(q) or not len(c):
            return pa.table({f.name: pa.array([], left.schema.field(f.name).type if f.name in keys else None) for f in schema.fields[: len(keys)]}
                            | {id_col: pa.array([], right.schema.field("_id").type), "similarity": pa.array([], pa.float64())})
        ids = right.column("_id").combine_chunks().take(pa.array(c_rows))
        rank = np.empty(len(ids), "int64")
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        numbers = right.column(segment).to_numpy().astype("int64")[c_rows] if segment else np.zeros(len(ids), "int64")
        kept = without_copies(c, numbers, rank)
        kept = kept[np.argsort(numbers[kept], kind="stable")]
        c, c_norms, rank, numbers, ids = c[kept], c_norms[kept], rank[kept], numbers[kept], ids.take(pa.array(kept))
        begins = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
        asked = probes(left.column(extra).combine_chunks().take(pa.array(q_rows)), numbers[begins]) if probes else None
        found = list(search(q, q_norms, c, c_norms, rank, np.append(begins, len(c)).tolist(), asked))
        q_at, c_at, sims = (np.concatenate(p) for p in zip(*found, strict=True))
        at = pa.array(q_rows[q_at])
        return pa.table({key: left.column(key).combine_chunks().take(at) for key in keys} | {id_col: ids.take(pa.array(c_at)), "similarity": pa.array(sims)})

    def dealt(df, own, n_own, other, n_other, by):
        copies = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)
        return df.select("*", F.pmod(F.xxhash64(*by), F.lit(n_own)).cast("int").alias(own)).select("*", copies).repartition(pairs, "_qb", "_cb")

    left = dealt(queries, "_qb", query_blocks, "_cb", chunk_blocks, [*keys, "_qv"])
    right = dealt(chunks, "_cb", chunk_blocks, "_qb", query_blocks, ["_id", "_cv"])
    return left.groupBy("_qb", "_cb").cogroup(right.groupBy("_qb", "_cb")).applyInArrow(meet, out)


def _scan_with_shared_queries(head, chunks, k, keys, id_col, out, cell, radius):
    """Every task scans its chunks once against all queries of the block."""
    import numpy as np

    matrix, sortable, keep_best, score = _best_rows(k, SIMILARITY_DIGITS, radius)
    spark = chunks.sparkSession
    if len(head):
        m, norms = matrix(head["_qv"])
        head, m = head[norms > 0], m[norms > 0] / norms[norms > 0, None]
    else:
        m = np.zeros((0, 1))
    cells = head[cell].to_numpy().astype("int64") if cell else None
    shared = spark.sparkContext.broadcast((m, cells, head[keys].reset_index(drop=True)))
    def scan(batches):
        import numpy as np

        queries, q_cells, labels = shared.value
        best = None
        for pdf in batches:
            if not len(pdf) or not len(queries):
                continue
            c_cells = pdf[cell].to_numpy().astype("int64") if cell else None
            part = score(queries, q_cells, sortable(pdf["_id"]), pdf["_cv"], c_cells)
            best = part if best is None else keep_best(*(np.concatenate(p) for p in zip(best, part)))
        if best is not None:
            rows, ids, sims = best
            frame = labels.iloc[rows].reset_index(drop=True)
            frame[id_col], frame["similarity"] = ids, sims
            yield frame

    return chunks.mapInPandas(scan, out)


# --- approximate search ---------------------------------------------------------------------


def with_cell(df: DataFrame, vector: str, bits: int = 8, seed: int = 7, name: str = "cell") -> DataFrame:
    """Add the sign pattern of `bits` fixed random projections: near vectors share most bits."""

    @F.pandas_udf("int")
    def cell(vectors):
        import numpy as np
        import pandas as pd

        if not len(vectors):
            return pd.Series([], dtype="int32")
        m = np.vstack(vectors.to_numpy()).astype("float64")
        planes = np.random.default_rng(seed).standard_normal((m.shape[1], bits))
        return pd.Series(((m @ planes) > 0) @ (1 << np.arange(bits)), dtype="int32")

    return df.filter(F.col(vector).isNotNull()).withColumn(name, cell(vector))


def write_ann_index(chunks: DataFrame, path: str, vector: str = "embedding", bits: int = 8, seed: int = 7) -> None:
    """Store the chunks by cell, so that a search reads only the cells it probes.

    A cell is written by a few tasks, so it has a few files however many tasks made its chunks; `cell_bits` gives the
    number of bits for a number of chunks.
    """
    placed = with_cell(chunks, vector, bits, seed)
    spread = placed.withColumn("_part", F.pmod(F.xxhash64(*[c for c in ("id",) if c in chunks.columns], F.lit(seed)), F.lit(4)))
    spread.repartition("cell", "_part").drop("_part").write.mode("overwrite").partitionBy("cell").parquet(path)


def cell_bits(chunks: int, per_cell: int = 20000) -> int:
    """Bits of a cell so that a cell holds about `per_cell` chunks, 4 to 16."""
    return min(16, max(4, math.ceil(math.log2(max(1, chunks / per_cell)))))


def recall_radius(q: DataFrame, indexed: DataFrame, k: int, query_vector: str, id_col: str, vector: str, bits: int) -> int:
    """The smallest radius at which a sample of the queries finds `RECALL` of its nearest chunks.

    Of a share of the chunks as large a share of k is asked for, one at least: those lie as far away as the k nearest of all, or
    farther, which errs towards the wider radius. Up to `_SAMPLE_CHUNKS` chunks the sample is the whole.
    """
    import numpy as np

    n = indexed.count()
    some = indexed if n <= _SAMPLE_CHUNKS else indexed.filter(F.pmod(F.xxhash64(id_col), F.lit(math.ceil(n / _SAMPLE_CHUNKS))) == 0)
    asked = q.select(F.col(query_vector).alias("v"), "cell").orderBy(F.xxhash64(query_vector)).limit(_SAMPLE_QUERIES).toPandas()
    found = some.select(F.col(vector).alias("v"), "cell").toPandas()  # some _SAMPLE_CHUNKS rows
    if not len(asked) or not len(found):
        return bits
    a, b = (np.vstack(x["v"].to_numpy()).astype("float64") for x in (asked, found))
    sizes_a, sizes_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    used_a, used_b = sizes_a > 0, sizes_b > 0
    if not used_a.any() or not used_b.any():
        return bits
    sims = (a[used_a] / sizes_a[used_a, None]) @ (b[used_b] / sizes_b[used_b, None]).T
    near = min(sims.shape[1], math.ceil(k * len(found) / n))
    top = np.argpartition(-sims, near - 1, axis=1)[:, :near]
    cells_a, cells_b = (x["cell"].to_numpy().astype("int64")[used] for x, used in ((asked, used_a), (found, used_b)))
    apart = np.bitwise_count(cells_a[:, None] ^ cells_b[top])
    return next(r for r in range(bits + 1) if r == bits or (apart <= r).mean() >= RECALL)


def cells_within(probed: list[int], bits: int, radius: int) -> list[int]:
    """All cells that differ from one of the probed in at most `radius` bits."""
    import numpy as np

    reached = np.zeros(1 << bits, bool)
    reached[probed] = True
    at = np.arange(1 << bits)
    for _ in range(min(radius, bits)):
        reached = np.logical_or.reduce([reached, *(reached[at ^ (1 << b)] for b in range(bits))])
    return np.flatnonzero(reached).tolist()


def vector_topk_ann(
    queries: DataFrame,
    indexed: DataFrame,
    k: int = DEFAULTS.retrieval_k,
    keys: tuple[str, ...] = ("qid",),
    query_vector: str = "vec",
    id_col: str = "id",
    vector: str = "embedding",
    bits: int = 8,
    radius: int | None = None,
    seed: int = 7,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Top-k among the chunks whose cell differs from the query's in at most `radius` bits.

    Similarities are exact; only the candidates are approximate. Without a radius `recall_radius` measures the one that the
    vectors need: where they have no near neighbours, most cells are read.
    """
    q = with_cell(queries, query_vector, bits, seed)
    probed = [r[0] for r in q.select("cell").distinct().collect()]  # at most 2 ** bits rows
    if radius is None:
        radius = recall_radius(q, indexed, k, query_vector, id_col, vector, bits)
    cells = cells_within(probed, bits, radius)
    near = indexed.filter(F.col("cell").isin(cells))
    return _topk(q, near, k, keys, query_vector, id_col, vector, settings, "cell", radius)
