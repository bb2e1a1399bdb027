import dataclasses

import numpy as np
import pytest

from corpuscle.config import Settings
from corpuscle.operators import vectors
from corpuscle.operators.vectors import vector_topk, vector_topk_ann, with_cell

SMALL = Settings(embedding_dimensions=8)
# A bound so low that the queries do not fit: both sides are blocked.
BLOCKED = dataclasses.replace(SMALL, broadcast_max_bytes=8 * 8 * 5)


def data(spark, n=200, nq=13, seed=0, ids=int):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((n, 8)).round(1)
    c[50] = c[51]
    q = rng.standard_normal((nq, 8)).round(1)
    chunks = spark.createDataFrame([(ids(i), [float(x) for x in v]) for i, v in enumerate(c)] + [(ids(n), None), (ids(n + 1), [0.0] * 8)],
                                   f"id {'string' if ids is str else 'long'}, embedding array<float>")
    queries = spark.createDataFrame([(f"q{i}", [float(x) for x in v]) for i, v in enumerate(q)], "qid string, vec array<float>")
    return c.astype("float32").astype(float), q.astype("float32").astype(float), chunks, queries


def brute(c, q, k, ids=int):
    out = set()
    for i, v in enumerate(q):
        sims = np.round((c @ v) / np.linalg.norm(c, axis=1) / np.linalg.norm(v), 9)
        order = sorted(range(len(c)), key=lambda j: (-sims[j], ids(j)))[:k]
        out |= {(f"q{i}", ids(j), r, round(float(sims[j]), 7)) for r, j in enumerate(order)}
    return out


@pytest.mark.parametrize("settings", [SMALL, BLOCKED])
@pytest.mark.parametrize("ids", [int, str])
def test_exact(spark, settings, ids):
    c, q, chunks, queries = data(spark, ids=ids)
    got = {(r.qid, r.id, r["rank"], round(r.similarity, 7)) for r in vector_topk(queries, chunks.repartition(3), 10, settings=settings).collect()}
    assert got == brute(c, q, 10, ids)


def test_fewer_rows_than_k(spark):
    c, q, chunks, queries = data(spark, n=60, nq=2)
    assert vector_topk(queries, chunks, 1000, settings=SMALL).count() == 120


def test_no_queries(spark):
    _, _, chunks, queries = data(spark)
    assert vector_topk(queries.filter("false"), chunks, 3, settings=SMALL).count() == 0


def test_hot_source_is_not_dropped(spark):
    """A third of the chunks share one vector: all ties are ranked by id."""
    chunks = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 == 0 else [0.0, float(i)]) for i in range(90)], "id long, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, vec array<float>")
    got = vector_topk(q, chunks.repartition(4), 10, settings=SMALL).orderBy("rank").collect()
    assert [r.id for r in got] == [i for i in range(0, 30, 3)]


@pytest.mark.parametrize("settings", [SMALL, BLOCKED])
def test_approximate(spark, settings):
    c, q, chunks, queries = data(spark, n=400)
    index = with_cell(chunks, "embedding", bits=6)
    exact = {(r.qid, r.id) for r in vector_topk(queries, chunks, 10, settings=settings).collect()}
    near = {(r.qid, r.id) for r in vector_topk_ann(queries, index, 10, bits=6, radius=2, settings=settings).collect()}
    assert len(near & exact) / len(exact) > 0.6
    everything = {(r.qid, r.id) for r in vector_topk_ann(queries, index, 10, bits=6, radius=6, settings=settings).collect()}
    assert everything == exact


@pytest.mark.parametrize("bits", [8, 12])
def test_recall_at_the_registered_k(spark, bits):
    """Vectors without any near neighbours: the radius is chosen so that 0.9 of the 40 nearest are found."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((600, 64)))]
    chunks = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = chunks.limit(100).selectExpr("concat('q', id) AS qid", "embedding AS vec")
    settings = Settings(embedding_dimensions=64)
    exact = {(r.qid, r.id) for r in vector_topk(queries, chunks, 40, settings=settings).collect()}
    found = {(r.qid, r.id) for r in vector_topk_ann(queries, with_cell(chunks, "embedding", bits), 40, bits=bits, settings=settings).collect()}
    assert len(found & exact) / len(exact) >= 0.9
    assert len(found) == len(exact)


def test_queries_beyond_the_bound_meet_in_blocks(spark, monkeypatch):
    """However many queries there are, the plan stays one step over pairs of blocks."""
    c, q, chunks, queries = data(spark, n=200, nq=60)
    monkeypatch.setattr(vectors, "_CHUNK_BLOCK", 4 * 8 * 30)
    monkeypatch.setattr(vectors, "_QUERY_BLOCK", 4 * 8 * 7)
    monkeypatch.setattr(vectors, "_TILE", 4)
    monkeypatch.setattr(vectors, "_PIECE", 16)
    found = vector_topk(queries, chunks, 10, settings=BLOCKED)
    assert {(r.qid, r.id, r["rank"], round(r.similarity, 7)) for r in found.collect()} == brute(c, q, 10)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CoGroup") == 1 and "MapInPandas" not in plan


def test_many_copies_in_blocks(spark):
    """A third of the chunks share one vector: of the copies the lowest ids stay, also where queries go in blocks."""
    chunks = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 == 0 else [0.0, float(i)]) for i in range(900)], "id long, embedding array<float>")
    q = spark.createDataFrame([(f"q{i}", [1.0, 0.0]) for i in range(50)], "qid string, vec array<float>")
    got = vector_topk(q, chunks.repartition(4), 10, settings=BLOCKED).collect()
    assert {(r.qid, r.id, r["rank"]) for r in got} == {(f"q{i}", 3 * r, r) for i in range(50) for r in range(10)}
