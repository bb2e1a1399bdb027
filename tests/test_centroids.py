import dataclasses

import numpy as np
import pytest

from corpuscle.config import Settings, scratch_path
from corpuscle.operators.centroids import assigned, fit_centroids, list_count, read_lists, search_lists, write_lists
from corpuscle.operators.vectors import vector_topk

SMALL = Settings(embedding_dimensions=32)


def frames(spark, vectors, nq):
    chunks = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, embedding array<float>")
    queries = chunks.limit(nq).selectExpr("concat('q', id) AS qid", "embedding AS vec")
    return chunks, queries


def clustered(n=4000, clusters=40, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, 32))
    return centres[rng.integers(0, clusters, n)] + 0.35 * rng.standard_normal((n, 32))


@pytest.fixture(scope="module")
def near(spark):
    """Clustered vectors, their index, and the exact result."""
    chunks, queries = frames(spark, clustered(), 150)
    path = scratch_path(spark, "lists")
    write_lists(chunks, path)
    exact = {(r.qid, r.id): (r["rank"], round(r.similarity, 7)) for r in vector_topk(queries, chunks, 40, settings=SMALL).collect()}
    return chunks, queries, path, exact


def test_every_chunk_is_in_the_list_of_its_nearest_centroid(spark):
    vectors = clustered(500)
    chunks, _ = frames(spark, vectors, 1)
    centroids = fit_centroids(chunks, lists=12, sample=200)
    got = {r.id: (r.list, r.angle) for r in assigned(chunks, centroids).collect()}
    unit = vectors.astype("float32").astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosines = unit @ centroids.T
    assert [got[i][0] for i in range(500)] == cosines.argmax(axis=1).tolist()
    assert np.allclose([got[i][1] for i in range(500)], np.arccos(cosines.max(axis=1)), atol=1e-6)


def test_recall_at_a_fraction_of_the_rows(near):
    chunks, queries, path, exact = near
    found = search_lists(queries, path, chunks.schema, 40, settings=SMALL).collect()
    hits = sum((r.qid, r.id) in exact for r in found)
    assert len(found) == len(exact) and hits / len(exact) >= 0.9
    read = {r.qid: r.n_read for r in found}
    assert sum(read.values()) < 0.3 * len(read) * 4000


@pytest.mark.parametrize("settings", [SMALL, dataclasses.replace(SMALL, broadcast_max_bytes=8 * 100 * 60)])
def test_exact_bound_loses_nothing(near, settings):
    chunks, queries, path, exact = near
    got = {(r.qid, r.id): (r["rank"], round(r.similarity, 7)) for r in search_lists(queries, path, chunks.schema, 40, exact=True, settings=settings).collect()}
    assert got == exact


def test_vectors_without_neighbours(spark):
    """No structure to find: the exact bound reads all, the likely one still reaches the recall."""
    chunks, queries = frames(spark, np.random.default_rng(3).standard_normal((1500, 32)), 60)
    path = scratch_path(spark, "lists")
    write_lists(chunks, path)
    exact = {(r.qid, r.id) for r in vector_topk(queries, chunks, 40, settings=SMALL).collect()}
    assert {(r.qid, r.id) for r in search_lists(queries, path, chunks.schema, 40, exact=True, settings=SMALL).collect()} == exact
    found = {(r.qid, r.id) for r in search_lists(queries, path, chunks.schema, 40, settings=SMALL).collect()}
    assert len(found & exact) / len(exact) >= 0.9


def test_hot_vector_few_chunks_and_none(spark):
    """A third of the chunks are one vector; ties go by id. Chunks without a direction are in no list."""
    rows = [(i, [1.0, 0.0] if i % 3 == 0 else [0.5, float(i)]) for i in range(90)] + [(90, None), (91, [0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("none", None), ("zero", [0.0, 0.0])], "qid string, vec array<float>")
    path = scratch_path(spark, "lists")
    write_lists(chunks, path, lists=5)
    assert read_lists(spark, path).sizes.sum() == 90
    got = search_lists(queries, path, chunks.schema, 10, exact=True).orderBy("rank").collect()
    assert [(r.qid, r.id) for r in got] == [("q", i) for i in range(0, 30, 3)]
    assert search_lists(queries, path, chunks.schema, 1000, exact=True).count() == 90
    empty = scratch_path(spark, "lists")
    write_lists(chunks.filter("id = 91"), empty)
    assert search_lists(queries, empty, chunks.schema, 10).count() == 0


def test_list_count():
    assert [list_count(n) for n in (0, 1, 100, 10**9)] == [1, 1, 10, 4096]


def test_queries_are_not_taken_block_by_block(near):
    """A bound that few queries fit leaves one plan, not one per block of queries."""
    chunks, queries, path, exact = near
    found = search_lists(queries, path, chunks.schema, 40, exact=True, settings=dataclasses.replace(SMALL, broadcast_max_bytes=1000))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Union") == 1
    assert {(r.qid, r.id) for r in found.collect()} == set(exact)
