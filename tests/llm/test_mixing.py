import random
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from catalog.compare import rows_of
from corpuscle.llm import mixing, queries
from corpuscle.llm.mixing import _draw

SCHEMA = "doc_id bigint, text string, source string, copy string"


def corpus(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rnd.randint(0, 40))), rnd.choice(["hot"] * 6 + ["b", "ä", None]), "x") for i in range(n)]
    return spark.createDataFrame(rows + rows[:3] + [(None, "a b", "b", "x"), (n, None, "b", "x")], SCHEMA)


def test_targets_and_sizes(spark):
    out = mixing.words_taken(corpus(spark)).collect()
    by_source = {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_source.setdefault((r["source_size"], r["target"]), []).append(r)
    assert abs(sum(t for _, t in by_source) - 1.5 * sum(s for s, _ in by_source)) < 1e-6
    for (size, target), rows in by_source.items():
        assert target <= 2 * size and sum(r["size"] for r in rows) == size
        assert abs(sum(r["taken"] for r in rows) - target) <= 41
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.words_taken(corpus(spark)).collect()), key=str)


def test_mix_has_the_rows_that_are_taken(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DOCS_PER_BLOCK", 16)
    docs = corpus(spark)
    taken = {r["doc_id"]: r["taken"] // max(1, r["size"]) for r in mixing.words_taken(docs).collect() if r["size"]}
    mixed = mixing.mix(docs).collect()
    counts = Counter((r["doc_id"], r["text"]) for r in mixed if r["text"])
    repeated = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert {d: n // repeated[d, t] for (d, t), n in counts.items()} == {d: n for d, n in taken.items() if n}
    assert {r["shard"] for r in mixed} == set(range(8))
    # A source's blocks spread over the shards: none takes all of the largest source.
    hot = Counter(r["shard"] for r in mixed if r["source"] == "hot")
    assert max(hot.values()) < 0.5 * sum(hot.values())
    assert set(mixing.mix(docs).columns) == {"doc_id", "text", "source", "copy", "shard", "shuffle_key"}


@pytest.mark.parametrize("total, hits, drawn", [(20, 7, 9), (5, 5, 2), (30, 0, 3), (30, 30, 30), (1000, 400, 10)])
def test_draws_follow_the_hypergeometric_distribution(spark, total, hits, drawn):
    grid = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    picks = Counter(r[0] for r in grid.select(F.expr(_draw(f"{total}L", f"{hits}L", f"{drawn}L", "u"))).collect())
    for k in range(drawn + 1):
        want = comb(hits, k) * comb(total - hits, drawn - k) / comb(total, drawn) if k <= hits else 0
        assert abs(picks[k] / 4000 - want) < 2e-3


def test_quotas_are_split_exactly(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 7), (None, 50)], "source string, draws bigint")
    for shards in (1, 5, 8):
        rows = mixing.split_quotas(quotas, shards, 3).collect()
        per_source = Counter()
        per_shard = Counter()
        for r in rows:
            per_source[r["source"]] += r["beyond"] - r["first"]
            per_shard[r["shard"]] += r["beyond"] - r["first"]
        assert per_source == {"a": 1000, "b": 7, None: 50}
        assert max(per_shard.values()) - min(per_shard.values()) <= 2


def test_empty(spark):
    none = corpus(spark).limit(0)
    assert mixing.words_taken(none).count() == 0 and mixing.mix(none).count() == 0


def test_against_sql(spark):
    from catalog.compare import connect

    sf = "/root/testdata/sf0.001"
    for name in ("op2_quality_rules", "op4_mixing"):
        df = queries.QUERIES[name](spark, sf)
        cur = connect(sf).execute(queries.ORACLE[name])
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())
