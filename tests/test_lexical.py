from corpuscle.config import Settings
from corpuscle.operators import lexical as lx


def test_lexical(spark):
    chunks = spark.createDataFrame([(1, "KV kv 64.10 fish"), (2, "fish pond"), (3, "Índice"), (4, None)], "id int, content string")
    postings = lx.build_postings(chunks)
    assert {(r.term, r.id): r.tf for r in postings.collect()} == {
        ("kv", 1): 2, ("64.10", 1): 1, ("fish", 1): 1, ("fish", 2): 1, ("pond", 2): 1, ("índice", 3): 1,
    }
    assert lx.build_postings(chunks, fold=True).filter("term = 'indice'").count() == 1
    terms = spark.createDataFrame([("q", "kv"), ("q", "fish"), ("q", "absent"), ("r", "indice")], "qid string, term string")
    got = lx.lexical_topk(terms, postings, 5).orderBy("rank").collect()
    assert [(r.qid, r.id, round(r.lexical_score, 4)) for r in got] == [("q", 1, round(0.3 / 1.3, 4)), ("q", 2, round(0.1 / 1.1, 4))]
    assert lx.lexical_topk(terms, postings, 1).count() == 1
    # Terms beyond the bound take the shuffled plan, with the same rows.
    beyond = lx.lexical_topk(terms, postings, 5, settings=Settings(broadcast_max_bytes=100)).orderBy("rank").collect()
    assert beyond == got
    freq = lx.term_doc_freq(postings, terms, spark.range(4).selectExpr("count(1) as n"))
    assert {r.term: (r.doc_count, r.total_docs) for r in freq.collect()} == {"kv": (1, 4), "fish": (2, 4), "absent": (0, 4), "indice": (0, 4)}


def test_stored_postings(spark, tmp_path):
    chunks = spark.createDataFrame([(i, "hot word" + str(i)) for i in range(50)], "id int, content string")
    path = str(tmp_path / "p")
    lx.write_postings(lx.build_postings(chunks), path)
    assert spark.read.parquet(path).filter("term = 'hot'").count() == 50


def test_stored_index_in_batches(spark, tmp_path):
    """Two ingest batches and a hidden chunk; a search reads the buckets of its terms and no others."""
    path = str(tmp_path / "p")
    first = spark.createDataFrame([(i, f"hot word{i}") for i in range(40)], "id int, content string")
    later = spark.createDataFrame([(i, f"hot term{i}") for i in range(40, 60)], "id int, content string")
    schema = lx.build_postings(first).schema
    lx.write_postings(lx.build_postings(first), path)
    terms = spark.createDataFrame([("q", "hot"), ("q", "term41"), ("r", "word3"), ("r", "absent")], "qid string, term string")
    assert {(r.term, r.id) for r in lx.asked_postings(spark, path, terms, schema).collect()} == {("hot", i) for i in range(40)} | {("word3", 3)}
    lx.write_postings(lx.build_postings(later), path)
    lx.hide_postings(spark.createDataFrame([(3,), (45,)], "id int"), path)
    found = lx.asked_postings(spark, path, terms, schema)
    assert {(r.term, r.id) for r in found.collect()} == {("hot", i) for i in range(60) if i not in (3, 45)} | {("term41", 41)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan parquet") :]
    assert "PartitionFilters: [_bucket" in scan or "_bucket#" in scan.split("PartitionFilters:")[1].split("]")[0]
