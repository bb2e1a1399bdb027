import gzip
import hashlib
import json
import random

from corpuscle.operators.evaluation import compare_runs
from corpuscle.sources import digests, readers, uploads, writers


def test_golden(spark, tmp_path):
    rows = [
        {"id": "a", "question": "q?", "history": [["x", "y"]], "scope": "in_corpus", "expected_passages": ["p"], "must_mention": ["m"]},
        {"id": "b", "question": "r?", "scope": "out_of_corpus"},
    ]
    (tmp_path / "g.json").write_text("\n".join(json.dumps(r) for r in rows))
    got = {r.qid: r for r in readers.read_golden(spark, str(tmp_path / "g.json")).collect()}
    assert got["a"].history == [["x", "y"]] and got["b"].history == [] and got["b"].expected_passages == []


def test_runs(spark, tmp_path):
    old = {"run_id": "A", "mode": "full", "k": 20, "llm_expansion": True, "config": {"chunk_size": 4000}, "summary": {"mean_recall": 0.8, "only_a": 1},
           "results": [{"id": "q1", "scope": "in_corpus", "retrieval": {"recall": 1.0, "selected_count": 3}, "generation": None}]}
    new = {"run_id": "B", "mode": "full", "k": 99, "config": {"chunk_size": 1200, "retrieval_k": 40}, "summary": {"mean_recall": 0.9},
           "results": [{"id": "q1", "scope": "in_corpus", "retrieval": {"recall": 0.5}, "generation": {"refused": False, "cited_files": ["f"]}}]}
    for r in (old, new):
        (tmp_path / f"{r['run_id']}.json").write_text(json.dumps(r, indent=1))
    rows = {r.run_id: r for r in readers.read_runs(spark, str(tmp_path)).collect()}
    assert rows["A"].recall == 1.0 and rows["A"].refused is None and rows["B"].cited_files == ["f"]
    values = readers.read_run_values(spark, str(tmp_path))
    got = {(r.section, r.name): (r.value_a, r.value_b, r.delta) for r in compare_runs(values.filter("run_id = 'A'"), values.filter("run_id = 'B'")).collect()}
    # The older form keeps its settings outside the config; a config value wins over them.
    assert got["config", "retrieval_k"] == ("20", "40", 20.0)
    assert got["config", "use_llm_expansion"] == ("true", None, None)
    assert got["config", "mode"] == ("full", "full", None)
    assert round(got["summary", "mean_recall"][2], 6) == 0.1 and got["summary", "only_a"][1] is None


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 hello")
    (tmp_path / "b.pdf").write_bytes(b"plain")
    (tmp_path / "c.txt").write_bytes(b"%PDF-1.4")
    files = readers.with_object_path(readers.scan_files(spark, str(tmp_path)))
    got = {r.original_file_name: r for r in files.collect()}
    assert got["a.pdf"].original_file_id == hashlib.sha256(b"%PDF-1.4 hello").hexdigest()
    assert got["c.txt"].storage_path == got["c.txt"].original_file_id + ".txt"
    verdict = {r.original_file_name: (r.admitted, r.reason) for r in uploads.admit_uploads(files, "document").collect()}
    assert verdict == {"a.pdf": (True, None), "b.pdf": (False, "content does not match"), "c.txt": (False, "extension not allowed")}
    assert uploads.admit_uploads(files, "image").filter("admitted").count() == 0


def test_large_files_are_hashed_by_stretch(spark, tmp_path, monkeypatch):
    rnd = random.Random(4)
    made = {
        "bytes [1]*.bin": rnd.randbytes(60000), "ends.txt": b"line\r\n" * 9000, "open.txt": b"\n\nline\n" * 7000 + b"end", "feeds.txt": b"\n" * 20000,
        "none.txt": bytes(30000), "long line.txt": b"a\n" + bytes(30000) + b"\nb", "mark.txt": b"\xef\xbb\xbf" + b"x\xff\n" * 5000, "mark2.txt": b"\xef\xbb\xbf" + b"x\n" * 6000 + b"y",
        "\u00e9 %20.txt": rnd.randbytes(10001), "small.txt": b"\n",
    }
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    jobs = []
    run = spark.sparkContext.runJob
    monkeypatch.setattr(spark.sparkContext, "runJob", lambda rdd, f, parts: jobs.append(parts) or run(rdd, f, parts))
    # A file beyond that length can't be read as one value: as 2 GB are by default.
    conf = {"spark.sql.sources.binaryFile.maxLength": "10000", "spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "4096"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        files = readers.with_object_path(readers.scan_files(spark, str(tmp_path), whole=10000))
        got = {r.original_file_name: (r.length, r.original_file_id) for r in files.select("original_file_name", "length", "original_file_id").collect()}
        assert got == {name: (len(x), hashlib.sha256(x).hexdigest()) for name, x in made.items()}
        assert all(len(x) == 1 for x in jobs) and len(jobs) >= sum(len(x) for x in made.values()) // 4096 - len(made)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    (tmp_path / "packed.gz").write_bytes(gzip.compress(rnd.randbytes(20000)))
    for r in readers.scan_files(spark, str(tmp_path), whole=10000).collect():
        assert r.original_file_id == hashlib.sha256(bytes(r.content)).hexdigest() and (r.original_file_name == "packed.gz" or bytes(r.content) == made[r.original_file_name])


def test_files_of_very_long_lines_are_hashed_as_one_value(spark, tmp_path, monkeypatch):
    made = {"none.txt": bytes(30000), "in.txt": b"a\n" + b"x" * 5000 + b"\nb\n", "short.txt": b"line\n" * 3000}
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    found = []
    hashed = digests.file_digests
    monkeypatch.setattr(digests, "file_digests", lambda *x: found.extend(hashed(*x)) or found)
    monkeypatch.setattr(digests, "LONGEST", 4000)
    got = {r.original_file_name: r.original_file_id for r in readers.scan_files(spark, str(tmp_path), whole=1000).collect()}
    assert got == {name: hashlib.sha256(x).hexdigest() for name, x in made.items()}
    assert {path.rsplit("/", 1)[1] for path, x in found if x} == {"short.txt"}


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("a;b", None, 1.5), ("ç", "x", None)], "n string, m string, v double")
    writers.export_csv(df.coalesce(1), str(tmp_path / "csv"))
    part = next((tmp_path / "csv").glob("part-*.csv")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbfn;m;v\r\n")
    assert part.decode("utf-8-sig").split("\r\n")[1:3] == ["a,b;;1.5", "ç;x;"]
    assert [r.value for r in writers.export_lines(df).collect()] == ["a,b;;1.5", "ç;x;"]


def test_chunk_table(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("1", "c", '{"original_file_id": "f", "page": 3}', None), ("2", "d", "{}", [1.0, 2.0])], "id string, content string, metadata string, embedding array<float>")
    writers.write_chunks(df, path)
    got = {r.id: r for r in readers.scan_chunks(spark, path, live_only=False).collect()}
    assert (got["1"].original_file_id, got["1"].page, got["2"].original_file_name) == ("f", 3, "unknown")
    live = readers.scan_chunks(spark, path)
    assert [r.id for r in live.collect()] == ["2"]
    plan = live.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "IsNull(deleted_at)" in plan and "content" not in plan[plan.index("ReadSchema"):]


def test_pages(spark):
    df = spark.createDataFrame([("f", "s", "\n".join(str(i) for i in range(7))), ("g", "s", "")], "file_id string, source string, text string")
    got = sorted((r.file_id, r.page, r.text) for r in readers.split_pages(df, 3).collect())
    assert got == [("f", 0, "0\n1\n2"), ("f", 1, "3\n4\n5"), ("f", 2, "6"), ("g", 0, "")]


def test_write_run(spark, tmp_path):
    results = spark.createDataFrame([("q", 0.5)], "qid string, recall double")
    run = writers.write_run(results, spark.createDataFrame([(1, 0.5)], "questions_total int, mean_recall double"), {"k": 40, "none": None}, str(tmp_path), "label")
    assert run.endswith("Z-label")
    values = {(r.section, r.name): r.value for r in spark.read.json(str(tmp_path / "values")).collect()}
    assert values["summary", "mean_recall"] == "0.5" and values["config", "k"] == "40"


def test_a_large_run_is_written_in_parts(spark, tmp_path):
    from catalog.evaluation import run_parts
    from corpuscle.sources import readers

    r = spark.range(3000).selectExpr(
        "concat('q', id) AS qid", "'in_corpus' AS scope", "if(id % 10 < 9, 'hot', 'rare') AS source", "1.0D AS recall", "id AS selected_count",
        "false AS refused", "1L AS citation_file_count",
    )
    runs = run_parts(r, 3000, per_part=100)
    assert runs.selectExpr("max(size(results))").first()[0] < 200
    runs.write.partitionBy("part").json(str(tmp_path / "runs"))
    back = readers.read_runs(spark, str(tmp_path / "runs"))
    assert {(x["run_id"], x["qid"]) for x in back.collect()} == {(x["source"], x["qid"]) for x in r.collect()} and back.count() == 3000
