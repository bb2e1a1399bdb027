import dataclasses

from pyspark.sql import functions as F

from corpuscle.config import Settings
from corpuscle.functions import vocab as V
from corpuscle.plans import answer as an
from corpuscle.plans.ingest import ingest
from corpuscle.plans.reindex import reindex_files
from corpuscle.plans.retrieve import query_variants
from corpuscle.sources.readers import CHUNK_SCHEMA

SETTINGS = Settings(
    chunk_size=200, chunk_overlap=20, min_words_per_page=5, embedding_dimensions=512, refusal_floor=0.1, strong_similarity=0.6, absolute_floor=0.05, relative_margin=0.5
)
WORDS = ["growth", "rate", "pond", "salinity", "feeding", "stress", "larvae", "oxygen"]


def embedder():
    def call(texts):
        import zlib

        out = []
        for t in texts:
            v = [0.0] * 512
            for w in t.lower().split():
                v[zlib.crc32(w.encode()) % 512] += 1.0
            out.append(v)
        return out

    return call


def corpus(spark):
    def page(i, p):
        return " ".join(f"{WORDS[(i + j) % 8]} measured v{i}{j}p{p} units." for j in range(12))

    rows = [(f"f{i}", "pypdf", p, page(i, p)) for i in range(4) for p in range(3)]
    rows += [("thin", "pypdf", 0, "a b"), ("saved", "pypdf", 0, "a b"), ("saved", "pdfplumber", 0, page(5, 0))]
    pages = spark.createDataFrame(rows, "file_id string, method string, page int, text string")
    files = pages.select("file_id").distinct().select(
        "file_id", F.concat("file_id", F.lit(".pdf")).alias("file_name"), F.lit("bucket").alias("storage_bucket"), F.concat("file_id", F.lit(".pdf")).alias("storage_path")
    )
    return pages, files


def test_report_reads_no_contents(spark):
    """What the report counts is settled on narrow rows; contents move once, to the chunk table."""
    pages, files = corpus(spark)
    report = ingest(pages, files, spark.createDataFrame([], CHUNK_SCHEMA), embedder(), SETTINGS).report
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "FileScan" in line and "content#" in line]


def test_ingest_and_reindex(spark):
    pages, files = corpus(spark)
    nothing = spark.createDataFrame([], CHUNK_SCHEMA)
    first = ingest(pages, files, nothing, embedder(), SETTINGS)
    report = {r.file_id: r for r in first.report.collect()}
    assert {f: r.status for f, r in report.items()} == {"f0": "success", "f1": "success", "f2": "success", "f3": "success", "thin": "extraction_failed", "saved": "success"}
    chunks = first.chunks
    counts = {r.original_file_id: r["count"] for r in chunks.groupBy("original_file_id").count().collect()}
    assert counts == {f: r.chunks for f, r in report.items() if r.chunks}
    assert chunks.filter("original_file_id = 'saved'").first().extraction_method == "pdfplumber"
    index = sorted(r.chunk_index for r in chunks.filter("original_file_id = 'f0'").collect())
    assert index == list(range(len(index)))
    spans = [(r.page_start, r.page_end) for r in chunks.filter("original_file_id = 'f0'").orderBy("chunk_index").collect()]
    assert spans == sorted(spans) and spans[0][0] == 0 and spans[-1][1] == 2

    again = ingest(pages, files, chunks, embedder(), SETTINGS)
    assert again.chunks.count() == 0
    assert {r.status for r in again.report.collect()} == {"already_exists", "extraction_failed"}

    asked = spark.createDataFrame([("f0",), ("f1",), ("nope",)], "original_file_id string")
    broken = pages.withColumn("text", F.when(F.col("file_id") == "f1", "bad").otherwise(F.col("text")))
    redo = reindex_files(chunks, broken, embedder(), asked, SETTINGS)
    outcome = {r.original_file_id: (r.status, r.chunks_created, r.chunks_removed) for r in redo.results.collect()}
    assert outcome == {"f0": ("success", counts["f0"], counts["f0"]), "f1": ("failed", 0, 0), "nope": ("failed", 0, 0)}
    after = {r.original_file_id: r["count"] for r in redo.chunks.groupBy("original_file_id").count().collect()}
    assert after == counts
    old = {r.id for r in chunks.filter("original_file_id = 'f0'").collect()}
    new = redo.chunks.filter("original_file_id = 'f0'").collect()
    assert not old & {r.id for r in new} and all(r.first_ingested_at for r in new)
    assert redo.report.first().status == "partial_failure"


def test_answers(spark):
    pages, files = corpus(spark)
    chunks = ingest(pages, files, spark.createDataFrame([], CHUNK_SCHEMA), embedder(), SETTINGS).chunks
    questions = spark.createDataFrame(
        [("ok", "What is the growth rate in the pond", None), ("far", "zebra quasar xylophone", None), ("judged", "insufficient salinity growth stress", None),
         ("made", "invented oxygen growth pond rate", None), ("mute", "silent feeding larvae growth", None)],
        "qid string, question string, last_question string",
    )

    def judge():
        def call(rows):
            return ["INSUFFICIENT" if "insufficient" in r["retrieval_query"] else "SUFFICIENT" for r in rows]

        return call

    def generate():
        def call(rows):
            out = []
            for r in rows:
                if "silent" in r["question"]:
                    out.append("sorry SEM_RESPOSTA_NO_CONTEXTO")
                elif "invented" in r["question"]:
                    out.append("oxygen growth pond was 777.77" if "unsupported" not in r else "oxygen growth pond was fine")
                else:
                    out.append("The growth rate in the pond is high")
            return out

        return call

    out = an.answer_questions(questions, chunks, embedder(), judge(), generate(), dataclasses.replace(SETTINGS, hybrid_enabled=False))
    got = {r.qid: r for r in out.answers.collect()}
    assert (got["ok"].route, got["ok"].evaluation, got["ok"].reformulation_count) == ("generate", "HIGH_QUALITY", 0)
    for q in ("far", "judged"):
        assert (got[q].route, got[q].evaluation, got[q].reformulation_count) == ("give_up", "REFUSED", 1)
        assert got[q].answer in V.REFUSAL_MESSAGES.values()
    assert (got["made"].numeric_regen_count, got["made"].unsupported_numbers, got["made"].answer) == (1, [], "oxygen growth pond was fine")
    assert got["mute"].evaluation == "REFUSED"
    assert {r.qid for r in out.sources.collect()} == {"ok", "made"}
    passes = {(r.qid, r["pass"]) for r in out.trace.collect()}
    assert ("ok", 1) in passes and ("ok", 2) not in passes and ("far", 2) in passes


def test_models_reword_the_question(spark):
    """A question in other words than the corpus finds its context by the paraphrase; a follow-up is made whole by the model."""
    pages, files = corpus(spark)
    chunks = ingest(pages, files, spark.createDataFrame([], CHUNK_SCHEMA), embedder(), SETTINGS).chunks
    questions = spark.createDataFrame(
        [("odd", "zebra quasar xylophone", None, None), ("next", "and the other one", "What is the growth rate", "It is high"), ("mute", "and silent", "zebra quasar", "x")],
        "qid string, question string, last_question string, last_answer string",
    )

    def judge():
        return lambda rows: ["SUFFICIENT" if "growth" in r["context"] else "INSUFFICIENT" for r in rows]

    def generate():
        return lambda rows: [f"{r['question']} growth" for r in rows]

    def condense():
        return lambda rows: ['"salinity stress of larvae"' if "growth" in r["last_question"] else "no" for r in rows]

    def paraphrase():
        return lambda rows: ["growth rate pond salinity" if "xylophone" in r["retrieval_query"] else "" for r in rows]

    def rewrite():
        return lambda rows: [r["retrieval_query"] + " oxygen" if "salinity" in r["retrieval_query"] else "nothing" for r in rows]

    one = dataclasses.replace(SETTINGS, hybrid_enabled=False)
    many = dataclasses.replace(one, multi_query_enabled=True)
    hooks = {"condense": condense(), "rewrite": rewrite(), "paraphrase": paraphrase()}
    got = {}
    for name, settings, extra in (("rules", one, {}), ("one", one, hooks), ("many", many, hooks)):
        out = an.answer_questions(questions, chunks, embedder(), judge(), generate(), settings, **extra)
        got[name] = {r.qid: r for r in out.answers.collect()}
    assert {n: g["odd"].route for n, g in got.items()} == {"rules": "give_up", "one": "give_up", "many": "generate"}
    assert got["rules"]["next"].retrieval_query == "What is the growth rate and the other one"
    assert got["many"]["next"].retrieval_query == got["one"]["next"].retrieval_query == "salinity stress of larvae"
    # A text of the model that is too short is of no use.
    assert got["many"]["mute"].retrieval_query == "zebra quasar and silent"
    assert got["many"]["odd"].reformulation_count == 0


def test_routing(spark):
    df = spark.createDataFrame([("sufficient", 0), ("partial", 1), ("insufficient", 0), ("insufficient", 1)], "v string, n int")
    assert [r[0] for r in df.select(an.route("v", "n")).collect()] == ["generate", "generate", "reformulate", "give_up"]


def test_variants(spark):
    df = spark.createDataFrame([("q", "A b", " a B ", "c", "d"), ("e", " ", None, "", None)], "qid string, a string, b string, c string, d string")
    got = {}
    for r in query_variants(df, ("a", "b", "c", "d")).orderBy("qid", "variant").collect():
        got.setdefault(r.qid, []).append(r.text)
    assert got == {"q": ["A b", "c", "d"], "e": [" "]}
