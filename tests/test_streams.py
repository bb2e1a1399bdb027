import datetime as dt
import os
import random


from corpuscle.config import Settings, shared_dir
from corpuscle.streaming import ingest as si
from corpuscle.streaming import jobs as sj
from corpuscle.streaming import limits as sl

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def brute(events, limit, window):
    """events: (key, id, second) in any order -> admitted by id."""
    state, out = {}, {}
    for key, i, s in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        recent = [t for t in state.get(key, []) if s - t <= window]
        out[i] = len(recent) < limit
        state[key] = recent + [s] if out[i] else recent
    return out


def random_events(n=600, seed=2):
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(9)}", i, rnd.randrange(400000)) for i in range(n)]


def frame(spark, events):
    return spark.createDataFrame([(k, i, at(s)) for k, i, s in events], "key string, event_id long, ts timestamp")


def test_boundaries(spark):
    # Kept exactly at the window, dropped after it; a refused event leaves no trace.
    events = [("a", 0, 0), ("a", 1, 300), ("a", 2, 301), ("a", 3, 601), ("a", 4, 602), (" A ", 5, 602)]
    got = {r.event_id: r.admitted for r in sl.admit_batch(frame(spark, events), 1, 300).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True, 5: False}


def test_batch_matches_brute_force(spark):
    events = random_events()
    for limit, window in ((3, 2000), (1, 300), (10, 86400)):
        got = {r.event_id: r.admitted for r in sl.admit_batch(frame(spark, events), limit, window).collect()}
        assert got == brute(events, limit, window)


def test_one_key_over_many_ranges(spark):
    """All events of one key, without a quiet gap: dense, at a steady beat that never forgets its start, and at one instant."""
    rnd = random.Random(9)
    dense = [("hot", i, rnd.randrange(40000)) for i in range(4000)]
    steady = [("hot", i, 10 * i) for i in range(1200)]
    instant = [("hot", i, 5) for i in range(900)] + [("next", 900 + i, 5 + i) for i in range(300)]
    for events, limit, window, size in ((dense, 4, 90, 300), (steady, 1, 95, 200), (steady, 3, 95, 200), (instant, 7, 30, 100)):
        got = {r.event_id: r.admitted for r in sl.admit_batch(frame(spark, events), limit, window, size).collect()}
        assert got == brute(events, limit, window)


def test_quiet_sessions(spark):
    events = [("a", 0, 0), ("a", 1, 100), ("a", 2, 401), ("a", 3, 86400 * 2), ("a", 4, 86400 * 2 + 300), ("b", 5, 50)]
    got = {r.event_id: r.session for r in sl.quiet_sessions(frame(spark, events), 300).collect()}
    assert got[0] == got[1] and got[2] == got[1] + 1 and got[3] == got[4] == got[2] + 1 and got[5] == 1


def stream(spark, tmp_path, df, parts, order):
    """Write `df` in several files by ranges of the order column, as a stream of one file per batch."""
    rows = sorted(df.collect(), key=lambda r: r[order])
    step = -(-len(rows) // parts)
    for i in range(parts):
        part = spark.createDataFrame(rows[i * step:(i + 1) * step], df.schema).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drain(tmp_path, df, name="out"):
    q = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / name))


def test_admission_over_batches(spark, tmp_path):
    events = random_events(200)
    source = stream(spark, tmp_path, frame(spark, events), 4, "ts")
    got = {r.event_id: r.admitted for r in drain(tmp_path, sl.admit_stream(source, 3, 2000)).collect()}
    assert got == brute(events, 3, 2000)


def test_failures(spark):
    df = spark.createDataFrame([("email_not_confirmed",), ("invalid_credentials",)], "code string")
    assert [r.code for r in sl.login_failures(df).collect()] == ["invalid_credentials"]


def test_stale_jobs(spark, tmp_path):
    log = [
        ("done", 0, "queued"), ("done", 100, "processing"), ("done", 350, "done"), ("late", 0, "queued"), ("late", 301, "done"),
        ("stuck", 10, "processing"), ("edge", 0, "queued"), ("edge", 300, "error"), ("fresh", 2000, "queued"), ("tick", 2100, "done"),
    ]
    df = spark.createDataFrame([(j, at(s), st) for j, s, st in log], "job_id string, at timestamp, status string")
    out = drain(tmp_path, sj.stale_job_stream(stream(spark, tmp_path, df, 5, "at"), 300))
    got = {r.job_id: (r.status, r.error is not None) for r in out.collect()}
    assert got == {"done": ("done", False), "late": ("error", True), "stuck": ("error", True), "edge": ("error", False), "tick": ("done", False)}


def test_closed_jobs(spark, tmp_path):
    """Each job once, with its times; what comes after the end is ignored, also when the state has gone."""
    log = [
        ("done", 0, "queued"), ("done", 100, "processing"), ("done", 350, "done"), ("late", 0, "queued"), ("late", 301, "done"),
        ("stuck", 10, "processing"), ("edge", 0, "queued"), ("edge", 300, "error"), ("twice", 20, "queued"), ("twice", 30, "done"),
        ("twice", 900, "error"), ("tick", 5000, "queued"), ("old", 5100, "queued"), ("done", 360, "error"), ("tick", 5200, "done"), ("end", 9000, "queued"),
    ]
    df = spark.createDataFrame([(j, at(s), st, f"r{s}", None, i) for i, (j, s, st) in enumerate(log)], "job_id string, at timestamp, status string, result string, error string, i int")
    with sj.rocksdb_state(spark):
        out = drain(tmp_path, sj.closed_jobs_stream(stream(spark, tmp_path, df, 6, "i"), 300, "600 seconds", 600))
        rows = out.collect()
    seconds = lambda t: None if t is None else int((t - T0).total_seconds())
    got = {r.job_id: (r.status, r.error is None, seconds(r.created_at), seconds(r.started_at), seconds(r.finished_at)) for r in rows}
    assert len(rows) == len(got)
    assert got == {
        "done": ("done", True, 0, 100, 350), "late": ("error", False, 0, None, 300), "stuck": ("error", False, None, 10, 310), "edge": ("error", True, 0, None, 300),
        "twice": ("done", True, 20, None, 30), "tick": ("done", True, 5000, None, 5200), "old": ("error", False, 5100, None, 5400),
    }


def test_window_counts(spark):
    got = sl.window_counts(frame(spark, [("a", 0, 30), ("a", 1, 90)]), "2 minutes", "1 minute").collect()
    assert {(r.window_start, r.events) for r in got} == {(at(-60), 1), (at(0), 2), (at(60), 1)}



def test_ingest_stream(spark, tmp_path):
    settings = Settings(chunk_size=200, chunk_overlap=20, min_words_per_page=5)
    text = "Some words of a page that are long enough to be kept. " * 5
    one = [("f1", "a.pdf", "pypdf", p, text + str(p)) for p in range(3)]
    two = [("f2", "b.pdf", "pypdf", 0, text), ("f1", "a.pdf", "pypdf", 0, text)]
    source, table = str(tmp_path / "in"), str(tmp_path / "table")

    def embedder():
        def call(texts):
            return [[float(len(t)), 1.0] for t in texts]

        return call

    def run(state):
        si.ingest_stream(spark, source, table, str(tmp_path / state), embedder(), settings, ("pypdf",), 1).awaitTermination()
        return {r.original_file_id: r["count"] for r in si.stored_chunks(spark, table).groupBy("original_file_id").count().collect()}

    spark.createDataFrame(one, si.PAGES_SCHEMA).coalesce(1).write.parquet(source)
    first = run("s")
    assert set(first) == {"f1"} and first["f1"] > 1
    spark.createDataFrame(two, si.PAGES_SCHEMA).coalesce(1).write.mode("append").parquet(source)
    second = run("s")
    # The known file is left out, the new one is added.
    assert set(second) == {"f1", "f2"} and second["f1"] == first["f1"]
    # The same files delivered again, with the progress lost: batches rewrite themselves.
    stored = sorted(p.name for p in (tmp_path / "table").rglob("part-*.parquet"))
    assert run("other") == second
    # Their documents stand with all their pages, so nothing was chunked again.
    assert sorted(p.name for p in (tmp_path / "table").rglob("part-*.parquet")) == stored
    # A page that comes late replaces the version of its document.
    spark.createDataFrame([("f2", "b.pdf", "pypdf", 1, text + "late")], si.PAGES_SCHEMA).coalesce(1).write.mode("append").parquet(source)
    third = run("s")
    assert third["f1"] == first["f1"] and third["f2"] > second["f2"]
    chunks = si.stored_chunks(spark, table).filter("original_file_id = 'f2'")
    assert chunks.agg({"page_end": "max"}).first()[0] == 1 and chunks.select("chunk_index").distinct().count() == third["f2"]


def test_ingest_leaves_no_intermediates(spark, tmp_path, monkeypatch):
    """Every batch in rounds: the same chunks as in one, with nothing left in the shared folder but the stream's own tables."""
    settings = Settings(chunk_size=200, chunk_overlap=20, min_words_per_page=5)
    text = "Some words of a page that are long enough to be kept. " * 5
    pages = [(f"f{i}", f"{i}.pdf", "pypdf", p, f"{text}{i} {p}") for i in range(6) for p in range(3)]
    halves = [[r for r in pages if r[3] % 2 == 0], [r for r in pages if r[3] % 2] + [pages[1], (None, "none", "pypdf", 0, text)]]
    halves[1] += [(*pages[0][:4], "New " + text)] * 2

    def embedder():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    def run(name, chars):
        monkeypatch.setattr(si, "ROUND_CHARS", chars, raising=False)
        monkeypatch.setattr(si, "MOST_ROUNDS", 2, raising=False)
        source, table = str(tmp_path / name / "in"), str(tmp_path / name / "table")
        for half in halves:
            spark.createDataFrame(half, si.PAGES_SCHEMA).coalesce(1).write.mode("append").parquet(source)
            si.ingest_stream(spark, source, table, str(tmp_path / name / "state"), embedder(), settings, ("pypdf",), 1).awaitTermination()
        chunks = si.stored_chunks(spark, table).select("id", "content", "chunk_index", "page_start", "page_end", "original_file_id", "n_chars")
        return sorted(map(str, chunks.collect()))

    before = set(os.listdir(shared_dir(spark)))
    one = run("one", 1 << 28)
    assert set(os.listdir(shared_dir(spark))) == before
    assert one == run("many", 500) and set(os.listdir(shared_dir(spark))) == before
    # The page that came three times stands once, in its last form.
    assert sum("content='New Some" in s for s in one) == 1 and sum("original_file_id='f0'" in s for s in one) == 3


def test_first_requests(spark, tmp_path):
    df = spark.createDataFrame([("r1", "u", "l", "s", at(0)), ("r2", "u", "l", "s", at(1)), ("r3", "u", "x", "s", at(2))],
                               "request_id string, user_id string, lateral_id string, superior_id string, requested_at timestamp")
    out = drain(tmp_path, sj.first_requests(stream(spark, tmp_path, df, 1, "requested_at")))
    assert sorted(r.lateral_id for r in out.collect()) == ["l", "x"]


def test_state_log(spark):
    from corpuscle.operators.jobs import job_state

    df = spark.createDataFrame([("j", at(0), 1, "queued", None, None), ("j", at(5), 2, "processing", None, None), ("j", at(9), 3, "done", "ok", None)],
                               "job_id string, at timestamp, event_id long, status string, result string, error string")
    r = job_state(df).first()
    assert (r.status, r.result, r.created_at, r.started_at, r.finished_at) == ("done", "ok", at(0), at(5), at(9))
