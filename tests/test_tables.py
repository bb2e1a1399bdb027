import datetime as dt

from pyspark.sql import functions as F

from corpuscle.operators import jobs as jb
from corpuscle.operators import measurements as ms
from corpuscle.operators import tables as tb
from corpuscle.plans.measure import measure_pairs

NOW = dt.datetime(2024, 1, 1, 12)


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", None)], "k int, v string, w string")
    assert sorted(map(tuple, tb.upsert(target, new, "k").collect())) == [(1, "a", "x"), (2, "b", "y"), (3, "c", None)]
    assert sorted(map(tuple, tb.upsert(target, new, "k", keep_null=False).collect()), key=str) == [(1, "a", "x"), (2, None, "y"), (3, "c", None)]


def test_upsert_moves_only_the_updates(spark):
    """Few updates: the target is not shuffled. Null and repeated keys give what a full join gives, in either way."""
    import dataclasses

    from corpuscle.config import Settings

    target = spark.createDataFrame([(i, f"v{i}") for i in range(50)] + [(None, "none"), (7, "again")], "k int, v string").repartition(3)
    new = spark.createDataFrame([(7, "x"), (7, "y"), (60, "new"), (60, "two"), (None, "u"), (8, None)], "k int, v string")
    plan = tb.upsert(target, new, "k")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "FullOuter" not in plan
    shuffled = dataclasses.replace(Settings(), broadcast_max_bytes=512)
    for keep in (True, False):
        assert sorted(map(tuple, tb.upsert(target, new, "k", keep).collect()), key=str) == sorted(map(tuple, tb.upsert(target, new, "k", keep, shuffled).collect()), key=str)


def test_upsert_of_stored_buckets(spark, tmp_path):
    """Untouched buckets keep their files."""
    import glob

    path = str(tmp_path / "table")
    target = spark.createDataFrame([(i, f"v{i}") for i in range(400)], "k int, v string")
    tb.write_buckets(target, path, "k", 16)
    before = {p: open(p, "rb").read() for p in glob.glob(f"{path}/_bucket=*/*.parquet")}
    new = spark.createDataFrame([(5, "five"), (1000, "new")], "k int, v string")
    assert tb.upsert_buckets(spark, path, target.schema, new, "k", 16) in (1, 2)
    got = {r.k: r.v for r in tb.read_buckets(spark, path, target.schema).collect()}
    assert got == {**{i: f"v{i}" for i in range(400)}, 5: "five", 1000: "new"}
    assert len(set(before) & set(glob.glob(f"{path}/_bucket=*/*.parquet"))) >= 14


def test_delete(spark):
    df = spark.createDataFrame([(str(i),) for i in range(5)], "id string")
    left, gone = tb.delete_rows(df, spark.createDataFrame([("1",), ("9",), ("1",)], "id string"))
    assert left.count() == 4 and gone.first()[0] == 1


def test_cascade(spark):
    users = spark.createDataFrame([("u",), ("v",)], "user_id string")
    analyses = spark.createDataFrame([("a", "u"), ("b", "v")], "id string, user_id string")
    images = spark.createDataFrame([("i", "u", "a"), ("j", "v", "a"), ("k", "v", "b")], "id string, user_id string, analysis_id string")
    jobs = spark.createDataFrame([("x", "v", "j", "k"), ("y", "v", "i", "k")], "id string, user_id string, lateral_id string, superior_id string")
    left = tb.delete_cascade(users, analyses, images, jobs, spark.createDataFrame([("u",)], "user_id string"))
    assert [r.id for r in left["analyses"].collect()] == ["b"]
    assert sorted((r.id, r.analysis_id) for r in left["images"].collect()) == [("j", None), ("k", "b")]
    assert [r.id for r in left["jobs"].collect()] == ["x"]


def test_profiles(spark):
    df = spark.createDataFrame(
        [("Ann", "1", "piscicultura", 1.5, " sp ", 1, " "), ("", "1", "x", 1.25, "XX", -1, "i" * 101), ("B", None, None, None, None, None, None), ("C", "2", "carcinicultura", -1.0, None, 0, "ok")],
        "full_name string, phone string, farming_type string, annual_production_tons double, address_state string, tank_count int, instagram string",
    )
    got = tb.validate_profiles(df).collect()
    assert got[0].ok and got[0].address_state == "SP" and got[0].instagram is None
    assert got[1].errors == [
        "full_name: required", "instagram: longer than 100", "farming_type: unknown", "annual_production_tons: more than one decimal",
        "tank_count: negative", "address_state: unknown",
    ]
    assert got[2].errors == ["phone: required", "farming_type: unknown", "annual_production_tons: required"]
    assert got[3].errors == ["annual_production_tons: negative"]


def test_listings(spark):
    rows = spark.createDataFrame([(1, "u", NOW, 0.5), (2, "u", NOW + dt.timedelta(days=1), None), (3, "v", NOW, 0.5)], "id int, user_id string, created_at timestamp, kvol double")
    assert [r.id for r in tb.list_measurements(rows, "u").collect()] == [2, 1]
    assert [r.id for r in tb.list_measurements(rows, "u", kvol_min=0.5).collect()] == [1]
    assert [r.id for r in tb.list_measurements(rows, "u", date_to=NOW).collect()] == [1]


def test_images(spark):
    m = spark.createDataFrame([("a",), ("b",)], "id string")
    img = spark.createDataFrame(
        [("i2", "a", "lateral", NOW), ("i1", "a", "lateral", NOW - dt.timedelta(1)), ("i3", "a", "superior", NOW), ("i4", None, "lateral", NOW)],
        "id string, analysis_id string, tag string, uploaded_at timestamp",
    )
    got = {r.id: (r.lateral_image and r.lateral_image.id, r.superior_image and r.superior_image.id) for r in ms.measurements_with_images(m, img).collect()}
    assert got == {"a": ("i1", "i3"), "b": (None, None)}


def test_measure_pairs(spark):
    jobs = spark.createDataFrame([("j1", "u", "l", "s", 100.0), ("j2", "u", "gone", "s", 1.0), ("j3", "u", "l", "other", 1.0), ("j4", "u", "l", "raw", None)],
                                 "id string, user_id string, lateral_id string, superior_id string, peso_g double")
    images = spark.createDataFrame([("l", "u"), ("s", "u"), ("other", "v"), ("raw", "u")], "id string, user_id string")
    side = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    pixels = spark.createDataFrame(
        [("l", 100.0, 50.0, 4000.0, 10.0, None), ("s", 90.0, 20.0, 1000.0, None, side), ("other", 1.0, 1.0, 1.0, 1.0, None), ("raw", 9.0, 9.0, 9.0, None, None)],
        "id string, bbox_width_px double, bbox_height_px double, mask_area_px double, manual_scale double, corners array<struct<x:double,y:double>>",
    )
    out = measure_pairs(jobs, images, pixels)
    got = {r.analysis_id: r for r in out.measurements.collect()}
    assert (got["j1"].comprimento_cm, got["j1"].altura_cm, got["j1"].largura_cm, got["j1"].kvol) == (10.0, 5.0, 2.0, 1.0)
    assert got["j4"].kvol is None and len(got["j4"].warnings) == 1
    assert {r.id: (r.code, r.side) for r in out.rejected.collect()} == {"j2": (404, "lateral"), "j3": (403, "superior")}
    assert out.images.filter("analysis_id = 'j1'").count() == 2


def job(id_, status, age, started=None, pair=("u", "l", "s")):
    at = NOW - dt.timedelta(seconds=age)
    return (id_, *pair, status, at, None if started is None else NOW - dt.timedelta(seconds=started), None, None)


JOBS = "id string, user_id string, lateral_id string, superior_id string, status string, created_at timestamp, started_at timestamp, finished_at timestamp, error string"


def test_stale_jobs(spark):
    now = F.lit(NOW)
    df = spark.createDataFrame([job("a", "queued", 299), job("b", "queued", 300), job("c", "queued", 301), job("d", "processing", 900, 10), job("e", "done", 900), job("f", "processing", 900, 301)], JOBS)
    got = {r.id: r for r in jb.expire_jobs(df, now).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "queued", "b": "queued", "c": "error", "d": "processing", "e": "done", "f": "error"}
    assert got["c"].finished_at == NOW and got["c"].error and got["e"].error is None


def test_admission(spark):
    now = F.lit(NOW)
    jobs = spark.createDataFrame([job("old", "queued", 200), job("live", "processing", 100, 50), job("stale", "queued", 999, pair=("u", "x", "s"))], JOBS)
    req = spark.createDataFrame([("r1", "u", "l", "s", NOW), ("r2", "u", "x", "s", NOW), ("r3", "u", "x", "s", NOW + dt.timedelta(seconds=1))],
                                "request_id string, user_id string, lateral_id string, superior_id string, requested_at timestamp")
    got = {r.request_id: (r.admitted_id, r.status, r.created) for r in jb.admit_jobs(req, jobs, now).collect()}
    assert got == {"r1": ("live", "processing", False), "r2": ("new:r2", "queued", True), "r3": ("new:r2", "queued", False)}


def test_series(spark):
    df = spark.createDataFrame([(NOW, 1.0, None), (NOW, 3.0, 5.0)], "t timestamp, a double, b double")
    got = sorted((r.metric, r.value, r.min_value, r.max_value, r.value_range) for r in ms.series_with_bounds(ms.metric_series(df, "t", ("a", "b"))).collect())
    assert got == [("a", 1.0, 1.0, 3.0, 2.0), ("a", 3.0, 1.0, 3.0, 2.0), ("b", 5.0, 5.0, 5.0, 1.0)]
