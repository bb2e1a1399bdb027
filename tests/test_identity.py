import json

from pyspark.sql import functions as F

from corpuscle.functions import identity as I
from corpuscle.functions import measures as M


def test_file_identity(spark):
    metas = [
        {"original_file_name": "n.pdf", "original_file_id": "x", "source": "/tmp/a"},
        {"source": "/tmp/zz.pdf", "title": "T"},
        {"source": "/data/zz.pdf", "title": "T"},
        {"source": "/data/"},
        {},
    ]
    df = spark.createDataFrame([(json.dumps(m),) for m in metas] + [("not json",), (None,)], "m string")
    got = df.select(I.file_name("m"), I.file_id("m") == F.md5(I.file_name("m"))).collect()
    assert [r[0] for r in got] == ["n.pdf", "T", "zz.pdf", "unknown", "unknown", "unknown", "unknown"]
    assert [r[1] for r in got] == [False, True, True, True, True, True, True]


def test_dedup_key(evaluate):
    key = evaluate(I.dedup_key, "7", "s", "1", "c")
    assert key == "db_id:7"
    a = evaluate(I.dedup_key, None, "s", "1", "c")
    assert a.startswith("meta:") and len(a) == 17
    # Rows that lack both source and page share one key.
    assert evaluate(I.dedup_key, None, None, None, "c") == evaluate(I.dedup_key, None, None, None, "d")


def test_names_and_paths(evaluate):
    assert evaluate(I.object_path, "h", "a.b.PDF") == "h.PDF"
    assert evaluate(I.object_path, "h", "noext") == "h.pdf"
    assert evaluate(I.object_path, "h", ".hidden") == "h.pdf"
    assert evaluate(I.sanitize_filename, " ../a b*c?.pdf ") == "a b_c_.pdf"
    assert evaluate(I.sanitize_filename, "\n\t") == "arquivo"
    assert len(evaluate(I.sanitize_filename, "x" * 500)) == 200
    assert evaluate(I.mask_email, "maria@site.org") == "m***@site.org"
    assert evaluate(I.mask_email, "none") == "***"
    assert evaluate(I.mask_email, "@x") == "***@x"
    assert evaluate(I.client_ip, "evil, 1.1.1.1, 2.2.2.2", "p") == "1.1.1.1"
    assert evaluate(I.client_ip, "one", "p") == "p"
    assert evaluate(I.first_non_blank, " ", None, " z ") == "z"
    assert evaluate(I.normalized_role, "Administrator") == "admin"
    assert evaluate(I.normalized_role, None) == "user"
    assert str(evaluate(I.parse_ts, "2024-01-02T03:04:05Z")) == "2024-01-02 03:04:05"
    assert evaluate(I.parse_ts, "bad") is None


def test_sniff(spark):
    cases = [
        (b"%PDF-1.7", "application/pdf"), (b"\xff\xd8\xff\xe0", "image/jpeg"), (b"\x89PNG\r\n\x1a\n..", "image/png"),
        (b"BM....", "image/bmp"), (b"RIFF1234WEBPx", "image/webp"), (b"\0\0\0\x18ftypmp42x", "video/mp4"),
        (b"\x1a\x45\xdf\xa3", "video/webm"), (b"hello", None), (b"\0\0\0\x18ftypmp42", None),
    ]
    df = spark.createDataFrame([(bytearray(b),) for b, _ in cases], "c binary")
    assert [r[0] for r in df.select(I.sniff_type("c")).collect()] == [t for _, t in cases]


def test_measures(spark):
    df = spark.createDataFrame([(100.0, 10.0, 5.0, 2.0), (100.0, 0.0, 5.0, 2.0), (None, 1.0, 1.0, 1.0), (0.0, 1.0, 1.0, 1.0)], "w double, l double, h double, d double")
    assert [r[0] for r in df.select(M.kvol("w", "l", "h", "d")).collect()] == [1.0, None, None, None]
    sizes = spark.createDataFrame([(10.0, 4.0), (10.0, None), (10.0, 0.0)], "px double, s double")
    assert [tuple(r) for r in sizes.select(M.to_physical("px", "s"), M.to_physical_area("px", "s")).collect()] == [(2.5, 0.625), (None, None), (None, None)]
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    m = spark.createDataFrame([(None, square), (7.0, square), (-1.0, None)], "m double, c array<struct<x:double,y:double>>")
    assert [r[0] for r in m.select(M.effective_scale("m", "c", 2.0)).collect()] == [2.0, 7.0, None]


def test_long_names(evaluate):
    """The start of a long name decides only where it fills the result."""
    assert evaluate(I.sanitize_filename, "a" * 300 + "?" * 500) == "a" * 200
    assert evaluate(I.sanitize_filename, "a" * 150 + "?" * 500) == "a" * 150
    assert evaluate(I.sanitize_filename, "?" * 900 + "b" * 250) == "b" * 200
    assert evaluate(I.sanitize_filename, "a" * 150 + "?" * 500 + "b" * 100) == "a" * 150 + "_" + "b" * 49
