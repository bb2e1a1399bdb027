import datetime as dt


from corpuscle.operators import admin as ad

T0 = dt.datetime(2024, 1, 1)
COLUMNS = (
    "id string, content string, original_file_id string, original_file_name string, storage_bucket string, storage_path string, "
    "deleted_at timestamp, created_at timestamp, first_ingested_at timestamp, chunk_index int, page int"
)


def day(n):
    return None if n is None else T0 + dt.timedelta(days=n)


def chunk(id_, file, deleted=None, created=0, first=None, index=None, page=None, obj=True):
    return (id_, f"text {id_}", file, f"{file}.pdf", "b" if obj else None, f"{file}.pdf" if obj else None, day(deleted), day(created), day(first), index, page)


def table(spark):
    return spark.createDataFrame(
        [
            chunk("1", "A", created=5, first=1, index=1), chunk("2", "A", created=6, index=0), chunk("3", "A", deleted=9, created=0, index=2),
            chunk("4", "B", deleted=3, created=1, obj=False), chunk("5", "B", deleted=4, created=2, page=1, obj=False), chunk("6", "C", created=8),
        ],
        COLUMNS,
    )


def test_summaries(spark):
    got = {r.original_file_id: r for r in ad.file_summaries(table(spark)).collect()}
    a, b = got["A"], got["B"]
    assert (a.total_chunks, a.active_chunks, a.deleted_chunks, a.status) == (3, 2, 1, "active")
    assert (a.created_at, a.last_ingested_at, a.deleted_at) == (day(1), day(6), day(9))
    assert (b.status, b.created_at, b.last_ingested_at, b.deleted_at) == ("deleted", None, None, day(4))
    order = [r.original_file_id for r in ad.newest_first(ad.file_summaries(table(spark))).collect()]
    assert order == ["C", "A", "B"]
    p = ad.cleanup_preview(ad.file_summaries(table(spark))).first()
    assert tuple(p) == (3, 6, 2, True)


def test_summaries_read_neither_text_nor_vectors(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "t"))
    plan = ad.file_summaries(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema"):]
    assert "content" not in schema


def test_listing_and_recovery(spark):
    assert [r.id for r in ad.file_chunks(table(spark), "A").collect()] == ["2", "1", "3"]
    assert [r.id for r in ad.file_chunks(table(spark), "B").collect()] == ["5", "4"]
    got = {}
    for r in ad.recover_content(table(spark)).orderBy("original_file_id", "unplaced", "part").collect():
        got.setdefault(r.original_file_id, []).append(r.content)
    assert got["A"] == ["text 2\n\ntext 1"]  # active chunks only
    assert sorted("\n\n".join(got["B"]).split("\n\n")) == ["text 4", "text 5"]  # none active: all


def test_diagnose(spark):
    got = {r.original_file_id: r for r in ad.diagnose(ad.file_summaries(table(spark))).collect()}
    assert got["A"].recoverable_from_both and not got["A"].recoverable_from_none
    assert got["B"].recoverable_from_none and not got["B"].has_storage


def test_reindex(spark):
    asked = spark.createDataFrame([("A",), ("B",), ("Z",), ("A",)], "original_file_id string")
    got = {r.original_file_id: (r.status, r.message) for r in ad.reindex_targets(asked, ad.file_summaries(table(spark))).collect()}
    assert got["A"] == ("ready", None) and got["Z"] == ("failed", "Arquivo não encontrado") and got["B"][0] == "failed"

    fresh = spark.createDataFrame([chunk("10", "A", created=20, index=0), chunk("11", "C", created=20, index=0)], COLUMNS)
    results = spark.createDataFrame([("A", "success", 1), ("C", "failed", 0)], "original_file_id string, status string, chunks_created int")
    out = {r.id: r.first_ingested_at for r in ad.replace_versions(table(spark), fresh, results).collect()}
    assert sorted(out) == ["10", "4", "5", "6"] and out["10"] == day(0)
    r = ad.reindex_report(results).first()
    assert (r.processed_files, r.failed_files, r.total_chunks_created, r.status) == (1, 1, 1, "partial_failure")
    assert ad.reindex_report(results.limit(0)).first().message == "Nenhum arquivo para reindexar."
    assert ad.reindex_report(results.filter("status = 'failed'")).first().status == "error"


def test_backfill(spark):
    df = spark.createDataFrame([(None, None, '{"original_file_id": "m", "original_file_name": "n"}'), ("k", None, '{"original_file_id": "m"}'), (None, None, None)],
                               "original_file_id string, original_file_name string, metadata string")
    assert [(r[0], r[1]) for r in ad.backfill_ids(df).collect()] == [("m", "n"), ("k", None), (None, None)]
    assert ad.where_meta(df, "original_file_id", "m").count() == 2


def test_new_files(spark):
    files = spark.createDataFrame([("A",), ("N",)], "original_file_id string")
    assert [r[0] for r in ad.new_files(files, table(spark)).collect()] == ["N"]
    assert ad.new_files(files, table(spark), force=True).count() == 2
    assert [r[0] for r in ad.already_ingested(files, table(spark)).collect()] == ["A"]


def test_recovery_in_bounded_pieces(spark):
    """Chunks of one instant without any place, one position that is repeated, and an ordinary file."""
    from pyspark.sql import functions as F

    n = 5000
    same = spark.range(n).select(
        F.format_string("%05d", "id").alias("id"), F.lit("hot").alias("original_file_id"), F.lit(None).cast("int").alias("chunk_index"), F.lit(None).cast("int").alias("page"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("deleted_at"), F.concat(F.lit("t"), "id").alias("content"),
    )
    repeated = same.limit(2500).withColumns({"original_file_id": F.lit("twice"), "chunk_index": F.lit(7)})
    plain = same.limit(30).withColumns({"original_file_id": F.lit("plain"), "chunk_index": F.col("id").cast("int")})
    rows = ad.recover_content(same.unionByName(repeated).unionByName(plain).repartition(7)).orderBy("original_file_id", "unplaced", "part", "piece").collect()
    assert max(r.chunks for r in rows) <= 1000
    text = {}
    for r in rows:
        text.setdefault(r.original_file_id, []).extend(r.content.split("\n\n"))
    assert text["hot"] == [f"t{i}" for i in range(n)] and len([r for r in rows if r.original_file_id == "hot"]) == 5
    assert text["plain"] == [f"t{i}" for i in range(30)] and len(text["twice"]) == len(set(text["twice"])) == 2500
