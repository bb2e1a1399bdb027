"""Row-level changes, listings, ownership, profiles, measurements and jobs."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from catalog import ORACLE, query
from catalog.fixtures import ANALYSES, IMAGES, JOBS, analyses, events, images, jobs, sql_ts, table, ts
from corpuscle.config import scratch_path
from corpuscle.functions import vocab as V
from corpuscle.operators import jobs as jb
from corpuscle.operators import measurements as ms
from corpuscle.operators import tables as tb
from corpuscle.plans.measure import measure_pairs
from corpuscle.sources import writers


@query("upsert", """SELECT coalesce(c_custkey, s_suppkey) AS c_custkey, coalesce(CASE WHEN s_acctbal > 0 THEN s_name END, c_name) AS c_name,
      coalesce(s_acctbal, c_acctbal) AS c_acctbal, c_mktsegment FROM customer FULL JOIN (SELECT s_suppkey + 50 AS s_suppkey, s_name, s_acctbal FROM supplier) ON c_custkey = s_suppkey""")
def upsert(spark, d):
    """Suppliers written over customers; names of those in debt are left alone."""
    new = table(spark, d, "supplier").select(
        (F.col("s_suppkey") + 50).alias("c_custkey"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("c_name"), F.col("s_acctbal").alias("c_acctbal")
    )
    target = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return tb.upsert(target, new, "c_custkey")


@query("upsert_buckets", ORACLE["upsert"])
def upsert_buckets(spark, d):
    """The same into a table stored by buckets of the key, of which only the touched ones are rewritten."""
    new = table(spark, d, "supplier").select(
        (F.col("s_suppkey") + 50).alias("c_custkey"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("c_name"), F.col("s_acctbal").alias("c_acctbal")
    )
    target = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = scratch_path(spark, "customer-buckets")
    tb.write_buckets(target, path, "c_custkey", 16)
    tb.upsert_buckets(spark, path, target.schema, new, "c_custkey", 16)
    return tb.read_buckets(spark, path, target.schema)


@query("upsert_all", """SELECT coalesce(o_orderkey, id) AS o_orderkey, CASE WHEN id IS NOT NULL THEN p ELSE o_orderpriority END AS o_orderpriority
    FROM orders FULL JOIN (SELECT l_orderkey + 100 AS id, CASE WHEN max(l_tax) > 0.05 THEN 'URGENT' END AS p FROM lineitem GROUP BY 1) ON o_orderkey = id""")
def upsert_all(spark, d):
    """The other mode: a null in the update overwrites."""
    new = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") + 100).alias("o_orderkey")).agg(
        F.when(F.max("l_tax") > 0.05, "URGENT").alias("o_orderpriority")
    )
    return tb.upsert(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), new, "o_orderkey", keep_null=False)


@query("export_lines", "SELECT concat_ws(';', page_id::VARCHAR, url, replace(html, ';', ',')) AS value FROM pages")
def export_lines(spark, d):
    return writers.export_lines(table(spark, d, "pages").select("page_id", "url", "html"))


# --- listings --------------------------------------------------------------------------------


@query("list_images", f"""WITH {IMAGES} SELECT id, tag, {sql_ts('uploaded_at')} FROM images WHERE user_id = 7 AND tag = 'lateral'
      AND uploaded_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'""")
def list_images(spark, d):
    rows = tb.list_images(images(spark, d), 7, "lateral", datetime.datetime(1996, 1, 1), datetime.datetime(1999, 12, 31))
    return rows.select("id", "tag", ts("uploaded_at"))


@query("list_measurements", f"""WITH {ANALYSES} SELECT id, {sql_ts('created_at')}, floor(kvol * 1e4)::BIGINT AS kvol FROM analyses
    WHERE user_id = 11 AND created_at >= TIMESTAMP '1993-06-01' AND kvol >= 0.5 AND kvol <= 20""")
def list_measurements(spark, d):
    rows = tb.list_measurements(analyses(spark, d), 11, datetime.datetime(1993, 6, 1), None, 0.5, 20)
    return rows.select("id", ts("created_at"), F.floor(F.col("kvol") * 1e4).alias("kvol"))


@query("list_library", """SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size > 10 THEN p_brand END AS description,
      CASE WHEN p_size > 25 THEN p_type ELSE 'geral' END AS category, p_size * 1000 AS file_size FROM part""")
def list_library(spark, d):
    p = table(spark, d, "part")
    videos = p.select(
        F.col("p_partkey").alias("id"), F.concat(F.lit(" "), "p_name", F.lit("\t")).alias("title"),
        F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise("  ").alias("description"),
        F.when(F.col("p_size") > 25, F.col("p_type")).when(F.col("p_size") > 15, " ").alias("category"),
        F.concat("p_brand", F.lit(".mp4")).alias("filename"), (F.col("p_size") * 1000).alias("file_size"),
        F.timestamp_seconds("p_partkey").alias("created_at"), F.col("p_size").alias("uploaded_by"),
    )
    return tb.list_library(videos).select("id", "title", "description", "category", "file_size")


@query("owned_by", f"WITH {IMAGES} SELECT id FROM images WHERE user_id = 42")
def owned_by(spark, d):
    return tb.owned_by(images(spark, d), 42).select("id")


@query("owned_objects", f"WITH {IMAGES} SELECT id, storage_path FROM images WHERE split_part(storage_path, '/', 1) = '4'")
def owned_objects(spark, d):
    return tb.owned_objects(images(spark, d), "4").select("id", "storage_path")


@query("accounts", """SELECT c_custkey AS user_id, c_name, o.orders AS orders, o.orders IS NOT NULL AS has_profile FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS orders FROM orders WHERE o_totalprice > 400000 GROUP BY 1) o ON o_custkey = c_custkey""")
def accounts(spark, d):
    profiles = table(spark, d, "orders").filter("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("orders"))
    return tb.accounts(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), profiles)


@query("validate_profiles", f"""WITH p AS (SELECT c_custkey, c_name AS full_name, CASE WHEN c_nationkey > 20 THEN '' ELSE repeat('9', c_nationkey + 12) END AS phone,
      CASE WHEN c_mktsegment = 'BUILDING' THEN 'piscicultura' WHEN c_mktsegment = 'MACHINERY' THEN 'other' ELSE 'carcinicultura' END AS farming_type,
      CASE WHEN c_acctbal < 100 THEN NULL ELSE c_acctbal / 10 - 50 END AS tons, upper(left(c_mktsegment, 2)) AS uf, c_nationkey - 3 AS tanks FROM customer),
    e AS (SELECT *, list_filter([CASE WHEN phone = '' THEN 'phone: required' END, CASE WHEN length(phone) > 30 THEN 'phone: longer than 30' END,
        CASE WHEN farming_type = 'other' THEN 'farming_type: unknown' END, CASE WHEN tons IS NULL THEN 'annual_production_tons: required' END,
        CASE WHEN tons < 0 THEN 'annual_production_tons: negative' END, CASE WHEN tons <> round(tons, 1) THEN 'annual_production_tons: more than one decimal' END,
        CASE WHEN tanks < 0 THEN 'tank_count: negative' END,
        CASE WHEN NOT list_contains({list(V.STATES)!r}, uf) THEN 'address_state: unknown' END], lambda x: x IS NOT NULL) AS errors FROM p)
    SELECT c_custkey, array_to_string(errors, '|') AS errors, len(errors) = 0 AS ok, uf AS address_state FROM e""")
def validate_profiles(spark, d):
    c = table(spark, d, "customer")
    n, seg = F.col("c_nationkey"), F.col("c_mktsegment")
    rows = c.select(
        "c_custkey", F.col("c_name").alias("full_name"), F.when(n > 20, "").otherwise(F.expr("repeat('9', c_nationkey + 12)")).alias("phone"),
        F.when(seg == "BUILDING", "piscicultura").when(seg == "MACHINERY", "other").otherwise("carcinicultura").alias("farming_type"),
        F.when(F.col("c_acctbal") >= 100, F.col("c_acctbal") / 10 - 50).alias("annual_production_tons"),
        F.concat(F.lit(" "), F.lower(F.left(seg, F.lit(2)))).alias("address_state"), (n - 3).alias("tank_count"),
    )
    out = tb.validate_profiles(rows)
    return out.select("c_custkey", F.array_join("errors", "|").alias("errors"), "ok", "address_state")


@query("delete_cascade", f"""WITH {IMAGES},{ANALYSES}, gone AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0),
    i AS (SELECT * FROM images WHERE user_id NOT IN (SELECT * FROM gone)),
    a AS (SELECT * FROM analyses WHERE user_id NOT IN (SELECT * FROM gone)),
    j AS (SELECT DISTINCT l_orderkey AS id, min(l_suppkey) AS user_id, l_orderkey * 10 + min(l_linenumber) AS lateral_id, l_orderkey * 10 + max(l_linenumber) AS superior_id FROM lineitem GROUP BY l_orderkey)
    SELECT 'image' AS kind, i.id, a.id AS analysis_id FROM i LEFT JOIN a ON a.id = i.analysis_id
    UNION ALL SELECT 'analysis', id, NULL FROM a
    UNION ALL SELECT 'job', id, NULL FROM j WHERE user_id NOT IN (SELECT * FROM gone) AND lateral_id IN (SELECT id FROM i) AND superior_id IN (SELECT id FROM i)""")
def delete_cascade(spark, d):
    gone = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("user_id"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.min("l_suppkey").alias("user_id"),
        (F.first("l_orderkey") * 10 + F.min("l_linenumber")).alias("lateral_id"), (F.first("l_orderkey") * 10 + F.max("l_linenumber")).alias("superior_id"),
    )
    users = table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"))
    left = tb.delete_cascade(users, analyses(spark, d), images(spark, d), lines, gone)
    none = F.lit(None).cast("bigint").alias("analysis_id")
    return (
        left["images"].select(F.lit("image").alias("kind"), "id", "analysis_id")
        .unionByName(left["analyses"].select(F.lit("analysis").alias("kind"), "id", none))
        .unionByName(left["jobs"].select(F.lit("job").alias("kind"), "id", none))
    )


# --- measurements ----------------------------------------------------------------------------


@query("measurements_with_images", f"""WITH {ANALYSES},{IMAGES},
    f AS (SELECT analysis_id, tag, arg_min(id, (uploaded_at, id)) AS id FROM images GROUP BY 1, 2)
    SELECT a.id, l.id AS lateral_id, s.id AS superior_id FROM analyses a
    LEFT JOIN f l ON l.analysis_id = a.id AND l.tag = 'lateral' LEFT JOIN f s ON s.analysis_id = a.id AND s.tag = 'superior'""")
def measurements_with_images(spark, d):
    out = ms.measurements_with_images(analyses(spark, d), images(spark, d))
    return out.select("id", F.col("lateral_image.id").alias("lateral_id"), F.col("superior_image.id").alias("superior_id"))


@query("image_metrics", f"""WITH {IMAGES}, s AS (SELECT *, coalesce(manual_scale, CASE WHEN tax > 0 THEN tax * 1000 / 2.5 END) AS scale FROM images)
    SELECT id, round(scale, 3) AS scale, floor(bbox_width_px / scale * 100)::BIGINT AS width_100, floor(bbox_height_px / scale * 100)::BIGINT AS height_100,
      floor(mask_area_px / (scale * scale) * 100)::BIGINT AS area_100, scale IS NULL AS warned FROM s""")
def image_metrics(spark, d):
    out = ms.image_metrics(with_corners(images(spark, d)), 2.5)

    return out.select(
        "id", F.round("scale", 3).alias("scale"), F.floor(F.col("bbox_width_px") / F.col("scale") * 100).alias("width_100"),
        F.floor(F.col("bbox_height_px") / F.col("scale") * 100).alias("height_100"),
        F.floor(F.col("mask_area_px") / (F.col("scale") * F.col("scale")) * 100).alias("area_100"), F.col("warning").isNotNull().alias("warned"),
    )


def with_corners(rows):
    """A square marker whose side is the tax in thousandths, where there is one."""
    side, zero = F.col("tax") * 1000, F.lit(0.0)

    def p(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    square = F.array(p(zero, zero), p(side, zero), p(side, side), p(zero, side))
    return rows.withColumn("corners", F.when(F.col("tax") > 0, square))


PAIRS = """pair_jobs AS (SELECT o_orderkey AS id, o_orderkey % 97 AS user_id, o_orderkey * 10 + 1 AS lateral_id, o_orderkey * 10 + 2 AS superior_id,
    o_totalprice AS peso_g FROM orders)"""


def pair_jobs(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 97).alias("user_id"),
        (F.col("o_orderkey") * 10 + 1).alias("lateral_id"), (F.col("o_orderkey") * 10 + 2).alias("superior_id"), F.col("o_totalprice").alias("peso_g"),
    )


@query("check_pairs", f"""WITH {IMAGES},{PAIRS}, c AS (SELECT j.*, l.user_id AS lu, s.user_id AS su FROM pair_jobs j LEFT JOIN images l ON l.id = lateral_id LEFT JOIN images s ON s.id = superior_id)
    SELECT id, CASE WHEN lu IS NULL THEN 404 WHEN lu <> user_id THEN 403 WHEN su IS NULL THEN 404 WHEN su <> user_id THEN 403 ELSE 200 END AS code,
      CASE WHEN lu IS NULL OR lu <> user_id THEN 'lateral' WHEN su IS NULL OR su <> user_id THEN 'superior' END AS side FROM c""")
def check_pairs(spark, d):
    return jb.check_pairs(pair_jobs(spark, d), images(spark, d)).select("id", "code", "side")


@query("measure_pairs", f"""WITH {IMAGES},{PAIRS}, s AS (SELECT *, coalesce(manual_scale, CASE WHEN tax > 0 THEN tax * 1000 / 2.5 END) AS scale FROM images),
    m AS (SELECT j.id, j.peso_g, round(l.bbox_width_px / l.scale, 4) AS a, round(l.bbox_height_px / l.scale, 4) AS b, round(p.bbox_height_px / p.scale, 4) AS c,
        (l.scale IS NULL)::INT + (p.scale IS NULL)::INT AS warnings
      FROM pair_jobs j JOIN s l ON l.id = lateral_id AND l.user_id = j.user_id JOIN s p ON p.id = superior_id AND p.user_id = j.user_id)
    SELECT id, floor(a * 100)::BIGINT AS length_100, floor(b * 100)::BIGINT AS height_100, floor(c * 100)::BIGINT AS width_100,
      round(log10(CASE WHEN a > 0 AND b > 0 AND c > 0 THEN peso_g / (a * b * c) END), 1) AS kvol_log, warnings FROM m""")
def measure_pairs_all(spark, d):
    rows = images(spark, d)
    out = measure_pairs(pair_jobs(spark, d), rows.select("id", "user_id"), with_corners(rows), 2.5).measurements

    def hundredths(c, name):
        return F.floor(F.col(c) * 100).alias(name)

    return out.select(
        F.col("analysis_id").alias("id"), hundredths("comprimento_cm", "length_100"), hundredths("altura_cm", "height_100"),
        hundredths("largura_cm", "width_100"), F.round(F.log10("kvol"), 1).alias("kvol_log"), F.size("warnings").alias("warnings"),
    )


@query("metric_series", f"""WITH {IMAGES}, s AS (
      SELECT tag, 'bbox_width_px' AS metric, uploaded_at AS tm, bbox_width_px AS value FROM images WHERE processing_status = 'done'
      UNION ALL SELECT tag, 'manual_scale', uploaded_at, manual_scale FROM images WHERE processing_status = 'done' AND manual_scale IS NOT NULL),
    b AS (SELECT tag, metric, min(value) AS lo, max(value) AS hi FROM s GROUP BY 1, 2)
    SELECT tag, metric, strftime(tm, '%Y-%m-%d %H:%M:%S') AS "at", round(value, 3) AS value, round(lo, 3) AS min_value, round(hi, 3) AS max_value,
      round(CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 3) AS value_range FROM s JOIN b USING (tag, metric)""")
def metric_series(spark, d):
    rows = images(spark, d)
    done = ms.finished_images(rows, "lateral").unionByName(ms.finished_images(rows, "superior"))
    series = ms.metric_series(done, "uploaded_at", ("bbox_width_px", "manual_scale"), ("tag",))
    out = ms.series_with_bounds(series, ("tag", "metric"))
    return out.select("tag", "metric", ts("at"), *[F.round(c, 3).alias(c) for c in ("value", "min_value", "max_value", "value_range")])


# --- jobs ------------------------------------------------------------------------------------

NOW, DAYS = "2024-01-20 00:00:00", 3 * 86400


def now():
    return F.lit(NOW).cast("timestamp")


@query("expire_jobs", f"""WITH {JOBS}, s AS (SELECT *, status IN ('queued', 'processing') AND coalesce(started_at, created_at) < TIMESTAMP '{NOW}' - INTERVAL 3 DAY AS stale FROM jobs)
    SELECT id, CASE WHEN stale THEN 'error' ELSE status END AS status, CASE WHEN stale THEN '{V.STALE_JOB_MESSAGE}' ELSE error END AS error,
      strftime(CASE WHEN stale THEN TIMESTAMP '{NOW}' ELSE finished_at END, '%Y-%m-%d %H:%M:%S') AS finished_at FROM s""")
def expire_jobs(spark, d):
    return jb.expire_jobs(jobs(spark, d), now(), DAYS).select("id", "status", "error", ts("finished_at"))


LATEST = f"{JOBS}, latest AS (SELECT * FROM jobs WHERE status IN ('queued', 'processing') QUALIFY row_number() OVER (PARTITION BY user_id, lateral_id, superior_id ORDER BY created_at DESC, id DESC) = 1)"


@query("latest_active", f"WITH {LATEST} SELECT user_id, lateral_id, id, status FROM latest")
def latest_active(spark, d):
    return jb.latest_active(jobs(spark, d)).select("user_id", "lateral_id", "id", "status")


@query("admit_jobs", f"""WITH {LATEST}, live AS (SELECT * FROM latest WHERE NOT coalesce(started_at, created_at) < TIMESTAMP '{NOW}' - INTERVAL 3 DAY),
    r AS (SELECT event_id AS request_id, user_id, json_extract_string(props, '$.k')::BIGINT AS lateral_id, ts FROM events),
    f AS (SELECT user_id, lateral_id, arg_min(request_id, (ts, request_id)) AS first FROM r GROUP BY 1, 2)
    SELECT request_id, coalesce(l.id::VARCHAR, 'new:' || first) AS admitted_id, coalesce(l.status, 'queued') AS status, l.id IS NULL AND request_id = first AS created
    FROM r JOIN f USING (user_id, lateral_id) LEFT JOIN live l USING (user_id, lateral_id)""")
def admit_jobs(spark, d):
    out = jb.admit_jobs(requests(spark, d), jobs(spark, d), now(), DAYS)
    return out.select("request_id", "admitted_id", "status", "created")


def requests(spark, d):
    return events(spark, d).select(
        F.col("event_id").alias("request_id"), "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("lateral_id"),
        F.lit(0).cast("bigint").alias("superior_id"), F.col("ts").alias("requested_at"),
    )


STATE = f"""{JOBS}, state AS (SELECT user_id AS job_id, max_by(status, (created_at, id)) AS status, max_by(id, (created_at, id)) AS last_id,
    min(created_at) FILTER (status = 'queued') AS created_at, max(created_at) FILTER (status = 'processing') AS started_at,
    max(created_at) FILTER (status IN ('done', 'error')) AS finished_at FROM jobs GROUP BY user_id)"""
STATE_SQL = f"WITH {STATE} SELECT job_id, status, last_id::VARCHAR AS result, {sql_ts('created_at')}, {sql_ts('started_at')}, {sql_ts('finished_at')} FROM state"


def job_log(spark, d):
    """All events of a user as the log of one job."""
    return jobs(spark, d).select(
        F.col("user_id").alias("job_id"), F.col("created_at").alias("at"), F.col("id").alias("event_id"), "status",
        F.col("id").cast("string").alias("result"), "error",
    )


@query("job_state", STATE_SQL)
def job_state(spark, d):
    out = jb.job_state(job_log(spark, d))
    return out.select("job_id", "status", "result", ts("created_at"), ts("started_at"), ts("finished_at"))


@query("sanitize_history", """WITH n AS (SELECT conv_id, turn, role, left(text, 4000) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
    SELECT conv_id, turn, role, text FROM n WHERE back <= 20""")
def sanitize_history(spark, d):
    from corpuscle.operators.history import recent_turns

    return recent_turns(table(spark, d, "conversations")).select("conv_id", "turn", "role", "text")


@query("trim_history", """WITH p AS (SELECT conv_id, turn // 2 AS pair, max(text) FILTER (turn % 2 = 0) AS q, max(text) FILTER (turn % 2 = 1) AS a FROM conversations GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pair DESC) AS back FROM (SELECT * FROM p UNION ALL SELECT conv_id, pair + 1000, q, a FROM p))
    SELECT conv_id, count(*) AS pairs, string_agg(left(q, 4000) || coalesce('|' || left(a, 4000), ''), '#' ORDER BY pair) AS kept FROM r WHERE back <= 10 GROUP BY conv_id""")
def trim_history(spark, d):
    """Each conversation, said twice over, as an array of pairs: the last ten stay."""
    from corpuscle.operators.history import trim_history as apply

    said = table(spark, d, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 2).alias("pair")).agg(
        F.max(F.when(F.col("turn") % 2 == 0, F.col("text"))).alias("q"), F.max(F.when(F.col("turn") % 2 == 1, F.col("text"))).alias("a")
    )
    twice = said.unionByName(said.withColumn("pair", F.col("pair") + 1000))
    ordered = F.array_sort(F.collect_list(F.struct("pair", F.array("q", "a").alias("texts"))))
    histories = twice.groupBy("conv_id").agg(F.transform(ordered, lambda x: x["texts"]).alias("history"))
    kept = histories.select("conv_id", apply("history").alias("h"))
    return kept.select(
        "conv_id", F.size("h").cast("bigint").alias("pairs"), F.array_join(F.transform("h", lambda p: F.array_join(p, "|")), "#").alias("kept")
    )


@query("with_last_turn", """SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS last_text FROM conversations""")
def with_last_turn(spark, d):
    from corpuscle.operators.history import with_last_turn as apply

    return apply(table(spark, d, "conversations")).select("conv_id", "turn", "text", "last_text")
