"""State of measurement jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.config import DEFAULTS
from corpuscle.functions import vocab as V

PAIR = ("user_id", "lateral_id", "superior_id")


def is_active() -> Column:
    return F.col("status").isin(*V.ACTIVE_JOB_STATUSES)


def is_stale(now: Column, seconds: int = DEFAULTS.job_stale_seconds) -> Column:
    """Active, and started (else created) more than `seconds` ago."""
    since = F.coalesce("started_at", "created_at")
    return F.coalesce(is_active() & (since < now - F.make_dt_interval(secs=F.lit(seconds))), F.lit(False))


def expire_jobs(jobs: DataFrame, now: Column, seconds: int = DEFAULTS.job_stale_seconds) -> DataFrame:
    """Stale jobs become errors; finished ones are never touched."""
    stale = is_stale(now, seconds)
    changed = {
        "status": F.when(stale, "error").otherwise(F.col("status")),
        "error": F.when(stale, V.STALE_JOB_MESSAGE).otherwise(F.col("error")),
        "finished_at": F.when(stale, now).otherwise(F.col("finished_at")),
    }
    return jobs.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in jobs.columns])


def latest_active(jobs: DataFrame, pair: tuple[str, ...] = PAIR) -> DataFrame:
    """The newest active job of every pair."""
    rest = [c for c in jobs.columns if c not in pair]
    newest = jobs.filter(is_active()).groupBy(*pair).agg(
        F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("_j")
    )
    return newest.select(*pair, "_j.*")


def admit_jobs(
    requests: DataFrame, jobs: DataFrame, now: Column, seconds: int = DEFAULTS.job_stale_seconds, pair: tuple[str, ...] = PAIR
) -> DataFrame:
    """Each request with the live job of its pair, or marked as new.

    Several requests of one pair share the first one's new job: `admitted_id` is the id
    of the live job, else the id of the pair's first request.
    """
    live = latest_active(jobs, pair).filter(~is_stale(now, seconds))
    live = live.select(*pair, F.col("id").alias("live_job_id"), F.col("status").alias("live_status"))
    first = requests.groupBy(*pair).agg(F.min_by("request_id", F.struct("requested_at", "request_id")).alias("_first"))
    joined = requests.join(first, list(pair)).join(live, list(pair), "left")
    is_new = F.col("live_job_id").isNull() & (F.col("request_id") == F.col("_first"))
    return joined.select(
        "request_id",
        *pair,
        F.coalesce(F.col("live_job_id").cast("string"), F.concat(F.lit("new:"), F.col("_first").cast("string"))).alias("admitted_id"),
        F.coalesce("live_status", F.lit("queued")).alias("status"),
        is_new.alias("created"),
    )


def check_pairs(requests: DataFrame, images: DataFrame) -> DataFrame:
    """Do both images exist and belong to the caller? 200, 404 or 403 with the side at fault."""
    out = requests
    for side in ("lateral", "superior"):
        known = images.select(F.col("id").alias(f"{side}_id"), F.col("user_id").alias(f"_{side}"))
        out = out.join(known, f"{side}_id", "left")

    def missing(side: str) -> Column:
        return F.col(f"_{side}").isNull()

    def foreign(side: str) -> Column:
        return F.col(f"_{side}") != F.col("user_id")

    verdict = (
        F.when(missing("lateral"), F.struct(F.lit(404).alias("code"), F.lit("lateral").alias("side")))
        .when(foreign("lateral"), F.struct(F.lit(403).alias("code"), F.lit("lateral").alias("side")))
        .when(missing("superior"), F.struct(F.lit(404).alias("code"), F.lit("superior").alias("side")))
        .when(foreign("superior"), F.struct(F.lit(403).alias("code"), F.lit("superior").alias("side")))
        .otherwise(F.struct(F.lit(200).alias("code"), F.lit(None).cast("string").alias("side")))
    )
    return out.withColumn("_v", verdict).select(*requests.columns, "_v.code", "_v.side")


def job_state(events: DataFrame) -> DataFrame:
    """Current state from the log (job_id, at, event_id, status, result, error).

    Times are those of the first queued, the last processing and the last terminal event.
    """
    at = F.struct("at", "event_id")

    def when(status, value):
        return F.when(F.col("status").isin(*status), value)

    last = F.max_by(F.struct("status", "result", "error"), at)
    out = events.groupBy("job_id").agg(
        last.alias("_last"),
        F.min(when(["queued"], F.col("at"))).alias("created_at"),
        F.max(when(["processing"], F.col("at"))).alias("started_at"),
        F.max(when(["done", "error"], F.col("at"))).alias("finished_at"),
    )
    return out.select("job_id", "_last.*", "created_at", "started_at", "finished_at")
