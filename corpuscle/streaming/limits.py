"""Sliding-window admission per key, as a stream and as a batch job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.config import scratch_path
from corpuscle.operators.ordering import running_before

_DAY = 86400


def normalized_key(column: str = "key"):
    return F.lower(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))))


def login_failures(events: DataFrame, code: str = "code") -> DataFrame:
    """Failed logins that count: a not yet confirmed account is no failure."""
    return events.filter(F.col(code) != "email_not_confirmed")


def _limiter(max_events: int, window: float):
    """Decide events in time order. `recent` holds accepted times, never more than the maximum."""

    def decide(recent: list, now: float) -> bool:
        while recent and now - recent[0] > window:
            recent.pop(0)
        if len(recent) >= max_events:
            return False
        recent.append(now)
        return True

    return decide


def admit_stream(events: DataFrame, max_events: int, window_seconds: float, delay: str = "10 minutes") -> DataFrame:
    """(key, ts, event_id, admitted) of a stream of (key, ts, event_id).

    State per key is the list of accepted times inside the window; a refused event leaves no
    trace. Event time is used, with a watermark; an idle key's state is dropped.
    """
    out = "key string, ts timestamp, event_id bigint, admitted boolean"
    decide = _limiter(max_events, window_seconds)

    def run(key, batches, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        recent = list(state.get[0]) if state.exists else []
        times = rows["ts"].astype("int64") / 1e9 if str(rows["ts"].dtype).startswith("datetime64[ns") else (
            rows["ts"].astype("datetime64[ns]").astype("int64") / 1e9
        )
        admitted = [decide(recent, t) for t in times]
        state.update((recent,))
        idle = int((times.iloc[-1] + window_seconds) * 1000) + 1
        state.setTimeoutTimestamp(max(idle, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            {"key": key[0], "ts": rows["ts"].to_numpy(), "event_id": rows["event_id"].to_numpy(), "admitted": admitted}
        )

    keyed = events.select(normalized_key().alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return (
        keyed.withWatermark("ts", delay)
        .groupBy("key")
        .applyInPandasWithState(run, out, "recent array<double>", "append", "EventTimeTimeout")
    )


def quiet_sessions(events: DataFrame, window_seconds: float) -> DataFrame:
    """Add `session`: a new one starts after a gap longer than the window.

    No state outlives such a gap, so the sessions of a busy key are independent. The gap to
    the previous event is found inside days; only the last event of each day meets the next.
    """
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    timed = events.withColumn("_s", seconds).withColumn("_day", F.floor(F.col("_s") / _DAY))
    inside = Window.partitionBy("key", "_day").orderBy("_s", "event_id")
    days = timed.groupBy("key", "_day").agg(F.max("_s").alias("_end"))
    previous = Window.partitionBy("key").orderBy("_day")
    carried = days.select("key", "_day", F.lag("_end").over(previous).alias("_carried"))
    lagged = timed.withColumn("_before", F.lag("_s").over(inside)).join(carried, ["key", "_day"])
    gap = F.col("_s") - F.coalesce("_before", "_carried")
    flagged = lagged.withColumn("_new", F.coalesce((gap > window_seconds).cast("bigint"), F.lit(1)))
    counted = running_before(
        flagged, ["key"], [F.col("_s"), F.col("event_id")], F.col("_day"), {"_earlier": F.col("_new")}
    )
    return counted.withColumn("session", F.col("_earlier") + F.col("_new")).drop(
        "_day", "_before", "_carried", "_new", "_earlier"
    )


RANGE_EVENTS = 100_000


def admit_batch(events: DataFrame, max_events: int, window_seconds: float, range_events: int = RANGE_EVENTS) -> DataFrame:
    """The same decisions over a finished table of (key, ts, event_id).

    Events are cut into ranges of (key, time) of about `range_events`, so a single key with all events is spread like any other.
    A range is first decided as if nothing came before it. What it leaves behind, at most `max_events` accepted times, is
    handed to the next range if that goes on with the same key, and only ranges that were handed something else than they
    had assumed are decided again, until none is. Decisions forget where they started after some windows, so that a few rounds
    do for ordinary streams; at worst the ranges of one key are decided one after the other. One summary per range reaches the driver.
    """
    keyed = events.select(normalized_key().alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("_s"), "event_id")
    spark, order = events.sparkSession, ["key", "_s", "event_id"]
    n_ranges = keyed.count() // range_events + 1
    ranged = keyed.repartitionByRange(n_ranges, *order).withColumn("_range", F.spark_partition_id())
    states: dict[int, list[float]] = {}
    if n_ranges > 1:
        path = scratch_path(spark, "event-ranges")
        ranged.write.partitionBy("_range").parquet(path)
        ranged = spark.read.schema(ranged.schema).parquet(path)
        states = _handed_on(ranged, max_events, window_seconds, order)
    decide = _limiter(max_events, window_seconds)

    def run(key, pdf):
        return _decided(pdf.sort_values(order, kind="stable"), states.get(int(key[0]), []), decide)[0][["key", "event_id", "admitted"]]

    return ranged.groupBy("_range").applyInPandas(run, f"key string, event_id {keyed.schema['event_id'].dataType.simpleString()}, admitted boolean")


def _decided(pdf, state: list[float], decide):
    """Ordered events with their verdicts, and the accepted times that the last key leaves behind; `state` is the first key's."""
    current, recent, verdicts = pdf["key"].iat[0], list(state), []
    for key, at in zip(pdf["key"].tolist(), pdf["_s"].tolist()):
        if key != current:
            current, recent = key, []
        verdicts.append(decide(recent, at))
    return pdf.assign(admitted=verdicts), recent


def _handed_on(ranged: DataFrame, max_events: int, window: float, order: list[str]) -> dict[int, list[float]]:
    """Per range the accepted times inside the window that its first key brings along."""
    decide = _limiter(max_events, window)
    known: dict[int, dict] = {}
    states: dict[int, list[float]] = {}
    todo = None
    while todo is None or todo:
        assumed = dict(states)

        def summarize(key, pdf):
            import pandas as pd

            pdf = pdf.sort_values(order, kind="stable")
            left = _decided(pdf, assumed.get(int(key[0]), []), decide)[1]
            first, last = pdf.iloc[0], pdf.iloc[-1]
            return pd.DataFrame({"_range": [key[0]], "first_key": [first["key"]], "first_s": [first["_s"]], "last_key": [last["key"]], "left": [left]})

        asked = ranged if todo is None or len(todo) > 1000 else ranged.filter(F.col("_range").isin(sorted(todo)))
        found = asked.groupBy("_range").applyInPandas(summarize, "_range int, first_key string, first_s double, last_key string, left array<double>")
        known |= {r["_range"]: r for r in found.collect()}
        todo, before = set(), None
        for number in sorted(known):
            row = known[number]
            goes_on = before is not None and before["last_key"] == row["first_key"]
            brought = [t for t in before["left"] if row["first_s"] - t <= window] if goes_on else []
            if brought != states.get(number, []):
                states[number] = brought
                todo.add(number)
            before = row
    return states


def window_counts(events: DataFrame, window: str = "5 minutes", slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Events per key and overlapping window, for monitoring; batch or stream."""
    keyed = events.select(normalized_key().alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    if events.isStreaming:
        keyed = keyed.withWatermark("ts", delay)
    counts = keyed.groupBy("key", F.window("ts", window, slide).alias("_w")).agg(F.count(F.lit(1)).alias("events"))
    return counts.select("key", F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "events")
