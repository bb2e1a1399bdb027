"""Job tracking as streams: current state, stale jobs, idempotent admission."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from corpuscle.config import DEFAULTS
from corpuscle.functions import vocab as V
from corpuscle.operators.jobs import PAIR, admit_jobs, job_state


def job_state_stream(events: DataFrame) -> DataFrame:
    """Running state per job from the log stream; write it in update or complete mode."""
    return job_state(events)


def stale_job_stream(
    events: DataFrame, seconds: int = DEFAULTS.job_stale_seconds, delay: str = "0 seconds", retention_seconds: int = 86400
) -> DataFrame:
    """Emit (job_id, status, error, finished_at) for jobs that end or go stale.

    `events`: job_id, status, at. A job that stays active longer than `seconds` of event time
    after its last start (or creation) becomes an error. A terminal state is final; it is
    remembered for `retention_seconds` of event time, then its state is dropped.
    """
    active, message = V.ACTIVE_JOB_STATUSES, V.STALE_JOB_MESSAGE

    def run(key, batches, state):
        import pandas as pd

        def row(status, error, at):
            return pd.DataFrame({"job_id": [key[0]], "status": [status], "error": [error], "finished_at": [at]})

        def remember(since):
            state.update(("closed", since))
            keep = since // 1000 + (seconds + retention_seconds) * 1000
            state.setTimeoutTimestamp(max(keep, state.getCurrentWatermarkMs() + 1))

        if state.hasTimedOut:
            status, since = state.get
            if status == "closed":
                state.remove()
                return
            remember(since)
            yield row("error", message, pd.Timestamp(since + seconds * 1_000_000, unit="us"))
            return
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        status, since = state.get if state.exists else ("", 0)
        for s, at in zip(rows["status"], rows["at"]):
            if status == "closed":
                continue
            micros = pd.Timestamp(at).value // 1000
            if status in active and micros - since > seconds * 1_000_000:
                status = "closed"
                yield row("error", message, pd.Timestamp(since + seconds * 1_000_000, unit="us"))
            elif s in active:
                status, since = s, micros
            else:
                status = "closed"
                yield row(s, None, at)
        if status == "closed":
            remember(max(since, pd.Timestamp(rows["at"].iloc[-1]).value // 1000))
        else:
            state.update((status, since))
            due = (since + seconds * 1_000_000) // 1000 + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    timed = events.select("job_id", "status", F.col("at").cast("timestamp").alias("at")).withWatermark("at", delay)
    return timed.groupBy("job_id").applyInPandasWithState(
        run,
        f"job_id {events.schema['job_id'].dataType.simpleString()}, status string, error string, finished_at timestamp",
        "status string, since bigint",
        "append",
        "EventTimeTimeout",
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """State by key and timer lives in RocksDB: start a stream of `closed_jobs_stream` inside."""
    before = spark.conf.get(_STATE_STORE)
    spark.conf.set(_STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_STATE_STORE, before)


_OPEN = "status string, created bigint, started bigint, since bigint, closed boolean"
_CLOSED = "status string, result string, error string, created_at timestamp, started_at timestamp, finished_at timestamp"


def closed_jobs_stream(
    events: DataFrame, seconds: int = DEFAULTS.job_stale_seconds, delay: str = "10 minutes", retention_seconds: int = 86400
) -> DataFrame:
    """Every job once, when it ends or goes stale: job_id, status, result, error and its three times.

    `events`: job_id, at, status, result, error. Append the result to a table of closed jobs: the stream itself holds open jobs and, for
    `retention_seconds` of event time after their end, the bare keys of closed ones, so that whatever still comes for them
    is ignored. Both end by timers: an open job at the time it goes stale, a closed one after its retention, which should
    be longer than `delay`; still later events are behind the watermark and never reach the state.
    """
    active, message = V.ACTIVE_JOB_STATUSES, V.STALE_JOB_MESSAGE
    limit, kept = seconds * 1_000_000, retention_seconds * 1000

    class Tracker(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle, self.job = handle, handle.getValueState("job", _OPEN)

        def _row(self, key, status, result, error, job, finished):
            import pandas as pd

            at = lambda micros: pd.Timestamp(micros, unit="us") if micros is not None else pd.NaT
            return pd.DataFrame({
                "job_id": [key[0]], "status": [status], "result": [result], "error": [error],
                "created_at": [at(job[1])], "started_at": [at(job[2])], "finished_at": [at(finished)],
            })

        def _wake(self, millis: int, times) -> None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(millis, times.getCurrentWatermarkInMs() + 1))

        def _close(self, job, finished: int, times) -> None:
            self.job.update((*job[:4], True))
            self._wake(finished // 1000 + kept, times)

        def handleInputRows(self, key, rows, timerValues):
            job = tuple(self.job.get()) if self.job.exists() else ("", None, None, 0, False)
            if job[4]:
                return
            # A job has a handful of events; those of one batch are read in the order of their times.
            news = sorted(((r.at.value // 1000, r.status, r.result, r.error) for pdf in rows for r in pdf.itertuples()), key=lambda r: r[0])
            for micros, status, result, error in news:
                if job[0] in active and micros - job[3] > limit:
                    yield self._row(key, "error", None, message, job, job[3] + limit)
                    self._close(job, job[3] + limit, timerValues)
                    return
                if status not in active:
                    yield self._row(key, status, result, error, job, micros)
                    self._close(job, micros, timerValues)
                    return
                created = micros if job[1] is None and status == active[0] else job[1]
                started = micros if status != active[0] else job[2]
                job = (status, created, started, micros, False)
            self.job.update(job)
            self._wake((job[3] + limit) // 1000 + 1, timerValues)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            job = tuple(self.job.get())
            if job[4]:
                self.job.clear()
                return
            yield self._row(key, "error", None, message, job, job[3] + limit)
            self._close(job, job[3] + limit, timerValues)

        def close(self) -> None:
            pass

    timed = events.select("job_id", F.col("at").cast("timestamp").alias("at"), "status", "result", "error").withWatermark("at", delay)
    out = f"job_id {events.schema['job_id'].dataType.simpleString()}, {_CLOSED}"
    return timed.groupBy("job_id").transformWithStateInPandas(Tracker(), out, "Append", "EventTime")


def admit_batches(read_jobs, write_jobs, now, seconds: int = DEFAULTS.job_stale_seconds, pair: tuple[str, ...] = PAIR):
    """A `foreachBatch` function that admits requests against the live jobs.

    `read_jobs()` returns the current jobs and `write_jobs(df, batch_id)` stores the admitted
    ones; writing by batch id makes a repeated batch harmless.
    """

    def run(requests: DataFrame, batch_id: int) -> None:
        admitted = admit_jobs(requests, read_jobs(), now, seconds, pair)
        write_jobs(admitted, batch_id)

    return run


def first_requests(requests: DataFrame, within: str = "5 minutes", pair: tuple[str, ...] = PAIR) -> DataFrame:
    """The first request of each pair inside the time bound; repeats are dropped."""
    timed = requests.withColumn("requested_at", F.col("requested_at").cast("timestamp"))
    return timed.withWatermark("requested_at", within).dropDuplicatesWithinWatermark(list(pair))
