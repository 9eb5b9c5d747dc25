"""Sanitization jobs as streams: bounded intake, states, expiry, latencies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT

#: States of a job in order; the last two are final.
STATES = ["queued", "processing", "completed", "failed"]
FINAL = STATES[2:]


def intake(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", queue_size: int = DEFAULT.queue_size) -> DataFrame:
    """A stream of files of which a batch takes ``queue_size`` at most; the rest waits."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", queue_size).load(path)


def work(jobs: DataFrame, process: Callable[[DataFrame], DataFrame], results: str, statuses: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run ``process`` on each batch of jobs (with job_id); write its results and every job's final status.

    If a batch fails its jobs are run again in halves, so that in the end only those that
    fail on their own are ``failed``, each with its error; the stream goes on. A batch's
    folders are named by its number and overwritten, so a batch that is run again after a
    crash writes nothing twice.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        place, failed = f"{results}/batch={number}", []

        def attempt(rows: DataFrame, ids: list | None, mode: str) -> None:
            try:
                process(rows).write.mode(mode).parquet(place)
            except Exception as e:  # noqa: BLE001 - whatever it was, it is the job's error
                if ids is None:  # no more than one batch's jobs
                    ids = [r["job_id"] for r in batch.select("job_id").distinct().orderBy("job_id").collect()]
                if len(ids) < 2:
                    failed.extend((x, str(e)[:400]) for x in ids)
                    return
                half = len(ids) // 2
                for part in (ids[:half], ids[half:]):
                    attempt(batch.where(F.col("job_id").isin(part)), part, "append")

        attempt(batch, None, "overwrite")
        done = batch.select("job_id").distinct()
        bad = batch.sparkSession.createDataFrame(failed, T.StructType([batch.schema["job_id"], T.StructField("error", T.StringType())]))
        done = done.join(bad, "job_id", "left").withColumn("status", F.when(F.col("error").isNull(), "completed").otherwise("failed"))
        done.select("job_id", "status", "error", F.current_timestamp().alias("updated_at")).write.mode("overwrite").parquet(f"{statuses}/batch={number}")
        batch.unpersist()

    writer = jobs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def state_rank(status):
    return F.array_position(F.array(*map(F.lit, STATES)), F.col(status))


def latest_states(events: DataFrame, job: str = "job_id", status: str = "status", ts: str = "ts", tie: str | None = None) -> DataFrame:
    """The last status of every job, of a batch or a stream; of equal times the later state wins."""
    order = F.struct(F.col(ts), F.col(tie) if tie else state_rank(status))
    return events.groupBy(job).agg(F.max_by(status, order).alias("status"), F.max(ts).alias("updated_at"))


def visible(states: DataFrame, now, ttl_seconds: int = DEFAULT.job_ttl_seconds) -> DataFrame:
    """States without final ones whose last change lies more than the limit back; waiting jobs never expire."""
    expired = F.col("status").isin(FINAL) & (F.col("updated_at") < now - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return states.where(~expired)


def job_status(records: DataFrame, statuses: DataFrame) -> DataFrame:
    """``records`` (job_id, status) with progress: the one reported, else 1 for completed jobs and 0 for others."""
    rows = records.join(statuses.select("job_id", "progress", "message"), "job_id", "left")
    default = F.when(F.col("status") == "completed", 1.0).otherwise(0.0)
    return rows.withColumn("progress", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("progress", default)))).withColumn("message", F.coalesce("message", "status"))


def distinct_events(events: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ("event_id",), delay: str = "30 minutes") -> DataFrame:
    """A stream without repeats of a key within ``delay``; state older than that is dropped."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(events: DataFrame, width: str = "10 minutes", by: str = "event_type", ts: str = "ts", delay: str = "30 minutes") -> DataFrame:
    """Events by tumbling window and kind; windows close when the watermark passes them."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def newest(logs: DataFrame, n: int = 120, ts: str = "ts") -> DataFrame:
    """The last ``n`` log rows, newest first."""
    return logs.orderBy(F.desc(ts), *(F.desc(c) for c in logs.columns if c != ts)).limit(n)


def observed(df: DataFrame, stage: str):
    """``df`` that counts its rows as it runs, and the observation to read the count from."""
    from pyspark.sql import Observation

    seen = Observation(stage)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def stage_seconds(timings: DataFrame) -> DataFrame:
    """Seconds by stage over events (job_id, stage, seconds)."""
    return timings.groupBy("job_id", "stage").agg(F.sum("seconds").alias("seconds"))
