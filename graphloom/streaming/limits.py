"""The time-driven rules as relations over a log of calls, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sliding_limit(calls: DataFrame, key: str, time: str = "ts", seconds: int = 60, most: int = 10, *tie: str) -> DataFrame:
    """Calls with ``within``, the earlier calls of their key in the last ``seconds``, and whether they would be
    let through. Every call counts, let through or not."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    span = Window.partitionBy(key).orderBy(at).rangeBetween(-(seconds * 1_000_000) + 1, 0)
    same = Window.partitionBy(key, time).orderBy(*(tie or (time,)))
    counted = calls.withColumn("within", F.count("*").over(span) - F.count("*").over(Window.partitionBy(key, time)) + F.row_number().over(same) - 1)
    return counted.withColumn("allowed", F.col("within") < most)


def daily_cap(calls: DataFrame, time: str = "ts", most: int = 200, *tie: str) -> DataFrame:
    """The first ``most`` calls of each UTC day are let through."""
    day = F.to_date(F.col(time).cast("timestamp"))
    order = Window.partitionBy("day").orderBy(time, *tie)
    return calls.withColumn("day", day).withColumn("nth", F.row_number().over(order)).withColumn("allowed", F.col("nth") <= most)


def one_per(calls: DataFrame, key: str, time: str = "ts", unit: str = "hour", *tie: str) -> DataFrame:
    """The first call of each key and hour is let through."""
    slot = F.date_trunc(unit, F.col(time).cast("timestamp"))
    nth = F.row_number().over(Window.partitionBy(key, slot).orderBy(time, *tie))
    return calls.withColumn("allowed", nth == 1)


def calls_per_minute(stream: DataFrame, key: str, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """R01 as a stream: calls of each key in each minute, late ones within the watermark counted."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 minute"), key).agg(F.count("*").alias("calls")).select(F.col("window.start").alias("start"), key, "calls")


def live_sessions(touches: DataFrame, key: str, time: str = "ts", idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """R04 as a stream or batch: sessions that end after ``idle`` without a touch. Start and end are aggregates rather than
    fields of the window: a filter on the window's own end would be pushed below the merging of sessions and split them."""
    sessions = touches.withWatermark(time, late).groupBy(F.session_window(time, idle).alias("s"), key)
    return sessions.agg(F.min(time).alias("start"), (F.max(time) + F.expr(f"interval {idle}")).alias("expires"), F.count("*").alias("touches")).drop("s")


def kept_sessions(sessions: DataFrame, now: str, most: int = 10) -> DataFrame:
    """Sessions not yet expired, the most recently used ones up to a number."""
    return sessions.where(F.col("expires") > F.to_timestamp(F.lit(now))).orderBy(F.desc("expires")).limit(most)


def kept_jobs(events: DataFrame, now: str, seconds: int = 1800, most: int = 100) -> DataFrame:
    """(job_id, last_ts) of the jobs whose last event is not too old, the latest ones up to a number."""
    last = events.groupBy("job_id").agg(F.max("ts").alias("last_ts"))
    fresh = last.where(F.unix_timestamp(F.col("last_ts").cast("timestamp")) > F.unix_timestamp(F.to_timestamp(F.lit(now))) - seconds)
    return fresh.orderBy(F.desc("last_ts"), "job_id").limit(most)


def replay_then_live(kept: DataFrame, live: DataFrame) -> DataFrame:
    """A job's events as a late reader gets them: all kept ones in order, then those of the live log that are newer than the last kept
    one. (job_id, ts, event_id) rows; the two logs may overlap."""
    last = kept.groupBy("job_id").agg(F.max(F.struct("ts", "event_id")).alias("__last"))
    new = live.join(last, "job_id", "left").where(F.col("__last").isNull() | (F.struct("ts", "event_id") > F.col("__last"))).select("job_id", "ts", "event_id")
    both = kept.select("job_id", "ts", "event_id", F.lit(False).alias("live")).unionByName(new.withColumn("live", F.lit(True)))
    return both.withColumn("n", F.row_number().over(Window.partitionBy("job_id").orderBy("ts", "event_id")))


def job_log(events: DataFrame) -> DataFrame:
    """Each job's events in order, and its last state."""
    order = Window.partitionBy("job_id").orderBy("ts", "event_id")
    return events.withColumn("n", F.row_number().over(order)).withColumn("is_last", F.lead("event_id").over(order).isNull())
