"""Streams of events: windows with watermarks, gaps, chunks, playback positions; each also as a batch query.

The transformations take a DataFrame, streaming or not. State is kept by user and bounded by the watermark or by a
few numbers a user.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from setloom.registry import query

LATE = "10 minutes"


def read_events(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder, ``files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def tumbling(events: DataFrame, size: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", size, step)).agg(F.count(F.lit(1)).alias("n"))


def by_session(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))


@query("events_tumbling", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(v) -> DataFrame:
    return tumbling(v.table("events")).select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("events_sliding", "SELECT w AS window_start, count(*) AS n FROM (SELECT time_bucket(INTERVAL '30 minutes', ts) - s.i * INTERVAL '30 minutes' AS w FROM events, (SELECT unnest(range(0, 2)) AS i) s) GROUP BY w")
def events_sliding(v) -> DataFrame:
    return sliding(v.table("events")).select(F.col("window.start").alias("window_start"), "n")


@query(
    "events_sessions",
    """SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM (
 SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""",
)
def events_sessions(v) -> DataFrame:
    return by_session(v.table("events")).select("user_id", F.col("session_window.start").alias("session_start"), "n")


def chunks(events: DataFrame, size: float = 10.0) -> DataFrame:
    """(user_id, chunk, carry): whole chunks of ``size`` that each user's running value fills, and what is left over."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, carry = state.get if state.exists else (0, 0.0)
        for frame in frames:
            for x in frame.sort_values(["ts", "event_id"])["value"]:
                carry += float(x or 0.0)
                while carry >= size:
                    carry -= size
                    done += 1
        state.update((done, carry))
        yield pd.DataFrame({"user_id": [key[0]], "chunk": [done], "carry": [carry]})

    return events.select("user_id", "event_id", "ts", "value").groupBy("user_id").applyInPandasWithState(step, "user_id long, chunk long, carry double", "done long, carry double", "update", GroupStateTimeout.NoTimeout)


def gaps(events: DataFrame, least: float = 3600.0) -> DataFrame:
    """(user_id, gap_start, seconds) of silences of ``least`` seconds or more, as soon as they end."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out: list[tuple] = []
        for frame in frames:
            for t in frame.sort_values("ts")["ts"]:
                now = int(t.value)
                if last is not None and now - last >= least * 1e9:
                    out.append((key[0], pd.Timestamp(last), (now - last) / 1e9))
                last = now if last is None else max(last, now)
        state.update((last,))
        if out:
            yield pd.DataFrame(out, columns=["user_id", "gap_start", "seconds"])

    return events.select("user_id", "ts").groupBy("user_id").applyInPandasWithState(step, "user_id long, gap_start timestamp, seconds double", "last long", "append", GroupStateTimeout.NoTimeout)


@query("silences", "SELECT user_id, p AS gap_start, round(date_diff('microsecond', p, ts) / 1000000e0, 3) AS seconds FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE date_diff('microsecond', p, ts) >= 3600000000")
def silences(v) -> DataFrame:
    """The batch form of ``gaps``."""
    from pyspark.sql import Window

    e = v.table("events").select("user_id", "ts", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts")).alias("p"))
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("p").cast("timestamp"))) / 1e6
    return e.where(seconds >= 3600).select("user_id", F.col("p").alias("gap_start"), F.round(seconds, 3).alias("seconds"))


def heartbeat(events: DataFrame) -> DataFrame:
    """(user_id, played): the largest position reported so far; reports that are negative or no number are ignored."""
    good = events.where((F.col("value") >= 0) & ~F.isnan("value") & (F.col("value") != float("inf")))
    return good.groupBy("user_id").agg(F.max("value").alias("played"))


def upsert_batches(stream: DataFrame, write, checkpoint: str):
    """Starts a query that hands every micro-batch, numbered, to ``write``; a batch number seen before is skipped by its sink."""
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).start()
