"""Streaming queries, run to the end of their input."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans.registry import query
from tidewell.shared import shared_folder
from tidewell.streaming import feeds


def _run(stream: DataFrame, label: str, mode: str, rest: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """What the stream wrote by the end of its input, and what ``rest`` makes of the checkpoint, where states are still open."""
    name = f"{label}_{uuid.uuid4().hex[:8]}"
    folder = f"{shared_folder(stream.sparkSession)}/tidewell/{name}"
    if mode == "whole":  # complete, but written by the executors: for results that may be as large as the input
        replace = lambda made, _: made.write.mode("overwrite").parquet(f"{folder}-out")
        stream.writeStream.outputMode("complete").option("checkpointLocation", folder).trigger(availableNow=True).foreachBatch(replace).start().awaitTermination()
        return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}-out")
    if mode != "append":
        return feeds.drain(stream, name, mode, checkpoint=folder)
    stream.writeStream.outputMode("append").option("checkpointLocation", folder).trigger(availableNow=True).format("parquet").start(f"{folder}-out").awaitTermination()
    out = stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}-out")
    return out if rest is None else out.unionByName(rest(folder))


@query("stream_hourly_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(feeds.windowed_counts(feeds.event_stream(spark, sf_dir)), "hourly", "whole")
    return out.select(F.col("started").cast("timestamp_ntz").alias("started"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sliding_counts", """SELECT s AS started, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY 1, 2""")
def stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(feeds.windowed_counts(feeds.event_stream(spark, sf_dir), "1 hour", "30 minutes"), "sliding", "whole")
    return out.select(F.col("started").cast("timestamp_ntz").alias("started"), "event_type", "n")


@query("stream_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
  SELECT user_id, min(ts) AS started, count(*) AS actions FROM k GROUP BY user_id, n""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions, those that the end of the input leaves open too."""
    return _run(feeds.session_counts(feeds.event_stream(spark, sf_dir), late=None), "sessions", "whole").select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "actions")


@query("stream_once", """WITH RECURSIVE o AS (SELECT event_id, user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1
  UNION ALL SELECT n.* FROM (SELECT e.event_id, e.user_id, e.event_type, e.ts FROM events e JOIN o ON e.user_id = o.user_id AND e.event_type = o.event_type AND e.ts >= o.ts + INTERVAL 1 HOUR QUALIFY row_number() OVER (PARTITION BY e.user_id, e.event_type ORDER BY e.ts, e.event_id) = 1) n)
  SELECT event_id, user_id, event_type FROM o""")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event of a user and type within an hour, by the time of the events."""
    stream = feeds.once_within(feeds.event_stream(spark, sf_dir), ["user_id", "event_type"], 3600)
    return _run(stream, "once", "append", lambda folder: feeds.once_rest(spark, folder, stream, 3600)).select("event_id", "user_id", "event_type")


@query("stream_debounced", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
  k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g) SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_action, count(*) AS actions, date_trunc('milliseconds', max(ts)) AS last_ts FROM k GROUP BY user_id, burst""")
def stream_debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last action of every burst, those that the end of the input leaves open too."""
    stream = feeds.debounced(feeds.event_stream(spark, sf_dir), "user_id", 1800)
    return _run(stream, "debounced", "append", lambda folder: feeds.debounced_rest(spark, folder, "user_id")).withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


@query("stream_enriched", "SELECT e.event_id, n.n_name FROM events e LEFT JOIN nation n ON n.n_nationkey = e.user_id % 25 WHERE e.event_type = 'purchase'")
def stream_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("nation"), "n_name")
    rows = feeds.event_stream(spark, sf_dir).where("event_type = 'purchase'").withColumn("nation", F.col("user_id") % 25)
    return _run(feeds.enriched(rows, names, "nation").select("event_id", "n_name"), "enriched", "append")
