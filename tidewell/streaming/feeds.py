"""Streams: change feeds, debounced actions, event-time windows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout

if TYPE_CHECKING:
    import pandas as pd


#: Before the time of any event, in microseconds.
NEVER = -(2**62)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream with an event time that takes watermarks."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums by event-time window and type; rows later than ``late`` are dropped once their window closed."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    made = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """Sessions of a user; without ``late`` no row is too late and no session closes, for complete mode."""
    made = (events.withWatermark("ts", late) if late else events).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("actions"))
    return made.select("user_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "actions")


def _first_in_gap(kept: int, waiting: list[tuple[int, int]], gap: int) -> tuple[int, list[int]]:
    """The last kept time and the ids kept of events (time, id) in order: each that comes ``gap`` or more after the last one kept."""
    ids = []
    for at, event in waiting:
        if at - kept >= gap:
            kept = at
            ids.append(event)
    return kept, ids


def once_within(events: DataFrame, keys: list[str], gap_seconds: int, late: str = "1 hour") -> DataFrame:
    """(event_id, keys): the events, in order of their time, with none of their keys kept in the gap before them.

    An event waits in the state until the watermark has passed it, as an earlier one may still come, so that the result
    does not depend on how the input is cut into micro-batches; what still waits at the end of the input is in
    :func:`once_rest`. State is the last kept time and the waiting events of each key."""
    gap = gap_seconds * 1_000_000

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        import pandas as pd

        kept, times, ids = state.get if state.exists else (NEVER, [], [])
        waiting, out = list(zip(times, ids)), []
        if not state.hasTimedOut:
            for rows in batches:
                waiting += zip(rows["at"].tolist(), rows["event_id"].tolist())
            out = [x[1] for x in waiting if x[0] == NEVER]  # without a time nothing tells that it is a repetition
            waiting = [x for x in waiting if x[0] != NEVER]
        waiting.sort()
        passed = state.getCurrentWatermarkMs() * 1000
        kept, now = _first_in_gap(kept, [x for x in waiting if x[0] <= passed], gap)
        out += now
        waiting = [x for x in waiting if x[0] > passed]
        if not waiting and passed - kept >= gap:
            state.remove()
        else:
            state.update((kept, [x[0] for x in waiting], [x[1] for x in waiting]))
            until = waiting[0][0] if waiting else kept + gap
            state.setTimeoutTimestamp(max(until // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({"event_id": out} | {c: [v] * len(out) for c, v in zip(keys, k)})

    told = events.withWatermark("ts", late).select(*keys, "ts", F.coalesce(F.unix_micros("ts"), F.lit(NEVER)).alias("at"), "event_id")
    schema = ", ".join(f"{c} {told.schema[c].dataType.simpleString()}" for c in ["event_id", *keys])
    return told.groupBy(*keys).applyInPandasWithState(run, schema, "kept bigint, times array<bigint>, ids array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def once_rest(spark: SparkSession, checkpoint: str, stream: DataFrame, gap_seconds: int) -> DataFrame:
    """What :func:`once_within` still holds back at the end of its input, decided without waiting."""
    keys, gap = stream.columns[1:], gap_seconds * 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for rows in batches:
            rows["event_id"] = [_first_in_gap(kept, sorted(zip(times, ids)), gap)[1] for kept, times, ids in zip(rows["kept"], rows["times"], rows["ids"])]
            yield rows[["event_id", *keys]]

    held = open_states(spark, checkpoint, keys).where(F.size("times") > 0)
    schema = ", ".join(f"{c} {'array<bigint>' if c == 'event_id' else stream.schema[c].dataType.simpleString()}" for c in stream.columns)
    return held.mapInPandas(run, schema).withColumn("event_id", F.explode("event_id"))


def open_states(spark: SparkSession, checkpoint: str, keys: list[str]) -> DataFrame:
    """Keys and state of the groups that a stopped query of one stateful operator left in its checkpoint."""
    held = spark.read.format("statestore").load(checkpoint)
    return held.select(*[F.col(f"key.{n}") for n in keys], "value.groupState.*")


def debounced(events: DataFrame, key: str, gap_seconds: int, late: str = "1 hour") -> DataFrame:
    """(key, last_action, actions, last_ts): the last action of each burst of a key, once it has been silent for the gap.

    State is one row per key. A burst is emitted when a later event of the key shows that it ended or when the watermark
    passes its end, so a lost task repeats nothing; bursts still open at the end of the input are in :func:`debounced_rest`."""
    gap = gap_seconds * 1000

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        import pandas as pd

        action, count, last = state.get if state.exists else (None, 0, 0)
        out = []
        if state.hasTimedOut:
            out.append((k[0], action, count, pd.Timestamp(last, unit="ms")))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            for what, at in zip(rows["event_type"], rows["ts"]):
                now = int(at.timestamp() * 1000)
                if count and now - last > gap:
                    out.append((k[0], action, count, pd.Timestamp(last, unit="ms")))
                    count = 0
                action, count, last = what, count + 1, max(last, now)
            state.update((action, count, last))
            state.setTimeoutTimestamp(max(last + gap, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "last_action", "actions", "last_ts"])

    kept = events.withWatermark("ts", late).select(key, "ts", "event_id", "event_type")
    return kept.groupBy(key).applyInPandasWithState(run, f"{key} bigint, last_action string, actions bigint, last_ts timestamp", "action string, count bigint, last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def debounced_rest(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """The bursts that :func:`debounced` still holds open at the end of its input."""
    held = open_states(spark, checkpoint, [key]).where("count > 0")
    return held.select(key, F.col("action").alias("last_action"), F.col("count").alias("actions"), F.timestamp_millis("last").alias("last_ts"))


def enriched(events: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """A stream joined with a static table."""
    return events.join(facts, key, "left")


def drain(stream: DataFrame, name: str, mode: str = "append", *, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all there is and return what it wrote, as a table in memory; for tests and small results."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    running = writer.start()
    running.awaitTermination()
    return stream.sparkSession.table(name)


def apply_changes(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Feed each micro-batch of changes to ``write`` exactly once per epoch; ``write`` must be repeatable."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Telemetry(StreamingQueryListener):
    """Collects what streams report, for logs and tests: their start, rows of each batch, and how they ended."""

    def __init__(self, most: int = 1000) -> None:
        self.events: deque[dict[str, Any]] = deque(maxlen=most)

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802
        self.events.append({"event": "started", "id": str(event.id)})

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        self.events.append({"event": "batch", "id": str(event.progress.id), "batch": event.progress.batchId, "rows": event.progress.numInputRows})

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        self.events.append({"event": "ended", "id": str(event.id), "error": event.exception})
