"""Streams against brute force, whatever the micro-batches."""

import datetime

from tidewell.plans import registry, streams
from tidewell.streaming import feeds

FOLDER = "/root/testdata/sf0.001"


def events(spark, folder=FOLDER):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/events.parquet").select("event_id", "user_id", "event_type", "ts").orderBy("ts", "event_id").collect()]


def once(rows, gap):
    kept, out = {}, set()
    for r in rows:
        key = r["user_id"], r["event_type"]
        if key not in kept or r["ts"] - kept[key] >= gap:
            kept[key] = r["ts"]
            out.add(r["event_id"])
    return out


def test_once_keeps_repetitions_after_the_hour(spark):
    rows = events(spark)
    expected = once(rows, datetime.timedelta(hours=1))
    got = [r["event_id"] for r in registry.queries()["stream_once"](spark, FOLDER).collect()]
    assert len(expected) > len({(r["user_id"], r["event_type"]) for r in rows})
    assert len(got) == len(set(got)) and set(got) == expected


def test_once_does_not_depend_on_micro_batches(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(n, n % 2, start + datetime.timedelta(minutes=17 * n)) for n in range(60)]
    rows[10:14] = rows[13:9:-1]  # out of order, within the lateness
    parts = tmp_path / "in"
    parts.mkdir()
    for n in range(0, 60, 12):
        frame = spark.createDataFrame(rows[n : n + 12], "event_id bigint, user_id bigint, ts timestamp")
        frame.coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        next((tmp_path / f"w{n}").glob("*.parquet")).rename(parts / f"{n:03}.parquet")

    def run(files):
        read = spark.readStream.schema("event_id bigint, user_id bigint, ts timestamp").option("maxFilesPerTrigger", files).parquet(str(parts))
        stream = feeds.once_within(read, ["user_id"], 3600, "2 hours")
        out = streams._run(stream, "once_test", "append", lambda folder: feeds.once_rest(spark, folder, stream, 3600))
        return sorted(r["event_id"] for r in out.collect())

    brute = sorted(once([{"event_id": e, "user_id": u, "event_type": "", "ts": t} for e, u, t in sorted(rows, key=lambda r: (r[2], r[0]))], datetime.timedelta(hours=1)))
    assert run(1) == run(99) == brute


def bursts(rows, gap, closes):
    """[user, first ts, last event type, events, last ts] of the runs of a user's events, apart by ``closes(distance, gap)``."""
    out, open_ = [], {}
    for r in rows:
        b = open_.get(r["user_id"])
        if b is None or closes(r["ts"] - b[4], gap):
            b = open_[r["user_id"]] = [r["user_id"], r["ts"], None, 0, None]
            out.append(b)
        b[2:] = [r["event_type"], b[3] + 1, r["ts"]]
    return out


def test_open_sessions_are_there(spark):
    expected = bursts(events(spark), datetime.timedelta(minutes=30), lambda d, gap: d >= gap)
    got = registry.queries()["stream_sessions"](spark, FOLDER).collect()
    assert sorted((r["user_id"], r["started"], r["actions"]) for r in got) == sorted((b[0], b[1], b[3]) for b in expected)


def test_open_bursts_are_there(spark):
    milli = lambda t: t.replace(microsecond=t.microsecond // 1000 * 1000)
    expected = bursts(events(spark), datetime.timedelta(minutes=30), lambda d, gap: d > gap)
    got = registry.queries()["stream_debounced"](spark, FOLDER).collect()
    assert sorted((r["user_id"], milli(r["last_ts"]), r["last_action"], r["actions"]) for r in got) == sorted((b[0], milli(b[4]), b[2], b[3]) for b in expected)
