import json

from pyspark.sql import functions as F

from umbel.runtime import scratch_path
from umbel.streaming import refresh


def published(spark):
    rows = [("1", 5, "2024-01-01"), ("2", 5, None), ("3", 5, "2023-01-01"), ("4", 5, "2024-01-01"), ("5", None, None)]
    return spark.createDataFrame(rows, "code string, published long, d string").select("code", "published", F.to_timestamp("d").alias("last_check"))


def event(code, live, at, kind="live-check"):
    return {"kind": kind, "orphaCode": code, "publishedTotal": 5, "liveTotal": live, "ranAt": at}


def write(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(e) for e in events) + "\nnot json\n")


def run(spark, feed, table, rejects, place):
    for q in refresh.run_refresh(spark, str(feed), published(spark), table, rejects, place):
        q.awaitTermination()
    return {r["code"]: r["reason"] for r in refresh.read_queue(spark, table).collect()}


def test_stream_merges_by_event_time(spark, tmp_path):
    feed, table, place = tmp_path / "feed", scratch_path(spark, "q"), scratch_path(spark, "cp")
    rejects = scratch_path(spark, "rej")
    write(feed, "a.json", [
        event("1", 9, "2024-01-10T00:00:00Z"), event("2", 5, "2024-01-10T00:00:00Z"), event("3", 5, "2024-01-10T00:00:00Z"),
        event("4", 5, "2024-01-10T00:00:00Z"), event("5", 5, "2024-01-10T00:00:00Z"), event("x", 5, "2024-01-10T00:00:00Z"),
        {**event("1", 5, "2024-01-10T00:00:00Z"), "liveTotal": "many"},
    ])
    assert run(spark, feed, table, rejects, place) == {"1": "live-delta", "2": "missing-last-check", "3": "stale-check"}
    assert spark.read.json(rejects).count() == 2
    # A late event does not replace a newer one; a new one moves the window on.
    write(feed, "b.json", [event("2", 7, "2024-01-09T00:00:00Z"), event("1", 8, "2024-01-23T12:00:00Z")])
    got = run(spark, feed, table, rejects, place)
    assert got == {"1": "live-delta", "2": "missing-last-check", "3": "stale-check"}
    write(feed, "c.json", [event("4", 8, "2024-01-24T12:00:00Z")])
    assert run(spark, feed, table, rejects, place) == {"1": "live-delta", "4": "live-delta"}


def test_two_runs_without_a_checkpoint_lose_nothing(spark, tmp_path):
    feed, table, rejects = tmp_path / "feed", scratch_path(spark, "q"), scratch_path(spark, "rej")
    write(feed, "a.json", [event("1", 9, "2024-01-10T00:00:00Z")])
    assert run(spark, feed, table, rejects, None) == {"1": "live-delta"}
    write(feed, "b.json", [event("4", 8, "2024-01-11T00:00:00Z"), event("2", 5, "2124-01-01T00:00:00Z")])
    # An event dated in the future stays, and does not empty the queue.
    assert run(spark, feed, table, rejects, None) == {"1": "live-delta", "4": "live-delta", "2": "missing-last-check"}
    assert len(refresh._versions(spark, table)) <= 2


def test_replayed_batch_changes_nothing(spark):
    table = scratch_path(spark, "q")
    batch = spark.createDataFrame([("1", "live-delta", 9, 5, "2024-01-10")], "code string, reason string, live_total long, published_total long, d string").withColumn("at", F.to_timestamp("d"))
    merge = refresh.merge_into_queue(table)
    merge(batch, 0)
    merge(batch.withColumn("reason", F.lit("other")), 0)
    assert [r["reason"] for r in refresh.read_queue(spark, table).collect()] == ["live-delta"]
    merge(batch.limit(0), 1)
    assert refresh.read_queue(spark, table).count() == 1


def test_batch_queue_keeps_undated_and_last_event(spark):
    rows = [("refresh-queue", "1", "2024-01-20", 1, "a"), ("live-check", "2", None, 2, "b"), ("other", "3", "2024-01-20", 3, "c"),
            ("live-check", "1", "2024-01-21", 4, "d"), ("live-check", "4", "2024-01-01", 5, "e"), ("live-check", "x", "2024-01-21", 6, "f")]
    e = spark.createDataFrame(rows, "kind string, code string, d string, seq long, reason string").withColumn("at", F.to_timestamp("d"))
    got = refresh.refresh_queue(e, F.lit("2024-01-22").cast("timestamp")).collect()
    assert [(r["code"], r["reason"]) for r in got] == [("2", "b"), ("1", "d")]
