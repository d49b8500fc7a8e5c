import datetime as dt

import numpy as np

from spanforge.streaming import alerts

T = dt.datetime(2026, 1, 1)
RULES = {"nest": (True, 0.8), "bird": (False, 0.1)}
SCHEMA = "user long, kind string, value double, ts timestamp, id long"


def events(*rows):
    return [(1, k, v, T + dt.timedelta(seconds=s), i) for k, v, s, i in rows]


def found(df):
    return sorted(r["event_id"] for r in df.collect())


def picked(df):
    return alerts.candidates(df, RULES, ["user", "kind"], "kind", "value", "ts", "id")


def test_thresholds(spark):
    df = spark.createDataFrame(events(("nest", 0.79, 0, 1), ("nest", 0.9, 0, 2), ("nest", float("nan"), 0, 3), ("nest", float("inf"), 0, 4), ("bird", 0.9, 0, 5), ("nest", None, 0, 6), (None, 0.9, 0, 7)), SCHEMA)
    assert found(picked(df)) == [2]


def test_cooldown_counts_from_the_last_alert(spark):
    df = spark.createDataFrame(events(("nest", 0.9, 0, 1), ("nest", 0.95, 0, 2), ("nest", 0.9, 20, 3), ("nest", 0.9, 40, 4), ("nest", 0.9, 69, 5), ("nest", 0.9, 70, 6)), SCHEMA)
    assert found(alerts.cooldown_batch(picked(df), 30)) == [2, 4, 6]
    assert found(alerts.cooldown_batch(picked(df), 0)) == [1, 2, 3, 4, 5, 6]
    assert alerts.emitted(np.array([5.0]), 30, 0.0)[0].tolist() == [False]


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    rows = events(*[("nest", 0.9, s, s) for s in (0, 10, 31, 45, 61, 62, 95)])
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = alerts.cooldown_stream(picked(spark.readStream.schema(SCHEMA).parquet(source)), 30)
        query = stream.writeStream.foreachBatch(alerts.outbox_writer(out)).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    box = spark.read.parquet(out)
    assert found(box) == found(alerts.cooldown_batch(picked(spark.createDataFrame(rows, SCHEMA)), 30)) == [0, 31, 61, 95]
    alerts.outbox_writer(out)(box.drop("sent"), 9)  # a batch that is run again
    assert spark.read.parquet(out).count() == 4
    assert [r["event_id"] for r in alerts.next_to_send(box, 2).collect()] == [0, 31]


def test_windows(spark):
    df = spark.createDataFrame(events(("nest", 1.0, 0, 1), ("nest", 1.0, 50, 2), ("nest", 1.0, 61, 3)), SCHEMA)
    assert sorted(r["n"] for r in alerts.tumbling_counts(df, "ts", "kind", "1 minute").collect()) == [1, 2]
    assert sorted(r["id"] for r in alerts.latest_per_window(df, "ts", "kind", "1 minute").collect()) == [2, 3]
