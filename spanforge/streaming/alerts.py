"""The alert stream: thresholds, a cooldown per key, a durable outbox, and counts per window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanforge.operators.matching import fold
from spanforge.session import exists

ALERT = "key string, event_id bigint, ts timestamp, confidence double"


def candidates(events: DataFrame, rules: dict[str, tuple[bool, float]], key: list[str], kind: str, confidence: str, ts: str, event_id: str) -> DataFrame:
    """(key, event_id, ts, confidence) of events that an enabled rule lets pass; missing, NaN and infinite confidences don't."""
    least = F.lit(None).cast("double")
    for name, (enabled, floor) in rules.items():
        if enabled:
            least = F.when(F.col(kind) == name, F.lit(floor)).otherwise(least)
    c = F.col(confidence).cast("double")
    good = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) & (c >= least)
    return events.where(good).select(F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("key"), F.col(event_id).cast("bigint").alias("event_id"), F.col(ts).cast("timestamp").alias("ts"), c.alias("confidence"))


def emitted(seconds: np.ndarray, cooldown: float, last: float | None = None) -> tuple[np.ndarray, float | None]:
    """Which of the sorted times emit: the first, then each at least ``cooldown`` after the last that did."""
    out = np.zeros(len(seconds), bool)
    for i, t in enumerate(seconds):
        if last is None or t - last >= cooldown:
            out[i], last = True, float(t)
    return out, last


def cooldown_batch(rows: DataFrame, cooldown: float) -> DataFrame:
    """The alerts of a table of candidates. Of candidates at one time the surest comes first, then the least id."""

    def kernel(group: dict[str, np.ndarray]) -> list[tuple]:
        t = group["micros"] / 1e6
        keep, _ = emitted(t, cooldown)
        return [(int(group["event_id"][i]), float(group["confidence"][i]), int(group["micros"][i])) for i in np.flatnonzero(keep)]

    timed = rows.select("key", "event_id", "confidence", F.unix_micros("ts").alias("micros")).withColumn("surest", -F.col("confidence"))
    # A candidate that comes a cooldown after the one before it always emits, so the rows of a key are cut there: a
    # busy key is many small folds.
    order = Window.partitionBy("key").orderBy("micros")
    gap = F.coalesce((F.col("micros") - F.lag("micros").over(order) >= F.lit(int(cooldown * 1e6))).cast("int"), F.lit(0)) if cooldown > 0 else F.lit(0)
    cut = timed.withColumn("gap", gap).withColumn("part", F.sum("gap").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    cut = cut.withColumn("run", F.to_json(F.struct("key", "part"))).drop("gap", "part", "key")
    out = fold(cut, "run", ["micros", "surest", "event_id"], kernel, "run string, event_id bigint, confidence double, micros bigint")
    return out.select(F.get_json_object("run", "$.key").alias("key"), "event_id", F.timestamp_micros("micros").alias("ts"), "confidence")


def cooldown_stream(rows: DataFrame, cooldown: float, delay: str = "10 minutes") -> DataFrame:
    """The same on a stream, with alerts at once: the time of the last alert of each key is kept as state, over restarts too, and goes
    once the watermark (``delay`` behind the latest time) is a cooldown past it. Rows later than that are dropped; a row that comes
    late, after a later alert of its key has gone out, gives no alert, where the batch form would have put it first."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames), ignore_index=True)
        if not len(rows):
            return
        rows = rows.sort_values(["ts", "confidence", "event_id"], ascending=[True, False, True], ignore_index=True)
        keep, last = emitted(rows["ts"].astype("int64").to_numpy() / 1e9, cooldown, last)
        state.update((last,))
        state.setTimeoutTimestamp(int(max((last + cooldown) * 1000, state.getCurrentWatermarkMs())) + 1)
        yield rows[keep][["key", "event_id", "ts", "confidence"]]

    watched = rows.withWatermark("ts", delay)
    return watched.groupBy("key").applyInPandasWithState(step, ALERT, "last double", "append", GroupStateTimeout.EventTimeTimeout)


def outbox_writer(path: str):
    """For ``foreachBatch``: appends alerts that the outbox doesn't hold yet, so that a batch that is run again adds nothing.

    The outbox lies in a folder per day; only the days of the batch are read. A fault in reading stops the batch, it never counts as an empty outbox.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["key", "event_id"]).withColumn("sent", F.lit(False)).withColumn("day", F.date_format("ts", "yyyyMMdd").cast("int"))
        days = [r["day"] for r in fresh.select("day").distinct().collect()]  # as many as a batch spans
        if days and exists(spark, path):
            known = spark.read.schema(fresh.schema).parquet(path).where(F.col("day").isin(days)).select("key", "event_id")
            fresh = fresh.join(known, ["key", "event_id"], "left_anti")
        fresh.write.mode("append").partitionBy("day").parquet(path)

    return write


def next_to_send(outbox: DataFrame, n: int = 20) -> DataFrame:
    """The oldest alerts that aren't sent."""
    return outbox.where("not sent").orderBy("ts", "key", "event_id").limit(n)


def latest_per_window(frames: DataFrame, ts: str, key: str, length: str) -> DataFrame:
    """The latest frame of each key and window: how a slow consumer samples a fast source."""
    rest = [c for c in frames.columns if c not in (ts, key)]
    best = frames.groupBy(key, F.window(ts, length).alias("w")).agg(F.max(ts).alias(ts), *[F.max_by(c, ts).alias(c) for c in rest])
    return best.drop("w")


def tumbling_counts(events: DataFrame, ts: str, key: str, length: str = "1 hour") -> DataFrame:
    """Events per key and window; on a stream set a watermark first."""
    return events.groupBy(F.window(ts, length).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
