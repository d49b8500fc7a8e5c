"""Queries over the events: cooldown of alerts and counts per window; and label files as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.sources.fixtures import SQL_GT, gt_boxes
from spanforge.sources.readers import format_labels, label_problems, parse_labels
from spanforge.sources.tables import table
from spanforge.streaming.alerts import candidates, cooldown_batch, latest_per_window, tumbling_counts

COOLDOWN = 3600.0


def alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of events with a value of 10 and more, an hour apart per user and type."""
    events = table(spark, sf_dir, "events")
    kinds = [r["event_type"] for r in events.select("event_type").distinct().collect() if r["event_type"] is not None]
    rows = candidates(events, {k: (True, 10.0) for k in kinds}, ["user_id", "event_type"], "event_type", "value", "ts", "event_id")
    return cooldown_batch(rows, COOLDOWN)


def events_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tumbling_counts(table(spark, sf_dir, "events"), "ts", "event_type")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def latest_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest_per_window(table(spark, sf_dir, "events").select("ts", "user_id", "event_id"), "ts", "user_id", "1 day")
    return rows.select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def label_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes written as label files and read again."""
    rows = parse_labels(format_labels(gt_boxes(spark, sf_dir), "image"))
    return rows.select("image", "idx", "cls", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h")])


def strict_label_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of label files made from line items, some broken: the rules they break."""
    line = F.when(F.col("image") % 7 == 0, F.format_string("%d %.4f %.4f %.4f", "cls", "cx", "cy", "w")).when(F.col("image") % 11 == 0, F.format_string("%d.5 %.4f %.4f %.4f %.4f", "cls", "cx", "cy", "w", "h"))
    line = line.when(F.col("image") % 13 == 0, F.format_string("%d x %.4f %.4f %.4f", "cls", "cy", "w", "h")).otherwise(F.format_string("%d %.4f %.4f %.4f %.4f", F.col("cls") + F.when(F.col("image") % 17 == 0, 6).otherwise(0), "cx", "cy", "w", "h"))
    rows = label_problems(gt_boxes(spark, sf_dir).select("image", "idx", line.alias("text")))
    return rows.groupBy("problem").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (alert_cooldown, events_per_hour, latest_per_day, label_round_trip, strict_label_problems)}

SQL = {
    "events_per_hour": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "latest_per_day": "SELECT user_id, arg_max(event_id, ts) AS event_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ts FROM events GROUP BY user_id, date_trunc('day', ts)",
    "label_round_trip": f"""SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY idx) - 1 AS INTEGER) AS idx, cls, round(round(cx, 8), 6) AS cx, round(round(cy, 8), 6) AS cy, round(round(w, 8), 6) AS w, round(round(h, 8), 6) AS h FROM {SQL_GT} WHERE w > 0 AND h > 0""",
    "strict_label_problems": f"""SELECT problem, n FROM (SELECT 'field_count' AS problem, count(*) FILTER (image % 7 = 0) AS n FROM {SQL_GT} UNION ALL SELECT 'class_id', count(*) FILTER (image % 7 <> 0 AND (image % 11 = 0 OR (image % 13 <> 0 AND image % 17 = 0))) FROM {SQL_GT}
        UNION ALL SELECT 'not_numeric', count(*) FILTER (image % 7 <> 0 AND image % 11 <> 0 AND image % 13 = 0) FROM {SQL_GT}) WHERE n > 0""",
}
