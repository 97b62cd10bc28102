"""Queries over streams: they run to the end of what is there, into a scratch folder, and read the result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagewright.session import scratch_folder, table
from pagewright.streaming.metering import budget_stream, finish, windowed


def _scratch(spark) -> str:
    return f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d.rstrip('/')}/event[s].parquet")  # a pattern, as the table may be one file


def budgets(spark, d):
    """Budgets per user with state."""
    rows = _events(spark, d).select(F.col("user_id").alias("document"), F.col("event_id").alias("event"), (F.floor("value") + F.col("event_id") % 50).cast("long").alias("tokens"))
    at = _scratch(spark)
    return finish(budget_stream(rows, 300), f"{at}/out", f"{at}/checkpoint").select(F.col("document").alias("user_id"), F.col("event").alias("event_id"), "spent_before")


def windows(spark, d):
    """Events in windows of event time; in batch the same plan without a watermark's effect."""
    rows = windowed(table(spark, d, "events"))
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {"event_stream_state": budgets, "event_windows": windows}
ORACLE_SQL = {
    "event_stream_state": """WITH x AS (SELECT user_id, event_id, CAST(coalesce(sum(floor(value) + event_id % 50) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent_before FROM events)
        SELECT * FROM x WHERE spent_before < 300""",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
