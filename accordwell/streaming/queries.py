"""Batch forms of the streaming operators, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import projections as P
from ..registry import query


@query(
    "str_windowed_counts",
    "SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
)
def str_windowed_counts(spark, sf_dir):
    """Tumbling windows of a day; the stream gives the same once its watermark has passed."""
    e = P.read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return w.select(F.unix_seconds("w.start").alias("window_start"), "event_type", "n", "total")
