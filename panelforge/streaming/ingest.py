"""Incremental resampling of observations to days, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_last_stream(observations: DataFrame, *, symbol: str, at: str, value: str, late: str = "1 day") -> DataFrame:
    """ticker, date_utc, `value`: the last value of each symbol and day of a stream.

    Days close when the watermark passes them; observations more than `late` behind are dropped by
    the watermark, as Structured Streaming defines. The state is one value for each open day.
    """
    seen = observations.withWatermark(at, late).where(F.col(value).isNotNull())
    best = seen.groupBy(F.window(at, "1 day").alias("w"), F.col(symbol).alias("ticker")).agg(F.max_by(value, at).alias(value))
    return best.select("ticker", F.to_date("w.start").alias("date_utc"), value)


def start(stream: DataFrame, path: str, checkpoint: str):
    """Appends closed days to a Parquet table; returns the query once all that is available is done."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
