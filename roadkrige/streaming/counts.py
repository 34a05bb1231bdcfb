"""Mean counts per road and window over a stream of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_mean(stream: DataFrame, key: str, value: str, time: str = "ts", window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Mean and number of values per key and tumbling window; rows later than ``late`` are dropped by the watermark."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    rows = stream.filter(F.col(value).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    grouped = rows.groupBy(F.window(time, window).alias("w"), key).agg(F.avg(value).alias("aadt_obs"), F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "aadt_obs", "n")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Process what is there and stop; results in the in-memory table ``name``."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
