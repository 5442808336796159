"""Keeping a slot grid up to date from a stream of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slot_sums(readings: DataFrame, entity: str, ts: str, value: str, slot: str = "30 minutes", lateness: str = "2 hours") -> DataFrame:
    """Sums per entity and slot; a slot is final once the watermark has passed it."""
    timed = readings.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", lateness)
    sums = timed.groupBy(F.window("__ts", slot).alias("w"), F.col(entity).alias("entity")).agg(F.sum(value).alias("value"), F.count(F.lit(1)).alias("readings"))
    return sums.select("entity", F.col("w.start").alias("slot_start"), "value", "readings")
