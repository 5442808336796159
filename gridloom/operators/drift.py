"""Temporal drift of entities' load between periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import circular_difference, safe_ratio
from gridloom.operators.profiles import peak_slot, ramp


def characteristics(rows: DataFrame, slots: dict[str, tuple[int, int]], low: float, high: float) -> DataFrame:
    """Per entity and period (rows: entity, period, slot, value): moments, shares of load ranges, and the shape of the slot profile."""
    v = F.col("value")
    level = rows.groupBy("entity", "period").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.avg((v == 0).cast("int")).alias("zero_share"), F.avg(((v > 0) & (v <= low)).cast("int")).alias("low_share"), F.avg(((v > low) & (v <= high)).cast("int")).alias("mid_share"), F.avg((v > high).cast("int")).alias("high_share"),
    )
    profile = rows.groupBy("entity", "period", "slot").agg(F.avg(v).alias("p"))
    parts = [safe_ratio(F.sum(F.when(F.col("slot").between(a, b), F.col("p")).otherwise(0.0)), F.sum("p")).alias(f"{n}_share") for n, (a, b) in slots.items()]
    shape = profile.groupBy("entity", "period").agg(F.avg("p").alias("profile_mean"), F.stddev_pop("p").alias("profile_std"), peak_slot("slot", "p").alias("peak_slot"), safe_ratio(F.max("p"), F.avg("p")).alias("peak_ratio"), *parts)
    return level.join(shape, ["entity", "period"]).join(ramp(profile, "slot", "p", "period"), ["entity", "period"])


def features(rows: DataFrame, baseline: str, period_slots: int, floor: float = 1e-12) -> DataFrame:
    """Each period's profile against the baseline's: z-scored and raw distances, correlation distance, changes of mean and deviation, shift of the peak."""
    p = rows.groupBy("entity", "period", "slot").agg(F.avg("value").alias("p"))
    own = Window.partitionBy("entity", "period")
    p = p.select("*", ((F.col("p") - F.avg("p").over(own)) / F.greatest(F.stddev_pop("p").over(own), F.lit(floor))).alias("z"))
    base = p.filter(F.col("period") == baseline).select("entity", "slot", F.col("p").alias("p0"), F.col("z").alias("z0"))
    both = p.filter(F.col("period") != baseline).join(base, ["entity", "slot"])
    d = F.col("p") - F.col("p0")
    sd, sd0 = F.stddev_pop("p"), F.stddev_pop("p0")
    return both.groupBy("entity", "period").agg(
        F.count(F.lit(1)).alias("slots"), F.sqrt(F.avg(F.pow(F.col("z") - F.col("z0"), 2))).alias("z_rmse"), F.avg(F.abs(d)).alias("raw_mae"), F.sqrt(F.avg(d * d)).alias("raw_rmse"),
        F.when((sd > floor) & (sd0 > floor), 1 - F.covar_pop("p", "p0") / (sd * sd0)).alias("correlation_distance"),
        safe_ratio(F.avg("p") - F.avg("p0"), F.avg("p0"), scale=100.0).alias("mean_change"), safe_ratio(sd - sd0, sd0, scale=100.0).alias("std_change"),
        circular_difference(peak_slot("slot", "p"), peak_slot("slot", "p0"), period_slots).alias("peak_shift"),
    )
