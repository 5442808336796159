"""Dense panel grids: complete entity x slot domains, window validity, samples and scalers.

A grid is a DataFrame (entity, slot, value) with one row for every entity and slot of a range;
value is NULL where nothing was observed. Windows are written as RANGE frames over the integer slot,
partitioned by entity: one shuffle serves all of them, and a missing row never shifts a frame.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import scalars as S


def sliced(facts: DataFrame, entity: str, ts: str, value: str, origin: str, seconds: int) -> DataFrame:
    """Facts summed to (entity, slot, value); values in hundredths are summed as whole numbers, so that sums don't depend on their order."""
    cents = F.sum(F.round(F.col(value) * 100).cast("long"))
    return facts.groupBy(F.col(entity).alias("entity"), S.slot_index(F.col(ts), origin, seconds).alias("slot")).agg((cents / 100.0).alias("value"))


def dense(panel: DataFrame, first: int, last: int) -> DataFrame:
    """All slots from first to last of each entity, left-joined with what was observed. The calendar is exploded, not joined."""
    entities = panel.select("entity").distinct()
    domain = entities.select("entity", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("slot"))
    return domain.join(panel.select("entity", "slot", "value"), ["entity", "slot"], "left")


def flagged(grid: DataFrame, structural: Column) -> DataFrame:
    """present, is_missing, and which missing rows are structural (by a predicate) or observational."""
    missing = F.col("value").isNull()
    return grid.select("*", (~missing).alias("present"), missing.alias("is_missing"), (missing & structural).alias("is_structural_absence"), (missing & ~structural).alias("is_observational_missing"))


def coverage(grid: DataFrame, *by: str) -> DataFrame:
    """Per entity (and other keys): expected and observed slots, coverage, missing rate."""
    n = F.count("value")
    return grid.groupBy("entity", *by).agg(F.count(F.lit(1)).alias("expected"), n.alias("observed"), (n / F.count(F.lit(1))).alias("coverage"))


def coverage_distribution(cover: DataFrame) -> DataFrame:
    c = F.col("coverage")
    return cover.agg(
        F.count(F.lit(1)).alias("entities"), F.avg(c).alias("mean_coverage"), F.percentile(c, 0.5).alias("median_coverage"), F.percentile(c, 0.25).alias("p25"), F.percentile(c, 0.75).alias("p75"),
        F.min(c).alias("min_coverage"), F.count_if(c >= 0.9).alias("at_least_90"), F.count_if(c < 0.5).alias("below_50"), (1 - F.sum("observed") / F.sum("expected")).alias("missing_rate"),
    )


def eligibility(grid: DataFrame, training: Column, least: float = 0.9, digits: int = 3) -> DataFrame:
    """R1: coverage of the whole period; R2: more than one distinct rounded training value."""
    x = F.col("value")
    return grid.groupBy("entity").agg((F.count("value") / F.count(F.lit(1))).alias("coverage"), F.count_distinct(F.when(training, F.bround(x, digits))).alias("distinct_values")).select(
        "*", (F.col("coverage") >= least).alias("r1"), (F.col("distinct_values") > 1).alias("r2")
    )


def _frame(first: int, last: int):
    return Window.partitionBy("entity").orderBy("slot").rangeBetween(-first, -last)


def windows(grid: DataFrame, lookback: int, leads: list[int], origin: int) -> DataFrame:
    """For each target row and lead: whether the input window is complete, how often adjacent inputs change, whether the target is there and not zero.

    The input of lead h is the `lookback` slots up to h before the target; a row is a candidate if it
    doesn't begin before slot `origin`. All leads share one sort.
    """
    w = Window.partitionBy("entity").orderBy("slot")
    before = F.lag("value").over(w)
    rows = grid.withColumn("changed", F.when(F.col("value").isNotNull() & before.isNotNull(), (F.col("value") != before).cast("int")).otherwise(0))
    each = [
        F.struct(
            F.lit(h).alias("lead"),
            (F.count("value").over(_frame(h + lookback - 1, h)) == lookback).alias("complete"),
            F.coalesce(F.sum("changed").over(_frame(h + lookback - 2, h)), F.lit(0)).alias("changes"),
        )
        for h in leads
    ]
    out = rows.select("entity", "slot", "value", F.array(*each).alias("w")).select("entity", "slot", "value", F.inline("w"))
    out = out.filter(F.col("slot") - F.col("lead") - lookback + 1 >= origin)
    there = F.col("value").isNotNull()
    return out.select("*", (F.col("slot") - F.col("lead") - lookback + 1).alias("input_start"), (F.col("complete") & there).alias("valid"), (there & (F.col("value") != 0)).alias("nonzero_target"))


def transition_audit(wins: DataFrame) -> DataFrame:
    """Per entity: useful samples (complete, changing input, nonzero target) and skip rate of each lead, with the extreme leads (first on ties)."""
    useful = F.col("valid") & (F.col("changes") > 0) & F.col("nonzero_target")
    per = wins.groupBy("entity", "lead").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(useful).alias("useful")).withColumn("skip_rate", 1 - F.col("useful") / F.col("candidates"))
    return per.groupBy("entity").agg(
        F.min("useful").alias("least_useful"), F.min_by("lead", F.struct("useful", "lead")).alias("least_useful_lead"), F.max("skip_rate").alias("worst_skip_rate"), F.max_by("lead", F.struct("skip_rate", -F.col("lead"))).alias("worst_skip_lead")
    )


def samples(wins: DataFrame, split: Column, boundaries: list[int]) -> DataFrame:
    """Sample index: valid windows that lie in a split and cross no continuity boundary; tensors are never stored."""
    return wins.select("*", split.alias("split"), S.crosses(F.col("input_start"), F.col("slot"), boundaries).alias("crossing"))


def sample_counts(index: DataFrame, *by: str) -> DataFrame:
    """Candidates, what missing values and continuity exclude, and valid samples; identity_holds checks their sum."""
    out = index.filter("split is not null").groupBy(*by).agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(~F.col("valid")).alias("missing_excluded"), F.count_if(F.col("valid") & F.col("crossing")).alias("continuity_excluded"), F.count_if(F.col("valid") & ~F.col("crossing")).alias("valid_samples")
    )
    return out.withColumn("identity_holds", F.col("candidates") - F.col("missing_excluded") - F.col("continuity_excluded") == F.col("valid_samples"))


def scaler(grid: DataFrame, floor: float = 0.01) -> DataFrame:
    """Per entity: observed values, mean, population deviation and the deviation that scaling uses."""
    std = F.stddev_pop("value")
    return grid.groupBy("entity").agg(F.count("value").alias("n_observed"), F.avg("value").alias("mean"), std.alias("raw_std"), F.greatest(std, F.lit(floor)).alias("effective_std"))


def lagged(grid: DataFrame, lags: dict[str, int]) -> DataFrame:
    """Columns of earlier values by name; on a dense grid a lag in rows is a lag in time."""
    w = Window.partitionBy("entity").orderBy("slot")
    return grid.select("*", *(F.lag("value", n).over(w).alias(name) for name, n in lags.items()))


def input_arrays(grid: DataFrame, lookback: int, lead: int) -> DataFrame:
    """For each valid sample, its input window as an array of values in order of time."""
    frame = _frame(lead + lookback - 1, lead)
    got = F.collect_list(F.struct("slot", "value")).over(frame)
    out = grid.select("entity", "slot", "value", got.alias("w")).filter((F.size(F.filter("w", lambda s: s["value"].isNotNull())) == lookback) & F.col("value").isNotNull())
    return out.select("entity", "slot", F.col("value").alias("target"), F.transform(F.array_sort("w"), lambda s: s["value"]).alias("input"))


def input_features(grid: DataFrame, scale: DataFrame, lookback: int, lead: int, origin: str, seconds: int) -> DataFrame:
    """For each valid sample, its scaled target and its input window as an array of eight features a step: the scaled load, and sine and cosine of slot of the day, weekday and month, and weekend. scale: (entity, mean, std), one row an entity."""
    per_day = 86400 // seconds
    ts = F.timestamp_add("SECOND", F.col("slot") * seconds, F.lit(origin).cast("timestamp_ntz"))
    turn = {"slot": (F.col("slot") % per_day, per_day), "dow": (F.weekday(ts), 7), "month": (F.month(ts) - 1, 12)}
    angles = [x for n, (v, k) in turn.items() for x in (F.sin(2 * math.pi * v / k).alias(f"{n}_sin"), F.cos(2 * math.pi * v / k).alias(f"{n}_cos"))]
    each = grid.join(F.broadcast(scale), "entity").select("entity", "slot", ((F.col("value") - F.col("mean")) / F.col("std")).alias("load"), *angles, (F.weekday(ts) >= 5).cast("int").alias("weekend"))
    names = ["load", *(f"{n}_{f}" for n in turn for f in ("sin", "cos")), "weekend"]
    got = F.array_sort(F.collect_list(F.when(F.col("load").isNotNull(), F.struct("slot", *names))).over(_frame(lead + lookback - 1, lead)))
    out = each.select("entity", "slot", F.col("load").alias("target"), got.alias("w")).filter((F.size("w") == lookback) & F.col("target").isNotNull())
    return out.select("entity", "slot", "target", F.transform("w", lambda s: F.struct(*(s[n].alias(n) for n in names))).alias("input"))


def irregular(panel: DataFrame, step: int = 1) -> DataFrame:
    """Rows whose distance to the entity's row before isn't `step`, duplicates among them."""
    w = Window.partitionBy("entity").orderBy("slot")
    return panel.select("entity", "slot", (F.col("slot") - F.lag("slot").over(w)).alias("distance")).filter(F.col("distance") != step)


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def repeated_wall_times(clock: DataFrame, wall: str = "wall", utc: str = "ts") -> DataFrame:
    """Which occurrence of its wall-clock time a row is, and whether the time occurs again."""
    own = Window.partitionBy(wall)
    return clock.select("*", F.row_number().over(own.orderBy(utc)).alias("occurrence"), (F.count(F.lit(1)).over(own) > 1).alias("is_repeated"))
