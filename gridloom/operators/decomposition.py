"""Load-range composition and the split of group differences into composition and conditional parts.

bins: (entity, bin, n, absolute_error_sum, squared_error_sum), dense over entity x bin, so that a
bin without observations counts with share 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import safe_ratio


def binned(facts: DataFrame, bins: list[str], *by: str) -> DataFrame:
    """Errors summed per entity and bin, zero-filled over all bins. facts have a column bin."""
    e = F.abs(F.col("predicted") - F.col("actual"))
    seen = facts.groupBy("entity", *by, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(e).alias("ae"), F.sum(e * e).alias("se"))
    domain = seen.select("entity", *by).distinct().select("entity", *by, F.explode(F.array(*map(F.lit, bins))).alias("bin"))
    out = domain.join(seen, ["entity", *by, "bin"], "left")
    return out.select("entity", *by, "bin", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "ae", "se")))


def composition(bins: DataFrame, *by: str) -> DataFrame:
    """Adds each entity's share of a bin and its mean errors in it."""
    own = Window.partitionBy("entity", *by)
    return bins.select("*", safe_ratio(F.col("n"), F.sum("n").over(own)).alias("share"), safe_ratio(F.col("ae"), F.col("n")).alias("mae"), safe_ratio(F.col("se"), F.col("n")).alias("mse"))


def weighted_mean(value: str, weight: str):
    """Aggregate: mean of value over rows of positive weight."""
    ok = (F.col(weight) > 0) & F.col(value).isNotNull()
    return safe_ratio(F.sum(F.when(ok, F.col(weight) * F.col(value))), F.sum(F.when(ok, F.col(weight))))


def group_bins(comp: DataFrame, group: str = "group", *by: str) -> DataFrame:
    """Per group and bin: mean share over entities, exposure-weighted conditional errors."""
    return comp.groupBy(group, *by, "bin").agg(F.avg("share").alias("share"), weighted_mean("mae", "share").alias("mae"), weighted_mean("mse", "share").alias("mse"))


def decompose(groups: DataFrame, value: str = "mae", group: str = "group") -> DataFrame:
    """For each pair of groups: total difference = composition part + conditional part, each weighted by the other's mean."""
    a, b = (groups.select(F.col(group).alias(t), "bin", F.col("share").alias(f"p_{t}"), F.coalesce(F.col(value), F.lit(0.0)).alias(f"d_{t}")) for t in "ab")
    pairs = a.join(b, "bin").filter("a < b")
    out = pairs.groupBy("a", "b").agg(
        F.sum(F.col("p_b") * F.col("d_b") - F.col("p_a") * F.col("d_a")).alias("total"),
        F.sum((F.col("p_b") - F.col("p_a")) * (F.col("d_a") + F.col("d_b")) / 2).alias("composition"),
        F.sum((F.col("d_b") - F.col("d_a")) * (F.col("p_a") + F.col("p_b")) / 2).alias("conditional"),
    )
    return out.withColumn("identity_holds", F.abs(F.col("total") - F.col("composition") - F.col("conditional")) <= 1e-10)


def complete_support(bins: DataFrame) -> DataFrame:
    """Entities with observations in every bin."""
    return bins.groupBy("entity").agg(F.min("n").alias("least")).filter("least > 0").select("entity")


def standardised(comp: DataFrame, reference: DataFrame, *by: str) -> DataFrame:
    """Errors of each entity under reference shares (bin, reference_share)."""
    return comp.join(F.broadcast(reference), "bin").groupBy("entity", *by).agg(F.sum(F.col("reference_share") * F.col("mae")).alias("mae"), F.sqrt(F.sum(F.col("reference_share") * F.col("mse"))).alias("rmse"))


def cumulative(groups: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    """Running sum of contributions in order."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return groups.select("*", F.sum(value).over(w).alias("cumulative"))
