"""Joins and set operations with the guarantees that analyses rely on, as violation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    """A join side whose keys should be unique has repeated ones."""


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, if no two rows have equal keys; one small aggregate is run."""
    if not df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        raise CardinalityError(f"repeated keys {keys}")
    return df


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return require_unique(left, *keys).join(require_unique(right, *keys), keys, how)


def join_dimension(facts: DataFrame, dimension: DataFrame, keys: list[str], default: dict | None = None) -> DataFrame:
    """Many-to-one left join; NULLs of unmatched rows are filled by default."""
    out = facts.join(require_unique(dimension, *keys), keys, "left")
    return out.fillna(default) if default else out


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of left that right doesn't have: empty if no row was lost."""
    return left.select(*keys).distinct().join(right, keys, "left_anti")


def differing(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Rows that only one of two universes has, with the side; repeated rows count."""
    x, y = a.select(*keys), b.select(*keys)
    return x.exceptAll(y).withColumn("side", F.lit("left")).union(y.exceptAll(x).withColumn("side", F.lit("right")))


def membership(named: dict[str, DataFrame], key: str) -> DataFrame:
    """Each key with a flag for each named set: one shuffle for any number of sets."""
    tagged = None
    for name, df in named.items():
        one = df.select(key, F.lit(name).alias("__set"))
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.groupBy(key).agg(*(F.max((F.col("__set") == n).cast("int")).alias(n) for n in named))


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """How many rows break each rule (a SQL predicate that should hold)."""
    n = df.agg(*(F.count_if(~F.coalesce(F.expr(p), F.lit(False))).alias(r) for r, p in rules.items()))
    return n.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("rows")) for r in rules))).alias("x")).select("x.*")


def interval_overlaps(intervals: DataFrame) -> DataFrame:
    """Steps that each pair of closed intervals (name, first, last) has in common. A few rows."""
    a, b = (intervals.select(*(F.col(c).alias(f"{c}_{t}") for c in intervals.columns)) for t in "ab")
    both = a.join(F.broadcast(b), F.col("name_a") < F.col("name_b"))
    return both.select("name_a", "name_b", F.greatest(F.lit(0), F.least("last_a", "last_b") - F.greatest("first_a", "first_b") + 1).alias("overlap"))
