"""Ranks, effect sizes, contingency tables and multiple testing: closed forms over group aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import special
from gridloom.functions.scalars import safe_ratio
from gridloom.sources.scratch import scratch


def average_rank(x: str | Column, by: list[str] | None = None) -> Column:
    """Rank with ties at their mean, by default over all rows."""
    x = F.col(x) if isinstance(x, str) else x
    by = by or [F.lit(1)]
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2


#: Ranges of values over which counts run side by side.
RANGES = 64


def _ranges(df: DataFrame, x: str) -> DataFrame:
    """df with column __range, which grows with x: cut at approximate quantiles of all rows."""
    edges = df.agg(F.percentile_approx(F.col(x).cast("double"), [i / RANGES for i in range(1, RANGES)], 10000).alias("__edges"))
    return df.crossJoin(F.broadcast(edges)).withColumn("__range", F.size(F.filter("__edges", lambda e: e < F.col(x)))).drop("__edges")


def _before(counts: DataFrame) -> DataFrame:
    """(__range, __before): rows in all lower ranges, from rows (__range, n). At most RANGES rows are ordered in one task."""
    n = counts.groupBy("__range").agg(F.sum("n").alias("n"))
    return n.select("__range", (F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("__range")) - F.col("n")).alias("__before"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_average_ranks(df: DataFrame, **columns: str) -> DataFrame:
    """df with ranks over all rows, ties at their mean, under new names: name=column. Rows without a value have no rank and go.

    df is computed and written once. Equal values of all columns are counted together, and ranges of
    each column's values run side by side, so that no task gets all rows.
    """
    df = _written(df, "ranked")
    kinds = {df.schema[x].dataType.simpleString() for x in columns.values()}
    value = lambda x: F.col(x) if len(kinds) == 1 else F.col(x).cast("double")
    long = df.select(F.explode(F.array(*(F.struct(F.lit(name).alias("c"), value(x).alias("v")) for name, x in columns.items()))).alias("s")).select("s.c", "s.v").filter("v is not null")
    counts = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    edges = counts.groupBy("c").agg(F.percentile_approx(F.col("v").cast("double"), [i / RANGES for i in range(1, RANGES)], 10000).alias("edges"))  # a row for each column
    dealt = counts.join(F.broadcast(edges), "c").select("c", "v", "n", F.size(F.filter("edges", lambda e: e < F.col("v"))).alias("range"))
    size = dealt.groupBy("c", "range").agg(F.sum("n").alias("n"))
    before = size.select("c", "range", (F.sum("n").over(Window.partitionBy("c").orderBy("range")) - F.col("n")).alias("before"))  # at most RANGES rows a column
    upto = F.sum("n").over(Window.partitionBy("c", "range").orderBy("v"))
    ranks = _written(dealt.withColumn("upto", upto).join(F.broadcast(before), ["c", "range"]).select("c", "v", (F.col("before") + F.col("upto") - (F.col("n") - 1) / 2).alias("rank")), "ranks")
    out = df
    for name, x in columns.items():
        own = ranks.filter(F.col("c") == name).select(F.col("v").alias("__v"), F.col("rank").alias(name))
        out = out.join(own, value(x) == own["__v"]).drop("__v")
    return out


def centred(x: str, *by: str) -> Column:
    """x less its mean within groups: what remains of a regression on group dummies."""
    return F.col(x) - F.avg(x).over(Window.partitionBy(*by))


def correlation(x: str, y: str) -> Column:
    """Pearson's r; NULL where either has no variance."""
    return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.covar_pop(x, y) / (F.stddev_pop(x) * F.stddev_pop(y)))


def spearman(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Rank correlation, within groups if given."""
    some = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"))
    ranked = some.select(*by, average_rank("__x", list(by)).alias("rx"), average_rank("__y", list(by)).alias("ry")) if by else with_average_ranks(some, rx="__x", ry="__y")
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation("rx", "ry").alias("rho"))


def adjusted_spearman(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """Rank correlation after the groups' mean ranks are taken off."""
    some = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group, F.col(x).alias("__x"), F.col(y).alias("__y"))
    ranked = with_average_ranks(some, rx="__x", ry="__y")
    return ranked.select(centred("rx", group).alias("cx"), centred("ry", group).alias("cy")).agg(F.count(F.lit(1)).alias("n"), correlation("cx", "cy").alias("rho"))


def with_p(df: DataFrame, rho: str = "rho", n: str = "n") -> DataFrame:
    """Adds the two-sided p of a correlation by the t distribution."""

    @F.pandas_udf("double")
    def p(r: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or b < 3 else 0.0 if abs(a) >= 1 else special.t_two_sided(a * np.sqrt((b - 2) / (1 - a * a)), b - 2) for a, b in zip(r, k)], dtype="float64")

    return df.withColumn("p", p(rho, n))


def quartile_by_rank(df: DataFrame, x: str, tie: str, k: int = 4) -> DataFrame:
    """Adds `bucket`: ranks cut at equal quantiles, ties in order of another column; differs from ntile in which buckets get the remainder. Ranges of values run side by side."""
    dealt = _ranges(df, x)
    before = _before(dealt.select("__range", F.lit(1).alias("n")))
    total = df.agg(F.count(F.lit(1)).alias("__n"))
    rn = F.row_number().over(Window.partitionBy("__range").orderBy(x, tie)) + F.col("__before")
    both = dealt.join(F.broadcast(before), "__range").crossJoin(F.broadcast(total))
    return both.withColumn("bucket", F.greatest(F.lit(1), F.ceil(k * (rn - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))).cast("int")).drop("__range", "__before", "__n")


def quantiles(df: DataFrame, x: str, probabilities: list[float], *by: str) -> DataFrame:
    """(by, q0, q1, ...): exact quantiles of x, within groups if given, between neighbouring values as the reference's; groups without values have none.

    Equal values are counted at once, and ranges of a group's values first; only those that hold a
    wanted rank are put in order, each by itself, so that no task sees all values and no buffer
    holds them. Values meet their group's edges by (group, copy): a large group is dealt out.
    """
    keys = list(by) or ["__one"]
    rows = df.filter(F.col(x).isNotNull()).select(*([F.lit(1).alias("__one")] if not by else by), F.col(x).cast("double").alias("__v"))
    counted = _written(rows.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__m")), "values")
    edges = counted.groupBy(*keys).agg(F.percentile_approx("__v", [i / RANGES for i in range(1, RANGES)], 1000).alias("__edges"))
    edges = edges.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(RANGES - 1))))
    copy = F.pmod(F.xxhash64("__v"), F.lit(RANGES)).cast("int")
    dealt = counted.withColumn("__copy", copy).join(edges, [*keys, "__copy"]).withColumn("__range", F.size(F.filter("__edges", lambda e: e < F.col("__v")))).drop("__edges", "__copy")
    n = dealt.groupBy(*keys, "__range").agg(F.sum("__m").alias("__n"))  # at most RANGES rows a group
    own = Window.partitionBy(*keys)
    n = n.select(*keys, "__range", (F.sum("__n").over(own.orderBy("__range")) - F.col("__n")).alias("__before"), F.sum("__n").over(own).alias("__all"), "__n")
    at = [p * (F.col("__all") - 1) for p in probabilities]
    ranks = F.array_distinct(F.array(*(f(h).cast("long") for h in at for f in (F.floor, F.ceil))))
    wanted = n.withColumn("__ranks", F.filter(ranks, lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__n")))).filter(F.size("__ranks") > 0).drop("__n")
    upto = F.sum("__m").over(Window.partitionBy(*keys, "__range").orderBy("__v")) + F.col("__before")
    found = dealt.join(wanted, [*keys, "__range"]).withColumn("__upto", upto).filter(F.exists("__ranks", lambda r: (r < F.col("__upto")) & (r >= F.col("__upto") - F.col("__m"))))
    held = lambda h: (h.cast("long") < F.col("__upto")) & (h.cast("long") >= F.col("__upto") - F.col("__m"))
    pick = lambda h: F.max(F.when(held(h), F.col("__v")))
    share = lambda h: F.max(h - F.floor(h))
    values = [(pick(F.floor(h)) + share(h) * (pick(F.ceil(h)) - pick(F.floor(h)))).alias(f"q{i}") for i, h in enumerate(at)]
    return found.groupBy(*keys).agg(*values).drop("__one")


def quantile_bucket(df: DataFrame, x: str, k: int) -> DataFrame:
    """Right-closed buckets by value quantiles: equal values stay together."""
    found = quantiles(df, x, [i / k for i in range(1, k)])
    edges = found.select(F.array(*found.columns).alias("edges"))
    return df.crossJoin(F.broadcast(edges)).withColumn("bucket", F.size(F.filter("edges", lambda e: e < F.col(x))) + 1).drop("edges")  # one row


def group_stats(df: DataFrame, x: str, group: str) -> DataFrame:
    return df.filter(F.col(x).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"))


def one_way(df: DataFrame, x: str, group: str) -> DataFrame:
    """F, eta squared, omega squared (raw and clipped) from n, mean and variance of each group."""
    s = group_stats(df, x, group).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("var")).alias("within"), (F.sum(F.col("n") * F.col("mean") * F.col("mean")) - F.pow(F.sum(F.col("n") * F.col("mean")), 2) / F.sum("n")).alias("between")
    )
    ms = F.col("within") / (F.col("total") - F.col("k"))
    omega = safe_ratio(F.col("between") - (F.col("k") - 1) * ms, F.col("between") + F.col("within") + ms)
    return s.select("k", F.col("total").alias("n"), "between", "within", safe_ratio(F.col("between") / (F.col("k") - 1), ms).alias("f"), safe_ratio(F.col("between"), F.col("between") + F.col("within")).alias("eta2"), omega.alias("omega2"), F.greatest(omega, F.lit(0.0)).alias("omega2_clipped"))


def pairwise(df: DataFrame, x: str, group: str) -> DataFrame:
    """For each pair of groups: difference of means, pooled deviation, Cohen's d and Hedges' g."""
    s = group_stats(df, x, group)
    a, b = (s.select(*(F.col(c).alias(f"{c}_{t}") for c in (group, "n", "mean", "var"))) for t in "ab")
    pairs = a.join(F.broadcast(b), F.col(f"{group}_a") < F.col(f"{group}_b"))
    total = F.col("n_a") + F.col("n_b")
    pooled = F.sqrt((F.col("n_a") * F.col("var_a") + F.col("n_b") * F.col("var_b")) / (total - 2))
    d = safe_ratio(F.col("mean_b") - F.col("mean_a"), pooled)
    return pairs.select(F.col(f"{group}_a").alias("a"), F.col(f"{group}_b").alias("b"), (F.col("mean_b") - F.col("mean_a")).alias("difference"), pooled.alias("pooled_sd"), d.alias("cohen_d"), (d * (1 - 3 / (4 * total - 9))).alias("hedges_g"))


def adjusted(df: DataFrame, p: str, *family: str) -> DataFrame:
    """Benjamini-Hochberg step-up within families; rows without p count for nothing."""
    family = list(family) or [F.lit(1)]
    some = df.filter(F.col(p).isNotNull())
    rank = F.row_number().over(Window.partitionBy(*family).orderBy(p))
    raw = some.select("*", (F.col(p) * F.count(F.lit(1)).over(Window.partitionBy(*family)) / rank).alias("__raw"), rank.alias("__rank"))
    back = Window.partitionBy(*family).orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    done = raw.withColumn("p_adjusted", F.least(F.lit(1.0), F.min("__raw").over(back))).drop("__raw", "__rank")
    return done.unionByName(df.filter(F.col(p).isNull()).withColumn("p_adjusted", F.lit(None).cast("double")))


def cross_counts(df: DataFrame, row: str, column: str) -> DataFrame:
    """Contingency cells with zeros filled in, marginals and expected counts."""
    seen = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    domain = seen.select(row).distinct().crossJoin(F.broadcast(seen.select(column).distinct()))
    cells = domain.join(seen, [row, column], "left").select(row, column, F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return cells.select("*", (F.sum("n").over(Window.partitionBy(row)) * F.sum("n").over(Window.partitionBy(column)) / total).alias("expected"))


def chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """Chi square, degrees of freedom, Cramer's V, least expected count and cells below 5."""
    c = cross_counts(df, row, column)
    s = c.agg(F.sum(F.pow(F.col("n") - F.col("expected"), 2) / F.col("expected")).alias("chi2"), F.sum("n").alias("n"), F.count_distinct(row).alias("rows"), F.count_distinct(column).alias("columns"), F.min("expected").alias("least_expected"), F.count_if(F.col("expected") < 5).alias("rare_cells"))
    return s.select("chi2", ((F.col("rows") - 1) * (F.col("columns") - 1)).alias("dof"), "n", F.sqrt(safe_ratio(F.col("chi2"), F.col("n") * (F.least("rows", "columns") - 1))).alias("cramers_v"), "least_expected", "rare_cells")


def kruskal(df: DataFrame, x: str, group: str) -> DataFrame:
    """Tie-corrected H, epsilon squared."""
    r = df.filter(F.col(x).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(x).alias("x"))
    ties = r.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("t")).agg(F.sum(F.pow("t", 3.0) - F.col("t")).alias("ties"))
    sums = with_average_ranks(r, r="x").groupBy("g").agg(F.sum("r").alias("s"), F.count(F.lit(1)).cast("double").alias("m")).agg(F.count(F.lit(1)).alias("k"), F.sum("m").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("m")).alias("q"))
    both = sums.crossJoin(ties)
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (F.pow(n, 3.0) - n))
    return both.select("k", n.cast("long").alias("n"), h.alias("h")).withColumn("epsilon2", F.greatest(F.lit(0.0), (F.col("h") - F.col("k") + 1) / (n - F.col("k"))))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve from average ranks."""
    r = with_average_ranks(df.select(F.col(label).alias("y"), F.col(score).alias("s")), r="s")
    pos, neg = F.count_if(F.col("y") == 1).cast("double"), F.count_if(F.col("y") == 0).cast("double")
    return r.agg(pos.cast("long").alias("positives"), neg.cast("long").alias("negatives"), F.when((pos > 0) & (neg > 0), (F.sum(F.when(F.col("y") == 1, F.col("r"))) - pos * (pos + 1) / 2) / (pos * neg)).alias("auc"))


def risk_difference(df: DataFrame, flag: str, group: str) -> DataFrame:
    """Shares of a flag for each pair of groups, their difference and Fisher's exact p."""
    s = df.groupBy(group).agg(F.count_if(flag).alias("yes"), F.count_if(~F.col(flag)).alias("no"))
    a, b = (s.select(*(F.col(c).alias(f"{c}_{t}") for c in (group, "yes", "no"))) for t in "ab")
    pairs = a.join(F.broadcast(b), F.col(f"{group}_a") < F.col(f"{group}_b"))
    share = {t: F.col(f"yes_{t}") / (F.col(f"yes_{t}") + F.col(f"no_{t}")) for t in "ab"}

    @F.pandas_udf("double")
    def p(w: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([special.fisher_exact(*map(int, v)) for v in zip(w, x, y, z)], dtype="float64")

    return pairs.select(F.col(f"{group}_a").alias("a"), F.col(f"{group}_b").alias("b"), share["a"].alias("share_a"), share["b"].alias("share_b"), (share["b"] - share["a"]).alias("risk_difference"), p("yes_a", "no_a", "yes_b", "no_b").alias("fisher_p"))
