"""Forecast metrics of prediction facts (entity, slot, lead, strategy, seed, actual, predicted).

Everything is an aggregate over one scan; several groupings share it by grouping sets. Errors are
taken from actual and predicted, never from stored rounded columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import scalars as S

#: (name, focal strategy, comparator): a gain is the comparator's error less the focal one's.
GAINS = (
    ("source_transfer", "direct", "limited"),
    ("fine_tuning", "tuned", "direct"),
    ("full_data", "full", "limited"),
    ("direct_vs_full", "direct", "full"),
    ("limited_vs_tuned", "tuned", "limited"),
    ("tuned_vs_full", "full", "tuned"),
)


def with_errors(facts: DataFrame) -> DataFrame:
    e = F.col("predicted") - F.col("actual")
    return facts.select("*", e.alias("error"), F.abs(e).alias("absolute_error"), (e * e).alias("squared_error"), S.smape(F.col("actual"), F.col("predicted")).alias("smape"))


def _pooled() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.avg("absolute_error").alias("mae"), F.sqrt(F.avg("squared_error")).alias("rmse"), F.avg("smape").alias("smape"), F.avg("error").alias("bias")]


def pooled(facts: DataFrame, *by: str) -> DataFrame:
    return with_errors(facts).groupBy(*by).agg(*_pooled())


def pooled_sets(facts: DataFrame, by: list[str], dimensions: list[str]) -> DataFrame:
    """The same for several dimensions at once: one row per `by`, dimension and its value."""
    rows = with_errors(facts).groupingSets([[*map(F.col, by), F.col(d)] for d in dimensions], *by, *dimensions).agg(*_pooled(), F.grouping_id().alias("__set"))
    last = len(dimensions) - 1
    name = value = F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        on = F.col("__set") == ((1 << len(dimensions)) - 1) ^ (1 << (last - i))
        name, value = F.when(on, d).otherwise(name), F.when(on, F.col(d).cast("string")).otherwise(value)
    return rows.select(*by, name.alias("dimension"), value.alias("level"), "n", "mae", "rmse", "smape", "bias")


def per_entity(facts: DataFrame, naive: str, *by: str, tol: float = S.TIE) -> DataFrame:
    """Entity metrics from sufficient statistics, with shares of over-, under- and exact forecasts and skill against a baseline column."""
    e = F.col("error")
    base = F.avg(F.abs(F.col(naive) - F.col("actual")))
    mae, rmse, mean = F.avg("absolute_error"), F.sqrt(F.avg("squared_error")), F.avg("actual")
    return with_errors(facts).groupBy("entity", *by).agg(
        F.count(F.lit(1)).alias("observations"), mean.alias("actual_mean"), F.stddev_pop("actual").alias("actual_std"), F.avg((F.abs("actual") <= tol).cast("int")).alias("zero_rate"),
        mae.alias("mae"), rmse.alias("rmse"), F.avg("smape").alias("smape"), F.avg(e).alias("bias"),
        F.avg((e > tol).cast("int")).alias("over_rate"), F.avg((e < -tol).cast("int")).alias("under_rate"), F.avg((F.abs(e) <= tol).cast("int")).alias("exact_rate"), F.avg((F.col("predicted") < 0).cast("int")).alias("negative_rate"),
        S.safe_ratio(mae, mean).alias("nmae"), S.safe_ratio(rmse, mean).alias("nrmse"), base.alias("naive_mae"), S.safe_ratio(mae, base).alias("relative_mae"), S.safe_ratio(base - mae, base).alias("skill"),
    )


def over_seeds(metrics: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean, sample deviation (NULL for one seed), extremes and number of seeds."""
    return metrics.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sample_std"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.count_distinct("seed").alias("seed_count"))


def by_strategy(metrics: DataFrame, value: str, strategies: list[str], *keys: str) -> DataFrame:
    """One column per strategy."""
    return metrics.groupBy(*keys).pivot("strategy", strategies).agg(F.first(value))


def gains(metrics: DataFrame, value: str, *keys: str, comparisons=GAINS) -> DataFrame:
    """Long gains by one aggregation: a map of each key's values by strategy, exploded by comparison. Positive is better."""
    kept = metrics.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("strategy", value))).alias("m"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("gain"), F.element_at("m", a).alias("focal_value"), F.element_at("m", b).alias("comparator_value")) for n, a, b in comparisons)))
    out = kept.select(*keys, each.alias("c")).select(*keys, "c.*")
    diff = F.col("comparator_value") - F.col("focal_value")
    return out.select("*", diff.alias("value"), S.safe_ratio(diff, F.col("comparator_value"), scale=100.0).alias("percent"))


def distribution(df: DataFrame, value: str, *by: str, tol: float = S.TIE) -> DataFrame:
    v = F.col(value)
    n = F.count(v)
    return df.groupBy(*by).agg(
        n.alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sample_std"), F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.25).alias("q25"), F.percentile(v, 0.75).alias("q75"), F.min(v).alias("minimum"), F.max(v).alias("maximum"),
        F.count_if(v > tol).alias("positive"), F.count_if(v < -tol).alias("negative"), F.count_if(F.abs(v) <= tol).alias("ties"), S.safe_ratio(F.count_if(v > tol), n).alias("positive_share"),
    )


def change_over(df: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    """Change against the row before in `order`, absolute and in percent."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return df.select("*", (F.col(value) - before).alias("change"), S.safe_ratio(F.col(value) - before, before, scale=100.0).alias("percent_change"))


def support_patterns(facts: DataFrame, leads: list[int], *keys: str) -> DataFrame:
    """How many keys are there at which leads, as a pattern of ones and zeros: one shuffle, no join chain."""
    has = facts.groupBy(*keys).agg(*(F.max((F.col("lead") == h).cast("int")).alias(f"l{h}") for h in leads))
    pattern = F.concat(*(F.col(f"l{h}").cast("string") for h in leads))
    return has.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("keys")).withColumn("share", F.col("keys") / F.sum("keys").over(Window.partitionBy(F.lit(1))))


def common_rows(facts: DataFrame, leads: list[int], *keys: str) -> DataFrame:
    """Rows of keys that all leads have."""
    full = facts.filter(F.col("lead").isin(leads)).groupBy(*keys).agg(F.count_distinct("lead").alias("n")).filter(F.col("n") == len(leads)).select(*keys)
    return facts.filter(F.col("lead").isin(leads)).join(full, list(keys), "left_semi")


def row_outcomes(facts: DataFrame, first: int, second: int, *keys: str, tol: float = S.TIE) -> DataFrame:
    """How often the first lead's absolute error is smaller, larger or equal to the second's, per strategy and seed."""
    both = with_errors(facts).groupBy("strategy", "seed", *keys).agg(*(F.max(F.when(F.col("lead") == h, F.col("absolute_error"))).alias(n) for n, h in (("a", first), ("b", second))))
    d = F.col("b") - F.col("a")
    return both.filter("a is not null and b is not null").groupBy("strategy", "seed").agg(F.count(F.lit(1)).alias("rows"), F.count_if(d > tol).alias("first_better"), F.count_if(d < -tol).alias("second_better"), F.count_if(F.abs(d) <= tol).alias("ties"))


def support_equality(facts: DataFrame, tag: str, *keys: str, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """For each two values of `tag`: keys of both, keys that only one has, and keys whose actual values aren't nearly equal. One shuffle brings the tags of a key together."""
    each = facts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(tag, "actual"))).alias("m"))
    tags = [x[0] for x in facts.select(tag).distinct().orderBy(tag).collect()]  # strategies, a few
    two = [(a, b) for i, a in enumerate(tags) for b in tags[i + 1 :]]
    x, y = (lambda t: F.try_element_at("m", F.lit(t))), F.lit
    cells = [F.struct(y(a).alias("a"), y(b).alias("b"), F.count_if(x(a).isNotNull() | x(b).isNotNull()).alias("rows"), F.count_if(x(a).isNull() != x(b).isNull()).alias("unmatched"), F.count_if(F.abs(x(a) - x(b)) > atol + rtol * F.abs(x(b))).alias("unequal")) for a, b in two]
    return each.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def signature(df: DataFrame, *keys: str) -> DataFrame:
    """An order-independent fingerprint of a set of rows."""
    h = F.xxhash64(*keys)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))


def above_quantile(facts: DataFrame, value: str, q: float, reference: DataFrame | None = None) -> DataFrame:
    """Rows of at least the quantile of a reference population; the threshold is one broadcast number, exact, from counts of equal values."""
    counts = (reference if reference is not None else facts).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    threshold = counts.agg(F.percentile(value, q, F.col("n")).alias("threshold"))
    return facts.crossJoin(F.broadcast(threshold)).filter(F.col(value) >= F.col("threshold"))


def audit(df: DataFrame, pairs: dict[str, tuple[str, str]], tol: float = S.TIE) -> DataFrame:
    """Largest difference of two columns for each audit, and whether it is within tol."""
    worst = df.agg(*(F.max(F.abs(F.col(a) - F.col(b))).alias(n) for n, (a, b) in pairs.items()))
    return worst.select(F.explode(F.array(*(F.struct(F.lit(n).alias("audit"), F.col(n).alias("worst")) for n in pairs))).alias("x")).select("x.*", (F.col("x.worst") <= tol).alias("passed"))
