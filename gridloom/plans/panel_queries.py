"""Queries on grids, samples, metrics and gains over the events table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.operators import grid as G
from gridloom.operators import metrics as M
from gridloom.plans.registry import Registry, r, rounded
from gridloom.sources.tables import table

#: The grids: event types in steps of 2 hours, users in days; both from the first day on.
ORIGIN, DAYS = "2024-01-01 00:00:00", 30
LOOKBACK, LEADS, BOUNDARIES = 12, [1, 3, 12], [120, 240]
STRATEGIES, SEEDS, DAY_LEADS = ["direct", "tuned", "limited", "full"], [1, 2], [1, 2]

query = Registry()
QUERIES, SQL = query.queries, query.sql


def type_grid(spark: SparkSession, sf: str) -> DataFrame:
    return G.dense(G.sliced(table(spark, sf, "events"), "event_type", "ts", "value", ORIGIN, 7200), 0, DAYS * 12 - 1)


def user_grid(spark: SparkSession, sf: str) -> DataFrame:
    return G.dense(G.sliced(table(spark, sf, "events"), "user_id", "ts", "value", ORIGIN, 86400), 0, DAYS - 1)


def _grid_sql(entity: str, seconds: int, last: int) -> str:
    return f"""p AS (SELECT {entity} AS entity, CAST(floor(date_diff('second', TIMESTAMP '{ORIGIN}', date_trunc('second', ts)) / {seconds}) AS INT) AS slot, sum(CAST(round(value * 100) AS BIGINT)) / 100.0 AS value FROM events GROUP BY 1, 2),
    g AS (SELECT e.entity, CAST(s.slot AS INT) AS slot, p.value FROM (SELECT DISTINCT entity FROM p) e CROSS JOIN (SELECT unnest(range(0, {last + 1})) AS slot) s LEFT JOIN p ON p.entity = e.entity AND p.slot = s.slot)"""


TYPE_SQL, USER_SQL = _grid_sql("event_type", 7200, DAYS * 12 - 1), _grid_sql("user_id", 86400, DAYS - 1)


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts of user days by four formulas of earlier days, two seeds, two leads: one pass over the grid gives all lags, then leads are exploded."""
    lags = G.lagged(user_grid(spark, sf), {**{f"l{n}": n for n in range(1, max(DAY_LEADS) + 3)}, "week": 7})

    def of(h: int):
        x, week = [F.col(f"l{n}") for n in range(h, h + 3)], F.col("week")
        forms = {"direct": x[0], "tuned": (x[0] + x[1]) / 2, "limited": (x[0] + x[1] + x[2]) / 3, "full": (x[0] + week) / 2}
        each = F.array(*(F.struct(F.lit(h).alias("lead"), F.lit(s).alias("strategy"), F.lit(k).alias("seed"), (f * (1 + 0.01 * k)).alias("predicted")) for s, f in forms.items() for k in SEEDS))
        known = F.col("value").isNotNull() & week.isNotNull() & x[0].isNotNull() & x[1].isNotNull() & x[2].isNotNull()
        return F.when(known, each).otherwise(F.slice(each, 1, 0))

    out = lags.select("entity", "slot", F.col("value").alias("actual"), F.col("week").alias("naive"), F.explode(F.flatten(F.array(*map(of, DAY_LEADS)))).alias("f"))
    return out.select("entity", "slot", "f.lead", "actual", "naive", "f.strategy", "f.seed", "f.predicted", (F.col("entity") % 4 + 1).cast("int").alias("grp"))


FACTS_SQL = (
    f"WITH {USER_SQL}, l AS (SELECT h.lead, g.entity, g.slot, g.value AS actual, "
    + ", ".join(f"(SELECT x.value FROM g x WHERE x.entity = g.entity AND x.slot = g.slot - {d}) AS {n}" for d, n in (("h.lead", "a"), ("h.lead - 1", "b"), ("h.lead - 2", "c"), ("7", "naive")))
    + """ FROM g CROSS JOIN (VALUES (1), (2)) h(lead)),
    ok AS (SELECT * FROM l WHERE actual IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND naive IS NOT NULL),
    f0 AS (SELECT entity, slot, lead, actual, naive, strategy, seed, CAST(entity % 4 + 1 AS INT) AS grp,
      CASE strategy WHEN 'direct' THEN a WHEN 'tuned' THEN (a + b) / 2 WHEN 'limited' THEN (a + b + c) / 3 ELSE (a + naive) / 2 END * (1 + 0.01 * seed) AS predicted
      FROM ok CROSS JOIN (VALUES ('direct'), ('tuned'), ('limited'), ('full')) s(strategy) CROSS JOIN (VALUES (1), (2)) k(seed)),
    f AS (SELECT *, predicted - actual AS error, abs(predicted - actual) AS ae, (predicted - actual) * (predicted - actual) AS se,
      CASE WHEN abs(actual) + abs(predicted) > 0 THEN 200 * abs(predicted - actual) / (abs(actual) + abs(predicted)) ELSE 0 END AS sm FROM f0)
    """
)
POOLED = "count(*) AS n, round(avg(ae), 6) AS mae, round(sqrt(avg(se)), 6) AS rmse, round(avg(sm), 6) AS smape, round(avg(error), 6) AS bias"
ENTITY_SQL = FACTS_SQL + ", m AS (SELECT entity, grp, lead, strategy, seed, count(*) AS observations, avg(ae) AS mae, sqrt(avg(se)) AS rmse, avg(sm) AS smape FROM f GROUP BY ALL)"


def entity_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return M.per_entity(facts(spark, sf), "naive", "grp", "lead", "strategy", "seed")


# ---- grid -------------------------------------------------------------------------------------


@query("grid_dense_flags", f"WITH {TYPE_SQL} SELECT entity, slot, round(value, 6) AS value, value IS NOT NULL AS present, value IS NULL AS is_missing, value IS NULL AND slot % 12 IN (1, 2) AS is_structural_absence, value IS NULL AND NOT slot % 12 IN (1, 2) AS is_observational_missing FROM g")
def grid_dense_flags(spark, sf):
    return rounded(G.flagged(type_grid(spark, sf), (F.col("slot") % 12).isin(1, 2)))


@query("grid_coverage", f"WITH {USER_SQL}, c AS (SELECT entity, count(*) AS expected, count(value) AS observed, count(value) / count(*) AS coverage FROM g GROUP BY 1) SELECT count(*) AS entities, round(avg(coverage), 6) AS mean_coverage, round(quantile_cont(coverage, 0.5), 6) AS median_coverage, round(quantile_cont(coverage, 0.25), 6) AS p25, round(quantile_cont(coverage, 0.75), 6) AS p75, round(min(coverage), 6) AS min_coverage, count_if(coverage >= 0.9) AS at_least_90, count_if(coverage < 0.5) AS below_50, round(1 - sum(observed) / sum(expected), 6) AS missing_rate FROM c")
def grid_coverage(spark, sf):
    return rounded(G.coverage_distribution(G.coverage(user_grid(spark, sf))))


@query("coverage_by_period", f"WITH {USER_SQL} SELECT entity, CASE WHEN slot < 15 THEN 'early' ELSE 'late' END AS period, count(*) AS expected, count(value) AS observed, round(count(value) / count(*), 6) AS coverage FROM g GROUP BY 1, 2")
def coverage_by_period(spark, sf):
    return rounded(G.coverage(user_grid(spark, sf).withColumn("period", F.when(F.col("slot") < 15, "early").otherwise("late")), "period"))


ELIGIBLE_SQL = f"WITH {USER_SQL}, e AS (SELECT entity, count(value) / count(*) AS coverage, count(DISTINCT CASE WHEN slot < 20 THEN round_even(value, 3) END) AS distinct_values FROM g GROUP BY 1), r AS (SELECT *, coverage >= 0.9 AS r1, distinct_values > 1 AS r2 FROM e)"


def _eligibility(spark, sf):
    return G.eligibility(user_grid(spark, sf), F.col("slot") < 20)


@query("r1_r2_eligibility", ELIGIBLE_SQL + " SELECT entity, round(coverage, 6) AS coverage, distinct_values, r1, r2 FROM r")
def r1_r2_eligibility(spark, sf):
    return rounded(_eligibility(spark, sf))


def _windows_sql(lookback: int, leads: list[int], grid: str) -> str:
    each = " UNION ALL ".join(
        f"SELECT entity, slot, value, {h} AS lead, count(value) OVER (PARTITION BY entity ORDER BY slot RANGE BETWEEN {h + lookback - 1} PRECEDING AND {h} PRECEDING) = {lookback} AS complete, coalesce(sum(changed) OVER (PARTITION BY entity ORDER BY slot RANGE BETWEEN {h + lookback - 2} PRECEDING AND {h} PRECEDING), 0) AS changes FROM d"
        for h in leads
    )
    return f"WITH {grid}, d AS (SELECT *, CASE WHEN value IS NOT NULL AND lag(value) OVER (PARTITION BY entity ORDER BY slot) IS NOT NULL AND value <> lag(value) OVER (PARTITION BY entity ORDER BY slot) THEN 1 ELSE 0 END AS changed FROM g), w0 AS ({each}), w AS (SELECT *, slot - lead - {lookback - 1} AS input_start, complete AND value IS NOT NULL AS valid, value IS NOT NULL AND coalesce(value, 0) <> 0 AS nonzero_target FROM w0 WHERE slot - lead - {lookback - 1} >= 0)"


WINDOWS_SQL, USER_WINDOWS_SQL = _windows_sql(LOOKBACK, LEADS, TYPE_SQL), _windows_sql(3, DAY_LEADS, USER_SQL)


def type_windows(spark, sf):
    return G.windows(type_grid(spark, sf), LOOKBACK, LEADS, 0)


def user_windows(spark, sf):
    return G.windows(user_grid(spark, sf), 3, DAY_LEADS, 0)


@query("window_validity", WINDOWS_SQL + " SELECT entity, lead, count(*) AS candidates, count_if(complete) AS complete, count_if(valid) AS valid, count_if(valid AND nonzero_target) AS nonzero, CAST(sum(changes) AS BIGINT) AS changes FROM w GROUP BY 1, 2")
def window_validity(spark, sf):
    return type_windows(spark, sf).groupBy("entity", "lead").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("complete").alias("complete"), F.count_if("valid").alias("valid"), F.count_if(F.col("valid") & F.col("nonzero_target")).alias("nonzero"), F.sum("changes").alias("changes"))


AUDIT_SQL = USER_WINDOWS_SQL + ", t AS (SELECT entity, lead, count(*) AS candidates, count_if(valid AND changes > 0 AND nonzero_target) AS useful FROM w GROUP BY 1, 2), a AS (SELECT entity, min(useful) AS least_useful, first(lead ORDER BY useful, lead) AS least_useful_lead, max(1 - useful / candidates) AS worst_skip_rate, first(lead ORDER BY 1 - useful / candidates DESC, lead) AS worst_skip_lead FROM t GROUP BY 1)"


@query("useful_transitions", AUDIT_SQL + " SELECT entity, least_useful, least_useful_lead, round(worst_skip_rate, 6) AS worst_skip_rate, worst_skip_lead FROM a")
def useful_transitions(spark, sf):
    return rounded(G.transition_audit(user_windows(spark, sf)))


def _rules(spark, sf):
    a = G.transition_audit(user_windows(spark, sf)).select("entity", (F.col("least_useful") >= 5).alias("r3"), (F.col("worst_skip_rate") <= 0.4).alias("r4"), "worst_skip_rate")
    return _eligibility(spark, sf).join(a, "entity", "left").select("entity", "r1", "r2", F.coalesce("r3", F.lit(False)).alias("r3"), F.coalesce("r4", F.lit(False)).alias("r4"), "worst_skip_rate", "coverage")


RULES_SQL = ELIGIBLE_SQL + AUDIT_SQL.replace("WITH " + USER_SQL, "") + ", rules AS (SELECT r.entity, r1, r2, coalesce(least_useful >= 5, false) AS r3, coalesce(worst_skip_rate <= 0.4, false) AS r4, worst_skip_rate, coverage FROM r LEFT JOIN a ON a.entity = r.entity)"


@query("eligibility_flow", RULES_SQL + " SELECT count(*) AS all_entities, count_if(r1) AS after_r1, count_if(r1 AND r2) AS after_r2, count_if(r1 AND r2 AND r3) AS after_r3, count_if(r1 AND r2 AND r3 AND r4) AS after_r4, count_if(NOT r3 AND NOT r4) AS fails_r3_and_r4 FROM rules")
def eligibility_flow(spark, sf):
    ok = F.col("r1")
    steps = {"after_r1": ok, "after_r2": ok & F.col("r2"), "after_r3": ok & F.col("r2") & F.col("r3"), "after_r4": ok & F.col("r2") & F.col("r3") & F.col("r4")}
    return _rules(spark, sf).agg(F.count(F.lit(1)).alias("all_entities"), *(F.count_if(c).alias(n) for n, c in steps.items()), F.count_if(~F.col("r3") & ~F.col("r4")).alias("fails_r3_and_r4"))


@query("threshold_tradeoff", RULES_SQL + " SELECT threshold, count_if(worst_skip_rate <= threshold) AS kept, count_if(worst_skip_rate > threshold) AS dropped FROM rules CROSS JOIN (VALUES (0.1), (0.3), (0.5), (0.7)) t(threshold) GROUP BY 1")
def threshold_tradeoff(spark, sf):
    each = _rules(spark, sf).select("worst_skip_rate", F.explode(F.array(*map(F.lit, (0.1, 0.3, 0.5, 0.7)))).alias("threshold"))
    return each.groupBy("threshold").agg(F.count_if(F.col("worst_skip_rate") <= F.col("threshold")).alias("kept"), F.count_if(F.col("worst_skip_rate") > F.col("threshold")).alias("dropped"))


@query("lowest_coverage", RULES_SQL + " SELECT entity, round(coverage, 6) AS coverage FROM rules ORDER BY rules.coverage, entity LIMIT 30")
def lowest_coverage(spark, sf):
    return rounded(_rules(spark, sf).select("entity", "coverage").orderBy("coverage", "entity").limit(30))


@query("failure_sets", RULES_SQL + ", x AS (SELECT entity FROM rules WHERE NOT r3), y AS (SELECT entity FROM rules WHERE NOT r4) SELECT (SELECT count(*) FROM (SELECT * FROM x UNION SELECT * FROM y)) AS either, (SELECT count(*) FROM (SELECT * FROM x INTERSECT SELECT * FROM y)) AS both_rules, (SELECT count(*) FROM (SELECT * FROM x EXCEPT SELECT * FROM y)) AS only_r3, (SELECT count(*) FROM (SELECT * FROM y EXCEPT SELECT * FROM x)) AS only_r4")
def failure_sets(spark, sf):
    from gridloom.operators.relational import membership

    r = _rules(spark, sf)
    m = membership({"x": r.filter("not r3"), "y": r.filter("not r4")}, "entity")
    return m.agg(F.count(F.lit(1)).alias("either"), F.count_if(F.col("x") + F.col("y") == 2).alias("both_rules"), F.count_if(F.col("x") > F.col("y")).alias("only_r3"), F.count_if(F.col("y") > F.col("x")).alias("only_r4"))


def _split(slot):
    return F.when(slot < 240, "train").when(slot < 300, "validation").when(slot < 348, "test")


SAMPLES_SQL = WINDOWS_SQL + ", i AS (SELECT *, CASE WHEN slot < 240 THEN 'train' WHEN slot < 300 THEN 'validation' WHEN slot < 348 THEN 'test' END AS split, (input_start <= 120 AND slot > 120) OR (input_start <= 240 AND slot > 240) AS crossing FROM w)"


def index(spark, sf):
    return G.samples(type_windows(spark, sf), _split(F.col("slot")), BOUNDARIES)


@query("sample_index", SAMPLES_SQL + " SELECT 'events' AS dataset, entity AS entity_id, CAST(lead AS SMALLINT) AS horizon, slot AS target_slot, split FROM i WHERE split IS NOT NULL AND valid AND NOT crossing")
def sample_index(spark, sf):
    return index(spark, sf).filter("split is not null and valid and not crossing").select(F.lit("events").alias("dataset"), F.col("entity").alias("entity_id"), F.col("lead").cast("smallint").alias("horizon"), F.col("slot").alias("target_slot"), "split")


@query("sample_counts_identity", SAMPLES_SQL + " SELECT entity, lead, split, count(*) AS candidates, count_if(NOT valid) AS missing_excluded, count_if(valid AND crossing) AS continuity_excluded, count_if(valid AND NOT crossing) AS valid_samples, count(*) - count_if(NOT valid) - count_if(valid AND crossing) = count_if(valid AND NOT crossing) AS identity_holds FROM i WHERE split IS NOT NULL GROUP BY 1, 2, 3")
def sample_counts_identity(spark, sf):
    return G.sample_counts(index(spark, sf), "entity", "lead", "split")


@query("sample_counts_rollup", SAMPLES_SQL + " SELECT coalesce(lead, 0) AS lead, coalesce(split, 'all') AS split, count_if(valid AND NOT crossing) AS valid_samples FROM i WHERE split IS NOT NULL GROUP BY ROLLUP (i.lead, i.split)")
def sample_counts_rollup(spark, sf):
    return index(spark, sf).filter("split is not null").rollup("lead", "split").agg(F.count_if(F.col("valid") & ~F.col("crossing")).alias("valid_samples")).fillna({"lead": 0, "split": "all"})


@query("scaler_table", f"WITH {USER_SQL} SELECT entity, count(value) AS n_observed, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS raw_std, round(greatest(stddev_pop(value), 0.01), 6) AS effective_std FROM g WHERE slot < 20 GROUP BY 1")
def scaler_table(spark, sf):
    return rounded(G.scaler(user_grid(spark, sf).filter("slot < 20")))


@query("scaler_invariants", f"WITH {USER_SQL}, s AS (SELECT entity, stddev_pop(value) AS d FROM g GROUP BY 1) SELECT 'finite' AS rule, count_if(d IS NULL) AS rows FROM s UNION ALL SELECT 'floor', count_if(NOT coalesce(greatest(d, 0.01) >= 0.01, false)) FROM s")
def scaler_invariants(spark, sf):
    from gridloom.operators.relational import violations

    return violations(G.scaler(user_grid(spark, sf)), {"finite": "raw_std is not null", "floor": "effective_std >= 0.01"})


@query("calendar_features", f"WITH t AS (SELECT event_id, ts, CAST(floor((hour(ts) * 60 + minute(ts)) / 30) + 1 AS INT) AS slot FROM events) SELECT event_id, slot, printf('%02d:%02d', CAST(floor((slot - 1) * 30 / 60) AS INT), (slot - 1) * 30 % 60) AS label, printf('%02d-%02d', CAST(floor((slot - 1) / 4) * 2 AS INT), CAST(floor((slot - 1) / 4) * 2 AS INT) + 2) AS band, CAST(isodow(ts) - 1 AS INT) AS dow, isodow(ts) >= 6 AS weekend, CAST(month(ts) AS INT) AS month, round(sin(2 * pi() * (slot - 1) / 48), 6) AS slot_sin, round(cos(2 * pi() * (slot - 1) / 48), 6) AS slot_cos FROM t")
def calendar_features(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", S.slot_of_day(F.col("ts")).alias("slot"))
    s, c = S.cyclic(F.col("slot") - 1, 48)
    return rounded(e.select("event_id", "slot", S.slot_label(F.col("slot")).alias("label"), S.hour_band(F.col("slot")).alias("band"), S.weekday(F.col("ts")).alias("dow"), S.is_weekend(F.col("ts")).alias("weekend"), F.month("ts").alias("month"), s.alias("slot_sin"), c.alias("slot_cos")))


@query("lag_features", f"WITH {TYPE_SQL} SELECT entity, slot, value, lag(value, 1) OVER w AS persistence, lag(value, 12) OVER w AS daily FROM g WINDOW w AS (PARTITION BY entity ORDER BY slot)")
def lag_features(spark, sf):
    return G.lagged(type_grid(spark, sf), {"persistence": 1, "daily": 12})


@query("input_windows", f"WITH {TYPE_SQL}, a AS (SELECT entity, slot, value AS target, count(value) OVER w AS n, sum(value) OVER w AS total, first(value) OVER w AS first_input, last(value) OVER w AS last_input FROM g WINDOW w AS (PARTITION BY entity ORDER BY slot RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING)) SELECT entity, slot, target, round(total, 6) AS total, first_input, last_input FROM a WHERE n = 12 AND target IS NOT NULL")
def input_windows(spark, sf):
    a = G.input_arrays(type_grid(spark, sf), LOOKBACK, 1)
    return rounded(a.select("entity", "slot", "target", F.aggregate("input", F.lit(0.0), lambda s, x: s + x).alias("total"), F.element_at("input", 1).alias("first_input"), F.element_at("input", -1).alias("last_input")))


@query("grid_irregular", f"WITH {USER_SQL}, s AS (SELECT entity, slot, slot - lag(slot) OVER (PARTITION BY entity ORDER BY slot) AS distance FROM p) SELECT entity, slot, distance FROM s WHERE distance <> 1")
def grid_irregular(spark, sf):
    return G.irregular(G.sliced(table(spark, sf, "events"), "user_id", "ts", "value", ORIGIN, 86400))


@query("duplicate_keys", "SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows FROM events GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return G.duplicates(table(spark, sf, "events").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")), "user_id", "event_type", "day")


@query("lead_difficulty", f"WITH {TYPE_SQL}, x AS (SELECT h.lead, g.entity, g.value AS y, o.value AS x, d.value AS s FROM g CROSS JOIN (SELECT unnest(range(1, 49)) AS lead) h JOIN g o ON o.entity = g.entity AND o.slot = g.slot - h.lead LEFT JOIN g d ON d.entity = g.entity AND d.slot = g.slot - 12), e AS (SELECT lead, entity, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS r, avg(abs(y - x)) AS persistence_mae, avg(abs(y - s)) AS seasonal_mae FROM x WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2) SELECT CAST(lead AS INT) AS lead, round(quantile_cont(r, 0.5), 6) AS median_r, round(quantile_cont(persistence_mae, 0.5), 6) AS median_persistence_mae, round(quantile_cont(seasonal_mae, 0.5), 6) AS median_seasonal_mae, round(quantile_cont(r, 0.75) - quantile_cont(r, 0.25), 6) AS iqr_r FROM e GROUP BY 1")
def lead_difficulty(spark, sf):
    from gridloom.operators.stats import correlation

    leads = range(1, 49)
    g = G.lagged(type_grid(spark, sf), {f"l{h}": h for h in leads})
    each = g.select("entity", F.col("value").alias("y"), F.col("l12").alias("s"), F.explode(F.array(*(F.struct(F.lit(h).alias("lead"), F.col(f"l{h}").alias("x")) for h in leads))).alias("o")).select("entity", "y", "s", "o.*")
    e = each.filter("x is not null and y is not null").groupBy("lead", "entity").agg(correlation("x", "y").alias("r"), F.avg(F.abs(F.col("y") - F.col("x"))).alias("p"), F.avg(F.abs(F.col("y") - F.col("s"))).alias("q"))
    return rounded(e.groupBy("lead").agg(F.percentile("r", 0.5).alias("median_r"), F.percentile("p", 0.5).alias("median_persistence_mae"), F.percentile("q", 0.5).alias("median_seasonal_mae"), (F.percentile("r", 0.75) - F.percentile("r", 0.25)).alias("iqr_r")))


# ---- metrics ----------------------------------------------------------------------------------


@query("baseline_predictions", FACTS_SQL + "SELECT entity, slot, lead, strategy, seed, round(actual, 6) AS actual, round(predicted, 6) AS predicted, round(ae, 6) AS absolute_error, round(se, 4) AS squared_error, round(sm, 6) AS smape, CASE WHEN error > 1e-12 THEN 'over' WHEN error < -1e-12 THEN 'under' ELSE 'exact' END AS direction FROM f")
def baseline_predictions(spark, sf):
    e = M.with_errors(facts(spark, sf))
    return e.select("entity", "slot", "lead", "strategy", "seed", *(r(c, 6).alias(c) for c in ("actual", "predicted", "absolute_error")), r("squared_error", 4).alias("squared_error"), r("smape", 6).alias("smape"), S.direction(F.col("actual"), F.col("predicted")).alias("direction"))


@query("pooled_metrics", FACTS_SQL + f"SELECT strategy, seed, lead, {POOLED} FROM f GROUP BY 1, 2, 3")
def pooled_metrics(spark, sf):
    return rounded(M.pooled(facts(spark, sf), "strategy", "seed", "lead"))


@query("household_metrics", FACTS_SQL + """SELECT entity, grp, lead, strategy, seed, count(*) AS observations, round(avg(actual), 6) AS actual_mean, round(stddev_pop(actual), 6) AS actual_std, round(avg(CAST(abs(actual) <= 1e-12 AS INT)), 6) AS zero_rate, round(avg(ae), 6) AS mae, round(sqrt(avg(se)), 6) AS rmse, round(avg(sm), 6) AS smape, round(avg(error), 6) AS bias,
 round(avg(CAST(error > 1e-12 AS INT)), 6) AS over_rate, round(avg(CAST(error < -1e-12 AS INT)), 6) AS under_rate, round(avg(CAST(abs(error) <= 1e-12 AS INT)), 6) AS exact_rate, round(avg(CAST(predicted < 0 AS INT)), 6) AS negative_rate, round(CASE WHEN abs(avg(actual)) > 1e-12 THEN avg(ae) / avg(actual) END, 6) AS nmae, round(CASE WHEN abs(avg(actual)) > 1e-12 THEN sqrt(avg(se)) / avg(actual) END, 6) AS nrmse,
 round(avg(abs(naive - actual)), 6) AS naive_mae, round(CASE WHEN avg(abs(naive - actual)) > 1e-12 THEN avg(ae) / avg(abs(naive - actual)) END, 6) AS relative_mae, round(CASE WHEN avg(abs(naive - actual)) > 1e-12 THEN (avg(abs(naive - actual)) - avg(ae)) / avg(abs(naive - actual)) END, 6) AS skill FROM f GROUP BY 1, 2, 3, 4, 5""")
def household_metrics(spark, sf):
    return rounded(entity_metrics(spark, sf))


def _dimensioned(spark, sf):
    return facts(spark, sf).withColumn("load_bin", S.load_bin(F.col("actual"), (20.0, 60.0, 150.0))).withColumn("weekpart", F.when((F.col("slot") % 7) >= 5, "weekend").otherwise("weekday"))


@query("metrics_by_dimension", FACTS_SQL + ", x AS (SELECT *, CASE WHEN actual = 0 THEN 'zero' WHEN actual <= 20 THEN '(0,20]' WHEN actual <= 60 THEN '(20,60]' WHEN actual <= 150 THEN '(60,150]' ELSE '>150' END AS load_bin, CASE WHEN slot % 7 >= 5 THEN 'weekend' ELSE 'weekday' END AS weekpart FROM f) " + " UNION ALL ".join(f"SELECT strategy, lead, '{d}' AS dimension, CAST({d} AS VARCHAR) AS level, {POOLED} FROM x GROUP BY 1, 2, {d}" for d in ("load_bin", "weekpart", "grp")))
def metrics_by_dimension(spark, sf):
    return rounded(M.pooled_sets(_dimensioned(spark, sf), ["strategy", "lead"], ["load_bin", "weekpart", "grp"]))


@query("peak_metrics", FACTS_SQL + f", t AS (SELECT quantile_cont(actual, 0.9) AS threshold FROM f) SELECT strategy, lead, {POOLED} FROM f, t WHERE actual >= threshold GROUP BY 1, 2")
def peak_metrics(spark, sf):
    return rounded(M.pooled(M.above_quantile(facts(spark, sf), "actual", 0.9), "strategy", "lead"))


@query("baseline_comparison", FACTS_SQL + "SELECT lead, baseline, count(*) AS n, round(avg(abs(v - actual)), 6) AS mae FROM (SELECT lead, actual, 'naive' AS baseline, naive AS v FROM f WHERE strategy = 'direct' AND seed = 1 UNION ALL SELECT lead, actual, 'persistence', predicted / 1.01 FROM f WHERE strategy = 'direct' AND seed = 1) GROUP BY 1, 2")
def baseline_comparison(spark, sf):
    f = facts(spark, sf).filter("strategy = 'direct' and seed = 1").select("lead", "actual", "naive", (F.col("predicted") / 1.01).alias("persistence"))
    long = f.unpivot(["lead", "actual"], ["naive", "persistence"], "baseline", "predicted")
    return rounded(M.pooled(long, "lead", "baseline").select("lead", "baseline", "n", "mae"))


PATTERN_SQL = f"WITH {USER_SQL}, k AS (SELECT entity, slot, max(CASE WHEN lead = 1 THEN 1 ELSE 0 END) AS l1, max(CASE WHEN lead = 2 THEN 1 ELSE 0 END) AS l2, max(CASE WHEN lead = 4 THEN 1 ELSE 0 END) AS l4 FROM (SELECT g.entity, g.slot, h.lead FROM g CROSS JOIN (VALUES (1), (2), (4)) h(lead) JOIN g o ON o.entity = g.entity AND o.slot = g.slot - h.lead WHERE g.value IS NOT NULL AND o.value IS NOT NULL) GROUP BY 1, 2)"


def _supported(spark, sf):
    g = G.lagged(user_grid(spark, sf), {f"l{h}": h for h in (1, 2, 4)})
    each = g.select("entity", "slot", "value", F.explode(F.array(*(F.struct(F.lit(h).alias("lead"), F.col(f"l{h}").alias("x")) for h in (1, 2, 4)))).alias("o")).select("entity", "slot", "value", "o.*")
    return each.filter("value is not null and x is not null")


@query("support_patterns", PATTERN_SQL + " SELECT concat(l1, l2, l4) AS pattern, count(*) AS keys, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM k GROUP BY 1")
def support_patterns(spark, sf):
    return rounded(M.support_patterns(_supported(spark, sf), [1, 2, 4], "entity", "slot"))


@query("common_rows", PATTERN_SQL + " SELECT entity, count(*) AS common_rows FROM k WHERE l1 + l2 + l4 = 3 GROUP BY 1")
def common_rows(spark, sf):
    return M.common_rows(_supported(spark, sf), [1, 2, 4], "entity", "slot").filter("lead = 1").groupBy("entity").agg(F.count(F.lit(1)).alias("common_rows"))


@query("support_signature", FACTS_SQL + "SELECT count(*) AS rows, count(DISTINCT entity) AS entities, CAST(sum(slot) AS BIGINT) AS slots FROM f")
def support_signature(spark, sf):
    return facts(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("entity").alias("entities"), F.sum("slot").alias("slots"))


@query("row_outcomes", FACTS_SQL + ", b AS (SELECT strategy, seed, entity, slot, max(CASE WHEN lead = 1 THEN ae END) AS a, max(CASE WHEN lead = 2 THEN ae END) AS b FROM f GROUP BY 1, 2, 3, 4) SELECT strategy, seed, count(*) AS rows, count_if(b - a > 1e-12) AS first_better, count_if(b - a < -1e-12) AS second_better, count_if(abs(b - a) <= 1e-12) AS ties FROM b WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2")
def row_outcomes(spark, sf):
    return M.row_outcomes(facts(spark, sf), 1, 2, "entity", "slot")


@query("seed_summary", ENTITY_SQL + " SELECT entity, lead, strategy, round(avg(mae), 6) AS mean, round(stddev_samp(mae), 6) AS sample_std, round(min(mae), 6) AS minimum, round(max(mae), 6) AS maximum, count(DISTINCT seed) AS seed_count FROM m GROUP BY 1, 2, 3")
def seed_summary(spark, sf):
    return rounded(M.over_seeds(entity_metrics(spark, sf), "mae", "entity", "lead", "strategy"))


GAIN_ROWS = " UNION ALL ".join(f"SELECT entity, grp, lead, seed, '{n}' AS gain, w.\"{a}\" AS focal_value, w.\"{b}\" AS comparator_value FROM w" for n, a, b in M.GAINS)
GAINS_SQL = ENTITY_SQL + ", w AS (SELECT entity, grp, lead, seed, " + ", ".join(f"max(CASE WHEN strategy = '{s}' THEN mae END) AS \"{s}\"" for s in STRATEGIES) + f" FROM m GROUP BY 1, 2, 3, 4), g0 AS ({GAIN_ROWS}), gains AS (SELECT *, comparator_value - focal_value AS value, CASE WHEN abs(comparator_value) > 1e-12 THEN 100 * (comparator_value - focal_value) / comparator_value END AS percent FROM g0)"


def entity_gains(spark, sf):
    return M.gains(entity_metrics(spark, sf), "mae", "entity", "grp", "lead", "seed")


@query("gains", GAINS_SQL + " SELECT entity, grp, lead, seed, gain, round(focal_value, 6) AS focal_value, round(comparator_value, 6) AS comparator_value, round(value, 6) AS value, round(percent, 4) AS percent FROM gains")
def gains(spark, sf):
    g = entity_gains(spark, sf)
    return g.select("entity", "grp", "lead", "seed", "gain", *(r(c, 6).alias(c) for c in ("focal_value", "comparator_value", "value")), r("percent", 4).alias("percent"))


DIST = "count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sample_std, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, round(min(value), 6) AS minimum, round(max(value), 6) AS maximum, count_if(value > 1e-12) AS positive, count_if(value < -1e-12) AS negative, count_if(abs(value) <= 1e-12) AS ties, round(count_if(value > 1e-12) / count(value), 6) AS positive_share"


@query("gain_distribution", GAINS_SQL + f" SELECT gain, lead, {DIST} FROM gains GROUP BY 1, 2")
def gain_distribution(spark, sf):
    return rounded(M.distribution(entity_gains(spark, sf), "value", "gain", "lead"))


@query("group_gain_summary", GAINS_SQL + f" SELECT grp, gain, lead, {DIST} FROM gains GROUP BY 1, 2, 3")
def group_gain_summary(spark, sf):
    return rounded(M.distribution(entity_gains(spark, sf), "value", "grp", "gain", "lead"))


@query("gain_algebra_audit", GAINS_SQL + ", v AS (SELECT entity, lead, seed, " + ", ".join(f"max(CASE WHEN gain = '{n}' THEN value END) AS {n}" for n, _, _ in M.GAINS) + " FROM gains GROUP BY 1, 2, 3) SELECT 'limited_less_tuned' AS audit, max(abs(limited_vs_tuned - (source_transfer + fine_tuning))) <= 1e-9 AS passed FROM v UNION ALL SELECT 'full_less_direct', max(abs(direct_vs_full - (source_transfer - full_data))) <= 1e-9 FROM v")
def gain_algebra_audit(spark, sf):
    names = [n for n, _, _ in M.GAINS]
    v = entity_gains(spark, sf).groupBy("entity", "lead", "seed").pivot("gain", names).agg(F.first("value"))
    v = v.withColumn("x", F.col("source_transfer") + F.col("fine_tuning")).withColumn("y", F.col("source_transfer") - F.col("full_data"))
    return M.audit(v, {"limited_less_tuned": ("limited_vs_tuned", "x"), "full_less_direct": ("direct_vs_full", "y")}, 1e-9).select("audit", "passed")


@query("lead_shift", ENTITY_SQL + ", s AS (SELECT entity, strategy, seed, lead, mae, mae - lag(mae) OVER w AS change, lag(mae) OVER w AS b FROM m WINDOW w AS (PARTITION BY entity, strategy, seed ORDER BY lead)) SELECT entity, strategy, seed, lead, round(mae, 6) AS mae, round(change, 6) AS change, round(CASE WHEN abs(b) > 1e-12 THEN 100 * change / b END, 4) AS percent_change FROM s")
def lead_shift(spark, sf):
    c = M.change_over(entity_metrics(spark, sf).select("entity", "strategy", "seed", "lead", "mae"), "mae", "lead", "entity", "strategy", "seed")
    return c.select("entity", "strategy", "seed", "lead", r("mae", 6).alias("mae"), r("change", 6).alias("change"), r("percent_change", 4).alias("percent_change"))


@query("wide_core", ENTITY_SQL + " SELECT entity, " + ", ".join(f"round(avg(CASE WHEN strategy = '{s}' AND lead = {h} THEN mae END), 6) AS {s}_{h}" for s in STRATEGIES for h in DAY_LEADS) + " FROM m GROUP BY 1")
def wide_core(spark, sf):
    m = entity_metrics(spark, sf).select("entity", "mae", F.concat_ws("_", "strategy", "lead").alias("k"))
    return rounded(m.groupBy("entity").pivot("k", [f"{s}_{h}" for s in STRATEGIES for h in DAY_LEADS]).agg(F.avg("mae")))


@query("strategy_self_join", FACTS_SQL + "SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.slot, b.slot) AS slot, round(abs(a.predicted - a.actual), 6) AS focal, round(abs(b.predicted - b.actual), 6) AS comparator FROM (SELECT * FROM f WHERE strategy = 'direct' AND seed = 1 AND lead = 1) a FULL JOIN (SELECT * FROM f WHERE strategy = 'full' AND seed = 1 AND lead = 2) b ON a.entity = b.entity AND a.slot = b.slot")
def strategy_self_join(spark, sf):
    """Errors of two strategies at two leads, row by row: targets that one of them can't forecast keep the other's."""
    f = facts(spark, sf).filter("seed = 1")
    side = lambda strategy, lead, name: f.filter((F.col("strategy") == strategy) & (F.col("lead") == lead)).select("entity", "slot", F.abs(F.col("predicted") - F.col("actual")).alias(name))
    return rounded(side("direct", 1, "focal").join(side("full", 2, "comparator"), ["entity", "slot"], "full"))


@query("bias_contrasts", FACTS_SQL + "SELECT entity, lead, seed, round(avg(CASE WHEN strategy = 'direct' THEN error END) - avg(CASE WHEN strategy = 'limited' THEN error END), 6) AS direct_less_limited, round(avg(CASE WHEN strategy = 'full' THEN error END) - avg(CASE WHEN strategy = 'direct' THEN error END), 6) AS full_less_direct FROM f GROUP BY 1, 2, 3")
def bias_contrasts(spark, sf):
    """Signed differences of biases; they rank nothing."""
    wide = M.by_strategy(entity_metrics(spark, sf), "bias", STRATEGIES, "entity", "lead", "seed")
    return rounded(wide.select("entity", "lead", "seed", (F.col("direct") - F.col("limited")).alias("direct_less_limited"), (F.col("full") - F.col("direct")).alias("full_less_direct")))


CALENDAR_SQL = ", ".join(f"round({f}(2 * pi() * ({v}) / {n}), 6) AS {name}_{f}" for name, v, n in (("slot", "(i - 1) % 12", 12), ("dow", "dow", 7), ("month", "month", 12)) for f in ("sin", "cos"))


@query("input_features", f"WITH {TYPE_SQL}, z AS (SELECT entity, avg(value) AS m, greatest(stddev_pop(value), 0.01) AS d FROM g WHERE slot < 120 GROUP BY 1), a AS (SELECT entity, slot, value AS target, count(value) OVER w AS n, list({{'at': slot, 'v': value}} ORDER BY slot) OVER w AS x FROM g WINDOW w AS (PARTITION BY entity ORDER BY slot RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING)), u AS (SELECT entity, slot, (target - m) / d AS target, unnest(range(1, 13)) AS step, unnest(x) AS e, m, d FROM a JOIN z USING (entity) WHERE n = 12 AND target IS NOT NULL), k AS (SELECT *, e.at % 12 + 1 AS i, TIMESTAMP '{ORIGIN}' + to_seconds(CAST(e.at AS BIGINT) * 7200) AS ts FROM u), c AS (SELECT *, isodow(ts) - 1 AS dow, month(ts) - 1 AS month FROM k) SELECT entity, slot, CAST(step AS INT) AS step, round(target, 6) AS target, round((e.v - m) / d, 6) AS load, {CALENDAR_SQL}, CAST(dow >= 5 AS INT) AS weekend FROM c")
def input_features(spark, sf):
    """The eight features of each step of each input window."""
    g = type_grid(spark, sf)
    scale = g.filter("slot < 120").groupBy("entity").agg(F.avg("value").alias("mean"), F.greatest(F.stddev_pop("value"), F.lit(0.01)).alias("std"))
    f = G.input_features(g, scale, LOOKBACK, 1, ORIGIN, 7200)
    return rounded(f.select("entity", "slot", "target", F.posexplode("input").alias("step", "x")).select("entity", "slot", (F.col("step") + 1).alias("step"), "target", "x.*"))


@query("scaled_round_trip", f"WITH {TYPE_SQL}, z AS (SELECT entity, avg(value) AS m, greatest(stddev_pop(value), 0.01) AS d FROM g WHERE slot < 120 GROUP BY 1) SELECT entity, slot, round((value - m) / d, 6) AS scaled, round(value, 6) AS restored FROM g JOIN z USING (entity) WHERE value IS NOT NULL")
def scaled_round_trip(spark, sf):
    g = type_grid(spark, sf).filter("value is not null")
    scale = g.filter("slot < 120").groupBy("entity").agg(F.avg("value").alias("mean"), F.greatest(F.stddev_pop("value"), F.lit(0.01)).alias("std"))
    both = g.join(F.broadcast(scale), "entity").withColumn("scaled", S.scaled(F.col("value"), F.col("mean"), F.col("std")))
    return rounded(both.select("entity", "slot", "scaled", S.unscaled(F.col("scaled"), F.col("mean"), F.col("std")).alias("restored")))


AUTUMN = "TIMESTAMP '2024-10-26 20:00:00' + to_seconds(event_id % 20 * 1800)"


@query("repeated_wall_times", f"WITH t AS (SELECT DISTINCT {AUTUMN} AS ts FROM events), w AS (SELECT ts, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London' AS wall FROM t) SELECT strftime(ts, '%Y-%m-%d %H:%M') AS utc, strftime(wall, '%Y-%m-%d %H:%M') AS wall, CAST(row_number() OVER (PARTITION BY wall ORDER BY ts) AS INT) AS occurrence, count(*) OVER (PARTITION BY wall) > 1 AS is_repeated, CAST(date_diff('minute', ts, wall) AS INT) AS offset_minutes FROM w")
def repeated_wall_times(spark, sf):
    """Half hours over the night in which summer time ends."""
    t = table(spark, sf, "events").select(F.expr("timestamp_ntz'2024-10-26 20:00:00' + make_dt_interval(0, 0, 0, event_id % 20 * 1800)").alias("ts")).distinct()
    c = G.repeated_wall_times(t.select("ts", S.local_wall(F.col("ts")).alias("wall")))
    return c.select(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("utc"), F.date_format("wall", "yyyy-MM-dd HH:mm").alias("wall"), "occurrence", "is_repeated", S.offset_minutes(F.col("ts")).alias("offset_minutes"))


@query("window_overlap", "SELECT a.n AS name_a, b.n AS name_b, greatest(0, least(a.l, b.l) - greatest(a.f, b.f) + 1) AS overlap FROM (VALUES ('h01', -12, -1), ('h03', -14, -3), ('h12', -23, -12)) a(n, f, l) JOIN (VALUES ('h01', -12, -1), ('h03', -14, -3), ('h12', -23, -12)) b(n, f, l) ON a.n < b.n")
def window_overlap(spark, sf):
    from gridloom.operators.relational import interval_overlaps

    return interval_overlaps(spark.createDataFrame([(f"h{h:02d}", -h - LOOKBACK + 1, -h) for h in LEADS], "name string, first int, last int"))
