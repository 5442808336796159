"""Queries that resample a study's entities, and tail probabilities, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import decomposition as D
from gridloom.operators import resampling as B
from gridloom.operators import stats as X
from gridloom.plans.analysis_queries import BINS_SQL, CORR, GRANK, STUDY_SQL, _bins, study
from gridloom.plans.registry import Registry, rounded

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: Replicates of each design, and folds.
PERMUTATIONS, INTERVALS, RANKS, TABLES, FOLDS, REPEATS = 1999, 1000, 500, 20000, 10, 50


def _range(times: int) -> str:
    return f"(SELECT unnest(range(1, {times + 1})) AS r)"


def _shuffled(rows: str, times: int, seed: int = 0, by: str = "") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY r{by} ORDER BY {B.draw('entity', 'r', seed)}, entity) AS place FROM {rows} CROSS JOIN {_range(times)}"


def _redrawn(rows: str, times: int, seed: int = 0) -> str:
    """CTEs nb, dr and bs: numbered entities, drawn numbers, and the sample."""
    return f"nb AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY entity) AS i, count(*) OVER (PARTITION BY grp) AS n FROM {rows}), dr AS (SELECT r, grp, CAST({B.draw('i * 101 + grp', 'r', seed)} % n + 1 AS INT) AS i FROM nb CROSS JOIN {_range(times)}), bs AS (SELECT dr.r, nb.* FROM dr JOIN nb USING (grp, i))"


PLACES = "pl AS (SELECT grp, CAST(sum(n) OVER (ORDER BY grp) AS BIGINT) AS upto, n FROM (SELECT grp, count(*) AS n FROM {0} GROUP BY 1))"
EFFECT = "ef AS (SELECT r, b / t AS eta2, (b - (k - 1) * (t - b) / (n - k)) / (t + (t - b) / (n - k)) AS omega2 FROM (SELECT r, count(*) AS k, sum(n) AS n, sum(s * s / n) - pow(sum(s), 2) / sum(n) AS b, sum(q) - pow(sum(s), 2) / sum(n) AS t FROM sm GROUP BY 1))"
SUMS = "SELECT {0} AS r, grp, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM {1} GROUP BY 1, 2"


@query("permutation_effect", STUDY_SQL + ", " + PLACES.format("st") + f", mv AS ({_shuffled('(SELECT entity, y FROM st)', PERMUTATIONS)}), rg AS (SELECT r, y, grp FROM mv JOIN pl ON place > upto - n AND place <= upto), sm AS ({SUMS.format('0', 'st')} UNION ALL {SUMS.format('r', 'rg')}), {EFFECT}, own AS (SELECT eta2 AS e FROM ef WHERE r = 0) SELECT round(any_value(e), 6) AS eta2, count_if(round(eta2, 12) >= round(e, 12)) AS exceedances, round((count_if(round(eta2, 12) >= round(e, 12)) + 1) / {PERMUTATIONS + 1}, 6) AS p FROM ef, own WHERE r > 0")
def permutation_effect(spark, sf):
    return rounded(B.permutation_effect(study(spark, sf), "entity", "y", "grp", PERMUTATIONS))


@query("bootstrap_effect", STUDY_SQL + f", {_redrawn('(SELECT entity, grp, y FROM st)', INTERVALS)}, sm AS ({SUMS.format('0', 'st')} UNION ALL {SUMS.format('r', 'bs')}), {EFFECT} SELECT (SELECT round(eta2, 6) FROM ef WHERE r = 0) AS eta2, round(quantile_cont(eta2, 0.025), 6) AS eta2_low, round(quantile_cont(eta2, 0.975), 6) AS eta2_high, round(quantile_cont(omega2, 0.025), 6) AS omega2_low, round(quantile_cont(omega2, 0.975), 6) AS omega2_high FROM ef WHERE r > 0")
def bootstrap_effect(spark, sf):
    return rounded(B.bootstrap_effect(study(spark, sf), "entity", "y", "grp", INTERVALS))


DIFFERENCE = "avg(CASE WHEN grp = 2 THEN y END) - avg(CASE WHEN grp = 1 THEN y END)"


@query("permutation_difference", STUDY_SQL + ", two AS (SELECT entity, grp, y FROM st WHERE grp IN (1, 2)), " + PLACES.format("two") + f", own AS (SELECT {DIFFERENCE} AS e FROM two), mv AS ({_shuffled('(SELECT entity, y FROM two)', PERMUTATIONS)}), dd AS (SELECT r, {DIFFERENCE} AS d FROM mv JOIN pl ON place > upto - n AND place <= upto GROUP BY 1), {_redrawn('two', PERMUTATIONS, 1)}, bd AS (SELECT r, {DIFFERENCE} AS d FROM bs GROUP BY 1) SELECT round(any_value(e), 6) AS difference, round((count_if(round(abs(d), 12) >= round(abs(e), 12)) + 1) / {PERMUTATIONS + 1}, 6) AS p, (SELECT round(quantile_cont(d, 0.025), 6) FROM bd) AS low, (SELECT round(quantile_cont(d, 0.975), 6) FROM bd) AS high FROM dd, own")
def permutation_difference(spark, sf):
    return rounded(B.permutation_difference(study(spark, sf), "entity", "y", "grp", 1, 2, PERMUTATIONS))


RRANK = "rank() OVER (PARTITION BY r, grp ORDER BY {0}) + (count(*) OVER (PARTITION BY r, grp, {0}) - 1) / 2"


@query("bootstrap_spearman", STUDY_SQL + f", k AS (SELECT grp, {GRANK.format('x')} AS rx, {GRANK.format('y')} AS ry FROM st), own AS (SELECT grp, {CORR.format('rx', 'ry')} AS rho FROM k GROUP BY 1), {_redrawn('(SELECT entity, grp, x, y FROM st)', RANKS)}, kb AS (SELECT r, grp, {RRANK.format('x')} AS rx, {RRANK.format('y')} AS ry FROM bs), rb AS (SELECT r, grp, {CORR.format('rx', 'ry')} AS v FROM kb GROUP BY 1, 2) SELECT grp, round(any_value(rho), 6) AS rho, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM rb JOIN own USING (grp) GROUP BY 1")
def bootstrap_spearman(spark, sf):
    return rounded(B.bootstrap_spearman(study(spark, sf), "entity", "x", "y", "grp", RANKS))


@query("monte_carlo_chi_square", STUDY_SQL + ", " + PLACES.format("st") + f", ce AS (SELECT a.kind, b.grp, a.n * b.n / (SELECT count(*) FROM st) AS expected FROM (SELECT kind, count(*) AS n FROM st GROUP BY 1) a CROSS JOIN (SELECT grp, count(*) AS n FROM st GROUP BY 1) b), own AS (SELECT sum(m * m / expected) - sum(m) AS e FROM (SELECT kind, grp, count(*) AS m FROM st GROUP BY 1, 2) JOIN ce USING (kind, grp)), mv AS ({_shuffled('(SELECT entity, kind FROM st)', TABLES)}), cn AS (SELECT r, kind, grp, count(*) AS m FROM mv JOIN pl ON place > upto - n AND place <= upto GROUP BY 1, 2, 3), v AS (SELECT r, sum(m * m / expected) - sum(m) AS x FROM cn JOIN ce USING (kind, grp) GROUP BY 1) SELECT round(any_value(e), 6) AS chi2, count_if(round(x, 9) >= round(e, 9)) AS exceedances, round((count_if(round(x, 9) >= round(e, 9)) + 1) / {TABLES + 1}, 6) AS p FROM v, own")
def monte_carlo_chi_square(spark, sf):
    return rounded(B.monte_carlo_chi_square(study(spark, sf), "entity", "kind", "grp", TABLES))


@query("monte_carlo_tables", STUDY_SQL + f", ce AS (SELECT a.kind, b.grp, a.n * b.n / (SELECT count(*) FROM st) AS expected FROM (SELECT kind, count(*) AS n FROM st GROUP BY 1) a CROSS JOIN (SELECT grp, count(*) AS n FROM st GROUP BY 1) b) SELECT round(sum(m * m / expected) - sum(m), 6) AS chi2, {TABLES} AS tables, 0 AS wrong_margins, true AS near_permuted FROM (SELECT kind, grp, count(*) AS m FROM st GROUP BY 1, 2) JOIN ce USING (kind, grp)")
def monte_carlo_tables(spark, sf):
    """Tables of the study's margins drawn directly: all keep them, and p is that of permuted labels but for chance."""
    drawn = B.monte_carlo_tables(study(spark, sf), "kind", "grp", TABLES)
    permuted = B.monte_carlo_chi_square(study(spark, sf), "entity", "kind", "grp", 2000).select(F.col("p").alias("other"))
    near = F.abs(F.col("p") - F.col("other")) < 0.06  # over five standard errors of 2000 replicates
    return rounded(drawn.crossJoin(F.broadcast(permuted)).select("chi2", "tables", "wrong_margins", near.alias("near_permuted")))


@query("bootstrap_counts", STUDY_SQL + f", ef AS (SELECT avg(y) AS gm FROM st), gs AS (SELECT grp, count(*) AS n, avg(y) AS m FROM st GROUP BY 1) SELECT round((SELECT sum(n * pow(m - gm, 2)) FROM gs, ef) / (SELECT sum(pow(y - gm, 2)) FROM st, ef), 6) AS eta2, {INTERVALS} AS replicates, 0 AS short_replicates, true AS holds_eta2, true AS near_drawn")
def bootstrap_counts(spark, sf):
    """The effect with intervals from multinomial counts: each replicate draws as many rows as there are, and the interval is that of drawn rows but for chance."""
    s = study(spark, sf)
    sums = B.bootstrap_sums(s, "entity", {"s": F.col("y")}, INTERVALS, 3, "grp")
    n = s.groupBy("grp").agg(F.count(F.lit(1)).alias("all"))
    short = sums.join(F.broadcast(n), "grp").agg(F.count_distinct("r").cast("int").alias("replicates"), F.count_if(F.col("n") != F.col("all")).cast("int").alias("short_replicates"))
    one = B.bootstrap_effect_by_counts(s, "entity", "y", "grp", INTERVALS, 3)
    two = B.bootstrap_effect(s, "entity", "y", "grp", 300).select(F.col("eta2_low").alias("low"), F.col("eta2_high").alias("high"))
    both = one.crossJoin(F.broadcast(short)).crossJoin(F.broadcast(two))  # one row each
    width = F.col("eta2_high") - F.col("eta2_low")
    near = (F.abs(F.col("eta2_low") - F.col("low")) < 0.5 * width) & (F.abs(F.col("eta2_high") - F.col("high")) < 0.5 * width)
    return rounded(both.select("eta2", "replicates", "short_replicates", (F.col("eta2") <= F.col("eta2_high")).alias("holds_eta2"), near.alias("near_drawn")))


EXPLAINED = "(b0 * b0 * g11 - 2 * b0 * b1 * g01 + b1 * b1 * g00) / (g00 * g11 - g01 * g01)"


@query("partial_r2_permutation", STUDY_SQL + f", rs AS (SELECT entity, grp, y - avg(y) OVER w AS ry, CAST(kind = 'b' AS INT) - avg(CAST(kind = 'b' AS INT)) OVER w AS x0, CAST(kind = 'c' AS INT) - avg(CAST(kind = 'c' AS INT)) OVER w AS x1, row_number() OVER (PARTITION BY grp ORDER BY entity) AS place FROM st WINDOW w AS (PARTITION BY grp)), gm AS (SELECT sum(x0 * x0) AS g00, sum(x0 * x1) AS g01, sum(x1 * x1) AS g11, sum(ry * ry) AS rest, sum(x0 * ry) AS b0, sum(x1 * ry) AS b1 FROM rs), own AS (SELECT g00, g01, g11, rest, {EXPLAINED} / rest AS e FROM gm), mv AS ({_shuffled('(SELECT entity, grp, ry FROM rs)', TABLES, by=', grp')}), bb AS (SELECT r, sum(x0 * mv.ry) AS b0, sum(x1 * mv.ry) AS b1 FROM mv JOIN rs USING (grp, place) GROUP BY 1), ex AS (SELECT {EXPLAINED} / rest AS x, e FROM bb, own) SELECT round(1 - (SELECT any_value(rest) FROM own) / (SELECT var_pop(y) * count(*) FROM st), 6) AS r2_group, round(1 - (SELECT any_value(rest) FROM own) / (SELECT var_pop(y) * count(*) FROM st) * (1 - any_value(e)), 6) AS r2_full, round(any_value(e), 6) AS partial_r2, round((count_if(round(x, 12) >= round(e, 12)) + 1) / {TABLES + 1}, 6) AS p FROM ex")
def partial_r2_permutation(spark, sf):
    return rounded(B.partial_r2(study(spark, sf), "entity", "y", "grp", "kind", TABLES))


@query("cross_validated_utility", STUDY_SQL + f", mv AS ({_shuffled('(SELECT entity, grp, y, CAST(y > 0 AS INT) AS up FROM st)', REPEATS, by=', grp')}), fo AS (SELECT *, (place - 1) % {FOLDS} AS fold FROM mv), ot AS (SELECT r, y, up, count(*) OVER w - count(*) OVER p AS n, sum(y) OVER w - sum(y) OVER p AS t, sum(up) OVER w - sum(up) OVER p AS u FROM fo WINDOW w AS (PARTITION BY r, grp), p AS (PARTITION BY r, grp, fold)), gu AS (SELECT r, y, up, t / n AS guess, u / n AS chance FROM ot WHERE n > 0), rk AS (SELECT *, rank() OVER (PARTITION BY r ORDER BY chance) + (count(*) OVER (PARTITION BY r, chance) - 1) / 2 AS k FROM gu), ea AS (SELECT r, 1 - sum(pow(y - guess, 2)) / (var_pop(y) * count(*)) AS r2, CASE WHEN sum(up) > 0 AND sum(1 - up) > 0 THEN (sum(k * up) - sum(up) * (sum(up) + 1) / 2) / (sum(up) * sum(1 - up)) END AS auc, CASE WHEN sum(up) > 0 AND sum(1 - up) > 0 THEN 1 - avg(pow(chance - up, 2)) / (avg(up) * (1 - avg(up))) END AS brier FROM rk GROUP BY 1) SELECT round(avg(r2), 6) AS r2, round(avg(auc), 6) AS auc, round(avg(brier), 6) AS brier_skill FROM ea")
def cross_validated_utility(spark, sf):
    return rounded(B.cross_validated(study(spark, sf), "entity", "y", "grp", FOLDS, REPEATS))


def _weighted(c: str) -> str:
    w = f"CASE WHEN share > 0 AND {c} IS NOT NULL THEN m * share END"
    return f"CASE WHEN abs(sum({w})) > 1e-12 THEN sum({w} * {c}) / sum({w}) END AS {c}"


def _total(w: str, c: str) -> str:
    return f"CASE WHEN count({c}) = count(*) THEN sum({w} * {c}) END"


def _rmse(w: str) -> str:
    return f"sqrt(greatest(0, {_total(w, 'mse_comparator')})) - sqrt(greatest(0, {_total(w, 'mse_focal')}))"


ESTIMATES = {"observed_gain": _total("p", "gain"), "standardised_gain": _total("q", "gain"), "observed_rmse_gain": f"CASE WHEN count(mse_focal) = count(*) AND count(mse_comparator) = count(*) THEN {_rmse('p')} END", "standardised_rmse_gain": f"CASE WHEN count(mse_focal) = count(*) AND count(mse_comparator) = count(*) THEN {_rmse('q')} END"}
COMPOSITION_SQL = (
    BINS_SQL
    + ", cd AS (SELECT entity, grp, bin, max(CASE WHEN strategy = 'direct' THEN share END) AS share, max(CASE WHEN strategy = 'direct' THEN mae END) - max(CASE WHEN strategy = 'full' THEN mae END) AS gain, max(CASE WHEN strategy = 'full' THEN mse END) AS mse_focal, max(CASE WHEN strategy = 'direct' THEN mse END) AS mse_comparator FROM cp GROUP BY 1, 2, 3), "
    + _redrawn("(SELECT DISTINCT entity, grp FROM cd)", INTERVALS)
    + ", w AS (SELECT r, entity, grp, count(*) AS m FROM bs GROUP BY 1, 2, 3), "
    + f"bb AS (SELECT r, grp, bin, sum(m * share) / sum(m) AS p, {_weighted('gain')}, {_weighted('mse_focal')}, {_weighted('mse_comparator')} FROM w JOIN cd USING (entity, grp) GROUP BY 1, 2, 3), sz AS (SELECT grp, count(DISTINCT entity) AS size FROM cd GROUP BY 1), qq AS (SELECT *, sum(size * p) OVER (PARTITION BY r, bin) / sum(size) OVER (PARTITION BY r, bin) AS q FROM bb JOIN sz USING (grp)), "
    + "ea AS (SELECT r, grp, " + ", ".join(f"{v} AS {k}" for k, v in ESTIMATES.items()) + " FROM qq GROUP BY 1, 2), lo AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS estimate, grp AS a, grp AS b, {k} AS value FROM ea" for k in ESTIMATES)
    + " UNION ALL " + " UNION ALL ".join(f"SELECT '{k}_difference', x.grp, y.grp, y.{k} - x.{k} FROM ea x JOIN ea y ON x.r = y.r AND x.grp < y.grp" for k in ("standardised_gain", "standardised_rmse_gain"))
    + ") SELECT estimate, a, b, count(value) AS replicates, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM lo GROUP BY 1, 2, 3"
)


@query("composition_bootstrap", COMPOSITION_SQL)
def composition_bootstrap(spark, sf):
    c = D.composition(_bins(spark, sf), "grp", "strategy")
    pick = lambda s, x: F.max(F.when(F.col("strategy") == s, F.col(x)))
    wide = c.groupBy("entity", "grp", "bin").agg(pick("direct", "share").alias("share"), (pick("direct", "mae") - pick("full", "mae")).alias("gain"), pick("full", "mse").alias("mse_focal"), pick("direct", "mse").alias("mse_comparator"))
    return rounded(B.composition_bootstrap(wide, "entity", "grp", INTERVALS))


# ---- tail probabilities -----------------------------------------------------------------------

#: Student's t by its finite series for whole degrees of freedom v, at the angle h whose tangent is |t| / sqrt(v).
T_TAIL = "CASE WHEN v % 2 = 0 THEN sin(h) * list_sum(list_transform(range(0, v // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow(cos(h), 2 * j))) WHEN v = 1 THEN 2 / pi() * h ELSE 2 / pi() * (h + sin(h) * list_sum(list_transform(range(0, (v - 1) // 2), lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5)) * pow(cos(h), 2 * j + 1)))) END"


@query("spearman_p", STUDY_SQL + f", k AS (SELECT grp, {GRANK.format('x')} AS rx, {GRANK.format('y')} AS ry FROM st), c AS (SELECT grp, count(*) AS n, {CORR.format('rx', 'ry')} AS rho FROM k GROUP BY 1), a AS (SELECT *, n - 2 AS v, atan(abs(rho) / sqrt(1 - rho * rho)) AS h FROM c) SELECT grp, n, round(rho, 6) AS rho, round(CASE WHEN n >= 3 THEN 1 - {T_TAIL} END, 6) AS p FROM a")
def spearman_p(spark, sf):
    return rounded(X.with_p(X.spearman(study(spark, sf), "x", "y", "grp")))


LOG_P = "lgamma(w + x + 1) + lgamma(y + z + 1) + lgamma(w + y + 1) + lgamma(x + z + 1) - lgamma(w + x + y + z + 1) - lgamma({0} + 1) - lgamma(w + x - {0} + 1) - lgamma(w + y - {0} + 1) - lgamma(z - w + {0} + 1)"


@query("risk_difference_fisher", STUDY_SQL + f", s AS (SELECT grp, count_if(y > 0) AS u, count_if(NOT y > 0) AS d FROM st GROUP BY 1), ft AS (SELECT p.grp AS a, q.grp AS b, p.u AS w, p.d AS x, q.u AS y, q.d AS z FROM s p JOIN s q ON p.grp < q.grp), gf AS (SELECT *, list_transform(range(greatest(0, w - z), least(w + x, w + y) + 1), lambda i: {LOG_P.format('i')}) AS l, {LOG_P.format('w')} AS o FROM ft) SELECT a, b, round(w / (w + x), 6) AS share_a, round(y / (y + z), 6) AS share_b, round(y / (y + z) - w / (w + x), 6) AS risk_difference, round(least(1, list_sum(list_transform(list_filter(l, lambda t: t <= o + 1e-7), lambda t: exp(t)))), 6) AS fisher_p FROM gf")
def risk_difference_fisher(spark, sf):
    return rounded(X.risk_difference(study(spark, sf).withColumn("up", F.col("y") > 0), "up", "grp"))
