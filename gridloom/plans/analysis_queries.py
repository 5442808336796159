"""Queries on profiles, decompositions, drift, statistics and survey answers, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.operators import clustering as C
from gridloom.operators import decomposition as D
from gridloom.operators import drift as T
from gridloom.operators import metrics as M
from gridloom.operators import neighbours as K
from gridloom.operators import profiles as P
from gridloom.operators import relational as R
from gridloom.operators import stats as X
from gridloom.operators import survey as V
from gridloom.operators import warping
from gridloom.plans import config
from gridloom.plans.panel_queries import FACTS_SQL, GAINS_SQL, ORIGIN, TYPE_SQL, USER_SQL, entity_gains, facts, type_grid, user_grid
from gridloom.plans.registry import Registry, r, rounded
from gridloom.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


# ---- profiles ---------------------------------------------------------------------------------

PROFILE_SQL = f"WITH {TYPE_SQL}, pr AS (SELECT entity, CAST(slot % 12 + 1 AS INT) AS s, avg(value) AS mean_value, count(value) AS observed FROM g GROUP BY 1, 2)"


def type_profiles(spark, sf):
    return P.slot_profile(type_grid(spark, sf).withColumn("s", (F.col("slot") % 12 + 1).cast("int")), "s")


@query("slot_profile", PROFILE_SQL + " SELECT s, round(avg(mean_value), 6) AS mean, round(quantile_cont(mean_value, 0.25), 6) AS q25, round(quantile_cont(mean_value, 0.5), 6) AS median, round(quantile_cont(mean_value, 0.75), 6) AS q75 FROM pr GROUP BY 1")
def slot_profile(spark, sf):
    return rounded(P.across_entities(type_profiles(spark, sf), "s"))


@query("entity_mean_distribution", f"WITH {USER_SQL}, m AS (SELECT entity, avg(value) AS v FROM g GROUP BY 1) SELECT count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sample_std, round(min(v), 6) AS minimum, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS maximum FROM m")
def entity_mean_distribution(spark, sf):
    m = user_grid(spark, sf).groupBy("entity").agg(F.avg("value").alias("v"))
    return rounded(M.distribution(m, "v").select("n", "mean", "sample_std", "minimum", "q25", "median", "q75", "maximum"))


Z_SQL = PROFILE_SQL + ", z AS (SELECT *, avg(mean_value) OVER (PARTITION BY entity) AS pm, stddev_pop(mean_value) OVER (PARTITION BY entity) AS ps FROM pr)"


@query("profile_zscore", Z_SQL + " SELECT entity, s, observed, round(mean_value, 6) AS mean_value, round(pm, 6) AS profile_mean, round(ps, 6) AS profile_std, round((mean_value - pm) / greatest(ps, 0.01), 6) AS z, ps < 0.01 AS low_signal FROM z")
def profile_zscore(spark, sf):
    return rounded(P.z_scored(type_profiles(spark, sf)).select("entity", "s", "observed", "mean_value", "profile_mean", "profile_std", "z", "low_signal"))


@query("profile_peaks", PROFILE_SQL + ", l AS (SELECT *, coalesce(lag(mean_value) OVER w, -1e300) AS b, coalesce(lead(mean_value) OVER w, -1e300) AS a FROM pr WINDOW w AS (PARTITION BY entity ORDER BY s)), k AS (SELECT entity, s, mean_value, row_number() OVER (PARTITION BY entity ORDER BY mean_value DESC, s) AS peak_rank FROM l WHERE mean_value >= b AND mean_value >= a) SELECT entity, s, CAST(peak_rank AS INT) AS peak_rank, round(mean_value, 6) AS mean_value FROM k WHERE peak_rank <= 2")
def profile_peaks(spark, sf):
    return rounded(P.local_maxima(type_profiles(spark, sf), "s", "mean_value").select("entity", "s", "peak_rank", "mean_value"))


@query("peak_slot_and_ramp", PROFILE_SQL + ", d AS (SELECT *, abs(mean_value - lag(mean_value) OVER (PARTITION BY entity ORDER BY s)) AS d FROM pr) SELECT entity, first(s ORDER BY mean_value DESC, s) AS peak_slot, round(max(d), 6) AS max_ramp FROM d GROUP BY 1")
def peak_slot_and_ramp(spark, sf):
    p = type_profiles(spark, sf)
    return rounded(p.groupBy("entity").agg(P.peak_slot("s", "mean_value").alias("peak_slot")).join(P.ramp(p, "s", "mean_value"), "entity"))


DRIFT0 = f"WITH {USER_SQL}, up AS (SELECT entity, CAST(entity % 4 AS INT) AS gp, slot % 7 AS s, avg(value) AS mean_value FROM g GROUP BY 1, 2, 3 HAVING avg(value) IS NOT NULL)"
PROTO_SQL = "WITH x AS (SELECT vec_id, label, embedding FROM embeddings), u AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM x), c AS (SELECT label, i, avg(v) AS c FROM u GROUP BY 1, 2), d AS (SELECT u.vec_id AS entity, c.label AS prototype, sqrt(sum((u.v - c.c) * (u.v - c.c)) / 64) AS distance FROM u JOIN c USING (i) GROUP BY 1, 2)"


def _embedded(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("entity"), F.col("label").alias("group"), F.transform("embedding", lambda x: x.cast("double")).alias("profile"))


def _prototypes(spark, sf):
    long = _embedded(spark, sf).select("group", F.posexplode("profile").alias("i", "v")).groupBy("group", "i").agg(F.avg("v").alias("v"))
    return P.as_arrays(long, "i", "v", "group").select(F.col("group").alias("prototype"), F.col("profile").alias("shape"))


def _assigned(spark, sf):
    return P.nearest(P.to_prototypes(_embedded(spark, sf).select("entity", "profile"), _prototypes(spark, sf), lambda a, b: P.euclidean(a, b, per_slot=True)))


NEAREST_SQL = PROTO_SQL + ", k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY distance, prototype) AS r FROM d), a AS (SELECT entity, max(CASE WHEN r = 1 THEN prototype END) AS assigned, max(CASE WHEN r = 2 THEN prototype END) AS second, max(CASE WHEN r = 1 THEN distance END) AS nearest_distance, max(CASE WHEN r = 2 THEN distance END) AS second_distance FROM k WHERE r <= 2 GROUP BY 1)"


@query("clock_rmse_assignment", NEAREST_SQL + " SELECT entity, assigned, second, round(nearest_distance, 6) AS nearest_distance, round(second_distance, 6) AS second_distance, round(second_distance - nearest_distance, 6) AS margin, round(CASE WHEN abs(second_distance) > 1e-12 THEN nearest_distance / second_distance END, 6) AS ratio FROM a")
def clock_rmse_assignment(spark, sf):
    return rounded(_assigned(spark, sf))


@query("assignment_summary", NEAREST_SQL + " SELECT assigned, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(avg(nearest_distance), 6) AS mean_distance, round(quantile_cont(nearest_distance, 0.5), 6) AS median_distance FROM a GROUP BY 1")
def assignment_summary(spark, sf):
    a = _assigned(spark, sf)
    total = a.agg(F.count(F.lit(1)).alias("t"))
    g = a.groupBy("assigned").agg(F.count(F.lit(1)).alias("n"), F.avg("nearest_distance").alias("mean_distance"), F.percentile("nearest_distance", 0.5).alias("median_distance"))
    return rounded(g.crossJoin(F.broadcast(total)).select("assigned", "n", (F.col("n") / F.col("t")).alias("share"), "mean_distance", "median_distance"))


#: Weekly profiles of users: z-scores of seven day means, for users that have all seven.
WEEK_SQL = DRIFT0 + ", wz AS (SELECT entity, gp, s, (mean_value - avg(mean_value) OVER w) / greatest(stddev_pop(mean_value) OVER w, 0.01) AS z, count(*) OVER w AS slots FROM up WINDOW w AS (PARTITION BY entity)), wp AS (SELECT entity, gp, list(z ORDER BY s) AS p FROM wz WHERE slots = 7 GROUP BY 1, 2)"
#: Time warping of arrays p and q of n places each, cell by cell over the matrix with its edge; w holds the last n + 2 cells.
WARP = "dt AS (SELECT *, 0 AS t, list_resize([0::DOUBLE], 1) AS w FROM {0} UNION ALL SELECT {1}, p, q, t + 1, list_append(CASE WHEN len(w) = 9 THEN w[2:] ELSE w END, CASE WHEN t + 1 < 8 OR (t + 1) % 8 = 0 THEN 'infinity'::DOUBLE ELSE pow(p[(t + 1) // 8] - q[(t + 1) % 8], 2) + least(w[len(w) - 8], w[len(w) - 7], w[len(w)]) END) FROM dt WHERE t < 63), wd AS (SELECT {1}, sqrt(w[len(w)]) AS d FROM dt WHERE t = 63)"


def _weeks(spark, sf):
    """(entity, gp, profile) of users with a value on all seven days of the week."""
    z = P.z_scored(P.slot_profile(user_grid(spark, sf).withColumn("s", F.col("slot") % 7), "s").filter("mean_value is not null"))
    p = P.as_arrays(z, "s", "z", "entity").filter(F.size("profile") == 7)
    return p.select("entity", (F.col("entity") % 4).cast("int").alias("gp"), "profile")


def _week_prototypes(spark, sf):
    long = _weeks(spark, sf).select("gp", F.posexplode("profile").alias("i", "v")).groupBy("gp", "i").agg(F.avg("v").alias("v"))
    return P.as_arrays(long, "i", "v", "gp").select(F.col("gp").alias("prototype"), F.col("profile").alias("shape"))


PAIRED = WEEK_SQL.replace("WITH", "WITH RECURSIVE", 1) + ", cn AS (SELECT gp, i, avg(v) AS v FROM (SELECT gp, unnest(range(1, 8)) AS i, unnest(p) AS v FROM wp) GROUP BY 1, 2), ct AS (SELECT gp AS prototype, list(v ORDER BY i) AS q FROM cn GROUP BY 1), pq AS (SELECT entity, prototype, p, q FROM wp CROSS JOIN ct), " + WARP.format("pq", "entity, prototype") + ", k AS (SELECT entity, prototype, d, row_number() OVER (PARTITION BY entity ORDER BY d, prototype) AS r FROM wd), a AS (SELECT entity, max(CASE WHEN r = 1 THEN prototype END) AS assigned, max(CASE WHEN r = 2 THEN prototype END) AS second, max(CASE WHEN r = 1 THEN d END) AS nearest_distance, max(CASE WHEN r = 2 THEN d END) AS second_distance FROM k WHERE r <= 2 GROUP BY 1)"


@query("dtw_assignment", PAIRED + " SELECT entity, assigned, second, round(nearest_distance, 6) AS nearest_distance, round(second_distance, 6) AS second_distance, round(second_distance - nearest_distance, 6) AS margin, round(CASE WHEN abs(second_distance) > 1e-12 THEN nearest_distance / second_distance END, 6) AS ratio FROM a")
def dtw_assignment(spark, sf):
    return rounded(P.nearest(P.to_prototypes(_weeks(spark, sf).select("entity", "profile"), _week_prototypes(spark, sf), P.dtw)))


MATRIX = WEEK_SQL.replace("WITH", "WITH RECURSIVE", 1) + ", pq AS (SELECT x.entity AS a, y.entity AS b, x.p, y.p AS q FROM wp x JOIN wp y ON x.entity < y.entity), " + WARP.format("pq", "a, b")


@query("dtw_matrix", MATRIX + " SELECT a, b, round(d, 6) AS distance FROM wd")
def dtw_matrix(spark, sf):
    return rounded(P.dtw_pairs(_weeks(spark, sf).select("entity", "profile")).withColumnRenamed("d", "distance"))


@query("dtw_silhouette", MATRIX + ", h AS (SELECT a, b, d FROM wd UNION ALL SELECT b, a, d FROM wd), m AS (SELECT h.a, x.gp AS own, y.gp AS other, avg(d) AS m FROM h JOIN wp x ON x.entity = h.a JOIN wp y ON y.entity = h.b GROUP BY 1, 2, 3), s AS (SELECT a, max(CASE WHEN own = other THEN m END) AS i, min(CASE WHEN own <> other THEN m END) AS o FROM m GROUP BY 1) SELECT count(*) AS n, round(avg(CASE WHEN i IS NULL THEN 0 ELSE coalesce((o - i) / greatest(o, i), 0) END), 6) AS silhouette FROM s")
def dtw_silhouette(spark, sf):
    w = _weeks(spark, sf)
    labels = w.select(F.lit(0).alias("k"), F.lit(0).alias("seed"), "entity", F.col("gp").alias("label"))
    return rounded(P.warped_silhouettes(w.select("entity", "profile"), labels).drop("k", "seed"))


_SHAPES = "{0} AS (SELECT k, i, avg(v) AS v FROM (SELECT entity % {1} AS k, unnest(range(1, 8)) AS i, unnest(p) AS v FROM wp) GROUP BY 1, 2)"


@query("prototype_matching", WEEK_SQL + ", " + _SHAPES.format("ca", 4) + ", " + _SHAPES.format("cb", 5) + ", dd AS (SELECT x.k AS a, y.k AS b, sqrt(avg(pow(x.v - y.v, 2))) AS d FROM ca x JOIN cb y ON x.i = y.i GROUP BY 1, 2), best AS (SELECT [w.b, x.b, y.b, z.b] AS bs, [w.d, x.d, y.d, z.d] AS ds FROM dd w JOIN dd x ON x.a = 1 AND x.b <> w.b JOIN dd y ON y.a = 2 AND y.b NOT IN (w.b, x.b) JOIN dd z ON z.a = 3 AND z.b NOT IN (w.b, x.b, y.b) WHERE w.a = 0 ORDER BY w.d + x.d + y.d + z.d LIMIT 1) SELECT CAST(i - 1 AS INT) AS prototype, CAST(bs[i] AS INT) AS matched, round(ds[i], 6) AS distance FROM best, (SELECT unnest(range(1, 5)) AS i)")
def prototype_matching(spark, sf):
    """Mean weeks of four groups of users, each matched with that of another one of five groups."""

    def shapes(k: int):
        long = _weeks(spark, sf).select((F.col("entity") % k).cast("int").alias("k"), F.posexplode("profile").alias("i", "v")).groupBy("k", "i").agg(F.avg("v").alias("v"))
        return P.as_arrays(long, "i", "v", "k").select(F.col("k").alias("prototype"), F.col("profile").alias("shape"))

    return rounded(P.matched_prototypes(shapes(4), shapes(5)))


@query("correlation_distance", PROTO_SQL + ", w AS (SELECT u.vec_id AS entity, 1 - covar_pop(u.v, c.c) / (stddev_pop(u.v) * stddev_pop(c.c)) AS distance FROM u JOIN c ON c.i = u.i AND c.label = u.label GROUP BY 1) SELECT entity, round(distance, 6) AS distance FROM w")
def correlation_distance(spark, sf):
    own = _embedded(spark, sf).join(F.broadcast(_prototypes(spark, sf)), F.col("group") == F.col("prototype"))
    return rounded(own.select("entity", P.correlation_distance(F.col("profile"), F.col("shape")).alias("distance")))


@query("knn_support", """WITH e AS (SELECT vec_id AS entity, label AS g, embedding, vec_id % 4 = 0 AS target FROM embeddings),
 d AS (SELECT a.entity, a.g, a.target, b.entity AS other, sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) / 64) AS d FROM e a JOIN e b ON a.g = b.g AND a.entity <> b.entity AND NOT b.target),
 k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d, other) AS r FROM d), m0 AS (SELECT entity, g, target, avg(CASE WHEN r <= 10 THEN d END) AS v10, avg(CASE WHEN r <= 25 THEN d END) AS v25 FROM k GROUP BY 1, 2, 3),
 u AS (SELECT entity, g, target, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM e), c AS (SELECT g, i, avg(v) AS c FROM u WHERE NOT target GROUP BY 1, 2), cd AS (SELECT u.entity, sqrt(avg(pow(v - c, 2))) AS vc FROM u JOIN c USING (g, i) GROUP BY 1), m AS (SELECT m0.*, vc FROM m0 JOIN cd USING (entity))
 SELECT t.entity, t.g AS "group", round(t.v10, 6) AS support_distance_10, round(t.v25, 6) AS support_distance_25, round(t.vc, 6) AS centre_distance, round(100 * avg(CAST(s.v10 >= t.v10 AS INT)), 6) AS support_percentile_10, round(100 * avg(CAST(s.v25 >= t.v25 AS INT)), 6) AS support_percentile_25, round(100 * avg(CAST(round(s.vc, 12) >= round(t.vc, 12) AS INT)), 6) AS centrality_percentile FROM m t JOIN m s ON t.g = s.g AND NOT s.target WHERE t.target GROUP BY t.entity, t.g, t.v10, t.v25, t.vc""")
def knn_support(spark, sf):
    e = _embedded(spark, sf)
    # Every fourth entity is a target, all others are sources: each is one of them.
    return rounded(K.support(e.filter("entity % 4 = 0"), e.filter("entity % 4 <> 0"), 10, 25))


RAND_SQL = NEAREST_SQL + ", lb AS (SELECT a.assigned, x.label FROM a JOIN x ON x.vec_id = a.entity), n AS (SELECT assigned, label, count(*) AS n FROM lb GROUP BY 1, 2), cc AS (SELECT sum(n * (n - 1) / 2) AS cells, sum(n) AS total FROM n)"


def _labels(spark, sf):
    return _assigned(spark, sf).join(_embedded(spark, sf).select("entity", F.col("group").alias("label")), "entity").select("entity", "assigned", "label")


@query("adjusted_rand_index", RAND_SQL + ", ra AS (SELECT sum(n * (n - 1) / 2) AS p FROM (SELECT sum(n) AS n FROM n GROUP BY assigned)), rb AS (SELECT sum(n * (n - 1) / 2) AS p FROM (SELECT sum(n) AS n FROM n GROUP BY label)) SELECT CAST(total AS BIGINT) AS n, round((cells - ra.p * rb.p / (total * (total - 1) / 2)) / ((ra.p + rb.p) / 2 - ra.p * rb.p / (total * (total - 1) / 2)), 6) AS ari FROM cc, ra, rb")
def adjusted_rand_index(spark, sf):
    return rounded(P.rand_index(_labels(spark, sf), "assigned", "label"))


@query("cluster_transition", RAND_SQL + ", t AS (SELECT *, n / sum(n) OVER (PARTITION BY assigned) AS p, row_number() OVER (PARTITION BY assigned ORDER BY n DESC, label) AS r FROM n) SELECT assigned, CAST(sum(n) AS BIGINT) AS size, round(max(p), 6) AS purity, round(sum(CASE WHEN r <= 2 THEN p END), 6) AS two_child_share, round(-sum(p * ln(p)) / ln((SELECT count(DISTINCT label) FROM lb)), 6) AS entropy FROM t GROUP BY 1")
def cluster_transition(spark, sf):
    return rounded(P.transition(_labels(spark, sf), "assigned", "label"))


@query("silhouette", "WITH e AS (SELECT vec_id AS entity, label, embedding FROM embeddings), d AS (SELECT a.entity, a.label AS own, b.label AS other, avg(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))))) AS m FROM e a JOIN e b ON a.entity <> b.entity GROUP BY 1, 2, 3), s AS (SELECT entity, max(CASE WHEN own = other THEN m END) AS i, min(CASE WHEN own <> other THEN m END) AS o FROM d GROUP BY 1) SELECT count(*) AS n, round(avg(CASE WHEN i IS NULL THEN 0 ELSE coalesce((o - i) / greatest(o, i), 0) END), 6) AS silhouette FROM s")
def silhouette(spark, sf):
    return rounded(P.silhouette_of_profiles(_embedded(spark, sf).withColumnRenamed("group", "label")))


#: Daily profiles of users: value per half-hour of the day, zero where there is none, as z-scores.
DAY_SQL = """WITH RECURSIVE dc AS (SELECT user_id AS entity, CAST(hour(ts) * 2 + minute(ts) // 30 AS INT) AS s, sum(CAST(round(value * 100) AS BIGINT)) AS c FROM events GROUP BY 1, 2),
 dv AS (SELECT u.entity, s.s, coalesce(c, 0) / 3000.0::DOUBLE AS v FROM (SELECT DISTINCT entity FROM dc) u CROSS JOIN (SELECT CAST(unnest(range(48)) AS INT) AS s) s LEFT JOIN dc ON dc.entity = u.entity AND dc.s = s.s),
 dz AS (SELECT entity, s, v, (v - avg(v) OVER w) / greatest(stddev_pop(v) OVER w, 0.01) AS z, stddev_pop(v) OVER w < 0.01 AS low FROM dv WINDOW w AS (PARTITION BY entity)),
 dp AS (SELECT entity, list(z ORDER BY s) AS p, bool_or(low) AS low FROM dz GROUP BY 1)"""
#: Time warping of arrays of 48 slots, a row of the matrix for each turn: w is the last row with its edge.
WARP_DAY = "dt AS (SELECT {1}, p, q, 0 AS t, list_prepend(0::DOUBLE, list_transform(range(48), lambda i: 'infinity'::DOUBLE)) AS w FROM {0} UNION ALL SELECT {1}, p, q, t + 1, list_reduce(list_transform(range(1, 49), lambda j: [pow(p[t + 1] - q[j], 2), w[j], w[j + 1]]), lambda a, x: list_append(a, x[1] + least(x[2], x[3], a[len(a)])), ['infinity'::DOUBLE]) FROM dt WHERE t < 48), wd AS (SELECT {1}, sqrt(w[49]) AS d FROM dt WHERE t = 48)"


def _days(spark, sf):
    """(entity, profile, low_signal) of all users: 48 half-hours of the day."""
    cents = table(spark, sf, "events").groupBy(F.col("user_id").alias("entity"), (F.hour("ts") * 2 + F.floor(F.minute("ts") / 30)).cast("int").alias("s")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("c"))
    held = cents.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("s", "c"))).alias("m"))
    dense = held.select("entity", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("s"), "m").select("entity", "s", (F.coalesce(F.col("m")[F.col("s")], F.lit(0)) / F.lit(3000.0)).alias("mean_value"))
    z = P.z_scored(dense)
    return z.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "z"))), lambda x: x["z"]).alias("profile"), F.bool_or("low_signal").alias("low_signal"))


def _day_prototypes(spark, sf):
    """Mean daily profile of each of 8 groups of users."""
    long = _days(spark, sf).select((F.col("entity") % 8).cast("int").alias("gp"), F.posexplode("profile").alias("i", "v")).groupBy("gp", "i").agg(F.avg("v").alias("v"))
    return P.as_arrays(long, "i", "v", "gp").select(F.col("gp").alias("prototype"), F.col("profile").alias("shape"))


DAY_ASSIGNED = DAY_SQL + ", cn AS (SELECT gp, i, avg(v) AS v FROM (SELECT entity % 8 AS gp, unnest(range(1, 49)) AS i, unnest(p) AS v FROM dp) GROUP BY 1, 2), ct AS (SELECT gp AS prototype, list(v ORDER BY i) AS q FROM cn GROUP BY 1), pq AS (SELECT entity, prototype, p, q FROM dp CROSS JOIN ct), " + WARP_DAY.format("pq", "entity, prototype") + ", k AS (SELECT entity, prototype, d, row_number() OVER (PARTITION BY entity ORDER BY d, prototype) AS r FROM wd)"


@query("warping_search", DAY_ASSIGNED + " SELECT entity, CAST(max(CASE WHEN r = 1 THEN prototype END) AS VARCHAR) AS assigned, CAST(max(CASE WHEN r = 2 THEN prototype END) AS VARCHAR) AS second, round(max(CASE WHEN r = 1 THEN d END), 6) AS nearest_distance, round(max(CASE WHEN r = 2 THEN d END), 6) AS second_distance, count(*) AS pairs FROM k GROUP BY 1")
def warping_search(spark, sf):
    """Nearest of the group means to each user's day, through the cascade of bounds; all pairs are accounted for."""
    shapes = [(r["prototype"], np.array(r["shape"])) for r in _day_prototypes(spark, sf).collect()]  # a row for each of 8 groups
    found = warping.search(_days(spark, sf), shapes)
    return rounded(found.select("entity", "assigned", "second", "nearest_distance", "second_distance", (F.col("by_ends") + F.col("by_envelope") + F.col("early") + F.col("filled")).alias("pairs")))


#: Numbers of clusters and seeds of the study: fixed values.
BROAD_KS, BROAD_SEEDS = (2, 3, 4, 5, 6, 7, 8), (42, 123, 2026, 31415)
FOCUSED_KS, FOCUSED_SEEDS = (4, 5, 6), (42, 123, 2026, 31415, 7, 11, 19, 31, 53, 71, 97, 131, 173, 211, 257, 307, 353, 401, 457, 509)
FITS = sorted({(k, s) for k in BROAD_KS for s in BROAD_SEEDS} | {(k, s) for k in FOCUSED_KS for s in FOCUSED_SEEDS})


@query("dtw_kmeans")
def dtw_kmeans(spark, sf):
    """The 76 fits of the study over daily profiles."""
    done = C.study(_days(spark, sf), FITS)
    return rounded(C.sizes(done.labels).join(F.broadcast(done.runs), ["k", "seed"]))


@query("best_kmeans_run")
def best_kmeans_run(spark, sf):
    """Of the 20 fits with four clusters, by the silhouettes under time warping."""
    days = _days(spark, sf)
    done = C.study(days, [f for f in FITS if f[0] == 4])
    scores = P.warped_silhouettes(days, done.labels.filter("not low_signal")).select("k", "seed", "silhouette")
    return rounded(P.best_run(C.sizes(done.labels).join(scores, ["k", "seed"]), F.col("least_share") > 0.01))


#: Gates of the split, as a spec: shares of seeds and medians over seeds.
SPLIT_GATES = [
    {"name": "purity_gate", "column": "median_purity", "operator": ">=", "value": 0.5},
    {"name": "two_child_gate", "column": "median_two_child_share", "operator": ">=", "value": 0.7},
    {"name": "band_gate", "column": "band_mode_share", "operator": ">=", "value": 0.5},
    {"name": "distinctness_gate", "column": "median_distinctness", "operator": ">=", "value": 0.8},
]


def _splits(spark, sf):
    return C.splits(C.study(_days(spark, sf), [f for f in FITS if f[0] in (4, 5)]), 4)


@query("cluster_splits")
def cluster_splits(spark, sf):
    """How the fifth cluster comes out of four, for each of 20 seeds."""
    return rounded(_splits(spark, sf))


@query("split_gates")
def split_gates(spark, sf):
    """The splits over all seeds, and which gates of a spec they pass."""
    found = _splits(spark, sf)
    whole = found.agg(*(F.percentile(c, 0.5).alias(f"median_{c}") for c in ("purity", "two_child_share", "distinctness")), F.count(F.lit(1)).alias("seeds"))
    modal = found.groupBy("extra_band").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("extra_band", F.struct("n", -F.col("extra_band"))).alias("band_mode"), F.max("n").alias("band_runs"))
    both = whole.crossJoin(F.broadcast(modal)).withColumn("band_mode_share", F.col("band_runs") / F.col("seeds"))  # one row each
    return rounded(P.decision_gates(both, config.gates(SPLIT_GATES)))


@query("group_slot_summary", DRIFT0 + ", s AS (SELECT gp, s, quantile_cont(mean_value, 0.5) AS m, quantile_cont(mean_value, 0.25) AS q25, quantile_cont(mean_value, 0.75) AS q75 FROM up GROUP BY 1, 2) SELECT gp, s, round(m, 6) AS median, round(q25, 6) AS q25, round(q75, 6) AS q75, round(q75 - q25, 6) AS iqr, m >= coalesce(lag(m) OVER w, m) AND m >= coalesce(lead(m) OVER w, m) AS local_maximum FROM s WINDOW w AS (PARTITION BY gp ORDER BY s)")
def group_slot_summary(spark, sf):
    p = P.slot_profile(user_grid(spark, sf).withColumn("s", F.col("slot") % 7), "s").filter("mean_value is not null").withColumn("gp", (F.col("entity") % 4).cast("int"))
    return rounded(P.group_slot_summary(p, "s", "mean_value", "gp"))


@query("decision_gates", RAND_SQL + ", tt AS (SELECT assigned, n / sum(n) OVER (PARTITION BY assigned) AS p, n FROM n), tu AS (SELECT assigned, CAST(sum(n) AS BIGINT) AS size, max(p) AS purity FROM tt GROUP BY 1) SELECT assigned, size, round(purity, 6) AS purity, size >= 20 AS large_enough, purity >= 0.3 AS pure, CAST((size >= 20)::INT + (purity >= 0.3)::INT AS INT) AS gates_passed FROM tu")
def decision_gates(spark, sf):
    t = P.transition(_labels(spark, sf), "assigned", "label").select("assigned", "size", "purity")
    return rounded(P.decision_gates(t, {"large_enough": F.col("size") >= 20, "pure": F.col("purity") >= 0.3}))


# ---- decomposition ----------------------------------------------------------------------------

BINS = ["zero", "(0,20]", "(20,60]", "(60,150]", ">150"]
MERGED = {"zero": "low", "(0,20]": "low"}
COARSE = ["low", "(20,60]", "(60,150]", ">150"]
BIN = "CASE WHEN actual = 0 THEN 'zero' WHEN actual <= 20 THEN '(0,20]' WHEN actual <= 60 THEN '(20,60]' WHEN actual <= 150 THEN '(60,150]' ELSE '>150' END"
BINS_SQL = FACTS_SQL + f", q AS (SELECT entity, grp, strategy, CASE WHEN {BIN} IN ('zero', '(0,20]') THEN 'low' ELSE {BIN} END AS bin, ae, se FROM f WHERE lead = 1 AND seed = 1 AND strategy IN ('direct', 'full')), sn AS (SELECT entity, grp, strategy, bin, count(*) AS n, sum(ae) AS ae, sum(se) AS se FROM q GROUP BY ALL), dm AS (SELECT DISTINCT entity, grp, strategy, b.bin FROM sn CROSS JOIN (VALUES ('low'), ('(20,60]'), ('(60,150]'), ('>150')) b(bin)), bn AS (SELECT dm.*, coalesce(n, 0) AS n, coalesce(ae, 0) AS ae, coalesce(se, 0) AS se FROM dm LEFT JOIN sn USING (entity, grp, strategy, bin)), cp AS (SELECT *, n / sum(n) OVER (PARTITION BY entity, grp, strategy) AS share, CASE WHEN n > 0 THEN ae / n END AS mae, CASE WHEN n > 0 THEN se / n END AS mse FROM bn)"
GB_SQL = BINS_SQL + ", gb AS (SELECT grp, strategy, bin, avg(share) AS share, sum(CASE WHEN share > 0 AND mae IS NOT NULL THEN share * mae END) / sum(CASE WHEN share > 0 AND mae IS NOT NULL THEN share END) AS mae, sum(CASE WHEN share > 0 AND mse IS NOT NULL THEN share * mse END) / sum(CASE WHEN share > 0 AND mse IS NOT NULL THEN share END) AS mse FROM cp GROUP BY 1, 2, 3)"


def _bins(spark, sf):
    f = facts(spark, sf).filter("lead = 1 and seed = 1 and strategy in ('direct', 'full')").withColumn("bin", S.coarse_bin(S.load_bin(F.col("actual"), (20.0, 60.0, 150.0)), MERGED))
    return D.binned(f, COARSE, "grp", "strategy")


@query("bin_composition", BINS_SQL + " SELECT entity, grp, strategy, bin, n, round(share, 6) AS share, round(mae, 6) AS mae FROM cp")
def bin_composition(spark, sf):
    return rounded(D.composition(_bins(spark, sf), "grp", "strategy").select("entity", "grp", "strategy", "bin", "n", "share", "mae"))


def _group_bins(spark, sf):
    return D.group_bins(D.composition(_bins(spark, sf), "grp", "strategy"), "grp", "strategy")


@query("conditional_error", GB_SQL + " SELECT grp, strategy, bin, round(share, 6) AS share, round(mae, 6) AS mae, round(sqrt(mse), 6) AS rmse FROM gb")
def conditional_error(spark, sf):
    return rounded(_group_bins(spark, sf).select("grp", "strategy", "bin", "share", "mae", F.sqrt("mse").alias("rmse")))


@query("conditional_gain", GB_SQL + " SELECT grp, bin, round(max(CASE WHEN strategy = 'full' THEN mae END) - max(CASE WHEN strategy = 'direct' THEN mae END), 6) AS gain FROM gb GROUP BY 1, 2")
def conditional_gain(spark, sf):
    wide = M.by_strategy(_group_bins(spark, sf), "mae", ["direct", "full"], "grp", "bin")
    return rounded(wide.select("grp", "bin", (F.col("full") - F.col("direct")).alias("gain")))


@query("composition_decomposition", GB_SQL + " SELECT x.grp AS a, y.grp AS b, round(sum(y.share * coalesce(y.mae, 0) - x.share * coalesce(x.mae, 0)), 6) AS total, round(sum((y.share - x.share) * (coalesce(x.mae, 0) + coalesce(y.mae, 0)) / 2), 6) AS composition, round(sum((coalesce(y.mae, 0) - coalesce(x.mae, 0)) * (x.share + y.share) / 2), 6) AS conditional, true AS identity_holds FROM gb x JOIN gb y ON x.bin = y.bin AND x.grp < y.grp AND x.strategy = 'direct' AND y.strategy = 'direct' GROUP BY 1, 2")
def composition_decomposition(spark, sf):
    return rounded(D.decompose(_group_bins(spark, sf).filter("strategy = 'direct'"), "mae", "grp"))


STANDARD_SQL = GB_SQL + ", oks AS (SELECT entity FROM bn GROUP BY 1 HAVING min(n) > 0), rf AS (SELECT bin, avg(share) AS reference_share FROM cp GROUP BY 1), st AS (SELECT entity, strategy, sum(reference_share * mae) AS mae, sqrt(sum(reference_share * mse)) AS rmse FROM cp JOIN rf USING (bin) WHERE entity IN (SELECT entity FROM oks) GROUP BY 1, 2)"


@query("complete_support", STANDARD_SQL + " SELECT entity, strategy, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM st")
def complete_support(spark, sf):
    b = _bins(spark, sf)
    comp = D.composition(b, "grp", "strategy")
    reference = comp.groupBy("bin").agg(F.avg("share").alias("reference_share"))
    return rounded(D.standardised(comp.join(D.complete_support(b), "entity", "left_semi"), reference, "strategy"))


@query("cumulative_contribution", GB_SQL + ", o AS (SELECT *, CASE bin WHEN 'low' THEN 1 WHEN '(20,60]' THEN 2 WHEN '(60,150]' THEN 3 ELSE 4 END AS o, share * coalesce(mae, 0) AS v FROM gb) SELECT grp, strategy, bin, round(v, 6) AS contribution, round(sum(v) OVER (PARTITION BY grp, strategy ORDER BY o ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM o")
def cumulative_contribution(spark, sf):
    place = F.element_at(F.create_map(*(F.lit(x) for i, b in enumerate(COARSE) for x in (b, i))), F.col("bin"))
    g = _group_bins(spark, sf).select("grp", "strategy", "bin", place.alias("o"), (F.col("share") * F.coalesce("mae", F.lit(0.0))).alias("contribution"))
    return rounded(D.cumulative(g, "contribution", "o", "grp", "strategy").drop("o"))


@query("raw_load_structure", f"WITH {USER_SQL} SELECT entity, count(value) AS n, count_if(value = 0) AS zero, count_if(value > 0 AND value <= 20) AS low, count_if(value > 20 AND value <= 60) AS mid, count_if(value > 60) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM g WHERE value IS NOT NULL GROUP BY 1")
def raw_load_structure(spark, sf):
    v = F.col("value")
    g = user_grid(spark, sf).filter("value is not null")
    return rounded(g.groupBy("entity").agg(F.count(v).alias("n"), F.count_if(v == 0).alias("zero"), F.count_if((v > 0) & (v <= 20)).alias("low"), F.count_if((v > 20) & (v <= 60)).alias("mid"), F.count_if(v > 60).alias("high"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")))


# ---- drift ------------------------------------------------------------------------------------

DRIFT_SQL = f"WITH {TYPE_SQL}, x AS (SELECT entity, CASE WHEN slot < 120 THEN 'p1' WHEN slot < 240 THEN 'p2' ELSE 'p3' END AS period, CAST(slot % 12 + 1 AS INT) AS s, value FROM g WHERE value IS NOT NULL), pp AS (SELECT entity, period, s, avg(value) AS p FROM x GROUP BY 1, 2, 3)"


def _periods(spark, sf):
    s = F.col("slot")
    return type_grid(spark, sf).filter("value is not null").select("entity", F.when(s < 120, "p1").when(s < 240, "p2").otherwise("p3").alias("period"), (s % 12 + 1).cast("int").alias("slot"), "value")


@query("period_characteristics", DRIFT_SQL + ", a AS (SELECT entity, period, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std, avg(CAST(value = 0 AS INT)) AS zero_share, avg(CAST(value > 0 AND value <= 100 AS INT)) AS low_share, avg(CAST(value > 100 AND value <= 300 AS INT)) AS mid_share, avg(CAST(value > 300 AS INT)) AS high_share FROM x GROUP BY 1, 2), d AS (SELECT *, abs(p - lag(p) OVER (PARTITION BY entity, period ORDER BY s)) AS d FROM pp), b AS (SELECT entity, period, avg(p) AS profile_mean, stddev_pop(p) AS profile_std, first(s ORDER BY p DESC, s) AS peak_slot, max(p) / avg(p) AS peak_ratio, sum(CASE WHEN s BETWEEN 4 AND 6 THEN p ELSE 0 END) / sum(p) AS morning_share, sum(CASE WHEN s BETWEEN 9 AND 11 THEN p ELSE 0 END) / sum(p) AS evening_share, max(d) AS max_ramp FROM d GROUP BY 1, 2) SELECT entity, period, n, peak_slot, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "std", "zero_share", "low_share", "mid_share", "high_share", "profile_mean", "profile_std", "peak_ratio", "morning_share", "evening_share", "max_ramp")) + " FROM a JOIN b USING (entity, period)")
def period_characteristics(spark, sf):
    return rounded(T.characteristics(_periods(spark, sf), {"morning": (4, 6), "evening": (9, 11)}, 100.0, 300.0))


FEATURES_SQL = DRIFT_SQL + ", z AS (SELECT *, (p - avg(p) OVER w) / greatest(stddev_pop(p) OVER w, 1e-12) AS z FROM pp WINDOW w AS (PARTITION BY entity, period)), j AS (SELECT a.entity, a.period, a.s, a.p, a.z, b.p AS p0, b.z AS z0 FROM z a JOIN z b ON a.entity = b.entity AND a.s = b.s AND b.period = 'p1' WHERE a.period <> 'p1'), ft AS (SELECT entity, period, count(*) AS slots, sqrt(avg((z - z0) * (z - z0))) AS z_rmse, avg(abs(p - p0)) AS raw_mae, sqrt(avg((p - p0) * (p - p0))) AS raw_rmse, 1 - covar_pop(p, p0) / (stddev_pop(p) * stddev_pop(p0)) AS correlation_distance, 100 * (avg(p) - avg(p0)) / avg(p0) AS mean_change, 100 * (stddev_pop(p) - stddev_pop(p0)) / stddev_pop(p0) AS std_change, first(s ORDER BY p DESC, s) AS k, first(s ORDER BY p0 DESC, s) AS k0 FROM j GROUP BY 1, 2)"


@query("drift_features", FEATURES_SQL + " SELECT entity, period, slots, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("z_rmse", "raw_mae", "raw_rmse", "correlation_distance", "mean_change", "std_change")) + ", least(abs(k - k0), 12 - abs(k - k0)) AS peak_shift FROM ft")
def drift_features(spark, sf):
    return rounded(T.features(_periods(spark, sf), "p1", 12))


# ---- statistics -------------------------------------------------------------------------------

STUDY_SQL = GAINS_SQL + ", st0 AS (SELECT entity, grp, avg(value) AS y, avg(comparator_value) AS x FROM gains WHERE gain = 'full_data' AND lead = 1 GROUP BY 1, 2), st AS (SELECT entity, grp, round(y, 6) AS y, round(x, 6) AS x, CASE WHEN entity % 7 < 3 THEN 'a' WHEN entity % 7 < 5 THEN 'b' ELSE 'c' END AS kind FROM st0)"


def study(spark, sf):
    """One row per entity: group, gain y, comparator's error x, a category."""
    g = entity_gains(spark, sf).filter("gain = 'full_data' and lead = 1").groupBy("entity", "grp").agg(F.avg("value").alias("y"), F.avg("comparator_value").alias("x"))
    m = F.col("entity") % 7
    return g.select("entity", "grp", r("y").alias("y"), r("x").alias("x"), F.when(m < 3, "a").when(m < 5, "b").otherwise("c").alias("kind"))


RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2"
GRANK = "rank() OVER (PARTITION BY grp ORDER BY {0}) + (count(*) OVER (PARTITION BY grp, {0}) - 1) / 2"
CORR = "CASE WHEN stddev_pop({0}) > 0 AND stddev_pop({1}) > 0 THEN covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) END"


@query("rank_average", STUDY_SQL + f" SELECT entity, {RANK.format('x')} AS rank_x, {GRANK.format('y')} AS rank_y_in_group FROM st")
def rank_average(spark, sf):
    return X.with_average_ranks(study(spark, sf), rank_x="x").select("entity", "rank_x", X.average_rank("y", ["grp"]).alias("rank_y_in_group"))


@query("spearman", STUDY_SQL + f", k AS (SELECT {RANK.format('x')} AS rx, {RANK.format('y')} AS ry FROM st) SELECT count(*) AS n, round({CORR.format('rx', 'ry')}, 6) AS rho FROM k")
def spearman(spark, sf):
    return rounded(X.spearman(study(spark, sf), "x", "y"))


@query("spearman_within_groups", STUDY_SQL + f", k AS (SELECT grp, {GRANK.format('x')} AS rx, {GRANK.format('y')} AS ry FROM st) SELECT grp, count(*) AS n, round({CORR.format('rx', 'ry')}, 6) AS rho FROM k GROUP BY 1")
def spearman_within_groups(spark, sf):
    return rounded(X.spearman(study(spark, sf), "x", "y", "grp"))


@query("group_adjusted_rho", STUDY_SQL + f", k AS (SELECT grp, {RANK.format('x')} AS rx, {RANK.format('y')} AS ry FROM st), c AS (SELECT rx - avg(rx) OVER (PARTITION BY grp) AS cx, ry - avg(ry) OVER (PARTITION BY grp) AS cy FROM k) SELECT count(*) AS n, round({CORR.format('cx', 'cy')}, 6) AS rho FROM c")
def group_adjusted_rho(spark, sf):
    return rounded(X.adjusted_spearman(study(spark, sf), "x", "y", "grp"))


BUCKETS_SQL = STUDY_SQL + ", q AS (SELECT *, greatest(1, CAST(ceil(4 * (row_number() OVER (ORDER BY x, entity) - 1) / greatest(count(*) OVER () - 1, 1)) AS INT)) AS bucket FROM st)"


@query("drift_quartiles", BUCKETS_SQL + " SELECT bucket, count(*) AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(quantile_cont(y, 0.5), 6) AS median_y, round(avg(CAST(y > 0 AS INT)), 6) AS positive_share FROM q GROUP BY 1")
def drift_quartiles(spark, sf):
    q = X.quartile_by_rank(study(spark, sf), "x", "entity")
    return rounded(q.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.percentile("y", 0.5).alias("median_y"), F.avg((F.col("y") > 0).cast("int")).alias("positive_share")))


@query("value_octiles", STUDY_SQL + ", e AS (SELECT quantile_cont(x, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS e FROM st), b AS (SELECT x, y, len(list_filter(e.e, lambda z: z < x)) + 1 AS bucket FROM st, e) SELECT CAST(bucket AS INT) AS bucket, count(*) AS n, round(avg(y), 6) AS mean_y FROM b GROUP BY 1")
def value_octiles(spark, sf):
    return rounded(X.quantile_bucket(study(spark, sf), "x", 8).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y")))


GS_SQL = STUDY_SQL + ", gs AS (SELECT grp, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM st GROUP BY 1)"


@query("one_way_effect", GS_SQL + ", t AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * v) AS w, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS b FROM gs) SELECT k, n, round(b, 6) AS \"between\", round(w, 4) AS within, round((b / (k - 1)) / (w / (n - k)), 6) AS f, round(b / (b + w), 6) AS eta2, round((b - (k - 1) * w / (n - k)) / (b + w + w / (n - k)), 6) AS omega2, round(greatest((b - (k - 1) * w / (n - k)) / (b + w + w / (n - k)), 0), 6) AS omega2_clipped FROM t")
def one_way_effect(spark, sf):
    o = X.one_way(study(spark, sf), "y", "grp")
    return o.select("k", "n", r("between").alias("between"), r("within", 4).alias("within"), *(r(c).alias(c) for c in ("f", "eta2", "omega2", "omega2_clipped")))


@query("pairwise_hedges", GS_SQL + " SELECT p.grp AS a, q.grp AS b, round(q.m - p.m, 6) AS difference, round(sqrt((p.n * p.v + q.n * q.v) / (p.n + q.n - 2)), 6) AS pooled_sd, round((q.m - p.m) / sqrt((p.n * p.v + q.n * q.v) / (p.n + q.n - 2)), 6) AS cohen_d, round((q.m - p.m) / sqrt((p.n * p.v + q.n * q.v) / (p.n + q.n - 2)) * (1 - 3 / (4 * (p.n + q.n) - 9)), 6) AS hedges_g, CASE WHEN abs((q.m - p.m) / sqrt((p.n * p.v + q.n * q.v) / (p.n + q.n - 2)) * (1 - 3 / (4 * (p.n + q.n) - 9))) >= 0.8 THEN 'large' WHEN abs((q.m - p.m) / sqrt((p.n * p.v + q.n * q.v) / (p.n + q.n - 2)) * (1 - 3 / (4 * (p.n + q.n) - 9))) >= 0.5 THEN 'medium' WHEN abs((q.m - p.m) / sqrt((p.n * p.v + q.n * q.v) / (p.n + q.n - 2)) * (1 - 3 / (4 * (p.n + q.n) - 9))) >= 0.2 THEN 'small' ELSE 'negligible' END AS label FROM gs p JOIN gs q ON p.grp < q.grp")
def pairwise_hedges(spark, sf):
    return rounded(X.pairwise(study(spark, sf), "y", "grp").withColumn("label", S.effect_label(F.col("hedges_g"), 0.2, 0.5, 0.8)))


@query("bh_adjust", "WITH p AS (SELECT supplier.s_suppkey AS k, s_nationkey AS fam, (abs(s_acctbal) % 97) / 100 AS p FROM supplier), q AS (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY p, k) AS rn, count(*) OVER (PARTITION BY fam) AS m FROM p) SELECT k, fam, round(p, 6) AS p, round(least(1, min(p * m / rn) OVER (PARTITION BY fam ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_adjusted FROM q")
def bh_adjust(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("fam"), ((F.abs("s_acctbal") % 97) / 100).alias("p"))
    return rounded(X.adjusted(s, "p", "fam"))


CELLS_SQL = "WITH c AS (SELECT c_mktsegment AS s, n_regionkey AS g FROM customer JOIN nation ON n_nationkey = c_nationkey), k AS (SELECT a.s, b.g, (SELECT count(*) FROM c WHERE c.s = a.s AND c.g = b.g) AS n FROM (SELECT DISTINCT s FROM c) a CROSS JOIN (SELECT DISTINCT g FROM c) b), e AS (SELECT *, sum(n) OVER (PARTITION BY s) * sum(n) OVER (PARTITION BY g) / sum(n) OVER () AS expected FROM k)"


def _segments(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("s"), F.col("n_regionkey").alias("g"))


@query("contingency_table", CELLS_SQL + " SELECT s, g, n, round(expected, 6) AS expected FROM e")
def contingency_table(spark, sf):
    return rounded(X.cross_counts(_segments(spark, sf), "s", "g"))


@query("contingency_cramers_v", CELLS_SQL + " SELECT round(sum(pow(n - expected, 2) / expected), 6) AS chi2, (count(DISTINCT s) - 1) * (count(DISTINCT g) - 1) AS dof, CAST(sum(n) AS BIGINT) AS n, round(sqrt(sum(pow(n - expected, 2) / expected) / (sum(n) * (least(count(DISTINCT s), count(DISTINCT g)) - 1))), 6) AS cramers_v, round(min(expected), 6) AS least_expected, count_if(expected < 5) AS rare_cells FROM e")
def contingency_cramers_v(spark, sf):
    return rounded(X.chi_square(_segments(spark, sf), "s", "g"))


@query("kruskal_h", STUDY_SQL + f", k AS (SELECT kind, x, {RANK.format('x')} AS r FROM st), t AS (SELECT sum(pow(t, 3) - t) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM k GROUP BY x)), s AS (SELECT count(*) AS k, sum(m) AS n, sum(s * s / m) AS q FROM (SELECT kind, sum(r) AS s, CAST(count(*) AS DOUBLE) AS m FROM k GROUP BY 1)), h AS (SELECT k, n, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (pow(n, 3) - n)) AS h FROM s, t) SELECT k, CAST(n AS BIGINT) AS n, round(h, 6) AS h, round(greatest(0, (h - k + 1) / (n - k)), 6) AS epsilon2 FROM h")
def kruskal_h(spark, sf):
    return rounded(X.kruskal(study(spark, sf), "x", "kind"))


@query("auc", STUDY_SQL + f", k AS (SELECT CAST(y > 0 AS INT) AS y, {RANK.format('x')} AS r FROM st) SELECT count_if(y = 1) AS positives, count_if(y = 0) AS negatives, round((sum(CASE WHEN y = 1 THEN r END) - CAST(count_if(y = 1) AS DOUBLE) * (count_if(y = 1) + 1) / 2) / (CAST(count_if(y = 1) AS DOUBLE) * count_if(y = 0)), 6) AS auc FROM k")
def auc(spark, sf):
    return rounded(X.auc(study(spark, sf).select("x", (F.col("y") > 0).cast("int").alias("y")), "x", "y"))


@query("category_outcomes", STUDY_SQL + ", c AS (SELECT kind, y, y - avg(y) OVER (PARTITION BY grp) AS e FROM st) SELECT kind, count(*) AS n, round(avg(y), 6) AS mean, round(avg(e), 6) AS adjusted_mean, round(quantile_cont(e, 0.25), 6) AS adjusted_q25, round(quantile_cont(e, 0.75), 6) AS adjusted_q75 FROM c GROUP BY 1")
def category_outcomes(spark, sf):
    c = study(spark, sf).select("kind", "y", X.centred("y", "grp").alias("e"))
    return rounded(c.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.avg("e").alias("adjusted_mean"), F.percentile("e", 0.25).alias("adjusted_q25"), F.percentile("e", 0.75).alias("adjusted_q75")))


# ---- survey -----------------------------------------------------------------------------------


def _answers(spark, sf):
    """Conversation turns as survey rows: one id, three text answers."""
    t = table(spark, sf, "conversations")
    return t.select(F.concat(F.when(F.col("conv_id") % 5 == 0, " n").otherwise("N"), F.lpad(F.col("conv_id").cast("string"), 4, "0")).alias("id"), F.col("role").alias("q1"), F.when(F.col("turn") % 3 == 0, "Refused").when(F.col("turn") % 3 == 1, "").otherwise("Don't know").alias("q2"), (F.length("text") % 7).cast("string").alias("q3"))


ANSWERS_SQL = "WITH an AS (SELECT concat(CASE WHEN conv_id % 5 = 0 THEN ' n' ELSE 'N' END, lpad(CAST(conv_id AS VARCHAR), 4, '0')) AS id, role AS q1, CASE turn % 3 WHEN 0 THEN 'Refused' WHEN 1 THEN '' ELSE 'Don''t know' END AS q2, CAST(length(text) % 7 AS VARCHAR) AS q3 FROM conversations)"


@query("id_normalise", ANSWERS_SQL + ", i AS (SELECT DISTINCT id, upper(trim(id)) AS normalised FROM an) SELECT id, normalised, CASE WHEN regexp_full_match(normalised, 'N[0-9]{4}') THEN 'valid' ELSE 'malformed' END AS status FROM i")
def id_normalise(spark, sf):
    return _answers(spark, sf).select("id").distinct().select("id", S.identifier(F.col("id")).alias("normalised"), S.identifier_status(F.col("id")).alias("status"))


@query("survey_coalesce", ANSWERS_SQL + ", k AS (SELECT id, count(*) AS rows, list_distinct(list(q1)) AS a, list_distinct(list(nullif(q2, ''))) AS b, list_distinct(list(q3)) AS c, count(DISTINCT (q1, q2, q3)) AS kinds FROM an GROUP BY 1), s AS (SELECT *, len(list_filter(a, lambda x: x IS NOT NULL)) AS na, len(list_filter(b, lambda x: x IS NOT NULL)) AS nb, len(list_filter(c, lambda x: x IS NOT NULL)) AS nc FROM k) SELECT id, rows, CASE WHEN na = 1 THEN list_filter(a, lambda x: x IS NOT NULL)[1] END AS q1, CASE WHEN nb = 1 THEN list_filter(b, lambda x: x IS NOT NULL)[1] END AS q2, CASE WHEN nc = 1 THEN list_filter(c, lambda x: x IS NOT NULL)[1] END AS q3, CAST((na > 1)::INT + (nb > 1)::INT + (nc > 1)::INT AS INT) AS conflicts, CASE WHEN rows = 1 THEN 'single' WHEN na > 1 OR nb > 1 OR nc > 1 THEN 'conflict' WHEN kinds = 1 THEN 'exact_duplicate' ELSE 'complementary' END AS resolution FROM s")
def survey_coalesce(spark, sf):
    return V.coalesced(_answers(spark, sf), "id", ["q1", "q2", "q3"])


@query("survey_inventory", ANSWERS_SQL + ", l AS (SELECT 'q1' AS question, q1 AS a FROM an UNION ALL SELECT 'q2', q2 FROM an UNION ALL SELECT 'q3', q3 FROM an), c AS (SELECT question, CASE WHEN a = '' THEN 'blank' WHEN lower(a) LIKE '%refus%' THEN 'refused' WHEN lower(a) LIKE '%know%' THEN 'dont_know' ELSE 'valid' END AS k, a FROM l), n AS (SELECT question, a, count(*) AS n FROM c WHERE k = 'valid' GROUP BY 1, 2) SELECT c.question, count(*) AS rows, count_if(k = 'valid') AS valid, count_if(k = 'blank') AS blank, count_if(k = 'refused') AS refused, count_if(k = 'dont_know') AS dont_know, count_if(k = 'not_applicable') AS not_applicable, (SELECT count(*) FROM n WHERE n.question = c.question) AS distinct_answers, coalesce((SELECT min(n) FROM n WHERE n.question = c.question), 0) AS smallest_category FROM c GROUP BY 1")
def survey_inventory(spark, sf):
    return V.inventory(_answers(spark, sf), "id", ["q1", "q2", "q3"]).drop("top_answers").fillna(0, ["distinct_answers", "smallest_category"])


@query("survey_top_answers", ANSWERS_SQL + ", n AS (SELECT q3 AS answer, count(*) AS n FROM an GROUP BY 1) SELECT answer, n, CAST(row_number() OVER (ORDER BY n DESC, answer) AS INT) AS place FROM n ORDER BY 2 DESC, 1 LIMIT 3")
def survey_top_answers(spark, sf):
    top = V.inventory(_answers(spark, sf), "id", ["q3"], 3).select(F.posexplode(F.map_entries(F.from_json("top_answers", "map<string, bigint>"))).alias("i", "e"))
    return top.select("e.key", "e.value", (F.col("i") + 1).cast("int").alias("place")).toDF("answer", "n", "place")


@query("survey_routing", ANSWERS_SQL + " SELECT q1 = 'user' AND coalesce(TRY_CAST(q3 AS DOUBLE) < 4, false) AS q2_eligible, coalesce(q1 IN ('user', 'system'), false) AS q3_eligible, count(*) AS n FROM an GROUP BY 1, 2")
def survey_routing(spark, sf):
    routes = [V.Route("q1", "equals", "user", ("q2",)), V.Route("q3", "numeric_lt", 4, ("q2",)), V.Route("q1", "in", ("user", "system"), ("q3",))]
    return V.routed(_answers(spark, sf), routes).groupBy(F.col("q2__eligible").alias("q2_eligible"), F.col("q3__eligible").alias("q3_eligible")).agg(F.count(F.lit(1)).alias("n"))


LINK_SQL = "WITH c AS (SELECT doc_id AS id, lang FROM documents), a AS (SELECT DISTINCT doc_id AS id FROM labels), b AS (SELECT c.*, a.id IS NOT NULL AS has FROM c LEFT JOIN a USING (id))"


@query("survey_linkage", LINK_SQL + " SELECT lang AS stratum, count(*) AS members, count_if(has) AS linked, count_if(NOT has) AS unlinked FROM b GROUP BY 1 UNION ALL SELECT 'ALL', count(*), count_if(has), count_if(NOT has) FROM b")
def survey_linkage(spark, sf):
    return V.linkage(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"), table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "lang")


@query("survey_only_ids", "SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def survey_only_ids(spark, sf):
    """Documents that the cohort, those with a vector, does not have."""
    return V.only_answered(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")), table(spark, sf, "documents").select(F.col("doc_id").alias("id")), "id")


@query("availability_by_group", "WITH d AS (SELECT source AS g, lang AS k FROM documents), c AS (SELECT a.g, b.k, (SELECT count(*) FROM d WHERE d.g = a.g AND d.k = b.k) AS n FROM (SELECT DISTINCT g FROM d) a CROSS JOIN (VALUES ('en'), ('fr'), ('de'), ('es'), ('it')) b(k)) SELECT g, k, n, round(100 * n / sum(n) OVER (PARTITION BY g), 6) AS percent, n < 5 AS rare FROM c")
def availability_by_group(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("g"), F.col("lang").alias("k"))
    return rounded(V.availability(d, "g", "k", ["en", "fr", "de", "es", "it"]))


@query("left_join_default", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_default(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality", F.lit(True).alias("labelled"))
    return R.join_dimension(table(spark, sf, "documents").select("doc_id"), labels, ["doc_id"], {"quality": -1, "labelled": False})


@query("tri_state_or", "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_tax < 0.03 THEN NULL ELSE l_tax < 0.05 END OR CASE WHEN l_discount < 0.03 THEN NULL ELSE l_discount < 0.05 END AS INT)::DOUBLE AS either FROM lineitem")
def tri_state_or(spark, sf):
    part = lambda c: F.when(~(F.col(c) < 0.03), (F.col(c) < 0.05).cast("int"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.any_of(part("l_tax"), part("l_discount")).cast("double").alias("either"))


@query("fallback_variable", "SELECT doc_id, 'quality' AS chosen, CAST(quality AS VARCHAR) AS value FROM labels")
def fallback_variable(spark, sf):
    d = table(spark, sf, "labels").withColumn("scarce", F.when(F.col("doc_id") % 4 == 0, F.col("toxic")))
    return V.fallback(d, ["scarce", "quality"], 0.8).select("doc_id", "chosen", "value")


@query("recoded_answers", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' END AS value, CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN NULL WHEN '5-LOW' THEN NULL WHEN '4-NOT SPECIFIED' THEN 'not_asked' ELSE 'unrecognised' END AS reason FROM orders")
def recoded_answers(spark, sf):
    x = V.recoded(F.col("o_orderpriority"), {"1-urgent": "high", "2-high": "high", "5-low": "low"}, {"4-not specified": "not_asked"})
    return table(spark, sf, "orders").select("o_orderkey", x.alias("x")).select("o_orderkey", "x.value", "x.reason")


@query("parsed_answers", "SELECT p_partkey, CASE WHEN p_size BETWEEN 5 AND 40 THEN CAST(p_size AS DOUBLE) END AS value, CASE WHEN NOT p_size BETWEEN 5 AND 40 THEN 'out_of_range' END AS reason, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size BETWEEN 11 AND 30 THEN 'medium' WHEN p_size BETWEEN 31 AND 50 THEN 'large' END AS band FROM part")
def parsed_answers(spark, sf):
    x = S.int_in_range(F.col("p_size").cast("string"), 5, 40)
    return table(spark, sf, "part").select("p_partkey", x.alias("x"), S.band(F.col("p_size"), [(1, 10, "small"), (11, 30, "medium"), (31, 50, "large")]).alias("band")).select("p_partkey", F.col("x.value").cast("double").alias("value"), "x.reason", "band")


@query("best_id_column", "SELECT 'doc_id' AS \"column\", (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS matches, (SELECT count(DISTINCT doc_id) FROM documents) AS distinct_values")
def best_id_column(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") + 1_000_000).alias("n_chars"))
    return V.best_match(d, table(spark, sf, "labels"), "doc_id")


@query("sample_availability", "WITH d AS (SELECT lang AS g, CAST(quality AS VARCHAR) AS quality, CASE WHEN doc_id % 3 = 0 THEN CAST(toxic AS VARCHAR) END AS toxic FROM documents LEFT JOIN labels USING (doc_id)), l AS (SELECT g, 'quality' AS variable, quality AS category FROM d UNION ALL SELECT g, 'toxic', toxic FROM d), c AS (SELECT a.variable, a.category, b.g, (SELECT count(*) FROM l WHERE l.variable = a.variable AND l.category = a.category AND l.g = b.g) AS n FROM (SELECT DISTINCT variable, category FROM l WHERE category IS NOT NULL) a CROSS JOIN (SELECT DISTINCT g FROM l) b), s AS (SELECT variable, min(size) AS smallest_category, min(least) AS smallest_cell FROM (SELECT variable, category, CAST(sum(n) AS BIGINT) AS size, min(n) AS least FROM c GROUP BY 1, 2) GROUP BY 1) SELECT l.variable, count(category) AS available, count(*) - count(category) AS missing, any_value(smallest_category) AS smallest_category, any_value(smallest_cell) AS smallest_cell, any_value(smallest_cell) < 5 AS rare_cells FROM l JOIN s USING (variable) GROUP BY 1")
def sample_availability(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    d = d.select(F.col("lang").alias("g"), F.col("quality").cast("string").alias("quality"), F.when(F.col("doc_id") % 3 == 0, F.col("toxic").cast("string")).alias("toxic"))
    return V.sample_availability(d, ["quality", "toxic"], "g")


@query("relative_outcomes", FACTS_SQL + ", m AS (SELECT entity, strategy, avg(ae) AS mae, sqrt(avg(se)) AS rmse, avg(sm) AS smape FROM f WHERE strategy IN ('direct', 'full') GROUP BY 1, 2), w AS (SELECT entity, " + ", ".join(f"max(CASE WHEN strategy = '{s}' THEN {c} END) AS {s[0]}_{c}" for s in ("direct", "full") for c in ("mae", "rmse", "smape")) + " FROM m GROUP BY 1) SELECT entity, " + ", ".join(f"round(CASE WHEN abs(f_{c}) > 1e-12 THEN 100 * (f_{c} - d_{c}) / f_{c} END, 4) AS {c}" for c in ("mae", "rmse", "smape")) + " FROM w")
def relative_outcomes(spark, sf):
    m = M.pooled(facts(spark, sf).filter("strategy in ('direct', 'full')"), "entity", "strategy")
    pick = lambda s, c: F.max(F.when(F.col("strategy") == s, F.col(c)))
    return m.groupBy("entity").agg(*(r(S.safe_ratio(pick("full", c) - pick("direct", c), pick("full", c), scale=100.0), 4).alias(c) for c in ("mae", "rmse", "smape")))


@query("question_map", "SELECT 'Q' || q AS question, 'Q' || (q + 1) AS answers_of, CASE WHEN q BETWEEN 211 AND 250 THEN 'household' WHEN q BETWEEN 251 AND 300 THEN 'dwelling' ELSE 'other' END AS domain FROM (SELECT unnest(range(211, 345)) AS q)")
def question_map(spark, sf):
    return spark.createDataFrame(V.question_map(211, 344, 1, [(211, 250, "household"), (251, 300, "dwelling")]), "question string, answers_of string, domain string")


@query("wide_panel_long", "WITH w AS (SELECT n_nationkey AS i, n_name AS a, CAST(n_regionkey AS VARCHAR) AS b FROM nation) SELECT i, 'a' AS entity, TRY_CAST(a AS DOUBLE) AS value FROM w UNION ALL SELECT i, 'b', TRY_CAST(b AS DOUBLE) FROM w")
def wide_panel_long(spark, sf):
    w = table(spark, sf, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("a"), F.col("n_regionkey").cast("string").alias("b"))
    return w.unpivot(["i"], ["a", "b"], "entity", "text").select("i", "entity", S.clean_number(F.col("text")).alias("value"))


# ---- relations --------------------------------------------------------------------------------


@query("cohort_filter", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND trim(c_mktsegment) = 'BUILDING' AND c_acctbal > 0")
def cohort_filter(spark, sf):
    return R.require_unique(table(spark, sf, "customer").filter((F.col("c_nationkey") == 3) & (F.trim("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 0)).select("c_custkey"), "c_custkey")


@query("code_decode", "SELECT l_orderkey, l_linenumber, CAST(floor(l_partkey / 100) AS INT) AS day, CAST(l_partkey % 100 AS INT) AS slot, l_partkey % 100 BETWEEN 1 AND 48 AS standard, strftime(DATE '2009-01-01' + CAST(floor(l_partkey / 100) AS INT) - 1, '%Y-%m-%d') AS date FROM lineitem")
def code_decode(spark, sf):
    c = F.col("l_partkey")
    day, slot = S.day_of_code(c), S.slot_of_code(c)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", day.alias("day"), slot.alias("slot"), slot.between(1, 48).alias("standard"), F.date_format(S.date_of_day(day), "yyyy-MM-dd").alias("date"))


@query("period_filter", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 12:00:00' AND ts < TIMESTAMP '2024-01-09 07:00:00' AND CAST(ts AS DATE) NOT IN (DATE '2024-01-07')")
def period_filter(spark, sf):
    e = table(spark, sf, "events")
    day = F.col("ts").cast("date")
    return e.filter(S.in_period(day, F.hour("ts"), ("2024-01-05", 12), ("2024-01-09", 6)) & ~day.isin(F.lit("2024-01-07").cast("date"))).select("event_id")


@query("membership_join", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def membership_join(spark, sf):
    c = table(spark, sf, "customer")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return o.join(c.filter("c_acctbal > 5000"), o["o_custkey"] == c["c_custkey"], "left_semi").join(c.filter("c_mktsegment = 'BUILDING'"), o["o_custkey"] == c["c_custkey"], "left_anti")


@query("one_to_one_join", "SELECT doc_id, lang, toxic FROM documents JOIN labels USING (doc_id)")
def one_to_one_join(spark, sf):
    return R.join_one_to_one(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id", "toxic"), ["doc_id"])


@query("universe_difference", "(SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) UNION ALL (SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))")
def universe_difference(spark, sf):
    return R.differing(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("set_membership", "WITH k AS (SELECT doc_id FROM documents), a AS (SELECT doc_id FROM labels WHERE toxic = 1), b AS (SELECT doc_id FROM labels WHERE quality = 1) SELECT doc_id, 1 AS docs, CAST(doc_id IN (SELECT doc_id FROM a) AS INT) AS toxic, CAST(doc_id IN (SELECT doc_id FROM b) AS INT) AS quality FROM k")
def set_membership(spark, sf):
    lab = table(spark, sf, "labels")
    return R.membership({"docs": table(spark, sf, "documents"), "toxic": lab.filter("toxic = 1"), "quality": lab.filter("quality = 1")}, "doc_id").select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("docs", "toxic", "quality")))


@query("violation_counts", "SELECT 'positive' AS rule, count_if(NOT l_quantity > 0) AS rows FROM lineitem UNION ALL SELECT 'small_discount', count_if(NOT l_discount <= 0.05) FROM lineitem")
def violation_counts(spark, sf):
    return R.violations(table(spark, sf, "lineitem"), {"positive": "l_quantity > 0", "small_discount": "l_discount <= 0.05"})


@query("crosstab_zero_filled", "SELECT l_returnflag, count_if(l_linestatus = 'F') AS F, count_if(l_linestatus = 'O') AS O, count_if(l_linestatus = 'X') AS X FROM lineitem GROUP BY 1")
def crosstab_zero_filled(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O", "X"]).count().fillna(0)


@query("unpivoted", "SELECT s_suppkey, 'balance' AS name, round(s_acctbal, 6) AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier")
def unpivoted(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return rounded(s.unpivot(["s_suppkey"], ["balance", "nation"], "name", "value"))


@query("json_counts", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_counts(spark, sf):
    return table(spark, sf, "events").select(F.from_json("props", "k bigint")["k"].alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("local_wall_time", "WITH t AS (SELECT event_id, ts + to_days(CAST(event_id % 12 * 30 AS INT)) AS ts FROM events) SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London', '%Y-%m-%d %H:%M:%S') AS wall, CAST(date_diff('minute', ts, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/London') AS INT) AS offset_minutes FROM t")
def local_wall_time(spark, sf):
    """Times spread over the whole year, summer time included."""
    t = table(spark, sf, "events").select("event_id", F.expr("cast(ts as timestamp_ntz) + make_dt_interval(cast(event_id % 12 * 30 as int))").alias("ts"))
    return t.select("event_id", F.date_format(S.local_wall(F.col("ts")), "yyyy-MM-dd HH:mm:ss").alias("wall"), S.offset_minutes(F.col("ts")).alias("offset_minutes"))


@query("profile_groups", "WITH g AS (SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'Profile G2' WHEN 1 THEN 'group 3' WHEN 2 THEN ' 4 ' WHEN 3 THEN 'G5' WHEN 4 THEN 'g1 only' WHEN 5 THEN 'cluster group  1' WHEN 6 THEN '' ELSE '12' END AS text FROM customer) SELECT c_custkey, coalesce(CAST(nullif(regexp_extract(upper(trim(text)), '([1-4])$', 1), '') AS VARCHAR), 'none') AS profile_group FROM g")
def profile_groups(spark, sf):
    text = F.expr("case c_custkey % 8 when 0 then 'Profile G2' when 1 then 'group 3' when 2 then ' 4 ' when 3 then 'G5' when 4 then 'g1 only' when 5 then 'cluster group  1' when 6 then '' else '12' end")
    return table(spark, sf, "customer").select("c_custkey", F.coalesce(S.profile_group(text).cast("string"), F.lit("none")).alias("profile_group"))


@query("one_of_columns", "SELECT c_custkey, c_mktsegment AS segment, c_acctbal AS balance FROM customer")
def one_of_columns(spark, sf):
    """Columns found by their normalised names."""
    odd = table(spark, sf, "customer").select(F.col("c_custkey").alias("Cust Key"), F.col("c_mktsegment").alias("Market-Segment "), F.col("c_acctbal").alias("ACCT_BAL"))
    pick = lambda *names: F.col(f"`{S.one_column(odd.columns, *names)}`")
    return odd.select(pick("cust_key", "customer key").alias("c_custkey"), pick("market segment").alias("segment"), pick("acct bal", "balance").alias("balance"))


def _solved(name: str, source: str, fit: str, pull: float, start: str | None = None) -> str:
    """CTEs that fit one strategy: sums of products over its rows, then elimination, column by column, to weights w0 to w3 in `name`."""
    n = 4
    x = ["1.0", "x1", "x2", "x3"]
    drawn = [f"{pull} * (SELECT w{i} FROM {start})" if start else "0" for i in range(n)]
    cells = [f"coalesce(sum(CASE WHEN {fit} THEN {x[i]} * {x[j]} END), 0)" + (f" + {pull + 1e-6!r}" if i == j else "") + f" AS m{i}{j}" for i in range(n) for j in range(n)] + [f"coalesce(sum(CASE WHEN {fit} THEN {x[i]} * target END), 0) + {drawn[i].replace(str(pull), repr(pull + 1e-6), 1)} AS m{i}{n}" for i in range(n)]
    out = [f"{name}_0 AS MATERIALIZED (SELECT {', '.join(cells)} FROM {source})"]
    for k in range(n):
        cols = []
        for i in range(n):
            for j in range(n + 1):
                cols.append((f"m{k}{j} / m{k}{k}" if i == k else f"m{i}{j} - m{i}{k} / m{k}{k} * m{k}{j}") + f" AS m{i}{j}")
        out.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT {', '.join(cols)} FROM {name}_{k})")
    return ", ".join([*out, f"{name} AS MATERIALIZED (SELECT {', '.join(f'm{i}{n} AS w{i}' for i in range(n))} FROM {name}_{n})"])


_FITS = (("source", "entity % 2 = 0", 0.0, None), ("direct", "false", 1.0, "source"), ("tuned", "entity % 2 = 1 AND slot >= 15", 50.0, "source"), ("limited", "entity % 2 = 1 AND slot >= 15", 0.0, None), ("full", "entity % 2 = 1", 0.0, None))
LINEAR_SQL = (
    f"WITH {USER_SQL}, la AS (SELECT entity, slot, value AS target, lag(value, 3) OVER w AS x1, lag(value, 2) OVER w AS x2, lag(value, 1) OVER w AS x3 FROM g WINDOW w AS (PARTITION BY entity ORDER BY slot)), sa AS (SELECT * FROM la WHERE target IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL), tr AS (SELECT * FROM sa WHERE slot < 24), "
    + ", ".join(_solved(f"fit_{n}", "tr", fit, pull, start and f"fit_{start}") for n, fit, pull, start in _FITS)
    + ", pr AS (" + " UNION ALL ".join(f"SELECT '{n}' AS strategy, target AS actual, w0 + w1 * x1 + w2 * x2 + w3 * x3 AS predicted FROM sa, fit_{n} WHERE slot >= 24 AND entity % 2 = 1" for n, *_ in _FITS)
    + ") SELECT strategy, count(*) AS n, round(avg(abs(predicted - actual)), 4) AS mae, round(sqrt(avg(pow(predicted - actual, 2))), 4) AS rmse, round(avg(CASE WHEN abs(actual) + abs(predicted) > 1e-12 THEN 200 * abs(predicted - actual) / (abs(actual) + abs(predicted)) ELSE 0 END), 4) AS smape, round(avg(predicted - actual), 4) AS bias FROM pr GROUP BY 1"
)


@query("linear_forecast", LINEAR_SQL)
def linear_forecast(spark, sf):
    from gridloom.operators import forecast as A
    from gridloom.operators import grid as G

    s = G.input_arrays(user_grid(spark, sf), 3, 1).withColumn("domain", F.when(F.col("entity") % 2 == 0, "source").otherwise("target")).withColumn("recent", F.col("slot") >= 15)
    train, test = s.filter("slot < 24"), s.filter("slot >= 24 and domain = 'target'")
    p = A.predicted(test, A.fitted(train, 3))
    return rounded(M.pooled(p.withColumnRenamed("target", "actual"), "strategy"), 4)


@query("exact_quantiles", "SELECT l_returnflag AS flag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS q{i}" for i, p in enumerate((0.0, 0.25, 0.5, 0.9, 0.999, 1.0))) + " FROM lineitem GROUP BY 1")
def exact_quantiles(spark, sf):
    """Exact quantiles of all prices by flag, from the ranges that hold their ranks."""
    return rounded(X.quantiles(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").cast("double").alias("v")), "v", [0.0, 0.25, 0.5, 0.9, 0.999, 1.0], "flag"))


@query("lossless_join", "SELECT count(*) AS rows, count(l.doc_id) AS matched, count(DISTINCT CASE WHEN l.doc_id IS NULL THEN user_id END) AS lost_keys FROM events LEFT JOIN labels l ON l.doc_id = user_id")
def lossless_join(spark, sf):
    """A many-to-one join keeps all rows; keys that found nothing are counted by the guard."""
    facts_, side = table(spark, sf, "events").select(F.col("user_id").alias("doc_id")), table(spark, sf, "labels").select("doc_id", F.lit(1).alias("found"))
    joined = R.join_dimension(facts_, side, ["doc_id"])
    lost = R.unmatched(facts_, side, ["doc_id"]).agg(F.count(F.lit(1)).alias("lost_keys"))
    return joined.agg(F.count(F.lit(1)).alias("rows"), F.count("found").alias("matched")).crossJoin(F.broadcast(lost))  # one row


_SPEC = {"bands": [{"min": -1000, "max": 0, "label": "debt"}, {"min": 0.01, "max": 4999.99, "label": "some"}, {"min": 5000, "max": 10000, "label": "much"}]}


@query("bands_by_spec", "SELECT band, count(*) AS customers FROM (SELECT CASE WHEN b BETWEEN -1000 AND 0 THEN 'debt' WHEN b BETWEEN 0.01 AND 4999.99 THEN 'some' WHEN b BETWEEN 5000 AND 10000 THEN 'much' END AS band FROM (SELECT round(c_acctbal, 2) AS b FROM customer)) GROUP BY 1")
def bands_by_spec(spark, sf):
    """All balances by the bands of a stored spec."""
    import json

    from gridloom.sources.scratch import scratch

    path = scratch(spark, "spec")
    spark.createDataFrame([(json.dumps(_SPEC),)], "value string").coalesce(1).write.text(path)
    spec = config.load("\n".join(r[0] for r in spark.read.text(path).collect()))
    return table(spark, sf, "customer").select(F.round("c_acctbal", 2).alias("b")).select(config.banded("b", spec["bands"]).alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("customers"))


@query("network_forecast")
def network_forecast(spark, sf):
    """The convolutional and recurrent forecaster under the five transfer strategies, with the study's settings: windows of seven days."""
    from gridloom.operators import grid as G
    from gridloom.operators import network as N

    g = N.dealt(user_grid(spark, sf).withColumn("value", F.coalesce("value", F.lit(0.0))), "entity")
    scale = g.filter("slot < 20").groupBy("entity").agg(F.avg("value").alias("mean"), F.greatest(F.stddev_pop("value"), F.lit(0.01)).alias("std"))
    windows = G.input_features(g, scale, 7, 1, ORIGIN, 86400).withColumn("domain", F.when(F.col("entity") % 2 == 0, "source").otherwise("target")).withColumn("recent", F.col("slot") >= 14)
    rows = N.held(N.samples(windows, "entity", "slot", "domain", "recent"))
    fits = N.transfer(rows.filter("slot < 20"), rows.filter("slot between 20 and 23"))
    p = N.predicted(rows.filter("slot >= 24 and domain = 'target'"), {n: f.weights for n, f in fits.items()})
    return rounded(M.pooled(p.select("strategy", F.col("y").cast("double").alias("actual"), "predicted"), "strategy"), 4)
