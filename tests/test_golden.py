"""Hand-checkable values of single functions and statistics."""

import math
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.functions import special
from gridloom.operators import clustering, decomposition, forecast, grid, metrics, neighbours, profiles, relational, resampling, stats, survey, warping


def frame(spark, columns, rows):
    return spark.createDataFrame(rows, columns)


def values(df, column):
    return [r[column] for r in df.collect()]


def test_smape(spark):
    df = frame(spark, "a double, p double", [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (2.0, 1.0), (None, 1.0)])
    got = values(df.select(S.smape(F.col("a"), F.col("p")).alias("s")), "s")
    assert got[:3] == [0, 200, 0] and got[3] == pytest.approx(66.6666667) and got[4] is None


def test_dtw():
    d = lambda a, b: float(profiles.dtw_matrix(np.array([a], float), np.array([b], float))[0])
    assert d([0, 1, 2, 1, 0], [0, 0, 1, 2, 1]) == pytest.approx(1.0)
    assert d([0, 1, 2], [2, 1, 0]) == pytest.approx(2.8284271247)


def test_dtw_column(spark):
    df = frame(spark, "a array<double>, b array<double>", [([0.0, 1.0, 2.0], [2.0, 1.0, 0.0])])
    assert values(df.select(profiles.dtw("a", "b").alias("d")), "d")[0] == pytest.approx(8**0.5)


def test_effects(spark):
    df = frame(spark, "x double, g int", [(1.0, 1), (2.0, 1), (3.0, 1), (5.0, 2), (6.0, 2), (7.0, 2)])
    r = stats.one_way(df, "x", "g").first()
    assert (r["eta2"], r["omega2"], r["f"]) == (pytest.approx(0.8571428571), pytest.approx(0.7931034483), pytest.approx(24.0))
    assert stats.pairwise(df, "x", "g").first()["hedges_g"] == pytest.approx(3.2)


@pytest.mark.parametrize("p, want", [([0.01, 0.02, 0.5], [0.03, 0.03, 0.5]), ([0.04, 0.01, 0.03, 0.5], [0.0533333, 0.04, 0.0533333, 0.5])])
def test_step_up(spark, p, want):
    df = frame(spark, "i int, p double", [*enumerate(p), (9, None)])
    got = stats.adjusted(df, "p").orderBy("i").collect()
    assert [r["p_adjusted"] for r in got][:-1] == pytest.approx(want, abs=1e-6) and got[-1]["p_adjusted"] is None


def test_contingency(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 20 + [("b", "y")] * 10
    r = stats.chi_square(frame(spark, "r string, c string", rows), "r", "c").first()
    assert r["chi2"] == pytest.approx(6.6666667) and r["cramers_v"] == pytest.approx(0.3333333) and r["dof"] == 1


def test_ranks_and_kruskal(spark):
    df = frame(spark, "i int, x int, g int", [(i, x, i // 3) for i, x in enumerate([1, 2, 2, 3, 4, 5, 5, 6, 7])])
    got = df.select("i", stats.average_rank("x").alias("r")).orderBy("i")
    assert values(got, "r") == [1, 2.5, 2.5, 4, 5, 6.5, 6.5, 8, 9]
    r = stats.kruskal(df, "x", "g").first()
    assert r["h"] == pytest.approx(6.9378531073) and r["epsilon2"] == pytest.approx(0.8229755179)


def test_auc_and_spearman(spark):
    assert stats.auc(frame(spark, "y int, s double", [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)]), "s", "y").first()["auc"] == pytest.approx(0.75)
    df = frame(spark, "x int, y int", list(zip(range(1, 6), [5, 6, 7, 8, 7])))
    assert stats.spearman(df, "x", "y").first()["rho"] == pytest.approx(0.8207826817)


def test_decomposition(spark):
    df = frame(spark, "g int, bin string, share double, mae double", [(1, "a", 0.5, 1.0), (1, "b", 0.5, 2.0), (2, "a", 0.2, 2.0), (2, "b", 0.8, 3.0)])
    r = decomposition.decompose(df, "mae", "g").first()
    assert (r["total"], r["composition"], r["conditional"], r["identity_holds"]) == (pytest.approx(1.3), pytest.approx(0.3), pytest.approx(1.0), True)


def test_rank_quartiles(spark):
    df = frame(spark, "x int", [(i,) for i in range(1, 11)])
    assert values(stats.quartile_by_rank(df, "x", "x").orderBy("x"), "bucket") == [1, 1, 1, 2, 2, 3, 3, 4, 4, 4]


def test_ranks_over_ranges(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 400, 3000) / 8
    df = frame(spark, "i int, x double", [(i, float(v)) for i, v in enumerate(x)]).repartition(5)
    got = stats.with_average_ranks(df, rank="x").orderBy("i").toPandas()["rank"]
    assert (got == pd.Series(x).rank()).all()


def test_silhouettes_of_fits(spark):
    """Fits over the matrix of warping distances, against NumPy."""
    rng = np.random.default_rng(0)
    x = np.concatenate([np.eye(5)[[k]].repeat(7, 0) for k in (0, 2, 4)]) + rng.normal(0, 0.2, (21, 5))
    df = frame(spark, "entity int, profile array<double>", [(i, v.tolist()) for i, v in enumerate(x)])
    d = np.stack([profiles.dtw_matrix(x, np.repeat(v[None], len(x), 0)) for v in x], 1)
    pairs = profiles.dtw_pairs(df)
    assert {(r["a"], r["b"]): pytest.approx(r["d"]) for r in pairs.collect()} == {(a, b): d[a, b] for a in range(21) for b in range(a + 1, 21)}
    done = clustering.study(df, [(2, 1), (2, 2), (3, 1), (3, 2)])
    fits = done.labels
    got = {(r["k"], r["seed"]): r["silhouette"] for r in profiles.silhouette(fits, pairs, "k", "seed").collect()}
    assert {(r["k"], r["seed"]): pytest.approx(r["silhouette"]) for r in profiles.warped_silhouettes(df, fits).collect()} == got
    for (k, s), one in fits.toPandas().sort_values("entity").groupby(["k", "seed"]):
        label = one["label"].to_numpy()
        score = []
        for i in range(21):
            mean = {c: d[i, (label == c) & (np.arange(21) != i)].mean() for c in set(label) if ((label == c) & (np.arange(21) != i)).any()}
            inner, outer = mean.pop(label[i], None), min(v for c, v in mean.items() if c != label[i])
            score.append(0 if inner is None else (outer - inner) / max(inner, outer))
        assert got[k, s] == pytest.approx(np.mean(score))
    best = profiles.best_run(clustering.sizes(fits).join(spark.createDataFrame([(k, s, v) for (k, s), v in got.items()], "k int, seed int, silhouette double"), ["k", "seed"])).first()
    assert best["silhouette"] >= np.median(list(got.values()))


def test_small_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()["v"]
    assert get(S.circular_difference(F.lit(1), F.lit(48), 48)) == 1
    assert get(S.safe_ratio(F.lit(1.0), F.lit(0.0), scale=100.0)) is None
    assert get(S.identifier(F.lit(" n0217 "))) == "N0217"
    assert get(S.identifier_status(F.lit(" n0217 "))) == "valid" and get(S.identifier_status(F.lit("D0001"))) == "out_of_scope" and get(S.identifier_status(F.lit(" "))) == "blank"
    assert get(S.identifier(F.lit("123.0"))) == "123"
    assert get(S.category(F.lit("1.0"))) == "1" and get(S.category(F.lit("nan"))) is None
    assert get(S.profile_group(F.lit("Group 3"))) == 3 and get(S.profile_group(F.lit("G9"))) is None and get(S.profile_group(F.lit("Profile G2 "))) == 2
    assert get(S.yes_no(F.lit("Don't know")))["reason"] == "dont_know" and get(S.yes_no(F.lit("yes")))["value"] == 1
    assert get(S.any_of(F.lit(0), F.lit(None).cast("int"))) is None and get(S.any_of(F.lit(1), F.lit(None).cast("int"))) == 1 and get(S.any_of(F.lit(0), F.lit(0))) == 0
    assert get(S.load_bin(F.lit(0.1))) == "(0,0.1]" and get(S.load_bin(F.lit(0.0))) == "zero" and get(S.load_bin(F.lit(2.0))) == ">1"
    assert str(get(S.local_wall(F.lit("2013-07-01 12:00:00").cast("timestamp_ntz")))) == "2013-07-01 13:00:00"
    assert get(S.offset_minutes(F.lit("2013-07-01 12:00:00").cast("timestamp_ntz"))) == 60
    assert get(S.clean_number(F.lit("x"))) is None and get(S.clean_number(F.lit("NaN"))) is None
    assert S.one_column(["A b", "c"], "a_b") == "A b"
    with pytest.raises(ValueError):
        S.one_column(["a b", "A-B"], "a b")


def test_tails():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert special.f_tail(24.0, 1, 4) == pytest.approx(0.0080499, abs=1e-6)
    assert special.chi2_tail(6.6666667, 1) == pytest.approx(0.0098233, abs=1e-6)
    assert special.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857143, abs=1e-6)


def test_windows_against_loops(spark):
    rng = np.random.default_rng(0)
    rows = [(e, s, None if rng.random() < 0.15 else float(rng.integers(0, 3))) for e in range(3) for s in range(40)]
    by = {(e, s): v for e, s, v in rows}
    got = grid.windows(frame(spark, "entity int, slot int, value double", rows), 4, [1, 3], 0).collect()
    assert len(got) == 3 * (40 - 4) + 3 * (40 - 6)
    for r in got:
        w = [by[r["entity"], s] for s in range(r["slot"] - r["lead"] - 3, r["slot"] - r["lead"] + 1)]
        assert r["complete"] == all(x is not None for x in w)
        assert r["changes"] == sum(a is not None and b is not None and a != b for a, b in zip(w, w[1:]))
        assert r["valid"] == (r["complete"] and r["value"] is not None)


def test_repeated_wall_times(spark):
    hours = pd.DataFrame({"ts": pd.date_range("2013-10-26 22:00", periods=10, freq="30min")})
    clock = spark.createDataFrame(hours).select(F.col("ts").cast("timestamp_ntz").alias("ts"))
    clock = clock.withColumn("wall", S.local_wall(F.col("ts")))
    got = grid.repeated_wall_times(clock).filter("is_repeated").collect()
    assert len(got) == 4 and sorted(r["occurrence"] for r in got) == [1, 1, 2, 2]


def test_survey_rows(spark):
    rows = [("a", "1", "x"), ("b", "1", "x"), ("b", "1", "x"), ("c", "1", None), ("c", None, "y"), ("d", "1", "x"), ("d", "2", "x")]
    got = {r["id"]: (r["q1"], r["q2"], r["resolution"]) for r in survey.coalesced(frame(spark, "id string, q1 string, q2 string", rows), "id", ["q1", "q2"]).collect()}
    assert got == {"a": ("1", "x", "single"), "b": ("1", "x", "exact_duplicate"), "c": ("1", "y", "complementary"), "d": (None, "x", "conflict")}


def test_join_guards(spark):
    a = frame(spark, "k int, x int", [(1, 1), (1, 2)])
    with pytest.raises(relational.CardinalityError):
        relational.join_one_to_one(a, a, ["k"])
    assert relational.unmatched(a, frame(spark, "k int", [(2,)]), ["k"]).count() == 1


def test_gain_identities(spark):
    rng = np.random.default_rng(1)
    rows = [(e, s, float(rng.random())) for e in range(20) for s in ("direct", "tuned", "limited", "full")]
    g = {(r["entity"], r["gain"]): r["value"] for r in metrics.gains(frame(spark, "entity int, strategy string, mae double", rows), "mae", "entity").collect()}
    for e in range(20):
        assert g[e, "limited_vs_tuned"] == pytest.approx(g[e, "source_transfer"] + g[e, "fine_tuning"])
        assert g[e, "direct_vs_full"] == pytest.approx(g[e, "source_transfer"] - g[e, "full_data"])


def test_draws_are_spread_evenly(spark):
    n = spark.range(1, 2001).selectExpr(f"{resampling.draw('id', '7', 3)} % 10 AS d").groupBy("d").count().toPandas()["count"]
    assert len(n) == 10 and n.min() > 150 and n.max() < 250


def test_resampling_is_reproducible(spark):
    rows = [(i, i % 3 + 1, float((i * 7919) % 101) + 10 * (i % 3), "ab"[i % 2]) for i in range(60)]
    df = frame(spark, "i int, g int, x double, k string", rows)
    one, two = (resampling.permutation_effect(df.repartition(n), "i", "x", "g", 199).first() for n in (1, 3))
    assert one == two and 0 < one["p"] <= 1
    b = resampling.bootstrap_effect(df, "i", "x", "g", 100).first()
    assert b["eta2_low"] <= b["eta2_high"]


def test_resampling_agrees_with_numpy(spark):
    """p values and intervals against NumPy's own random numbers, within what chance allows."""
    rng = np.random.default_rng(1)
    g = np.arange(90) % 3 + 1
    x = rng.normal(0, 1, 90) + 0.35 * (g == 2)
    df = frame(spark, "i int, g int, x double", [(i, int(a), float(b)) for i, (a, b) in enumerate(zip(g, x))])
    eta = lambda y: sum((g == k).sum() * (y[g == k].mean() - y.mean()) ** 2 for k in (1, 2, 3)) / ((y - y.mean()) ** 2).sum()
    p = np.mean([eta(rng.permutation(x)) >= eta(x) for _ in range(3000)])
    got = resampling.permutation_effect(df, "i", "x", "g", 1999).first()
    assert got["eta2"] == pytest.approx(eta(x)) and got["p"] == pytest.approx(p, abs=0.05)
    d = [rng.choice(x[g == 2], 30).mean() - rng.choice(x[g == 1], 30).mean() for _ in range(3000)]
    got = resampling.permutation_difference(df, "i", "x", "g", 1, 2, 1999).first()
    assert got["difference"] == pytest.approx(x[g == 2].mean() - x[g == 1].mean())
    assert (got["low"], got["high"]) == pytest.approx(tuple(np.quantile(d, [0.025, 0.975])), abs=0.1)


def test_partial_r2(spark):
    rng = np.random.default_rng(2)
    g, k = np.arange(80) % 4 + 1, rng.integers(0, 4, 80)
    y = rng.normal(0, 1, 80) + 0.5 * g + 0.8 * (k == 2)
    df = frame(spark, "i int, g int, k string, y double", [(i, int(a), "pqrs"[b], float(c)) for i, (a, b, c) in enumerate(zip(g, k, y))])
    got = resampling.partial_r2(df, "i", "y", "g", "k", 500).first()
    dummies = lambda v: np.stack([v == z for z in np.unique(v)[1:]], 1).astype(float)
    def r2(*parts):
        m = np.column_stack([np.ones(80), *parts])
        return 1 - ((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    one, two = r2(dummies(g)), r2(dummies(g), dummies(k))
    assert (got["r2_group"], got["r2_full"], got["partial_r2"]) == pytest.approx((one, two, (two - one) / (1 - one)))


def plain_kmeans(x, centres, rounds, tolerance):
    """The same rounds over one array, pair by pair."""

    def matrix(c, v):
        m = np.full((len(c) + 1, len(v) + 1), np.inf)
        m[0, 0] = 0
        for i in range(len(c)):
            for j in range(len(v)):
                m[i + 1, j + 1] = (c[i] - v[j]) ** 2 + min(m[i, j], m[i, j + 1], m[i + 1, j])
        return m

    before = np.inf
    for n in range(1, rounds + 1):
        every = [[matrix(c, v) for c in centres] for v in x]
        d = np.array([[m[-1, -1] for m in row] for row in every])
        label, inertia = d.argmin(1), d.min(1).mean()
        new, empty = centres.copy(), [c for c in range(len(centres)) if not (label == c).any()]
        for c in range(len(centres)):
            held = [[] for _ in range(x.shape[1])]
            for v, row in zip(x[label == c], [r for r, own in zip(every, label) if own == c]):
                i, j = len(v) - 1, len(v) - 1
                while i >= 0 and j >= 0:
                    held[i].append(v[j])
                    way = int(np.argmin([row[c][i, j], row[c][i, j + 1], row[c][i + 1, j]]))
                    i, j = i - (way != 2), j - (way != 1)
            if any(held):
                new[c] = [np.mean(h) for h in held]
        if empty:
            new[empty[0]] = x[d.min(1).argmax()]
        centres = new
        if abs(before - inertia) < tolerance:
            break
        before = inertia
    d = np.array([[matrix(c, v)[-1, -1] for c in centres] for v in x])
    return d.argmin(1), centres, np.sqrt(d.min(1)), n


def test_kmeans_rounds(spark):
    """All fits at once, over several tasks, against one array; rows of low signal are labelled, not fitted on."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (40, 12)).cumsum(1)
    low = rng.random(40) < 0.2
    df = frame(spark, "entity int, profile array<double>, low_signal boolean", [(i, v.tolist(), bool(s)) for i, (v, s) in enumerate(zip(x, low))]).repartition(3)
    fits = [(2, 1), (3, 1), (3, 2), (5, 9), (1, 0)]
    done = clustering.study(df, fits)
    keyed = df.filter("not low_signal").select(F.xxhash64("entity").alias("key"), "profile")
    began = clustering.starts(keyed, fits)
    assert all(any(np.array_equal(c, v) for v in x[~low]) for f in fits for c in began[f]) and all(len(began[f]) == f[0] for f in fits)
    runs = {(r["k"], r["seed"]): r for r in done.runs.collect()}
    labels = done.labels.toPandas()
    for f in fits:
        _, centres, _, n = plain_kmeans(x[~low], began[f], 100, 1e-6)
        label, distance = assigned(x, centres)
        mine = labels[(labels["k"] == f[0]) & (labels["seed"] == f[1])].sort_values("entity")
        assert np.allclose(done.centres[f], centres, atol=1e-8) and runs[f]["rounds"] == n and runs[f]["settled"]
        assert (mine["label"].to_numpy() == label).all() and np.allclose(mine["distance"], distance)
    got = {(r["k"], r["seed"]): r for r in clustering.sizes(done.labels).collect()}
    for f in fits:
        label, distance = assigned(x, done.centres[f])
        n = np.bincount(label)
        n = n[n > 0]
        shares = [low[label == c].mean() for c in set(label)]
        assert (got[f]["clusters"], got[f]["least_share"], got[f]["size_cv"]) == (len(n), pytest.approx(n.min() / 40), pytest.approx(n.std() / n.mean()))
        assert (got[f]["inertia"], got[f]["largest_low_signal_share"]) == (pytest.approx((distance[~low] ** 2).mean()), pytest.approx(max(shares)))


def assigned(x, centres):
    d = np.stack([profiles.dtw_matrix(x, np.repeat(c[None], len(x), 0)) for c in centres], 1)
    return d.argmin(1), d.min(1)


def test_kmeans_odd_profiles(spark):
    """Equal profiles, an empty cluster that takes the farthest one, and no profiles."""
    same = frame(spark, "entity string, profile array<double>", [(str(i), [1.0, 2.0]) for i in range(5)])
    done = clustering.study(same, [(3, 1)])
    assert {r["label"] for r in done.labels.collect()} == {0} and done.runs.first()["settled"]
    two = frame(spark, "entity int, profile array<double>", [(i, [float(i // 4 * 10)] * 3) for i in range(8)])
    done = clustering.study(two, [(2, 0)], begin={(2, 0): np.array([[0.0] * 3, [90.0] * 3])})
    assert sorted(r["label"] for r in done.labels.collect()) == [0] * 4 + [1] * 4
    none = clustering.study(same.limit(0), [(2, 1)])
    assert none.labels.count() == none.runs.count() == 0


def test_starts_follow_distances(spark):
    """The first centre is any row alike; the second one is drawn in proportion to squared distances."""
    df = frame(spark, "key long, profile array<double>", [(k, [v, v]) for k, v in enumerate((0.0, 1.0, 3.0))])
    found = clustering.starts(df, [(2, s) for s in range(600)])
    first = np.array([c[0][0] for c in found.values()])
    assert all(abs((first == v).mean() - 1 / 3) < 0.07 for v in (0, 1, 3))
    second = np.array([c[1][0] for c in found.values() if c[0][0] == 0])
    assert abs((second == 3).mean() - 0.9) < 0.07


def test_nearest_shapes_by_bounds(spark):
    rng = np.random.default_rng(5)
    x, shapes = rng.normal(0, 1, (200, 48)).cumsum(1), rng.normal(0, 1, (9, 48)).cumsum(1)
    x[:3], shapes[4] = shapes[:3], shapes[2]  # exact hits and a tie
    who, best, ended = warping.nearest_two(x, shapes)
    d = warping.all_squared(x, shapes)
    order = np.argsort(d, 1, kind="stable")[:, :2]
    assert (who == order).all() and np.array_equal(best, np.take_along_axis(d, order, 1))
    assert (ended.sum(1) == 9).all() and ended[:, 3].sum() < 0.6 * 9 * 200 and (ended.sum(0) > 0).all()
    bound = np.stack([warping.envelope(warping.least_costs(x, c), x, c) for c in shapes], 1)
    assert (bound <= d + 1e-9).all() and (warping.ends(x, shapes) <= d + 1e-9).all()
    one = warping.search(frame(spark, "entity int, profile array<double>", [(0, [1.0, 2.0])]), [("a", np.array([1.0, 4.0]))]).first()
    assert (one["assigned"], one["second"], one["nearest_distance"], one["second_distance"], one["filled"]) == ("a", None, 2.0, None, 1)


def test_pairs_of_blocks(spark, monkeypatch):
    """Blocks go by number, whatever order rows arrive in."""
    monkeypatch.setattr(profiles, "BLOCK", 8)
    x = np.random.default_rng(1).normal(0, 1, (50, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    for seed in range(2):
        np.random.default_rng(seed).shuffle(rows)
        got = profiles.dtw_pairs(frame(spark, "entity int, profile array<double>", rows).repartition(7)).collect()
        assert {(r["a"], r["b"]) for r in got} == {(a, b) for a in range(50) for b in range(a + 1, 50)} and len(got) == 50 * 49 // 2


@pytest.mark.parametrize("dims", [2, 20])
def test_neighbours_by_pivots_and_rings(spark, monkeypatch, dims):
    """Against all pairs, in blocks of a few rows; where dimensions are few most pairs are never compared."""
    monkeypatch.setattr(profiles, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "ROWS", 12)
    rng = np.random.default_rng(dims)
    x, group, source = rng.normal(0, 1, (700, dims)), rng.choice(3, 700, p=[0.8, 0.19, 0.01]), rng.random(700) < 0.7
    x[:30] = x[30:60]  # equal profiles
    rows = [(i, int(g), bool(s), v.tolist()) for i, (g, s, v) in enumerate(zip(group, source, x))]
    every = frame(spark, "entity int, group int, is_source boolean, profile array<double>", rows).repartition(5)
    got = {(r["entity"], r["is_source"]): r for r in neighbours.nearest_distances(every, every.filter("is_source"), 25).collect()}
    compared = 0
    for i in range(700):
        others = np.array([j for j in range(700) if source[j] and group[j] == group[i] and j != i])
        want = np.sort(np.sqrt(((x[i] - x[others]) ** 2).mean(1)))[:25] if len(others) else []
        assert np.allclose(got[i, bool(source[i])]["near"] if len(want) else [], want)
        compared += got[i, bool(source[i])]["compared"]
    pairs = sum(int((source & (group == group[i])).sum()) - int(source[i]) for i in range(700))
    assert compared <= pairs and (dims > 2 or compared < 0.5 * pairs)


def test_random_tables(spark):
    """Margins hold; cells have their distribution; the stream does not depend on partitions."""
    got = resampling.random_tables(spark, [7, 5, 0, 3], [6, 9, 0], 1234, 5).toPandas()
    t = np.stack(got["cells"]).reshape(-1, 4, 3)
    assert (t.sum(2) == [7, 5, 0, 3]).all() and (t.sum(1) == [6, 9, 0]).all() and (t >= 0).all() and sorted(got["r"]) == list(range(1, 1235))
    again = resampling.random_tables(spark, [7, 5, 0, 3], [6, 9, 0], 1234, 5).repartition(7).toPandas().sort_values("r")
    assert np.array_equal(np.stack(again["cells"]), np.stack(got.sort_values("r")["cells"]))
    n = np.stack(resampling.random_tables(spark, [8, 12], [10, 10], 40_000, 1).toPandas()["cells"])[:, 0]
    want = np.array([math.comb(10, k) * math.comb(10, 8 - k) for k in range(9)]) / math.comb(20, 8)
    seen = np.bincount(n, minlength=9)
    assert ((seen - 40_000 * want) ** 2 / np.maximum(40_000 * want, 1e-9)).sum() < 35
    with pytest.raises(ValueError):
        resampling.random_tables(spark, [1], [2], 1)
    rng = np.random.default_rng(0)
    df = frame(spark, "entity int, a string, b int", [(i, None if i == 3 else "xyz"[int(v)], int(w)) for i, (v, w) in enumerate(zip(rng.integers(0, 3, 90), rng.integers(0, 4, 90)))])
    own = resampling.monte_carlo_tables(df, "a", "b", 5000).first()
    other = resampling.monte_carlo_chi_square(df.filter("a is not null"), "entity", "a", "b", 2000).first()
    assert own["chi2"] == pytest.approx(other["chi2"]) and own["wrong_margins"] == 0 and own["tables"] == 5000 and abs(own["p"] - other["p"]) < 0.06


def test_bootstrap_by_counts(spark, monkeypatch):
    """Counts sum to the rows; sums have the mean and variance of draws with replacement; partitions don't matter."""
    monkeypatch.setattr(resampling, "BLOCK", 16)
    rng = np.random.default_rng(6)
    x, g = rng.normal(3, 2, 130), np.array(["a"] * 100 + ["b"] * 29 + ["c"])
    df = frame(spark, "entity int, g string, x double", [(i, str(v), float(w)) for i, (v, w) in enumerate(zip(g, x))])
    got = resampling.bootstrap_sums(df.repartition(5), "entity", {"x": F.col("x")}, 600, 4, "g").toPandas()
    assert len(got) == 1800 and all((own["n"] == (g == k).sum()).all() for k, own in got.groupby("g"))
    again = resampling.bootstrap_sums(df.repartition(2), "entity", {"x": F.col("x")}, 600, 4, "g").toPandas()
    key = ["g", "r"]
    assert got.sort_values(key)["x"].to_numpy() == pytest.approx(again.sort_values(key)["x"].to_numpy())
    for k in "ab":
        v, s = x[g == k], got[got["g"] == k]["x"]
        assert abs(s.mean() - v.sum()) < 5 * np.sqrt(len(v) * v.var() / 600) and 0.8 < s.var() / (len(v) * v.var()) < 1.25
    whole = resampling.bootstrap_sums(df, "entity", {"x": F.col("x")}, 20, 4).toPandas()
    assert len(whole) == 20 and (whole["n"] == 130).all()
    one = resampling.bootstrap_effect_by_counts(df.filter("g <> 'c'"), "entity", "x", "g", 400).first()
    assert 0 <= one["eta2_low"] <= one["eta2_high"] <= 1


def test_quantiles_by_ranges(spark):
    rng = np.random.default_rng(4)
    x, g = np.where(rng.random(3000) < 0.3, 5.0, rng.normal(0, 10, 3000)), rng.choice(3, 3000, p=[0.9, 0.0995, 0.0005])
    df = frame(spark, "g int, x double", [(int(a), float(b)) for a, b in zip(g, x)] + [(0, None), (9, None)]).repartition(4)
    p = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    for r in stats.quantiles(df, "x", p, "g").collect():
        assert list(r)[1:] == pytest.approx(np.quantile(x[g == r["g"]], p).tolist())
    assert list(stats.quantiles(df, "x", p).first()) == pytest.approx(np.quantile(x, p).tolist())
    assert stats.quantiles(df.limit(0), "x", [0.5]).count() == 0


def test_clusters_split(spark):
    """Two shapes, of which the second one falls apart."""
    rng = np.random.default_rng(0)
    base = np.eye(12)[[1] * 10 + [6] * 6 + [10] * 6] * 5 + rng.normal(0, 0.05, (22, 12))
    df = frame(spark, "entity int, profile array<double>", [(i, v.tolist()) for i, v in enumerate(base)])
    begin = {(2, 1): base[[0, 10]], (3, 1): base[[16, 10, 0]]}
    done = clustering.study(df, [(2, 1), (3, 1)], begin=begin)
    r = clustering.splits(done, 2).first()
    n = done.labels.groupBy("k", "label").count().toPandas()
    assert r["seed"] == 1 and r["overlap"] + r["extra_n"] == 22 and 0 < r["purity"] <= 1 and r["entropy"] >= 0
    assert r["extra_n"] == n[(n["k"] == 3) & (n["label"] == r["extra"])]["count"].iloc[0]
    more = done.centres[3, 1]
    apart = lambda i, j: float(profiles.dtw_matrix(more[[i]], more[[j]])[0])
    assert r["extra_to_retained"] == pytest.approx(apart(r["extra"], r["retained"])) and r["distinctness"] == pytest.approx(apart(r["extra"], r["retained"]) / np.median([apart(0, 1), apart(0, 2), apart(1, 2)]))
    assert r["extra_peak"] == more[r["extra"]].argmax() + 1 and r["extra_band"] == (r["extra_peak"] - 1) // 4 + 1


def test_shares_by_ranges(spark):
    rng = np.random.default_rng(2)
    v, w, g, s = rng.integers(0, 50, 900) / 4, rng.random(900), rng.integers(0, 2, 900), rng.random(900) < 0.6
    df = frame(spark, "entity int, group int, is_source boolean, v double, w double", [(i, int(a), bool(b), float(c), float(d)) for i, (a, b, c, d) in enumerate(zip(g, s, v, w))]).repartition(3)
    for r in neighbours.shares_at_least(df, of_v="v", of_w="w").collect():
        own = s & (g == r["group"])
        assert r["of_v"] == pytest.approx(100 * (v[own] >= r["v"]).mean()) and r["of_w"] == pytest.approx(100 * (w[own] >= r["w"]).mean())


def test_assignment():
    """Against all permutations, with ties, and at a size that no enumeration reaches."""
    assert profiles.best_assignment(np.array([[5.0, 1.0, 9.0], [1.0, 5.0, 9.0]])) == [1, 0]
    rng = np.random.default_rng(0)
    for t in range(300):
        n, m = int(rng.integers(1, 6)), 6
        cost = rng.integers(0, 5, (n, m)).astype(float) if t % 2 else rng.normal(0, 1, (n, m))
        got = profiles.best_assignment(cost)
        assert len(set(got)) == n and cost[np.arange(n), got].sum() == pytest.approx(min(cost[np.arange(n), list(p)].sum() for p in permutations(range(m), n)))
    cost = rng.random((150, 160))
    got = profiles.best_assignment(cost)
    assert len(set(got)) == 150
    # No exchange of two columns, and no free column, is cheaper.
    used, own = np.array(got), cost[np.arange(150), got]
    assert (cost[:, used] + cost[:, used].T >= own[:, None] + own[None] - 1e-12).all() and (cost[:, list(set(range(160)) - set(got))].min(1) >= own - 1e-12).all()
    with pytest.raises(ValueError):
        profiles.best_assignment(np.zeros((2, 1)))


def test_linear_forecast_recovers_weights(spark):
    rng = np.random.default_rng(0)
    x = rng.random((300, 2))
    rows = [("target" if i % 2 else "source", i % 3 == 0, [float(a), float(b)], float(1 + 2 * a - b)) for i, (a, b) in enumerate(x)]
    w = forecast.fitted(frame(spark, "domain string, recent boolean, input array<double>, target double", rows), 2)
    assert w["full"] == pytest.approx([1, 2, -1], abs=1e-3) and w["direct"] == pytest.approx(w["source"], abs=1e-2)


def test_regrouped_sums_match_sorted_rows(spark, monkeypatch):
    """Sums by drawn places are those of all rows in order, also for replicates whose places lie far off; what is sent grows slower than rows."""
    rng = np.random.default_rng(3)
    rows = [(i * 5, None if i % 50 == 0 else int(g), None if i % 70 == 0 else float(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 3000), rng.integers(0, 40, 3000)))]
    df = frame(spark, "entity long, g int, x double", rows)
    want = resampling._regrouped(df, "entity", ["x"], "g", 40, 2).groupBy("r", "g").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s")).toPandas().sort_values(["r", "g"])
    for reach in (6.0, 0.3):
        monkeypatch.setattr(resampling, "REACH", reach)
        got = resampling.regrouped_sums(df, "entity", {"s": F.col("x")}, "g", 40, 2).toPandas().sort_values(["r", "g"])
        assert len(got) == len(want) and (got["n"].to_numpy() == want["n"].to_numpy()).all() and np.allclose(got["s"], want["s"])


def test_drawn_numbers_match_sql(duck):
    ids = np.array([0, 1, 1499, 540_000, 2**31 - 1, -3, -70_000], np.int64)
    for some in (ids[:5], ids):
        for r in (1, 20_000):
            want = [duck.execute(f"SELECT {resampling.draw(str(i), str(r), 3)}").fetchone()[0] for i in some]
            assert resampling.drawn_numbers(some, r, 3).tolist() == want


def test_partial_r2_of_held_and_sorted_groups(spark, monkeypatch):
    """Groups that tasks hold and groups that Spark sorts give the same; blocks of a group may be many."""
    rng = np.random.default_rng(4)
    rows = [(i * 3, None if i % 31 == 0 else int(i % 5 > 0), None if i % 23 == 0 else float(v), None if i % 29 == 0 else "abc"[int(c)]) for i, (v, c) in enumerate(zip(rng.normal(0, 1, 400), rng.integers(0, 3, 400)))]
    df = frame(spark, "i long, g int, y double, k string", rows)
    monkeypatch.setattr(resampling, "BLOCK", 64)
    found = []
    for held in (1 << 21, 100, 0):
        monkeypatch.setattr(resampling, "HELD", held)
        found.append(tuple(resampling.partial_r2(df, "i", "y", "g", "k", 60, 1).first()))
    assert found[1] == pytest.approx(found[0], rel=1e-12) and found[2] == pytest.approx(found[0], rel=1e-12)


def test_quantiles_deal_out_groups_and_ties(spark):
    """Values of a group meet its edges in many parts, equal ones as one row; quantiles are those of NumPy."""
    rng = np.random.default_rng(8)
    x = {"a": np.concatenate([rng.integers(0, 5, 900), rng.normal(2, 9, 300), [np.float64(2)] * 800]), "b": np.array([7.0] * 50), "c": np.array([1.5, -2.0])}
    df = frame(spark, "g string, x double", [(g, float(v)) for g, own in x.items() for v in own] + [("a", None), ("d", None)])
    p = [0.0, 0.01, 0.3, 0.5, 0.77, 0.999, 1.0]
    got = stats.quantiles(df, "x", p, "g")
    assert {r["g"]: list(r)[1:] for r in got.collect()} == {g: pytest.approx(np.quantile(own, p).tolist()) for g, own in x.items()}
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "__m" in plan and all("__copy" in line or "__range" in line for line in plan.splitlines() if "Join" in line)


def test_neighbours_are_sent_in_small_pieces(spark, monkeypatch):
    """A block that goes to many rings is sent piece by piece; distances are those of all pairs."""
    from gridloom.operators import neighbours

    monkeypatch.setattr(neighbours, "ROWS", 8)
    monkeypatch.setattr(neighbours, "SENT", 2)
    x = np.random.default_rng(9).normal(0, 1, (90, 6))
    df = frame(spark, "entity long, group int, profile array<double>", [(i, 1, [float(v) for v in r]) for i, r in enumerate(x)])
    got = {r["entity"]: r["near"] for r in neighbours.nearest_distances(df.withColumn("is_source", F.lit(True)), df, 4).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).mean(2))
    np.fill_diagonal(d, np.inf)
    assert len(got) == 90 and all(got[i] == pytest.approx(np.sort(d[i])[:4].tolist()) for i in range(90))
