"""That what a step sends or holds does not grow beyond its input."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridloom.operators import profiles, warping
from gridloom.operators import resampling as B
from gridloom.sources import rowgroups


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_drawn_rows_are_not_broadcast(spark):
    """A bootstrap's drawn numbers are entities times replicates, which Spark does not see."""
    df = spark.range(40).select(F.col("id").alias("entity"), (F.col("id") % 3).cast("int").alias("grp"), (F.col("id") * 0.5).alias("y"))
    drawn = B.redrawn(df, "entity", 1000, 0, "grp")
    assert "BroadcastHashJoin" not in _plan(drawn) and "ShuffledHashJoin" in _plan(drawn)
    counts = drawn.groupBy("r", "grp").count().groupBy("grp").agg(F.count_distinct("count").alias("n"), F.max("count").alias("count")).collect()
    assert {(r["grp"], r["n"], r["count"]) for r in counts} == {(0, 1, 14), (1, 1, 13), (2, 1, 13)}


def test_composition_draws_are_not_broadcast(spark):
    """Of the joins of a composition bootstrap only that with the sizes of groups is a broadcast."""
    df = spark.range(60).select((F.col("id") / 2).cast("int").alias("entity"), *(F.lit(0.5).alias(c) for c in ("share", "gain", "mse_focal", "mse_comparator")), F.when(F.col("id") % 2 == 0, "low").otherwise("high").alias("bin"))
    df = df.withColumn("grp", F.col("entity") % 2)
    found = B.composition_bootstrap(df, "entity", "grp", 1000)
    assert "BroadcastHashJoin [entity" not in _plan(found) and {r["replicates"] for r in found.collect()} == {1000}


def test_tasks_of_row_groups_are_bounded(spark, tmp_path):
    """Ten times the row groups don't mean more tasks; parts, order and samples are those of the groups."""
    for f in range(2):
        pq.write_table(pa.table({"i": np.arange(f * 1500, f * 1500 + 1500)}), tmp_path / f"{f}.parquet", row_group_size=2)
    df = rowgroups.batches(spark, str(tmp_path), 5, 1, 50, ["i"])
    assert df.rdd.getNumPartitions() <= rowgroups.TASKS
    got = df.toPandas()
    assert sorted(got["i"]) == list(range(3000)) and sorted(got["part"].unique()) == list(range(1500))
    order = np.random.default_rng([5, 1]).permutation(1500)
    assert all((g["i"] // 2 == order[part]).all() for part, g in got.groupby("part"))


def test_blocks_of_pairs_are_shuffled_evenly(spark, monkeypatch):
    """No side of the pairs of blocks is broadcast, no block has more partners than others, and every two meet once."""
    monkeypatch.setattr(profiles, "BLOCK", 2)
    for n in (1, 7, 40, 41, 300):
        df = spark.range(n).select(F.col("id").alias("entity"), F.array(F.col("id") * 1.0).alias("profile"))
        pairs = profiles._block_pairs(df)
        assert "BroadcastHashJoin" not in _plan(pairs)
        met = [(tuple(r["a"]), tuple(r["b"]), r["same"]) for r in pairs.select(F.col("block_x.entity").alias("a"), F.col("block_y.entity").alias("b"), "same").collect()]
        found = [frozenset((a, b)) for a, b, _ in met]
        blocks = set().union(*found)
        k = len(blocks)
        assert len(set(found)) == len(found) == k * (k + 1) // 2 and all((a == b) == same for a, b, same in met)
        numbers = max(-(-n // 8), min(-(-n // 2), profiles.PARTNERS))  # some of them without rows
        assert max(sum(b == x for _, b, _ in met) for x in blocks) <= numbers // 2 + 1


def test_silhouette_by_products(spark, monkeypatch):
    """Several blocks in a batch, with equal and almost equal profiles far from zero, against all differences."""
    monkeypatch.setattr(profiles, "BLOCK", 3)
    rng = np.random.default_rng(2)
    x = 100 + rng.normal(0, 1, (60, 4))
    x[:10], x[10:20] = x[20:30], x[30:40] + 1e-7
    label = rng.integers(0, 3, 60)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert np.allclose(profiles.straight(x, x), d, rtol=1e-9, atol=0)
    want = []
    for i in range(60):
        m = [d[i, (label == c) & (np.arange(60) != i)].mean() for c in range(3)]
        outer = min(m[c] for c in range(3) if c != label[i])
        want.append((outer - m[label[i]]) / max(outer, m[label[i]]))
    rows = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x))], "entity long, label int, profile array<double>")
    got = profiles.silhouette_of_profiles(rows).first()
    assert got["n"] == 60 and abs(got["silhouette"] - np.mean(want)) < 1e-9


def test_warping_by_diagonals_in_tiles(monkeypatch):
    """Tiles of a few pairs, with ties, against plain matrices: distances, and the values that each slot of a shape gets along its path."""
    monkeypatch.setattr(warping, "TILE", 3)
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (1, 4), (5, 1), (3, 6), (6, 6)):
        shapes, rows = rng.integers(0, 3, (11, n)).astype(float), rng.integers(0, 3, (11, m)).astype(float)
        owner, total, count = np.arange(11) % 2, np.zeros((2, n)), np.zeros((2, n), np.int64)
        warping.aligned(rows, shapes, owner, total, count)
        sums, numbers = np.zeros((2, n)), np.zeros((2, n), np.int64)
        for p in range(11):
            w = np.full((n + 1, m + 1), np.inf)
            w[0, 0] = 0
            for i in range(n):
                for j in range(m):
                    w[i + 1, j + 1] = (shapes[p, i] - rows[p, j]) ** 2 + min(w[i, j], w[i, j + 1], w[i + 1, j])
            assert warping.squared(shapes[p : p + 1], rows[p : p + 1])[0] == warping.squared(shapes, rows)[p] == w[n, m]
            i, j = n, m
            while i and j:
                sums[owner[p], i - 1] += rows[p, j - 1]
                numbers[owner[p], i - 1] += 1
                corner, above, left = w[i - 1, j - 1], w[i - 1, j], w[i, j - 1]
                i, j = (i, j - 1) if left < min(corner, above) else (i - 1, j) if above < corner else (i - 1, j - 1)
        assert (total == sums).all() and (count == numbers).all()


def test_what_pairs_send_grows_with_profiles(spark, monkeypatch):
    """Ten times the profiles: a block goes to as many tasks as before, and each entity has as many rows of sums. Parts of a block's distances come to the same."""
    monkeypatch.setattr(profiles, "BLOCK", 2)
    monkeypatch.setattr(profiles, "SIDE", 5)
    sent = []
    for n in (160, 1600):
        df = spark.range(n).select(F.col("id").alias("entity"), F.array(F.col("id") * 1.0, F.col("id") % 7 * 1.0).alias("profile"))
        met = profiles._block_pairs(df).select((F.size("block_x") + F.size("block_y")).alias("n")).agg(F.sum("n")).first()[0]
        sent.append(met / n)
    assert sent[0] == pytest.approx(sent[1], rel=0.1)
    x = np.random.default_rng(3).normal(0, 1, (90, 3))
    label = np.random.default_rng(3).integers(-2, 3, 90)
    got = profiles.silhouette_of_profiles(spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x))], "entity long, label int, profile array<double>")).first()
    d, want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), []
    for i in range(90):
        m = {c: d[i, (label == c) & (np.arange(90) != i)].mean() for c in set(label)}
        outer = min(v for c, v in m.items() if c != label[i])
        want.append((outer - m[label[i]]) / max(outer, m[label[i]]))
    assert got["n"] == 90 and abs(got["silhouette"] - np.mean(want)) < 1e-9
    pairs = profiles.dtw_pairs(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entity long, profile array<double>")).collect()
    assert {(r["a"], r["b"]) for r in pairs} == {(a, b) for a in range(90) for b in range(a + 1, 90)} and len(pairs) == 90 * 89 // 2
    assert all(r["d"] == profiles.dtw_matrix(x[[r["a"]]], x[[r["b"]]])[0] for r in pairs[:200])


def test_short_arrays_advance_together(monkeypatch):
    """All pairs of two sets are filled without a copy of a row for each pair, of few slots thousands at once, and come to the same as pair by pair."""
    rng = np.random.default_rng(6)
    seen, filled = [], warping._filled
    monkeypatch.setattr(warping, "_filled", lambda a, b, *more: seen.append((a.shape, b.shape)) or filled(a, b, *more))
    for slots, rows, shapes, steps in ((7, 64, 64, 1), (7, 3, 5000, 6), (48, 64, 64, 4), (48, 0, 3, 0)):
        x, y = rng.normal(0, 1, (rows, slots)), rng.normal(0, 1, (shapes, slots))
        seen.clear()
        got = warping.all_squared(x, y)
        assert len(seen) == steps and all(a[2] == b[1] == 1 for a, b in seen)
        assert np.array_equal(got.ravel(), warping.squared(np.repeat(x, shapes, 0), np.tile(y, (rows, 1))))
