"""The convolutional and recurrent forecaster: gradients, steps over tasks, transfer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import network as N


def rows(spark, n, steps=6, seed=0, **more):
    """The target is the mean of the last two loads."""
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, steps, N.FEATURES)).astype(np.float32)
    y = x[:, -2:, 0].mean(1)
    names = "".join(f", {c} {t}" for c, (t, _) in more.items())
    return spark.createDataFrame([(i, v.ravel().tolist(), float(t), *(f(i) for _, f in more.values())) for i, (v, t) in enumerate(zip(x, y))], f"key long, x array<float>, y float{names}"), x, y


def test_number_of_weights():
    assert sum(v.size for v in N.initial(0).values()) == 34977


@pytest.mark.parametrize("dropout", [False, True])
def test_gradients_are_those_of_finite_differences(dropout):
    rng = np.random.default_rng(1)
    w = N.initial(3, float)
    x, y = rng.normal(0, 1, (5, 7, N.FEATURES)), rng.normal(0, 1, 5)
    keep = (rng.random((5, N.HIDDEN)) > 0.2) / 0.8 if dropout else None
    loss = lambda: float(((N.forward(w, x, keep)[0] - y) ** 2).sum())
    predicted, kept = N.forward(w, x, keep)
    g = N.backward(w, kept, 2 * (predicted - y))
    assert set(g) == set(w)
    for name, v in w.items():
        for at in rng.choice(v.size, min(v.size, 12), replace=False):
            place = np.unravel_index(at, v.shape)
            old, step = v[place], 1e-6
            v[place] = old + step
            up = loss()
            v[place] = old - step
            down = loss()
            v[place] = old
            assert g[name][place] == pytest.approx((up - down) / (2 * step), rel=2e-4, abs=1e-6), (name, place)


def test_frozen_layers_have_no_gradient():
    w = N.initial(0)
    _, kept = N.forward(w, np.ones((2, 4, N.FEATURES), np.float32))
    assert {n.split(".")[0] for n in N.backward(w, kept, np.ones(2, np.float32), ("fc1", "output"))} == {"fc1", "output"}
    assert {n.split(".")[0] for n in N.backward(w, kept, np.ones(2, np.float32), ("lstm",))} == {"lstm"}


def test_an_epoch_is_the_mean_of_its_tasks(spark, monkeypatch):
    """Without dropout: each task's steps over its share, in the order of its keys, then the mean by samples."""
    monkeypatch.setattr(N, "DROPOUT", 0.0)
    df, x, y = rows(spark, 60)
    start, s = N.initial(0), N.Settings(batch=8, workers=3)
    turn = F.xxhash64("key", F.lit(s.seed), F.lit(1))
    shares = df.select("key", turn.alias("turn"), F.pmod(F.hash(turn), F.lit(3)).alias("part")).toPandas()
    ends = []
    for _, share in shares.groupby("part"):
        at = share.sort_values("turn")["key"].to_numpy()
        w, loss = {n: v.copy() for n, v in start.items()}, 0.0
        opt = N.Adam(w, N.LAYERS)
        for i in range(0, len(at), 8):
            b = at[i : i + 8]
            found, kept = N.forward(w, x[b])
            loss += float(((found - y[b]) ** 2).sum())
            opt.step(w, N.backward(w, kept, 2 * (found - y[b]) / len(b)), 1e-3, 1.0)
        ends.append((len(at), w, opt.state, loss))
    assert len(ends) == 3
    got, state, mse = N.epoch(df.repartition(5), start, None, N.LAYERS, 1e-3, s, 1)
    assert state["t"] == max(e[2]["t"] for e in ends) and mse == pytest.approx(sum(e[3] for e in ends) / 60, rel=1e-5)
    for n in got:
        assert np.allclose(got[n], sum(k * w[n] for k, w, _, _ in ends) / 60, atol=2e-5)
        assert np.allclose(state["m"][n], sum(k * o["m"][n] for k, _, o, _ in ends) / 60, atol=1e-5)
    again, _, _ = N.epoch(df, start, None, N.LAYERS, 1e-3, s, 1)
    assert all(np.array_equal(got[n], again[n]) for n in got)
    other, _, _ = N.epoch(df, start, None, N.LAYERS, 1e-3, s, 2)
    assert any(not np.array_equal(got[n], other[n]) for n in got)


def test_loss_falls_and_head_alone_moves(spark):
    df, _, _ = rows(spark, 400, domain=("string", lambda i: "source" if i % 2 else "target"), recent=("boolean", lambda i: i % 3 == 0))
    check, x, y = rows(spark, 120, seed=5, domain=("string", lambda i: "source" if i % 2 else "target"), recent=("boolean", lambda i: True))
    fits = N.transfer(df, check, settings=N.Settings(batch=16, epochs=4, most_epochs=4, workers=2, rate=5e-3, tuning_rate=1e-3))
    assert list(fits) == ["source", "direct", "tuned", "limited", "full"]
    history = fits["source"].history
    assert len(history) == 4 and history[-1]["train_mse"] < 0.7 * history[0]["train_mse"] and history[-1]["validation_mse"] < history[0]["validation_mse"]
    source, tuned = fits["source"].weights, fits["tuned"].weights
    assert all(np.array_equal(fits["direct"].weights[n], source[n]) for n in source)
    assert {n.split(".")[0] for n in source if not np.array_equal(source[n], tuned[n])} == {"fc1", "output"}
    got = N.predicted(check, {n: f.weights for n, f in fits.items()}, "key").toPandas()
    assert len(got) == 5 * 120
    one = got[got["strategy"] == "full"].sort_values("key")["predicted"].to_numpy()
    assert np.allclose(one, N.forward(fits["full"].weights, x)[0], atol=1e-5)
    assert N.error(check, fits["full"].weights) == pytest.approx(float(((one - y) ** 2).mean()), rel=1e-4)


def test_stops_and_cuts(spark, monkeypatch):
    values = iter([5.0, 4.0, 4.1, 4.2, 4.3, 4.4, 4.5])
    monkeypatch.setattr(N, "epoch", lambda rows, w, *a: ({"w": w["w"] + 1}, None, 1.0))
    monkeypatch.setattr(N, "error", lambda rows, w: next(values))
    fit = N.fitted(None, None, {"w": 0}, (), 1.0, N.Settings())
    assert [h["rate"] for h in fit.history] == [1, 1, 1, 1, 1, 0.5, 0.5] and fit.weights == {"w": 2}
    assert N.goes_on([9, 8, 7, 6, 5, 4]) and not N.goes_on([9, 8, 7, 6, 5, 5.5, 5.6]) and not N.goes_on([1, 1, 1, 1, 1, 0.9999]) and not N.goes_on([2, 1])


def test_batches_have_their_size(spark):
    df, x, y = rows(spark, 23)
    pdf = df.toPandas()
    got = list(N._batches(iter([pdf[:3], pdf[3:3], pdf[3:18], pdf[18:]]), 5))
    assert [len(v) for _, v in got] == [5, 5, 5, 5, 3] and np.array_equal(np.concatenate([a for a, _ in got]), x) and np.allclose(np.concatenate([b for _, b in got]), y)


def test_no_training_samples(spark):
    df, _, _ = rows(spark, 4, domain=("string", lambda i: "source"), recent=("boolean", lambda i: True))
    fits = N.transfer(df.limit(0), df.limit(0), settings=N.Settings(epochs=1))
    assert all(not f.history for f in fits.values())
    assert N.predicted(df.limit(0), {"a": N.initial(0)}, "key").count() == 0


def test_samples_are_flat(spark):
    names = ["load", "a", "b", "c", "d", "e", "f", "g"]
    df = spark.range(2).select(F.col("id").alias("entity"), F.lit(3).alias("slot"), F.lit(1.5).alias("target"), F.array(*(F.struct(*(F.lit(float(8 * t + i)).alias(n) for i, n in enumerate(names))) for t in range(2))).alias("input"))
    assert [r["x"] for r in N.samples(df, "entity").collect()] == [[float(i) for i in range(16)]] * 2


def test_windows_are_dealt_out_and_fits_side_by_side_are_those_alone(spark, monkeypatch):
    """A table of few bytes is not left to one task; a fit does not depend on those beside it, nor on where its samples were."""
    df, _, _ = rows(spark, 200, domain=("string", lambda i: "source" if i % 2 else "target"), recent=("boolean", lambda i: i % 3 == 0))
    settings, files, fitted = N.Settings(batch=16, epochs=1, most_epochs=1, workers=2), [], N.fitted
    monkeypatch.setattr(N, "fitted", lambda train, validation, *a: files.append((len(train.inputFiles()), len(validation.inputFiles()))) or fitted(train, validation, *a))
    together = N.transfer(df.coalesce(1), df.coalesce(1), settings=settings)
    assert list(together) == [s.name for s in N.STRATEGIES] and len(files) == 4 and min(map(min, files)) > 1
    for s in (N.STRATEGIES[0], N.STRATEGIES[4]):
        alone = N.transfer(df.repartition(3), df, [s], settings)[s.name]
        assert all(np.array_equal(v, together[s.name].weights[n]) for n, v in alone.weights.items())
    with pytest.raises(ValueError, match="source"):
        N.transfer(df, df, [N.STRATEGIES[2]], settings)


def test_query_trains_with_the_settings_of_the_study(spark, monkeypatch):
    """No batch, epochs or rates of its own."""
    from __spark_entry__ import queries
    from tests.conftest import SF

    seen = []

    def fitted(train, validation, weights, layers, rate, settings):
        seen.append((rate, settings))
        return N.Fit(weights)

    monkeypatch.setattr(N, "fitted", fitted)
    queries()["network_forecast"](spark, SF)
    assert N.Settings() == N.Settings(batch=512, rate=1e-3, tuning_rate=3e-5, clip=1.0, factor=0.5, plateau=2, least_rate=1e-6, patience=5, epochs=30, most_epochs=45, seed=42)
    assert [s for _, s in seen] == [N.Settings()] * 4 and sorted(r for r, _ in seen) == [3e-5, 1e-3, 1e-3, 1e-3]
