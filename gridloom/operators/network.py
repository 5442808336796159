"""A convolutional and recurrent forecaster, trained by many tasks at once.

Two convolutions over time, one LSTM, a dense layer and an output; forward and backward pass are
NumPy. In an epoch each task takes Adam steps over its share of the samples, batch by batch, from
the same weights; then weights and moments of all tasks are averaged, in proportion to their
samples. A task holds one batch, never its share, and can be run again by
itself when its executor is lost. (A barrier stage that sums gradients after each batch gives the
steps of one fit, but Spark looks for the other tasks' messages once a second, so that each batch
takes a second at least.)
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.scratch import scratch

#: Features of a step, filters of the convolutions, hidden units, dense units.
FEATURES, FILTERS, HIDDEN, DENSE = 8, (64, 32), 64, 32
KERNEL, DROPOUT = 3, 0.2
LAYERS = ("conv1", "conv2", "lstm", "fc1", "output")
#: Tasks of an epoch; a number of its own, so that results do not depend on the cluster.
WORKERS = 8

Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Settings:
    """The fixed values of the study: batch, rates, clipping, plateau, early stop, and the gate from 30 epochs to 45."""

    batch: int = 512
    rate: float = 1e-3
    tuning_rate: float = 3e-5
    clip: float = 1.0
    factor: float = 0.5
    plateau: int = 2
    least_rate: float = 1e-6
    patience: int = 5
    epochs: int = 30
    most_epochs: int = 45
    seed: int = 42
    workers: int = WORKERS


@dataclass(frozen=True)
class Strategy:
    """fit, check: which training and validation samples count (SQL predicates, no fit to apply start as it is); start: the strategy whose weights it begins with; layers: those that are trained."""

    name: str
    fit: str | None
    check: str = "true"
    start: str | None = None
    layers: Sequence[str] = LAYERS


#: Fit on the source, apply as it is, tune the dense head on a short target span, fit on the short or the whole target span.
STRATEGIES = (
    Strategy("source", "domain = 'source'", "domain = 'source'"),
    Strategy("direct", None, start="source"),
    Strategy("tuned", "domain = 'target' and recent", "domain = 'target'", "source", ("fc1", "output")),
    Strategy("limited", "domain = 'target' and recent", "domain = 'target'"),
    Strategy("full", "domain = 'target'", "domain = 'target'"),
)


@dataclass
class Fit:
    """Weights of the best epoch, and a row for each epoch: epoch, train_mse, validation_mse, rate."""

    weights: Weights
    history: list[dict] = field(default_factory=list)


def initial(seed: int, dtype=np.float32) -> Weights:
    """Uniform weights within 1 / sqrt(inputs of the layer), as many as 34,977."""
    rng = np.random.default_rng(seed)
    one, two = FILTERS
    shapes = {
        "conv1.w": (KERNEL * FEATURES, one), "conv1.b": (one,), "conv2.w": (KERNEL * one, two), "conv2.b": (two,),
        "lstm.wx": (two, 4 * HIDDEN), "lstm.wh": (HIDDEN, 4 * HIDDEN), "lstm.bx": (4 * HIDDEN,), "lstm.bh": (4 * HIDDEN,),
        "fc1.w": (HIDDEN, DENSE), "fc1.b": (DENSE,), "output.w": (DENSE, 1), "output.b": (1,),
    }
    bound = {"conv1": KERNEL * FEATURES, "conv2": KERNEL * one, "lstm": HIDDEN, "fc1": HIDDEN, "output": DENSE}
    return {n: rng.uniform(-1, 1, s).astype(dtype) / np.sqrt(bound[n.split(".")[0]]).astype(dtype) for n, s in shapes.items()}


def _spread(x: np.ndarray) -> np.ndarray:
    """Each step with its neighbours, zeros beyond both ends: (samples, steps, KERNEL channels)."""
    wide = np.pad(x, ((0, 0), (1, 1), (0, 0)))
    return np.concatenate([wide[:, i : i + x.shape[1]] for i in range(KERNEL)], 2)


def _gathered(d: np.ndarray, channels: int) -> np.ndarray:
    """The transpose of _spread."""
    n, t, _ = d.shape
    wide = np.zeros((n, t + 2, channels), d.dtype)
    for i in range(KERNEL):
        wide[:, i : i + t] += d[:, :, i * channels : (i + 1) * channels]
    return wide[:, 1:-1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def forward(w: Weights, x: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
    """Predictions for x (samples, steps, features) and what the backward pass needs; keep scales the last hidden state (dropout)."""
    s1 = _spread(x)
    a1 = np.maximum(s1 @ w["conv1.w"] + w["conv1.b"], 0)
    s2 = _spread(a1)
    a2 = np.maximum(s2 @ w["conv2.w"] + w["conv2.b"], 0)
    n, t, _ = a2.shape
    inner = a2 @ w["lstm.wx"] + (w["lstm.bx"] + w["lstm.bh"])
    h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    hs, cs, gates = [h], [c], []
    for i in range(t):
        z = inner[:, i] + h @ w["lstm.wh"]
        z[:, : 3 * HIDDEN] = _sigmoid(z[:, : 3 * HIDDEN])  # input, forget, output; then the candidate
        z[:, 3 * HIDDEN :] = np.tanh(z[:, 3 * HIDDEN :])
        c = z[:, HIDDEN : 2 * HIDDEN] * c + z[:, :HIDDEN] * z[:, 3 * HIDDEN :]
        h = z[:, 2 * HIDDEN : 3 * HIDDEN] * np.tanh(c)
        gates.append(z)
        hs.append(h)
        cs.append(c)
    last = h if keep is None else h * keep
    a3 = np.maximum(last @ w["fc1.w"] + w["fc1.b"], 0)
    y = (a3 @ w["output.w"] + w["output.b"])[:, 0]
    return y, {"s1": s1, "a1": a1, "s2": s2, "a2": a2, "hs": hs, "cs": cs, "gates": gates, "last": last, "keep": keep, "a3": a3}


def backward(w: Weights, kept: dict, dy: np.ndarray, layers: Sequence[str] = LAYERS) -> Weights:
    """Gradients of the trained layers from dy, the loss's derivative by each prediction; the pass ends behind the first of them."""
    g: Weights = {}
    dy = dy[:, None]
    g["output.w"], g["output.b"] = kept["a3"].T @ dy, dy.sum(0)
    d = (dy @ w["output.w"].T) * (kept["a3"] > 0)
    g["fc1.w"], g["fc1.b"] = kept["last"].T @ d, d.sum(0)
    if set(layers) & {"conv1", "conv2", "lstm"}:
        dh = d @ w["fc1.w"].T
        if kept["keep"] is not None:
            dh = dh * kept["keep"]
        dc, flow = np.zeros_like(dh), np.empty((*kept["a2"].shape[:2], 4 * HIDDEN), dh.dtype)
        g["lstm.wh"] = np.zeros_like(w["lstm.wh"])
        for i in range(len(kept["gates"]) - 1, -1, -1):
            z, c, before = kept["gates"][i], np.tanh(kept["cs"][i + 1]), kept["cs"][i]
            gi, gf, go, gc = (z[:, j * HIDDEN : (j + 1) * HIDDEN] for j in range(4))
            dc = dc + dh * go * (1 - c * c)
            step = np.concatenate([dc * gc * gi * (1 - gi), dc * before * gf * (1 - gf), dh * c * go * (1 - go), dc * gi * (1 - gc * gc)], 1)
            flow[:, i] = step
            g["lstm.wh"] += kept["hs"][i].T @ step
            dh, dc = step @ w["lstm.wh"].T, dc * gf
        g["lstm.wx"] = np.tensordot(kept["a2"], flow, ((0, 1), (0, 1)))
        g["lstm.bx"] = g["lstm.bh"] = flow.sum((0, 1))
        if set(layers) & {"conv1", "conv2"}:
            d2 = (flow @ w["lstm.wx"].T) * (kept["a2"] > 0)
            g["conv2.w"], g["conv2.b"] = np.tensordot(kept["s2"], d2, ((0, 1), (0, 1))), d2.sum((0, 1))
            d1 = _gathered(d2 @ w["conv2.w"].T, FILTERS[0]) * (kept["a1"] > 0)
            g["conv1.w"], g["conv1.b"] = np.tensordot(kept["s1"], d1, ((0, 1), (0, 1))), d1.sum((0, 1))
    return {n: v for n, v in g.items() if n.split(".")[0] in layers}


class Adam:
    """Moments of the trained weights; step() clips the gradient's norm first."""

    def __init__(self, weights: Weights, layers: Sequence[str], state: dict | None = None):
        names = [n for n in weights if n.split(".")[0] in layers]
        self.state = state or {"t": 0, "m": {n: np.zeros_like(weights[n], float) for n in names}, "v": {n: np.zeros_like(weights[n], float) for n in names}}

    def step(self, weights: Weights, gradient: Weights, rate: float, clip: float) -> None:
        s = self.state
        s["t"] += 1
        norm = np.sqrt(sum(float((g.astype(float) ** 2).sum()) for g in gradient.values()))
        scale = min(1.0, clip / (norm + 1e-6))
        for n, g in gradient.items():
            g = g.astype(float) * scale
            s["m"][n] = 0.9 * s["m"][n] + 0.1 * g
            s["v"][n] = 0.999 * s["v"][n] + 0.001 * g * g
            move = s["m"][n] / (1 - 0.9 ** s["t"]) / (np.sqrt(s["v"][n] / (1 - 0.999 ** s["t"])) + 1e-8)
            weights[n] = (weights[n] - rate * move).astype(weights[n].dtype)


# ---- samples ----------------------------------------------------------------------------------


def _batches(frames: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Inputs and targets in batches of the size, whatever the frames hold; the last one may be smaller."""
    x, y, n = [], [], 0
    for pdf in frames:
        if len(pdf):
            x.append(np.stack([np.asarray(v, np.float32) for v in pdf["x"]]).reshape(len(pdf), -1, FEATURES))
            y.append(pdf["y"].to_numpy(np.float32))
            n += len(pdf)
        while n >= size:
            whole_x, whole_y = np.concatenate(x), np.concatenate(y)
            yield whole_x[:size], whole_y[:size]
            x, y, n = [whole_x[size:]], [whole_y[size:]], n - size
    if n:
        yield np.concatenate(x), np.concatenate(y)


def samples(features: DataFrame, *keep: str) -> DataFrame:
    """(keep, key, x, y) of windows (entity, slot, target, input: structs of the eight features), x flat in order of time."""
    names = features.schema["input"].dataType.elementType.names
    flat = F.flatten(F.transform("input", lambda s: F.array(*(s[n].cast("float") for n in names))))
    return features.select(*keep, F.xxhash64("entity", "slot").alias("key"), flat.alias("x"), F.col("target").cast("float").alias("y"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in four tasks a core: windows have few bytes and much work, so that by bytes Spark leaves all of them to one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def held(rows: DataFrame) -> DataFrame:
    """Samples as an intermediate table, dealt out by their keys."""
    path = scratch(rows.sparkSession, "samples")
    dealt(rows, "key").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def epoch(rows: DataFrame, weights: Weights, adam: dict | None, layers: Sequence[str], rate: float, settings: Settings, number: int) -> tuple[Weights, dict, float]:
    """Weights and moments after one pass over rows (key, x, y), dealt out and ordered anew by their keys, and the mean squared error on the way."""

    def run(frames):
        from pyspark import TaskContext

        w = {n: v.copy() for n, v in weights.items()}
        opt = Adam(w, layers, adam)
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([settings.seed, number, part])
        seen, squares = 0, 0.0
        for x, y in _batches(frames, settings.batch):
            keep = ((rng.random((len(x), HIDDEN)) >= DROPOUT) / (1 - DROPOUT)).astype(np.float32)
            found, kept = forward(w, x, keep)
            off = found - y
            opt.step(w, backward(w, kept, 2 * off / len(x), layers), rate, settings.clip)
            seen, squares = seen + len(x), squares + float((off.astype(float) ** 2).sum())
        if seen:
            s = opt.state
            kinds = [("w", {n: w[n] for n in s["m"]}), ("m", s["m"]), ("v", s["v"]), ("loss", {"": np.array([squares / seen])})]
            yield pd.DataFrame([(part, kind, n, s["t"], seen, v.astype(float).ravel().tolist()) for kind, d in kinds for n, v in d.items()], columns=["part", "kind", "name", "t", "n", "numbers"])

    turns = rows.select("key", "x", "y").withColumn("__turn", F.xxhash64("key", F.lit(settings.seed), F.lit(number))).repartition(settings.workers, "__turn").sortWithinPartitions("__turn", "key")
    own = turns.select("x", "y").mapInPandas(run, "part int, kind string, name string, t long, n long, numbers array<double>")
    total: dict[tuple[str, str], np.ndarray] = {}
    rows_of: dict[tuple[str, str], int] = {}
    taken = 0
    for r in sorted(own.collect(), key=lambda r: r["part"]):  # weights of `workers` tasks, whatever the samples
        at = r["kind"], r["name"]
        total[at] = total.get(at, 0) + r["n"] * np.array(r["numbers"])
        rows_of[at] = rows_of.get(at, 0) + r["n"]
        taken = max(taken, r["t"])
    if not total:
        return weights, adam, float("nan")
    mean = {at: v / rows_of[at] for at, v in total.items()}
    after = {n: mean["w", n].reshape(v.shape).astype(v.dtype) if ("w", n) in mean else v for n, v in weights.items()}
    state = {"t": taken, **{k: {n: v.reshape(weights[n].shape) for (kind, n), v in mean.items() if kind == k} for k in "mv"}}
    return after, state, float(mean["loss", ""][0])


def predicted(rows: DataFrame, weights: dict[str, Weights], *keep: str, batch: int = 512) -> DataFrame:
    """(keep, y, strategy, predicted) for rows (keep, x, y) and each set of weights."""

    def run(frames):
        for pdf in frames:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start : start + batch]
                x = np.stack([np.asarray(v, np.float32) for v in part["x"]]).reshape(len(part), -1, FEATURES)
                for name, w in weights.items():
                    yield part[[*keep, "y"]].assign(strategy=name, predicted=forward(w, x)[0].astype(float))

    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.select(*keep, "x", "y").mapInPandas(run, f"{kinds}y float, strategy string, predicted double")


def error(rows: DataFrame, weights: Weights) -> float:
    """Mean squared error over rows (x, y); squares are added as decimals, so their order does not matter."""
    off = F.col("predicted") - F.col("y")
    r = predicted(rows, {"": weights}).agg(F.sum((off * off).cast("decimal(38,12)")).cast("double").alias("s"), F.count(F.lit(1)).alias("n")).first()
    return r["s"] / r["n"] if r["n"] else float("nan")


def goes_on(validation: Sequence[float]) -> bool:
    """Whether a fit at its last epoch may go on: the best epoch is one of the last two, and the last three are better by a thousandth than the three before."""
    if len(validation) < 6:
        return False
    before, last = np.mean(validation[-6:-3]), np.mean(validation[-3:])
    return int(np.argmin(validation)) >= len(validation) - 2 and before > 0 and (before - last) / before >= 0.001


def fitted(train: DataFrame, validation: DataFrame, weights: Weights, layers: Sequence[str], rate: float, settings: Settings) -> Fit:
    """Epochs until the validation error has not fallen for `patience` of them; the rate is cut after `plateau` without a fall of a ten-thousandth. Without validation rows the last weights stay."""
    fit, adam, best, stale, level, flat, number, last = Fit(weights), None, np.inf, 0, np.inf, 0, 0, settings.epochs
    while number < last:
        number += 1
        weights, adam, mse = epoch(train, weights, adam, layers, rate, settings, number)
        value = error(validation, weights)
        fit.history.append({"epoch": number, "train_mse": mse, "validation_mse": value, "rate": rate})
        if value < best or np.isnan(value):
            best, stale, fit.weights = value, 0, weights
        else:
            stale += 1
        if value < level * (1 - 1e-4):
            level, flat = value, 0
        else:
            flat += 1
        if flat > settings.plateau:
            rate, flat = max(settings.least_rate, rate * settings.factor), 0
        if stale >= settings.patience:
            break
        if number == settings.epochs < settings.most_epochs and goes_on([h["validation_mse"] for h in fit.history]):
            last = settings.most_epochs
    return fit


def transfer(train: DataFrame, validation: DataFrame, strategies: Sequence[Strategy] = STRATEGIES, settings: Settings = Settings()) -> dict[str, Fit]:
    """The fit of each strategy; train and validation are samples() with the columns of the strategies' predicates. Fits that start from another one's weights come after it and use the tuning rate; those that wait for none run side by side. Without training samples a strategy keeps its start."""
    rows, checks = held(train), held(validation)
    fits: dict[str, Fit] = {}

    def one(s: Strategy) -> Fit:
        start = {n: v.copy() for n, v in fits[s.start].weights.items()} if s.start else initial(settings.seed)
        if not s.fit or rows.filter(s.fit).isEmpty():
            return Fit(start)
        return fitted(rows.filter(s.fit), checks.filter(s.check), start, s.layers, settings.tuning_rate if s.start else settings.rate, settings)

    waiting = list(strategies)
    while waiting:
        ready = [s for s in waiting if not s.start or s.start in fits]
        if not ready:
            raise ValueError(f"no strategy to start from: {', '.join(s.start for s in waiting)}")
        with ThreadPoolExecutor(len(ready)) as pool:
            runs = {s.name: pool.submit(inheritable_thread_target(one), s) for s in ready}
        fits |= {n: run.result() for n, run in runs.items()}
        waiting = [s for s in waiting if s.name not in fits]
    return {s.name: fits[s.name] for s in strategies}
