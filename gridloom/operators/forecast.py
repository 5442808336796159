"""Forecasts as pluggable predictors, with a linear autoregressive one, and the transfer strategies.

A strategy says which rows the scaler and the weights are fitted on and whether weights start from
another strategy's. Fits are normal equations: sums of products over all training rows, aggregated
in Spark, so that no training row comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Strategy:
    """fit: which training rows count (a SQL predicate); start: the strategy that weights are drawn to; pull: how strongly."""

    name: str
    fit: str
    start: str | None = None
    pull: float = 0.0


#: Fit on the source, apply as it is, adapt it on a short target span, fit on the short or the whole target span.
STRATEGIES = (
    Strategy("source", "domain = 'source'"),
    Strategy("direct", "false", "source", 1.0),
    Strategy("tuned", "domain = 'target' and recent", "source", 50.0),
    Strategy("limited", "domain = 'target' and recent"),
    Strategy("full", "domain = 'target'"),
)


def _moments(samples: DataFrame, n: int, fit: str) -> tuple[np.ndarray, np.ndarray]:
    x = [F.lit(1.0), *(F.element_at("input", i + 1) for i in range(n))]
    sums = [F.sum(x[i] * x[j]).alias(f"m{i}_{j}") for i in range(n + 1) for j in range(i, n + 1)] + [F.sum(x[i] * F.col("target")).alias(f"v{i}") for i in range(n + 1)]
    row = samples.filter(fit).agg(*sums).first()
    m = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n + 1)] for i in range(n + 1)])
    return m, np.array([row[f"v{i}"] or 0.0 for i in range(n + 1)])


def fitted(samples: DataFrame, lookback: int, strategies=STRATEGIES, ridge: float = 1e-6) -> dict[str, np.ndarray]:
    """Weights (intercept first) of each strategy; samples have domain, recent, input, target."""
    out: dict[str, np.ndarray] = {}
    for s in strategies:
        m, v = _moments(samples, lookback, s.fit)
        start = out[s.start] if s.start else np.zeros(lookback + 1)
        pull = np.eye(lookback + 1) * (s.pull + ridge)
        out[s.name] = np.linalg.solve(m + pull, v + pull @ start)
    return out


def predicted(samples: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """Each sample's forecast by each strategy, as an expression that stays in the JVM."""
    def one(w: np.ndarray) -> Column:
        return sum((F.element_at("input", i + 1) * float(c) for i, c in enumerate(w[1:])), F.lit(float(w[0])))

    each = F.array(*(F.struct(F.lit(n).alias("strategy"), one(w).alias("predicted")) for n, w in weights.items()))
    return samples.select("*", F.explode(each).alias("p")).select(*[c for c in samples.columns if c != "input"], "p.*")
