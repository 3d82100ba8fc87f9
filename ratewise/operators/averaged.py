"""Logistic regression by averaged stochastic gradient descent in passes over the data."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewise.functions.features import finite_or_zero

#: Rows of one step; first step, which falls with the power of the steps taken; steps by which each later pass is ahead; weight of late steps in the average.
STEP_ROWS, FIRST_STEP, POWER, LATER, LEAN = 16, 1.0, 0.6, 20, 3


@dataclass(frozen=True)
class Line:
    """Weights on raw feature values, the log-odds at 0, and the means and deviations of the fitted rows."""

    features: list[str]
    weights: list[float]
    intercept: float
    means: list[float]
    deviations: list[float]

    def log_odds(self) -> Column:
        return sum((w * finite_or_zero(F.col(c).cast("double")) for c, w in zip(self.features, self.weights, strict=True)), F.lit(self.intercept))


def scaler(df: DataFrame, features: list[str]) -> tuple[list[float], list[float]]:
    """Means and population deviations of the features (null, NaN and infinite values are 0); 1 for a constant feature. One pass."""
    x = [finite_or_zero(F.col(c).cast("double")) for c in features]
    row = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)], *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(x)]).first()
    n = len(features)
    return [row[i] or 0.0 for i in range(n)], [row[n + i] or 1.0 for i in range(n)]


def _descend(x: np.ndarray, y: np.ndarray, at: tuple[np.ndarray, np.ndarray, int], alpha: float, ahead: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(weights, their average, steps) after the steps over x; the last weight is the intercept and is not shrunk. In the average of t steps the last ones count most, as the power LEAN of their number."""
    w, mean, taken = at
    shrink = np.append(np.full(x.shape[1] - 1, alpha), 0.0)
    for start in range(0, len(x), STEP_ROWS):
        part, want = x[start : start + STEP_ROWS], y[start : start + STEP_ROWS]
        miss = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30))) - want
        w = w - FIRST_STEP / (1 + ahead + taken) ** POWER * (part.T @ miss / len(part) + shrink * w)
        taken += 1
        mean = mean + (w - mean) * (LEAN + 1) / (LEAN + taken)
    return w, mean, taken


def fit(df: DataFrame, features: list[str], label: str = "click", alpha: float = 1e-4, passes: int = 2) -> Line:
    """L2 logistic regression on standardised features. In a pass every task descends over its own rows from the common weights; the averages of what its steps went through meet, weighted by rows, and start the next pass, whose steps are shorter.

    What a task hands on is one row of weights. Rows without a label are left out; without any, all weights are 0.
    """
    rows = df.dropna(subset=[label])
    means, deviations = scaler(rows, features)
    n, m, s = len(features), np.array(means), np.array(deviations)
    ready = rows.select(F.array(*[finite_or_zero(F.col(c).cast("double")) for c in features]).alias("x"), F.col(label).cast("double").alias("y"))
    weights = np.zeros(n + 1)
    for turn in range(passes):

        def task(batches, start=weights, ahead=LATER * turn):
            at, rows = (start, start, 0), 0
            for b in batches:
                x = (np.asarray(b.column(0).flatten(), float).reshape(-1, n) - m) / s
                at = _descend(np.column_stack([x, np.ones(len(x))]), np.asarray(b.column(1)), at, alpha, ahead)
                rows += len(x)
            if rows:
                yield pa.RecordBatch.from_pydict({"w": [at[1].tolist()], "rows": [rows]})

        parts = ready.mapInArrow(task, "w array<double>, rows long")
        met = parts.agg(F.sum("rows").alias("rows"), *[F.sum(F.get("w", F.lit(i)) * F.col("rows")).alias(f"w{i}") for i in range(n + 1)]).first()
        if not met["rows"]:
            break
        weights = np.array([met[f"w{i}"] for i in range(n + 1)]) / met["rows"]
    raw = weights[:-1] / s
    return Line(features, raw.tolist(), float(weights[-1] - (raw * m).sum()), means, deviations)


def score(model: Line, df: DataFrame, out: str = "score") -> DataFrame:
    """df and the probability of class 1, an expression of the columns."""
    return df.withColumn(out, 1 / (1 + F.exp(-model.log_odds())))


def loss(model: Line, df: DataFrame, label: str = "click") -> float:
    """Mean log loss on labelled rows."""
    z = model.log_odds()
    return df.dropna(subset=[label]).agg(F.avg(F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - z * F.col(label))).first()[0] or math.nan
