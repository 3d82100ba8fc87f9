"""Averaged descent against the optimum of the same objective."""

import math
import random

import numpy as np
import pytest

from ratewise.operators import averaged


@pytest.mark.parametrize("parts", [1, 4])
def test_loss_within_one_percent_of_the_optimum(spark, parts):
    rng = random.Random(11)
    rows = []
    for i in range(20_000):
        a, b, c = rng.gauss(50, 10), rng.choice([0.0, 1.0, None]), rng.expovariate(3)
        z = 0.08 * (a - 50) - 1.1 * (b or 0) + 1.7 * c - 0.9
        rows.append((i, a, b, c, 4.0, int(rng.random() < 1 / (1 + math.exp(-z)))))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, same double, click int").repartition(parts)
    model = averaged.fit(df, ["a", "b", "c", "same"])
    x = np.array([[r[1], r[2] or 0, r[3]] for r in rows])
    x = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(x))])
    y, w = np.array([r[5] for r in rows]), np.zeros(4)
    for _ in range(30):  # Newton
        p = 1 / (1 + np.exp(-x @ w))
        ridge = np.diag([1e-4] * 3 + [0])
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge, x.T @ (p - y) / len(x) + ridge @ w)
    p = 1 / (1 + np.exp(-x @ w))
    best = -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))
    assert best <= averaged.loss(model, df) * (1 + 1e-4) and averaged.loss(model, df) < 1.01 * best
    scored = averaged.score(model, df).select("id", "score").toPandas().set_index("id")["score"]
    assert np.abs(scored.loc[range(len(rows))].to_numpy() - p).mean() < 0.02 and model.deviations[3] == 1.0


def test_no_rows_and_no_labels(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, click int")
    assert averaged.fit(df, ["a"]).weights == [0.0] and averaged.fit(df.limit(0), ["a"]).intercept == 0.0
