"""The non-decreasing fit against pool adjacent violators in plain Python, over one and over many ranges."""

import random

import pytest

from ratewise.operators import calibration, ranking


def plain(rows):
    """Knots: scores by mean label, joined with the pool before while its mean is not smaller."""
    by = {}
    for s, y in rows:
        if s is not None and y is not None:
            t, n = by.get(s, (0, 0))
            by[s] = (t + y, n + 1)
    pools = []
    for s in sorted(by):
        pools.append([s, s, *by[s]])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            _, high, t, n = pools.pop()
            pools[-1] = [pools[-1][0], high, pools[-1][2] + t, pools[-1][3] + n]
    return [(lo, hi, t, n) for lo, hi, t, n in pools]


@pytest.mark.parametrize("sampled, kept, fan", [(1 << 15, 16, 32), (2, 2, 32), (1, 1, 4)])
@pytest.mark.parametrize("shape", ["rising", "falling", "noise", "steps"])
def test_pools_equal_the_plain_fit(spark, monkeypatch, sampled, kept, fan, shape):
    monkeypatch.setattr(ranking, "SAMPLED", sampled)
    monkeypatch.setattr(ranking, "KEPT", kept)
    monkeypatch.setattr(ranking, "STEPS", 9)
    monkeypatch.setattr(calibration, "FAN", fan)
    rng = random.Random(shape)
    chance = {"rising": lambda s: s, "falling": lambda s: 1 - s, "noise": lambda s: 0.3, "steps": lambda s: round(3 * s) / 3}[shape]
    rows = [(s, int(rng.random() < chance(s))) for s in (round(rng.random(), 3) for _ in range(400))] + [(None, 1), (0.5, None)]
    df = spark.createDataFrame(rows, "score double, click int").repartition(3)
    got = sorted(map(tuple, calibration.pools(df).collect()))
    assert got == [(a, b, float(t), float(n)) for a, b, t, n in plain(rows)]


def test_knots_are_applied_and_clamped(spark):
    df = spark.createDataFrame([(0.2, 0), (0.2, 1), (0.4, 1), (0.6, 1), (0.8, 1)], "score double, click int")
    model = calibration.fit_isotonic(df)
    assert model == calibration.Isotonic([0.2, 0.4, 0.8], [0.5, 1.0, 1.0])
    out = calibration.apply_isotonic(model, spark.createDataFrame([(0.0,), (0.3,), (0.9,), (None,)], "score double"))
    assert [r.isotonic for r in out.collect()] == [0.5, 0.75, 1 - 1e-7, None]
    assert calibration.fit_isotonic(df.limit(0)) == calibration.Isotonic([0.0], [0.0])
