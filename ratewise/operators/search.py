"""Search of boosted trees' settings: each trial is drawn where earlier good trials lie dense and bad ones thin, and ends early where its losses lag."""

from __future__ import annotations

import json
import math
import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.operators import boosting, evaluation


@dataclass(frozen=True)
class Range:
    """A setting's range; whole numbers, and evenness on a log scale, where asked."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def bounds(self) -> tuple[float, float]:
        """Ends of the scale on which draws are even; a whole number has half a step on each side."""
        low, high = (self.low - 0.5, self.high + 0.5) if self.whole else (self.low, self.high)
        return (math.log(low), math.log(high)) if self.log else (low, high)

    def at(self, value: float) -> float:
        return math.log(value) if self.log else value

    def value(self, x: float) -> float | int:
        v = math.exp(x) if self.log else x
        v = min(max(v, self.low), self.high)
        return min(max(round(v), int(self.low)), int(self.high)) if self.whole else v


#: The nine ranges of the search. The number of leaves has the smaller of 128 and 2**depth as its upper end.
SPACE = {
    "depth": Range(5, 12, whole=True), "rate": Range(0.02, 0.15, log=True), "leaves": Range(20, 128, whole=True), "least_rows": Range(20, 300, log=True, whole=True), "row_share": Range(0.7, 1.0), "column_share": Range(0.7, 1.0),
    "l1": Range(1e-8, 10.0, log=True), "l2": Range(1e-8, 10.0, log=True), "least_gain": Range(0.0, 0.2)}


def leaves_within_depth(name: str, drawn: dict, given: Range) -> Range:
    return Range(given.low, min(given.high, 2 ** drawn["depth"]), whole=True) if name == "leaves" else given


class Density:
    """A mixture of normal densities on a range: one around each value, as wide as the farther of its neighbours, and one over the whole range."""

    def __init__(self, values: list[float], low: float, high: float):
        x = np.sort(np.clip(np.array(values, float), low, high))
        around = np.concatenate([[low], x, [high]])
        wide = np.maximum(np.diff(around)[:-1], np.diff(around)[1:]) if len(x) else np.empty(0)
        self.low, self.high = low, high
        self.mean = np.append(x, (low + high) / 2)
        self.wide = np.append(np.clip(wide, (high - low) / min(100, 1 + len(x)), high - low), high - low)
        cut = lambda z: 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))
        self.inside = cut((high - self.mean) / self.wide) - cut((low - self.mean) / self.wide)

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        out = []
        while len(out) < n:
            k = int(rng.integers(len(self.mean)))
            x = rng.normal(self.mean[k], self.wide[k])
            if self.low <= x <= self.high:
                out.append(x)
        return np.array(out)

    def log(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - self.mean) / self.wide
        return np.log(np.mean(np.exp(-z * z / 2) / (math.sqrt(2 * math.pi) * self.wide * self.inside), axis=1) + 1e-300)


class Sampler:
    """Draws settings: evenly for the first trials, then of CANDIDATES draws from the density of the best trials the one that is likeliest among them and least likely among the others; each setting on its own. Seeded."""

    CANDIDATES, BEST_SHARE, MOST_BEST = 24, 0.2, 25

    def __init__(self, space: dict[str, Range] | None = None, seed: int = 42, first: int = 10, narrowed=leaves_within_depth):
        self.space, self.rng, self.first, self.narrowed = space or SPACE, np.random.default_rng(seed), first, narrowed
        self.told: list[tuple[float, dict]] = []

    def ask(self) -> dict:
        ranked = sorted(range(len(self.told)), key=lambda i: (self.told[i][0], i))
        n = min(math.ceil(self.BEST_SHARE * len(ranked)), self.MOST_BEST)
        drawn: dict = {}
        for name, given in self.space.items():
            r = self.narrowed(name, drawn, given)
            low, high = r.bounds()
            if len(ranked) < self.first:
                x = float(self.rng.uniform(low, high))
            else:
                good, bad = (Density([r.at(self.told[i][1][name]) for i in part], low, high) for part in (ranked[:n], ranked[n:]))
                some = good.draw(self.rng, self.CANDIDATES)
                x = float(some[int(np.argmax(good.log(some) - bad.log(some)))])
            drawn[name] = r.value(x)
        return drawn

    def tell(self, params: dict, loss: float) -> None:
        self.told.append((loss, params))


class Lagging:
    """Whether a trial's best loss up to a round is worse than the median of what earlier trials had by then; never before some trials and rounds."""

    def __init__(self, trials: int = 5, rounds: int = 10):
        self.trials, self.rounds, self.curves = trials, rounds, []

    def __call__(self, curve: list[float]) -> bool:
        at = len(curve)
        earlier = [min(c[:at]) for c in self.curves if len(c) >= at]
        return at > self.rounds and len(earlier) >= self.trials and min(curve) > float(np.median(earlier))


def search(df: DataFrame, features: list[str], valid_flag: str, trials: int = 20, label: str = "click", id_col: str | None = None, base: boosting.Settings = boosting.LEAF_WISE, sampler: Sampler | None = None) -> tuple[DataFrame, boosting.Boosted]:
    """(a row for each trial, the model of the least validation loss).

    Trials: trial, log_loss, auc, calibration_gap, best_round, pruned, seconds, params (JSON of the nine settings), rank.
    A pruned trial counts with its best loss so far and is never the best model unless it has the least loss of all.
    """
    spark, sampler, lag = df.sparkSession, sampler or Sampler(seed=base.seed), Lagging()
    ready = df.select(*dict.fromkeys([*features, label, valid_flag, *([id_col] if id_col else [])])).persist()
    rows, best, binned = [], None, None
    try:
        for trial in range(trials):
            params, started, curve, pruned = sampler.ask(), time.monotonic(), [], []

            def watch(_, loss, curve=curve, pruned=pruned):
                curve.append(loss)
                if lag(curve):
                    pruned.append(True)
                return bool(pruned)

            settings = boosting.replace(base, **params)
            if binned is None or binned.bins != settings.bins:  # once, unless the number of bins is drawn
                if binned is not None:
                    binned.release()
                binned = boosting.prepare(ready, features, label, valid_flag, settings.bins, id_col)
            model = boosting.fit_prepared(binned, settings, watch)
            lag.curves.append(curve)
            judged = boosting.score(model, ready.filter(F.col(valid_flag)).select(*features, label))
            m = evaluation.score_summary(judged, "score", label).first()
            gap = abs(m["mean_score"] - m["ctr"])
            sampler.tell(params, m["log_loss"])
            rows.append((trial, m["log_loss"], m["auc"], gap, len(model.trees), bool(pruned), time.monotonic() - started, json.dumps(params)))
            if best is None or m["log_loss"] < best[0]:
                best = (m["log_loss"], model)
    finally:
        ready.unpersist()
        if binned is not None:
            binned.release()
    table = spark.createDataFrame(rows, "trial int, log_loss double, auc double, calibration_gap double, best_round int, pruned boolean, seconds double, params string")
    return table.withColumn("rank", F.row_number().over(Window.orderBy("log_loss", "trial"))), best[1]  # one row for each trial
