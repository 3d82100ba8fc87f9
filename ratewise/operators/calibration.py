"""Calibrators of scores: fit on one part, compared on another, chosen by log loss."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.functions.features import clip_probability, logit
from ratewise.operators import evaluation, ranking, splits


def _logits(df: DataFrame, score: str) -> DataFrame:
    return VectorAssembler(inputCols=["_logit"], outputCol="_x").transform(df.withColumn("_logit", logit(F.col(score))))


def fit_sigmoid(df: DataFrame, score: str = "score", label: str = "click") -> LogisticRegressionModel:
    """Logistic regression on the logit of the score, fitted on the distinct scores weighted by their rows; L2 weight 1 over the rows."""
    counts = df.groupBy(score).agg(F.sum(label).alias("pos"), F.count(label).alias("n"))
    both = F.array(F.struct(F.lit(1.0).alias("y"), F.col("pos").cast("double").alias("w")), F.struct(F.lit(0.0).alias("y"), (F.col("n") - F.col("pos")).cast("double").alias("w")))
    rows = _logits(counts.select(score, F.inline(both)).filter("w > 0"), score)
    n = max(df.count(), 1)
    return LogisticRegression(featuresCol="_x", labelCol="y", weightCol="w", regParam=1.0 / n, standardization=False, maxIter=200, tol=1e-9).fit(rows)


def apply_sigmoid(model: LogisticRegressionModel, df: DataFrame, score: str = "score", out: str = "sigmoid") -> DataFrame:
    """The calibrated score by the fitted line on the logit, an expression without any vector column; clamped."""
    z = F.lit(float(model.coefficients[0])) * logit(F.col(score)) + F.lit(float(model.intercept))
    return df.withColumn(out, clip_probability(1 / (1 + F.exp(-z))))


@dataclass(frozen=True)
class Isotonic:
    """Knots of a non-decreasing fit: scores in rising order and the value at each; linear between them, constant outside."""

    scores: list[float]
    values: list[float]


def _pooled(rows: list[tuple[float, float, float, float]]) -> list[tuple[float, float, float, float]]:
    """Pool adjacent violators: pools (low, high, sum of labels, weight) in order of low, neighbours joined until their means rise."""
    out = []
    for low, high, total, weight in rows:
        while out and out[-1][2] * weight >= total * out[-1][3]:
            first, _, t, w = out.pop()
            low, total, weight = first, total + t, weight + w
        out.append((low, high, total, weight))
    return out


#: Neighbouring groups of pools that one task joins in a round.
FAN = 32


def pools(df: DataFrame, score: str = "score", label: str = "click") -> DataFrame:
    """low, high, total, weight: the pools of the non-decreasing fit of label on score; rows without a score or label are left out.

    Rows are counted by score, and scores cut into ranges. Each range is pooled by a task of its own; then FAN neighbours
    are joined at a time, round by round. Pools of a part are parts of the whole's pools, so every round hands on pools
    only: of 0/1 labels a range has about as many as the cube root of its scores, the last round about that of all.
    """
    rows = df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("y")).dropna()
    counts = rows.groupBy("s").agg(F.sum("y").alias("total"), F.count("*").cast("double").alias("weight"))
    cut = ranking.with_range(counts, "s", "part", of=rows).select("part", F.col("s").alias("low"), F.col("s").alias("high"), "total", "weight")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("low")
        found = pd.DataFrame(_pooled(list(zip(pdf["low"], pdf["high"], pdf["total"], pdf["weight"], strict=True))), columns=["low", "high", "total", "weight"])
        return found.assign(part=int(pdf["part"].iloc[0]))[["part", "low", "high", "total", "weight"]]

    schema = "part int, low double, high double, total double, weight double"
    for _ in range(math.ceil(ranking.STEPS / math.log2(FAN)) + 1):  # 2**STEPS ranges at most
        cut = cut.groupBy("part").applyInPandas(join, schema).withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
    return cut.drop("part")


def fit_isotonic(df: DataFrame, score: str = "score", label: str = "click") -> Isotonic:
    """Non-decreasing fit by pools; a pool's ends are knots of its mean. Without a labelled row every score has value 0."""
    found = pools(df, score, label).orderBy("low").collect()  # the pools are the model
    scores, values = [], []
    for p in found:
        for at in dict.fromkeys((p["low"], p["high"])):
            scores.append(at)
            values.append(p["total"] / p["weight"])
    return Isotonic(scores or [0.0], values or [0.0])


def apply_isotonic(model: Isotonic, df: DataFrame, score: str = "score", out: str = "isotonic") -> DataFrame:
    """Linear between knots, constant outside of them; clamped. A null score stays null."""

    @F.pandas_udf("double")
    def value(s: pd.Series) -> pd.Series:
        return pd.Series(np.interp(s, model.scores, model.values))

    return df.withColumn(out, F.when(F.col(score).isNotNull(), clip_probability(value(F.col(score).cast("double")))))


def scores_long(df: DataFrame, methods: dict[str, str], keep: list[str]) -> DataFrame:
    """One row for each row and method: keep, method, score."""
    per = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("score")) for m, c in methods.items()])
    return df.select(*keep, F.inline(per))


def ece_mce(bins: DataFrame) -> DataFrame:
    """Gaps weighted by rows, and the largest gap, of calibration bins."""
    return bins.agg(F.try_divide(F.sum(F.col("gap") * F.col("n_rows")), F.sum("n_rows")).alias("ece"), F.max("gap").alias("mce"))


def calibration_metrics(df: DataFrame, methods: dict[str, str], bins: int = 20, label: str = "click", id_col: str = "id") -> DataFrame:
    """For each method (name: score column): confusion at 0.5, log loss, Brier, means and gap, AUC, average precision, ECE and MCE; one row each."""
    out = None
    for name, column in methods.items():
        x = df.select(id_col, label, F.col(column).alias("score"))
        row = evaluation.ranked_metrics(x, "score", label).join(evaluation.confusion(x, 0.5, "score", label))
        row = row.join(ece_mce(evaluation.score_groups(x, bins, True, "score", label, id_col))).select(F.lit(name).alias("method"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def select_calibrator(metrics: DataFrame, raw: str = "raw") -> DataFrame:
    """The method of the smallest log loss, then Brier, ECE and gap, with what each of them changes against the raw scores."""
    keys = ("log_loss", "brier", "ece", "calibration_gap")
    best = metrics.orderBy(*keys, "method").limit(1)
    base = metrics.filter(F.col("method") == raw).select(*[F.col(k).alias(f"_{k}") for k in keys])
    return best.join(F.broadcast(base), how="left").withColumns({f"{k}_change": F.col(k) - F.col(f"_{k}") for k in keys}).drop(*[f"_{k}" for k in keys])


def refit_selected(df: DataFrame, method: str, score: str = "score", label: str = "click"):
    """The chosen method fitted on all rows; None for raw scores. The result is not evaluated again."""
    return {"raw": lambda: None, "sigmoid": lambda: fit_sigmoid(df, score, label), "isotonic": lambda: fit_isotonic(df, score, label)}[method]()


def calibration_split(df: DataFrame, label: str = "click", fraction: float = 0.6, id_col: str = "id", seed: int = 42, drift: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """(df with part a to fit and b to compare, stratified by label; a check row that warns where the parts' rates lie more than drift apart)."""
    parts = splits.stratified_split(df, label, fraction, id_col, seed)
    rates = parts.agg(F.avg(F.when(F.col("part") == "a", F.col(label))).alias("a"), F.avg(F.when(F.col("part") == "b", F.col(label))).alias("b"))
    gap = F.abs(F.col("a") - F.col("b"))
    return parts, rates.select(F.lit("calibration_split").alias("check"), F.lit(label).alias("subject"), F.when(gap > drift, "WARNING").otherwise("PASS").alias("status"), F.round(gap, 9).cast("string").alias("observed"), F.lit(str(drift)).alias("expected"))


def check_calibration(parts: DataFrame, whole: DataFrame, metrics: DataFrame, bins: DataFrame, id_col: str = "id") -> DataFrame:
    """Check rows: the split is disjoint and complete, ECE lies in [0, 1], metrics are finite, and the bins' rows add up to those of part b."""
    ids = parts.groupBy(id_col).agg(F.count_distinct("part").alias("p")).agg(F.count("*").alias("ids"), F.count_if(F.col("p") > 1).alias("in_both"))
    x = ids.join(parts.agg(F.count("*").alias("rows"), F.count_if(F.col("part") == "b").alias("b_rows"))).join(whole.agg(F.count("*").alias("all_rows")))
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    x = x.join(metrics.agg(F.count_if(~F.col("ece").between(0, 1)).alias("bad_ece"), F.count_if(bad("log_loss") | bad("brier") | bad("auc")).alias("not_finite"))).join(bins.agg(F.sum("n_rows").alias("bin_rows")))
    rules = {"disjoint": ("in_both", F.lit(0)), "complete": ("rows", F.col("all_rows")), "ece_range": ("bad_ece", F.lit(0)), "finite": ("not_finite", F.lit(0)), "bin_rows": ("bin_rows", F.col("b_rows"))}
    rows = [F.struct(F.lit(n).alias("check"), F.lit("calibration").alias("subject"), F.when(F.col(c) == e, "PASS").otherwise("ERROR").alias("status"), F.col(c).cast("string").alias("observed"), e.cast("string").alias("expected")) for n, (c, e) in rules.items()]
    return x.select(F.inline(F.array(*rows)))


def check_monotone(df: DataFrame, before: str, after: str, slack: float = 1e-12) -> DataFrame:
    """One row: places where the score after falls as the one before rises. Distinct scores are compared within ranges, and ranges with one another."""
    pairs = df.groupBy(F.col(before).alias("b")).agg(F.min(after).alias("low"), F.max(after).alias("high"))
    pairs = ranking.with_range(pairs, "b", "r")
    fell = F.col("low") < F.lag("high").over(Window.partitionBy("r").orderBy("b")) - slack
    inside = pairs.withColumn("fell", fell).groupBy("r").agg(F.count_if("fell").alias("falls"), F.min_by("low", "b").alias("first"), F.max_by("high", "b").alias("last"))
    across = F.col("first") < F.lag("last").over(Window.orderBy("r")) - slack  # one row for each range
    return inside.withColumn("across", F.coalesce(across, F.lit(False)).cast("int")).agg((F.coalesce(F.sum("falls"), F.lit(0)) + F.coalesce(F.sum("across"), F.lit(0))).alias("falls"))


def probability_of_one(df: DataFrame, vector: str = "probability", out: str = "score") -> DataFrame:
    return df.withColumn(out, vector_to_array(F.col(vector))[1])
