"""Click models with Spark ML, and what each feature adds to a linear score."""

from __future__ import annotations

import json
import math
import random
import re
import time
from collections import Counter

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratewise.functions.features import contribution_direction, feature_entity, feature_family, finite_or_zero, hour_cyclic, log1p_columns
from ratewise.operators import evaluation, ranking
from ratewise.operators.calibration import probability_of_one

#: Endings of the columns that are features.
FEATURE_ENDINGS = ("_freq", "_hist_impressions", "_hist_clicks", "_hist_ctr", "_exposure_percentile", "_te")


def discover_features(columns: list[str], deny: tuple[str, ...] = (), expected: int | None = None) -> list[str]:
    """Columns with a feature's ending, sorted, then is_weekend and the two hour terms; an error where one kind is missing, or where there are not as many as expected."""
    found = sorted(c for c in columns if c.endswith(FEATURE_ENDINGS) and c not in deny and not re.fullmatch(r"C\d+", c))
    if not found or "is_weekend" not in columns:
        raise ValueError("no feature column found" if not found else "is_weekend is missing")
    every = [*found, "is_weekend", "hour_sin", "hour_cos"]
    if expected is not None and len(every) != expected:
        raise ValueError(f"{len(every)} features, not {expected}")
    return every


def matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """Features as doubles; null, NaN and infinite values are 0."""
    return df.withColumns({c: finite_or_zero(F.col(c).cast("double")) for c in features})


def build_matrix(df: DataFrame, features: list[str], hour: str = "hour_of_day") -> DataFrame:
    """In this order: counts as log(1 + x), the hour as sine and cosine, then null, NaN and infinite values as 0."""
    x = log1p_columns(df, features)
    if hour in df.columns:
        sin, cos = hour_cyclic(F.col(hour))
        x = x.withColumns({"hour_sin": sin, "hour_cos": cos})
    return matrix(x, features)


def fit_logistic(df: DataFrame, features: list[str], label: str = "click", reg: float = 1e-4) -> PipelineModel:
    """L2 logistic regression on standardised features; scaler and model fit on df only."""
    steps = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="_x"),
             LogisticRegression(featuresCol="_x", labelCol=label, regParam=reg, elasticNetParam=0.0, standardization=False)]
    return Pipeline(stages=steps).fit(matrix(df, features))


def fit_boosted(df: DataFrame, features: list[str], label: str = "click", valid_flag: str | None = None, rounds: int = 50, step: float = 0.1, depth: int = 5, row_share: float = 0.8, seed: int = 42) -> PipelineModel:
    """Boosted trees; with valid_flag (a boolean column) rounds stop early on its rows."""
    gbt = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=rounds, stepSize=step, maxDepth=depth, subsamplingRate=row_share, seed=seed)
    if valid_flag:
        gbt = gbt.setValidationIndicatorCol(valid_flag)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), gbt]).fit(matrix(df, features))


def score(model: PipelineModel, df: DataFrame, features: list[str], out: str = "score") -> DataFrame:
    """df and the probability of class 1."""
    x = probability_of_one(model.transform(matrix(df, features)), "probability", out)
    return x.drop("_raw", "_x", "rawPrediction", "probability", "prediction")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def coefficients(spark: SparkSession, model: PipelineModel, features: list[str]) -> DataFrame:
    """feature, coefficient, absolute, direction; largest first."""
    rows = [(f, float(c)) for f, c in zip(features, model.stages[-1].coefficients.toArray(), strict=True)]
    x = spark.createDataFrame(rows, "feature string, coefficient double").withColumn("absolute", F.abs("coefficient"))
    way = F.when(F.col("coefficient") > 0, "positive").when(F.col("coefficient") < 0, "negative").otherwise("zero")
    return x.withColumn("direction", way).orderBy(F.desc("absolute"), "feature")


def tree_importance(spark: SparkSession, model: PipelineModel, features: list[str]) -> DataFrame:
    """feature, its share of the gain, the number of splits by it, rank by gain."""
    splits = Counter(int(k) for tree in model.stages[-1].trees for k in re.findall(r"If \(feature (\d+) ", tree.toDebugString))
    rows = [(f, float(g), splits[k]) for k, (f, g) in enumerate(zip(features, model.stages[-1].featureImportances.toArray(), strict=True))]
    return spark.createDataFrame(rows, "feature string, gain double, splits long").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("gain"), "feature")))


def linear_contributions(model: PipelineModel, df: DataFrame, features: list[str], id_col: str = "id") -> DataFrame:
    """id, base (the log-odds at the mean of the fitted rows), feature, value, contribution in log-odds; one row for each feature."""
    scaler, last = model.stages[-2], model.stages[-1]
    parts = []
    for f, mean, std, c in zip(features, scaler.mean, scaler.std, last.coefficients, strict=True):
        weight = float(c) / float(std) if std else 0.0
        parts.append(F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"), ((F.col(f) - float(mean)) * weight).alias("contribution")))
    return matrix(df, features).select(id_col, F.lit(float(last.intercept)).alias("base"), F.inline(F.array(*parts)))


def check_additive(contributions: DataFrame, scored: DataFrame, id_col: str = "id", score: str = "score") -> DataFrame:
    """Mean and largest distance between base plus contributions and the log-odds of the score."""
    sums = contributions.groupBy(id_col).agg((F.first("base") + F.sum("contribution")).alias("z"))
    x = sums.join(scored.select(id_col, F.ln(F.col(score) / (1 - F.col(score))).alias("want")), id_col)
    return x.agg(F.avg(F.abs(F.col("z") - F.col("want"))).alias("mean_error"), F.max(F.abs(F.col("z") - F.col("want"))).alias("max_error"))


def global_importance(contributions: DataFrame) -> DataFrame:
    """For each feature: mean absolute, mean signed, exact median absolute, population deviation, shares of signs, percent of all, rank."""
    c = F.col("contribution")
    x = contributions.groupBy("feature").agg(
        F.avg(F.abs(c)).alias("mean_abs"), F.avg(c).alias("mean_signed"), F.stddev_pop(c).alias("std"),
        F.avg((c > 0).cast("int")).alias("positive_share"), F.avg((c < 0).cast("int")).alias("negative_share"))
    medians = ranking.quantiles(contributions.withColumn("_abs", F.abs(c)), "_abs", [0.5], "feature").select("feature", F.col("q")[0].alias("median_abs"))
    x = x.join(F.broadcast(medians), "feature", "left")  # one row for each feature
    every = Window.partitionBy(F.lit(0))
    percent = F.coalesce(F.try_divide(100 * F.col("mean_abs"), F.sum("mean_abs").over(every)), F.lit(0.0))
    return x.withColumns({"percent": percent, "rank": F.row_number().over(every.orderBy(F.desc("mean_abs"), "feature"))})


def find_cases(scored: DataFrame, threshold: float, score: str = "score", label: str = "click", id_col: str = "id") -> DataFrame:
    """The most extreme true and false positive and negative; ties go to the smallest id, a kind without rows is absent."""
    hit, y, s = F.col(score) >= threshold, F.col(label) == 1, F.col(score)
    kind = F.when(hit & y, "true_positive").when(hit, "false_positive").when(y, "false_negative").otherwise("true_negative")
    far = F.when(hit, -s).otherwise(s)
    return scored.groupBy(kind.alias("case")).agg(F.min(F.struct(far.alias("far"), F.col(id_col).alias("id"), s.alias("score"))).alias("x")).select("case", "x.id", "x.score")


#: What a trial of a search draws, evenly or on a log scale (low, high, log): depth, step, rows of a leaf, gain of a split, share of rows and of features.
SEARCH_SPACE = {"maxDepth": (3, 7, False), "stepSize": (0.02, 0.15, True), "minInstancesPerNode": (1, 300, True), "minInfoGain": (0.0, 0.2, False), "subsamplingRate": (0.7, 1.0, False), "features": (0.7, 1.0, False)}


def search_boosted(spark: SparkSession, df: DataFrame, features: list[str], valid_flag: str, trials: int = 20, rounds: int = 50, label: str = "click", seed: int = 42) -> tuple[DataFrame, PipelineModel]:
    """(a row for each trial, the best trial's model): seeded draws, each fitted with early stopping and judged by the log loss on the rows of valid_flag.

    Spark's trees have no number of leaves and no L1 or L2 weight; depth, step, rows of a leaf, gain, and shares of rows and features are searched.
    """
    rng, rows, best = random.Random(seed), [], None
    ready = matrix(df, features).select(*features, label, valid_flag).persist()
    try:
        for trial in range(trials):
            drawn = {k: math.exp(rng.uniform(math.log(lo), math.log(hi))) if log else rng.uniform(lo, hi) for k, (lo, hi, log) in SEARCH_SPACE.items()}
            params = {"maxDepth": round(drawn["maxDepth"]), "stepSize": drawn["stepSize"], "minInstancesPerNode": round(drawn["minInstancesPerNode"]), "minInfoGain": drawn["minInfoGain"], "subsamplingRate": drawn["subsamplingRate"], "featureSubsetStrategy": f"{drawn['features']:.3f}"}
            started = time.monotonic()
            gbt = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=rounds, seed=seed, validationIndicatorCol=valid_flag, **params)
            model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), gbt]).fit(ready)
            scored = score(model, ready.filter(F.col(valid_flag)), features)
            m = evaluation.probability_metrics(scored, "score", label).join(evaluation.roc_auc(scored, "score", label)).first()
            rows.append((trial, float(m["log_loss"]), m["auc"], float(m["calibration_gap"]), len(model.stages[-1].trees), time.monotonic() - started, json.dumps(params)))
            if best is None or rows[-1][1] < best[0]:
                best = (rows[-1][1], model)
    finally:
        ready.unpersist()
    return spark.createDataFrame(rows, "trial int, log_loss double, auc double, calibration_gap double, best_round int, seconds double, params string").withColumn("rank", F.row_number().over(Window.orderBy("log_loss", "trial"))), best[1]


def score_models(df: DataFrame, models: dict[str, tuple[PipelineModel, list[str]]], keep: list[str]) -> DataFrame:
    """keep and one probability column for each model (name: model and its features), in one pass."""
    x = df
    for i, (model, features) in enumerate(models.values()):
        ready = df.select(*keep, *[c for c in df.columns if c not in keep]) if i == 0 else x
        raw = {f: F.col(f) for f in features}
        x = score(model, ready.withColumns({f"_keep_{f}": c for f, c in raw.items()}), features, f"_score_{i}")
        x = x.withColumns({f: F.col(f"_keep_{f}") for f in features}).drop(*[f"_keep_{f}" for f in features])
    return x.select(*keep, *[F.col(f"_score_{i}").alias(name) for i, name in enumerate(models)])


def group_importance(importance: DataFrame, by: str, entities: list[str] | None = None) -> DataFrame:
    """From global_importance, by 'family' or 'entity': features, total mean absolute contribution, the strongest feature and its value, percent of all."""
    group = feature_family(F.col("feature")) if by == "family" else feature_entity(F.col("feature"), entities or [])
    x = importance.groupBy(group.alias(by)).agg(F.count("*").alias("feature_count"), F.sum("mean_abs").alias("total_mean_abs"), F.max(F.struct("mean_abs", "feature")).alias("top"))
    percent = F.coalesce(F.try_divide(100 * F.col("total_mean_abs"), F.sum("total_mean_abs").over(Window.partitionBy(F.lit(0)))), F.lit(0.0))  # one row for each group
    return x.select(by, "feature_count", "total_mean_abs", F.col("top.feature").alias("top_feature"), F.col("top.mean_abs").alias("top_mean_abs"), percent.alias("percent"))


def case_contributions(contributions: DataFrame, cases: DataFrame, id_col: str = "id") -> DataFrame:
    """Of each case (case, id, score) its features by absolute contribution, with their rank and direction."""
    few = cases.select("case", F.col("id").alias("_id"), "score")  # four rows
    x = contributions.join(F.broadcast(few), F.col(id_col) == F.col("_id")).drop("_id")
    order = Window.partitionBy("case").orderBy(F.desc(F.abs("contribution")), "feature")  # one row for each feature
    return x.withColumns({"rank": F.row_number().over(order), "direction": contribution_direction(F.col("contribution"))})


def case_extremes(contributions: DataFrame) -> DataFrame:
    """From case_contributions: for each case the features that raise and lower its score most; null where none does."""
    c = F.col("contribution")
    x = contributions.groupBy("case").agg(F.max(F.when(c > 0, F.struct(c.alias("v"), F.col("feature").alias("f")))).alias("up"), F.min(F.when(c < 0, F.struct(c.alias("v"), F.col("feature").alias("f")))).alias("down"))
    return x.select("case", F.col("up.f").alias("top_positive"), F.col("up.v").alias("top_positive_value"), F.col("down.f").alias("top_negative"), F.col("down.v").alias("top_negative_value"))
