"""Exact ranking and probability metrics, calibration bins, thresholds, top-K and deciles of scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratewise.functions.features import clip_probability
from ratewise.operators import ranking
from ratewise.operators.rates import rate


def by_score(df: DataFrame, score: str = "score", label: str = "click") -> DataFrame:
    """Distinct scores of labelled rows with rows n, clicks c and the rows and clicks above (n_above, c_above)."""
    rows = df.dropna(subset=[label]).select(F.col(score).alias("s"), F.col(label).alias("y"))
    counts = rows.groupBy("s").agg(F.count("*").alias("n"), F.sum("y").alias("c"))
    return ranking.with_running(counts, "s", ["n", "c"], descending=True, of=rows).withColumnsRenamed({"n_before": "n_above", "c_before": "c_above"})


def roc_auc(df: DataFrame, score: str = "score", label: str = "click") -> DataFrame:
    """Exact, ties half counted; null with one class only."""
    x = by_score(df, score, label)
    won = F.sum((F.col("n") - F.col("c")) * (F.col("c_above") + F.col("c") / 2))
    return x.agg(F.try_divide(won, F.sum("c").cast("double") * F.sum(F.col("n") - F.col("c"))).alias("auc"))


def average_precision(df: DataFrame, score: str = "score", label: str = "click") -> DataFrame:
    x = by_score(df, score, label)
    part = F.col("c") * (F.col("c_above") + F.col("c")) / (F.col("n_above") + F.col("n"))
    return x.agg(F.try_divide(F.sum(part), F.sum("c").cast("double")).alias("average_precision"))


def probability_metrics(df: DataFrame, score: str = "score", label: str = "click") -> DataFrame:
    """Log loss of clamped scores, Brier score, mean score, actual rate and the gap between them."""
    p, y = F.col(score), F.col(label)
    loss = -F.ln(F.when(y == 1, clip_probability(p)).otherwise(1 - clip_probability(p)))
    x = df.agg(F.avg(loss).alias("log_loss"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(p).alias("mean_score"), F.avg(y).alias("actual_rate"))
    return x.withColumn("calibration_gap", F.abs(F.col("mean_score") - F.col("actual_rate")))


def confusion(df: DataFrame, threshold: float = 0.5, score: str = "score", label: str = "click") -> DataFrame:
    """One row at one threshold (score >= threshold selects): tp, fp, tn, fn, accuracy, precision, recall, f1, and the share selected; undefined rates are 0. Rows without a label are left out."""
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    x = df.dropna(subset=[label]).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~F.coalesce(hit, F.lit(False)) & ~y).alias("tn"), F.count_if(~F.coalesce(hit, F.lit(False)) & y).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    every = tp + fp + tn + fn
    return x.withColumns({"accuracy": rate(tp + tn, every), "precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "f1": rate(2 * tp, 2 * tp + fp + fn), "positive_share": rate(tp + fp, every)})


#: Coverages of the threshold grid and of the top-K table.
GRID_COVERAGES = (0.01, 0.02, 0.03, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.75, 0.9)
TOPK_COVERAGES = (0.01, 0.02, 0.03, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.75, 0.9, 1.0)


def threshold_grid(df: DataFrame, score: str = "score") -> DataFrame:
    """threshold: 0.01 to 0.50 by 0.01, 0.55 to 0.95 by 0.05, the scores at which GRID_COVERAGES of the rows lie above, the smallest and largest score; distinct, in order."""
    fixed = [round(i / 100, 2) for i in range(1, 51)] + [round(0.55 + 0.05 * i, 2) for i in range(9)]
    found = ranking.quantiles(df, score, [0.0, *[round(1 - c, 12) for c in reversed(GRID_COVERAGES)], 1.0])
    every = F.array_sort(F.array_distinct(F.concat(F.array(*[F.lit(x) for x in fixed]), "q")))
    return found.select(F.explode(every).alias("threshold"))


#: Columns of threshold_metrics besides the threshold and the four counts.
THRESHOLD_RATES = (
    "coverage", "precision", "recall", "specificity", "false_positive_rate", "false_negative_rate", "accuracy", "balanced_accuracy", "f1", "npv", "selected_ctr", "unselected_ctr", "overall_ctr", "lift", "capture", "missed", "youden_j")


def threshold_metrics(df: DataFrame, grid: list[float], score: str = "score", label: str = "click") -> DataFrame:
    """Confusion counts and rates for each threshold, score >= threshold being selected; undefined rates are null, F1 without a true positive among them. Rows without a label are left out.

    Rows are first counted by the highest threshold that they reach, so the data is read once whatever the grid.
    """
    steps = sorted(grid)
    level = sum((F.coalesce(F.col(score) >= t, F.lit(False)).cast("int") for t in steps[1:]), F.coalesce(F.col(score) >= steps[0], F.lit(False)).cast("int"))
    counts = df.dropna(subset=[label]).groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum(label).alias("c"))
    per = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(steps)])
    rows = counts.select("level", "n", "c", F.inline(per))
    hit = F.col("level") >= F.col("i")
    zero = F.lit(0)
    x = rows.groupBy("threshold").agg(
        F.sum(F.when(hit, F.col("c")).otherwise(zero)).alias("tp"), F.sum(F.when(hit, F.col("n") - F.col("c")).otherwise(zero)).alias("fp"),
        F.sum(F.when(~hit, F.col("n") - F.col("c")).otherwise(zero)).alias("tn"), F.sum(F.when(~hit, F.col("c")).otherwise(zero)).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    every = tp + fp + tn + fn
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    x = x.withColumns({
        "positive_rows": tp + fn, "negative_rows": fp + tn, "selected_rows": tp + fp, "coverage": ratio(tp + fp, every), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp),
        "false_positive_rate": ratio(fp, fp + tn), "false_negative_rate": ratio(fn, fn + tp), "accuracy": ratio(tp + tn, every), "f1": F.when(tp > 0, ratio(2 * tp, 2 * tp + fp + fn)), "npv": ratio(tn, tn + fn),
        "selected_ctr": ratio(tp, tp + fp), "unselected_ctr": ratio(fn, fn + tn), "overall_ctr": ratio(tp + fn, every), "capture": ratio(tp, tp + fn), "missed": ratio(fn, tp + fn)})
    return x.withColumns({"balanced_accuracy": (F.col("recall") + F.col("specificity")) / 2, "lift": F.try_divide(F.col("precision"), F.col("overall_ctr")), "youden_j": F.col("recall") + F.col("specificity") - 1})


def best_f1(thresholds: DataFrame) -> DataFrame:
    return thresholds.orderBy(F.desc_nulls_last("f1"), F.desc("threshold")).limit(1)


def with_score_rank(df: DataFrame, score: str = "score", id_col: str = "id") -> DataFrame:
    """rank from 1 by score (descending) and id, total (all rows), rank_share and decile. Ranks of a score start where the scores above end; ties of one score are ordered in ranges of the id."""
    starts = by_score(df.withColumn("_one", F.lit(1)), score, "_one").select(F.col("s").alias("_s"), "n_above")
    one = df.agg(F.count("*").alias("total"))
    placed = ranking.with_place(df, score, id_col, "_place").join(starts, F.col(score).eqNullSafe(F.col("_s"))).withColumn("rank", F.col("n_above") + F.col("_place")).join(F.broadcast(one))
    return placed.drop("_s", "n_above", "_place").withColumns({"rank_share": F.col("rank") / F.col("total"), "decile": group_of_rank(F.col("rank"), F.col("total"), 10)})


def _score_segments(df: DataFrame, cuts, segment, score: str, label: str, id_col: str) -> DataFrame:
    """segment, n, c, low, high, weight (sum of scores) for segments of the ranking by score (descending) and id, and total.

    cuts(total): an array of ranks after which a segment ends; segment(rank, total): a rank's segment. Whole scores are
    counted by score; only the rows of a score that a cut divides, one score for each cut at most, are ranked by id.
    """
    rows = df.select(F.col(score).alias("s"), F.col(label).alias("y"), F.col(id_col).alias("i"))
    counts = rows.groupBy("s").agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("c"))
    run = ranking.with_running(counts, "s", ["n"], descending=True, of=rows).join(F.broadcast(counts.agg(F.sum("n").alias("total"))))
    above = F.col("n_before")
    run = run.withColumn("cut", F.exists(cuts(F.col("total")), lambda k: (k > above) & (k < above + F.col("n"))))
    whole = run.filter("not cut").groupBy(segment(above + 1, F.col("total")).alias("segment")).agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.min("s").alias("low"), F.max("s").alias("high"), F.sum(F.col("s") * F.col("n")).alias("weight"), F.max("total").alias("total"))
    few = run.filter("cut").select(F.col("s").alias("_s"), F.col("n_before").alias("_above"), "total")  # a row for each cut at most
    tied = rows.join(F.broadcast(few), F.col("s").eqNullSafe(F.col("_s"))).drop("_s")
    placed = ranking.with_place(tied, "s", "i", "_place", of=rows)
    parts = placed.groupBy(segment(F.col("_above") + F.col("_place"), F.col("total")).alias("segment")).agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("c"), F.min("s").alias("low"), F.max("s").alias("high"), F.sum("s").alias("weight"), F.max("total").alias("total"))
    return whole.unionByName(parts).groupBy("segment").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("weight").alias("weight"), F.max("total").alias("total"))


def group_of_rank(rank: Column, total: Column, groups: int) -> Column:
    """Near-equal groups from 1; the first total % groups have one row more."""
    few, more = F.floor(total / groups), total % groups
    cut = more * (few + 1)
    return F.when(rank <= cut, F.ceil(rank / (few + 1))).otherwise(more + F.ceil((rank - cut) / F.greatest(few, F.lit(1)))).cast("int")


def topk_metrics(df: DataFrame, coverages=TOPK_COVERAGES, score: str = "score", label: str = "click", id_col: str = "id") -> DataFrame:
    """For each coverage its max(1, ceil(n * coverage)) best rows: clicks, cutoff, rate, lift, capture, gain (capture over coverage), clicks expected of as many random rows, and clicks beyond those."""
    steps = sorted({float(c) for c in coverages})
    last = lambda total, c: F.greatest(F.lit(1), F.ceil(total * F.lit(c))).cast("bigint")
    cuts = lambda total: F.array(*[last(total, c) for c in steps])
    # a segment is the number of coverages that do not reach a rank: rows count for the later ones
    segment = lambda rank, total: sum((last(total, c) < rank).cast("int") for c in steps[1:]) + (last(total, steps[0]) < rank).cast("int")
    cells = _score_segments(df, cuts, segment, score, label, id_col)
    per = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("coverage")) for i, c in enumerate(steps)])
    rows = cells.select("segment", "n", "c", "low", "total", F.inline(per))
    taken = F.col("segment") <= F.col("i")
    x = rows.groupBy("coverage").agg(F.sum(F.when(taken, F.col("n"))).alias("rows"), F.sum(F.when(taken, F.col("c"))).alias("clicks"), F.min(F.when(taken, F.col("low"))).alias("cutoff"), F.max("total").alias("_all"), F.sum("c").alias("_clicks"))
    x = x.withColumns({"ctr": rate(F.col("clicks"), F.col("rows")), "capture": rate(F.col("clicks"), F.col("_clicks")), "expected_clicks": rate(F.col("rows") * F.col("_clicks"), F.col("_all"))})
    lift = F.coalesce(F.try_divide(F.col("ctr"), rate(F.col("_clicks"), F.col("_all"))), F.lit(0.0))
    return x.withColumns({"lift": lift, "gain": F.try_divide(F.col("capture"), F.col("rows") / F.col("_all")), "incremental_clicks": F.col("clicks") - F.col("expected_clicks")}).drop("_all", "_clicks")


def score_groups(df: DataFrame, groups: int, ascending: bool, score: str = "score", label: str = "click", id_col: str = "id") -> DataFrame:
    """Near-equal groups in score order (deciles, calibration bins): rows, clicks, score range and mean, rate, gap, weighted gap, lift, share of clicks, and rows, coverage, clicks and capture up to each group."""
    sized = lambda total, k: F.floor(total / groups) * k + F.least(total % groups, F.lit(k))  # noqa: E731  rows of the first k groups
    cuts = lambda total: F.array(*[(total - sized(total, k) if ascending else sized(total, k)).cast("bigint") for k in range(1, groups)], F.lit(0).cast("bigint"))
    segment = lambda rank, total: group_of_rank(total + 1 - rank if ascending else rank, total, groups)
    x = _score_segments(df, cuts, segment, score, label, id_col).select(
        F.col("segment").alias("grp"), F.col("n").alias("n_rows"), F.col("c").alias("clicks"), F.col("low").alias("min_score"), F.col("high").alias("max_score"), F.round(F.col("weight") / F.col("n"), 9).alias("mean_score"))
    x = x.withColumn("ctr", rate(F.col("clicks"), F.col("n_rows"))).withColumn("gap", F.round(F.abs(F.col("mean_score") - F.col("ctr")), 9))
    every, upto = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("grp")  # one row for each group
    rows, clicks = F.sum("n_rows").over(every), F.sum("clicks").over(every)
    return x.withColumns({
        "weighted_gap": F.col("gap") * F.col("n_rows") / rows, "lift": F.coalesce(F.try_divide(F.col("ctr"), rate(clicks, rows)), F.lit(0.0)), "click_share": rate(F.col("clicks"), clicks), "cumulative_rows": F.sum("n_rows").over(upto),
        "cumulative_coverage": rate(F.sum("n_rows").over(upto), rows), "cumulative_clicks": F.sum("clicks").over(upto), "cumulative_capture": rate(F.sum("clicks").over(upto), clicks)})


#: The quantiles of a score summary, in percent.
PERCENTS = (0, 1, 5, 10, 25, 50, 75, 90, 95, 99, 100)


def score_summary(df: DataFrame, score: str = "score", label: str = "click") -> DataFrame:
    """Rows, clicks, rate, mean score and its quantiles, interpolated; AUC, average precision, log loss and Brier score of the labelled rows. One row, all of it from the counts by score."""
    rows, y = df.select(F.col(score).cast("double").alias("s"), F.col(label).alias("y")), F.col("y")
    counts = rows.groupBy("s").agg(F.count("*").alias("n"), F.count(y).alias("m"), F.coalesce(F.sum(y), F.lit(0)).alias("c"))
    run = ranking.with_running(counts, "s", ["n", "m", "c"], descending=True, of=rows)
    run = run.join(F.broadcast(counts.agg(F.sum(F.when(F.col("s").isNotNull(), F.col("n"))).alias("_total"))))
    s, n, m, c, m_above, c_above = (F.col(k) for k in ("s", "n", "m", "c", "m_before", "c_before"))
    p = clip_probability(s)
    won, hit = (m - c) * (c_above + c / 2), c * (c_above + c) / F.nullif(m_above + m, F.lit(0))
    loss, square = -(c * F.ln(p) + (m - c) * F.ln(1 - p)), c * (1 - s) * (1 - s) + (m - c) * s * s
    labelled = lambda x: F.try_divide(F.sum(F.when(s.isNotNull(), x)), F.sum(F.when(s.isNotNull(), m)))
    per = ranking.quantile_values(s, F.col("_total") - F.col("n_before") - n, n, F.col("_total"), [q / 100 for q in PERCENTS])
    return run.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n_rows"), F.sum(c).alias("clicks"), F.try_divide(F.sum(c).cast("double"), F.sum(m)).alias("ctr"), F.try_divide(F.sum(s * n), F.max("_total")).alias("mean_score"), *[q.alias(f"p{k}") for k, q in zip(PERCENTS, per, strict=True)],
        F.try_divide(F.sum(won), F.sum(c).cast("double") * F.sum(m - c)).alias("auc"), F.try_divide(F.sum(hit), F.sum(c).cast("double")).alias("average_precision"), labelled(loss).alias("log_loss"), labelled(square).alias("brier"))


def ranked_metrics(df: DataFrame, score: str = "score", label: str = "click") -> DataFrame:
    """One row: log loss, Brier score, mean score, actual rate, their gap, AUC and average precision, all from the counts by score."""
    x = score_summary(df, score, label)
    return x.select("log_loss", "brier", "mean_score", F.col("ctr").alias("actual_rate"), F.abs(F.col("mean_score") - F.col("ctr")).alias("calibration_gap"), "auc", "average_precision")


def model_metrics(df: DataFrame, name: str, threshold: float = 0.5, features: int | None = None, seconds: float | None = None, score: str = "score", label: str = "click") -> DataFrame:
    """One row for a scored table: the model's name, rows, confusion at the threshold, AUC, average precision, probability metrics, number of features and seconds; holdout_used is false, as no holdout row is looked at unless given."""
    x = df.agg(F.lit(name).alias("model"), F.count("*").alias("n_rows"))
    for one in (confusion(df, threshold, score, label), ranked_metrics(df, score, label)):
        x = x.join(F.broadcast(one))
    return x.withColumns({"feature_count": F.lit(features).cast("int"), "seconds": F.lit(seconds).cast("double"), "holdout_used": F.lit(False)})


def compare_models_priority(metrics: DataFrame, base: str) -> DataFrame:
    """compare_models with the place by AUC, then log loss, then gap, and each model's improvement over the base model."""
    every = Window.partitionBy(F.lit(0))  # one row for each model
    x = compare_models(metrics).withColumn("priority_rank", F.row_number().over(every.orderBy(F.desc("auc"), "log_loss", "calibration_gap", "model")))
    return x.join(relative_improvement(metrics, base), "model").withColumn("is_best", F.col("priority_rank") == 1)


def relative_improvement(metrics: DataFrame, base: str) -> DataFrame:
    """model, and against the base model: auc_gain, auc_gain_percent, log_loss_reduction (and percent), gap_reduction (and percent); null where the base value is 0."""
    one = metrics.filter(F.col("model") == base).select(*[F.col(c).alias(f"_{c}") for c in ("auc", "log_loss", "calibration_gap")])
    x = metrics.join(F.broadcast(one))
    fall = lambda c: F.col(f"_{c}") - F.col(c)
    percent = lambda v, c: 100 * F.try_divide(v, F.col(f"_{c}"))
    return x.select(
        "model", (-fall("auc")).alias("auc_gain"), percent(-fall("auc"), "auc").alias("auc_gain_percent"), fall("log_loss").alias("log_loss_reduction"), percent(fall("log_loss"), "log_loss").alias("log_loss_reduction_percent"),
        fall("calibration_gap").alias("gap_reduction"), percent(fall("calibration_gap"), "calibration_gap").alias("gap_reduction_percent"))


def best_per_metric(metrics: DataFrame) -> DataFrame:
    """criterion, model, value: the best model by AUC, log loss and gap; ties go to the first name."""
    goals = {"auc": F.desc("auc"), "log_loss": F.asc("log_loss"), "calibration_gap": F.asc("calibration_gap")}
    every = Window.partitionBy(F.lit(0))  # one row for each model
    out = None
    for c, order in goals.items():
        x = metrics.withColumn("_r", F.row_number().over(every.orderBy(order, "model"))).filter("_r = 1").select(F.lit(c).alias("criterion"), "model", F.col(c).alias("value"))
        out = x if out is None else out.unionByName(x)
    return out


def strategy_summary(df: DataFrame, method: str, thresholds: DataFrame, score: str = "score", label: str = "click", id_col: str = "id") -> DataFrame:
    """One row: the selected method, rows, clicks, rate, AUC, average precision, the threshold of largest F1, and rate, lift and capture of the best 1, 5, 10 and 20 percent."""
    top = topk_metrics(df, (0.01, 0.05, 0.1, 0.2, 1.0), score, label, id_col)
    cells = [F.max(F.when(F.col("coverage") == c, F.col(m))).alias(f"top_{round(100 * c)}_{m}") for c in (0.01, 0.05, 0.1, 0.2) for m in ("ctr", "lift", "capture")]
    x = df.agg(F.lit(method).alias("method"), F.count("*").alias("n_rows"), F.sum(label).alias("clicks"), F.avg(label).alias("ctr"))
    point = best_f1(thresholds).select(F.col("threshold").alias("max_f1_threshold"), F.col("precision").alias("max_f1_precision"), F.col("recall").alias("max_f1_recall"), F.col("f1").alias("max_f1"))
    for one in (roc_auc(df, score, label), average_precision(df, score, label), point, top.agg(*cells)):
        x = x.join(F.broadcast(one))
    return x


def compare_models(metrics: DataFrame) -> DataFrame:
    """Ranks of models (one row each) by AUC, log loss and gap, ties sharing the best; their mean; and the overall rank."""
    every = Window.partitionBy(F.lit(0))  # one row for each model
    x = metrics.withColumns({
        "auc_rank": F.rank().over(every.orderBy(F.desc("auc"))), "log_loss_rank": F.rank().over(every.orderBy("log_loss")), "gap_rank": F.rank().over(every.orderBy("calibration_gap"))})
    x = x.withColumn("mean_rank", (F.col("auc_rank") + F.col("log_loss_rank") + F.col("gap_rank")) / 3)
    return x.withColumn("overall_rank", F.rank().over(every.orderBy("mean_rank")))


def operating_points(thresholds: DataFrame) -> DataFrame:
    """The thresholds of largest F1 and Youden J, of recall 0.8 and 0.9 at best precision, precision 0.25 at best recall, coverage nearest 0.1 and 0.2.

    Ties go to the higher threshold; a point that no threshold reaches has feasible false and nulls.
    """
    c = F.col
    goals = {
        "max_f1": (c("f1"), F.lit(True)), "max_youden_j": (c("youden_j"), F.lit(True)), "recall_80": (c("precision"), c("recall") >= 0.8), "recall_90": (c("precision"), c("recall") >= 0.9),
        "precision_25": (c("recall"), c("precision") >= 0.25), "coverage_10": (-F.abs(c("coverage") - 0.1), F.lit(True)), "coverage_20": (-F.abs(c("coverage") - 0.2), F.lit(True))}
    best = [F.max(F.when(ok & goal.isNotNull(), F.struct(F.round(goal, 12).alias("goal"), "threshold", "precision", "recall", "f1", "coverage"))).alias(n) for n, (goal, ok) in goals.items()]
    rows = thresholds.agg(*best).select(F.inline(F.array(*[F.struct(F.lit(n).alias("point"), c(n).alias("x")) for n in goals])))
    return rows.select("point", c("x").isNotNull().alias("feasible"), *[c("x")[k].alias(k) for k in ("threshold", "precision", "recall", "f1", "coverage")])
