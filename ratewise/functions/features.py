"""Row-local features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-7


def time_parts(df: DataFrame, ts: str = "ts") -> DataFrame:
    """hour, day of month, weekday (Monday 0) and is_weekend (0 without a time)."""
    day = F.weekday(ts)
    return df.withColumns({"hour_of_day": F.hour(ts), "day": F.dayofmonth(ts), "weekday": day, "is_weekend": F.when(day.isin(5, 6), 1).otherwise(0)})


def cross_key(a: Column, b: Column) -> Column:
    """a_b, null if either is."""
    return F.concat(a.cast("string"), F.lit("_"), b.cast("string"))


def hour_cyclic(hour: Column) -> tuple[Column, Column]:
    angle = hour * (2 * math.pi / 24)
    return F.sin(angle), F.cos(angle)


def finite_or_zero(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c).cast("float")


def clip_probability(p: Column, eps: float = EPSILON) -> Column:
    return F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))


def logit(p: Column) -> Column:
    c = clip_probability(p)
    return F.ln(c / (1 - c))


def hard_label(p: Column, threshold: float = 0.5) -> Column:
    return (p >= threshold).cast("int")


def event_date(df: DataFrame, date: str = "date", hour: str = "hour", ts: str = "hour_dt") -> Column:
    """The date of a row: from its date, else its yyMMddHH hour (text or number, a trailing .0 ignored, zeros in front), else its time; null where none parses."""
    found = []
    if date in df.columns:
        found.append(F.col(date).try_cast("date"))
    if hour in df.columns:
        text = F.lpad(F.regexp_replace(F.col(hour).cast("string"), r"\.0$", ""), 8, "0")
        found.append(F.try_to_timestamp(F.concat(F.lit("20"), F.substring(text, 1, 6)), F.lit("yyyyMMdd")).cast("date"))
    if ts in df.columns:
        found.append(F.to_date(ts))
    if not found:
        raise ValueError(f"none of {date}, {hour}, {ts} is a column")
    return F.coalesce(*found)


#: Endings of counts that models take as log(1 + x).
LOG1P_ENDINGS = ("_freq", "_hist_impressions", "_hist_clicks")


def log1p_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """log(1 + x) of the count columns among columns (all of them without a list)."""
    return df.withColumns({c: F.log1p(F.col(c).cast("double")) for c in (columns or df.columns) if c.endswith(LOG1P_ENDINGS)})


#: Families of features by their ending, and time features.
FAMILIES = {
    "_te": "target_encoding",
    "_hist_ctr": "historical_ctr",
    "_hist_impressions": "historical_impressions",
    "_hist_clicks": "historical_clicks",
    "_exposure_percentile": "exposure_percentile",
    "_freq": "frequency",
}
TIME_FEATURES = ("is_weekend", "hour_sin", "hour_cos")


def feature_family(name: Column) -> Column:
    """The family of a feature by its name's ending, time for time features, else other."""
    out = F.when(name.isin(*TIME_FEATURES), "time").otherwise("other")
    for ending, family in reversed(FAMILIES.items()):
        out = F.when(name.endswith(ending), family).otherwise(out)
    return out


def feature_entity(name: Column, entities: list[str]) -> Column:
    """The key that a feature is of, by its name's beginning (of several, the longest), time for time features, else other."""
    out = F.when(name.isin(*TIME_FEATURES), "time").otherwise("other")
    for e in sorted(entities, key=len):
        out = F.when(name.startswith(f"{e}_"), e).otherwise(out)
    return out


def contribution_direction(v: Column) -> Column:
    return F.when(v > 1e-12, "increase").when(v < -1e-12, "decrease").otherwise("neutral")
