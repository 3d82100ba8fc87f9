"""Cleaning of raw text columns, with what was coerced counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Without the white space at both ends, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def safe_int(c: Column, kind: str) -> Column:
    """A whole number that fits kind (tinyint, smallint, int), else null; '1.0' counts as 1."""
    number = trimmed(c).try_cast("double")
    return F.when(number == F.floor(number), number.cast("bigint").try_cast(kind))


def coercion_failures(raw: Column, parsed: Column) -> Column:
    """Non-blank values that became null."""
    return F.count_if(raw.isNotNull() & (trimmed(raw) != "") & parsed.isNull())


def parse_hour(c: Column) -> Column:
    """yyMMddHH text to a time; null where it is none."""
    return F.try_to_timestamp(F.concat(F.lit("20"), trimmed(c)), F.lit("yyyyMMddHH")).cast("timestamp_ntz")


def flag_duplicates(df: DataFrame, key: list[str], name: str = "is_dup") -> DataFrame:
    """True for every member of a repeated key. Counts are joined back, so that a hot key is no window partition."""
    counts = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in key]).agg((F.count("*") > 1).alias(name))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key]
    return df.join(counts, on, "left").drop(*[f"_k_{k}" for k in key])


def label_distribution(df: DataFrame, label: str = "click") -> DataFrame:
    value = F.when(F.col(label).isNull(), "null").when(F.col(label).isin(0, 1), F.col(label).cast("string")).otherwise("other")
    return df.groupBy(value.alias("label")).agg(F.count("*").alias("rows"))


def profile(df: DataFrame, label: str, id_col: str, ts: str) -> DataFrame:
    """One row: rows, extra copies of ids, first and last time, null labels, rate of labelled rows."""
    return df.agg(
        F.count("*").alias("n_rows"), (F.count(id_col) - F.count_distinct(id_col)).alias("extra_ids"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.count_if(F.col(label).isNull()).alias("null_labels"), F.avg(label).alias("sample_rate"))


def flag_invalid_label(raw: Column, parsed: Column) -> Column:
    """True where a label is not blank but did not parse, or is neither 0 nor 1."""
    blank = raw.isNull() | (trimmed(raw) == "")
    return F.coalesce((~blank & parsed.isNull()) | (parsed.isNotNull() & ~parsed.isin(0, 1)), F.lit(False))


def quarantine(df: DataFrame, flag: Column, path: str, raw: dict[str, str] | None = None) -> DataFrame:
    """Write the flagged rows, with the raw text of columns (clean: raw column) beside the parsed values, and return the others."""
    marked = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    marked.filter("_flag").drop("_flag").withColumnsRenamed({r: f"{c}_raw" for c, r in (raw or {}).items()}).write.mode("overwrite").parquet(path)
    return marked.filter("not _flag").drop("_flag", *(raw or {}).values())


def profile_columns(df: DataFrame) -> DataFrame:
    """column, data_type, nulls of every column, most nulls first; one pass."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("data_type"), F.col(f"n{i}").alias("nulls")) for i, (c, t) in enumerate(df.dtypes)])
    return one.select(F.inline(rows)).orderBy(F.desc("nulls"), "column")


def compare_schemas(spark: SparkSession, a: list[str], b: list[str], exclude: tuple[str, ...] = ()) -> DataFrame:
    """side, column: columns that only one of two tables has."""
    rows = [("a", c) for c in sorted(set(a) - set(b) - set(exclude))] + [("b", c) for c in sorted(set(b) - set(a) - set(exclude))]
    return spark.createDataFrame(rows, "side string, column string")


def cleaning_report(raw: DataFrame, kinds: dict[str, str], hour: str, id_col: str, label: str | None = None) -> DataFrame:
    """(measure, column, n) of a raw text table in one pass.

    rows, bad hours and extra ids; for each column nulls and blanks; for each typed column the values lost to its kind, split
    into those that are no whole number (unparsed) and those outside of its range (out_of_range); with label: its
    distribution (label_0, label_1, label_null, label_other) and the rows to be quarantined.
    """
    cells = [("rows", None, F.count("*")), ("bad_hour", hour, coercion_failures(F.col(hour), parse_hour(F.col(hour)))), ("extra_ids", id_col, F.count(id_col) - F.count_distinct(id_col))]
    for c in raw.columns:
        cells += [("nulls", c, F.count_if(F.col(c).isNull())), ("blanks", c, F.count_if(trimmed(F.col(c)) == ""))]
    for c, kind in kinds.items():
        lost, whole = coercion_failures(F.col(c), safe_int(F.col(c), kind)), coercion_failures(F.col(c), safe_int(F.col(c), "bigint"))
        cells += [("lost", c, lost), ("unparsed", c, whole), ("out_of_range", c, lost - whole)]
    if label:
        y = safe_int(F.col(label), kinds.get(label, "tinyint"))
        cells += [("label_0", label, F.count_if(y == 0)), ("label_1", label, F.count_if(y == 1)), ("label_null", label, F.count_if(y.isNull())), ("label_other", label, F.count_if(~y.isin(0, 1))), ("quarantined", label, F.count_if(flag_invalid_label(F.col(label), y)))]
    one = raw.agg(*[n.alias(f"n{i}") for i, (_, _, n) in enumerate(cells)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(c).cast("string").alias("column"), F.col(f"n{i}").alias("n")) for i, (m, c, _) in enumerate(cells)])))
