"""SQL over registered tables."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Comments, and the text between semicolons; quotes and comments may hold one.
_COMMENT = r"--[^\n]*|/\*(?:[^*]|\*(?!/))*\*/"
_STATEMENT = re.compile(rf"(?:'[^']*'|\"[^\"]*\"|`[^`]*`|{_COMMENT}|[^;])+")


def register_events(df: DataFrame, view: str) -> DataFrame:
    """df as a view ready for SQL: times as `yyyy-MM-dd HH:mm:ss` text (null stays null), booleans as 0 or 1 (null as 0), other columns as they are."""
    out = []
    for name, kind in df.dtypes:
        c = df[name]
        out.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name) if kind.startswith("timestamp") else F.coalesce(c, F.lit(False)).cast("int").alias(name) if kind == "boolean" else c)
    ready = df.select(*out)
    ready.createOrReplaceTempView(view)
    return ready


def run_sql(spark: SparkSession, sql: str, args: dict | list | None = None) -> DataFrame:
    """A SELECT with its named or positional arguments."""
    return spark.sql(sql, args=args)


def run_sql_file(spark: SparkSession, path: str) -> list[DataFrame]:
    """A DataFrame for each statement of a file."""
    parts = _STATEMENT.findall(Path(path).read_text(encoding="utf-8"))
    return [spark.sql(p) for p in parts if re.sub(_COMMENT, "", p).strip()]


def table_names(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def table_columns(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    """(column, type) in order; an unknown table is an error."""
    _known(spark, name)
    return spark.table(name).dtypes


def row_count(spark: SparkSession, name: str) -> int:
    _known(spark, name)
    return spark.table(name).count()


def _known(spark: SparkSession, name: str) -> None:
    if not spark.catalog.tableExists(name):
        raise ValueError(f"no table {name}")
