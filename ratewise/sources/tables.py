"""CSV sources with every column as text, and sinks for small tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own under spark.checkpoint.dir, which driver and executors share; on a local master without that setting, under a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="shared-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, wherever Spark can reach it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet to a new folder and read back: what is read several times is computed once."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_events_csv(spark: SparkSession, path: str, columns: list[str], null_values: tuple[str, ...] = ("",)) -> DataFrame:
    """Headed CSV, every column a string, so that no dirty value stops the read; null_values become null."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return raw.select(*[F.when(~F.col(c).isin(*null_values), F.col(c)).alias(c) for c in columns])


def write_table_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A small result as one headed CSV file, columns in the given order."""
    out = df.select(*columns).coalesce(1).write.mode("overwrite").option("header", True)
    out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_by_date(df: DataFrame, path: str, date: str) -> None:
    """Parquet in one folder for each date; rows of a date are spread over tasks, a hot date over many."""
    df.hint("rebalance", date).write.mode("overwrite").partitionBy(date).parquet(path)


def read_events(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet with only the columns asked for; the scan reads no others."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_many(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    """One table over several datasets, columns matched by name; an error without any."""
    if not paths:
        raise ValueError("no dataset given")
    return reduce(lambda a, b: a.unionByName(b), [read_events(spark, p, columns) for p in paths])


def query_to_csv(spark: SparkSession, sql: str, path: str, args: dict | list | None = None) -> None:
    """The small result of a query as one headed CSV file."""
    out = spark.sql(sql, args=args)
    write_table_csv(out, path, out.columns)


def write_report_json(df: DataFrame, path: str) -> None:
    """A report of a few rows, nested columns included, as JSON lines in one file."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def table_stats(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """table, n_rows, files, columns of each Parquet dataset; counts come from the files' footers."""
    out = None
    for name, path in paths.items():
        df = spark.read.parquet(path)
        row = df.agg(F.lit(name).alias("table"), F.count("*").alias("n_rows"), F.lit(len(df.inputFiles())).cast("bigint").alias("files"), F.lit(len(df.columns)).cast("bigint").alias("columns"))
        out = row if out is None else out.unionByName(row)
    return out


def head_sample(df: DataFrame, n: int = 100_000) -> DataFrame:
    """The first n rows, for a profile."""
    return df.limit(n)


def save_predictions(df: DataFrame, path: str, score: str = "score", columns: tuple[str, ...] = ("id", "click", "date")) -> None:
    """id, label, date and probability of each scored row."""
    df.select(*columns, F.col(score).alias("probability")).write.mode("overwrite").parquet(path)
