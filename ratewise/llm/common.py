"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a class of a Java or RE2 pattern.
SPACE = r"[\x20\x09-\x0D]+"
#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset on a local master, as in tests, a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch while data is staged: whole texts lie in them, in the JVM's memory and the worker's.
BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def staged(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged tables of one computation, deleted once what was computed from them is staged itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def staged(self, df: DataFrame, label: str) -> DataFrame:
        self.paths.append(new_path(self.spark, label))
        return staged(df, label, self.paths[-1])

    def clear(self) -> None:
        """Delete their folders; no DataFrame that reads them may be used from here on."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in self.paths:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
        self.paths = []


def in_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """df.mapInArrow; at the end of a task its worker, which Spark uses again, hands back the memory that Arrow no longer needs."""

    def task(batches):
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(task, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """A-Z only; every other letter stays."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def group_key(c: Column) -> Column:
    """A string without nulls that tells null from every value, for joins and windows on a nullable key."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string")))


def seeded_unit(seed: int, *cols: Column) -> Column:
    """A repeatable number in [0, 1) for a row."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)).cast("double") * F.lit(2.0**-53)
