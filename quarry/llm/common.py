"""Shared helpers: table reading, whole-text columns, staged tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quarry.session import scratch_path, ship_package

# Rows per Arrow batch handed to Python. Texts average a few KB, so a batch is
# a few MB; one very long text only makes its own batch larger.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with at least two tasks per core.

    A small file is one split; its rows (not keys) are then dealt out evenly.
    Large inputs come in many splits and are not shuffled.
    """
    return dealt(table(spark, sf_dir, "documents"))


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out row by row if its scan has fewer tasks than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(2 * cores)
    return df


def whole_text(col: str | Column = "text") -> Column:
    """The text as it is; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def map_batches(df: DataFrame, run, schema: StructType) -> DataFrame:
    """``mapInArrow`` for any column names (it can't resolve names with dots)."""
    inner = StructType([StructField(f"c{i}", f.dataType, True) for i, f in enumerate(schema)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, inner.names)

    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(renamed, inner).toDF(*schema.names)


def cleared(df: DataFrame, outputs, inputs=()) -> DataFrame:
    """``df`` without columns that have an output's name: outputs replace them."""
    names = {n.lower() for n in outputs} - {n.lower() for n in inputs}
    return df.select(*[x for c, x in zip(df.columns, columns(df), strict=True)
                       if c.lower() not in names])


def python_ready(spark: SparkSession) -> None:
    """Before Python runs in tasks: ship the package, bound Arrow batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the cluster's checkpoint directory and read it back.

    Cuts the lineage with files every executor can read, so a lost executor
    costs only its running tasks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete written tables of ``staged`` that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def least_hashed(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` rows of ``df`` whose ``key`` has the least hashes.

    Only hashes below four times the wanted share of the range are sorted, so
    that the last task gets about ``4 * limit`` rows, however many tasks there
    are (a top-k alone would send it ``limit`` rows from each).
    """
    share = min(1.0, 4 * limit / max(1, df.count()))
    bound = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    hashed = df.withColumn("_hash", F.xxhash64(key)).where(F.col("_hash") <= bound)
    return hashed.orderBy("_hash", key).limit(limit).drop("_hash")


def collapse_space(col: Column) -> Column:
    """Lower-cased text with runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(col), r"\s+", " "))
