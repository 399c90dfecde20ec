"""Intermediate tables in the folder that all executors share: they cut the lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset: in local mode, as in tests, a new folder in /tmp; on a cluster, ValueError."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written as a table in the shared folder, with a folder for each value of the columns ``by``, and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _file_system(spark, path)
    return system.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder."""
    system, where = _file_system(spark, path)
    return [str(f.getPath().toString()) for f in system.listStatus(where)]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    system, where = _file_system(spark, path)
    system.delete(where, True)


def forget(df: DataFrame) -> None:
    """Delete the table that ``written`` made for ``df``."""
    delete(df.sparkSession, df.written_path)


def numbered(df: DataFrame, *order: str, name: str = "row") -> DataFrame:
    """``df`` with ``name``, 1 and on in order of the columns: rows are dealt into ranges, numbered within each, and moved on by the ranges before."""
    ranged = written(df.repartitionByRange(*(F.col(c).asc_nulls_first() for c in order)).withColumn("_range", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = ranged.groupBy("_range").count().select(F.col("_range").alias("_r"), before.alias("_before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*(F.col(c).asc_nulls_first() for c in order)))
    return ranged.withColumn("_own", own).join(F.broadcast(sizes), F.col("_range") == F.col("_r")).withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_r", "_own", "_before")
