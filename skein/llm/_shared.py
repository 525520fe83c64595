"""Scratch tables in the cluster's shared folder, and small plan helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session has a local one; a cluster must set it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.gettempdir() + "/skein-shared"
    return path.rstrip("/")


_recorders: list[list[str]] = []


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Add the paths of the scratch tables that are written meanwhile to ``paths``."""
    _recorders.append(paths)
    try:
        yield
    finally:
        _recorders.pop()


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Remove scratch tables that no plan reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _recorders:
        _recorders[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def released(*tables: DataFrame) -> None:
    """Remove written tables that no later step reads."""
    for t in tables:
        removed(t.sparkSession, [t._scratch])


def columns_as(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the two columns, as _id (long) and _text, whatever else the table holds."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))


def running_before(df: DataFrame, keys: list[str], bucket: str, order: list[str], weight: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over the earlier rows of the same keys, in order of (bucket, order).

    Sorts within (keys, bucket) only, so no key's rows meet in one task; buckets'
    totals are summed up by themselves.
    """
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, bucket).agg(F.sum(weight).alias("_total")).select(*keys, bucket, F.coalesce(F.sum("_total").over(outer), F.lit(0)).alias("_base"))
    own = df.withColumn("_inner", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
    return own.join(totals, [*keys, bucket]).withColumn(name, F.col("_base") + F.col("_inner")).drop("_base", "_inner")
