"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. A temporary one stands in only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


_KEPT: list[str] = []
#: Lets Spark delete the shuffle files of a query as soon as it has ended.
_CLEAR = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: computed once, and its files outlive lost executors.

    The shuffles it took are deleted once it is written, so they and those of what follows don't fill the disk together.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAR, "false")
    spark.conf.set(_CLEAR, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAR, before)
    _KEPT.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(spark: SparkSession) -> None:
    """Deletes all that `keep` has written in this process, once results that read it are written."""
    for path in _KEPT:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _KEPT.clear()


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as make it no column of `df`."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
