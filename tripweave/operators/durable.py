"""Cutting lineage with tables written to the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: intermediate tables are written once and read a few times, so they are packed tighter than by default
CODEC = "zstd"


def work_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A session that runs in one process may leave it unset; a temporary folder is then chosen and kept for the
    session. On a cluster that folder would differ from node to node, so a missing setting is an error there.
    """
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {_SETTING} to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(_SETTING, named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{work_folder(spark)}/tripweave-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate once and read it back.

    Later steps then start from columnar files: nothing upstream is recomputed
    when an executor is lost, and steps that read it twice do not repeat the work.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing will read again."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
