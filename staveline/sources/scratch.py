"""Intermediate tables that outlive lost executors.

Iterative operators cut their lineage by writing Parquet into the folder that
``spark.checkpoint.dir`` names. Where the setting is absent, a session in one
process (tests, notebooks) uses one temporary folder; on a cluster, where other
machines would not see that folder, it is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, without a trailing slash."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="staveline-")
    return _OWN[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch root."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", files: int | None = None) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written copy.

    ``files`` bounds the number of files, for tables known to be small.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df if files is None else df.coalesce(files)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a DataFrame made by ``materialize``; anything else is left alone."""
    path = getattr(df, "_scratch_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
