"""Cutting lineage: intermediate tables in the folder that all executors share.

The folder is the session's checkpoint folder (``spark.checkpoint.dir``). Only a local session without one gets its own
temporary folder, as in tests; a cluster session without one is refused, as its executors would not share a local disk.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if found := sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not (sc.master.startswith("local[") or sc.master == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="runloom-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir("file://" + own)
    return sc.getCheckpointDir().rstrip("/")


def counted(df: DataFrame, of: Column, label: str = "t") -> tuple[DataFrame, int]:
    """table(), and the value of an aggregate of what was written.

    A second, small job: an Observation would save it, but once a session has made one, plans with models can't be sent.
    """
    out = table(df, label)
    return out, out.agg(of.alias("n")).first()["n"] or 0


def table(df: DataFrame, label: str = "t", files: int | None = None) -> DataFrame:
    """Write df once as Parquet to the shared folder and read it back: a fixed result without lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/runloom-{label}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._runloom_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables made by table() that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_runloom_path", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
