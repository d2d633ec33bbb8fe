"""Readers and sinks with fixed schemas: JSON lines, logs where the last answer wins, guarded scans, part-wise sinks."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, schema: str, partitions: int | None = None) -> DataFrame:
    """JSON lines with a fixed schema. Gzip can't be split, so what reads it may be spread again."""
    df = spark.read.schema(schema).json(path)
    return df.repartition(partitions) if partitions else df


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, compression="gzip")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def guarded(df: DataFrame, allowed: list[str]) -> DataFrame:
    """Only the allowed columns, pruned at the scan, so that nothing else can leak into features."""
    missing = [c for c in allowed if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*allowed)


def last_answers(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key of an append-only log; order must end in a unique column."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def replace_parts(df: DataFrame, path: str, part: str) -> None:
    """Overwrite only the parts that df holds; other parts of the table stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def pattern_list(lines: list[str]) -> list[str]:
    """Patterns of a text file: blank lines and comments left out."""
    return [x.strip() for x in lines if x.strip() and not x.lstrip().startswith("#")]


def vector_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, label, task_id, t, vector) of .npy files named <label>_<task>_ts.npy, one row a time step."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, body in zip(b["path"], b["content"]):
                m = re.search(r"([^/_]+)_([^/]+)_ts\.npy$", path)
                matrix = np.load(io.BytesIO(body), allow_pickle=False)
                if m and matrix.ndim == 2:
                    yield pd.DataFrame({"path": path, "label": m[1], "task_id": m[2], "t": range(len(matrix)), "vector": list(matrix.astype("float32"))})

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(load, "path string, label string, task_id string, t int, vector array<float>")
