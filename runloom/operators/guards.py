"""Assertions over results, and flat views of nested settings."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators import shred


def pinned(df: DataFrame, key: str, value: str, expected: dict[str, float], digits: int = 3) -> DataFrame:
    """(key, value, expected, holds): rounded values against pinned ones; a pinned key that is missing does not hold."""
    want = df.sparkSession.createDataFrame(sorted(expected.items()), f"{key} string, expected double")
    j = want.join(df.select(key, value), key, "left")
    return j.select(key, value, "expected", F.coalesce(F.round(value, digits) == F.round("expected", digits), F.lit(False)).alias("holds"))


def enforce(checks: DataFrame, key: str) -> DataFrame:
    """The checks unchanged; reading a row that does not hold fails the query."""
    said = F.concat(F.lit("pinned value not reproduced: "), F.col(key))
    return checks.withColumn("holds", F.when(~F.col("holds"), F.raise_error(said).cast("boolean")).otherwise(F.col("holds")))


SECRET = r"(?i)(?:key|token|secret|password)$"


def flat_settings(df: DataFrame, record_id: str, body: str) -> DataFrame:
    """(record_id, path, value): dotted paths of the scalars of nested records; values of secret names are masked.

    Paths grow along each record's walk, to any depth that can be read; list places count from 0.
    """

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(20_000)
        for batch in batches:
            rows = []
            for rid, text in zip(batch["record_id"], batch["body"]):
                if text is None or (value := shred.read_value(text)) is None:
                    continue
                above: dict[int, str] = {}
                for node, parent, label, ord_, kind, scalar, _ in shred.walk(value):
                    name = "" if parent < 0 else str(ord_) if label is None else label
                    path = f"{above[parent]}.{name}" if above.get(parent) else name
                    if kind in ("object", "array"):
                        above[node] = path
                    else:
                        rows.append((rid, path, scalar))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=["record_id", "path", "scalar"])
                    rows = []
            yield pd.DataFrame(rows, columns=["record_id", "path", "scalar"])

    bodies = df.select(F.col(record_id).cast("long").alias("record_id"), F.col(body).cast("string").alias("body")).where("record_id is not null")
    out = bodies.mapInPandas(paths, "record_id long, path string, scalar string")
    return out.select("record_id", "path", F.when(F.col("path").rlike(SECRET), "***").otherwise(F.col("scalar")).alias("value"))
