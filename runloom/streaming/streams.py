"""Streaming twins of batch operators: file sources, watermarks, keyed state. Results land in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runloom import scratch


def source(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table of a folder as a file stream; times without a zone are read as the session's."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    df = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{table}.parquet*")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def drain(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Run a stream over all that is there and give its result table; in complete mode the last state of the result."""
    spark = stream.sparkSession
    path = f"{scratch.shared_dir(spark)}/runloom-stream-{label}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", path + "-log").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", path).start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, i: df.write.mode("overwrite" if mode == "complete" else "append").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def tumbling_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) in windows of event time; rows later than the watermark are dropped by the engine."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return s.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_deliveries(events: DataFrame, keys: list[str], ts: str, late: str = "30 days") -> DataFrame:
    """Each key once, whatever is delivered again within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def keyed_progress(events: DataFrame, key: str, order: str, kind: str, mark: str, check: str) -> DataFrame:
    """(key, n_mark, n_check, checks_after_mark) as keyed state: marks and checks so far, checks since the last mark."""
    name, numeric = key, dict(events.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        marks, checks, after = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(order)
        for x in rows[kind]:
            if x == mark:
                marks, after = marks + 1, 0
            elif x == check:
                checks, after = checks + 1, after + 1
        state.update((marks, checks, after))
        yield pd.DataFrame({name: [k[0]], "n_mark": [marks], "n_check": [checks], "checks_after_mark": [after]})

    out = f"{key} {numeric}, n_mark long, n_check long, checks_after_mark long"
    return events.groupBy(key).applyInPandasWithState(step, out, "marks long, checks long, after long", "update", GroupStateTimeout.NoTimeout)
