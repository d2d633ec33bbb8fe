"""The engine's functions for SQL: register(spark) adds them to a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from runloom.functions import commands, text


def register(spark: SparkSession) -> list[str]:
    """SQL functions clean_nl, norm_command, call_hash, parse_number as JVM expressions; parse_outcome and segment as
    Arrow UDFs; classify_command as a table function from a command to its events. Gives their names."""
    for name, make in (("norm_command", text.norm_command), ("call_hash", text.call_hash), ("clean_nl", text.clean_prose), ("parse_number", text.parse_number)):
        body = spark.range(1).select(F.lit("@@").alias("x")).select(make(F.col("x")).alias("v"))
        # a SQL function whose body is the column's own SQL text
        sql = body._jdf.queryExecution().analyzed().expressions().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURN {sql.replace('`x`', 'x')}")

    def outcome(out: pd.Series, runner: pd.Series) -> pd.Series:
        return pd.Series([commands.outcome(a, b or "") for a, b in zip(out, runner)])

    def segment(s: pd.Series) -> pd.Series:
        return s.map(text.fragments_text)

    spark.udf.register("parse_outcome", F.pandas_udf(outcome, "string"))
    spark.udf.register("segment", F.pandas_udf(segment, "array<struct<kind:string,text:string>>"))

    @udtf(returnType="ev_idx int, kind string, target string, runner string")
    class ClassifyCommand:
        def eval(self, command: str) -> Iterator[tuple]:
            for i, e in enumerate(commands.events(command or "", {})):
                yield (i, *e)

    spark.udtf.register("classify_command", ClassifyCommand)
    return ["norm_command", "call_hash", "clean_nl", "parse_number", "parse_outcome", "segment", "classify_command"]
