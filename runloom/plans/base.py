"""The scored runs that ranking queries share: one row per labelled run with its features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.io import load

ASSISTANT = ("assistant", "agent", "ai")


def role(c: str = "role"):
    r = F.lower(F.trim(c))
    return F.when(r.isin(*ASSISTANT), "assistant").when(r.isin("tool", "observation", "function"), "tool").when(r == "human", "user").otherwise(r)


def once(steps: DataFrame) -> DataFrame:
    """Steps without second deliveries: the row with the least step_id of each place."""
    cols = [c for c in steps.columns if c not in ("run_id", "pos")]
    return steps.groupBy("run_id", "pos").agg(F.min_by(F.struct(*cols), "step_id").alias("r")).select("run_id", "pos", "r.*")


def run_features(spark: SparkSession, d: str) -> DataFrame:
    s = once(load(spark, d, "steps", "step_id", "run_id", "pos", "role", "tool", "error"))
    a = role() == "assistant"
    return s.groupBy("run_id").agg(F.count_if(a).alias("n_steps"), F.count_if("error").alias("n_err"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.when(a, F.lower(F.trim("tool")))).alias("n_tools"))


def scored(spark: SparkSession, d: str, merge: bool = False) -> DataFrame:
    """merge: runs are sorted to their features and never broadcast. Without it they are as long as the columns read take
    less of the file than the broadcast limit, and the driver then holds several times that for each use in a plan."""
    runs = load(spark, d, "runs", "run_id", "task_id", "agent_id", "model_id", "model_family", "source", "label", "submitted").where("label is not null")
    major = F.regexp_extract("agent_id", r"-(\d+)\.", 1)
    j = (runs.hint("merge") if merge else runs).join(run_features(spark, d), "run_id")
    fold = F.conv(F.substring(F.md5("task_id"), 1, 8), 16, 10).cast("long") % 5
    return j.select("run_id", "task_id", F.split("task_id", "__")[0].alias("owner"), F.concat_ws("|", "model_id", major).alias("combo"), "model_family", "source", F.col("label").alias("y"), F.coalesce("submitted", F.lit(0)).alias("finished"), "n_steps", "n_err", "n_rows", "n_tools", (F.col("n_err") / F.col("n_rows")).alias("score"), fold.cast("int").alias("fold"))


ROLE_SQL = "CASE WHEN lower(trim(role)) IN ('assistant','agent','ai') THEN 'assistant' WHEN lower(trim(role)) IN ('tool','observation','function') THEN 'tool' WHEN lower(trim(role)) = 'human' THEN 'user' ELSE lower(trim(role)) END"
ONCE_SQL = f"once AS (SELECT run_id, pos, step_id, step_idx, task_id, {ROLE_SQL} AS role, lower(trim(tool)) AS tool, tool_calls, text, error, ts FROM steps QUALIFY row_number() OVER (PARTITION BY run_id, pos ORDER BY step_id) = 1)"
SCORED_SQL = f"""{ONCE_SQL},
f AS (SELECT run_id, count(*) FILTER (role = 'assistant') AS n_steps, count(*) FILTER (error) AS n_err, count(*) AS n_rows, count(DISTINCT tool) FILTER (role = 'assistant') AS n_tools FROM once GROUP BY run_id),
d AS (SELECT r.run_id, r.task_id, split_part(r.task_id, '__', 1) AS owner, concat_ws('|', model_id, regexp_extract(agent_id, '-(\\d+)\\.', 1)) AS combo, model_family, source, label AS y,
      coalesce(submitted, 0) AS finished, n_steps, n_err, n_rows, n_tools, n_err / n_rows AS score, ('0x' || substr(md5(r.task_id), 1, 8))::BIGINT % 5 AS fold
      FROM runs r JOIN f USING (run_id) WHERE label IS NOT NULL)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded at the sink; nothing else changes."""
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
