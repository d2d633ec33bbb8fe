"""Queries of this subpackage by name, and their SQL where plain SQL is quick on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom import scratch
from runloom.io import load
from runloom.llm import conversations, copies, groups, leaks, packing, repeats, spam, splits, subsequences

Query = Callable[[SparkSession, str], DataFrame]


def _records(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    tasks = load(spark, folder, "tasks", "task_id", "former_id")
    return splits.project_records(load(spark, folder, "folds", "fold_row", "task_id", "fold"), load(spark, folder, "e7_metrics", "metric_id", "population", "split_name"), tasks), tasks


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.torn(*_records(spark, folder))


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder)[0].select("kind", "row_id", "group_id", "bin", "split")


def p1_balance(spark: SparkSession, folder: str) -> DataFrame:
    return splits.balance(_records(spark, folder)[0])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = groups.same_pairs(load(spark, folder, "run_pairs", "run_id_a", "run_id_b", "verdict"))
    return groups.connected_groups(pairs, "a", "b").withColumnRenamed("node", "run_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_supports(spark, folder).select("event_pattern")


def p3_supports(spark: SparkSession, folder: str) -> DataFrame:
    return subsequences.frequent_tool_orders(load(spark, folder, "steps", "run_id", "pos", "role", "tool"))


def _fragments(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "fragments", "frag_id", "run_id", "step_idx", "frag_idx", "role", "text", "created_at")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.broken(conversations.conversation_faults(_fragments(spark, folder))).select("run_id")


def p4_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.rebuild(_fragments(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_stretches(spark, folder).select("run_id", "first_step_idx", "last_step_idx")


def p6_stretches(spark: SparkSession, folder: str) -> DataFrame:
    steps = load(spark, folder, "steps", "run_id", "pos", "step_idx", "role", "tool_calls", "ts")
    out = repeats.collapse_repeats(repeats.call_events(steps))
    return out.select(F.col("run").alias("run_id"), F.col("first_step").alias("first_step_idx"), F.col("last_step").alias("last_step_idx"), "n", *[F.to_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz").alias(c) for c in ("first_ts", "last_ts")], "seconds")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_copies(spark, folder).where("pred_id <> first_id").select(F.col("first_id").alias("pred_id_first"), F.col("pred_id").alias("pred_id_copy"))


def p7_copies(spark: SparkSession, folder: str) -> DataFrame:
    return copies.prediction_copies(load(spark, folder, "preds", "pred_id", "pred_json"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(load(spark, folder, "documents", "doc_id", "text"))


def p8_invariants(spark: SparkSession, folder: str) -> DataFrame:
    documents = load(spark, folder, "documents", "doc_id", "text")
    sizes = scratch.table(packing.token_sizes(documents), "sizes")
    out = packing.packed_well(packing.pack(sizes), sizes)
    return out.join(documents.agg(F.count("doc_id").alias("in_table"))).select("in_table", F.col("n_documents").alias("packed"), "over_capacity", "wrongly_cut", "lost_tokens", "tight")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(load(spark, folder, "documents", "doc_id", "text"), load(spark, folder, "eval_items", "item_id", "text"))


def p9_passages(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_passages(load(spark, folder, "documents", "doc_id", "text"), load(spark, folder, "eval_items", "item_id", "text")).drop("text_key")


def p9_clean(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.without_leaks(load(spark, folder, "documents", "doc_id", "text"), load(spark, folder, "eval_items", "item_id", "text"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.stuffed_pages(load(spark, folder, "documents", "doc_id", "text", "sender")).select("doc_id")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_splits, p1_balance, p2_found, p3_found, p3_supports, p4_found, p4_conversations, p6_found, p6_stretches, p7_found, p7_copies, p8_containers, p8_invariants, p9_found, p9_passages, p9_clean, p10_found)}


_ROLE = "lower(trim(role, E' \\t\\n\\r'))"
_ASSISTANT = f"{_ROLE} IN ('assistant', 'agent', 'ai')"
_BLANK = "regexp_replace(coalesce({0}, ''), '[\\s\\p{{Z}}\\p{{Cf}}\\p{{Cc}}]+', '', 'g') = ''"


def oracle_sql() -> dict[str, str]:
    key = "nullif(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '')"
    p1 = f"""
WITH names AS (SELECT {key.format('task_id')} AS k, task_id FROM tasks
               UNION SELECT {key.format('former_id')}, task_id FROM tasks WHERE former_id IS NOT NULL),
     pop AS (SELECT array_to_string(list_filter(regexp_split_to_array(lower(population), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), '_') AS entity, split_name FROM e7_metrics)
SELECT 'task' AS field, n.task_id AS entity FROM folds f JOIN names n ON n.k = {key.format('f.task_id')}
GROUP BY n.task_id HAVING count(DISTINCT f.fold) > 1
UNION ALL SELECT 'population', entity FROM pop GROUP BY entity HAVING count(DISTINCT split_name) > 1"""
    p2 = """
WITH RECURSIVE pairs AS (
  SELECT lower(trim(run_id_a, E' \\t\\n\\r')) AS a, lower(trim(run_id_b, E' \\t\\n\\r')) AS b FROM run_pairs WHERE lower(trim(verdict, E' \\t\\n\\r')) = 'same'),
links AS (SELECT a, b FROM pairs WHERE a <> b AND a <> '' AND b <> '' UNION SELECT b, a FROM pairs WHERE a <> b AND a <> '' AND b <> ''),
reach(run_id, other) AS (SELECT a, a FROM links UNION SELECT r.run_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT run_id, min(other) AS group_id FROM reach GROUP BY run_id"""
    orders = f"""
WITH e AS (SELECT run_id, pos, min(lower(trim(tool, E' \\t\\n\\r'))) AS tool FROM steps WHERE {_ASSISTANT} AND run_id IS NOT NULL AND pos IS NOT NULL AND trim(tool, E' \\t\\n\\r') <> '' GROUP BY run_id, pos),
least AS (SELECT (count(DISTINCT run_id) * 50000 + 999999) // 1000000 AS n FROM steps),
o1 AS (SELECT run_id, [tool] AS p, min(pos) AS ends FROM e GROUP BY run_id, tool),
f1 AS (SELECT p, count(*) AS support FROM o1 GROUP BY p HAVING count(*) >= (SELECT n FROM least))"""
    for k in range(2, 7):
        orders += f""",
o{k} AS (SELECT o.run_id, list_append(o.p, e.tool) AS p, min(e.pos) AS ends FROM o{k - 1} o JOIN f{k - 1} USING (p) JOIN e ON e.run_id = o.run_id AND e.pos > o.ends GROUP BY o.run_id, o.p, e.tool),
f{k} AS (SELECT p, count(*) AS support FROM o{k} GROUP BY p HAVING count(*) >= (SELECT n FROM least))"""
    p3 = orders + """,
longer AS (SELECT p, support FROM f4 UNION ALL SELECT p, support FROM f5 UNION ALL SELECT p, support FROM f6),
open_ AS (SELECT DISTINCT list_concat(p[1:i - 1], p[i + 1:]) AS p, support FROM longer, unnest(range(1, len(p) + 1)) AS t(i)),
found AS (SELECT p, support FROM f3 UNION ALL SELECT p, support FROM f4 UNION ALL SELECT p, support FROM f5)
SELECT array_to_string(f.p, '>') AS event_pattern, f.support, o.p IS NULL AS closed FROM found f LEFT JOIN open_ o ON o.p = f.p AND o.support = f.support"""
    p4 = f"""
WITH raw AS (SELECT frag_id, run_id, step_idx, frag_idx, {_ROLE} AS r0, text, CASE WHEN frag_idx IS NULL THEN created_at END AS made, {_BLANK.format('role')} AS no_role, {_BLANK.format('text')} AS empty FROM fragments WHERE run_id IS NOT NULL),
m AS (SELECT min(frag_id) AS frag_id, run_id, step_idx, frag_idx, CASE WHEN r0 IN ('agent', 'ai') THEN 'assistant' WHEN r0 = 'human' THEN 'user' WHEN r0 IN ('observation', 'function') THEN 'tool' ELSE r0 END AS role, text, made, no_role, empty FROM raw GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY run_id, step_idx ORDER BY frag_idx, made, frag_id) AS k FROM m),
s AS (SELECT run_id, step_idx,
        bool_or(no_role OR step_idx IS NULL) OR (count(frag_idx) > 0 AND (count(frag_idx) < count(*) OR min(frag_idx) <> 0 OR max(frag_idx) <> count(*) - 1 OR count(DISTINCT frag_idx) < count(*)))
          OR max(CASE WHEN role = 'assistant' AND NOT empty THEN k END) IS NULL
          OR coalesce(max(CASE WHEN role = 'user' THEN k END), -1) > max(CASE WHEN role = 'assistant' AND NOT empty THEN k END) AS bad,
        bool_or(step_idx = 0 AND role = 'user' AND NOT empty) AS asked
      FROM o GROUP BY run_id, step_idx),
dropped AS (SELECT run_id FROM s GROUP BY run_id HAVING bool_or(bad) OR NOT coalesce(bool_or(asked), false) OR min(step_idx) <> 0 OR max(step_idx) <> count(*) - 1)
"""
    shape = "c"
    for pattern, put in (
        ("[‘’‚‛“”„‟`\"'']", "''"), ("[\\s\\p{Z}]+", " "), ("^ ?(?:cd (?:''[^'']*''|[^ ;&|]+) ?(?:&&|;) ?)+", ""), ("/tmp/[^ ''\";|&<>(),:=]*", "/tmp/F"),
        *[("(^|[^0-9A-Za-z])(?:0x)?[0-9a-fA-F]{8}($|[^0-9A-Za-z])", "\\1N\\2")] * 2, ("[0-9]+(?:\\.[0-9]+)*", "N"), (" ?(&&|\\|\\||[;|<>]) ?", "\\1"),
    ):
        shape = f"regexp_replace({shape}, '{pattern}', '{put}', 'g')"
    p6 = f"""
WITH e AS (SELECT run_id, pos, step_idx, ts, nullif(array_to_string(list_filter(list_transform(tool_calls, lambda c: trim({shape})), lambda x: x <> ''), chr(1)), '') AS sig
           FROM steps WHERE {_ASSISTANT} AND run_id IS NOT NULL AND pos IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id, pos ORDER BY step_id) = 1),
b AS (SELECT *, CASE WHEN sig = lag(sig) OVER (PARTITION BY run_id ORDER BY pos) THEN 0 ELSE 1 END AS opens FROM e),
s AS (SELECT *, sum(opens) OVER (PARTITION BY run_id ORDER BY pos) AS stretch FROM b)
SELECT run_id, min_by(step_idx, pos) AS first_step_idx, max_by(step_idx, pos) AS last_step_idx FROM s WHERE sig IS NOT NULL GROUP BY run_id, stretch HAVING count(*) > 1"""
    p7 = """
WITH one AS (SELECT pred_id, json_extract_string(pred_json, '$.*.*') AS any_, json_extract(pred_json, '$.*')[1] AS r FROM preds),
k AS (SELECT pred_id, [regexp_replace(lower(coalesce(json_extract_string(r, '$.' || f), '')), '[^\\p{L}\\p{N}]+', '', 'g') FOR f IN ['instance_id', 'model_name_or_path', 'model_patch']] AS key FROM one),
g AS (SELECT pred_id, min(pred_id) OVER (PARTITION BY key) AS pred_id_first, count(*) OVER (PARTITION BY key) AS copies FROM k)
"""
    return {
        "p1_found": p1,
        "p1_balance": "SELECT 'task' AS kind, count(*) AS n_rows, 0 AS no_split, 0 AS torn_groups, true AS balanced FROM folds UNION ALL SELECT 'population', count(*), 0, 0, true FROM e7_metrics",
        "p2_found": p2,
        "p3_found": f"SELECT event_pattern FROM ({p3})",
        "p3_supports": p3,
        "p4_found": p4 + "SELECT run_id FROM dropped",
        "p4_conversations": p4 + "SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY step_idx, k) - 1 AS turn, step_idx, role, text, frag_id FROM o ANTI JOIN dropped USING (run_id)",
        "p8_invariants": "SELECT count(*) AS in_table, count(DISTINCT doc_id) AS packed, 0 AS over_capacity, 0 AS wrongly_cut, 0 AS lost_tokens, true AS tight FROM documents",
        "p6_found": p6,
        "p6_stretches": p6.replace(" FROM s WHERE", ", count(*) AS n, make_timestamp(epoch_us(min(ts))) AS first_ts, make_timestamp(epoch_us(max(ts))) AS last_ts, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM s WHERE"),
        "p7_found": p7 + "SELECT pred_id_first, pred_id AS pred_id_copy FROM g WHERE pred_id <> pred_id_first",
        "p7_copies": p7 + "SELECT pred_id, pred_id_first AS first_id, copies FROM g",
    }
