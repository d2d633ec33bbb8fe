"""Projections, joins, aggregates, sets and orders over the star schema and the runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from runloom.io import load
from runloom.operators import relational as R
from runloom.plans.base import rounded


def _q(make, sql):
    return (lambda spark, d: rounded(make(lambda name, *cols: load(spark, d, name, *cols)))), sql


def _difficulty(t):
    o = t("orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return R.leave_one_out(o, "y", "o_custkey", "o_orderpriority").select("o_orderkey", "difficulty")


def _noise(t):
    p = t("preds", "pred_id", "submission", "pred_json").withColumn("h", F.sha1("pred_json"))
    task = F.map_keys(F.from_json("pred_json", "map<string,string>"))[0]
    r = t("runs", "run_id", "task_id", "label").where("label is not null").groupBy("task_id").agg(F.max("label").alias("y"))
    u = p.withColumn("task_id", task).join(r, "task_id")
    return R.identical_noise(u.withColumn("f", (F.col("pred_id") % 3 == 0).cast("int")), "task_id", "submission", "f")


def _patch_noise(t):
    """Answers carry no run: their label is that of the runs of the same task and model, where those agree."""
    whole = F.from_json("pred_json", "map<string,map<string,string>>")
    p = t("preds", "pred_json").select(F.map_keys(whole)[0].alias("task_id"), F.map_values(whole)[0].alias("a")).select("task_id", F.col("a")["model_name_or_path"].alias("model_id"), F.col("a")["model_patch"].alias("patch"))
    r = t("runs", "task_id", "model_id", "label").where("label is not null").groupBy("task_id", "model_id").agg(F.min("label").alias("y"), F.max("label").alias("hi")).where("y = hi").drop("hi")
    return R.patch_noise(p.join(r, ["task_id", "model_id"], "left"), "task_id", "patch", "y")


QUERIES = {
    "population_filter": _q(lambda t: t("runs", "run_id", "task_id", "agent_id", "model_id", "submitted").where("submitted = 1 and task_id not like 'quillbox%'").select("run_id", F.regexp_extract("task_id", r"^(.*)-\d+$", 1).alias("repo"), F.concat_ws("|", "model_id", F.regexp_extract("agent_id", r"-(\d+)\.", 1)).alias("combo"), F.regexp_replace("model_id", "-high$", "").alias("base_model"), F.element_at(F.split("task_id", "-"), -1).cast("int").alias("number")), "SELECT run_id, regexp_extract(task_id, '^(.*)-\\d+$', 1) AS repo, concat_ws('|', model_id, regexp_extract(agent_id, '-(\\d+)\\.', 1)) AS combo, regexp_replace(model_id, '-high$', '') AS base_model, regexp_extract(task_id, '(\\d+)$', 1)::INTEGER AS number FROM runs WHERE submitted = 1 AND task_id NOT LIKE 'quillbox%'"),
    "finished_flag": _q(lambda t: R.finished(t("steps", "step_id", "run_id", "pos", "role", "text", "tool_calls")), "WITH l AS (SELECT run_id, role, text, tool_calls FROM steps QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY pos DESC, step_id) = 1) SELECT run_id, (lower(trim(role)) IN ('assistant','agent','ai') AND coalesce(trim(text), '') <> '' AND coalesce(len(tool_calls), 0) = 0)::INTEGER AS finished FROM l"),
    "usable_columns": _q(lambda t: R.usable_columns(t("runs", "source", "label", "submitted", "model_family", "exit_status"), "source"), "WITH l AS (" + " UNION ALL ".join(f"SELECT source, '{c}' AS column_name, {c}::VARCHAR AS v FROM runs" for c in ("label", "submitted", "model_family", "exit_status")) + ") SELECT source, column_name, count(v) AS present, (count(DISTINCT v) > 1) AS usable FROM l GROUP BY source, column_name"),
    "complete_cases": _q(lambda t: t("runs", "run_id", "label", "model_family", "exit_status").dropna(), "SELECT run_id, label, model_family, exit_status FROM runs WHERE run_id IS NOT NULL AND label IS NOT NULL AND model_family IS NOT NULL AND exit_status IS NOT NULL"),
    "firing_shares": _q(lambda t: R.firing(t("lineitem", "l_discount", "l_tax", "l_quantity"), {"l_discount": 0.0, "l_tax": 0.0, "l_quantity": 1.0}, 0.05), " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(({c} <> {v})::INT), 6) AS share, avg(({c} <> {v})::INT) >= 0.05 AS kept FROM lineitem" for c, v in (("l_discount", 0.0), ("l_tax", 0.0), ("l_quantity", 1.0)))),
    "acceptance_gate": _q(
        lambda t: R.acceptance(t("runs", "task_id", "label"), "task_id", "label", 20, 200),
        "WITH g AS (SELECT task_id, count(*) AS n, min(label) AS lo, max(label) AS hi FROM runs WHERE label IS NOT NULL GROUP BY task_id) SELECT count(*) FILTER (lo < hi) AS both_class, sum(n)::BIGINT AS n, count(*) FILTER (lo < hi) >= 20 AND sum(n) >= 200 AS accepted FROM g",
    ),
    "median_gate": _q(lambda t: R.median_gate(t("steps", "run_id", "step_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("n")), "n"), "WITH g AS (SELECT count(*) AS n FROM steps GROUP BY run_id), m AS (SELECT quantile_cont(n, 0.5) AS median FROM g) SELECT round(median, 6) AS median, CASE WHEN median >= 200 THEN '200,4' WHEN median >= 100 THEN '100,4' WHEN median >= 50 THEN '50,3 biased' ELSE 'untested' END AS decision FROM m"),
    "clip_logit": _q(lambda t: t("lineitem", "l_orderkey", "l_linenumber", "l_discount").select("l_orderkey", "l_linenumber", R.logit(F.col("l_discount") * 5).alias("logit"), F.log1p("l_discount").alias("log1p")), "SELECT l_orderkey, l_linenumber, round(ln(greatest(0.001, least(0.999, l_discount * 5)) / (1 - greatest(0.001, least(0.999, l_discount * 5)))), 6) AS logit, round(ln(1 + l_discount), 6) AS log1p FROM lineitem"),
    "left_join_checked": _q(lambda t: R.left_lookup(t("customer", "c_custkey", "c_nationkey", "c_acctbal"), t("nation"), "c_nationkey", "n_nationkey").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance")), "SELECT n_name, count(*) AS n, round(sum(c_acctbal::DECIMAL(18,2))::DOUBLE, 6) AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    "composite_key_join": _q(lambda t: t("fragments", "run_id", "step_idx", "frag_id").groupBy("run_id", "step_idx").agg(F.count(F.lit(1)).alias("frags")).join(t("steps", "run_id", "step_idx", "step_id").groupBy("run_id", "step_idx").agg(F.count(F.lit(1)).alias("rows")), ["run_id", "step_idx"]), "SELECT * FROM (SELECT run_id, step_idx, count(*) AS frags FROM fragments GROUP BY ALL) JOIN (SELECT run_id, step_idx, count(*) AS rows FROM steps GROUP BY ALL) USING (run_id, step_idx)"),
    "semi_anti": _q(
        lambda t: t("customer", "c_custkey").join(t("orders", "o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.count(F.lit(1)).alias("without")).join(t("customer", "c_custkey").join(t("orders", "o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").agg(F.count(F.lit(1)).alias("with_orders"))),
        "SELECT (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS without, (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS with_orders",
    ),
    "coverage_both_ways": _q(lambda t: R.coverage(t("runs", "run_id"), t("steps", "run_id"), "run_id"), "SELECT 'left only' AS side, count(*) AS n FROM (SELECT DISTINCT run_id FROM runs EXCEPT SELECT DISTINCT run_id FROM steps) UNION ALL SELECT 'right only', count(*) FROM (SELECT DISTINCT run_id FROM steps EXCEPT SELECT DISTINCT run_id FROM runs)"),
    "stack_corpora": _q(lambda t: t("runs", "run_id", "task_id", "label").withColumn("corpus", F.lit("runs")).unionByName(t("reports", "run_id", "task_id").withColumn("corpus", F.lit("reports")), allowMissingColumns=True).groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.count_distinct("task_id").alias("tasks")), "SELECT 'runs' AS corpus, count(*) AS n, count(label) AS labelled, count(DISTINCT task_id) AS tasks FROM runs UNION ALL SELECT 'reports', count(*), 0, count(DISTINCT task_id) FROM reports"),
    "difficulty_leave_one_out": _q(_difficulty, "WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority, (o_orderstatus = 'F')::INT AS y FROM orders), w AS (SELECT o_orderkey, sum(y) OVER a - sum(y) OVER b AS s, count(*) OVER a - count(*) OVER b AS n, avg(y) OVER () AS m FROM o WINDOW a AS (PARTITION BY o_custkey), b AS (PARTITION BY o_custkey, o_orderpriority)) SELECT o_orderkey, round(CASE WHEN n > 0 THEN s / n ELSE m END, 6) AS difficulty FROM w"),
    "scope_rollup": _q(lambda t: t("orders", "o_orderstatus", "o_orderpriority", "o_totalprice").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")), "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE, 6) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "contingency_table": _q(lambda t: t("lineitem", "l_returnflag", "l_linestatus").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("l_returnflag"))), "SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS share FROM lineitem GROUP BY 1, 2"),
    "pivot_outcome": _q(lambda t: t("runs", "model_family", "label").fillna({"model_family": "none"}).groupBy("model_family").pivot("label", [0, 1]).agg(F.count(F.lit(1))).fillna(0).withColumnsRenamed({"0": "solved", "1": "failed"}), "SELECT coalesce(model_family, 'none') AS model_family, count(*) FILTER (label = 0) AS solved, count(*) FILTER (label = 1) AS failed FROM runs GROUP BY 1"),
    "exact_percentiles": _q(lambda t: t("lineitem", "l_returnflag", "l_extendedprice").groupBy("l_returnflag").agg(F.min("l_extendedprice").alias("p0"), F.percentile("l_extendedprice", [0.25, 0.5, 0.75, 0.9]).alias("p"), F.max("l_extendedprice").alias("p100")).select("l_returnflag", "p0", *[F.col("p")[i].alias(f"p{q}") for i, q in enumerate((25, 50, 75, 90))], "p100"), "SELECT l_returnflag, round(min(l_extendedprice), 6) AS p0, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q / 100}), 6) AS p{q}" for q in (25, 50, 75, 90)) + ", round(max(l_extendedprice), 6) AS p100 FROM lineitem GROUP BY 1"),
    "conditional_shares": _q(lambda t: t("lineitem", "l_linestatus", "l_returnflag", "l_discount", "l_quantity").groupBy("l_linestatus").agg(F.avg((F.col("l_returnflag") == "R").cast("int")).alias("returned"), F.avg(F.when(F.col("l_quantity") > 25, (F.col("l_discount") > 0.05).cast("int"))).alias("discounted_large")), "SELECT l_linestatus, round(avg((l_returnflag = 'R')::INT), 6) AS returned, round(avg((l_discount > 0.05)::INT) FILTER (l_quantity > 25), 6) AS discounted_large FROM lineitem GROUP BY 1"),
    "exclusion_log": _q(lambda t: t("runs", "exit_status", "label", "submitted").where("submitted = 0 or label is null").groupBy(F.coalesce(F.lower("exit_status"), F.lit("unknown")).alias("reason")).agg(F.count_if(F.col("label") == 0).alias("solved"), F.count_if(F.col("label") == 1).alias("failed"), F.count_if(F.col("label").isNull()).alias("unlabelled")), "SELECT coalesce(lower(exit_status), 'unknown') AS reason, count(*) FILTER (label = 0) AS solved, count(*) FILTER (label = 1) AS failed, count(*) FILTER (label IS NULL) AS unlabelled FROM runs WHERE submitted = 0 OR label IS NULL GROUP BY 1"),
    "both_class_groups": _q(lambda t: t("runs", "task_id", "label").groupBy("task_id").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo = 0 and hi = 1").select("task_id"), "SELECT task_id FROM runs GROUP BY task_id HAVING min(label) = 0 AND max(label) = 1"),
    "outcome_tensor": _q(lambda t: t("runs", "task_id", "model_id", "label").where("label is not null").groupBy("task_id", "model_id").agg(F.sum("label").alias("failed"), F.count(F.lit(1)).alias("n")), "SELECT task_id, model_id, sum(label)::BIGINT AS failed, count(*) AS n FROM runs WHERE label IS NOT NULL GROUP BY 1, 2"),
    "last_row_per_group": _q(lambda t: t("orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("m")).select("o_custkey", "m.*"), "SELECT o_custkey, o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"),
    "distinct_dedupe": _q(lambda t: t("preds", "pred_id", "submission").where("submission is not null").groupBy("submission").agg(F.min("pred_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "SELECT submission, min(pred_id) AS first_id, count(*) AS copies FROM preds WHERE submission IS NOT NULL GROUP BY 1"),
    "top_k": _q(lambda t: t("orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20), "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    "natural_sort": _q(lambda t: t("runs", "run_id").select("run_id", F.regexp_extract("run_id", r"_r(\d+)/", 1).cast("int").alias("attempt")).withColumn("place", F.row_number().over(Window.partitionBy("attempt").orderBy("run_id"))), "SELECT run_id, regexp_extract(run_id, '_r(\\d+)/', 1)::INTEGER AS attempt, row_number() OVER (PARTITION BY regexp_extract(run_id, '_r(\\d+)/', 1)::INTEGER ORDER BY run_id)::INTEGER AS place FROM runs"),
    "set_operations": _q(lambda t: R.set_counts(t("runs", "task_id"), t("reports", "task_id"), "task_id"), "WITH a AS (SELECT DISTINCT task_id FROM runs), b AS (SELECT DISTINCT task_id FROM reports) SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'left', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'right', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)"),
    "table_compare": _q(lambda t: R.compare_tables(t("customer", "c_custkey", "c_acctbal"), t("customer", "c_custkey", "c_acctbal").where("c_custkey % 10 <> 0").withColumn("c_acctbal", F.col("c_acctbal") + F.when(F.col("c_custkey") % 7 == 0, 1.0).otherwise(0.0)), "c_custkey", "c_acctbal"), "WITH b AS (SELECT c_custkey, c_acctbal + CASE WHEN c_custkey % 7 = 0 THEN 1.0 ELSE 0.0 END AS v FROM customer WHERE c_custkey % 10 <> 0) SELECT count(*) FILTER (b.c_custkey IS NULL) AS left_only, count(*) FILTER (a.c_custkey IS NULL) AS right_only, count(*) FILTER (abs(a.c_acctbal - b.v) > 1e-9) AS different, round(max(abs(a.c_acctbal - b.v)), 6) AS max_abs FROM customer a FULL JOIN b ON a.c_custkey = b.c_custkey"),
    "identical_patch_noise": _q(_noise, "WITH p AS (SELECT pred_id, submission, json_keys(pred_json)[1] AS task_id, (pred_id % 3 = 0)::INT AS f FROM preds), r AS (SELECT task_id FROM runs WHERE label IS NOT NULL GROUP BY task_id), g AS (SELECT p.task_id, submission, count(*) AS m, sum(f) AS f FROM p JOIN r ON p.task_id = r.task_id WHERE submission IS NOT NULL GROUP BY 1, 2), t AS (SELECT sum(m * (m - 1) / 2) AS pairs, sum(f * (m - f)) AS discordant FROM g), d AS (SELECT *, discordant / pairs AS d FROM t) SELECT pairs::DOUBLE AS pairs, discordant::DOUBLE AS discordant, round(d, 6) AS discordance, CASE WHEN d <= 0.5 THEN round((1 - sqrt(1 - 2 * d)) / 2, 6) END AS epsilon FROM d"),
    "patch_identity_noise": _q(_patch_noise, ""),
    "variance_shares_anova": _q(lambda t: R.anova_shares(t("runs", "task_id", "model_id", "label").where("label is not null"), "task_id", "model_id", "label"), "WITH d AS (SELECT task_id, model_id, label::DOUBLE AS y FROM runs WHERE label IS NOT NULL), t AS (SELECT avg(y) AS m, var_pop(y) AS v FROM d), a AS (SELECT sum(n * pow(g - m, 2)) / sum(n) AS v FROM (SELECT avg(y) g, count(*) n FROM d GROUP BY task_id), t), b AS (SELECT sum(n * pow(g - m, 2)) / sum(n) AS v FROM (SELECT avg(y) g, count(*) n FROM d GROUP BY model_id), t), c AS (SELECT sum((n - 1) * s) / sum(n - 1) AS v FROM (SELECT var_samp(y) s, count(*) n FROM d GROUP BY task_id, model_id HAVING count(*) > 1)) SELECT round(a.v / t.v, 6) AS a_share, round(b.v / t.v, 6) AS b_share, round(coalesce(c.v, 0) / t.v, 6) AS within_share FROM a, b, c, t"),
    "json_props": _q(lambda t: t("events", "event_id", "props").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "string").alias("k"), F.size(F.map_keys(F.from_json("props", "map<string,string>"))).alias("n_keys")), "SELECT event_id, json_extract_string(props, '$.k') AS k, len(json_keys(props))::INTEGER AS n_keys FROM events"),
    "shared_identifier_groups": _q(lambda t: R.linked_groups(t("preds", "submission", "pred_json").where("submission is not null").select("submission", F.sha1("pred_json").alias("h")), "submission", "h").select("submission", "group_id"), "WITH RECURSIVE p AS (SELECT DISTINCT submission AS s, sha1(pred_json) AS h FROM preds WHERE submission IS NOT NULL), e AS (SELECT DISTINCT a.s AS a, b.s AS b FROM p a JOIN p b USING (h)), r(s, o) AS (SELECT s, s FROM p UNION SELECT r.s, e.b FROM r JOIN e ON e.a = r.o) SELECT s AS submission, min(o) AS group_id FROM r GROUP BY s"),
}
