"""Commands, models, sources and streams over the runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from runloom import scratch
from runloom.functions import commands as C
from runloom.io import load
from runloom.operators import command_runs as R
from runloom.operators import guards as K
from runloom.operators import metrics as M
from runloom.operators import models as L
from runloom.operators import resampling as B
from runloom.operators import sequences as Q
from runloom.operators import structure as G
from runloom.plans.base import ONCE_SQL, once, role, rounded, scored
from runloom.sources import tables as T
from runloom.sources import trajectories as J
from runloom.streaming import streams as S

FEATURES = ["n_steps", "n_err", "n_rows", "n_tools", "score"]


def _calls(spark, d):
    s = once(load(spark, d, "steps", "step_id", "run_id", "pos", "role", "text", "tool_calls")).withColumn("role", role())
    return R.calls_with_output(s)


def command_events(spark, d):
    return R.command_events(_calls(spark, d))


def check_features(spark, d):
    return R.check_features(scratch.table(R.command_events(_calls(spark, d)), "commands"))


def outcome_counts(spark, d):
    return R.command_events(_calls(spark, d)).where("kind = 'verify'").groupBy("runner", "outcome").agg(F.count(F.lit(1)).alias("n"))


def _check_rows(spark, d):
    s = once(load(spark, d, "steps", "step_id", "run_id", "task_id", "pos", "step_idx", "role", "text", "tool_calls")).withColumn("role", role())
    return R.check_rows(R.paired_calls(s))


def command_checks(spark, d):
    return _check_rows(spark, d)


def check_block(spark, d):
    runs = load(spark, d, "runs", "run_id", "submitted").select("run_id", (F.coalesce("submitted", F.lit(0)) == 1).alias("claim"))
    return rounded(R.check_block(scratch.table(_check_rows(spark, d), "checks"), runs))


def check_categories(spark, d):
    return _check_rows(spark, d).agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(F.col("is_check") & F.col("category").isNull()).alias("unjudged"), F.count_if(~F.col("is_check") & F.col("category").isNotNull()).alias("judged_without_check"))


def _frame(spark, d):
    return scratch.table(scored(spark, d), "scored")


def oof_logistic(spark, d):
    return rounded(L.out_of_fold(_frame(spark, d), "y", FEATURES, "fold", "task_id").select("run_id", "y", "risk"))


def oof_auroc(spark, d):
    risk = scratch.table(L.out_of_fold(_frame(spark, d), "y", FEATURES, "fold", "task_id"), "risk")
    return rounded(M.auroc(risk, "y", "risk").join(M.within_auroc(risk, "y", "risk", "task_id").select("pooled")))


def transfer_matrix(spark, d):
    f = _frame(spark, d)
    t = scratch.table(L.transfer(f, "y", FEATURES, "source", "fold").select("run_id", "source", "fold", "y", "trained_on", "risk"), "transfer")
    pooled = M.group_pairs(t, "y", "risk", "trained_on", "source").select("trained_on", "source", F.when(F.col("pairs") > 0, F.col("concordant") / F.col("pairs")).alias("auroc"))
    each = M.group_pairs(t.where("fold is not null"), "y", "risk", "trained_on", "source", "fold").where("pairs > 0").groupBy("trained_on", "source").agg(F.avg(F.col("concordant") / F.col("pairs")).alias("fold_auroc"))
    return rounded(pooled.join(each, ["trained_on", "source"], "left"))


def linear_shap(spark, d):
    f = _frame(spark, d)
    return rounded(L.linear_shap(L.fit_logistic(f, "y", FEATURES), f, FEATURES))


def isotonic_calibration(spark, d):
    risk = scratch.table(L.out_of_fold(_frame(spark, d), "y", FEATURES, "fold", "task_id"), "risk")
    return rounded(M.calibration(L.isotonic(risk, "y", "risk", "fold"), "y", "calibrated", "run_id"))


def boosted_risk(spark, d):
    return rounded(L.boosted(_frame(spark, d), "y", FEATURES, "fold").select("run_id", "risk"))


def text_risk(spark, d):
    texts = load(spark, d, "steps", "run_id", "step_id", "text").where("text is not null").groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_id", "text"))), lambda x: x["text"]), " ").alias("text"))
    f = scratch.table(_frame(spark, d).join(texts, "run_id"), "texts")
    return rounded(L.text_risk(f, "y", "text", "combo", FEATURES, "fold").select("run_id", "risk"))


def baseline_aurocs(spark, d):
    f = L.baselines(_frame(spark, d), "y", FEATURES, "n_steps", "combo", "model_family", "task_id", "fold")
    risk = scratch.table(f, "baselines")
    names = [c for c in risk.columns if c.startswith("risk_")]
    long = risk.select("run_id", "y", F.explode(F.array(*[F.struct(F.lit(c[5:]).alias("model"), F.col(c).alias("risk")) for c in names])).alias("x")).select("run_id", "y", "x.*")
    g = M.group_pairs(long, "y", "risk", "model").where("pairs > 0")
    return rounded(g.select("model", (F.col("concordant") / F.col("pairs")).alias("auroc")))


def cleaned_by_fold(spark, d):
    f = L.clean_by_fold(_frame(spark, d), "y", FEATURES, ["score"], "fold", "task_id")
    return rounded(f.groupBy("fold", "kept").agg(F.count(F.lit(1)).alias("n"), F.avg("risk").alias("mean_risk")))


def transfer_finished(spark, d):
    f = _frame(spark, d).where("finished = 1")
    t = L.transfer(f, "y", FEATURES, "model_family", "fold")
    g = M.group_pairs(t, "y", "risk", "trained_on", "model_family").where("pairs > 0")
    return rounded(g.select("trained_on", "model_family", (F.col("concordant") / F.col("pairs")).alias("auroc")))


def stacked_risk(spark, d):
    risk = scratch.table(L.out_of_fold(_frame(spark, d), "y", FEATURES, "fold", "task_id"), "risk")
    return rounded(L.stack(risk, "y", "risk", "score", "fold", "task_id").select("run_id", "risk"))


def nested_selection(spark, d):
    sets = {"length": ["n_steps"], "errors": ["n_err", "score"], "all": FEATURES}
    return rounded(L.nested_selection(_frame(spark, d), "y", sets, "fold", "task_id").groupBy("fold", "chosen").agg(F.count(F.lit(1)).alias("n"), F.avg("risk").alias("mean_risk")))


def vif_table(spark, d):
    v = L.vif(_frame(spark, d), ["n_steps", "n_err", "n_tools", "score"])
    return rounded(spark.createDataFrame([(k, float(x)) for k, x in sorted(v.items())], "feature string, vif double"))


def selected_features(spark, d):
    f = _frame(spark, d)
    strength = {r.feature: r.strength for r in M.feature_aurocs(f, "y", FEATURES).collect()}
    corr = {(r.a, r.b): r.r for r in M.pearson(f, FEATURES).collect()}
    return spark.createDataFrame([(i, x) for i, x in enumerate(L.select_features(strength, corr, ["score"]))], "place int, feature string")


def variance_shares_glmm(spark, d):
    units = scored(spark, d).groupBy("task_id").agg(F.sum("y").alias("failed"), F.count(F.lit(1)).alias("n"))
    mu, sd, share = L.random_intercept(units, "failed", "n")
    return rounded(spark.createDataFrame([(mu, sd, share)], "mean_logit double, deviation double, latent_share double"), 4)


def noise_ceiling(spark, d):
    units = scored(spark, d).groupBy("task_id").agg(F.avg("y").alias("share"))
    return rounded(L.noise_ceiling(units, "share", 0.05, 200).agg(F.avg("auroc").alias("ceiling"), F.count(F.lit(1)).alias("sims")))


def report_labels(spark, d):
    r = load(spark, d, "reports", "report_id", "task_id", "report")
    return r.select("report_id", J.report_label(F.col("report"), F.col("task_id")).alias("label"))


def raw_trajectories(spark, d):
    """Raw logs made of the steps of each run, read back through the reader of raw logs."""
    s = once(load(spark, d, "steps", "step_id", "run_id", "pos", "role", "text", "tool_calls")).withColumn("role", role()).where("role in ('assistant', 'tool')")
    call = F.transform(F.coalesce("tool_calls", F.array().cast("array<string>")), lambda c: F.struct(F.struct(F.to_json(F.struct(c.alias("command"))).alias("arguments")).alias("function")))
    m = s.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("pos", "role", F.coalesce("text", F.lit("")).alias("content"), call.alias("tool_calls")))).alias("m"))
    task = F.struct(F.lit(-1).alias("pos"), F.lit("user").alias("role"), F.concat(F.lit("<pr_description>Task of "), F.col("run_id"), F.lit("</pr_description>")).alias("content"), F.array().cast("array<struct<function:struct<arguments:string>>>").alias("tool_calls"))
    body = F.to_json(F.struct(F.struct(F.lit("Submitted").alias("exit_status")).alias("info"), F.concat(F.array(task), F.col("m")).alias("messages")))
    raw = m.select(F.split("run_id", "/")[0].alias("submission"), F.split("run_id", "/")[1].alias("task_id"), body.alias("body"))
    return J.exploded(J.trajectories(raw)).groupBy("run_id").agg(F.count_if(F.col("role") == "assistant").alias("n_steps"), F.sum(F.size("tool_calls")).alias("n_calls"), F.max("step_idx").alias("last_step"))


def attempt_status(spark, d):
    r = load(spark, d, "runs", "run_id", "task_id", "label", "submitted", "exit_status")
    status = F.when(F.col("label") == 0, "resolved").when(F.col("label") == 1, "unresolved").when(F.col("submitted") == 1, "eval_error").otherwise("not_evaluated")
    lists = r.groupBy(F.split("run_id", "/")[0].alias("run"), status.alias("status")).agg(F.collect_list("task_id").alias("ids"))
    return J.status_labels(lists).select("run", "task_id", "status", "label")


def last_answer(spark, d):
    return T.last_answers(load(spark, d, "preds", "pred_id", "submission", "created_at").where("submission is not null"), ["submission"], ["created_at", "pred_id"]).select("submission", "pred_id")


def frequent_tools(spark, d):
    calls = load(spark, d, "steps", "task_id", "tool").where("tool is not null").select(F.split("task_id", "__")[0].alias("benchmark"), F.lower(F.trim("tool")).alias("name"))
    return J.known_tools(calls)


def tool_kinds(spark, d):
    kind = F.udf(lambda x: C.tool_kind(x)[0], "string")
    tools = load(spark, d, "steps", "tool").where("tool is not null").groupBy(F.lower(F.trim("tool")).alias("tool")).agg(F.count(F.lit(1)).alias("n"))
    return tools.select("tool", "n", kind("tool").alias("kind"))  # on distinct tool names only


def lines_roundtrip(spark, d):
    df = load(spark, d, "runs", "run_id", "task_id", "label", "meta")
    path = f"{scratch.shared_dir(spark)}/runloom-lines-{uuid.uuid4().hex}"
    T.write_lines(df, path)
    back = T.read_lines(spark, path, "run_id string, task_id string, label int, meta map<string,string>")
    return back.select("run_id", "label", F.size("meta").alias("n_meta"))


def parts_roundtrip(spark, d):
    df = T.guarded(load(spark, d, "orders"), ["o_orderkey", "o_orderpriority", "o_totalprice"])
    path = f"{scratch.shared_dir(spark)}/runloom-parts-{uuid.uuid4().hex}"
    T.replace_parts(df, path, "o_orderpriority")
    T.replace_parts(df.where("o_orderpriority like '1%'").withColumn("o_totalprice", F.lit(0.0)), path, "o_orderpriority")
    return rounded(spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most")))


def stream_tumbling_counts(spark, d):
    return rounded(S.drain(S.tumbling_counts(S.source(spark, d, "events"), late="400 days"), "complete", "tumbling").withColumn("start", F.col("start").cast("timestamp_ntz")), 4)


def stream_sessions(spark, d):
    return S.drain(S.session_counts(S.source(spark, d, "events"), late="400 days"), "complete", "sessions").withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_first_deliveries(spark, d):
    s = S.source(spark, d, "steps").where("run_id is not null").select("run_id", "pos", "loaded_at")
    return S.drain(S.first_deliveries(s, ["run_id", "pos"], "loaded_at", "400 days"), "append", "first").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


def stream_event_state(spark, d):
    e = S.source(spark, d, "events").select("event_id", "user_id", "event_type")
    return S.drain(S.keyed_progress(e, "user_id", "event_id", "event_type", "click", "purchase"), "update", "state").groupBy("user_id").agg(F.max("n_mark").alias("n_mark"), F.max("n_check").alias("n_check"))


def structure_features(spark, d):
    s = scratch.table(once(load(spark, d, "steps", "step_id", "run_id", "pos", "step_idx", "role", "text", "tool_calls")).withColumn("role", role()), "once")
    ev = R.command_events(R.calls_with_output(s)).join(s.select("run_id", "pos", "step_idx"), ["run_id", "pos"])
    ev = scratch.table(ev.withColumn("ord", F.struct("pos", "call_idx", "ev_idx")), "events")
    return rounded(G.structure_features(scratch.table(G.step_table(s), "steps"), ev))


def gold_runs(spark, d):
    """One row a run: ids, features of structure and of its own checks, label and flags."""
    r = load(spark, d, "runs", "run_id", "task_id", "model_id", "source", "label", "submitted")
    return r.join(structure_features(spark, d), "run_id", "left").join(check_features(spark, d), "run_id", "left")


def pinned_values(spark, d):
    f = scored(spark, d).groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = f.agg(F.sum("n")).first()[0]
    t = f.unionByName(spark.createDataFrame([("all", float(total))], "source string, n double"))
    return K.enforce(K.pinned(t, "source", "n", {"all": float(total)}), "source")


def flat_settings(spark, d):
    return K.flat_settings(load(spark, d, "reports", "report_id", "report"), "report_id", "report")


def error_share_interval(spark, d):
    r = load(spark, d, "steps", "step_id", "task_id", "error").where("error is not null").withColumn("v", F.col("error").cast("int")).withColumn("w", F.lit(1.0))
    return rounded(B.row_bootstrap(r, "step_id", "task_id", "v", "w", 1000))


def segment_after_last_edit(spark, d):
    """Steps after a run's last edit, and the order patterns of their text lengths."""
    s = scratch.table(once(load(spark, d, "steps", "step_id", "run_id", "pos", "role", "text", "tool_calls")).withColumn("role", role()), "once")
    last = R.command_events(R.calls_with_output(s)).where("kind = 'edit'").groupBy("run_id").agg(F.max("pos").alias("le"))
    tail = s.join(last, "run_id", "left").where("pos > coalesce(le, -1)").withColumn("len", F.coalesce(F.length("text"), F.lit(0)).cast("double"))
    return rounded(Q.complexity(tail, "run_id", "pos", "len"))


QUERIES = {
    "structure_features": (structure_features, ""), "gold_runs": (gold_runs, ""), "pinned_values": (pinned_values, ""), "flat_settings": (flat_settings, ""), "error_share_interval": (error_share_interval, ""), "segment_after_last_edit": (segment_after_last_edit, ""),
    "command_events": (command_events, ""), "command_check_features": (check_features, ""), "command_outcomes": (outcome_counts, ""),
    "command_checks": (command_checks, ""), "check_block": (check_block, ""),
    "baseline_aurocs": (baseline_aurocs, ""), "cleaned_by_fold": (cleaned_by_fold, ""), "transfer_finished": (transfer_finished, ""),
    "check_categories": (check_categories, f"WITH {ONCE_SQL} SELECT sum(len(list_filter(tool_calls, lambda x: x IS NOT NULL)))::BIGINT AS n_calls, 0 AS unjudged, 0 AS judged_without_check FROM once WHERE role = 'assistant' AND run_id IS NOT NULL"),
    "oof_logistic": (oof_logistic, ""), "oof_auroc": (oof_auroc, ""), "transfer_matrix": (transfer_matrix, ""), "linear_shap": (linear_shap, ""), "isotonic_calibration": (isotonic_calibration, ""),
    "boosted_risk": (boosted_risk, ""), "text_risk": (text_risk, ""), "stacked_risk": (stacked_risk, ""), "nested_selection": (nested_selection, ""), "vif_table": (vif_table, ""), "selected_features": (selected_features, ""),
    "variance_shares_glmm": (variance_shares_glmm, ""), "noise_ceiling": (noise_ceiling, ""), "report_labels": (report_labels, ""),
    "raw_trajectories": (raw_trajectories, f"WITH {ONCE_SQL}, m AS (SELECT *, max(pos) FILTER (role = 'assistant') OVER (PARTITION BY run_id) AS la FROM once WHERE role IN ('assistant', 'tool')) SELECT run_id, count(*) FILTER (role = 'assistant') AS n_steps, sum(coalesce(len(tool_calls), 0)) FILTER (role = 'assistant')::BIGINT AS n_calls, (count(*) FILTER (role = 'assistant') - 1)::INTEGER AS last_step FROM m WHERE pos <= la GROUP BY run_id"),
    "attempt_status": (attempt_status, "SELECT split_part(run_id, '/', 1) AS run, task_id, CASE WHEN label = 0 THEN 'resolved' WHEN label = 1 THEN 'unresolved' WHEN submitted = 1 THEN 'eval_error' ELSE 'not_evaluated' END AS status, label FROM runs"),
    "last_answer": (last_answer, "SELECT submission, arg_max(pred_id, (created_at, pred_id)) AS pred_id FROM preds WHERE submission IS NOT NULL GROUP BY submission"),
    "frequent_tools": (frequent_tools, "SELECT split_part(task_id, '__', 1) AS benchmark, lower(trim(tool)) AS name FROM steps WHERE tool IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3"),
    "tool_kinds": (tool_kinds, ""),
    "lines_roundtrip": (lines_roundtrip, "SELECT run_id, label, CASE WHEN meta IS NOT NULL THEN cardinality(meta)::INTEGER END AS n_meta FROM runs"),
    "parts_roundtrip": (parts_roundtrip, "SELECT o_orderpriority, count(*) AS n, round(max(CASE WHEN o_orderpriority LIKE '1%' THEN 0.0 ELSE o_totalprice END), 6) AS most FROM orders GROUP BY 1"),
    "stream_tumbling_counts": (stream_tumbling_counts, "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "stream_sessions": (stream_sessions, "WITH n AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM n) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s"),
    "stream_first_deliveries": (stream_first_deliveries, "SELECT run_id, count(DISTINCT pos) AS n FROM steps GROUP BY run_id"),
    "stream_event_state": (stream_event_state, "SELECT user_id, count(*) FILTER (event_type = 'click') AS n_mark, count(*) FILTER (event_type = 'purchase') AS n_check FROM events GROUP BY user_id"),
}
