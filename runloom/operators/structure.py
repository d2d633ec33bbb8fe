"""The structure features of runs: one plan over steps and command events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.operators.sequences import entropy, grams


def step_table(steps: DataFrame) -> DataFrame:
    """(run_id, step_idx, pos, calls, n_outputs, n_nonzero, n_sent), one row an assistant step.

    steps: run_id, pos, step_idx, role (assistant, tool, ...), text, tool_calls. Outputs share the step_idx of their call.
    """
    out = F.col("role") == "tool"
    asst = F.col("role") == "assistant"
    sentences = F.size(F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) >= 15))
    g = steps.groupBy("run_id", "step_idx").agg(
        F.min(F.when(asst, F.col("pos"))).alias("pos"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(asst, F.struct("pos", F.coalesce("tool_calls", F.array().cast("array<string>")).alias("c"))))), lambda x: x["c"])).alias("calls"),
        F.count_if(out).alias("n_outputs"), F.count_if(out & F.col("text").startswith("returncode: ")).alias("n_nonzero"), F.sum(F.when(asst, sentences).otherwise(0)).alias("n_sent"),
    )
    return g.where("pos is not null")


def phased(steps: DataFrame, events: DataFrame) -> DataFrame:
    """step_table() with phase: edit if the step edits, else verify if it checks, else other."""
    e = events.groupBy("run_id", "step_idx").agg(F.max((F.col("kind") == "edit").cast("int")).alias("e"), F.max((F.col("kind") == "verify").cast("int")).alias("v"))
    d = steps.join(e, ["run_id", "step_idx"], "left")
    return d.withColumn("phase", F.when(F.col("e") == 1, "edit").when(F.col("v") == 1, "verify").otherwise("other"))


def _share(c: Column, n: Column) -> Column:
    return F.coalesce(c, F.lit(0)) / F.greatest(n, F.lit(1))


def structure_features(steps: DataFrame, events: DataFrame) -> DataFrame:
    """One row a run: lengths, counts, shares and order of edits and checks, repeats, return codes, files.

    steps: step_table(); events: (run_id, step_idx, ord, kind, target), ord a sortable order inside the run. A run
    without edits has its checks after a last edit that never came: all of them, and share_before_first_edit 1.
    """
    p = phased(steps, events)
    run = Window.partitionBy("run_id").orderBy("pos")
    p = p.withColumn("i", F.row_number().over(run) - 1).withColumn("prev", F.lag("phase").over(run))
    p = p.withColumn("island", F.sum(F.coalesce((F.col("phase") != F.col("prev")).cast("int"), F.lit(0))).over(run))
    is_edit = F.col("phase") == "edit"
    base = p.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_steps"), F.count_if(is_edit).alias("n_edits"), F.max(F.when(is_edit, F.col("i"))).alias("last_edit"), F.min(F.when(is_edit, F.col("i"))).alias("first_edit"),
        F.count_if(F.col("v") == 1).alias("n_verifications"), F.count_if(F.col("phase") == "verify").alias("pv"), F.count_if(F.col("phase") == "other").alias("po"),
        F.count_if(F.col("phase") != F.col("prev")).alias("n_transitions"), F.sum("n_outputs").alias("outs"), F.sum("n_nonzero").alias("bad"),
        F.count_if((F.col("v") == 1) & (F.col("n_nonzero") > 0)).alias("vf"),
        F.count_if((F.col("prev") == "edit") & (F.col("phase") == "verify")).alias("ev"),
    )
    tail = p.join(base.select("run_id", F.coalesce("last_edit", F.lit(-1)).alias("le")), "run_id").where("i > le").groupBy("run_id").agg(F.count(F.lit(1)).alias("seg_len_steps"), F.sum("n_sent").alias("seg_len_sent"))
    longest = p.groupBy("run_id", "island").agg(F.count(F.lit(1)).alias("n")).groupBy("run_id").agg(F.max("n").alias("max_phase_run"))
    bi = entropy(grams(p, "run_id", "pos", "phase", 2), "run_id", "gram", 9).withColumnRenamed("entropy", "phase_bigram_entropy")
    tri = entropy(grams(p, "run_id", "pos", "phase", 3), "run_id", "gram", 27).withColumnRenamed("entropy", "phase_trigram_entropy")

    cmd = p.select("run_id", "pos", F.posexplode("calls").alias("j", "c")).withColumn("c", F.trim(F.regexp_replace("c", r"\s+", " ")))
    cmd = cmd.withColumn("same", (F.lag("c").over(Window.partitionBy("run_id").orderBy("pos", "j")) == F.col("c")).cast("int"))
    cmds = cmd.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_cmd"), F.sum("same").alias("reps"), F.count_distinct("c").alias("kinds"))

    w = Window.partitionBy("run_id")
    edit = F.col("kind") == "edit"
    e = events.withColumn("le", F.max(F.when(edit, F.col("ord"))).over(w)).withColumn("fe", F.min(F.when(edit, F.col("ord"))).over(w))
    check = F.col("kind") == "verify"
    after = check & (F.col("le").isNull() | (F.col("ord") > F.col("le")))
    named = F.when(edit & (F.col("target") != "?"), F.col("target"))
    e = e.withColumn("fv", F.min(F.when(check, F.col("ord"))).over(w))
    ev = e.groupBy("run_id").agg(F.count_if(after).alias("n_after"), F.max((check & (F.col("fe").isNull() | (F.col("ord") < F.col("fe")))).cast("int")).alias("before"), F.count_distinct(named).alias("files"), F.max((after & (F.col("ord") > F.col("fv"))).cast("int")).alias("again"))
    t = e.where(named.isNotNull()).withColumn("pt", F.lag("target").over(Window.partitionBy("run_id").orderBy("ord")))
    switches = t.groupBy("run_id").agg(F.count_if(F.col("pt") != F.col("target")).alias("switches"))

    d = base
    for other in (tail, longest, bi, tri, cmds, ev, switches):
        d = d.join(other, "run_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n = F.col("n_steps")
    return d.select(
        "run_id", "n_steps", zero("seg_len_steps").alias("seg_len_steps"), zero("seg_len_sent").alias("seg_len_sent"), "n_edits", (F.col("n_verifications") > 0).cast("int").alias("has_any_verification"), "n_verifications",
        (zero("n_after") > 0).cast("int").alias("verif_after_last_edit"), zero("n_after").alias("n_verif_after_last_edit"), zero("before").alias("verified_before_first_edit"), zero("seg_len_steps").alias("n_steps_after_last_edit"),
        _share(F.col("n_edits"), n).alias("share_edit"), _share(F.col("pv"), n).alias("share_verify"), _share(F.col("po"), n).alias("share_other"), "n_transitions", F.coalesce("phase_bigram_entropy", F.lit(0.0)).alias("phase_bigram_entropy"),
        F.coalesce(F.col("first_edit") / n, F.lit(1.0)).alias("share_before_first_edit"), F.when(F.col("n_cmd") > 1, F.col("reps") / (F.col("n_cmd") - 1)).otherwise(0.0).alias("repeat_ratio"), _share(F.col("kinds"), n).alias("distinct_cmd_ratio"),
        _share(F.col("bad"), F.col("outs")).alias("nonzero_rc_share"), zero("files").alias("n_files_edited"), zero("switches").alias("n_file_switches"),
        F.coalesce("phase_trigram_entropy", F.lit(0.0)).alias("phase_trigram_entropy"), "max_phase_run", _share(F.col("vf"), F.col("n_verifications")).alias("verify_fail_share"), _share(F.col("ev"), n - 1).alias("bg_edit_verify"), zero("again").alias("reverify_after_last_edit"),
    )
