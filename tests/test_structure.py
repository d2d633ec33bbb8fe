import math

import pytest
from pyspark.sql import functions as F

from runloom.functions.registry import register
from runloom.operators import command_runs as R
from runloom.operators import guards, resampling
from runloom.operators import structure as G

CALLS = [("grep -rn foo src", "src/x.py:1:foo"), ("sed -i 's/a/b/' src/x.py", ""), ("python -m pytest -q", "returncode: 1\nFAILED"), ("sed -i 's/b/c/' src/y.py", ""), ("python -m pytest -q", "1 passed"), ("echo COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT && cat patch.txt", None)]


def frame(spark):
    rows = []
    for i, (call, out) in enumerate(CALLS):
        rows.append(("r", 2 * i, i, "assistant", "Some reasoning sentence that is long enough here.", [call]))
        if out is not None:
            rows.append(("r", 2 * i + 1, i, "tool", out, []))
    rows.append(("empty", 0, 0, "assistant", None, None))
    return spark.createDataFrame(rows, "run_id string, pos int, step_idx int, role string, text string, tool_calls array<string>")


def test_structure_of_six_steps(spark):
    s = frame(spark)
    ev = R.command_events(R.calls_with_output(s)).join(s.select("run_id", "pos", "step_idx"), ["run_id", "pos"]).withColumn("ord", F.struct("pos", "call_idx", "ev_idx"))
    rows = {r.run_id: r for r in G.structure_features(G.step_table(s), ev).collect()}
    f = rows["r"]
    assert (f.n_steps, f.n_edits, f.seg_len_steps, f.n_verifications, f.verif_after_last_edit, f.n_verif_after_last_edit) == (6, 2, 2, 2, 1, 1)
    assert (f.verified_before_first_edit, f.n_files_edited, f.n_file_switches, f.n_transitions, f.max_phase_run, f.reverify_after_last_edit) == (0, 2, 1, 5, 1, 1)
    assert f.nonzero_rc_share == 1 / 5 and f.share_before_first_edit == 1 / 6 and f.verify_fail_share == 1 / 2 and f.bg_edit_verify == 2 / 5
    assert f.phase_trigram_entropy == pytest.approx(2 / math.log2(27)) and 0 < f.phase_bigram_entropy <= 1
    assert f.share_edit + f.share_verify + f.share_other == pytest.approx(1)
    assert rows["empty"].n_steps == 1 and rows["empty"].share_before_first_edit == 1.0 and rows["empty"].repeat_ratio == 0.0


def test_guards(spark):
    d = spark.createDataFrame([("a", 0.6851), ("b", 0.5)], "k string, v double")
    checks = guards.pinned(d, "k", "v", {"a": 0.685, "b": 0.6, "c": 1.0})
    assert {r.k: r.holds for r in checks.collect()} == {"a": True, "b": False, "c": False}
    with pytest.raises(Exception, match="not reproduced"):
        guards.enforce(checks, "k").collect()
    flat = guards.flat_settings(spark.createDataFrame([(1, '{"a": {"b": [1, {"api_key": "x"}]}, "c": null}'), (2, "{")], "id long, body string"), "id", "body")
    assert sorted(map(tuple, flat.collect()), key=str) == [(1, "a.b.0", "1"), (1, "a.b.1.api_key", "***"), (1, "c", None)]


def test_functions_in_sql(spark):
    assert len(register(spark)) == 7
    assert spark.sql("SELECT norm_command('cd /x && git show 3f2a9c1b')").first()[0] == "git show H"
    assert spark.sql("SELECT parse_outcome('1 failed', 'pytest')").first()[0] == "fail"
    assert [r.kind for r in spark.sql("SELECT * FROM classify_command('sed -i s/a/b/ x.py && pytest')").collect()] == ["edit", "verify"]


def test_row_bootstrap(spark):
    d = spark.range(2000).select("id", (F.col("id") % 2).alias("c"), (F.col("id") % 4 == 0).cast("int").alias("v"), F.lit(1.0).alias("w"))
    r = resampling.row_bootstrap(d, "id", "c", "v", "w", 200).first()
    assert r.estimate == 0.25 and r.lo <= 0.25 <= r.hi and r.undefined == 0
