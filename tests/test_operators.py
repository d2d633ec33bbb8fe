import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from runloom.operators import metrics as M
from runloom.operators import models as L
from runloom.operators import ranks
from runloom.operators import relational as R
from runloom.operators import sequences as Q
from runloom.operators import shred as S


def test_ties_nulls_and_one_class(spark):
    d = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1), (None, 0.3), (1, None)], "y int, s double")
    assert M.auroc(d, "y", "s").first().auroc == 0.875
    assert M.auroc(d.where("y = 1"), "y", "s").first().auroc is None
    assert M.auroc(d.limit(0), "y", "s").first().auroc is None


def test_auroc_against_pairs(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 400), np.round(rng.normal(size=400), 1)
    d = spark.createDataFrame(pd.DataFrame({"y": y, "s": s, "i": range(400)}))
    p, q = s[y == 1][:, None], s[y == 0][None, :]
    assert M.auroc(d, "y", "s").first().auroc == pytest.approx(((p > q) + (p == q) / 2).mean())
    got = {r.i: r.rn for r in ranks.row_numbers(d, "s", "i", "rn").collect()}
    assert sorted(got.values()) == list(range(1, 401)) and all(got[a] < got[b] for a, b in zip(np.lexsort((range(400), s)), np.lexsort((range(400), s))[1:]))


def test_tie_expected_precision(spark):
    y = [1, 1, 0, 1, 0, 0, 0, 1, 0, 0]
    s = [0.9, 0.5, 0.5, 0.5, 0.5, 0.2, 0.2, 0.2, 0.1, 0.1]
    got = {r.rate: r for r in M.precision_tie_expected(spark.createDataFrame(list(zip(y, s)), "y int, s double"), "y", "s", [0.1, 0.2, 0.3]).collect()}
    assert got[0.1].precision == 1.0 and got[0.2].precision == 0.75 and got[0.3].precision == pytest.approx(2 / 3)


def test_loop_features_of_six_steps(spark):
    sigs = ["grep", "cat", "sed", "sed", None, "cat"]
    d = spark.createDataFrame([("r", i, x) for i, x in enumerate(sigs)], "run string, pos int, sig string")
    f = Q.loop_features(d, "run", "pos", "sig").first()
    assert f.max_run_length == 2 and f.distinct_ratio == 0.5 and f.repeat_ratio == 0.2


def test_sequence_windows_on_empty_input(spark):
    d = spark.createDataFrame([], "run string, pos int, sig string, v double")
    assert Q.loop_features(d, "run", "pos", "sig").count() == 0 and Q.complexity(d, "run", "pos", "v").count() == 0 and Q.sessions(d.withColumn("ts", F.lit(None).cast("timestamp")), "run", "ts", "pos", 10).count() == 0


def test_lookup_refuses_repeated_keys(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x"), (1, "y")], "d int, v string")
    with pytest.raises(Exception, match="repeated key"):
        R.left_lookup(a, b, "k", "d").collect()


def test_linked_groups(spark):
    d = spark.createDataFrame([("s1", "u"), ("s1", "e"), ("s2", "e"), ("s3", "v"), ("s4", None), (None, "u"), *[(f"c{i:02}", f"l{i}") for i in range(20)], *[(f"c{i:02}", f"l{i + 1}") for i in range(20)]], "s string, i string")
    g = {r.s: r.group_id for r in R.linked_groups(d, "s", "i").collect()}
    assert g["s1"] == g["s2"] == "s1" and g["s3"] == "s3" and g["s4"] == "s4" and {g[f"c{i:02}"] for i in range(20)} == {"c00"}


def test_logistic_recovers_signal_and_folds_stay_apart(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    d = spark.createDataFrame(pd.DataFrame({"x": x, "z": 1.0, "y": (x + rng.normal(size=300) > 0).astype(int), "g": np.arange(300) // 5, "fold": (np.arange(300) // 5) % 2}))
    out = L.out_of_fold(d, "y", ["x", "z"], "fold", "g", k=2)
    assert out.count() == 300 and M.auroc(out, "y", "risk").first().auroc > 0.75
    with pytest.raises(ValueError, match="training and test"):
        L.out_of_fold(d.withColumn("g", F.lit(1)), "y", ["x"], "fold", "g", k=2)


def test_vif_and_selection(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=200), rng.normal(size=200)
    d = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": a + b}))
    assert L.vif(d, ["a", "b", "c"])["c"] == float("inf") and L.vif(d, ["a", "b"])["a"] < 1.2
    assert L.select_features({"a": 0.3, "b": 0.2, "c": 0.1}, {("a", "b"): 0.9}, ["c"]) == ["c", "a"]


def test_random_intercept_recovers_parameters(spark):
    rng = np.random.default_rng(5)
    p = 1 / (1 + np.exp(-(0.5 + 1.5 * rng.normal(size=1500))))
    d = spark.createDataFrame(pd.DataFrame({"s": rng.binomial(10, p), "n": 10}))
    mu, sd, share = L.random_intercept(d, "s", "n")
    assert abs(mu - 0.5) < 0.15 and abs(sd - 1.5) < 0.15 and 0 < share < 1


REPORTS = [
    (1, "t1", '{"a__b-1": {"resolved": "True", "tests_status": {"FAIL_TO_PASS": {"success": ["x", null, {"name": "y"}, {"seconds": 1}, ""], "failure": null}, "OTHER": {"success": ["z"]}}}}'),
    (2, "t2", '{"resolved": 0, "tests_status": null}'),
    (3, "t3", "{'reports': [{'instance_id': 'q__r-2', 'resolved': None}, {}], 'version': 2}"),
    (4, "t4", '"{\\"patch_exists\\": true}"'), (5, "t5", "﻿{\"resolved\": false}"), (6, "t6", '{"a": '), (7, "t7", None), (8, "t8", "{}"), (9, "t9", "null"), (10, None, '{"resolved": true}'), (11, "t", "[" * 5000), (12, "t", '"' + "x" * 1000 + '"'),
]


def test_reports_of_all_shapes(spark):
    d = spark.createDataFrame(REPORTS, "report_id long, task_id string, report string").withColumn("node", F.lit("clash")).withColumn("label", F.lit(1))
    got = sorted(tuple(r) for r in S.flat_reports(d).collect() if r.task_id)
    assert got == [
        (1, "a__b-1", "FAIL_TO_PASS", "success", 0, "x"), (1, "a__b-1", "FAIL_TO_PASS", "success", 2, "y"), (1, "a__b-1", "REPORT", "resolved", -1, ""),
        (2, "t2", "REPORT", "unresolved", -1, ""), (3, "q__r-2", "REPORT", "unknown", -1, ""), (4, "t4", "REPORT", "unknown", -1, ""), (5, "t5", "REPORT", "unresolved", -1, ""),
    ]
    assert S.flat_reports(d).where("report_id = 10").first().task_id is None
    assert S.flat_reports(d.limit(0)).count() == 0


def test_walk_rebuilds_the_value():
    value = {"a": [1, {"b": None}, [True, "x"]], "c": {}, "d": []}
    nodes = list(S.walk(value))

    def build(node):
        kind = nodes[node][4]
        kids = sorted((n for n in nodes if n[1] == node), key=lambda n: n[3])
        if kind == "object":
            return {n[2]: build(n[0]) for n in kids}
        if kind == "array":
            return [build(n[0]) for n in kids]
        scalar = nodes[node][5]
        return int(scalar) if kind == "number" else scalar == "true" if kind == "boolean" else scalar

    assert [n[0] for n in nodes] == list(range(len(nodes))) and build(0) == value


def test_class_pairs_against_pairs(spark):
    rng = np.random.default_rng(8)
    d = pd.DataFrame({"g": rng.integers(0, 6, 200), "y": rng.integers(0, 2, 200), "s": rng.integers(0, 5, 200) / 2, "c": rng.integers(0, 3, 200)})
    label = F.when(F.col("f_c") == F.col("s_c"), "same").when(F.col("f_c") > F.col("s_c"), "up").otherwise("down")
    got = {r.pair_set: (r.n, r.concordant) for r in M.class_pairs(spark.createDataFrame(d), "y", "s", "g", ["c"], label).collect()}
    p = d[d.y == 1].merge(d[d.y == 0], on="g")
    p["set"] = np.where(p.c_x == p.c_y, "same", np.where(p.c_x > p.c_y, "up", "down"))
    p["w"] = (p.s_x > p.s_y) + (p.s_x == p.s_y) / 2
    assert got == {k: (len(x), x.w.sum()) for k, x in p.groupby("set")}
    assert M.class_pairs(spark.createDataFrame(d).limit(0), "y", "s", "g", ["c"], label).count() == 0


def test_values_wrapped_any_number_of_times():
    import json

    text = json.dumps({"a": 1})
    for _ in range(14):
        text = json.dumps(text) if len(text) < 4000 else repr(text)
        assert S.read_value("﻿ " + text) == {"a": 1}
    assert S.read_value('"') is None and S.read_value('""') is None and S.read_value("'x'") is None


def test_halves_of_surrogate_pairs(spark):
    d = spark.createDataFrame([(1, '{"a": "x\\ud800", "b": ["\\udc00", "é"]}')], "id long, body string")
    assert [r.scalar for r in S.shred(d, "id", "body").orderBy("node").collect()] == [None, "x?", None, "?", "é"]


def test_no_message_is_picked_where_all_are_short(spark):
    from runloom.operators import sequences as Q

    long = "This one is long enough to be picked."
    rows = [("a", 0, long), *[("a", i, "ok") for i in (1, 2, 3)], ("b", 0, long), *[("b", i, "ok") for i in (1, 2, 3, 4)], ("c", 0, "ok"), ("d", 0, long), ("d", 1, long + "!"), ("e", 0, None)]
    out = Q.step_back(spark.createDataFrame(rows, "run string, pos int, text string"), "run", "pos", "text").collect()
    assert sorted((r.run, r.pos) for r in out) == [("a", 0), ("d", 1)]
