import random

import numpy as np
import pandas as pd
import pytest

from runloom.llm import groups, splits


def union_find(pairs):
    p = {}

    def root(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            p[max(x, y)] = min(x, y)
    return {x: root(x) for x in p}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "empty"])
@pytest.mark.parametrize("one_task", [5, 5_000])
def test_components(spark, kind, one_task, monkeypatch):
    monkeypatch.setattr(groups, "ONE_TASK", one_task)
    rng = random.Random(7)
    pairs = {
        "random": [(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}") for _ in range(260)] + [(None, "a"), ("b", None), ("c", "c")],
        "chain": [(f"{i:05}", f"{i + 1:05}") for i in range(120)],
        "star": [("hub", f"leaf{i}") for i in range(600)] * 2 + [(f"leaf{i}", "hub") for i in range(50)],
        "empty": [],
    }[kind]
    d = spark.createDataFrame([(a, b, 1, "x") for a, b in pairs], "a string, b string, node int, group_id string")
    got = {r.node: r.group_id for r in groups.connected_groups(d, "a", "b").collect()}
    assert got == union_find(pairs)


def test_clusters_are_connected_and_shallow(spark):
    n, beta = 400, 0.5
    edges = [(i, i + 1) for i in range(n - 1)]
    of = {r.v: r.c for r in groups.clusters(spark.createDataFrame(edges, "s long, d long"), 0, beta).collect()}
    assert set(of) == set(range(n)) and len(set(of.values())) > 10  # one level does not settle a long chain
    for c in set(of.values()):
        members = sorted(v for v in of if of[v] == c)
        assert members == list(range(members[0], members[-1] + 1)) and c in members
    assert max(abs(v - c) for v, c in of.items()) <= 4 * np.log(n) / beta
    # one task decomposes exactly as all tasks together do
    rng = random.Random(3)
    mixed = [(rng.randrange(150), 1000 + rng.randrange(150)) for _ in range(200)]
    assert groups.grow(edges, 0, beta) == of
    assert groups.grow(mixed, 2, 0.2) == {r.v: r.c for r in groups.clusters(spark.createDataFrame(mixed, "s long, d long"), 2, 0.2).collect()}


def test_pairs_of_runs(spark):
    rows = [(" A ", "b", "Same "), ("b", "B", "same"), ("c", None, "same"), ("c", "d", "unsure"), ("e", "f", None), ("", "g", "same"), ("a", "z", "SAME")]
    d = groups.same_pairs(spark.createDataFrame(rows, "run_id_a string, run_id_b string, verdict string"))
    assert sorted(map(tuple, d.collect())) == [("a", "b"), ("a", "z")]


def test_differencing_balances():
    rng = np.random.default_rng(1)
    w = np.sort(rng.integers(1, 100, 400))[::-1].astype(float)
    bins = splits.difference_bins(w.reshape(-1, 10))
    sums = np.bincount(bins.ravel(), weights=w, minlength=10)
    assert sums.max() - sums.min() <= 2 and all(sorted(row) == list(range(10)) for row in bins)


def test_splits_in_a_tree_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(splits, "BLOCK_GROUPS", 200)
    monkeypatch.setattr(splits, "FAN_IN", 2)
    rng = np.random.default_rng(2)
    w = pd.DataFrame({"kind": "k", "group_id": [f"g{i}" for i in range(1500)], "weight": np.append(rng.integers(1, 30, 1499), 10_000)})
    out = splits.balanced_splits(spark.createDataFrame(w), bins=20).toPandas().merge(w, on=["kind", "group_id"])
    share = out.groupby("split").weight.sum() / out.weight.sum()
    assert len(out) == 1500 and abs(share["train"] - 0.8) < 0.03 and abs(share["test"] - 0.1) < 0.02


def test_related_rows_stay_together(spark):
    tasks = spark.createDataFrame([("o__r-1", "old__r-1"), ("o__r-2", None), (None, None)], "task_id string, former_id string")
    folds = spark.createDataFrame([(1, "O/R 1", 0), (2, "old__r-1", 1), (3, "o__r-2", 2), (4, "O__R-2", None), (5, None, 1), (6, " ", 2), (7, "o__r-2", 2)], "fold_row long, task_id string, fold int")
    metrics = spark.createDataFrame([(1, "Only A b", "train"), (2, "only_a_B", "test"), (3, "all", None), (4, "ALL ", "train"), (5, None, "test")], "metric_id long, population string, split_name string")
    r = splits.project_records(folds, metrics, tasks).cache()
    assert r.count() == 12 and r.where("split is null").count() == 0
    assert r.groupBy("kind", "group_id").agg({"split": "count"}).join(r.select("kind", "group_id", "split").distinct(), ["kind", "group_id"]).count() == r.select("kind", "group_id").distinct().count()
    assert sorted(map(tuple, splits.torn(r, tasks).collect())) == [("population", "only_a_b"), ("task", "o__r-1")]
    empty = splits.project_records(folds.limit(0), metrics.limit(0), tasks.limit(0))
    assert empty.count() == 0 and splits.torn(empty, tasks).count() == 0
