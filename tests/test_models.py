"""Fits against a solver written apart, and the guards around them."""

import numpy as np
import pandas as pd
import pytest

from runloom.operators import models as L


def solve(x, y):
    """Gradient descent's end on the C = 1 objective, by plain Newton steps on standardised columns."""
    sd = x.std(axis=0)
    z = np.hstack([np.ones((len(x), 1)), (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)])
    w, r = np.zeros(z.shape[1]), np.append(0, np.ones(z.shape[1] - 1))
    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - 0.5 * np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(r), z.T @ (p - y) + r * w)
    return w, 1 / (1 + np.exp(-z @ w))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    n = 600
    a = rng.normal(50, 10, n)
    d = pd.DataFrame({"i": range(n), "g": [f"g{i % 60}" for i in range(n)], "a": a, "b": a * 2 + rng.normal(0, 0.01, n), "c": rng.integers(0, 2, n) * 1e6, "flat": 1.0})
    d["fold"] = [i % 60 % 5 for i in range(n)]
    d["y"] = (rng.random(n) < 1 / (1 + np.exp(-(a - 50) / 8))).astype(int)
    return d


FEATURES = ["a", "b", "c", "flat"]  # a and b nearly the same


def test_fit_is_the_solvers(spark, data):
    w, risk = solve(data[FEATURES].to_numpy(), data.y.to_numpy())
    m = L.fit_logistic(spark.createDataFrame(data), "y", FEATURES)
    assert np.allclose([m.intercept, *m.coefficients], w, atol=1e-6)
    out = L.predict(m, spark.createDataFrame(data), FEATURES).toPandas().sort_values("i")
    assert np.allclose(out.risk, risk, atol=1e-6)


def test_folds_are_the_solvers(spark, data):
    out = L.out_of_fold(spark.createDataFrame(data), "y", FEATURES, "fold", "g").toPandas().sort_values("i").reset_index(drop=True)
    for k in range(5):
        train, test = data[data.fold != k], data[data.fold == k]
        m, s = train[FEATURES].mean(), train[FEATURES].std(ddof=0).replace(0, 1)
        w, _ = solve(train[FEATURES].to_numpy(), train.y.to_numpy())
        want = 1 / (1 + np.exp(-(w[0] + ((test[FEATURES] - m) / s) @ w[1:])))
        assert np.allclose(out.risk[test.index], want, atol=1e-6)


def test_one_class_no_rows_and_nulls(spark, data):
    d = spark.createDataFrame(data.assign(y=1))
    assert L.predict(L.fit_logistic(d, "y", ["a"]), d, ["a"]).agg({"risk": "min"}).first()[0] > 0.999
    with pytest.raises(ValueError):
        L.fit_logistic(d.limit(0), "y", ["a"])
    holes = spark.createDataFrame([(i, f"g{i}", i % 5 if i % 7 else None, float(i) if i % 3 else None, i % 2 if i % 11 else None) for i in range(60)], "i int, g string, fold int, a double, y int")
    out = L.out_of_fold(holes, "y", ["a"], "fold", "g")
    assert out.count() == 60 and out.where("risk is null").count() == 0
    with pytest.raises(ValueError, match="no convergence"):
        L.fit_models(spark.createDataFrame(data), "y", FEATURES, L.F.lit("x"), {"m": {"x"}}, steps=2)


def test_stack_never_sees_the_test_fold(spark, data):
    d = data.assign(risk=0.3 + 0.4 * (data.a > 50), other=np.where(data.i % 3 == 0, np.nan, data.a))
    base = L.stack(spark.createDataFrame(d).replace(float("nan"), None), "y", "risk", "other", "fold", "g").toPandas().set_index("i").risk
    # changing the scores of a fold changes the medians of the others only
    changed = d.assign(other=np.where((d.fold == 0) & d.other.notna(), d.other + 1000, d.other))
    again = L.stack(spark.createDataFrame(changed).replace(float("nan"), None), "y", "risk", "other", "fold", "g").toPandas().set_index("i").risk
    gaps0 = d[(d.fold == 0) & d.other.isna()].i
    assert np.allclose(base[gaps0], again[gaps0], atol=1e-9)
    assert len(base) == len(d)


def test_words_weigh_as_published(spark):
    d = spark.createDataFrame([(0, "Red fox red", 1), (1, "red hen", 0), (2, None, 1)], "i int, text string, y int")
    w = L.Words(d, "text", "x", size=100)
    assert sorted(w.counts.vocabulary) == sorted(["red", "fox", "hen", "red fox", "fox red", "red hen"])
    row = w.transform(d).where("i = 1").first()
    v = dict(zip(w.counts.vocabulary, row.x.toArray()))
    idf = {"red": np.log(4 / 3) + 1, "hen": np.log(4 / 2) + 1, "red hen": np.log(4 / 2) + 1}
    norm = np.sqrt(sum(x * x for x in idf.values()))
    assert all(v[k] == pytest.approx(x / norm) for k, x in idf.items()) and v["fox"] == 0
    assert len(L.Words(d, "text", "x", size=1).counts.vocabulary) == 1


def test_specs_baselines_and_cleaning(spark, data):
    small = data.head(120).assign(combo=lambda x: "c" + (x.i % 3).astype(str), maker=lambda x: x.i % 4, task=lambda x: np.where(x.g.str[1:].astype(int) % 2 == 0, "even words here", "odd words there"), size=lambda x: x.a)
    d = spark.createDataFrame(small)
    out = L.spec_risks(d, "y", ["a"], "fold", "g", {"M+S": (("combo",), True, ()), "T": ((), False, ("task",))}, k=5)
    p = out.toPandas()
    assert len(p) == 120 and p["risk_T"].nunique() <= 10 and np.corrcoef(p["risk_M+S"], p.a)[0, 1] > 0.9
    b = L.baselines(d, "y", ["a"], "size", "combo", "maker", "g", "fold").toPandas().set_index("i")
    for i, r in small.set_index("i").iterrows():
        rest = small[(small.g == r.g) & (small.maker != r.maker)]
        assert b.risk_D[i] == pytest.approx(rest.y.mean() if len(rest) else small.y.mean())
    assert {"risk_M", "risk_MN", "risk_MLEN", "risk_S", "risk_MS", "risk_DM", "risk_DMS"} <= set(b.columns)
    c = L.clean_by_fold(d, "y", ["a", "b", "c"], ["a"], "fold", "g").toPandas()
    assert set(c.kept) <= {"a", "a,c"} and len(c) == 120  # b is too close to a in every training set
