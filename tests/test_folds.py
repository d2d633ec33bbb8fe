import numpy as np
import pandas as pd
import pytest

from runloom.operators import models as L


@pytest.fixture(scope="module")
def frame(spark):
    """300 rows of 60 tasks in five folds and three domains; the last ten rows have no fold."""
    rng = np.random.default_rng(5)
    x, g = rng.normal(size=300), np.arange(300) % 60
    d = pd.DataFrame({"i": range(300), "g": g, "x": x, "y": (rng.random(300) < 1 / (1 + np.exp(-2 * x))).astype(int), "domain": np.array(["a", "b", "c"])[(np.arange(300) // 60) % 3]})
    d["fold"] = (d.g % 5).astype(object).where(d.i < 290, None)
    return spark.createDataFrame(d, "i int, g int, x double, y int, domain string, fold int").cache()


def test_transfer_over_all_domains_and_folds(frame):
    out = L.transfer(frame, "y", ["x"], "domain", "fold").toPandas()
    d = frame.toPandas()
    n = d.groupby("domain").size().to_dict()
    assert out.groupby(["trained_on", "domain"]).size().to_dict() == {(a, b): n[b] for a in ("a", "b", "c", L.OTHERS) for b in n}
    for a, i in (("a", 1), ("c", 4)):
        of = frame.where(f"domain = '{a}' and fold <> {i}")
        want = L.predict(L.fit_logistic(of, "y", ["x"]), frame.where(f"fold = {i}"), ["x"]).toPandas().set_index("i").risk
        got = out[(out.trained_on == a) & (out.fold == i)].set_index("i").risk
        assert np.allclose(got.sort_index(), want.sort_index())
    want = L.predict(L.fit_logistic(frame.where("domain <> 'b' and fold <> 2"), "y", ["x"]), frame.where("domain = 'b' and fold = 2"), ["x"]).toPandas().set_index("i").risk
    got = out[(out.trained_on == L.OTHERS) & (out.domain == "b") & (out.fold == 2)].set_index("i").risk
    assert np.allclose(got.sort_index(), want.sort_index())


def test_every_fold_by_the_other_four(frame, monkeypatch):
    """Rows that each model is fitted on, as the fits themselves see them."""
    seen = []

    def spy(cls):
        fit = cls.fit
        monkeypatch.setattr(cls, "fit", lambda self, d, *a: (seen.append(sorted(x[0] for x in d.select("fold").distinct().collect())), fit(self, d, *a))[1])

    spy(L.IsotonicRegression)
    spy(L.GBTClassifier)
    others = [[j for j in range(5) if j != i] for i in range(5)] + [[0, 1, 2, 3, 4]]
    d = frame.withColumnRenamed("x", "risk")
    assert L.isotonic(d, "y", "risk", "fold").count() == 300 and seen == others
    seen.clear()
    out = L.boosted(frame, "y", ["x"], "fold", rounds=1)
    assert out.count() == 300 and out.where("risk is null").count() == 0 and seen == others


def test_text_risk_keeps_rows_without_fold(frame):
    from pyspark.sql import functions as F

    d = frame.withColumn("text", F.when(F.col("y") == 1, "went wrong here").otherwise("all went fine"))
    out = L.text_risk(d, "y", "text", "domain", ["x"], "fold").toPandas()
    assert len(out) == 300 and out.risk.notna().all() and out[out.y == 1].risk.min() > out[out.y == 0].risk.max()


def test_nested_selection_over_five_folds(frame):
    out = L.nested_selection(frame.selectExpr("*", "double(0) as flat"), "y", {"flat": ["flat"], "x": ["x"]}, "fold", "g").toPandas()
    assert len(out[out.fold.notna()]) == 290 and set(out.chosen) == {"x"} and out[out.fold.notna()].groupby("fold").size().to_dict() == frame.where("fold is not null").toPandas().groupby("fold").size().to_dict()


def test_defaults_are_the_reference_counts():
    import inspect

    of = lambda f, p: inspect.signature(f).parameters[p].default
    assert all(of(f, "k") == 5 for f in (L.isotonic, L.boosted, L.text_risk, L.nested_selection, L.transfer)) and of(L.boosted, "rounds") == 200
