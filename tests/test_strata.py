import numpy as np
import pandas as pd
import pytest

from runloom.operators import resampling as R
from runloom.plans import resampling as P

N = 40


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    d = pd.DataFrame({"unit": np.repeat(np.arange(24) * 7919, 6), "y": rng.integers(0, 2, 144), "a": np.round(rng.normal(size=144), 1), "b": np.round(rng.normal(size=144), 1)})
    d["fold"] = (d.unit // 7919) % 3
    d.loc[d.fold == 2, "y"] = (d.unit == 7919 * 2).astype(int)  # draws without that unit have one class in this fold
    weights = R.draws(spark.createDataFrame(d[["unit"]].drop_duplicates()), "unit", N).toPandas().pivot(index="unit", columns="draw", values="w")
    return d, weights


def auroc(y, s):
    p, q = s[y == 1][:, None], s[y == 0][None, :]
    return ((p > q) + (p == q) / 2).mean() if p.size and q.size else np.nan


def test_fold_averaged_auroc_against_repeated_rows(spark, rows):
    d, weights = rows

    def diff(w):
        each = [[auroc(*(np.repeat(f[c].to_numpy(), w[f.unit]) for c in ("y", m))) for m in "ab"] for _, f in d.groupby("fold")]
        return np.subtract(*np.nanmean(each, axis=0))

    got = R.fold_auroc_difference(spark.createDataFrame(d), "y", "a", "b", "unit", "fold", N).first()
    v = np.array([diff(weights[i]) for i in range(N)])
    assert got.difference == pytest.approx(diff(weights[0] * 0 + 1)) and got.p_value == pytest.approx(((v <= 0).sum() + 1) / (N + 1))
    assert (got.lo, got.hi) == pytest.approx(tuple(np.percentile(v, [2.5, 97.5])))


def test_ratios_inside_strata(spark, rows):
    d, weights = rows
    st = pd.DataFrame([(u, i % 3, m, float((i * k) % 5), 4.0 if i % 3 < 2 else 4.0 * (i == 2)) for i, u in enumerate(weights.index) for m, k in (("a", 1), ("b", 3))], columns=["unit", "fold", "model", "num", "den"])

    def means(w):
        with np.errstate(invalid="ignore", divide="ignore"):
            r = st.assign(n=st.num * w[st.unit].to_numpy(), d=st.den * w[st.unit].to_numpy()).groupby(["fold", "model"])[["n", "d"]].sum()
        return (r.n / r.d.where(r.d > 0)).groupby("model").mean()

    sp = spark.createDataFrame(st)
    v = [means(weights[i]) for i in range(N)]
    got = {r.model: r for r in R.cluster_bootstrap(sp, "unit", "num", "den", "model", N, strata="fold").collect()}
    for m in "ab":
        assert got[m].estimate == pytest.approx(means(weights[0] * 0 + 1)[m]) and (got[m].lo, got[m].hi) == pytest.approx(tuple(np.percentile([x[m] for x in v], [2.5, 97.5])))
    pair = R.paired_difference(sp, "unit", "num", "den", "model", "a", "b", N, strata="fold").first()
    assert (pair.lo, pair.hi) == pytest.approx(tuple(np.percentile([x["a"] - x["b"] for x in v], [2.5, 97.5])))


def test_draws_are_the_reference_counts():
    assert (P.N_DRAWS, P.N_PERM, P.N_SUB) == (1000, 1000, 200)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("strata", [None, "fold"])
def test_draws_of_ratios_are_not_joined(spark, strata):
    """A join would broadcast units times draws, which no driver holds."""
    st = spark.createDataFrame([(u * 7919, u % 2, m, float(u % 5), 4.0) for u in range(9) for m in "ab"] + [(None, 0, "a", 9.0, 9.0), (1, 0, None, 9.0, 9.0)], "unit long, fold int, model string, num double, den double")
    out = R.cluster_bootstrap(st, "unit", "num", "den", "model", N, strata)
    assert "Join" not in plan(out) and sorted(r.model for r in out.collect()) == ["a", "b"]


@pytest.mark.parametrize("strata", [None, "fold"])
def test_draws_of_differences_are_not_joined(spark, strata):
    st = spark.createDataFrame([(u * 7919, u % 2, m, float(u % 5), 4.0) for u in range(9) for m in "ab"] + [(None, 0, "a", 9.0, 9.0)], "unit long, fold int, model string, num double, den double")
    out = R.paired_difference(st, "unit", "num", "den", "model", "a", "b", N, strata=strata)
    assert "Join" not in plan(out) and tuple(out.first()) == (0.0, 0.0, 0.0, 1.0, "not shown")


@pytest.mark.parametrize("rows_at_once", [1, 7, 512])
def test_draws_of_folds_are_not_joined(spark, rows, rows_at_once, monkeypatch):
    d, _ = rows
    monkeypatch.setattr(R, "ROWS", rows_at_once)
    want = tuple(R.fold_auroc_difference(spark.createDataFrame(d), "y", "a", "b", "unit", "fold", N).first())
    more = spark.createDataFrame(d).selectExpr("unit", "y", "a", "b", "concat('f', fold) as fold").union(spark.createDataFrame([(None, 1, 9.0, 9.0, "f0"), (5, 1, 9.0, 9.0, None)], "unit long, y long, a double, b double, fold string"))
    out = R.fold_auroc_difference(more, "y", "a", "b", "unit", "fold", N)
    assert "Join" not in plan(out) and tuple(out.first()) == pytest.approx(want)


def test_runs_of_fold_differences_are_not_broadcast(spark):
    """The limit is that of sessions which don't set one; the plan that ran counts, as adaptive execution may change a join."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(limit)
    spark.conf.set(limit, "10m")
    try:
        out = P.QUERIES["bootstrap_fold_diff"][0](spark, "/root/testdata/sf0.001")
        assert len(out.collect()) == 1
        ran = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(limit, was)
    assert "Broadcast" not in ran and "isFinalPlan=true" in ran and ran.count("SortMergeJoin") >= 2
