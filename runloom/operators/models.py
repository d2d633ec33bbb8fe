"""Grouped out-of-fold modelling on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom import scratch


@dataclass(frozen=True)
class Linear:
    """A logistic model on standardised features: intercept, and per feature its coefficient, mean and deviation."""

    intercept: float
    coefficients: tuple[float, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]


def _moments(cells: list, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, population deviation) of each feature over some cells, from the cells' counts, means and variances."""
    n, mean, m2 = np.zeros(p), np.zeros(p), np.zeros(p)
    for c in cells:
        more, mu, sq = (np.array([float(c[f"{k}{j}"] or 0.0) for j in range(p)]) for k in "nmv")
        total = np.maximum(n + more, 1)
        gap = mu - mean
        m2 += sq * more + gap**2 * n * more / total
        mean += gap * more / total
        n += more
    deviation = np.sqrt(m2 / np.maximum(n, 1))
    return mean, np.where(deviation > 1e-12 * np.maximum(1.0, np.abs(mean)), deviation, 1.0)


def fit_models(df: DataFrame, y: str, features: list[str], cell: Column, training: dict, *, tolerance: float = 1e-8, steps: int = 100) -> dict[object, Linear]:
    """L2 logistic regressions with C = 1 on standardised features, all at once: one for each name in training, fitted on
    the rows whose cell (a string) is in its set.

    Newton's method with halved steps. A step is one pass over the rows in which every Arrow batch adds up loss, gradient
    and Hessian of all models; the sums, models by features squared, are all that comes to the driver. Raises if a model
    has not converged after `steps` passes. Features are standardised by the model's own rows (population deviation, 1
    for a constant) and nulls take the mean; rows without y are not fitted on. A model of one class has no coefficients
    and its class as risk; one without rows is left out.
    """
    p = len(features)
    d = df.where(F.col(y).isNotNull()).select(cell.cast("string").alias("_cell"), F.col(y).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f"f{j}") for j, f in enumerate(features)])
    sums = [x for j in range(p) for x in (F.count(f"f{j}").alias(f"n{j}"), F.avg(f"f{j}").alias(f"m{j}"), F.var_pop(f"f{j}").alias(f"v{j}"))]
    cells = {r["_cell"]: r for r in d.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos"), *sums).collect()}
    codes = {c: i for i, c in enumerate(cells)}
    out: dict[object, Linear] = {}
    names, mean, deviation, member = [], [], [], []
    for name, wanted in training.items():
        own = [cells[c] for c in wanted if c in cells]
        n, pos = sum(c["n"] for c in own), sum(c["pos"] for c in own)
        if not n:
            continue
        m, s = _moments(own, p)
        if pos in (0, n):
            out[name] = Linear(40.0 if pos else -40.0, (0.0,) * p, tuple(m.tolist()), tuple(s.tolist()))
            continue
        names.append(name), mean.append(m), deviation.append(s)
        member.append([c in wanted for c in cells])
    if not names:
        return out
    mean, deviation, member = np.array(mean), np.array(deviation), np.array(member)
    w = np.zeros((len(names), p + 1))
    last, direction, size, loss = w.copy(), np.zeros_like(w), np.ones(len(names)), np.full(len(names), np.inf)
    going = np.ones(len(names), dtype=bool)
    ridge = np.append(0.0, np.ones(p))
    for _ in range(steps):
        todo, at = np.flatnonzero(going), w.copy()

        def add(batches: Iterator[pd.DataFrame], todo=todo, at=at) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(todo), 1 + (p + 1) + (p + 1) ** 2))
            for b in batches:
                of = b["_cell"].map(codes, na_action=None).to_numpy(int) if len(b) else np.zeros(0, int)
                x, label = b[[f"f{j}" for j in range(p)]].to_numpy(float), b["_y"].to_numpy()
                for i, m in enumerate(todo):
                    rows = member[m][of]
                    z = np.nan_to_num((x[rows] - mean[m]) / deviation[m])
                    z = np.hstack([np.ones((len(z), 1)), z])
                    eta, t = z @ at[m], label[rows]
                    risk = 1 / (1 + np.exp(-eta))
                    total[i, 0] += np.sum(np.logaddexp(0, eta) - t * eta)
                    total[i, 1 : p + 2] += z.T @ (risk - t)
                    total[i, p + 2 :] += ((z * (risk * (1 - risk))[:, None]).T @ z).ravel()
            yield pd.DataFrame({"i": np.arange(len(todo)), "v": list(total)})

        sums = d.mapInPandas(add, "i int, v array<double>").select("i", F.posexplode("v")).groupBy("i", "pos").agg(F.sum("col").alias("s")).collect()
        total = np.zeros((len(todo), 1 + (p + 1) + (p + 1) ** 2))
        for r in sums:
            total[r["i"], r["pos"]] = r["s"]
        for i, m in enumerate(todo):
            value = total[i, 0] + 0.5 * float(np.sum(ridge * w[m] ** 2))
            if value > loss[m] + 1e-9 * abs(loss[m]):
                size[m] /= 2
                w[m] = last[m] + size[m] * direction[m]
                continue
            slope = total[i, 1 : p + 2] + ridge * w[m]
            bend = total[i, p + 2 :].reshape(p + 1, p + 1) + np.diag(ridge)
            last[m], loss[m], size[m] = w[m], value, 1.0
            direction[m] = -np.linalg.solve(bend, slope)
            if np.abs(direction[m]).max() < tolerance:
                going[m] = False
            else:
                w[m] = w[m] + direction[m]
        if not going.any():
            break
    else:
        raise ValueError(f"no convergence in {steps} passes: {[n for n, g in zip(names, going) if g]}")
    for i, name in enumerate(names):
        out[name] = Linear(float(last[i, 0]), tuple(last[i, 1:].tolist()), tuple(mean[i].tolist()), tuple(deviation[i].tolist()))
    return out


def fit_logistic(train: DataFrame, y: str, features: list[str]) -> Linear:
    """One model of all rows."""
    models = fit_models(train, y, features, F.lit("all"), {"all": {"all"}})
    if not models:
        raise ValueError("no training rows")
    return models["all"]


def predict(model: Linear, df: DataFrame, features: list[str], out: str = "risk") -> DataFrame:
    parts = [c * (F.coalesce(F.col(f).cast("double"), F.lit(m)) - m) / s for f, c, m, s in zip(features, model.coefficients, model.means, model.deviations)]
    return df.withColumn(out, 1 / (1 + F.exp(-sum(parts, F.lit(model.intercept)))))


def _predicted(df: DataFrame, features: list[str], models: list[tuple], keys: str, on: Column) -> DataFrame:
    """df joined with a table of a row per model (key columns, model), and the model's risk; so the plan does not grow
    with the models."""
    rows = [(*key, m.intercept, [*zip(m.coefficients, m.means, m.deviations)]) for key, m in models]
    table = df.sparkSession.createDataFrame(rows, f"{keys}, _b double, _w array<struct<c:double,m:double,s:double>>")
    part = lambda f, w: w["c"] * (F.coalesce(F.col(f).cast("double"), w["m"]) - w["m"]) / w["s"]
    z = sum((part(f, F.col("_w")[n]) for n, f in enumerate(features)), F.col("_b"))
    return df.join(F.broadcast(table), on).withColumn("risk", 1 / (1 + F.exp(-z))).drop("_b", "_w")


def apart(df: DataFrame, fold: str, group: str) -> None:
    """Fails if rows of one group lie in two folds: the guard against leaks between folds."""
    if df.where(F.col(fold).isNotNull()).groupBy(group).agg((F.min(fold) != F.max(fold)).alias("torn")).where("torn").limit(1).count():
        raise ValueError(f"{group} in training and test rows")


def out_of_fold(df: DataFrame, y: str, features: list[str], fold: str, group: str, k: int = 5, folds: list[int] | None = None) -> DataFrame:
    """df with `risk`: each fold predicted by a model of the others; rows without a fold by a model of all that have one.
    folds names them if they are not 0 to k - 1. All models are fitted in the same passes."""
    folds = [*range(k)] if folds is None else folds
    apart(df, fold, group)
    training = {i: {str(j) for j in folds if j != i} for i in folds} | {None: {str(j) for j in folds}}
    models = fit_models(df, y, features, F.col(fold), training)
    table = [((i,), m) for i, m in models.items()]
    return _predicted(df, features, table, "_i int", F.col(fold).cast("int").eqNullSafe(F.col("_i"))).drop("_i")


OTHERS = "all others"


def transfer(df: DataFrame, y: str, features: list[str], domain: str, fold: str, k: int = 5) -> DataFrame:
    """df rows with `trained_on` and `risk`: from every domain to every domain, and from all others to each (OTHERS).

    The domains are those of the data, whatever the column: a source, a family, a version, a generation, whether a run
    finished. Each fold is predicted by models of the other folds; a domain without training rows there predicts nothing.
    Rows without a fold are predicted by models of all rows with one. Only coefficients come to the driver.
    """
    cells = [(r[0], r[1]) for r in df.where(F.col(domain).isNotNull()).select(domain, fold).distinct().collect()]  # a row per domain and fold
    code = {a: n for n, a in enumerate(sorted({a for a, _ in cells}))}
    name = lambda a, i: f"{code[a]}:{i}"
    folds = [*range(k), None] if any(i is None for _, i in cells) else [*range(k)]
    training = {(a, others, i): {name(b, j) for b, j in cells if (b != a) == others and j is not None and j != i} for a in code for others in (False, True) for i in folds}
    if not code:
        return df.limit(0).withColumn("trained_on", F.col(domain)).withColumn("risk", F.lit(0.0))
    coded = F.create_map(*[x for a, n in code.items() for x in (F.lit(a), F.lit(str(n)))])[F.col(domain)]
    models = fit_models(df, y, features, F.concat(coded, F.lit(":"), F.col(fold).cast("string")), training)
    table = [((OTHERS if others else a, a if others else None, i), m) for (a, others, i), m in models.items()]
    kind = df.schema[domain].dataType.simpleString()
    if kind != "string":
        raise ValueError("name domains by strings")
    on = F.col(fold).eqNullSafe(F.col("_i")) & F.col(domain).isNotNull() & (F.col("_to").isNull() | (F.col("_to") == F.col(domain)))
    return _predicted(df, features, table, "trained_on string, _to string, _i int", on).drop("_to", "_i")


def linear_shap(model: Linear, df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, coefficient, mean_abs): exact contributions of a linear model, coef times standardised value."""
    of = [*zip(features, model.coefficients, model.means, model.deviations)]
    rows = df.agg(*[F.avg(F.abs(F.lit(c) * (F.coalesce(F.col(f).cast("double"), F.lit(m)) - m) / s)).alias(f) for f, c, m, s in of])
    return rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(c).alias("coefficient"), F.col(f).alias("mean_abs")) for f, c, _, _ in of])).alias("x")).select("x.*")


def _by_fold(df: DataFrame, fold: str, k: int, one) -> DataFrame:
    """one(train, test) of every fold against the others; rows without a fold are predicted from all that have one."""
    parts = [(df.where(F.col(fold) != i), df.where(F.col(fold) == i)) for i in range(k)]
    orphans = df.where(F.col(fold).isNull())
    if orphans.limit(1).count():
        parts.append((df.where(F.col(fold).isNotNull()), orphans))
    return reduce(DataFrame.unionByName, [one(*p) for p in parts])


def isotonic(df: DataFrame, y: str, risk: str, fold: str, k: int = 5) -> DataFrame:
    """df with `calibrated`: monotone fit of y on out-of-fold risk, each fold by the others."""
    x = VectorAssembler(inputCols=[risk], outputCol="_v")

    def one(train, test):
        return IsotonicRegression(featuresCol="_v", labelCol=y, predictionCol="calibrated").fit(x.transform(train)).transform(x.transform(test)).drop("_v")

    return _by_fold(df, fold, k, one)


def boosted(df: DataFrame, y: str, features: list[str], fold: str, k: int = 5, rounds: int = 200) -> DataFrame:
    """df with `risk` of boosted trees: as many rounds, and steps as small, as the reference's (200, 0.05)."""
    x = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="keep")

    def one(train, test):
        model = GBTClassifier(featuresCol="_v", labelCol=y, maxIter=rounds, maxDepth=4, stepSize=0.05, seed=42).fit(x.transform(train))
        return model.transform(x.transform(test)).withColumn("risk", vector_to_array("probability")[1]).drop("_v", "rawPrediction", "probability", "prediction")

    return _by_fold(df, fold, k, one)


class Words:
    """TF-IDF of words and pairs of words: the `size` terms that occur most in the training texts, ln((1 + n) / (1 + df)) + 1
    as weight, rows of length 1."""

    def __init__(self, train: DataFrame, text: str, out: str, size: int = 5000):
        self.terms = [RegexTokenizer(inputCol=text, outputCol=f"{out}_w", pattern=r"(?U)\b\w\w+\b", gaps=False, toLowercase=True), NGram(n=2, inputCol=f"{out}_w", outputCol=f"{out}_b")]
        self.text, self.out = text, out
        self.counts = CountVectorizer(inputCol=f"{out}_t", outputCol=f"{out}_c", vocabSize=size, minDF=1.0).fit(self._terms(train))
        idf = IDF(inputCol=f"{out}_c", outputCol=f"{out}_i").fit(self.counts.transform(self._terms(train)))
        self.weigh = [ElementwiseProduct(scalingVec=Vectors.dense(idf.idf.toArray() + 1.0), inputCol=f"{out}_c", outputCol=f"{out}_i"), Normalizer(inputCol=f"{out}_i", outputCol=out)]

    def _terms(self, df: DataFrame) -> DataFrame:
        d = df.withColumn(self.text, F.coalesce(self.text, F.lit("")))
        for t in self.terms:
            d = t.transform(d)
        return d.withColumn(f"{self.out}_t", F.concat(f"{self.out}_w", f"{self.out}_b"))

    def transform(self, df: DataFrame) -> DataFrame:
        d = self.counts.transform(self._terms(df))
        for w in self.weigh:
            d = w.transform(d)
        return d.drop(*[f"{self.out}_{x}" for x in "wbtci"])


#: name -> (categories, whether the features are in, texts): the models that differ in what they are told.
SPECS = {
    "S": ((), True, ()), "M": (("combo",), False, ()), "T": (("repo",), False, ("task",)), "T+M": (("repo", "combo"), False, ("task",)),
    "T+M+S": (("repo", "combo"), True, ("task",)), "T+M+S+A": (("repo", "combo"), True, ("task", "answer")), "T+M+S+R": (("repo", "combo"), True, ("task", "reasoning")), "M+S": (("combo",), True, ()),
}


def spec_risks(df: DataFrame, y: str, features: list[str], fold: str, group: str, specs: dict | None = None, once_a_group: tuple[str, ...] = ("task",), k: int = 5, size: int = 5000) -> DataFrame:
    """df with a column risk_<spec> for each named spec: out-of-fold risks of one-hot categories, features and texts.

    Categories and features are standardised on the training folds, texts weighed as Words on them; what a group shares
    (`once_a_group`) is fitted on the training groups, each once. A category unknown in training has no column. Blocks are
    made once a fold for all specs. Rows without a fold are predicted from all that have one.
    """
    specs = specs or SPECS
    apart(df, fold, group)
    categories = sorted({c for cs, _, _ in specs.values() for c in cs})
    texts = sorted({t for _, _, ts in specs.values() for t in ts})
    keep = df.columns

    def one(train: DataFrame, test: DataFrame) -> DataFrame:
        first = train.dropDuplicates([group])
        blocks = [Words(first if t in once_a_group else train, t, f"_x_{t}", size) for t in texts]
        levels = {c: [r[0] for r in train.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).collect()] for c in categories}  # a column each
        flags = {c: [(F.coalesce(F.col(c) == v, F.lit(False))).cast("double").alias(f"_{c}_{i}") for i, v in enumerate(vs)] for c, vs in levels.items()}
        dense = {c: [f"_{c}_{i}" for i in range(len(vs))] for c, vs in levels.items()} | {"": [f"_f_{f}" for f in features]}
        columns = [x for xs in dense.values() for x in xs]

        def widen(d: DataFrame) -> DataFrame:
            d = d.select("*", *[x for xs in flags.values() for x in xs], *[F.col(f).cast("double").alias(f"_f_{f}") for f in features])
            for b in blocks:
                d = b.transform(d)
            return d

        wide, told = widen(train), widen(test)
        row = wide.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)], F.count(F.lit(1)).alias("n")).first()
        scale = {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}
        standard = lambda d: d.withColumns({c: (F.coalesce(F.col(c), F.lit(m)) - m) / s for c, (m, s) in scale.items()})
        # written once a fold, so that no fit makes the blocks again
        wide, told = (scratch.table(standard(d).select(*keep, *columns, *[f"_x_{t}" for t in texts]), "blocks") for d in (wide, told))
        for name, (cs, own, ts) in specs.items():
            inputs = [x for c in cs for x in dense[c]] + (dense[""] if own else []) + [f"_x_{t}" for t in ts]
            x = VectorAssembler(inputCols=inputs, outputCol="_v")
            model = LogisticRegression(featuresCol="_v", labelCol=y, regParam=1.0 / max(row["n"], 1), standardization=False, maxIter=5000, tol=1e-4).fit(x.transform(wide).select("_v", y))
            told = model.transform(x.transform(told)).withColumn(f"risk_{name}", vector_to_array("probability")[1]).drop("_v", "rawPrediction", "probability", "prediction")
        return told.select(*keep, *[f"risk_{name}" for name in specs])

    return _by_fold(df, fold, k, one)


def text_risk(df: DataFrame, y: str, text: str, category: str, features: list[str], fold: str, k: int = 5) -> DataFrame:
    """df with `risk` from category, features and text, vocabulary and weights fitted on training folds only."""
    row_group = df.withColumn("_row", F.monotonically_increasing_id())
    out = spec_risks(row_group, y, features, fold, "_row", {"all": ((category,), True, (text,))}, once_a_group=(), k=k)
    return out.withColumnRenamed("risk_all", "risk").drop("_row")


def baselines(df: DataFrame, y: str, features: list[str], size: str, category: str, maker: str, group: str, fold: str, k: int = 5) -> DataFrame:
    """df with the risks that a model must beat: risk_D (share of failures of the group's runs by other makers), risk_M
    (category), risk_MN (category and log of the size), risk_MLEN (category, size and its log), risk_S (features),
    risk_MS (category and features), risk_DM and risk_DMS (those with the logit of D).

    D is the overall share where no other maker ran the group; it is no fitted model and knows the group's other labels.
    """
    of = [group, maker]
    rest = Window.partitionBy(group)
    own = Window.partitionBy(*of)
    d = df.withColumn("_n", F.count(y).over(rest) - F.count(y).over(own)).withColumn("_f", F.sum(y).over(rest) - F.sum(y).over(own))
    mean = df.agg(F.avg(y)).first()[0] or 0.0
    d = d.withColumn("risk_D", F.when(F.col("_n") > 0, F.col("_f") / F.col("_n")).otherwise(F.lit(float(mean))))
    p = F.least(F.lit(0.98), F.greatest(F.lit(0.02), F.col("risk_D")))
    levels = [r[0] for r in df.select(category).where(F.col(category).isNotNull()).distinct().orderBy(category).collect()]  # a column each
    m = [f"_m{i}" for i in range(len(levels))]
    d = d.select("*", F.log1p(size).alias("_log"), F.log(p / (1 - p)).alias("_d"), *[F.coalesce(F.col(category) == v, F.lit(False)).cast("double").alias(c) for c, v in zip(m, levels)])
    sets = {"M": m, "MN": [*m, "_log"], "MLEN": [*m, size, "_log"], "S": features, "MS": [*m, *features], "DM": [*m, "_d"], "DMS": [*m, *features, "_d"]}
    keep = [c for c in d.columns if not c.startswith("_")]
    for name, columns in sets.items():
        d = out_of_fold(d, y, columns, fold, group, k).withColumnRenamed("risk", f"risk_{name}")
        keep.append(f"risk_{name}")
    return d.select(*keep)


def clean_by_fold(df: DataFrame, y: str, features: list[str], anchors: list[str], fold: str, group: str, k: int = 5, limit: float = 0.8) -> DataFrame:
    """df with `kept` and `risk`: features are chosen inside the training folds, by AUROC strength and closeness there,
    and the model of the chosen ones predicts the fold."""
    from runloom.operators.metrics import feature_aurocs, pearson

    apart(df, fold, group)

    def one(train, test):
        strength = {r.feature: r.strength for r in feature_aurocs(train, y, features).collect()}
        corr = {(r.a, r.b): r.r for r in pearson(train, features).collect()}
        kept = select_features(strength, corr, anchors, limit)
        return predict(fit_logistic(train, y, kept), test, kept).withColumn("kept", F.lit(",".join(kept)))

    return _by_fold(df, fold, k, one)


def stack(df: DataFrame, y: str, risk: str, other: str, fold: str, group: str) -> DataFrame:
    """Second-level risk from the logit of a risk and another score, whose gaps are filled by the training median: for a
    fold that of the other folds, for rows without a fold that of all folds. Each fold's model is fitted on such rows."""
    p = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col(risk)))
    d = df.withColumn("_l", F.log(p / (1 - p))).drop(risk)
    apart(d, fold, group)
    folds = [r[0] for r in d.where(F.col(fold).isNotNull()).select(fold).distinct().orderBy(fold).collect()]
    if not folds:
        return d.limit(0).withColumn("risk", F.lit(0.0)).drop("_l")
    percentile = lambda keep: F.percentile(F.when(keep, F.col(other)), 0.5)
    middle = d.agg(*[percentile(F.col(fold) != i).alias(f"m{n}") for n, i in enumerate(folds)], percentile(F.col(fold).isNotNull()).alias("all")).first()
    # a row for each model that sees it: `_of` is the fold the model leaves out, null for the model of all folds
    of = d.sparkSession.createDataFrame([(i, float(middle[f"m{n}"] or 0.0)) for n, i in enumerate(folds)] + [(None, float(middle["all"] or 0.0))], "_of int, _mid double")
    seen = d.join(F.broadcast(of)).withColumn("_o", F.coalesce(F.col(other), F.col("_mid")))  # a row per fold
    cell = F.concat(F.coalesce(F.col("_of").cast("string"), F.lit("-")), F.lit("|"), F.col(fold).cast("string"))
    models = fit_models(seen, y, ["_l", "_o"], cell, {i: {f"{'-' if i is None else i}|{j}" for j in folds if j != i} for i in [*folds, None]})
    own = seen.where(F.col(fold).eqNullSafe(F.col("_of")))
    return _predicted(own, ["_l", "_o"], [((i,), m) for i, m in models.items()], "_i int", F.col("_of").eqNullSafe(F.col("_i"))).drop("_i", "_l", "_o", "_of", "_mid")


def vif(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Variance inflation: diagonal of the inverse correlation matrix (features by features, on the driver)."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs]).first()
    m = np.eye(len(features))
    for a, b in pairs:
        m[features.index(a), features.index(b)] = m[features.index(b), features.index(a)] = row[f"{a}~{b}"] or 0.0
    if np.linalg.matrix_rank(m, tol=1e-8) < len(features):
        out = {}
        for i, f in enumerate(features):
            rest = [j for j in range(len(features)) if j != i]
            r2 = float(m[i, rest] @ np.linalg.pinv(m[np.ix_(rest, rest)]) @ m[rest, i])
            out[f] = math.inf if r2 > 1 - 1e-9 else 1 / (1 - r2)
        return out
    return dict(zip(features, np.diag(np.linalg.inv(m)).tolist()))


def select_features(strength: dict[str, float], corr: dict[tuple[str, str], float], anchors: list[str], limit: float = 0.8) -> list[str]:
    """Anchors first, then by falling strength (ties by name): a feature stays unless it is too close to one kept."""
    kept: list[str] = []
    for f in [*anchors, *sorted((f for f in strength if f not in anchors), key=lambda f: (-strength[f], f))]:
        if all(abs(corr.get((f, g), corr.get((g, f), 0.0))) <= limit for g in kept):
            kept.append(f)
    return kept


def random_intercept(counts: DataFrame, failed: str, n: str) -> tuple[float, float, float]:
    """(mean logit, deviation, latent share) of unit failure counts, by maximum likelihood over Gauss-Hermite nodes.

    Units enter as their distinct (failed, n) pairs with multiplicity: as many rows as there are such pairs.
    """
    rows = counts.groupBy(failed, n).agg(F.count(F.lit(1)).alias("m")).collect()
    s, t, m = (np.array([float(r[i]) for r in rows]) for i in range(3))
    nodes, weights = np.polynomial.hermite_e.hermegauss(40)
    logw = np.log(weights / weights.sum())

    def loss(mu: float, sd: float) -> float:
        eta = mu + sd * nodes[None, :]
        ll = s[:, None] * eta - t[:, None] * np.logaddexp(0, eta) + logw
        top = ll.max(axis=1)
        return -float((m * (top + np.log(np.exp(ll - top[:, None]).sum(axis=1)))).sum())

    best = min(((loss(a, b), a, b) for a in np.linspace(-4, 4, 33) for b in np.linspace(0.05, 5, 34)))
    step = (0.25, 0.15)
    while step[0] > 1e-5:
        around = min((loss(best[1] + i * step[0], max(1e-4, best[2] + j * step[1])), best[1] + i * step[0], max(1e-4, best[2] + j * step[1])) for i in (-1, 0, 1) for j in (-1, 0, 1))
        if around[0] < best[0] - 1e-12:
            best = around
        else:
            step = (step[0] / 2, step[1] / 2)
    var = best[2] ** 2
    return float(best[1]), float(best[2]), float(var / (var + math.pi**2 / 3))


def noise_ceiling(units: DataFrame, share: str, epsilon: float, n_sim: int, seed: int = 42) -> DataFrame:
    """(sim, auroc): AUROC of true failure shares against labels drawn from them and flipped with epsilon."""
    from runloom.operators.metrics import group_pairs

    d = units.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n_sim - 1))))
    u = lambda salt: (F.shiftrightunsigned(F.xxhash64(*[F.col(c) for c in units.columns], F.col("sim"), F.lit(salt + seed)), 11) / F.lit(float(2**53)))
    drawn = (u(1) < F.col(share)).cast("int")
    d = d.withColumn("_y", F.when(u(2) < epsilon, 1 - drawn).otherwise(drawn))
    g = group_pairs(d, "_y", share, "sim")
    return g.where("pairs > 0").select("sim", (F.col("concordant") / F.col("pairs")).alias("auroc"))


def nested_selection(df: DataFrame, y: str, sets: dict[str, list[str]], fold: str, group: str, k: int = 5) -> DataFrame:
    """df with `chosen` and `risk`: in each outer fold the feature set with the best AUROC among out-of-fold risks inside
    the training folds, refitted on all of them. Ties go to the first name.

    The inner folds are the training folds themselves and the AUROC is their average. Rows without a fold get the set
    chosen over all folds.
    """
    from runloom.operators.metrics import group_pairs

    def one(i: int | None) -> DataFrame:
        train, test = (df.where(F.col(fold).isNotNull()), df.where(F.col(fold).isNull())) if i is None else (df.where(F.col(fold) != i), df.where(F.col(fold) == i))
        folds = [j for j in range(k) if j != i]

        def strength(name: str) -> float:
            g = group_pairs(out_of_fold(train, y, sets[name], fold, group, folds=folds), y, "risk", fold).where("pairs > 0")
            return g.agg(F.avg(F.col("concordant") / F.col("pairs"))).first()[0] or 0.0

        found = {name: strength(name) for name in sets}
        best = min(found, key=lambda name: (-found[name], name))
        return predict(fit_logistic(train, y, sets[best]), test, sets[best]).withColumn("chosen", F.lit(best))

    orphans = [None] if df.where(F.col(fold).isNull()).limit(1).count() else []
    return reduce(DataFrame.unionByName, [one(i) for i in [*range(k), *orphans]])
