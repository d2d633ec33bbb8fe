"""Ranking and agreement metrics as DataFrame aggregates. Labels: 1 = failure; a higher score means more risk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom.operators.ranks import midranks, row_numbers, running


def _clean(df: DataFrame, *needed: str) -> DataFrame:
    return df.dropna(subset=list(needed))


def auroc(df: DataFrame, y: str, score: str) -> DataFrame:
    """(n, n_pos, auroc): rank statistic with ties counted half; null if a class is missing.

    Counted over distinct scores, so each positive class meets the negatives below it without any pair being made.
    """
    by = _clean(df, y, score).groupBy(score).agg(F.sum(y).cast("double").alias("pos"), F.sum(1 - F.col(y)).cast("double").alias("neg"))
    c = running(by, score, ["neg"])
    t = c.agg(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return t.select((F.col("p") + F.col("q")).cast("long").alias("n"), F.col("p").cast("long").alias("n_pos"), F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("u") / (F.col("p") * F.col("q"))).alias("auroc"))


def group_pairs(df: DataFrame, y: str, score: str, *group: str) -> DataFrame:
    """(group..., concordant, pairs) by ranks inside each group: U = sum of ranks less k(k+1)/2, ties half."""
    by = _clean(df, y, score, *group).groupBy(*group, score).agg(F.sum(y).cast("double").alias("pos"), F.sum(1 - F.col(y)).cast("double").alias("neg"))
    up = Window.partitionBy(*group).orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by = by.withColumn("below", F.sum("neg").over(up) - F.col("neg") / 2)
    return by.groupBy(*group).agg(F.sum(F.col("pos") * F.col("below")).alias("concordant"), (F.sum("pos") * F.sum("neg")).alias("pairs"))


def within_auroc(df: DataFrame, y: str, score: str, group: str) -> DataFrame:
    """(groups, pairs, pooled, macro) over groups with both classes."""
    g = group_pairs(df, y, score, group).where("pairs > 0")
    return g.agg(F.count(F.lit(1)).alias("groups"), F.sum("pairs").alias("pairs"), (F.sum("concordant") / F.sum("pairs")).alias("pooled"), F.avg(F.col("concordant") / F.col("pairs")).alias("macro"))


def class_pairs(df: DataFrame, y: str, score: str, group: str, classes: list[str], label: Column) -> DataFrame:
    """(pair_set, n, concordant, auroc) over (failed, solved) pairs of one group, sorted into sets by their classes.

    label reads the pair's classes as f_x and s_x. No pair is made: rows become counts per class and score, each failed
    cell meets the solved classes of its group once, and running counts tell how many solved rows of the class lie below.
    Work grows as cells times classes of a group.
    """
    cells = _clean(df, y, score, group).groupBy(group, *classes, score).agg(F.sum(y).cast("double").alias("pos"), F.sum(1 - F.col(y)).cast("double").alias("neg"))
    solved = cells.where("neg > 0").select(group, *[F.col(c).alias(f"s_{c}") for c in classes], F.col(score).alias("v"), "neg")
    failed = cells.where("pos > 0").select(group, *[F.col(c).alias(f"f_{c}") for c in classes], F.col(score).alias("v"), "pos")
    s = [f"s_{c}" for c in classes]
    met = failed.join(solved.select(group, *s).distinct(), group)
    both = met.unionByName(solved, allowMissingColumns=True)
    w = Window.partitionBy(group, *s)
    below = F.sum("neg").over(w.orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.coalesce(F.sum("neg").over(Window.partitionBy(group, *s, "v")), F.lit(0.0)) / 2
    d = both.withColumn("below", F.coalesce(below, F.lit(0.0))).withColumn("total", F.sum("neg").over(w)).where("pos is not null")
    p = d.groupBy(label.alias("pair_set")).agg(F.sum(F.col("pos") * F.col("total")).cast("long").alias("n"), F.sum(F.col("pos") * F.col("below")).alias("concordant"))
    return p.withColumn("auroc", F.col("concordant") / F.col("n"))


def average_precision(df: DataFrame, y: str, score: str) -> DataFrame:
    """(ap): sum over distinct thresholds of recall gain times precision."""
    by = _clean(df, y, score).groupBy(score).agg(F.sum(y).cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    c = running(by, score, ["pos", "n"], descending=True)
    return c.agg((F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")) / F.sum("pos")).alias("ap"))


def precision_at(df: DataFrame, y: str, score: str, tie: str, rates: list[float]) -> DataFrame:
    """(rate, k, found, precision, recall) for the top k = max(1, ceil(rate n)) rows, ties by the unique column."""
    d = row_numbers(_clean(df, y, score), score, tie, "rn", descending=True)
    rate = F.explode(F.array(*[F.lit(r) for r in rates])).alias("rate")
    t = d.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos")).select("*", rate).withColumn("k", F.greatest(F.lit(1), F.ceil(F.round(F.col("rate") * F.col("n"), 9))))
    out = d.join(F.broadcast(t), F.col("rn") <= F.col("k")).groupBy("rate", "k", "pos").agg(F.sum(y).alias("found"))
    return out.select("rate", "k", "found", (F.col("found") / F.col("k")).alias("precision"), (F.col("found") / F.col("pos")).alias("recall"))


def precision_tie_expected(df: DataFrame, y: str, score: str, rates: list[float]) -> DataFrame:
    """(rate, k, hits, precision, recall): the tied rows at the threshold count by their mean label."""
    by = _clean(df, y, score).groupBy(score).agg(F.sum(y).cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    c = running(by, score, ["pos", "n"], descending=True)
    total = c.agg(F.sum("n").alias("all"), F.sum("pos").alias("allpos"))
    rate = F.explode(F.array(*[F.lit(r) for r in rates])).alias("rate")
    t = total.select("*", rate).withColumn("k", F.greatest(F.lit(1.0), F.ceil(F.round(F.col("rate") * F.col("all"), 9)).cast("double")))
    at = c.join(F.broadcast(t), (F.col("cum_n") >= F.col("k")) & (F.col("cum_n") - F.col("n") < F.col("k")))
    hits = F.col("cum_pos") - F.col("pos") + (F.col("k") - (F.col("cum_n") - F.col("n"))) * F.col("pos") / F.col("n")
    return at.select("rate", "k", hits.alias("hits"), (hits / F.col("k")).alias("precision"), (hits / F.col("allpos")).alias("recall"))


def fold_budget(df: DataFrame, y: str, score: str, fold: str, tie: str, rate: float) -> DataFrame:
    """(fold, checked, found, wasted, precision, recall, lift) with the budget ceil(rate n) in each fold."""
    w = Window.partitionBy(fold)
    d = _clean(df, y, score, fold).withColumn("rn", F.row_number().over(w.orderBy(F.desc(score), tie))).withColumn("k", F.greatest(F.lit(1), F.ceil(F.round(F.lit(rate) * F.count(F.lit(1)).over(w), 9))))
    hit = F.col("rn") <= F.col("k")
    g = d.groupBy(fold).agg(F.count_if(hit).alias("checked"), F.sum(F.when(hit, F.col(y)).otherwise(0)).alias("found"), F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    p = F.col("found") / F.col("checked")
    return g.select(fold, "checked", "found", (F.col("checked") - F.col("found")).alias("wasted"), p.alias("precision"), (F.col("found") / F.col("pos")).alias("recall"), (p / (F.col("pos") / F.col("n"))).alias("lift"))


def brier(df: DataFrame, y: str, p: str) -> DataFrame:
    return _clean(df, y, p).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def calibration(df: DataFrame, y: str, p: str, tie: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, observed) for equal-count bins by p; the first n mod bins have one row more."""
    d = row_numbers(_clean(df, y, p), p, tie, "rn")
    total = F.broadcast(d.agg(F.count(F.lit(1)).alias("_n")))
    small, more = F.floor(F.col("_n") / bins), F.col("_n") % bins
    i = F.col("rn") - 1
    cut = more * (small + 1)
    b = F.when(i < cut, F.floor(i / (small + 1))).otherwise(more + F.floor((i - cut) / F.greatest(small, F.lit(1)))) + 1
    return d.join(total).withColumn("bin", b.cast("int")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("observed"))


def fold_auroc(df: DataFrame, y: str, score: str, fold: str) -> DataFrame:
    """(folds, auroc): mean of the folds' own AUROC over folds with both classes."""
    g = group_pairs(df, y, score, fold).where("pairs > 0")
    return g.agg(F.count(F.lit(1)).alias("folds"), F.avg(F.col("concordant") / F.col("pairs")).alias("auroc"))


def rank_effects(df: DataFrame, y: str, score: str, group: str) -> DataFrame:
    """(group, u, pairs, effect): Mann-Whitney U and rank-biserial effect of each group with both classes."""
    g = group_pairs(df, y, score, group).where("pairs > 0")
    return g.select(group, F.col("concordant").alias("u"), "pairs", (2 * F.col("concordant") / F.col("pairs") - 1).alias("effect"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    d = _clean(df, a, b).select(F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
    return midranks(midranks(d, "_a", "ra"), "_b", "rb").agg(F.corr("ra", "rb").alias("spearman"))


def _plogp(p: Column) -> Column:
    return F.sum(-p * F.log2(p))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """(bits, share): mutual information of two columns and its share of b's entropy."""
    joint = _clean(df, a, b).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    n = F.sum("n").over(Window.partitionBy())  # the contingency table: few rows
    j = joint.withColumn("p", F.col("n") / n)
    parts = [j.agg(_plogp(F.col("p")).alias("h")), *[j.groupBy(c).agg(F.sum("p").alias("p")).agg(_plogp(F.col("p")).alias("h")) for c in ("a", "b")]]
    hab, ha, hb = (p.withColumnRenamed("h", f"h{i}") for i, p in enumerate(parts))
    return hab.join(ha).join(hb).select((F.col("h1") + F.col("h2") - F.col("h0")).alias("bits"), ((F.col("h1") + F.col("h2") - F.col("h0")) / F.col("h2")).alias("share"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, observed, kappa, pabak) of two 0/1 ratings."""
    d = _clean(df, a, b).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("o"), F.avg(F.col(a).cast("double")).alias("pa"), F.avg(F.col(b).cast("double")).alias("pb"))
    e = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return d.select("n", F.col("o").alias("observed"), F.when(e < 1, (F.col("o") - e) / (1 - e)).alias("kappa"), (2 * F.col("o") - 1).alias("pabak"))


def gap(df: DataFrame, flag: str, outcome: str, stratum: str) -> DataFrame:
    """(pooled, stratified): share of flag at outcome 1 less at 0; inside strata, then weighted by their rows."""
    def diff():
        return F.avg(F.when(F.col(outcome) == 1, F.col(flag).cast("double"))) - F.avg(F.when(F.col(outcome) == 0, F.col(flag).cast("double")))

    d = _clean(df, flag, outcome, stratum)
    inside = d.groupBy(stratum).agg(diff().alias("g"), F.count(F.lit(1)).alias("n")).where("g is not null").agg((F.sum(F.col("g") * F.col("n")) / F.sum("n")).alias("stratified"))
    return d.agg(diff().alias("pooled")).join(inside)


def mean_shift(df: DataFrame, by: str, features: list[str]) -> DataFrame:
    """(feature, smd, ks) between by = 1 and by = 0: standardised mean difference and largest gap of the ECDFs."""
    long = df.where(F.col(by).isin(0, 1)).select(by, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select(by, "x.*").where("v is not null")
    one = [F.when(F.col(by) == k, F.col("v")) for k in (0, 1)]
    smd = long.groupBy("feature").agg(((F.avg(one[1]) - F.avg(one[0])) / F.sqrt((F.var_samp(one[1]) + F.var_samp(one[0])) / 2)).alias("smd"), *[F.count(c).alias(f"n{k}") for k, c in enumerate(one)])
    cells = long.groupBy("feature", "v").agg(*[F.count(c).cast("double").alias(f"c{k}") for k, c in enumerate(one)])
    up = Window.partitionBy("feature").orderBy("v")
    ecdf = cells.join(F.broadcast(smd), "feature").withColumn("gap", F.abs(F.sum("c1").over(up) / F.col("n1") - F.sum("c0").over(up) / F.col("n0")))
    return ecdf.groupBy("feature").agg(F.first("smd").alias("smd"), F.max("gap").alias("ks"))


def feature_aurocs(df: DataFrame, y: str, features: list[str]) -> DataFrame:
    """(feature, auroc, strength) of each feature alone, all in one pass over the unpivoted rows."""
    long = df.where(F.col(y).isNotNull()).select(y, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select(y, "x.*")
    g = group_pairs(long, y, "v", "feature")
    a = F.when(F.col("pairs") > 0, F.col("concordant") / F.col("pairs"))
    return g.select("feature", a.alias("auroc"), F.abs(a - 0.5).alias("strength"))


def pearson(df: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, r) for a < b, one pass."""
    d = df.select([F.col(f).cast("double").alias(f) for f in features]).dropna()
    pairs = [(a, b) for a in sorted(features) for b in sorted(features) if a < b]
    row = d.agg(*[F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}~{b}").alias("r")) for a, b in pairs])).alias("x")).select("x.*")


def binomial_tail(wins: Column, n: Column) -> Column:
    """Two-sided exact sign-test p-value of `wins` of n at 1/2, as one expression over at most n terms."""
    k = F.greatest(wins, n - wins)
    term = lambda i: F.exp(_lgamma(n + 1) - _lgamma(i + 1) - _lgamma(n - i + 1) - n * F.log(F.lit(2.0)))
    tail = F.aggregate(F.sequence(k.cast("int"), n.cast("int")), F.lit(0.0), lambda acc, i: acc + term(i))
    return F.least(F.lit(1.0), 2 * tail)


def _lgamma(x: Column) -> Column:
    """log of the gamma function for x >= 1: Stirling's series after eight steps of recurrence."""
    z = x.cast("double") + 8
    shift = reduce(lambda a, b: a + b, (F.log(x.cast("double") + i) for i in range(8)))
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - shift
