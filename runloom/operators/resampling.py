"""Resampling and multiplicity: always over per-group sufficient statistics, never over rows per draw."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values of the shared hash draws: any engine with 64-bit integers gives the same weights
_A, _B, _C, _M = 1_103_515, 12_345, 7_919, 1_000_003


def draws(groups: DataFrame, unit: str, n_draws: int) -> DataFrame:
    """(unit, draw, w): bootstrap weights of units (long numbers), fixed by unit and draw, so that all models and metrics
    share them. w follows the Poisson(1) shape by thresholds of a hash in [0, 1)."""
    draw = F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw")
    d = groups.select(unit, draw)
    u = poisson_hash(F.col(unit), F.col("draw"))
    return d.withColumn("w", poisson_weight(u))


def poisson_hash(unit: Column, draw: Column) -> Column:
    h = (unit.cast("long") * _A + draw.cast("long") * _B + _C) % _M
    return (h * h) % _M / F.lit(float(_M))


# fixed values: the Poisson(1) distribution function at 0 to 4
POISSON = (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153)


def poisson_weight(u: Column) -> Column:
    return sum(((u >= p).cast("int") for p in POISSON), F.lit(0))


def drawn(stats: DataFrame, unit: str, n_draws: int) -> DataFrame:
    """stats once a draw with `draw` and its weight `w` as in draws(), and once as they are, as draw -1.

    The weights are worked out in place. A join with draws() would broadcast units times draws, as adaptive execution takes
    the few units for the size of what is exploded from them; for the same reason the rows are first spread over tasks.
    """
    tasks = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = stats.where(F.col(unit).isNotNull()).repartition(tasks, unit).withColumn("draw", F.explode(F.sequence(F.lit(-1), F.lit(n_draws - 1))))
    return each.withColumn("w", F.when(F.col("draw") < 0, 1).otherwise(poisson_weight(poisson_hash(F.col(unit), F.col("draw")))))


def cluster_bootstrap(stats: DataFrame, unit: str, num: str, den: str, model: str, n_draws: int, strata: str | None = None) -> DataFrame:
    """(model, estimate, lo, hi) of sum(num)/sum(den) over units; stats has one row per unit and model. With strata (a
    column of the units) the ratio is taken inside each stratum and averaged over those where it is defined."""
    num_, den_ = F.sum(F.col("w") * F.col(num)), F.sum(F.col("w") * F.col(den))
    by = drawn(stats.where(F.col(model).isNotNull()), unit, n_draws)
    if strata:
        by = by.where(F.col(strata).isNotNull()).groupBy(model, "draw", strata).agg(F.when(den_ > 0, num_ / den_).alias("v")).groupBy(model, "draw").agg(F.avg("v").alias("v"))
    else:
        by = by.groupBy(model, "draw").agg((num_ / den_).alias("v"))
    v = F.when(F.col("draw") >= 0, F.col("v"))
    return by.groupBy(model).agg(F.max(F.when(F.col("draw") < 0, F.col("v"))).alias("estimate"), F.percentile(v, 0.025).alias("lo"), F.percentile(v, 0.975).alias("hi"))


def _verdict(values: DataFrame, alpha: float, tests: int) -> DataFrame:
    """values: (draw, v), draw -1 being the rows as they are."""
    cut, drawn_ = alpha / tests / 2, F.col("draw") >= 0
    v = F.when(drawn_, F.col("v"))
    ci = values.agg(F.max(F.when(~drawn_, F.col("v"))).alias("difference"), F.percentile(v, cut).alias("lo"), F.percentile(v, 1 - cut).alias("hi"), ((F.count_if(v <= 0) + 1) / (F.count_if(drawn_) + 1)).alias("p_value"))
    verdict = F.when(F.col("lo") > 0, "gain").when(F.col("hi") < 0, "loss").otherwise("not shown")
    return ci.withColumn("verdict", verdict)


def paired_difference(stats: DataFrame, unit: str, num: str, den: str, model: str, a: str, b: str, n_draws: int, alpha: float = 0.05, tests: int = 1, strata: str | None = None) -> DataFrame:
    """(difference, lo, hi, p_value, verdict): model a less model b on shared draws, interval at alpha / tests. With strata
    the difference is taken inside each stratum and averaged."""

    def ratio(m):
        on = F.when(F.col(model) == m, F.col("w"))
        below = F.sum(on * F.col(den))
        return F.sum(on * F.col(num)) / (F.when(below > 0, below) if strata else below)

    less = (ratio(a) - ratio(b)).alias("v")
    by = drawn(stats, unit, n_draws)
    if strata:
        by = by.where(F.col(strata).isNotNull()).groupBy("draw", strata).agg(less).groupBy("draw").agg(F.avg("v").alias("v")).where("v is not null")
    else:
        by = by.groupBy("draw").agg(less)
    return _verdict(by, alpha, tests)


ROWS = 512  # cells that are weighted for all draws at once


def _drawn_pieces(fold: str, unit: str, n_draws: int):
    """A function of sorted cells (fold, m, v, unit, pos, neg) to a piece's weighted sums in each draw, draw -1 unweighted:
    (fold, m, least v, draw, pos, neg, u), u being its positives times the negatives below them, ties half."""

    def pieces(batches):
        h = np.arange(_M, dtype=np.int64)
        weight = np.tile(np.searchsorted(POISSON, h * h % _M / float(_M), side="right").astype(float), 2)
        step = (np.arange(n_draws, dtype=np.int64) * _B + _C) % _M
        key = first = at = None
        zero = np.zeros(n_draws + 1)
        total_p, total_n, u, p, n = zero, zero, zero, zero, zero  # p, n: of the value `at`, which may go on

        def done():
            return pd.DataFrame({"fold": [key[0]] * (n_draws + 1), "m": key[1], "v": first, "draw": np.arange(-1, n_draws), "pos": total_p + p, "neg": total_n + n, "u": u + p * (total_n + n / 2)})

        for b in batches:
            new = (b[fold].ne(b[fold].shift()) | b["m"].ne(b["m"].shift())).to_numpy()
            cuts = np.unique(np.concatenate([np.flatnonzero(new), np.arange(0, len(b), ROWS), [len(b)]]))
            folds, ms, vs, pos, neg = b[fold].to_numpy(), b["m"].to_numpy(), b["v"].to_numpy(), b["pos"].to_numpy(float), b["neg"].to_numpy(float)
            res = b[unit].to_numpy(np.int64) % _M * (_A % _M) % _M
            for i, j in zip(cuts[:-1], cuts[1:]):
                if key != (folds[i], ms[i]):
                    if key is not None:
                        yield done()
                    key, first, at = (folds[i], ms[i]), vs[i], None
                    total_p, total_n, u, p, n = zero, zero, zero, zero, zero
                w = np.ones((j - i, n_draws + 1))
                w[:, 1:] = weight[res[i:j, None] + step]
                starts = np.flatnonzero(np.concatenate([[True], vs[i + 1 : j] != vs[i : j - 1]]))
                ps, ns = np.add.reduceat(w * pos[i:j, None], starts), np.add.reduceat(w * neg[i:j, None], starts)
                if at is not None and at == vs[i]:
                    ps[0] += p
                    ns[0] += n
                else:
                    total_p, total_n, u = total_p + p, total_n + n, u + p * (total_n + n / 2)
                full = ns[:-1]
                u = u + (ps[:-1] * (total_n + np.cumsum(full, axis=0) - full / 2)).sum(axis=0)
                total_p, total_n = total_p + ps[:-1].sum(axis=0), total_n + full.sum(axis=0)
                p, n, at = ps[-1], ns[-1], vs[j - 1]
        if key is not None:
            yield done()

    return pieces


def fold_auroc_difference(df: DataFrame, y: str, a: str, b: str, unit: str, fold: str, n_draws: int, alpha: float = 0.05, tests: int = 1) -> DataFrame:
    """(difference, lo, hi, p_value, verdict) of the fold-averaged AUROC of score a less that of b, units drawn inside
    their folds. Folds where a draw has one class only are left out of its average, draws without any fold of the rest.

    Rows become counts per (unit, score), sorted by fold and score over all tasks. A task sums its piece of the order up for
    each draw, so that what is shuffled grows as tasks and draws, and pieces are put together by the negatives before them.
    """
    d = df.where(F.col(fold).isNotNull() & F.col(unit).isNotNull()).dropna(subset=[y, a, b])
    models = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(c).cast("double").alias("v")) for i, c in enumerate((a, b))])).alias("x")
    cells = d.select(unit, fold, y, models).groupBy(unit, fold, "x.m", "x.v").agg(F.sum(y).cast("double").alias("pos"), F.sum(1 - F.col(y)).cast("double").alias("neg"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartitionByRange(tasks, fold, "m", "v").sortWithinPartitions(fold, "m", "v")  # a value is never cut
    x = cells.mapInPandas(_drawn_pieces(fold, unit, n_draws), f"fold {df.schema[fold].dataType.simpleString()}, m int, v double, draw int, pos double, neg double, u double")
    before = Window.partitionBy("draw", "fold", "m").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("below", F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
    pairs = F.sum("pos") * F.sum("neg")
    each = x.groupBy("draw", "fold", "m").agg(F.when(pairs > 0, F.sum(F.col("u") + F.col("pos") * F.col("below")) / pairs).alias("auroc"))
    v = each.groupBy("draw").agg((F.avg(F.when(F.col("m") == 0, F.col("auroc"))) - F.avg(F.when(F.col("m") == 1, F.col("auroc")))).alias("v"))
    return _verdict(v.where("v is not null"), alpha, tests)


def permutation_null(df: DataFrame, y: str, score: str, unit: str, tie: str, n_perm: int) -> DataFrame:
    """(observed, n_at_least, p_value) of the pooled within-unit concordance against labels permuted inside units.

    A permutation gives the k positive labels of a unit to the k rows with the least hash of (tie, permutation).
    """
    ranks = Window.partitionBy(unit).orderBy(score)
    same = Window.partitionBy(unit, score)
    d = df.dropna(subset=[y, score]).withColumn("mr", F.rank().over(ranks) + (F.count(F.lit(1)).over(same) - 1) / 2)
    d = d.withColumn("k", F.sum(y).over(Window.partitionBy(unit)))
    b = d.select(unit, tie, "mr", "k", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("perm"))
    order = F.md5(F.concat_ws(":", F.col(tie), F.col("perm").cast("string")))
    b = b.withColumn("rn", F.row_number().over(Window.partitionBy(unit, "perm").orderBy(order)))
    null = b.where("rn <= k").groupBy("perm").agg(F.sum("mr").alias("t"))
    seen = d.agg(F.sum(F.when(F.col(y) == 1, F.col("mr")).otherwise(0)).alias("observed"))
    hit = null.join(seen).agg(F.first("observed").alias("observed"), F.count_if(F.col("t") >= F.col("observed")).alias("n_at_least"), F.count(F.lit(1)).alias("n"))
    return hit.select("observed", "n_at_least", ((F.col("n_at_least") + 1) / (F.col("n") + 1)).alias("p_value"))


def benjamini_hochberg(df: DataFrame, p: str, key: str, family: list[str]) -> DataFrame:
    """df with q: the least p m / rank at or above each row's rank, inside each family."""
    w = Window.partitionBy(*family)
    d = df.withColumn("_r", F.row_number().over(w.orderBy(p, key))).withColumn("_m", F.count(p).over(w))
    back = w.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(back))).drop("_r", "_m")


def holm(df: DataFrame, p: str, key: str, family: list[str]) -> DataFrame:
    w = Window.partitionBy(*family)
    d = df.withColumn("_r", F.row_number().over(w.orderBy(p, key))).withColumn("_m", F.count(p).over(w))
    up = w.orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.withColumn("holm", F.least(F.lit(1.0), F.max(F.col(p) * (F.col("_m") - F.col("_r") + 1)).over(up))).drop("_r", "_m")


def stratified_sample(df: DataFrame, strata: list[str], n: int, key: str, seed: str = "42") -> DataFrame:
    """n rows of each stratum by the hash of a unique key; smaller strata come whole."""
    order = Window.partitionBy(*strata).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), key)
    return df.withColumn("draw_order", F.row_number().over(order)).where(F.col("draw_order") <= n)


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """(group, fold): whole groups in k folds by hash; a function of the group alone, so no fold map has to be sent."""
    return df.select(group).where(F.col(group).isNotNull()).distinct().withColumn("fold", (F.conv(F.substring(F.md5(group), 1, 8), 16, 10).cast("long") % k).cast("int"))


def subset_draws(attempts: DataFrame, unit: str, attempt: str, k: int, n_subsets: int) -> DataFrame:
    """attempts with `subset`: the first k of each unit's attempts in each of n_subsets hash orders."""
    d = attempts.withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(n_subsets - 1))))
    order = Window.partitionBy(unit, "subset").orderBy(F.md5(F.concat_ws(":", F.col(attempt), F.col("subset").cast("string"))), attempt)
    return d.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def row_bootstrap(df: DataFrame, key: str, cell: str, value: str, weight: str, n_draws: int) -> DataFrame:
    """(estimate, lo, hi, undefined) of a weighted mean with rows drawn inside cells; key is a unique long.

    Rows first become counts per (cell, value, weight): what is drawn is how often each such class comes, so the work
    depends on the classes and draws, not on the rows.
    """
    classes = df.groupBy(F.col(cell).alias("_c"), F.col(value).alias("_v"), F.col(weight).alias("_g")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("unit"))
    w = draws(classes.select("unit"), "unit", n_draws)
    # the sum of n Poisson(1) weights, as its normal limit for large n, at least 0
    spread = F.greatest(F.lit(0.0), F.col("n") + F.sqrt("n") * (F.col("w") - 1))
    by = classes.join(w, "unit").groupBy("draw").agg(F.sum(spread * F.col("_g")).alias("d"), F.sum(spread * F.col("_g") * F.col("_v")).alias("u"))
    v = by.select(F.when(F.col("d") > 0, F.col("u") / F.col("d")).alias("v"))
    est = classes.agg((F.sum(F.col("n") * F.col("_g") * F.col("_v")) / F.sum(F.col("n") * F.col("_g"))).alias("estimate"))
    return est.join(v.agg(F.percentile("v", 0.025).alias("lo"), F.percentile("v", 0.975).alias("hi"), F.count_if(F.col("v").isNull()).alias("undefined")))
