"""Ranking and agreement metrics over the scored runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import metrics as M
from runloom.plans.base import SCORED_SQL, rounded, scored


def _q(make, sql: str):
    return (lambda spark, d: rounded(make(scored(spark, d)))), f"WITH {SCORED_SQL}\n{sql}"


_PAIRS = "p AS (SELECT f.run_id, f.task_id, CASE WHEN f.score > s.score THEN 1.0 WHEN f.score = s.score THEN 0.5 ELSE 0.0 END AS w, f.finished AS ff, s.finished AS sf, f.st AS fst, s.st AS sst FROM e f JOIN e s ON f.task_id = s.task_id WHERE f.y = 1 AND s.y = 0)"
_E = "e AS (SELECT *, avg(y) OVER (PARTITION BY combo) AS st FROM d)"


def _strength(d):
    d = d.join(d.groupBy("combo").agg(F.avg("y").alias("st")), "combo")
    gap = F.col("f_st") - F.col("s_st")
    label = F.when(F.abs(gap) <= 0.05, "similar").when(gap > 0, "failed weaker").otherwise("failed stronger")
    return M.class_pairs(d, "y", "score", "task_id", ["st"], label)


def _sets(d):
    label = F.when((F.col("f_finished") == 1) & (F.col("s_finished") == 1), "FF").when((F.col("f_finished") == 0) & (F.col("s_finished") == 0), "UU").otherwise("FU")
    return M.class_pairs(d, "y", "score", "task_id", ["finished"], label)


_P = "1 / (1 + exp(1 - 4 * score))"


def _prob(d):
    return d.withColumn("p", 1 / (1 + F.exp(1 - 4 * F.col("score"))))


_FEATS = ["n_steps", "n_err", "n_rows", "n_tools", "score"]
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT y, '{f}' AS feature, {f}::DOUBLE AS v FROM d" for f in _FEATS) + ")"
_U = "(sum(CASE WHEN y = 1 THEN mr ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0)"
_RANK = "rank() OVER (PARTITION BY {0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1) / 2.0"
_TOP = "r AS (SELECT *, row_number() OVER (ORDER BY score DESC, run_id) AS rn, count(*) OVER () AS n, sum(y) OVER () AS pos FROM d), k AS (SELECT unnest([0.05, 0.1, 0.2, 0.3]) AS rate)"


def _sign(d):
    e = M.rank_effects(d, "y", "score", "task_id").where("effect <> 0")
    t = e.agg(F.count_if(F.col("effect") > 0).alias("up"), F.count(F.lit(1)).alias("tasks"))
    return t.select("up", "tasks", (F.greatest("up", F.col("tasks") - F.col("up")) / F.col("tasks")).alias("majority"), M.binomial_tail(F.col("up"), F.col("tasks")).alias("p_value"))


def _a_ratio(d):
    s = M.within_auroc(d, "y", "score", "task_id").select(F.col("pooled").alias("s"))
    st = d.join(d.groupBy("combo").agg(F.avg("y").alias("st")), "combo")
    m = M.within_auroc(st, "y", "st", "task_id").select(F.col("pooled").alias("m"))
    return m.join(s).select("m", "s", ((F.col("m") - 0.5) / (F.col("s") - 0.5)).alias("a_ratio"))


def _unit_scores(d):
    u = d.groupBy("task_id").pivot("y", [0, 1]).agg(F.avg("score"))
    pair = F.when(F.col("1").isNull() | F.col("0").isNull(), None).when(F.col("1") > F.col("0"), 1.0).when(F.col("1") == F.col("0"), 0.5).otherwise(0.0)
    return u.select(pair.alias("s")).agg(F.count("s").alias("units"), F.avg("s").alias("excluding_missing"), F.avg(F.coalesce("s", F.lit(0.5))).alias("missing_as_tie"))



QUERIES = {
    "auroc_global": _q(lambda d: M.auroc(d, "y", "score"), f"SELECT count(*) AS n, sum(y)::BIGINT AS n_pos, round({_U} / (sum(y) * (count(*) - sum(y))), 6) AS auroc FROM (SELECT y, {_RANK.format('1', 'score')} AS mr FROM d)"),
    "auroc_within_group": _q(
        lambda d: M.within_auroc(d, "y", "score", "task_id"),
        f", g AS (SELECT task_id, {_U} AS c, sum(y) * (count(*) - sum(y)) AS n FROM (SELECT task_id, y, {_RANK.format('task_id', 'score')} AS mr FROM d) GROUP BY task_id) SELECT count(*) AS groups, sum(n)::DOUBLE AS pairs, round(sum(c) / sum(n), 6) AS pooled, round(avg(c / n), 6) AS macro FROM g WHERE n > 0",
    ),
    "auroc_by_group": _q(
        lambda d: M.group_pairs(d, "y", "score", "combo").where("pairs > 0").select("combo", "pairs", (F.col("concordant") / F.col("pairs")).alias("auroc")),
        f", g AS (SELECT combo, {_U} AS c, sum(y) * (count(*) - sum(y)) AS n FROM (SELECT combo, y, {_RANK.format('combo', 'score')} AS mr FROM d) GROUP BY combo) SELECT combo, n::DOUBLE AS pairs, round(c / n, 6) AS auroc FROM g WHERE n > 0",
    ),
    "auroc_pairs_by_strength": _q(_strength, f", {_E}, {_PAIRS} SELECT CASE WHEN abs(fst - sst) <= 0.05 THEN 'similar' WHEN fst > sst THEN 'failed weaker' ELSE 'failed stronger' END AS pair_set, count(*) AS n, sum(w)::DOUBLE AS concordant, round(sum(w) / count(*), 6) AS auroc FROM p GROUP BY 1"),
    "auroc_pair_sets_masked": _q(_sets, f", {_E}, {_PAIRS} SELECT CASE WHEN ff = 1 AND sf = 1 THEN 'FF' WHEN ff = 0 AND sf = 0 THEN 'UU' ELSE 'FU' END AS pair_set, count(*) AS n, sum(w)::DOUBLE AS concordant, round(sum(w) / count(*), 6) AS auroc FROM p GROUP BY 1"),
    "auroc_by_feature": _q(lambda d: M.feature_aurocs(d, "y", _FEATS), f", {_LONG}, g AS (SELECT feature, {_U} / (sum(y) * (count(*) - sum(y))) AS a FROM (SELECT feature, y, {_RANK.format('feature', 'v')} AS mr FROM long) GROUP BY feature) SELECT feature, round(a, 6) AS auroc, round(abs(a - 0.5), 6) AS strength FROM g"),
    "auroc_fold_averaged": _q(lambda d: M.fold_auroc(d, "y", "score", "fold"), f", g AS (SELECT fold, {_U} AS c, sum(y) * (count(*) - sum(y)) AS n FROM (SELECT fold, y, {_RANK.format('fold', 'score')} AS mr FROM d) GROUP BY fold) SELECT count(*) AS folds, round(avg(c / n), 6) AS auroc FROM g WHERE n > 0"),
    "average_precision": _q(lambda d: M.average_precision(d, "y", "score"), ", g AS (SELECT score, sum(y) AS pos, count(*) AS n FROM d GROUP BY score), c AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn FROM g) SELECT round(sum(pos * cp / cn) / sum(pos), 6) AS ap FROM c"),
    "precision_at_budget": _q(lambda d: M.precision_at(d, "y", "score", "run_id", [0.05, 0.1, 0.2, 0.3]), f", {_TOP} SELECT rate::DOUBLE AS rate, greatest(1, ceil(round(rate * n, 9)))::BIGINT AS k, sum(y)::BIGINT AS found, round(sum(y) / greatest(1, ceil(round(rate * n, 9))), 6) AS precision, round(sum(y) / max(pos), 6) AS recall FROM r, k WHERE rn <= greatest(1, ceil(round(rate * n, 9))) GROUP BY rate, n"),
    "precision_tie_expected": _q(
        lambda d: M.precision_tie_expected(d, "y", "score", [0.05, 0.1, 0.2, 0.3]),
        ", g AS (SELECT score, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM d GROUP BY score), c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn, sum(n) OVER () AS a, sum(pos) OVER () AS ap FROM g), k AS (SELECT unnest([0.05, 0.1, 0.2, 0.3]) AS rate), h AS (SELECT rate, greatest(1.0, ceil(round(rate * a, 9)))::DOUBLE AS k, c.* FROM c, k) SELECT rate::DOUBLE AS rate, k, round(cp - pos + (k - (cn - n)) * pos / n, 6) AS hits, round((cp - pos + (k - (cn - n)) * pos / n) / k, 6) AS precision, round((cp - pos + (k - (cn - n)) * pos / n) / ap, 6) AS recall FROM h WHERE cn >= k AND cn - n < k",
    ),
    "recall_lift_by_fold": _q(
        lambda d: M.fold_budget(d, "y", "score", "fold", "run_id", 0.1),
        ", r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, run_id) AS rn, greatest(1, ceil(round(0.1 * count(*) OVER (PARTITION BY fold), 9))) AS k FROM d), g AS (SELECT fold, count(*) FILTER (rn <= k) AS checked, sum(CASE WHEN rn <= k THEN y ELSE 0 END)::BIGINT AS found, sum(y) AS pos, count(*) AS n FROM r GROUP BY fold) SELECT fold::INTEGER AS fold, checked, found, checked - found AS wasted, round(found / checked, 6) AS precision, round(found / pos, 6) AS recall, round((found / checked) / (pos / n), 6) AS lift FROM g",
    ),
    "brier_score": _q(lambda d: M.brier(_prob(d), "y", "p"), f"SELECT round(avg(pow({_P} - y, 2)), 6) AS brier FROM d"),
    "calibration_bins": _q(lambda d: M.calibration(_prob(d), "y", "p", "run_id"), f", b AS (SELECT y, {_P} AS p, ntile(10) OVER (ORDER BY {_P}, run_id) AS bin FROM d) SELECT bin::INTEGER AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS observed FROM b GROUP BY bin"),
    "rank_effect_by_task": _q(lambda d: M.rank_effects(d, "y", "score", "task_id"), f", g AS (SELECT task_id, {_U}::DOUBLE AS u, (sum(y) * (count(*) - sum(y)))::DOUBLE AS pairs FROM (SELECT task_id, y, {_RANK.format('task_id', 'score')} AS mr FROM d) GROUP BY task_id) SELECT task_id, u, pairs, round(2 * u / pairs - 1, 6) AS effect FROM g WHERE pairs > 0"),
    "direction_sign_test": _q(_sign, f", g AS (SELECT task_id, {_U} AS u, sum(y) * (count(*) - sum(y)) AS n FROM (SELECT task_id, y, {_RANK.format('task_id', 'score')} AS mr FROM d) GROUP BY task_id), t AS (SELECT count(*) FILTER (2 * u > n) AS up, count(*) AS tasks FROM g WHERE n > 0 AND 2 * u <> n) SELECT up, tasks, round(greatest(up, tasks - up) / tasks, 6) AS majority, round(least(1, 2 * (SELECT sum(exp(lgamma(tasks + 1) - lgamma(i + 1) - lgamma(tasks - i + 1) - tasks * ln(2))) FROM range(0, 100000) x(i) WHERE i BETWEEN greatest(up, tasks - up) AND tasks)), 6) AS p_value FROM t"),
    "spearman_midrank": _q(lambda d: M.spearman(d, "n_steps", "score"), ", r AS (SELECT rank() OVER (ORDER BY n_steps) + (count(*) OVER (PARTITION BY n_steps) - 1) / 2.0 AS a, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS b FROM d) SELECT round(corr(a, b), 6) AS spearman FROM r"),
    "mutual_information": _q(lambda d: M.mutual_information(d, "finished", "y"), ", j AS (SELECT finished a, y b, count(*) / sum(count(*)) OVER () AS p FROM d GROUP BY 1, 2), h AS (SELECT (SELECT sum(-p * log2(p)) FROM j) AS ab, (SELECT sum(-p * log2(p)) FROM (SELECT sum(p) p FROM j GROUP BY a)) AS a, (SELECT sum(-p * log2(p)) FROM (SELECT sum(p) p FROM j GROUP BY b)) AS b) SELECT round(a + b - ab, 6) AS bits, round((a + b - ab) / b, 6) AS share FROM h"),
    "agreement_kappa": _q(lambda d: M.agreement(d.withColumn("flag", (F.col("score") > 0.15).cast("int")), "flag", "y"), ", a AS (SELECT count(*) AS n, avg((CASE WHEN score > 0.15 THEN 1 ELSE 0 END = y)::INT) AS o, avg(CASE WHEN score > 0.15 THEN 1 ELSE 0 END) AS p, avg(y) AS q FROM d) SELECT n, round(o, 6) AS observed, round((o - (p * q + (1 - p) * (1 - q))) / (1 - (p * q + (1 - p) * (1 - q))), 6) AS kappa, round(2 * o - 1, 6) AS pabak FROM a"),
    "claim_gap": _q(
        lambda d: M.gap(d, "finished", "y", "combo"),
        ", g AS (SELECT combo, avg(finished) FILTER (y = 1) - avg(finished) FILTER (y = 0) AS g, count(*) AS n FROM d GROUP BY combo) SELECT (SELECT round(avg(finished) FILTER (y = 1) - avg(finished) FILTER (y = 0), 6) FROM d) AS pooled, (SELECT round(sum(g * n) / sum(n), 6) FROM g WHERE g IS NOT NULL) AS stratified",
    ),
    "smd_and_ks": _q(
        lambda d: M.mean_shift(d, "y", _FEATS),
        f", {_LONG}, m AS (SELECT feature, (avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0)) / sqrt((var_samp(v) FILTER (y = 1) + var_samp(v) FILTER (y = 0)) / 2) AS smd, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM long GROUP BY feature), c AS (SELECT feature, v, count(*) FILTER (y = 1) AS c1, count(*) FILTER (y = 0) AS c0 FROM long GROUP BY feature, v), e AS (SELECT feature, abs(sum(c1) OVER w / n1 - sum(c0) OVER w / n0) AS gap, smd FROM c JOIN m USING (feature) WINDOW w AS (PARTITION BY feature ORDER BY v)) SELECT feature, round(any_value(smd), 6) AS smd, round(max(gap), 6) AS ks FROM e GROUP BY feature",
    ),
    "pearson_matrix": _q(lambda d: M.pearson(d, _FEATS), " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM d" for a in sorted(_FEATS) for b in sorted(_FEATS) if a < b)),
    "advantage_ratio": _q(_a_ratio, f", {_E}, " + ", ".join(f"g{c} AS (SELECT task_id, {_U} AS c, sum(y) * (count(*) - sum(y)) AS n FROM (SELECT task_id, y, {_RANK.format('task_id', v)} AS mr FROM e) GROUP BY task_id)" for c, v in (("s", "score"), ("m", "st"))) + ", x AS (SELECT (SELECT sum(c) / sum(n) FROM gm WHERE n > 0) AS m, (SELECT sum(c) / sum(n) FROM gs WHERE n > 0) AS s) SELECT round(m, 6) AS m, round(s, 6) AS s, round((m - 0.5) / (s - 0.5), 6) AS a_ratio FROM x"),
    "unit_pair_scores": _q(_unit_scores, ", u AS (SELECT avg(score) FILTER (y = 1) AS a, avg(score) FILTER (y = 0) AS b FROM d GROUP BY task_id), s AS (SELECT CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a > b THEN 1.0 WHEN a = b THEN 0.5 ELSE 0.0 END AS s FROM u) SELECT count(s) AS units, round(avg(s), 6) AS excluding_missing, round(avg(coalesce(s, 0.5)), 6) AS missing_as_tie FROM s"),
    "class_metrics": _q(
        lambda d: d.groupBy("source", "y").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.percentile("score", 0.5).alias("median_score"), F.avg("finished").alias("finished_share")),
        "SELECT source, y, count(*) AS n, round(avg(score), 6) AS mean_score, round(quantile_cont(score, 0.5), 6) AS median_score, round(avg(finished), 6) AS finished_share FROM d GROUP BY source, y",
    ),
    "scope_profile": _q(
        lambda d: d.rollup("source").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("failed"), F.avg(F.when(F.col("n_err") > 0, F.col("y"))).alias("failed_given_error")).select(F.coalesce("source", F.lit("all")).alias("scope"), "n", "failed", "failed_given_error"),
        "SELECT coalesce(source, 'all') AS scope, count(*) AS n, round(avg(y), 6) AS failed, round(avg(y) FILTER (n_err > 0), 6) AS failed_given_error FROM d GROUP BY ROLLUP (source)",
    ),
    "detector_weighted": _q(
        lambda d: d.groupBy("combo").agg(F.count(F.lit(1)).alias("big"), F.count_if(F.col("fold") < 3).alias("n"), F.sum(F.when((F.col("fold") < 3) & (F.col("n_err") > 2) & (F.col("y") == 1), 1).otherwise(0)).alias("tp"), F.sum(F.when((F.col("fold") < 3) & (F.col("n_err") > 2), 1).otherwise(0)).alias("pp"), F.sum(F.when((F.col("fold") < 3) & (F.col("y") == 1), 1).otherwise(0)).alias("p")).where("n > 0").withColumn("w", F.col("big") / F.col("n"))
        .agg((F.sum(F.col("w") * F.col("tp")) / F.sum(F.col("w") * F.col("pp"))).alias("precision"), (F.sum(F.col("w") * F.col("tp")) / F.sum(F.col("w") * F.col("p"))).alias("recall"), (F.sum(F.col("w") * F.col("p")) / F.sum(F.col("w") * F.col("n"))).alias("true_share")),
        ", g AS (SELECT combo, count(*) AS big, count(*) FILTER (fold < 3) AS n, count(*) FILTER (fold < 3 AND n_err > 2 AND y = 1) AS tp, count(*) FILTER (fold < 3 AND n_err > 2) AS pp, count(*) FILTER (fold < 3 AND y = 1) AS p FROM d GROUP BY combo), w AS (SELECT *, big / n AS w FROM g WHERE n > 0) SELECT round(sum(w * tp) / sum(w * pp), 6) AS precision, round(sum(w * tp) / sum(w * p), 6) AS recall, round(sum(w * p) / sum(w * n), 6) AS true_share FROM w",
    ),
}

