"""Intervals, permutations, multiplicity, samples and best-of-k over the scored runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.operators import metrics as M
from runloom.operators import resampling as R
from runloom.operators import selection as S
from runloom.plans.base import SCORED_SQL, rounded, scored
from runloom.plans.ranking import _RANK, _U

N_DRAWS, N_PERM, N_SUB = 1000, 1000, 200  # the reference's
_NUM = "('0x' || substr(md5(task_id), 1, 7))::BIGINT"


def _unit(c="task_id"):
    return F.conv(F.substring(F.md5(c), 1, 7), 16, 10).cast("long")


def _q(make, sql, merge=False):
    return (lambda spark, d: rounded(make(scored(spark, d, merge)))), f"WITH {SCORED_SQL}\n{sql}" if sql else ""


def _stats(d):
    """Concordance of two scores per task: the sufficient statistics of every draw."""
    parts = [M.group_pairs(d, "y", s, "task_id").withColumn("model", F.lit(s)) for s in ("score", "n_steps")]
    return parts[0].union(parts[1]).where("pairs > 0").withColumn("unit", _unit())


_HASH = f"((({{u}} * {R._A} + draw * {R._B} + {R._C}) % {R._M}) * (({{u}} * {R._A} + draw * {R._B} + {R._C}) % {R._M})) % {R._M} / {R._M}.0"
_STATS_SQL = ", st AS (" + " UNION ALL ".join(f"SELECT '{s}' AS model, {_NUM} AS unit, {_U}::DOUBLE AS c, (sum(y) * (count(*) - sum(y)))::DOUBLE AS n FROM (SELECT task_id, y, {_RANK.format('task_id', s)} AS mr FROM d) GROUP BY task_id HAVING sum(y) * (count(*) - sum(y)) > 0" for s in ("score", "n_steps")) + f"), dr AS (SELECT unit, draw, {_HASH.format(u='unit')} AS u FROM (SELECT DISTINCT unit FROM st), range(0, {N_DRAWS}) r(draw)), w AS (SELECT unit, draw, " + " + ".join(f"(u >= {p})::INT" for p in R.POISSON) + " AS w FROM dr)"


def _share(d):
    g = d.groupBy("task_id").agg(F.sum("y").alias("num"), F.count(F.lit(1)).alias("den")).withColumn("unit", _unit()).withColumn("model", F.lit("failed share"))
    return R.cluster_bootstrap(g, "unit", "num", "den", "model", N_DRAWS)


def _pvalues(d):
    """A p-value per combo: sign test of its failed share against one half."""
    g = d.groupBy("combo", "source").agg(F.sum("y").alias("k"), F.count(F.lit(1)).alias("n"))
    return g.select("combo", "source", F.round(M.binomial_tail(F.col("k"), F.col("n")), 9).alias("p"), F.concat_ws("/", "combo", "source").alias("key"))


_P_SQL = ", g AS (SELECT combo, source, sum(y) AS k, count(*) AS n FROM d GROUP BY combo, source), pv AS (SELECT combo, source, concat_ws('/', combo, source) AS key, round(least(1, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM range(0, 20000) x(i) WHERE i BETWEEN greatest(k, n - k) AND n)), 9) AS p FROM g)"


def _attempts(d):
    return d.withColumn("solved", 1 - F.col("y")).select("task_id", "run_id", "solved", "score", F.col("finished").alias("submitted"), (F.col("n_err") < 4).cast("int").alias("done"))


def _rules(d):
    return S.rule_values(R.subset_draws(_attempts(d), "task_id", "run_id", 3, N_SUB), "task_id", "solved", "score", "submitted", "done")


_RULES = ["random", "submitted", "lowest_risk", "finished", "finished_lowest", "oracle"]
_RULES_SQL = f""", a AS (SELECT task_id, run_id, 1 - y AS solved, score, finished AS submitted, (n_err < 4)::INT AS done FROM d),
sb AS (SELECT a.*, subset FROM a, range(0, {N_SUB}) r(subset) QUALIFY row_number() OVER (PARTITION BY task_id, subset ORDER BY md5(concat_ws(':', run_id, subset::VARCHAR)), run_id) <= 3),
lo AS (SELECT *, min(score) FILTER (submitted = 1) OVER (PARTITION BY task_id, subset) AS low, min(score) FILTER (done = 1) OVER (PARTITION BY task_id, subset) AS flow FROM sb),
v AS (SELECT task_id, subset, avg(solved) AS random, coalesce(avg(solved) FILTER (submitted = 1), avg(solved)) AS submitted, coalesce(avg(solved) FILTER (submitted = 1 AND score = low), avg(solved)) AS lowest_risk,
      coalesce(avg(solved) FILTER (done = 1), avg(solved)) AS finished, coalesce(avg(solved) FILTER (done = 1 AND score = flow), avg(solved)) AS finished_lowest, max(solved)::DOUBLE AS oracle FROM lo GROUP BY task_id, subset)"""

_MD5_SAMPLE = "md5(concat_ws(':', '42', run_id)), run_id"

QUERIES = {
    "bootstrap_ci_cluster": _q(lambda d: R.cluster_bootstrap(_stats(d), "unit", "concordant", "pairs", "model", N_DRAWS), f"{_STATS_SQL}, b AS (SELECT model, draw, sum(w * c) / sum(w * n) AS v FROM st JOIN w USING (unit) GROUP BY model, draw), e AS (SELECT model, sum(c) / sum(n) AS estimate FROM st GROUP BY model) SELECT e.model, round(any_value(estimate), 6) AS estimate, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM b JOIN e USING (model) GROUP BY e.model"),
    "bootstrap_paired_diff": _q(lambda d: R.paired_difference(_stats(d), "unit", "concordant", "pairs", "model", "score", "n_steps", N_DRAWS, tests=3), f"{_STATS_SQL}, b AS (SELECT draw, sum(w * c) FILTER (model = 'score') / sum(w * n) FILTER (model = 'score') - sum(w * c) FILTER (model = 'n_steps') / sum(w * n) FILTER (model = 'n_steps') AS v FROM st JOIN w USING (unit) GROUP BY draw), i AS (SELECT quantile_cont(v, 0.05 / 6) AS lo, quantile_cont(v, 1 - 0.05 / 6) AS hi, (count(*) FILTER (v <= 0) + 1) / (count(*) + 1) AS p FROM b) SELECT round((SELECT sum(c) FILTER (model = 'score') / sum(n) FILTER (model = 'score') - sum(c) FILTER (model = 'n_steps') / sum(n) FILTER (model = 'n_steps') FROM st), 6) AS difference, round(lo, 6) AS lo, round(hi, 6) AS hi, round(p, 6) AS p_value, CASE WHEN lo > 0 THEN 'gain' WHEN hi < 0 THEN 'loss' ELSE 'not shown' END AS verdict FROM i"),
    "bootstrap_fold_auroc": _q(lambda d: R.fold_auroc_difference(d.withColumn("unit", _unit()), "y", "score", "n_steps", "unit", "fold", N_DRAWS), ""),
    "bootstrap_fold_diff": _q(lambda d: R.paired_difference(_stats(d).withColumn("fold", F.conv(F.substring(F.md5("task_id"), 1, 8), 16, 10).cast("long") % 5), "unit", "concordant", "pairs", "model", "score", "n_steps", N_DRAWS, strata="fold"), "", merge=True),
    "bootstrap_share": _q(_share, f", st AS (SELECT {_NUM} AS unit, sum(y) AS c, count(*) AS n FROM d GROUP BY task_id), dr AS (SELECT unit, draw, {_HASH.format(u='unit')} AS u FROM (SELECT DISTINCT unit FROM st), range(0, {N_DRAWS}) r(draw)), b AS (SELECT draw, sum(w * c) / sum(w * n) AS v FROM (SELECT unit, draw, " + " + ".join(f"(u >= {p})::INT" for p in R.POISSON) + " AS w FROM dr) JOIN st USING (unit) GROUP BY draw) SELECT 'failed share' AS model, (SELECT round(sum(c) / sum(n), 6) FROM st) AS estimate, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM b"),
    "permutation_within_unit": _q(
        lambda d: R.permutation_null(d, "y", "score", "task_id", "run_id", N_PERM),
        f", m AS (SELECT task_id, run_id, y, {_RANK.format('task_id', 'score')} AS mr, sum(y) OVER (PARTITION BY task_id) AS k FROM d), b AS (SELECT m.*, perm, row_number() OVER (PARTITION BY task_id, perm ORDER BY md5(concat_ws(':', run_id, perm::VARCHAR))) AS rn FROM m, range(0, {N_PERM}) r(perm)), t AS (SELECT perm, sum(mr) AS t FROM b WHERE rn <= k GROUP BY perm), o AS (SELECT sum(CASE WHEN y = 1 THEN mr ELSE 0 END) AS obs FROM m) SELECT round(any_value(obs)::DOUBLE, 6) AS observed, count(*) FILTER (t >= obs) AS n_at_least, round((count(*) FILTER (t >= obs) + 1) / (count(*) + 1), 6) AS p_value FROM t, o",
    ),
    "bh_qvalues": _q(lambda d: R.benjamini_hochberg(_pvalues(d), "p", "key", ["source"]).drop("key"), f"{_P_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p, key) AS r, count(*) OVER (PARTITION BY source) AS m FROM pv) SELECT combo, source, round(p, 6) AS p, round(least(1.0, min(p * m / r) OVER (PARTITION BY source ORDER BY r DESC)), 6) AS q FROM r"),
    "holm_adjust": _q(lambda d: R.holm(_pvalues(d), "p", "key", ["source"]).drop("key"), f"{_P_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p, key) AS r, count(*) OVER (PARTITION BY source) AS m FROM pv) SELECT combo, source, round(p, 6) AS p, round(least(1.0, max(p * (m - r + 1)) OVER (PARTITION BY source ORDER BY r)), 6) AS holm FROM r"),
    "stratified_sample": _q(lambda d: R.stratified_sample(d, ["source", "y"], 5, "run_id").select("run_id", "source", "y", "draw_order"), f"SELECT run_id, source, y, row_number() OVER (PARTITION BY source, y ORDER BY {_MD5_SAMPLE})::INTEGER AS draw_order FROM d QUALIFY draw_order <= 5"),
    "group_fold_map": _q(lambda d: R.group_folds(d, "task_id"), "SELECT DISTINCT task_id, (('0x' || substr(md5(task_id), 1, 8))::BIGINT % 5)::INTEGER AS fold FROM d"),
    "attempt_checks": _q(lambda d: S.check_attempts(_attempts(d), "task_id", "run_id"), ", g AS (SELECT task_id, count(*) n, count(DISTINCT run_id) u, count(*) - count(run_id) z FROM d GROUP BY task_id), t AS (SELECT count(*) FILTER (n <> u + z) AS repeated, count(*) FILTER (z > 0) AS unnamed FROM g) SELECT 'repeated' AS check, repeated AS failed FROM t UNION ALL SELECT 'unnamed', unnamed FROM t UNION ALL SELECT 'empty', 0 FROM t"),
    "best_of_k": _q(_rules, f"{_RULES_SQL} SELECT task_id, subset::INTEGER AS subset, " + ", ".join(f"round({r}, 6) AS {r}" for r in _RULES) + " FROM v"),
    "gap_closed": _q(lambda d: S.pooled_rules(_rules(d), "task_id", _RULES, 3), f"{_RULES_SQL}, u AS (SELECT task_id, " + ", ".join(f"avg({r}) AS {r}" for r in _RULES) + " FROM v GROUP BY task_id), m AS (SELECT " + ", ".join(f"avg({r}) AS {r}" for r in _RULES) + " FROM u) " + " UNION ALL ".join(f"SELECT '{r}' AS rule, round({r}, 6) AS solved, round(100 * ({r} - submitted), 6) AS delta_pp, CASE WHEN oracle > submitted THEN round(({r} - submitted) / (oracle - submitted), 6) END AS gap_closed FROM m" for r in _RULES)),
}
