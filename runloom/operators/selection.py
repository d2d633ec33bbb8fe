"""Best-of-k selection over repeated attempts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rule_values(subsets: DataFrame, unit: str, solved: str, risk: str, submitted: str, finished: str) -> DataFrame:
    """(unit, subset, random, submitted, lowest_risk, finished, finished_lowest, oracle): expected solved share of each
    rule in each subset, exact over ties. A rule without candidates falls back on all attempts of the subset."""
    base = subsets.groupBy(unit, "subset").agg(
        F.avg(solved).alias("random"),
        F.avg(F.when(F.col(submitted) == 1, F.col(solved))).alias("s"),
        F.max(solved).cast("double").alias("oracle"),
        F.min(F.when(F.col(submitted) == 1, F.col(risk))).alias("low"),
        F.avg(F.when(F.col(finished) == 1, F.col(solved))).alias("f"),
        F.min(F.when(F.col(finished) == 1, F.col(risk))).alias("flow"),
    )
    at = subsets.join(base, [unit, "subset"]).groupBy(unit, "subset").agg(
        F.first("random").alias("random"), F.first("s").alias("s"), F.first("f").alias("f"), F.first("oracle").alias("oracle"),
        F.avg(F.when((F.col(submitted) == 1) & (F.col(risk) == F.col("low")), F.col(solved))).alias("l"),
        F.avg(F.when((F.col(finished) == 1) & (F.col(risk) == F.col("flow")), F.col(solved))).alias("fl"),
    )
    some = lambda c: F.coalesce(c, F.col("random"))
    return at.select(unit, "subset", "random", some(F.col("s")).alias("submitted"), some(F.col("l")).alias("lowest_risk"), some(F.col("f")).alias("finished"), some(F.col("fl")).alias("finished_lowest"), "oracle")


def pooled_rules(values: DataFrame, unit: str, rules: list[str], k: int, base: str = "submitted") -> DataFrame:
    """(rule, solved, delta_pp, gap_closed): mean over units of the mean over subsets; gain over base in points and as a
    share of what the oracle would gain. values are rule_values() of subsets of at most k attempts with solved 0 or 1.

    Values are counted in whole parts, so that totals and what is rounded later don't depend on the order of rows.
    """
    names, parts = sorted({*rules, base, "oracle"}), math.lcm(*range(1, k + 1))
    per = values.where("oracle is not null").groupBy(unit).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.round(F.col(r) * parts).cast("long")).alias(r) for r in names])
    # subset_draws makes as many subsets for each unit, so there is one n and each quotient below is of whole numbers
    by = per.groupBy("n").agg(F.count(F.lit(1)).alias("units"), *[F.sum(r).alias(r) for r in names])
    m = by.agg(F.sort_array(F.collect_list(F.struct("n", "units", *names))).alias("x"), F.max("n").alias("most"), F.sum("units").alias("units"))

    def total(r):
        return F.aggregate("x", F.lit(0.0), lambda acc, t: acc + t[r] * F.col("most") / t["n"]).alias(r)

    m = m.select((F.col("most") * F.col("units") * parts).alias("of"), *map(total, names))
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("solved")) for r in rules])
    x = m.select("of", F.col(base).alias("b"), F.col("oracle").alias("o"), F.explode(rows).alias("x")).select("of", "b", "o", "x.*")
    more = F.col("solved") - F.col("b")
    return x.select("rule", (F.col("solved") / F.col("of")).alias("solved"), (100 * more / F.col("of")).alias("delta_pp"), F.when(F.col("o") > F.col("b"), more / (F.col("o") - F.col("b"))).alias("gap_closed"))


def check_attempts(attempts: DataFrame, unit: str, attempt: str) -> DataFrame:
    """(check, failed): the constraints an attempt table must meet, with how many units break each."""
    g = attempts.groupBy(unit).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(attempt).alias("d"), F.count_if(F.col(attempt).isNull()).alias("z"))
    t = g.agg(F.count_if(F.col("n") != F.col("d") + F.col("z")).alias("repeated"), F.count_if(F.col("z") > 0).alias("unnamed"), F.count_if(F.col("n") < 1).alias("empty"))
    return t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("failed")) for c in ("repeated", "unnamed", "empty")])).alias("x")).select("x.*")
