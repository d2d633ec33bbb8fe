"""Sequence features of ordered events: windows per entity, one shuffle by entity for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(run: str, pos: str):
    return Window.partitionBy(run).orderBy(pos)


def entropy(df: DataFrame, run: str, gram: str, states: int) -> DataFrame:
    """(run, entropy): entropy of the grams of a run over the log of the number of possible grams."""
    c = df.where(F.col(gram).isNotNull()).groupBy(run, gram).agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(run)))
    return c.groupBy(run).agg((F.sum(-F.col("p") * F.log2("p")) / F.log2(F.lit(float(states)))).alias("entropy"))


def grams(df: DataFrame, run: str, pos: str, state: str, n: int) -> DataFrame:
    """df with `gram`: the state and the n - 1 after it, joined; null where the run ends first."""
    w = _over(run, pos)
    parts = [F.col(state), *[F.lead(state, i).over(w) for i in range(1, n)]]
    d = df.withColumn("_last", parts[-1])
    return d.withColumn("gram", F.when(F.col("_last").isNotNull(), F.concat_ws(">", *parts))).drop("_last")


def transitions(df: DataFrame, run: str, pos: str, state: str) -> DataFrame:
    """(run, n_transitions, n_changes)."""
    prev = F.lag(state).over(_over(run, pos))
    d = df.select(run, F.col(state), prev.alias("_p"))
    return d.groupBy(run).agg(F.count("_p").alias("n_transitions"), F.count_if(F.col("_p") != F.col(state)).alias("n_changes"))


def loop_features(df: DataFrame, run: str, pos: str, sig: str, windows: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """(run, n, distinct_ratio, repeat_ratio, repeat_in_window_k..., max_run_length) of a run's signatures.

    A null signature repeats nothing and ends a stretch. Windows hold at most 10 signatures, so rows stay small.
    """
    w = _over(run, pos)
    d = df.select(run, pos, sig, F.lag(sig).over(w).alias("_p"), *[F.array_contains(F.collect_list(sig).over(w.rowsBetween(-k, -1)), F.col(sig)).alias(f"_w{k}") for k in windows])
    same = F.coalesce(F.col("_p") == F.col(sig), F.lit(False))
    d = d.withColumn("_island", F.sum(F.when(same, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = d.groupBy(run, "_island").agg(F.count(F.lit(1)).alias("n"), F.count(sig).alias("k"), F.count_if(same).alias("r"), *[F.count_if(F.col(f"_w{k}")).alias(f"w{k}") for k in windows])
    kinds = df.groupBy(run).agg(F.count_distinct(sig).alias("kinds"))
    per = islands.groupBy(run).agg(F.sum("n").alias("n"), F.sum("r").alias("r"), *[F.sum(f"w{k}").alias(f"w{k}") for k in windows], F.max(F.when(F.col("k") > 0, F.col("n")).otherwise(0)).alias("max_run_length"))
    n = F.col("n")
    return per.join(kinds, run).select(run, "n", (F.col("kinds") / n).alias("distinct_ratio"), F.when(n > 1, F.col("r") / (n - 1)).alias("repeat_ratio"), *[(F.col(f"w{k}") / n).alias(f"repeat_in_window_{k}") for k in windows], "max_run_length")


def revisit_ratio(df: DataFrame, run: str, pos: str, target: str) -> DataFrame:
    """(run, touched, revisit_ratio): share of events whose target the run had touched before."""
    d = df.where(F.col(target).isNotNull()).withColumn("_first", F.min(pos).over(Window.partitionBy(run, target)))
    return d.groupBy(run).agg(F.count(F.lit(1)).alias("touched"), F.avg((F.col("_first") < F.col(pos)).cast("double")).alias("revisit_ratio"))


def around_last(df: DataFrame, run: str, pos: str, kind: str, mark: str, check: str) -> DataFrame:
    """(run, n_mark, n_check, n_check_after, check_after_last, check_before_first, share_before_first)."""
    at = lambda k: F.when(F.col(kind) == k, F.col(pos))
    w = Window.partitionBy(run)
    d = df.withColumn("_last", F.max(at(mark)).over(w)).withColumn("_first", F.min(at(mark)).over(w))
    after, before = F.col(pos) > F.col("_last"), F.col(pos) < F.col("_first")
    is_check = F.col(kind) == check
    return d.groupBy(run).agg(
        F.count_if(F.col(kind) == mark).alias("n_mark"), F.count_if(is_check).alias("n_check"), F.count_if(is_check & after).alias("n_check_after"),
        F.max((is_check & after).cast("int")).alias("check_after_last"), F.max((is_check & before).cast("int")).alias("check_before_first"),
        (F.count_if(before) / F.count(F.lit(1))).alias("share_before_first"),
    )


def unresolved_failure(df: DataFrame, run: str, pos: str, failed: Column, passed: Column) -> DataFrame:
    """(run, unresolved_fail): whether a failure comes after the last pass, or there is a failure and no pass."""
    g = df.groupBy(run).agg(F.max(F.when(passed, F.col(pos))).alias("p"), F.max(F.when(failed, F.col(pos))).alias("f"))
    return g.select(run, F.coalesce((F.col("f") > F.coalesce("p", F.lit(-1))).cast("int"), F.lit(0)).alias("unresolved_fail"))


def prefix_features(df: DataFrame, run: str, pos: str, step: str, size: str, n: int) -> DataFrame:
    """(run, n_steps, n_frag, total_chars, mean_len) over the completed steps in a run's first n fragments."""
    d = df.withColumn("_i", F.row_number().over(_over(run, pos))).where(F.col("_i") <= n)
    d = d.withColumn("_top", F.max(step).over(Window.partitionBy(run)))
    return d.groupBy(run).agg(F.count_distinct(F.when(F.col(step) < F.col("_top"), F.col(step))).alias("n_steps"), F.count(F.lit(1)).alias("n_frag"), F.sum(size).alias("total_chars"), F.avg(size).alias("mean_len"))


def step_back(df: DataFrame, run: str, pos: str, text: str, back: int = 3, least: int = 30) -> DataFrame:
    """(run, pos, text): the last text with at least `least` characters among the last back + 1; runs without one are
    left out."""
    d = df.withColumn("_r", F.row_number().over(Window.partitionBy(run).orderBy(F.desc(pos)))).where((F.col("_r") <= back + 1) & (F.length(text) >= least))
    return d.groupBy(run).agg(F.min_by(F.struct(pos, text), "_r").alias("m")).select(run, "m.*")


def ordinal_patterns(df: DataFrame, run: str, pos: str, value: str, dim: int = 3) -> DataFrame:
    """df with `pattern`: the order type of `dim` consecutive values, ties by place; null at a run's end."""
    w = _over(run, pos)
    values = [F.col(value), *[F.lead(value, i).over(w) for i in range(1, dim)]]
    pairs = F.array_sort(F.array(*[F.struct(v.alias("v"), F.lit(i).alias("i")) for i, v in enumerate(values)]))
    d = df.withColumn("_last", values[-1])
    return d.withColumn("pattern", F.when(F.col("_last").isNotNull(), F.concat_ws("", F.transform(pairs, lambda x: x["i"].cast("string"))))).drop("_last")


def complexity(df: DataFrame, run: str, pos: str, value: str, dim: int = 3) -> DataFrame:
    """(run, h, c, fisher): permutation entropy, Jensen-Shannon complexity and Fisher information of a series.

    Fisher information sums over neighbouring patterns in lexicographic order.
    """
    n_states = 1
    for i in range(2, dim + 1):
        n_states *= i
    d = ordinal_patterns(df, run, pos, value, dim).where("pattern is not null").groupBy(run, "pattern").agg(F.count(F.lit(1)).alias("n"))
    p = d.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(run)))
    g = p.groupBy(run).agg(F.sum(-F.col("p") * F.log("p")).alias("s"), F.map_from_entries(F.collect_list(F.struct("pattern", "p"))).alias("m"))
    import itertools

    states = ["".join(map(str, s)) for s in itertools.permutations(range(dim))]
    at = [F.coalesce(F.element_at("m", s), F.lit(0.0)) for s in states]
    u = 1.0 / n_states
    ent = lambda x: F.when(x > 0, -x * F.log(x)).otherwise(0.0)
    mixed = sum((ent((x + u) / 2) for x in at), F.lit(0.0))
    import math

    top = math.log(n_states)
    q0 = -2 / (((n_states + 1) / n_states) * math.log(n_states + 1) - 2 * math.log(2 * n_states) + math.log(n_states))
    js = mixed - F.col("s") / 2 - top / 2
    fisher = sum((F.pow(F.sqrt(b) - F.sqrt(a), 2) for a, b in zip(at, at[1:])), F.lit(0.0))
    edge = (at[0] == 1) | (at[-1] == 1)
    return g.select(run, (F.col("s") / top).alias("h"), (q0 * js * F.col("s") / top).alias("c"), (F.when(edge, 1.0).otherwise(0.5) * fisher).alias("fisher"))


def lag_one(df: DataFrame, run: str, pos: str, value: str) -> DataFrame:
    """(run, n, r1, ljung_box): lag-1 autocorrelation and the Ljung-Box statistic n (n + 2) r1^2 / (n - 1)."""
    w, whole = _over(run, pos), Window.partitionBy(run)
    d = df.where(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.avg(value).over(whole))
    d = d.withColumn("_p", F.lag("_d").over(w))
    g = d.groupBy(run).agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("_d") * F.col("_p")) / F.sum(F.col("_d") * F.col("_d"))).alias("r1"))
    return g.where("n > 2 and r1 is not null").select(run, "n", "r1", (F.col("n") * (F.col("n") + 2) * F.col("r1") * F.col("r1") / (F.col("n") - 1)).alias("ljung_box"))


def sessions(df: DataFrame, key: str, ts: str, tie: str, gap_seconds: int) -> DataFrame:
    """(key, session, first, last, n): events of a key cut where the pause exceeds the gap."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    new = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp")) > gap_seconds * 1_000_000, F.lit(True))
    d = df.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(key, "session").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"))
