"""Relational operators with their constraints: checked lookups, leave-one-out, gates, comparisons, groups of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom import scratch


def finished(steps: DataFrame) -> DataFrame:
    """(run_id, finished): whether a run's last message is an assistant's, has text and calls no tool."""
    last = steps.groupBy("run_id").agg(F.max_by(F.struct("role", "text", "tool_calls"), F.struct("pos", -F.col("step_id"))).alias("m"))
    done = F.lower(F.trim("m.role")).isin("assistant", "agent", "ai") & (F.coalesce(F.trim("m.text"), F.lit("")) != "") & (F.coalesce(F.size("m.tool_calls"), F.lit(0)) <= 0)
    return last.select("run_id", done.cast("int").alias("finished"))


def usable_columns(df: DataFrame, by: str) -> DataFrame:
    """(by, column_name, present, usable): columns with two or more values inside each group; one pass for all."""
    cols = [c for c in df.columns if c != by]
    row = df.groupBy(by).agg(*[F.count(c).alias(f"n_{c}") for c in cols], *[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols])
    parts = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_{c}").alias("present"), F.coalesce(F.col(f"lo_{c}") != F.col(f"hi_{c}"), F.lit(False)).alias("usable")) for c in cols])
    return row.select(by, F.explode(parts).alias("x")).select(by, "x.*")


def firing(df: DataFrame, trivial: dict[str, float], least: float) -> DataFrame:
    """(feature, share, kept): how often a feature differs from its trivial value."""
    row = df.agg(*[F.avg((F.col(c) != v).cast("int")).alias(c) for c, v in trivial.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("share"), (F.col(c) >= least).alias("kept")) for c in trivial])).alias("x")).select("x.*")


def acceptance(df: DataFrame, group: str, label: str, groups: int, rows: int) -> DataFrame:
    g = df.where(F.col(label).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), (F.min(label) < F.max(label)).alias("both"))
    return g.agg(F.count_if("both").alias("both_class"), F.sum("n").alias("n")).withColumn("accepted", (F.col("both_class") >= groups) & (F.col("n") >= rows))


def median_gate(df: DataFrame, n: str) -> DataFrame:
    m = df.agg(F.percentile(n, 0.5).alias("median"))
    return m.withColumn("decision", F.when(F.col("median") >= 200, "200,4").when(F.col("median") >= 100, "100,4").when(F.col("median") >= 50, "50,3 biased").otherwise("untested"))


def logit(p: Column, edge: float = 0.001) -> Column:
    q = F.greatest(F.lit(edge), F.least(F.lit(1 - edge), p))
    return F.log(q / (1 - q))


def left_lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Left equi-join to a dimension that must have unique keys: a repeated one fails the query where it is met.

    No broadcast hint: the planner broadcasts the dimension if its size allows it.
    """
    checked = dim.groupBy(dim_key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[c for c in dim.columns if c != dim_key])).alias("_d"))
    ok = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(dim_key).cast("string")))).otherwise(F.col("_n"))
    checked = checked.withColumn("_n", ok).where("_n = 1").select(dim_key, "_d.*")
    return df.join(checked, F.col(key) == F.col(dim_key), "left").drop(dim_key)


def coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, n): keys of one table that the other lacks, both ways in one pass."""
    k = a.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).union(b.select(key, F.lit(0), F.lit(1))).groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    t = k.agg(F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("lo"), F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("ro"))
    return t.select(F.explode(F.array(F.struct(F.lit("left only").alias("side"), F.col("lo").alias("n")), F.struct(F.lit("right only").alias("side"), F.col("ro").alias("n")))).alias("x")).select("x.*")


def set_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    k = a.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).union(b.select(key, F.lit(0), F.lit(1))).groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    parts = {"both": (F.col("l") + F.col("r")) == 2, "left": F.col("l") > F.col("r"), "right": F.col("r") > F.col("l"), "union": F.lit(True)}
    t = k.agg(*[F.count_if(c).alias(p) for p, c in parts.items()])
    return t.select(F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("n")) for p in parts])).alias("x")).select("x.*")


def leave_one_out(df: DataFrame, y: str, group: str, by: str) -> DataFrame:
    """df with difficulty: mean of y over the group without the rows that share `by`; the overall mean if none is left."""
    g, b = Window.partitionBy(group), Window.partitionBy(group, by)
    overall = F.broadcast(df.agg(F.avg(y).alias("_m")))  # one row
    n = F.count(y).over(g) - F.count(y).over(b)
    s = F.coalesce(F.sum(y).over(g), F.lit(0)) - F.coalesce(F.sum(y).over(b), F.lit(0))
    return df.join(overall).withColumn("difficulty", F.when(n > 0, s / n).otherwise(F.col("_m"))).drop("_m")


def compare_tables(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(left_only, right_only, different, max_abs) of one numeric column by key."""
    j = a.select(F.col(key).alias("ka"), F.col(value).alias("va")).join(b.select(F.col(key).alias("kb"), F.col(value).alias("vb")), F.col("ka") == F.col("kb"), "full")
    diff = F.abs(F.col("va") - F.col("vb"))
    return j.agg(F.count_if(F.col("kb").isNull()).alias("left_only"), F.count_if(F.col("ka").isNull()).alias("right_only"), F.count_if(diff > 1e-9).alias("different"), F.max(diff).alias("max_abs"))


def identical_noise(df: DataFrame, unit: str, same: str, failed: str) -> DataFrame:
    """(pairs, discordant, discordance, epsilon) of rows of a unit with the same content, counted without pairing."""
    g = df.where(F.col(same).isNotNull()).groupBy(unit, same).agg(F.count(F.lit(1)).cast("double").alias("m"), F.sum(failed).cast("double").alias("f"))
    t = g.agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("pairs"), F.sum(F.col("f") * (F.col("m") - F.col("f"))).alias("discordant"))
    d = F.col("discordant") / F.col("pairs")
    return t.select("pairs", "discordant", d.alias("discordance"), F.when(d <= 0.5, (1 - F.sqrt(1 - 2 * d)) / 2).alias("epsilon"))


def patch_noise(attempts: DataFrame, unit: str, patch: str, failed: str) -> DataFrame:
    """One row: what labels of attempts with the same patch say about label noise, over all attempts of a unit.

    identical_pairs counts pairs of a unit's attempts whose patches agree byte for byte (outer space aside, empty ones
    left out), labelled_pairs those where both labels are known, discordant those with different labels; discordance and
    epsilon follow from these. within_pairs counts (failed, solved) pairs of a unit's labelled attempts, also without
    patch; s is the share of them that have one patch, ceiling = 1 - s / 2. Counted from groups, no pair is made.
    """
    text = F.regexp_replace(patch, r"^\s+|\s+$", "")
    known = F.count(failed).cast("double")
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    d = attempts.where(F.col(unit).isNotNull()).withColumn("_h", F.when((text != "") & (text != "None"), F.sha1(text)))
    g = d.groupBy(unit, "_h").agg(F.count(F.lit(1)).cast("double").alias("n"), known.alias("m"), F.coalesce(F.sum(failed), F.lit(0)).cast("double").alias("f"))
    same = g.where("_h is not null").agg(F.coalesce(pairs("n"), F.lit(0.0)).alias("identical_pairs"), F.coalesce(pairs("m"), F.lit(0.0)).alias("labelled_pairs"), F.coalesce(F.sum(F.col("f") * (F.col("m") - F.col("f"))), F.lit(0.0)).alias("discordant"))
    u = g.groupBy(unit).agg(F.sum("m").alias("m"), F.sum("f").alias("f"))
    whole = u.agg(F.coalesce(F.sum(F.col("f") * (F.col("m") - F.col("f"))), F.lit(0.0)).alias("within_pairs"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    t = same.join(whole).withColumn("discordance", share("discordant", "labelled_pairs")).withColumn("s", share("discordant", "within_pairs"))
    eps = F.when(F.col("discordance").isNotNull(), (1 - F.sqrt(F.greatest(F.lit(0.0), 1 - 2 * F.col("discordance")))) / 2)
    return t.select("identical_pairs", "labelled_pairs", "discordant", "discordance", eps.alias("epsilon"), "within_pairs", "s", (1 - F.col("s") / 2).alias("ceiling"))


def anova_shares(df: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """(a_share, b_share, within_share): variance of group means by either factor, and pooled inside cells, over the whole.

    Everything comes from the cells' counts, sums and squares; no row is joined back.
    """
    v = F.col(y).cast("double")
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    whole = cells.agg(F.sum("n").alias("N"), F.sum("s").alias("S"), F.sum("q").alias("Q")).select((F.col("S") / F.col("N")).alias("m"), (F.col("Q") / F.col("N") - F.pow(F.col("S") / F.col("N"), 2)).alias("v"))

    def between(by, name):
        g = cells.groupBy(by).agg(F.sum("n").alias("n"), F.sum("s").alias("s")).join(F.broadcast(whole))
        return g.agg((F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("m"), 2)) / F.sum("n") / F.first("v")).alias(name))

    ss = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    within = cells.where("n > 1").agg((F.sum(ss) / F.sum(F.col("n") - 1)).alias("w")).join(whole).select((F.coalesce("w", F.lit(0.0)) / F.col("v")).alias("within_share"))
    return between(a, "a_share").join(between(b, "b_share")).join(within)


def linked_groups(df: DataFrame, entity: str, identifier: str, max_rounds: int = 60) -> DataFrame:
    """(entity, group_id): entities that share identifiers, directly or over others; group_id is the least entity.

    Labels pass between entities and identifiers as minima, each round written, until nothing changes; a shared
    identifier is a star, never pairs. Entities without identifiers are groups by themselves.
    """
    links = scratch.table(df.select(F.col(entity).alias("e"), F.col(identifier).alias("i")).where("e is not null").distinct(), "links")
    labels = links.groupBy("e").agg(F.min("e").alias("g"))
    labels = scratch.table(labels, "labels")
    for _ in range(max_rounds):
        by_id = links.where("i is not null").join(labels, "e").groupBy("i").agg(F.min("g").alias("g"))
        reach = links.join(by_id, "i").groupBy("e").agg(F.min("g").alias("n"))
        step = labels.join(reach, "e", "left").select("e", F.least("g", F.coalesce("n", "g")).alias("g"), F.col("g").alias("was"))
        # a label's own label: paths halve each round
        up = step.select(F.col("e").alias("g"), F.col("g").alias("gg"))
        nxt = scratch.table(step.join(up, "g", "left").select("e", F.least("g", F.coalesce("gg", "g")).alias("g"), "was"), "labels")
        changed = nxt.where("g <> was").limit(1).count()
        scratch.forget(labels)
        labels = nxt.drop("was")
        labels._runloom_path = nxt._runloom_path
        if not changed:
            break
    else:
        raise RuntimeError("links need more rounds than max_rounds")
    return labels.select(F.col("e").alias(entity), F.col("g").alias("group_id"))
