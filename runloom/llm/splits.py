"""Splits that keep related records together: components, balanced bins, whole bins to splits."""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom import scratch
from runloom.llm.groups import connected_groups

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
N_BINS = 100
BLOCK_GROUPS = 100_000
FAN_IN = 64


def difference_bins(tuples: np.ndarray) -> np.ndarray:
    """Bin of every slot: combine weight tuples (one row each, N_BINS slots) by largest differencing.

    Taken out again and again are the two tuples whose largest and least slot differ most; the heavy slots of one go
    with the light slots of the other, which leaves one tuple fewer, until one is left: the equal bins.
    """
    n, k = tuples.shape
    order = np.argsort(-tuples, axis=1, kind="stable")
    sums = list(np.take_along_axis(tuples, order, 1))
    content = [[(i, order[i])] for i in range(n)]
    tick = count(n)
    heap = [(-(s[0] - s[-1]), i, i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    joins: dict[int, tuple[int, int, np.ndarray, np.ndarray]] = {}
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        total = sums[a] + sums[b][::-1]
        by = np.argsort(-total, kind="stable")
        sums.append(total[by])
        sums[a] = sums[b] = None
        new = len(sums) - 1
        joins[new] = (a, b, by, k - 1 - by)
        heapq.heappush(heap, (-(sums[new][0] - sums[new][-1]), next(tick), new))
    bins = np.empty((n, k), dtype=np.int64)
    todo = [(heap[0][2], np.arange(k))] if heap else []
    while todo:  # place holds the bin of each slot of the tuple, heaviest slot first
        at, place = todo.pop()
        if at in joins:
            a, b, from_a, from_b = joins[at]
            pa, pb = np.empty(k, dtype=np.int64), np.empty(k, dtype=np.int64)
            pa[from_a], pb[from_b] = place, place
            todo += [(a, pa), (b, pb)]
        else:
            i, slots = content[at][0]
            bins[i, slots] = place
    return bins


def _bins_of_groups(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    rows = rows.sort_values(["weight", "group_id"], ascending=[False, True], kind="stable")
    weights = rows["weight"].to_numpy(np.float64)
    padded = np.zeros(-(-len(weights) // k) * k)
    padded[: len(weights)] = weights
    rows["slot"] = difference_bins(padded.reshape(-1, k)).ravel()[: len(weights)]
    return rows[["kind", "group_id", "weight", "block", "slot"]]


def _bins_of_blocks(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    blocks = np.sort(rows["block"].unique())
    at = {b: i for i, b in enumerate(blocks)}
    tuples = np.zeros((len(blocks), k))
    tuples[rows["block"].map(at), rows["slot"]] = rows["weight"]
    bins = difference_bins(tuples)
    out = rows[["kind", "block", "slot", "weight"]].copy()
    out["new_slot"] = bins[rows["block"].map(at), rows["slot"]]
    out["new_block"] = out["block"] // FAN_IN
    return out


def _splits_of_bins(rows: pd.DataFrame, proportions: dict[str, float]) -> pd.DataFrame:
    """Whole bins, heaviest first, each to the split that lacks most of its share."""
    rows = rows.sort_values(["weight", "slot"], ascending=[False, True], kind="stable")
    total, names = rows["weight"].sum(), list(proportions)
    lacks = np.array([proportions[x] * total for x in names], dtype=float)
    out = []
    for w in rows["weight"]:
        best = int(np.argmax(lacks))
        lacks[best] -= w
        out.append(names[best])
    rows["split"] = out
    return rows[["kind", "slot", "split"]]


def balanced_splits(weights: DataFrame, proportions: dict[str, float] | None = None, bins: int = N_BINS) -> DataFrame:
    """(kind, group_id, bin, split) for rows (kind, group_id, weight), one row a group; each kind is split on its own.

    Largest differencing in the blocks of a tree: every block of about BLOCK_GROUPS groups is differenced into `bins`
    slots inside one task, then the slot weights of FAN_IN blocks at a time, up to one block, whose slots are the bins.
    A group heavier than a bin has a bin to itself. No task holds more than a block, and the driver holds nothing.
    """
    proportions = proportions or PROPORTIONS
    weights = scratch.table(weights.select("kind", "group_id", F.col("weight").cast("double").alias("weight")), "weights")
    blocks = max(1, -(-weights.count() // BLOCK_GROUPS))
    placed = weights.withColumn("block", F.pmod(F.xxhash64("group_id"), F.lit(blocks)))
    placed = scratch.table(placed.groupBy("kind", "block").applyInPandas(lambda p: _bins_of_groups(p, bins), "kind string, group_id string, weight double, block long, slot long"), "slots")
    sums = placed.groupBy("kind", "block", "slot").agg(F.sum("weight").alias("weight"))
    maps = []
    while blocks > 1:
        step = sums.withColumn("over", F.expr(f"block div {FAN_IN}")).groupBy("kind", "over").applyInPandas(lambda p: _bins_of_blocks(p, bins), "kind string, block long, slot long, weight double, new_slot long, new_block long")
        maps.append(step := scratch.table(step, "step"))
        sums = step.groupBy("kind", F.col("new_block").alias("block"), F.col("new_slot").alias("slot")).agg(F.sum("weight").alias("weight"))
        blocks = -(-blocks // FAN_IN)
    last = sums.groupBy("kind").applyInPandas(lambda p: _splits_of_bins(p, proportions), "kind string, slot long, split string")
    for step in maps:
        placed = placed.join(step.select("kind", "block", "slot", "new_block", "new_slot"), ["kind", "block", "slot"]).select("kind", "group_id", "weight", F.col("new_block").alias("block"), F.col("new_slot").alias("slot"))
    return placed.join(last, ["kind", "slot"]).select("kind", "group_id", F.col("slot").alias("bin"), "split")


def entity_key(c):
    """What spellings of one name share: its letters and digits in lower case. Null where none are left."""
    key = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    return F.when(key != "", key)


def together(records: DataFrame, links: DataFrame, proportions: dict[str, float] | None = None, bins: int = N_BINS) -> DataFrame:
    """records (kind, key, ...) with group_id, bin and split added; one group never has two splits.

    links (a, b) say that two keys are one entity, directly or over others; keys without a link are groups by themselves.
    Rows whose key is null belong to no entity; all of a kind share the group ''. Weights are row counts, so a split's
    share of rows is near its proportion, as far as whole groups allow: a group with more rows than a split's share still
    stays whole. Repeated rows count as rows. Columns besides kind and key pass through; group_id, bin and split replace
    columns of those names. No records give no rows.
    """
    records = records.drop("group_id", "bin", "split")
    counted = records.groupBy("kind", F.coalesce("key", F.lit("")).alias("key")).agg(F.count(F.lit(1)).alias("weight"))
    named = connected_groups(links, "a", "b").withColumnRenamed("node", "key")
    grouped = scratch.table(counted.join(named, "key", "left").select("kind", "key", F.coalesce("group_id", "key").alias("group_id"), "weight"), "grouped")
    splits = balanced_splits(grouped.groupBy("kind", "group_id").agg(F.sum("weight").alias("weight")), proportions, bins)
    entity = grouped.drop("weight").join(splits, ["kind", "group_id"])
    out = records.withColumn("_key", F.coalesce("key", F.lit(""))).join(entity.withColumnRenamed("key", "_key"), ["kind", "_key"]).drop("_key")
    return out


def project_records(folds: DataFrame, metrics: DataFrame, tasks: DataFrame, proportions: dict[str, float] | None = None) -> DataFrame:
    """Every row of folds (kind `task`) and of e7_metrics (kind `population`) with its group and split.

    given is the assignment that the row carries: the fold, or the split name.
    """
    folds = folds.select(F.lit("task").alias("kind"), entity_key(F.col("task_id")).alias("key"), F.col("fold_row").alias("row_id"), F.col("fold").cast("string").alias("given"), F.lit(None).cast("string").alias("spelled"))
    population = F.array_join(F.filter(F.split(F.lower("population"), r"[^\p{L}\p{N}]+"), lambda x: x != ""), "_")
    metrics = metrics.select(F.lit("population").alias("kind"), entity_key(F.col("population")).alias("key"), F.col("metric_id").alias("row_id"), F.col("split_name").alias("given"), population.alias("spelled"))
    links = tasks.select(entity_key(F.col("task_id")).alias("a"), entity_key(F.col("former_id")).alias("b"))
    return together(folds.unionByName(metrics), links, proportions)


def torn(records: DataFrame, tasks: DataFrame) -> DataFrame:
    """(field, entity): groups whose rows carry two or more different given assignments, nulls aside."""
    groups = records.where("group_id <> ''").groupBy("kind", "group_id").agg(F.min("given").alias("lo"), F.max("given").alias("hi"), F.max(F.struct(F.length("spelled"), "spelled")).alias("spelled")).where("lo <> hi")
    named = tasks.select(entity_key(F.col("task_id")).alias("key"), "task_id").where("key is not null").distinct()
    of_tasks = records.where("kind = 'task'").select("key", "group_id").where("key is not null").distinct()
    former = tasks.select(entity_key(F.col("former_id")).alias("key"), entity_key(F.col("task_id")).alias("present")).where("key is not null and present is not null")
    # a task's group is that of its present name or, where no row uses that, of its former name
    known = of_tasks.select(F.col("key").alias("present"), "group_id").union(of_tasks.join(former, "key").select("present", "group_id")).distinct()
    tasks_torn = named.join(known.withColumnRenamed("present", "key"), "key").join(groups.where("kind = 'task'").select("group_id"), "group_id").select(F.lit("task").alias("field"), F.col("task_id").alias("entity"))
    return tasks_torn.distinct().union(groups.where("kind = 'population'").select(F.lit("population").alias("field"), F.col("spelled.spelled").alias("entity")))


def balance(records: DataFrame, proportions: dict[str, float] | None = None) -> DataFrame:
    """(kind, n_rows, no_split, torn_groups, balanced): what must hold of together() for each kind.

    balanced: no split has more rows off its proportion than one bin holds, a bin being a hundredth of the rows or the
    heaviest group, whichever is more: whole groups allow no better.
    """
    proportions = proportions or PROPORTIONS
    groups = records.groupBy("kind", "group_id", "split").agg(F.count(F.lit(1)).alias("n"))
    torn = groups.groupBy("kind", "group_id").agg(F.sum("n").alias("n"), (F.count(F.lit(1)) > 1).alias("torn"))
    off = F.greatest(*[F.abs(F.sum(F.when(F.col("split") == x, F.col("n")).otherwise(0)) - p * F.sum("n")) for x, p in proportions.items()])
    sums = groups.groupBy("kind").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("split").isNull(), F.col("n")).otherwise(0)).alias("no_split"), off.alias("off"))
    heaviest = torn.groupBy("kind").agg(F.count_if("torn").alias("torn_groups"), F.max("n").alias("heaviest"))
    return sums.join(heaviest, "kind").select("kind", "n_rows", "no_split", "torn_groups", (F.col("off") <= F.greatest(F.ceil(F.col("n_rows") / N_BINS), F.col("heaviest"))).alias("balanced"))
