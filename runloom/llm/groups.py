"""Consolidating pairwise matches into groups: connected components by low-diameter decomposition."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom import scratch

ROUNDS = 4  # rounds of growth in one job
ONE_TASK = 5_000  # edges that one task decomposes by itself, by the same method and with the same start times


def _start(vertex, level: int, beta: float):
    """Start time of a vertex: less an exponential shift, fixed by id and level. Only differences of start times matter."""
    uniform = (F.shiftrightunsigned(F.xxhash64(vertex, F.lit(level)), 11).cast("double") + 1) / F.lit(float(2**53))
    return F.log(uniform) / F.lit(beta)


def clusters(edges: DataFrame, level: int, beta: float) -> DataFrame:
    """One low-diameter decomposition: (v, c) for every vertex of edges (s, d).

    A vertex goes to the centre for which start time plus distance is least, itself included. Clusters grow round by
    round until no vertex changes. No shift exceeds log(n) / beta by much, so neither do radius and number of rounds,
    however long the group is. ROUNDS rounds make one job, whose plan uses the state once a round, and whose result is
    written; the partitioning by vertex that a round leaves serves the next one's join.
    """
    none = F.lit(None).cast("struct<k: double, c: long>")
    both = edges.union(edges.select("d", "s")).withColumn("w", F.lit(1.0))
    vertices = both.select(F.col("s").alias("v")).distinct()
    reach = scratch.table(both.union(vertices.select("v", "v", F.lit(0.0))), "reach")
    state = vertices.select("v", F.struct(_start(F.col("v"), level, beta).alias("k"), F.col("v").alias("c")).alias("best"))
    changed = 1
    while changed:
        grown = state.withColumn("old", F.col("best"))
        for _ in range(ROUNDS):
            sent = reach.join(grown.withColumnRenamed("v", "s"), "s").select(F.col("d").alias("v"), F.struct((F.col("best.k") + F.col("w")).alias("k"), F.col("best.c").alias("c")).alias("best"), F.when(F.col("w") == 0, F.col("old")).otherwise(none).alias("old"))
            grown = sent.groupBy("v").agg(F.min("best").alias("best"), F.max("old").alias("old"))
        new, changed = scratch.counted(grown, F.count_if(F.col("best") < F.col("old")), "state")
        scratch.forget(state)
        state = new.select("v", "best")
        state._runloom_path = new._runloom_path
    scratch.forget(reach)
    return state.select("v", F.col("best.c").alias("c"))


def start_time(vertex: int, level: int, beta: float) -> float:
    """_start() of one vertex outside a plan."""
    import xxhash

    seed = xxhash.xxh64_intdigest(vertex.to_bytes(8, "little", signed=True), 42)
    bits = xxhash.xxh64_intdigest(level.to_bytes(4, "little"), seed)
    return math.log(((bits >> 11) + 1.0) / 2.0**53) / beta


def grow(edges: list[tuple[int, int]], level: int, beta: float) -> dict[int, int]:
    """clusters() of few edges: the clusters grow in the order of their times of arrival."""
    near: dict[int, list[int]] = {}
    for s, d in edges:
        near.setdefault(s, []).append(d)
        near.setdefault(d, []).append(s)
    waiting = [(start_time(v, level, beta), v, v) for v in near]
    heapq.heapify(waiting)
    of: dict[int, int] = {}
    while waiting:
        k, c, v = heapq.heappop(waiting)
        if v not in of:
            of[v] = c
            for u in near[v]:
                if u not in of:
                    heapq.heappush(waiting, (k + 1.0, c, u))
    return of


def _recursion(level: int, beta: float):
    """All further levels inside one task: grow, contract, go on with the edges between clusters, compose."""

    def decompose(rows: pd.DataFrame) -> pd.DataFrame:
        edges, at, maps = list(zip(rows["s"].tolist(), rows["d"].tolist())), level, []
        while edges:
            maps.append(of := grow(edges, at, beta))
            edges, at = sorted({(min(of[s], of[d]), max(of[s], of[d])) for s, d in edges if of[s] != of[d]}), at + 1
        roots = maps.pop()
        while maps:
            roots = {v: roots.get(c, c) for v, c in maps.pop().items()}
        return pd.DataFrame({"v": list(roots), "c": list(roots.values())})

    return decompose


def connected_groups(pairs: DataFrame, a: str, b: str, *, beta: float = 0.2) -> DataFrame:
    """(node, group_id) for every node in a pair with another node; group_id = least node of the group in byte order.

    Low-diameter decomposition: clusters grow from exponentially shifted start times, each cluster is contracted to one
    vertex, and the same is done to the edges between clusters until none are left; then the assignments are composed,
    last level first. An edge is cut with a probability of at most about beta, so each level leaves a fraction of the
    edges. What is left when at most ONE_TASK edges are left is decomposed in the same way, level by level, inside one task.

    Pairs with a null end or with equal ends link nothing; repeated and reversed pairs count once; other columns of
    pairs are ignored; no pairs give no rows. A vertex with very many edges only makes a join partition large, which
    adaptive execution splits, and the messages to one vertex are combined before they are shuffled.
    """
    spark = pairs.sparkSession
    links = pairs.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).where("a is not null and b is not null and a <> b")
    links = scratch.table(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    # the ids are fixed by being written: a later read sees the same ids whatever is lost
    nodes = scratch.table(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("v", F.monotonically_increasing_id()), "nodes")
    edges = links.join(nodes.select(F.col("node").alias("a"), F.col("v").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.col("v").alias("y")), "b")
    one = F.count(F.lit(1))
    edges, n = scratch.counted(edges.select(F.least("x", "y").alias("s"), F.greatest("x", "y").alias("d")), one, "edges")
    scratch.forget(links)
    maps: list[DataFrame] = []
    while n > ONE_TASK:
        maps.append(of := clusters(edges, len(maps), beta))
        left = edges.join(of.select(F.col("v").alias("s"), F.col("c").alias("x")), "s").join(of.select(F.col("v").alias("d"), F.col("c").alias("y")), "d").where("x <> y")
        between, n = scratch.counted(left.select(F.least("x", "y").alias("s"), F.greatest("x", "y").alias("d")).distinct(), one, "edges")
        scratch.forget(edges)
        edges = between
    if n:
        maps.append(edges.groupBy(F.lit(0).alias("one")).applyInPandas(_recursion(len(maps), beta), "v long, c long"))
    roots = maps.pop() if maps else spark.createDataFrame([], "v long, c long")
    while maps:
        lower = maps.pop()
        roots = lower.join(roots.select(F.col("v").alias("c"), F.col("c").alias("r")), "c", "left").select("v", F.coalesce("r", "c").alias("c"))
    member = scratch.table(nodes.join(roots, "v").select("node", "c"), "members")
    least = member.groupBy("c").agg(F.min("node").alias("group_id"))
    return member.join(least, "c").select("node", "group_id")


def same_pairs(run_pairs: DataFrame) -> DataFrame:
    """The pairs of two different runs that a verdict of `same` links; ids lower-cased and stripped of surrounding space."""
    def clean(c):
        return F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))

    verdict = F.lower(F.regexp_replace("verdict", r"(?U)^\s+|\s+$", ""))
    return run_pairs.where(verdict == "same").select(clean("run_id_a").alias("a"), clean("run_id_b").alias("b")).where("a <> '' and b <> '' and a <> b")
