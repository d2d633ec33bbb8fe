"""Frequent subsequences across many sequences: closed patterns by bidirectional extension, gaps allowed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom import scratch
from runloom.llm.roles import speaker

BLOCK_SEQUENCES = 8192


class Block:
    """Sequences laid end to end, with pseudo-projections: a pattern's instances are positions, nothing is copied.

    values holds the items of all sequences, offsets their bounds. after[p, a] is the first place at or after p, within
    p's own sequence, of item a; before[p, a] the last place before p. Every sequence is followed by one empty place.
    """

    def __init__(self, values: np.ndarray, offsets: np.ndarray, n_items: int):
        lengths = np.diff(offsets)
        n = len(lengths)
        self.n, self.n_items = n, n_items
        self.first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
        self.last = self.first + lengths
        size = int((lengths + 1).sum())
        events = np.full(size, -1, dtype=np.int32)
        owner = np.repeat(np.arange(n), lengths + 1)
        inner = np.ones(size, dtype=bool)
        inner[self.last] = False
        events[inner] = values[offsets[0] : offsets[-1]] if n else []
        self.none = size
        place = np.arange(size, dtype=np.int32)
        end, begin = self.last[owner], self.first[owner]
        self.after = np.empty((size, n_items), dtype=np.int32)
        self.before = np.empty((size, n_items), dtype=np.int32)
        for a in range(n_items):
            at = np.where(events == a, place, size)
            nxt = np.minimum.accumulate(at[::-1])[::-1]
            self.after[:, a] = np.where(nxt < end, nxt, size)
            at = np.where(events == a, place, -1)
            prev = np.concatenate([[-1], np.maximum.accumulate(at)[:-1]])
            self.before[:, a] = np.where(prev >= begin, prev, -1)

    def _common(self, low: np.ndarray, high: np.ndarray) -> bool:
        """Whether some item lies in [low, high) of every sequence."""
        alive = None
        for i in range(0, len(low), 256):  # most patterns fail within the first rows
            has = (self.after[low[i : i + 256]] < high[i : i + 256, None]).all(axis=0)
            alive = has if alive is None else alive & has
            if not alive.any():
                return False
        return alive is not None

    def extendable(self, pattern: list[int], firsts: list[np.ndarray], rows: np.ndarray, semi: bool) -> bool:
        """Backward extension check, or with semi the backscan over semi-maximum periods, behind the first item.

        firsts[i] are the places of item i in the first instance. The period before item i runs from the end of the
        first instance of the items before it to the item's latest place (semi: to its latest place inside the first
        instance). Before the first item lies another partition.
        """
        top = firsts[-1] if semi else self.before[self.last[rows], pattern[-1]]
        for i in range(len(pattern) - 1, 0, -1):
            if self._common(firsts[i - 1] + 1, top):
                return True
            top = self.before[top, pattern[i - 1]]
        return False


def closed_patterns(block: Block, first: int, least: int, backscan: bool = True) -> tuple[list[list[int]], list[int], int]:
    """Closed patterns that begin with item `first` and lie in at least `least` sequences, their supports, and the
    number of patterns visited.

    Closed: no pattern with one item more behind the first has the same support. Depth first over pseudo-projections,
    of any length. Where the backscan finds an item in a semi-maximum period of all sequences, no pattern with this
    prefix is closed and the descent stops; without backscan everything frequent is visited.
    """
    kept, supports, visited = [], [], 0
    at = block.after[block.first, first] if block.n else np.zeros(0, np.int32)
    rows = np.flatnonzero(at < block.none)
    stack = [([first], rows, [at[rows]])] if len(rows) >= least else []
    while stack:
        pattern, rows, firsts = stack.pop()
        visited += 1
        if backscan and block.extendable(pattern, firsts, rows, semi=True):
            continue
        nxt = block.after[firsts[-1] + 1]
        found = nxt < block.none
        support = found.sum(axis=0)
        if not (support == len(rows)).any() and not block.extendable(pattern, firsts, rows, semi=False):
            kept.append(pattern)
            supports.append(len(rows))
        for a in np.flatnonzero(support >= least)[::-1]:
            has = found[:, a]
            stack.append(([*pattern, int(a)], rows[has], [f[has] for f in firsts] + [nxt[has, a]]))
    return kept, supports, visited


def recovered(kept: list[list[int]], supports: list[int], n_items: int, shortest: int, longest: int) -> tuple[list[list[int]], list[int]]:
    """All parts of closed patterns of shortest to longest items that begin as they do, with their supports.

    A pattern's support is the largest among the closed patterns that contain it; each pattern is visited once.
    """
    if not kept:
        return [], []
    weight = np.asarray(supports)
    of = Block(np.concatenate([np.asarray(k, np.int32) for k in kept]), np.cumsum([0, *map(len, kept)]), n_items)
    out, found = [], []
    stack = [([kept[0][0]], np.arange(len(kept)), of.first)]
    while stack:
        pattern, rows, at = stack.pop()
        if len(pattern) >= shortest:
            out.append(pattern)
            found.append(int(weight[rows].max()))
        if len(pattern) < longest:
            nxt = of.after[at + 1]
            has = nxt < of.none
            for a in np.flatnonzero(has.any(axis=0)):
                stack.append(([*pattern, int(a)], rows[has[:, a]], nxt[has[:, a], a]))
    return out, found


def count_patterns(block: Block, patterns: list[tuple[int, ...]]) -> list[int]:
    """Number of sequences with each pattern; patterns are sorted, so that neighbours share projected prefixes."""
    out, path, old = [], [], ()
    for pattern in patterns:
        same = 0
        while same < len(old) and same < len(pattern) and old[same] == pattern[same]:
            same += 1
        del path[same:]
        for a in pattern[len(path) :]:
            at = block.after[block.first if not path else path[-1] + 1, a] if block.n else np.zeros(0, np.int32)
            path.append(at[at < block.none])
        out.append(len(path[-1]))
        old = pattern
    return out


def _local(table: pa.Table, least: int, always: int) -> tuple[Block, np.ndarray]:
    """The block of a table's sequences over the items that occur in at least `least` of them, and those items."""
    lists = table.column("items").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    top = int(values.max()) + 1 if len(values) else 0
    support = np.bincount(np.unique(owner * top + values) % top, minlength=top) if top else np.zeros(0, np.int64)
    known = np.union1d(np.flatnonzero(support >= least), [always])
    code = np.full(max(top, always + 1), -1)
    code[known] = np.arange(len(known))
    values = code[values]
    stay = values >= 0
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner[stay], minlength=len(offsets) - 1))]).astype(np.int64)
    return Block(values[stay], bounds, len(known)), known


def frequent_subsequences(sequences: DataFrame, *, share: float = 0.05, total: int | None = None, shortest: int = 3, longest: int = 5, closed_only: bool = False) -> DataFrame:
    """(pattern array<string>, support long, closed boolean) for sequences (id, events array<string>), one row an id.

    A pattern counts once for a sequence, gaps allowed, repeats allowed. All patterns of shortest to longest items in at
    least `share` of `total` sequences (default: their number) come out, or with closed_only those that are closed.
    closed: no pattern with one item more, of whatever length, has the same support.

    The search is partitioned by first item: the sequences that hold it, from its first place on, are one partition,
    in blocks of about BLOCK_SEQUENCES sequences, each in its own task. There the closed patterns of any length that
    begin with it are mined by bidirectional extension checks and backscan, with the block's share of the threshold
    (what is frequent in the partition is frequent in some block), and the supports of all shorter patterns are recovered
    from the closed ones. Supports of a block are summed by a shuffle. Only where a pattern was below a block's share
    is it counted there. The driver holds the frequent items alone: at most the mean length of a sequence divided by
    `share`. Null events are skipped; null and empty sequences count in the total only; no sequences give no rows.
    """
    spark = sequences.sparkSession
    empty = spark.createDataFrame([], "pattern array<string>, support long, closed boolean")
    data = scratch.table(sequences.select("id", F.array_compact("events").alias("events")).where("size(events) > 0"), "sequences")
    n = data.count()
    total = n if total is None else total
    # exact: share is taken as a decimal with up to six places
    scaled = round(share * 1_000_000)
    least = max(1, -(-total * scaled // 1_000_000))
    if not n:
        return empty
    frequent = data.select(F.explode(F.array_distinct("events")).alias("e")).groupBy("e").count().where(F.col("count") >= least).orderBy("e").collect()
    if not frequent:
        return empty
    items, holders = [r[0] for r in frequent], [r[1] for r in frequent]
    code = F.create_map(*[x for i, e in enumerate(items) for x in (F.lit(e), F.lit(i))])
    n_blocks = F.array(*[F.lit(-(-h // BLOCK_SEQUENCES)) for h in holders])
    coded = scratch.table(data.select("id", F.filter(F.transform("events", lambda e: code[e]), lambda x: x.isNotNull()).alias("items")).where("size(items) > 0"), "coded")
    scratch.forget(data)
    parts = coded.select("id", "items", F.explode(F.array_distinct("items")).alias("first"))
    parts = parts.select("first", F.pmod(F.xxhash64("id"), n_blocks[F.col("first")]).cast("int").alias("block"), F.slice("items", F.array_position("items", F.col("first")).cast("int"), F.size("items")).alias("items"))
    schema = "first int, block int, pattern array<int>, support long"
    arrow = pa.schema([("first", pa.int32()), ("block", pa.int32()), ("pattern", pa.list_(pa.int32())), ("support", pa.int64())])

    def rows(first: int, block: int, patterns: list, supports: list) -> pa.Table:
        n = len(patterns)
        return pa.table([pa.array([first] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(patterns, pa.list_(pa.int32())), pa.array(supports, pa.int64())], schema=arrow)

    def mine(key, table):
        first, number = key[0].as_py(), key[1].as_py()
        local = max(1, -(-least * table.num_rows // holders[first]))
        block, known = _local(table, local, first)
        kept, supports, _ = closed_patterns(block, int(np.searchsorted(known, first)), local)
        # one item more than asked for tells which of the longest are closed
        patterns, supports = recovered(kept, supports, block.n_items, shortest, longest + 1)
        return rows(first, number, [known[p].tolist() for p in patterns], supports)

    def fill(key, table, wanted):
        if not wanted.num_rows or not table.num_rows:
            return arrow.empty_table()
        first, number = key[0].as_py(), key[1].as_py()
        patterns = sorted(map(tuple, wanted.column("pattern").to_pylist()))
        block, known = _local(table, 1, first)
        at = {int(x): i for i, x in enumerate(known)}
        here = [p for p in patterns if all(x in at for x in p)]
        return rows(first, number, [list(p) for p in here], count_patterns(block, [tuple(at[x] for x in p) for p in here]))

    found = scratch.table(parts.groupBy("first", "block").applyInArrow(mine, schema), "mined")
    seen = found.groupBy("pattern").agg(F.count(F.lit(1)).alias("blocks"), F.min("first").alias("first")).where(F.col("blocks") < n_blocks[F.col("first")])
    every = seen.select("first", F.explode(F.sequence(F.lit(0), n_blocks[F.col("first")] - 1)).alias("block"), "pattern")
    absent = scratch.table(every.join(found, ["block", "pattern"], "left_anti").select("first", "block", "pattern"), "absent")
    counted = found.select("pattern", "support")
    if not absent.isEmpty():
        again = parts.join(absent.select("first", "block").distinct(), ["first", "block"], "left_semi")
        counted = counted.union(again.groupBy("first", "block").cogroup(absent.groupBy("first", "block")).applyInArrow(fill, schema).select("pattern", "support"))
    support = scratch.table(counted.groupBy("pattern").agg(F.sum("support").alias("support")).where(F.col("support") >= least), "supports", 1)
    less = F.transform(F.sequence(F.lit(0), F.size("pattern") - 1), lambda i: F.filter("pattern", lambda x, j: j != i))
    open_ = support.select(F.explode(less).alias("pattern"), "support").distinct().withColumn("closed", F.lit(False))
    out = support.where(F.size("pattern") <= longest).join(open_, ["pattern", "support"], "left").withColumn("closed", F.coalesce("closed", F.lit(True)))
    names = F.array(*[F.lit(x) for x in items])
    return (out.where("closed") if closed_only else out).select(F.transform("pattern", lambda x: names[x]).alias("pattern"), "support", "closed")


def tool_sequences(steps: DataFrame) -> DataFrame:
    """(run_id, events): the tools of a run's assistant rows in order of pos, each place once.

    Events are lower-cased and stripped; rows without run_id, pos or tool are left out.
    """
    tool = F.lower(F.regexp_replace("tool", r"(?U)^\s+|\s+$", ""))
    rows = steps.where("run_id is not null and pos is not null and tool is not null").where(speaker(F.col("role")) == "assistant").select("run_id", F.struct("pos", tool.alias("tool")).alias("at")).where("at.tool <> ''")
    ordered = rows.groupBy("run_id").agg(F.sort_array(F.collect_set("at")).alias("at"))
    # one place, one event: a clash of two tools at one place keeps the first in byte order
    once = F.filter("at", lambda x, i: (i == 0) | (F.col("at")[F.greatest(i - 1, F.lit(0))]["pos"] != x["pos"]))
    return ordered.select("run_id", F.transform(once, lambda x: x["tool"]).alias("events"))


def frequent_tool_orders(steps: DataFrame, share: float = 0.05) -> DataFrame:
    """(event_pattern, support) of the tool orders of 3 to 5 events in at least `share` of the run_ids of steps."""
    total = steps.select("run_id").where("run_id is not null").distinct().count()
    found = frequent_subsequences(tool_sequences(steps).withColumnRenamed("run_id", "id"), share=share, total=total)
    return found.select(F.array_join("pattern", ">").alias("event_pattern"), "support", "closed")
