"""Repeated consecutive events: runs of equal or nearly equal neighbours become one row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runloom import scratch
from runloom.llm.roles import speaker

CHUNK = 4096

#: Order matters: longer shapes before the digits inside them.
_CALL_SHAPES = (
    (r"[‘’‚‛“”„‟`\"']", "'"),
    (r"(?U)\s+", " "),
    (r"^ ?(?:cd (?:'[^']*'|[^ ;&|]+) ?(?:&&|;) ?)+", ""),
    (r"/tmp/[^ '\";|&<>(),:=]*", "/tmp/F"),
    (r"(?<![0-9A-Za-z])(?:0x)?[0-9a-fA-F]{8}(?![0-9A-Za-z])", "N"),  # an id may be all digits: ids and numbers are alike
    (r"[0-9]+(?:\.[0-9]+)*", "N"),
    (r" ?(&&|\|\||[;|<>]) ?", "$1"),
)


def call_shape(call: Column) -> Column:
    """A call without what may differ between nearly equal ones: numbers, hex ids of eight digits, files under /tmp,
    kind of quote, white space, a leading change of directory."""
    for pattern, put in _CALL_SHAPES:
        call = F.regexp_replace(call, pattern, put)
    return F.trim(call)


def _lookup(rows: pd.DataFrame) -> pd.DataFrame:
    """Whole chunks, ordered by run and place: each event gets the run-start at or before it in its chunk."""
    sig, ok = rows["sig"].to_numpy(), rows["ok"].to_numpy(bool)
    group = (rows["run"].ne(rows["run"].shift()) | rows["chunk"].ne(rows["chunk"].shift())).to_numpy()
    fresh = group.copy()
    fresh[1:] |= (sig[1:] != sig[:-1]) | ~ok[1:] | ~ok[:-1]
    starts = np.flatnonzero(fresh)  # sorted positions of run starts, all chunks end to end
    of = np.searchsorted(starts, np.arange(len(rows)), side="right") - 1
    first = starts
    last = np.append(starts[1:], len(rows)) - 1
    chunk_of = np.cumsum(group)
    ends_chunk = np.append(chunk_of[1:] != chunk_of[:-1], True)
    when = rows["ts"].to_numpy("int64")
    known = rows["ts_known"].to_numpy(bool)
    low = np.minimum.reduceat(np.where(known, when, np.iinfo(np.int64).max), starts) if len(starts) else when
    high = np.maximum.reduceat(np.where(known, when, np.iinfo(np.int64).min), starts) if len(starts) else when
    out = pd.DataFrame({
        "run": rows["run"].to_numpy()[first], "chunk": rows["chunk"].to_numpy()[first], "sig": sig[first], "ok": ok[first],
        "first_pos": rows["pos"].to_numpy()[first], "first_step": rows["step"].to_numpy()[first], "last_step": rows["step"].to_numpy()[last],
        "n": np.bincount(of, minlength=len(starts)).astype(np.int64), "low": low, "high": high,
        "at_edge": group[first] | ends_chunk[last],
    })
    return out[out["ok"] & ((out["n"] > 1) | out["at_edge"]) | out["at_edge"]]


_PIECES = "run string, chunk long, sig long, ok boolean, first_pos long, first_step int, last_step int, n long, low long, high long, at_edge boolean"


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stream a sorted partition, holding back the last, perhaps unfinished chunk of each batch (at most CHUNK places)."""
    held: pd.DataFrame | None = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        new = (rows["run"].ne(rows["run"].shift()) | rows["chunk"].ne(rows["chunk"].shift())).to_numpy()
        cut = int(np.flatnonzero(new)[-1])
        held = rows.iloc[cut:].reset_index(drop=True)
        if cut:
            yield _lookup(rows.iloc[:cut].reset_index(drop=True))
    if held is not None and len(held):
        yield _lookup(held)


def collapse_repeats(events: DataFrame) -> DataFrame:
    """(run, first_step, last_step, n, first_ts, last_ts, seconds) of every maximal stretch of two or more events.

    events: run string, pos int (total order in the run), step int, sig long (equal for events that count as the same,
    null for an event that ends a stretch), ts timestamp (may be null). Two rows with one run and pos are one event.

    The runs are cut into chunks of CHUNK places. In each, run-start positions are gathered into a sorted array and
    events find theirs by binary search; stretches wholly inside a chunk are finished there, only those at a chunk's
    edge go on, one row each, and are joined if the next chunk's first has the same signature. So a run of any length is
    spread over tasks, and after the first shuffle next to nothing is moved. Rows without run or pos are left out.
    """
    micros = F.unix_micros("ts")
    rows = events.where("run is not null and pos is not null").select("run", F.expr(f"cast(floor(pos / {CHUNK}) as long)").alias("chunk"), F.col("pos").cast("long").alias("pos"), F.col("step").cast("int").alias("step"), F.coalesce("sig", F.lit(0)).cast("long").alias("sig"), F.col("sig").isNotNull().alias("ok"), F.coalesce(micros, F.lit(0)).alias("ts"), micros.isNotNull().alias("ts_known"))
    rows = rows.repartition("run", "chunk").dropDuplicates(["run", "chunk", "pos"])
    rows = rows.withColumn("step", F.coalesce("step", F.lit(-1))).sortWithinPartitions("run", "chunk", "pos")
    pieces = rows.mapInPandas(_pieces, _PIECES)
    pieces = scratch.table(rows.mapInPandas(_pieces, _PIECES), "pieces")
    # only pieces at chunk edges go on, at most two a chunk: a stretch goes on while signature and chunk follow without a break
    run = Window.partitionBy("run").orderBy("first_pos")
    before = F.lag(F.struct("sig", "ok", "chunk")).over(run)
    edge = pieces.where("at_edge").withColumn("goes_on", F.coalesce(F.col("ok") & before["ok"] & (F.col("sig") == before["sig"]) & (F.col("chunk") != before["chunk"]), F.lit(False)))
    edge = edge.where("ok").withColumn("stretch", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edge.groupBy("run", "stretch").agg(F.min_by("first_step", "first_pos").alias("first_step"), F.max_by("last_step", "first_pos").alias("last_step"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where("n > 1").drop("stretch")
    out = pieces.where("not at_edge").select(joined.columns).union(joined)
    known = F.col("high") >= F.col("low")
    return out.select("run", F.when(F.col("first_step") >= 0, F.col("first_step")).alias("first_step"), F.when(F.col("last_step") >= 0, F.col("last_step")).alias("last_step"), "n", F.when(known, F.timestamp_micros("low")).alias("first_ts"), F.when(known, F.timestamp_micros("high")).alias("last_ts"), F.when(known, (F.col("high") - F.col("low")) / 1e6).alias("seconds"))


def call_events(steps: DataFrame) -> DataFrame:
    """The assistant rows of steps as events of collapse_repeats; calls that are nearly the same share a signature.

    Null and blank entries of tool_calls are no calls; a row without calls has a null signature.
    """
    calls = F.filter(F.transform("tool_calls", call_shape), lambda x: x.isNotNull() & (x != ""))
    # one call, the usual case, is taken without lambdas
    shape = F.when(F.size("tool_calls") == 1, call_shape(F.col("tool_calls")[0])).otherwise(F.array_join(calls, "\x01"))
    rows = steps.where("run_id is not null and pos is not null").where(speaker(F.col("role")) == "assistant")
    return rows.select(F.col("run_id").alias("run"), "pos", F.col("step_idx").alias("step"), F.when(shape != "", F.xxhash64(shape)).alias("sig"), "ts")
