import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.llm import conversations, repeats, subsequences


def contains(s, p):
    it = iter(s)
    return all(x in it for x in p)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_patterns_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(subsequences, "BLOCK_SEQUENCES", 12)
    rng = random.Random(seed)
    seqs = [[rng.choice("abcd") for _ in range(rng.randrange(0, 9))] for _ in range(40)] + [["a", None, "b"], None, []]
    d = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "id long, events array<string>")
    n = len(seqs)
    want = {}
    for k in range(2, 5):
        for p in itertools.product("abcd", repeat=k):
            c = sum(contains([x for x in s or [] if x], p) for s in seqs)
            if c >= 0.2 * n:
                want[p] = c
    got = {tuple(r.pattern): r.support for r in subsequences.frequent_subsequences(d, share=0.2, total=n, shortest=2, longest=4).collect()}
    assert got == want
    closed = {tuple(r.pattern) for r in subsequences.frequent_subsequences(d, share=0.2, total=n, shortest=2, longest=4, closed_only=True).collect()}
    more = {p: c for k in (5,) for p in itertools.product("abcd", repeat=k) if (c := sum(contains([x for x in s or [] if x], p) for s in seqs))}
    longer = want | more
    assert closed == {p for p, c in want.items() if not any(s == c and len(q) == len(p) + 1 and contains(q, p) for q, s in longer.items())}


def block_of(seqs, n_items):
    return subsequences.Block(np.array([x for s in seqs for x in s], np.int32), np.cumsum([0, *map(len, seqs)]), n_items)


@pytest.mark.parametrize("seed", range(6))
def test_backscan_prunes_the_search(seed):
    rng = random.Random(seed)
    # a common thread with noise between its steps gives many patterns that are not closed
    seqs = [[y for x in (0, 1, 2, 3, 1) for y in ([rng.choice((3, 4))] if rng.random() < 0.2 else []) + ([x] if x < 2 or rng.random() < 0.8 else [])] for _ in range(30)]
    seqs = [s[s.index(0) :] for s in seqs if 0 in s]
    block = block_of(seqs, 5)
    least = 6
    pruned, full = subsequences.closed_patterns(block, 0, least), subsequences.closed_patterns(block, 0, least, backscan=False)
    assert dict(zip(map(tuple, pruned[0]), pruned[1])) == dict(zip(map(tuple, full[0]), full[1]))
    assert pruned[2] < full[2]
    # without backscan everything frequent is visited; all of it is recovered from the closed patterns
    found, support = subsequences.recovered(pruned[0], pruned[1], 5, 1, 99)
    assert len(found) == full[2] and all(s == sum(contains(x, p) for x in seqs) for p, s in zip(found, support))
    assert subsequences.count_patterns(block, sorted(map(tuple, found))) == [s for _, s in sorted(zip(map(tuple, found), support))]


def test_long_equal_sequences(spark):
    d = spark.createDataFrame([(i, ["a", "b", "c"] * 20) for i in range(30)] + [(99, ["z"])], "id long, events array<string>").withColumn("first", F.lit("clash"))
    out = subsequences.frequent_subsequences(d, share=0.5).collect()
    assert len(out) == 27 + 81 + 243 and all(r.support == 30 and not r.closed for r in out)


def test_no_sequences(spark):
    d = spark.createDataFrame([], "id long, events array<string>")
    assert subsequences.frequent_subsequences(d).count() == 0
    steps = spark.createDataFrame([("r", 0, None, "x"), ("r", 1, "agent", None), (None, 0, "ai", "x"), ("r", None, "ai", "x"), ("r", 2, " AI ", " X "), ("r", 2, "assistant", "x"), ("r", 3, "ai", " ")], "run_id string, pos int, role string, tool string")
    assert [tuple(r) for r in subsequences.tool_sequences(steps).collect()] == [("r", ["x"])]


def messages(spark, rows):
    t0 = datetime(2026, 1, 1)
    full = [(i, *r[:5], t0 + timedelta(seconds=r[5]) if r[5] is not None else None) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "frag_id long, run_id string, step_idx int, frag_idx int, role string, text string, created_at timestamp").withColumn("k", F.lit("clash"))


GOOD = [("ok", 0, 0, "user", "q", 0), ("ok", 0, 1, "Agent ", "a", 1), ("ok", 0, 1, "assistant", "a", 9), ("ok", 1, 0, "ai", "b", 2)]
CASES = {
    "gap": [("x", 0, 0, "user", "q", 0), ("x", 0, 1, "ai", "a", 1), ("x", 2, 0, "ai", "b", 2)],
    "hole": [("x", 0, 0, "user", "q", 0), ("x", 0, 2, "ai", "a", 1)],
    "start": [("x", 1, 0, "user", "q", 0), ("x", 1, 1, "ai", "a", 1)],
    "clash": [("x", 0, 0, "user", "q", 0), ("x", 0, 1, "ai", "a", 1), ("x", 0, 1, "ai", "other", 1)],
    "role": [("x", 0, 0, "user", "q", 0), ("x", 0, 1, " ​", "a", 1), ("x", 0, 2, "ai", "a", 1)],
    "no step": [("x", 0, 0, "user", "q", 0), ("x", 0, 1, "ai", "a", 1), ("x", None, 0, "ai", "a", 1)],
    "no reply": [("x", 0, 0, "user", "q", 0), ("x", 0, 1, "ai", "  ", 1)],
    "user last": [("x", 0, None, "user", "q", 0), ("x", 0, None, "ai", "a", 1), ("x", 0, None, "human", "r", 2)],
    "unasked": [("x", 0, 0, "user", None, 0), ("x", 0, 1, "ai", "a", 1)],
    "mixed": [("x", 0, 0, "user", "q", 0), ("x", 0, None, "ai", "a", 1)],
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_broken_conversations(spark, name, monkeypatch):
    monkeypatch.setattr(conversations, "STEPS", 1 + len(name) % 3)
    monkeypatch.setattr(conversations, "CHUNK", 1 + len(name) % 2)
    d = messages(spark, GOOD + CASES[name])
    assert {r.run_id for r in conversations.broken(conversations.conversation_faults(d)).collect()} == {"x"}


def test_whole_conversations(spark):
    rows = GOOD + [("t", 0, None, "user", "q", 5), ("t", 0, None, "ai", "a", 6), ("t", 0, None, "ai", "a", 6), ("t", 1, None, "tool", "z", 8), ("t", 1, None, "ai", "late", 7), (None, 0, 0, "user", "q", 0)]
    out = conversations.rebuild(messages(spark, rows)).orderBy("run_id", "turn").collect()
    assert [(r.run_id, r.turn, r.role, r.text) for r in out] == [("ok", 0, "user", "q"), ("ok", 1, "assistant", "a"), ("ok", 2, "assistant", "b"), ("t", 0, "user", "q"), ("t", 1, "assistant", "a"), ("t", 2, "assistant", "late"), ("t", 3, "tool", "z")]
    assert conversations.rebuild(messages(spark, [])).count() == 0 and conversations.conversation_faults(messages(spark, [])).count() == 0


@pytest.mark.parametrize("steps,chunk", [(1, 1), (2, 3), (3, 64)])
def test_long_conversations(spark, steps, chunk, monkeypatch):
    monkeypatch.setattr(conversations, "STEPS", steps)
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    long = [("long", i // 5, i % 5 if i // 5 % 2 else None, "ai" if i % 5 else "user", "same words", i) for i in range(65)]
    holed = [("holed", *r[1:]) for r in long if r[1:3] != (7, 2)]
    rows = holed + long
    random.Random(1).shuffle(rows)
    out = conversations.rebuild(messages(spark, rows)).orderBy("turn").collect()
    assert [(r.run_id, r.turn, r.step_idx, r.role) for r in out] == [("long", i, i // 5, "assistant" if i % 5 else "user") for i in range(65)]


def test_rows_without_step_are_not_merged(spark):
    """Merging them changes nothing that follows."""
    d = messages(spark, GOOD + [("x", None, 0, "ai", "a", 1)] * 2)
    m = conversations.messages(d).where("step_idx is null")
    assert [(r.run_id, r.damaged, r.clash, r.k, r.at) for r in m.collect()] == [("x", True, False, None, None)] * 2
    assert [(r.run_id, r.damaged) for r in conversations.broken(conversations.conversation_faults(d)).collect()] == [("x", True)]


def exports(spark, rows):
    return spark.createDataFrame([(c, i, m) for c, i, m in rows], "conversation string, id long, messages array<long>").withColumn("path", F.lit("clash"))


def paths(df, longest=None):
    return {r.id: (r.path, r.shift) for r in conversations.assemble(df, longest).collect()}


def test_order_from_overlaps_alone(spark):
    rng = random.Random(5)
    rows, want = [], {}
    ids = rng.sample(range(10_000), 400)
    for c in ("x", "y"):
        text = [rng.randrange(40) for _ in range(300)]  # messages are said again and again
        at, end, head = 0, 0, None
        while end < len(text):
            i, end = ids.pop(), max(end + 1, at + rng.randrange(14, 20))
            head = i if head is None else head
            rows.append((c, i, text[at:end]))
            want[i] = (head, at)
            at += rng.randrange(3, end - at - 6)  # overlaps of seven messages and more
    rng.shuffle(rows)
    assert paths(exports(spark, rows)) == want


def test_ambiguous_overlaps_do_not_merge(spark):
    fork = [("f", 1, [1, 2, 3]), ("f", 2, [3, 4]), ("f", 3, [3, 5]), ("f", 4, [5, 6])]
    assert paths(exports(spark, fork)) == {1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (3, 1)}
    circle = [("c", 1, [1, 2]), ("c", 2, [2, 3]), ("c", 3, [3, 1]), ("d", 4, [1, 2]), ("d", 5, [7, 7])]
    for longest in (None, 1):
        assert paths(exports(spark, circle), longest) == {1: (None, None), 2: (None, None), 3: (None, None), 4: (4, 0), 5: (5, 0)}
    # the longest match decides: 1 goes on in 2, though 3 begins with its last message
    longer = [("l", 1, [1, 2, 3]), ("l", 2, [2, 3, 4]), ("l", 3, [3, 9])]
    assert paths(exports(spark, longer)) == {1: (1, 0), 2: (1, 1), 3: (3, 0)}
    assert paths(exports(spark, [])) == {} and paths(exports(spark, [("e", 1, [])])) == {1: (1, 0)}


def test_contained_exports(spark):
    rows = [("a", 1, [1, 2, 3]), ("a", 2, [1, 2, 3]), ("a", 3, [1, 2]), ("a", 4, [3]), ("a", 5, [2]), ("b", 6, [1, 2]), ("a", 7, [3, 4]), ("a", 8, [2, 3, 9, 4]), ("a", 9, [9, 4])]
    assert sorted(r.id for r in conversations.without_contained(exports(spark, rows)).collect()) == [1, 6, 7, 8]


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_stretches_across_chunks(spark, chunk, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows, want = [], []
    for run in ("a", "b", "c"):
        sigs = [rng.choice([1, 1, 2, None]) for _ in range(60)]
        rows += [(run, 2 * i, i, s, datetime(2026, 1, 1) + timedelta(seconds=i) if i % 5 else None) for i, s in enumerate(sigs)]
        for s, g in itertools.groupby(enumerate(sigs), key=lambda x: x[1]):
            g = list(g)
            if s is not None and len(g) > 1:
                want.append((run, g[0][0], g[-1][0], len(g)))
    rows += rows[:20] + [(None, 1, 1, 1, None), ("a", None, 1, 1, None)]
    d = spark.createDataFrame(rows, "run string, pos int, step int, sig long, ts timestamp").withColumn("chunk", F.lit("clash"))
    got = sorted((r.run, r.first_step, r.last_step, r.n) for r in repeats.collapse_repeats(d).collect())
    assert got == sorted(want)
    assert repeats.collapse_repeats(d.limit(0)).count() == 0


def test_nearly_equal_calls(spark):
    same = ["cd /x && sed -n '1,5p' a.py", "sed -n \"20,35p\"  a.py", "sed   -n `1,5p` a.py\n"]
    tmp = ["diff a.py /tmp/4a06bd73.bak", "diff a.py /tmp/zz/q.txt"]
    hexes = ["git show deadbeef", "git show 12345678", "git show 77"]
    other = ["sed -n '1,5p' b.py", "grep -n 'x' a.py", "git show feed"]
    d = spark.createDataFrame([(x,) for x in same + tmp + hexes + other], "c string").select(repeats.call_shape(F.col("c")).alias("s"))
    shapes = [r.s for r in d.collect()]
    assert len(set(shapes[:3])) == 1 and len(set(shapes[3:5])) == 1 and len(set(shapes)) == 6


def test_one_run_holds_nearly_all_events(spark, monkeypatch):
    """Chunks of the hot run are spread, and only its edge pieces meet in one task."""
    monkeypatch.setattr(repeats, "CHUNK", 64)
    n = 20_000
    d = spark.range(n).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("r"), F.col("id"))).otherwise("hot").alias("run"), F.col("id").cast("int").alias("pos"), F.col("id").cast("int").alias("step"), F.expr("case when id < 10000 then id div 7 else 5 end").alias("sig"), F.lit(None).cast("timestamp").alias("ts"))
    got = {(r.first_step, r.last_step): r.n for r in repeats.collapse_repeats(d).where("run = 'hot'").collect()}
    sigs = [(i, i // 7 if i < 10_000 else 5) for i in range(n) if i % 10]
    want = [[x[0] for x in g] for _, g in itertools.groupby(sigs, key=lambda x: x[1])]
    assert got == {(g[0], g[-1]): len(g) for g in want if len(g) > 1}
