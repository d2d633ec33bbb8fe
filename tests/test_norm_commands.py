import re
from collections import Counter

from runloom.plans import catalog


def plain(c):
    for p, r in ((r"^\s*(?:cd\s+[^;&|]+(?:&&|;)\s*)+", ""), (r"/tmp/[^\s'\";|&)]+", "TMP"), (r"\b(?=[0-9a-f]*\d)[0-9a-f]{7,40}\b", "H"), (r"\d+", "N")):
        c = re.sub(p, r, c)
    return " ".join(c.split())


def test_counts_with_hashes_against_python(spark, tmp_path):
    calls = [["cd /x && git diff baca2ef2", "git diff 67ad4b7b"], ["git diff 67ad4b7b0f", "ls /tmp/a1"], None, ["ls /tmp/b2", "git diff deadbee", "sed -n 1,20p a.py", "sed -n 3,9p  a.py"]]
    rows = [(i, f"r{i}", c, "t", False) for i, c in enumerate(calls)]
    spark.createDataFrame(rows, "step_id long, run_id string, tool_calls array<string>, text string, error boolean").write.parquet(f"{tmp_path}/steps.parquet")
    got = {r.command: r.n for r in catalog.queries()["norm_command_hash_counts"](spark, str(tmp_path)).collect()}
    assert got == Counter(plain(c) for cs in calls if cs for c in cs) and got["git diff H"] == 3
