from itertools import combinations

import pytest

from runloom.operators import relational as R


def test_patch_noise_against_pairs(spark):
    """Attempts of one task compared pair by pair, over submissions; without patch or label they stay out of the pairs they can't be in."""
    rows = [
        ("a", "diff 1", 0), ("a", "diff 1\n", 1), ("a", " diff 1", 1), ("a", "diff 2", 1), ("a", "diff 2", None), ("a", "", 0), ("a", " ", 0), ("a", None, 1),
        ("b", "diff 1", 0), ("b", "diff 1", 0), ("b", "diff 3", 1), (None, "diff 1", 0),
    ]
    got = R.patch_noise(spark.createDataFrame(rows, "task string, patch string, y int"), "task", "patch", "y").first()
    pairs = [(p, q) for p, q in combinations(rows, 2) if p[0] and p[0] == q[0]]
    same = [(p, q) for p, q in pairs if (p[1] or "").strip() and (p[1] or "").strip() == (q[1] or "").strip()]
    known = [(p, q) for p, q in same if None not in (p[2], q[2])]
    bad = [(p, q) for p, q in known if p[2] != q[2]]
    within = [(p, q) for p, q in pairs if {p[2], q[2]} == {0, 1}]
    assert (got.identical_pairs, got.labelled_pairs, got.discordant, got.within_pairs) == (len(same), len(known), len(bad), len(within))
    assert got.discordance == pytest.approx(len(bad) / len(known)) and got.epsilon == pytest.approx((1 - max(0, 1 - 2 * len(bad) / len(known)) ** 0.5) / 2)
    assert got.s == pytest.approx(len(bad) / len(within)) and got.ceiling == pytest.approx(1 - len(bad) / len(within) / 2)


def test_patch_noise_of_nothing(spark):
    got = R.patch_noise(spark.createDataFrame([], "task string, patch string, y int"), "task", "patch", "y").first()
    assert got.identical_pairs == 0 and got.s is None and got.epsilon is None
