import random

import pytest

from runloom.operators import selection as S


@pytest.mark.parametrize("seed", range(3))
def test_pooled_rules_are_exact_in_any_order(spark, seed):
    """Sums of thirds in floats depend on the order of rows, and then so does how a mean halfway between two is rounded."""
    rows = [("a", i, 1 / 3, 1 / 3, 1.0) for i in range(300)] + [("b", i, [1 / 3, 2 / 3, 0.5][i % 3], [1 / 3, 0.0, 1.0][i % 3], 1.0) for i in range(300)] + [("b", 999, None, None, None)]
    random.Random(seed).shuffle(rows)
    d = spark.createDataFrame(rows, "u string, subset int, random double, submitted double, oracle double").repartition(1 + 3 * seed)
    got = {r.rule: tuple(r)[1:] for r in S.pooled_rules(d, "u", ["random", "submitted", "oracle"], 3).collect()}
    assert got == {"random": (5 / 12, 100 / 36, 1 / 22), "submitted": (7 / 18, 0.0, 0.0), "oracle": (1.0, 1100 / 18, 1.0)}
