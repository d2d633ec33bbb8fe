import json

from runloom.operators import guards


def test_settings_below_any_level(spark):
    def nest(n, inner):
        for i in range(n):
            inner = [0, inner] if i % 3 == 2 else {f"k{i}": inner}
        return inner

    deep = nest(200, {"api_key": "x", "v": 7})
    rows = [(1, json.dumps({"a": {"b": [1, None]}, "": 2})), (2, json.dumps(deep)), (3, "5"), (4, None), (5, "{")]
    got = {(r.record_id, r.path): r.value for r in guards.flat_settings(spark.createDataFrame(rows, "i long, t string"), "i", "t").collect()}
    assert {k: v for k, v in got.items() if k[0] != 2} == {(1, "a.b.0"): "1", (1, "a.b.1"): None, (1, ""): "2", (3, ""): "5"}
    ends = {p.rsplit(".", 1)[1]: (p.count("."), v) for (i, p), v in got.items() if i == 2 and p.endswith(("api_key", ".v"))}
    assert ends == {"api_key": (200, "***"), "v": (200, "7")}
