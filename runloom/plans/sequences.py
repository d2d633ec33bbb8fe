"""Sequence windows over steps, events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.io import load
from runloom.operators import sequences as Q
from runloom.operators import vectors as V
from runloom.plans.base import ONCE_SQL, once, role, rounded

# fixed values: what tools change files and what tools check them
EDIT = ("edit", "insert", "sed", "patch", "touch", "mv", "cp", "mkdir", "black")
VERIFY = ("pytest", "tox", "python", "coverage", "mypy", "ruff", "timeit", "make")


def acts(spark, d):
    """Assistant rows of steps, each place once, with phase E, V or O."""
    s = once(load(spark, d, "steps", "step_id", "run_id", "pos", "step_idx", "role", "tool", "tool_calls", "text", "error", "ts"))
    t = F.lower(F.trim("tool"))
    phase = F.when(t.isin(*EDIT), "E").when(t.isin(*VERIFY), "V").otherwise("O")
    return s.where(role() == "assistant").select("run_id", "pos", "step_idx", t.alias("tool"), phase.alias("phase"), F.col("tool_calls")[0].alias("call"), "text")


def places(spark, d):
    return once(load(spark, d, "steps", "step_id", "run_id", "pos", "step_idx", "role", "text", "error")).withColumn("role", role())


def _in(xs):
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


ACTS_SQL = f"{ONCE_SQL}, a AS (SELECT run_id, pos, step_idx, tool, CASE WHEN tool IN {_in(EDIT)} THEN 'E' WHEN tool IN {_in(VERIFY)} THEN 'V' ELSE 'O' END AS phase, tool_calls[1] AS call, text FROM once WHERE role = 'assistant')"


def _q(make, sql, source=acts, base=ACTS_SQL):
    return (lambda spark, d: rounded(make(source(spark, d)))), f"WITH {base}\n{sql}"


def _gram_entropy(n):
    def make(a):
        return Q.entropy(Q.grams(a, "run_id", "pos", "phase", n), "run_id", "gram", 3**n)

    leads = " || '>' || ".join(["phase", *[f"lead(phase, {i}) OVER w" for i in range(1, n)]])
    return make, f", g AS (SELECT run_id, {leads} AS gram FROM a WINDOW w AS (PARTITION BY run_id ORDER BY pos)), c AS (SELECT run_id, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY run_id, gram), p AS (SELECT run_id, n / sum(n) OVER (PARTITION BY run_id) AS p FROM c) SELECT run_id, round(sum(-p * log2(p)) / log2({3**n}), 6) AS entropy FROM p GROUP BY run_id"


_WIN = ", ".join(f"list_contains(list(tool) FILTER (tool IS NOT NULL) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), tool) AS w{k}" for k in (3, 5, 10))
_EVENTS = lambda spark, d: load(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value", "props")
_FRAGS = lambda spark, d: load(spark, d, "fragments", "frag_id", "run_id", "step_idx", "text").withColumn("len", F.coalesce(F.length("text"), F.lit(0)))
_EMB = lambda spark, d: load(spark, d, "embeddings")
_DOT = "list_sum(list_transform(range(1, 65), lambda i: ({0})[i]::DOUBLE * ({1})[i]::DOUBLE))"


def _dot(a, b):
    return _DOT.format(a, b)


_CENT = ", x AS (SELECT label, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings), m AS (SELECT label, i, avg(x::DOUBLE) AS m FROM x GROUP BY label, i), ce AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label)"

QUERIES = {
    "phase_transitions": _q(lambda a: Q.transitions(a, "run_id", "pos", "phase"), ", t AS (SELECT run_id, phase, lag(phase) OVER (PARTITION BY run_id ORDER BY pos) AS p FROM a) SELECT run_id, count(p) AS n_transitions, count(*) FILTER (p <> phase) AS n_changes FROM t GROUP BY run_id"),
    "phase_bigram_entropy": _q(*_gram_entropy(2)),
    "phase_trigram_entropy": _q(*_gram_entropy(3)),
    "trigram_top10": _q(
        lambda a: Q.grams(a, "run_id", "pos", "phase", 3).where("gram is not null").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gram").limit(10),
        ", g AS (SELECT phase || '>' || lead(phase, 1) OVER w || '>' || lead(phase, 2) OVER w AS gram FROM a WINDOW w AS (PARTITION BY run_id ORDER BY pos)) SELECT gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY gram ORDER BY n DESC, gram LIMIT 10",
    ),
    "loop_features": _q(
        lambda a: Q.loop_features(a, "run_id", "pos", "tool"),
        f", l AS (SELECT run_id, pos, tool, coalesce(lag(tool) OVER (PARTITION BY run_id ORDER BY pos) = tool, false) AS same, {_WIN} FROM a), i AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY pos) AS isl FROM l), g AS (SELECT run_id, isl, count(*) n, count(tool) k FROM i GROUP BY run_id, isl), m AS (SELECT run_id, max(CASE WHEN k > 0 THEN n ELSE 0 END) AS max_run_length FROM g GROUP BY run_id) SELECT run_id, count(*) AS n, round(count(DISTINCT tool) / count(*), 6) AS distinct_ratio, CASE WHEN count(*) > 1 THEN round(count(*) FILTER (same) / (count(*) - 1), 6) END AS repeat_ratio, " + ", ".join(f"round(count(*) FILTER (w{k}) / count(*), 6) AS repeat_in_window_{k}" for k in (3, 5, 10)) + ", any_value(max_run_length) AS max_run_length FROM i JOIN m USING (run_id) GROUP BY run_id",
    ),
    "revisit_ratio": _q(lambda a: Q.revisit_ratio(a, "run_id", "pos", "tool"), ", f AS (SELECT run_id, pos, min(pos) OVER (PARTITION BY run_id, tool) AS fp FROM a WHERE tool IS NOT NULL) SELECT run_id, count(*) AS touched, round(avg((fp < pos)::INT), 6) AS revisit_ratio FROM f GROUP BY run_id"),
    "around_last_edit": _q(
        lambda a: Q.around_last(a, "run_id", "pos", "phase", "E", "V"),
        ", m AS (SELECT *, max(CASE WHEN phase = 'E' THEN pos END) OVER (PARTITION BY run_id) AS le, min(CASE WHEN phase = 'E' THEN pos END) OVER (PARTITION BY run_id) AS fe FROM a) SELECT run_id, count(*) FILTER (phase = 'E') AS n_mark, count(*) FILTER (phase = 'V') AS n_check, count(*) FILTER (phase = 'V' AND pos > le) AS n_check_after, max((phase = 'V' AND pos > le)::INT) AS check_after_last, max((phase = 'V' AND pos < fe)::INT) AS check_before_first, round(count(*) FILTER (pos < fe) / count(*), 6) AS share_before_first FROM m GROUP BY run_id",
    ),
    "unresolved_fail": _q(lambda p: Q.unresolved_failure(p, "run_id", "pos", F.col("error") == True, F.col("error") == False), "SELECT run_id, coalesce((max(pos) FILTER (error) > coalesce(max(pos) FILTER (NOT error), -1))::INT, 0) AS unresolved_fail FROM once GROUP BY run_id", places, ONCE_SQL),  # noqa: E712
    "prefix_window_features": _q(
        lambda f: Q.prefix_features(f, "run_id", "frag_id", "step_idx", "len", 10),
        ", p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY frag_id) AS i FROM fr QUALIFY i <= 10), t AS (SELECT *, max(step_idx) OVER (PARTITION BY run_id) AS top FROM p) SELECT run_id, count(DISTINCT step_idx) FILTER (step_idx < top) AS n_steps, count(*) AS n_frag, sum(len)::BIGINT AS total_chars, round(avg(len), 6) AS mean_len FROM t GROUP BY run_id",
        _FRAGS, "fr AS (SELECT frag_id, run_id, step_idx, coalesce(length(text), 0) AS len FROM fragments)",
    ),
    "short_sequence_exclusions": _q(
        lambda f: f.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).groupBy(F.when(F.col("n") >= 10, "kept").otherwise("too short").alias("reason")).agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("fragments")),
        ", g AS (SELECT run_id, count(*) n FROM fr GROUP BY run_id) SELECT CASE WHEN n >= 10 THEN 'kept' ELSE 'too short' END AS reason, count(*) AS runs, sum(n)::BIGINT AS fragments FROM g GROUP BY 1",
        _FRAGS, "fr AS (SELECT * FROM fragments)",
    ),
    "final_message_pick": _q(lambda a: Q.step_back(a.where("text is not null"), "run_id", "pos", "text"), ", r AS (SELECT run_id, pos, text, row_number() OVER (PARTITION BY run_id ORDER BY pos DESC) AS r FROM a WHERE text IS NOT NULL QUALIFY r <= 4) SELECT run_id, arg_min(pos, r) AS pos, arg_min(text, r) AS text FROM r WHERE length(text) >= 30 GROUP BY run_id"),
    "event_sessions": _q(lambda e: Q.sessions(e, "user_id", "ts", "event_id", 3600), ", n AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM n) SELECT user_id, session::BIGINT AS session, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, session", _EVENTS, "e AS (SELECT * FROM events)"),
    "permutation_entropy": _q(
        lambda e: Q.complexity(e, "user_id", "event_id", "value").select("user_id", "h", "c", "fisher"),
        """, p AS (SELECT user_id, v, list_sort([{'v': v[1], 'i': 0}, {'v': v[2], 'i': 1}, {'v': v[3], 'i': 2}]) AS o FROM (SELECT user_id, [value, lead(value, 1) OVER w, lead(value, 2) OVER w] AS v FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE v[3] IS NOT NULL),
c AS (SELECT user_id, o[1].i::VARCHAR || o[2].i::VARCHAR || o[3].i::VARCHAR AS s, count(*) AS n FROM p GROUP BY 1, 2), q AS (SELECT user_id, s, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c),
st AS (SELECT unnest(['012', '021', '102', '120', '201', '210']) AS s, unnest(range(6)) AS k), f AS (SELECT u.user_id, st.k, coalesce(q.p, 0) AS p FROM (SELECT DISTINCT user_id FROM q) u CROSS JOIN st LEFT JOIN q ON q.user_id = u.user_id AND q.s = st.s),
g AS (SELECT user_id, p, k, lag(p) OVER (PARTITION BY user_id ORDER BY k) AS pp FROM f),
h AS (SELECT user_id, sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) AS s, sum(-(p + 1/6) / 2 * ln((p + 1/6) / 2)) AS m, sum(pow(sqrt(p) - sqrt(pp), 2)) AS fi, max((k IN (0, 5) AND p = 1)::INT) AS edge FROM g GROUP BY user_id)
SELECT user_id, round(s / ln(6), 6) AS h, round((-2 / ((7 / 6) * ln(7) - 2 * ln(12) + ln(6))) * (m - s / 2 - ln(6) / 2) * s / ln(6), 6) AS c, round(CASE WHEN edge = 1 THEN 1.0 ELSE 0.5 END * fi, 6) AS fisher FROM h""",
        _EVENTS, "e AS (SELECT * FROM events)",
    ),
    "lag_one_ljung_box": _q(lambda e: Q.lag_one(e, "user_id", "event_id", "value"), ", c AS (SELECT user_id, event_id, value - avg(value) OVER (PARTITION BY user_id) AS dv FROM e WHERE value IS NOT NULL), l AS (SELECT *, lag(dv) OVER (PARTITION BY user_id ORDER BY event_id) AS pv FROM c), g AS (SELECT user_id, count(*) AS n, sum(dv * pv) / sum(dv * dv) AS r1 FROM l GROUP BY user_id) SELECT user_id, n, round(r1, 6) AS r1, round(n * (n + 2) * r1 * r1 / (n - 1), 6) AS ljung_box FROM g WHERE n > 2 AND r1 IS NOT NULL", _EVENTS, "e AS (SELECT * FROM events)"),
    "vector_step_series": _q(lambda e: V.step_series(e, "label", "vec_id", "embedding").select("vec_id", "label", "cos_step", "move"), f", p AS (SELECT vec_id, label, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings) SELECT vec_id, label, round({_dot('e', 'p')} / (sqrt({_dot('e', 'e')}) * sqrt({_dot('p', 'p')})), 6) AS cos_step, CASE WHEN p IS NOT NULL THEN round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(e[i]::DOUBLE - p[i]::DOUBLE, 2)))), 6) END AS move FROM p", _EMB, "z AS (SELECT 1)"),
    "vector_to_centroid": _q(lambda e: V.to_centroid(e, "label", "embedding").select("vec_id", "label", "cos_centroid"), f"{_CENT} SELECT vec_id, e.label, round({_dot('embedding', 'c')} / (sqrt({_dot('embedding', 'embedding')}) * sqrt({_dot('c', 'c')})), 6) AS cos_centroid FROM embeddings e JOIN ce USING (label)", _EMB, "z AS (SELECT 1)"),
}


def _pca(spark, d):
    e = _EMB(spark, d)
    return rounded(V.project(e, "embedding", V.first_component(e, "embedding")).select("vec_id", "pca1"))


QUERIES["vector_pca1"] = (_pca, "")
