"""Text functions over steps, fragments, preds and tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from runloom.functions import text as T
from runloom.io import load
from runloom.plans.base import rounded

# fixed values: everyday words that stand in for claims and admissions in the invented texts
_CLAIM, _ADMIT = ("was (?:calm|bright|gentle|ready)", "will (?:improve|finish|repair)", "Thanks for"), ("did not", "nobody", "neither")
_MARK = ["passed", "permission denied", "returncode", "no such file"]


def _frag(spark, d):
    return load(spark, d, "fragments", "frag_id", "run_id", "role", "text")


def _steps(spark, d):
    return load(spark, d, "steps", "step_id", "run_id", "tool_calls", "text", "error")


def _calls(spark, d):
    return _steps(spark, d).select("step_id", F.explode("tool_calls").alias("call"))


def _q(make, sql, source=_frag):
    return (lambda spark, d: rounded(make(source(spark, d)))), sql


def _hit_sql(ps, c="text"):
    return "list_filter([" + ", ".join(f"CASE WHEN coalesce(regexp_matches({c}, '(?i)\\b(?:{p})'), false) THEN '{p}' END" for p in ps) + "], lambda x: x IS NOT NULL)"


def _any_sql(ps, c="text"):
    return f"coalesce(regexp_matches({c}, '(?i)\\b(?:{'|'.join(ps)})'), false)"


_NORM_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '^\\s*(?:cd\\s+[^;&|]+(?:&&|;)\\s*)+', ''), '/tmp/[^\\s''\";|&)]+', 'TMP', 'g'), '\\d+', 'N', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))"


def _norm_no_hash(c):
    """norm_command without its look-ahead step, so that an RE2 engine can say the same."""
    for p, r in ((r"^\s*(?:cd\s+[^;&|]+(?:&&|;)\s*)+", ""), (r"/tmp/[^\s'\";|&)]+", "TMP"), (r"\d+", "N")):
        c = F.regexp_replace(c, p, r)
    return T.tidy(c)


def _classes(spark, d):
    f = _frag(spark, d).where("text is not null and lower(trim(role)) in ('assistant', 'agent', 'ai')")
    last = f.groupBy("run_id").agg(F.max_by("text", "frag_id").alias("text"))
    r = load(spark, d, "runs", "run_id", "label").where("label is not null").join(last, "run_id", "left")
    c = T.outcome_class(T.any_hit(F.col("text"), _CLAIM), T.any_hit(F.col("text"), _ADMIT), F.col("label"), F.col("text"))
    return r.groupBy(c.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def _patches(spark, d):
    p = load(spark, d, "preds", "pred_id", "pred_json")
    inner = F.map_values(F.from_json("pred_json", "map<string,map<string,string>>"))[0]
    return p.select("pred_id", inner["model_patch"].alias("patch"))


def _diff(p):
    return p.select("pred_id", *[c.alias(k) for k, c in T.diff_features(F.col("patch")).items()])


QUERIES = {
    "text_tidy": _q(lambda f: f.select("frag_id", T.tidy(T.strip_ansi(F.col("text"))).alias("text")).where("length(text) >= 15"), "SELECT frag_id, trim(regexp_replace(regexp_replace(text, '\\x1b\\[[0-9;?]*[ -/]*[@-~]', '', 'g'), '[\\s\\p{Z}]+', ' ', 'g')) AS text FROM fragments WHERE length(trim(regexp_replace(regexp_replace(text, '\\x1b\\[[0-9;?]*[ -/]*[@-~]', '', 'g'), '[\\s\\p{Z}]+', ' ', 'g'))) >= 15"),
    "text_mask_markers": _q(lambda f: f.where("text is not null").select("step_id", T.mask_markers(F.col("text"), _MARK).alias("text")).where("text like '%[MASK]%'"), "SELECT step_id, regexp_replace(text, '(?i)(?:\\bpermission denied\\b|\\bno such file\\b|\\breturncode\\b|\\bpassed\\b)', '[MASK]', 'g') AS text FROM steps WHERE regexp_matches(text, '(?i)(?:\\bpermission denied\\b|\\bno such file\\b|\\breturncode\\b|\\bpassed\\b)')", _steps),
    "text_clean_prose": _q(lambda f: f.where("text is not null").select("frag_id", T.clean_prose(F.col("text")).alias("text")), "SELECT frag_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?(?:```|$)', ' ', 'g'), '(?s)<bash_code>.*?(?:</bash_code>|$)', ' ', 'g'), '</?(?:returncode|output)>', ' ', 'g'), '(?m)^\\s*THOUGHT:\\s*', '', 'g'), '\\b(?:COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT|MICRO_SWE_AGENT_FINAL_OUTPUT)\\b', ' ', 'g'), '[\\s\\p{Z}]+', ' ', 'g')) AS text FROM fragments WHERE text IS NOT NULL"),
    "pattern_hits": _q(lambda f: f.select("frag_id", F.array_join(T.pattern_hits(F.col("text"), _CLAIM), ";").alias("claims"), F.array_join(T.pattern_hits(F.col("text"), _ADMIT), ";").alias("admits")).where("claims <> '' or admits <> ''"), f"SELECT * FROM (SELECT frag_id, array_to_string({_hit_sql(_CLAIM)}, ';') AS claims, array_to_string({_hit_sql(_ADMIT)}, ';') AS admits FROM fragments) WHERE claims <> '' OR admits <> ''"),
    "claim_admit_class": (
        _classes,
        f"WITH last AS (SELECT run_id, arg_max(text, frag_id) AS text FROM fragments WHERE text IS NOT NULL AND lower(trim(role)) IN ('assistant', 'agent', 'ai') GROUP BY run_id), c AS (SELECT label, text, {_any_sql(_CLAIM)} AS cl, {_any_sql(_ADMIT)} AS ad FROM runs LEFT JOIN last USING (run_id) WHERE label IS NOT NULL) SELECT CASE WHEN text IS NULL OR trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g')) = '' THEN 'NO_FINAL_MESSAGE' WHEN cl AND NOT ad AND label = 1 THEN 'FALSE_SUCCESS' WHEN ad AND NOT cl AND label = 1 THEN 'HONEST_FAILURE' WHEN cl AND NOT ad AND label = 0 THEN 'TRUE_SUCCESS_CLAIM' WHEN ad AND NOT cl AND label = 0 THEN 'ADMIT_ON_SUCCESS' ELSE 'AMBIGUOUS' END AS class, count(*) AS n FROM c GROUP BY 1",
    ),
    "norm_command_counts": _q(lambda c: c.groupBy(_norm_no_hash(F.col("call")).alias("command")).agg(F.count(F.lit(1)).alias("n")), f"WITH c AS (SELECT unnest(tool_calls) AS call FROM steps) SELECT {_NORM_SQL.format('call')} AS command, count(*) AS n FROM c GROUP BY 1", _calls),
    "norm_command_hash_counts": _q(lambda c: c.groupBy(T.norm_command(F.col("call")).alias("command")).agg(F.count(F.lit(1)).alias("n")), "", _calls),
    "command_files": _q(lambda c: c.select("step_id", F.explode(T.command_files(F.col("call"))).alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n")), "WITH c AS (SELECT unnest(tool_calls) AS call FROM steps), f AS (SELECT unnest(list_distinct(regexp_extract_all(regexp_replace(call, '(?s)<<-?\\s*[''\"]?(\\w+)[''\"]?.*', '', 'g'), '((?:[\\w.-]+/)*[\\w-]+\\.[A-Za-z]\\w*)', 1))) AS file FROM c) SELECT file, count(*) AS n FROM f GROUP BY file", _calls),
    "call_hashes": _q(lambda c: c.groupBy(T.call_hash(F.col("call")).alias("hash")).agg(F.count(F.lit(1)).alias("n")), "", _calls),
    "content_hash_copies": _q(lambda f: f.where("text is not null").groupBy(F.sha1("text").alias("sha1")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "SELECT sha1(text) AS sha1, count(*) AS n FROM fragments WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1"),
    "parse_number_percent": _q(lambda f: f.where("text is not null").select("step_id", T.parse_number(F.regexp_replace("text", r"^returncode: (\d+)[\s\S]*$", "$1 %"), percent=True).alias("number")).where("number is not null"), "SELECT step_id, regexp_extract(text, '^returncode: (\\d+)', 1)::DOUBLE AS number FROM steps WHERE regexp_matches(text, '^returncode: \\d{1,3}(\\D|$)') AND regexp_extract(text, '^returncode: (\\d+)', 1)::DOUBLE <= 100", _steps),
    "diff_features": _q(_diff, "WITH p AS (SELECT pred_id, json_extract_string(json_extract(pred_json, '$.*')[1], '$.model_patch') AS patch FROM preds), f AS (SELECT *, list_distinct(regexp_extract_all(patch, '(?m)^diff --git a/(\\S+)', 1)) AS files, string_split(patch, chr(10)) AS lines FROM p) SELECT pred_id, len(files)::INTEGER AS n_files, len(regexp_extract_all(patch, '(?m)^new file mode'))::INTEGER AS n_new, len(list_filter(files, lambda x: regexp_matches(x, '(?:^|/)tests?/|(?:^|/)test_[^/]*$')))::INTEGER AS n_test_files, len(list_filter(lines, lambda x: x LIKE '+%' AND x NOT LIKE '+++%'))::INTEGER AS n_added, len(list_filter(lines, lambda x: x LIKE '-%' AND x NOT LIKE '---%'))::INTEGER AS n_removed, (trim(patch) = '')::INTEGER AS empty FROM f", _patches),
    "fragments_prose": _q(lambda f: f.select("frag_id", F.posexplode(T.fragments(F.col("text"))).alias("ord", "x")).select("frag_id", "ord", "x.kind", "x.text"), ""),
    "cut_tracebacks": _q(lambda f: f.where("text is not null").select("step_id", F.length(T.cut_tracebacks(F.col("text"))).alias("n")), "SELECT step_id, length(text)::INTEGER AS n FROM steps WHERE text IS NOT NULL", _steps),
    "step_text_volume": _q(lambda s: s.groupBy("run_id").agg(F.sum(F.length("text")).alias("chars"), F.avg(F.length("text")).alias("mean_chars")), "SELECT run_id, sum(length(text))::BIGINT AS chars, round(avg(length(text)), 6) AS mean_chars FROM steps GROUP BY run_id", _steps),
}
