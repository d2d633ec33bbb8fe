"""Nested records to flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runloom.io import load
from runloom.operators import shred


def _reports(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    reports = load(spark, folder, "reports", "report_id", "task_id", "report")
    return reports.drop("report"), shred.node_table(reports, "report_id", "report")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return shred.flat_reports(*_reports(spark, folder))


def p5_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return shred.shred(load(spark, folder, "reports", "report_id", "report"), "report_id", "report")


# A Python literal is made JSON token by token: strings get double quotes, words and round brackets outside are replaced.
P5_SQL = r"""
WITH RECURSIVE bare AS (SELECT report_id, trim(report, chr(65279) || E' \t\n\r') AS t FROM reports WHERE report IS NOT NULL),
unwrapped AS (
  SELECT report_id, t FROM bare
  UNION ALL
  SELECT report_id, trim(json_extract_string(CASE WHEN json_valid(t) THEN t END::JSON, '$'), chr(65279) || E' \t\n\r') FROM unwrapped WHERE t LIKE '"%' AND json_valid(t)),
plain AS (SELECT report_id, t FROM unwrapped WHERE t NOT LIKE '"%'),
literal AS (
  SELECT report_id, array_to_string(list_transform(regexp_extract_all(t, '\x27(?:[^\x27\\]|\\.)*\x27|"(?:[^"\\]|\\.)*"|[^\x27"]+'), lambda x:
    CASE WHEN x[1] = chr(39) THEN '"' || replace(replace(x[2:-2], '\' || chr(39), chr(39)), '"', '\"') || '"'
         WHEN x LIKE '"%' THEN x
         ELSE replace(replace(translate(replace(x, 'True', 'true'), '()', '[]'), 'False', 'false'), 'None', 'null') END), '') AS t
  FROM plain WHERE NOT json_valid(t)),
readable AS (SELECT report_id, t::JSON AS j FROM plain WHERE json_valid(t) UNION ALL SELECT report_id, t::JSON FROM literal WHERE json_valid(t)),
root AS (SELECT report_id, j, json_type(j, '$.reports') = 'ARRAY' AS listed, len(list_intersect(json_keys(j), ['resolved', 'tests_status', 'patch_is_None', 'patch_exists', 'patch_successfully_applied'])) > 0 AS alone
         FROM readable WHERE json_type(j) = 'OBJECT' AND len(json_keys(j)) > 0),
record AS (
  SELECT report_id, j AS r, NULL AS named FROM root WHERE alone AND NOT coalesce(listed, false)
  UNION ALL SELECT report_id, json_extract(j, '/' || replace(replace(k, '~', '~0'), '/', '~1')), k FROM root, unnest(json_keys(j)) AS u(k) WHERE NOT alone AND NOT coalesce(listed, false)
  UNION ALL SELECT report_id, json_extract(j, '$.reports[' || i || ']'), NULL FROM root, unnest(range(json_array_length(j, '$.reports')::BIGINT)) AS u(i) WHERE listed),
entity AS (SELECT p.report_id, r, coalesce(named, r->>'$.instance_id', p.task_id) AS task_id, lower(trim(r->>'$.resolved')) AS w FROM record JOIN reports p USING (report_id) WHERE json_type(r) = 'OBJECT' AND len(json_keys(r)) > 0),
held AS (SELECT report_id, task_id, g AS test_group, o AS outcome, json_extract(r, '$.tests_status.' || g || '.' || o) AS a FROM entity, unnest(['FAIL_TO_PASS', 'PASS_TO_PASS', 'FAIL_TO_FAIL', 'PASS_TO_FAIL']) AS u(g), unnest(['success', 'failure']) AS v(o)),
entry AS (SELECT report_id, task_id, test_group, outcome, i::INT AS ord, json_extract(a, '$[' || i || ']') AS e FROM held, unnest(range(json_array_length(a)::BIGINT)) AS u(i) WHERE json_type(a) = 'ARRAY'),
test AS (SELECT report_id, task_id, test_group, outcome, ord, CASE json_type(e) WHEN 'OBJECT' THEN e->>'$.name' WHEN 'ARRAY' THEN NULL ELSE e->>'$' END AS test_name FROM entry)
SELECT report_id, task_id, 'REPORT' AS test_group, CASE WHEN w IN ('true', '1', '1.0') THEN 'resolved' WHEN w IN ('false', '0', '0.0') THEN 'unresolved' ELSE 'unknown' END AS outcome, -1 AS ord, '' AS test_name FROM entity
UNION ALL SELECT * FROM test WHERE test_name <> ''"""

QUERIES = {"p5_found": (p5_found, P5_SQL), "p5_nodes": (p5_nodes, "")}
