"""Problem 1 over the node and run tables."""

from __future__ import annotations

from strandwell.operators.snapshot_diff import snapshot_changes
from strandwell.records import read

P1_SQL = r"""
WITH runs AS (
  SELECT lower(trim(repo)) AS repo, trim(branch) AS branch, trim(snapshot_id) AS snap, min(CAST(finished_utc AS TIMESTAMPTZ)) AS fin
  FROM import_run WHERE lower(trim(status)) = 'completed' AND coalesce(trim(finished_utc), '') <> '' GROUP BY 1, 2, 3),
chain AS (SELECT lag(snap) OVER (PARTITION BY repo, branch ORDER BY fin, snap) AS b, snap AS a FROM runs),
rec AS (
  SELECT DISTINCT string_split(canonical_id, '::')[2] AS snap, array_to_string(string_split(canonical_id, '::')[3:], '::') AS k,
    regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[ \t\f\v]+(\n|$)', '\1', 'g'), '\n+$', '') AS t
  FROM rag_node WHERE len(string_split(canonical_id, '::')) >= 4),
x AS (SELECT c.a AS snap, r.k, r.t FROM chain c JOIN rec r ON r.snap = c.a WHERE c.b IS NOT NULL),
y AS (SELECT c.a AS snap, r.k, r.t FROM chain c JOIN rec r ON r.snap = c.b WHERE c.b IS NOT NULL)
SELECT coalesce(x.snap, y.snap) AS snapshot_id, coalesce(x.k, y.k) AS record_key,
  CASE WHEN y.k IS NULL THEN 'added' WHEN x.k IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM x FULL JOIN y ON x.snap = y.snap AND x.k = y.k WHERE x.k IS NULL OR y.k IS NULL OR x.t <> y.t
"""

QUERIES = {"p1_found": (lambda s, d: snapshot_changes(read(s, d, "rag_node"), read(s, d, "import_run")), P1_SQL)}
