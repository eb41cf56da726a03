"""Whole pipelines over the tables: a fork over every snapshot, with access, graph and budget, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwell.catalog.graphs import E_SQL
from strandwell.plans import engine, loader
from strandwell.records import read

QUESTION = "rebuilds the price table while the lock is held"
ACCESS = {"acl_tags_any": ["finance", "security"], "classification_labels_all": ["public", "internal"], "user_level": 20}
BUDGET = 60_000
FITS = BUDGET * 7 // 10  # texts get seven tenths of the context
DEPTH, MOST_NODES = 2, 100_000

FORK = f"""
name: retrieval
settings: {{entry_step_id: ask, top_k: 3, default_search_method: bm25, graph_max_depth: {DEPTH}, graph_max_nodes: {MOST_NODES}, max_context_tokens: {BUDGET}}}
steps:
  - {{id: ask, action: translate_in_if_needed, next: fork}}
  - {{id: fork, action: fork_action, next: search}}
  - {{id: search, action: search_nodes, next: expand}}
  - {{id: expand, action: expand_dependency_tree, next: fetch}}
  - {{id: fetch, action: fetch_node_texts, next: end}}
"""


def _ran(s, d, until):
    """The pipeline's state after a step, for a fork over every snapshot of the table."""
    nodes = read(s, d, "rag_node")
    plan = sorted(r.snapshot_id for r in nodes.where("snapshot_id IS NOT NULL").select("snapshot_id").distinct().collect())  # the snapshots asked for are a parameter
    raw = loader.resolve("retrieval", loader.load([FORK]))
    for step in raw["steps"]:
        if step["id"] == until:
            step["next"] = "end"
    return engine.run(loader.build(raw), engine.State(QUESTION, dict(ACCESS), variables={"snapshots": plan}), engine.Runtime(s, nodes, read(s, d, "rag_edge")))


def _expanded(s, d):
    return _ran(s, d, "expand").graph_nodes.select("node", "depth")


def _fetched(s, d):
    texts = _ran(s, d, "fetch").node_texts
    return s.createDataFrame([(r["node"], int(r["place"]), int(r["tokens"])) for r in texts], "node string, place int, tokens int")


VISIBLE_SQL = "(acl_allow IS NULL OR list_has_any(acl_allow, ['finance','security'])) AND (classification_labels IS NULL OR list_has_all(['public','internal'], classification_labels)) AND (doc_level IS NULL OR doc_level <= 20)"
_FIELDS = ", ".join(f"max({c})" for c in ("text", *engine.NODE_FIELDS))
HITS_SQL = f"""
d AS (SELECT snapshot_id, canonical_id AS doc_id, max({VISIBLE_SQL}) AS seen, regexp_extract_all(lower(concat_ws(' ', {_FIELDS})), '[a-z0-9_]+') AS w FROM rag_node WHERE snapshot_id IS NOT NULL AND canonical_id IS NOT NULL GROUP BY 1, 2),
st AS (SELECT snapshot_id, count(*) AS n, avg(len(w)) AS avg_dl FROM d WHERE len(w) > 0 GROUP BY 1),
qt AS (SELECT DISTINCT unnest(regexp_extract_all(lower('{QUESTION}'), '[a-z0-9_]+')) AS term),
p AS (SELECT snapshot_id, doc_id, seen, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT snapshot_id, doc_id, seen, len(w) AS dl, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3, 4),
df AS (SELECT snapshot_id, term, count(*) AS df FROM p GROUP BY 1, 2),
bm AS (SELECT p.snapshot_id AS query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score FROM p JOIN df USING (snapshot_id, term) JOIN st USING (snapshot_id) WHERE seen GROUP BY 1, 2),
hits AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bm QUALIFY rank <= 3)
"""
TREE_SQL = f"""
{HITS_SQL}, {E_SQL}, v AS (SELECT DISTINCT canonical_id FROM rag_node WHERE snapshot_id IS NOT NULL AND canonical_id IS NOT NULL AND {VISIBLE_SQL}),
i AS (SELECT src, dst FROM e WHERE src IN (SELECT canonical_id FROM v) AND dst IN (SELECT canonical_id FROM v)),
g AS (SELECT node, min(depth) AS depth FROM (WITH RECURSIVE w AS (SELECT doc_id AS node, 0 AS depth FROM hits UNION SELECT i.dst, w.depth + 1 FROM w JOIN i ON i.src = w.node WHERE w.depth < {DEPTH}) SELECT * FROM w) GROUP BY 1)
"""
TEXTS_SQL = f"""
{TREE_SQL}, s AS (SELECT doc_id AS node, CAST(row_number() OVER (ORDER BY query_id, rank) AS INTEGER) AS place FROM hits),
o AS (SELECT node, place FROM s UNION ALL SELECT node, CAST((SELECT count(*) FROM s) + row_number() OVER (ORDER BY depth, node) AS INTEGER) FROM g WHERE node NOT IN (SELECT node FROM s)),
t AS (SELECT canonical_id AS node, max(text) AS text FROM rag_node WHERE snapshot_id IS NOT NULL AND {VISIBLE_SQL} GROUP BY 1),
x AS (SELECT node, place, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens, row_number() OVER (ORDER BY place) AS n FROM o JOIN t USING (node)),
f AS (WITH RECURSIVE w AS (SELECT node, place, tokens, n, CASE WHEN tokens <= {FITS} THEN tokens ELSE 0 END AS used, tokens <= {FITS} AS kept FROM x WHERE n = 1
  UNION ALL SELECT x.node, x.place, x.tokens, x.n, CASE WHEN w.used + x.tokens <= {FITS} THEN w.used + x.tokens ELSE w.used END, w.used + x.tokens <= {FITS} FROM w JOIN x ON x.n = w.n + 1) SELECT * FROM w)
"""

QUERIES = {
    "d00_pipeline": (_fetched, f"WITH {TEXTS_SQL} SELECT node, place, CAST(tokens AS INTEGER) AS tokens FROM f WHERE kept"),
    "d02_expand_visible": (_expanded, f"WITH {TREE_SQL} SELECT node, CAST(depth AS INTEGER) AS depth FROM g"),
    "d18_compare": (lambda s, d: _ran(s, d, "search").hits, f"WITH {HITS_SQL} SELECT * FROM hits"),
}
