"""Graph, context and budget queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandwell.operators import context as c
from strandwell.operators import graph as g
from strandwell.operators import nodes as n
from strandwell.operators.filters import acl_any, clearance
from strandwell.records import read

E_SQL = "e AS (SELECT DISTINCT trim(from_canonical_id) AS src, trim(to_canonical_id) AS dst, coalesce(nullif(lower(trim(edge_type)), ''), 'unknown') AS edge_type FROM rag_edge WHERE trim(from_canonical_id) <> '' AND trim(to_canonical_id) <> '')"
SEEDS_SQL = "s AS (SELECT DISTINCT src AS seed FROM e WHERE edge_type IN ('sql_calls', 'calls'))"


def _edges(s, d):
    return g.clean_edges(read(s, d, "rag_edge"))


def _seeds(s, d):
    """Every node that calls another."""
    return _edges(s, d).where(g.type_allowed(["calls"])).select(F.col("src").alias("seed")).distinct()


def _bfs_sql(edges: str = "e", seeds: str = "s", depth: int = 2) -> str:
    return (
        f"r AS (WITH RECURSIVE w AS (SELECT seed, seed AS node, 0 AS depth FROM {seeds} UNION SELECT w.seed, x.dst, w.depth + 1 FROM w JOIN {edges} x ON x.src = w.node WHERE w.depth < {depth}) "
        "SELECT seed, node, min(depth) AS depth FROM w GROUP BY 1, 2)"
    )


def _visible(s, d):
    return read(s, d, "rag_node").where(acl_any(["finance", "security"]) & clearance(10)).where("canonical_id IS NOT NULL").select("canonical_id").distinct()


VIS = "v AS (SELECT DISTINCT canonical_id FROM rag_node WHERE canonical_id IS NOT NULL AND (acl_allow IS NULL OR list_has_any(acl_allow, ['finance','security'])) AND (doc_level IS NULL OR doc_level <= 10))"
INNER = "i AS (SELECT * FROM e WHERE src IN (SELECT canonical_id FROM v) AND dst IN (SELECT canonical_id FROM v))"


def _expand(s, d):
    """From the least calling node of every repository, without reaching the cap."""
    seeds = [r.s for r in _seeds(s, d).groupBy(F.split("seed", "::")[0]).agg(F.min("seed").alias("s")).collect()]  # one a repository
    nodes, _ = g.expand(_edges(s, d), sorted(seeds), 3, 100_000)
    return nodes.select("node", "depth")


def _texts(s, d):
    return read(s, d, "rag_node").where("canonical_id IS NOT NULL").groupBy("canonical_id").agg(F.max("text").alias("text"), F.max("snapshot_id").alias("snapshot_id"))


def _reached_texts(s, d):
    """Texts around each seed in (depth, node) order."""
    reached = g.distances(_edges(s, d), _seeds(s, d))
    t = _texts(s, d).select(F.col("canonical_id").alias("node"), "text")
    order = F.row_number().over(Window.partitionBy("seed").orderBy("depth", "node"))
    return reached.join(t, "node").select("seed", "node", "depth", c.approx_tokens("text").alias("tokens"), order.alias("place"))


TEXTS_SQL = (
    f"WITH {E_SQL}, {SEEDS_SQL}, {_bfs_sql()}, t AS (SELECT canonical_id AS node, max(text) AS text FROM rag_node WHERE canonical_id IS NOT NULL GROUP BY 1), "
    "x AS (SELECT seed, node, depth, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens, row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS place FROM r JOIN t USING (node))"
)


def _budgeted(s, d):
    return c.greedy_fit(_reached_texts(s, d), "seed", "place", "tokens", 700).select("seed", "node", "tokens", "place")


BUDGET_SQL = TEXTS_SQL + (
    ", f AS (WITH RECURSIVE w AS (SELECT seed, node, tokens, place, CASE WHEN tokens <= 700 THEN tokens ELSE 0 END AS used, tokens <= 700 AS kept FROM x WHERE place = 1 "
    "UNION ALL SELECT x.seed, x.node, x.tokens, x.place, CASE WHEN w.used + x.tokens <= 700 THEN w.used + x.tokens ELSE w.used END, w.used + x.tokens <= 700 FROM w JOIN x ON x.seed = w.seed AND x.place = w.place + 1) SELECT * FROM w) "
    "SELECT seed, node, tokens, CAST(place AS INTEGER) AS place FROM f WHERE kept"
)

TURNS_SQL = "SELECT lower(trim(session_id)) AS session_id, turn_id, max(finalized_at_utc) AS ts, max(question_neutral) AS q, max(answer_neutral) AS a FROM conversation_turn WHERE trim(session_id) <> '' GROUP BY 1, 2"


def _turns(s, d):
    t = read(s, d, "conversation_turn").where(F.trim("session_id") != "")
    return t.groupBy(F.lower(F.trim("session_id")).alias("session_id"), "turn_id").agg(F.max("finalized_at_utc").alias("at"), F.max("question_neutral").alias("q"), F.max("answer_neutral").alias("a"))


def _trimmed_history(s, d):
    size = c.approx_tokens("q") + c.approx_tokens("a") + 32
    return c.newest_that_fit(_turns(s, d), "session_id", [F.desc_nulls_last("at"), F.desc("turn_id")], size, 200).select("session_id", "turn_id", "running")


HIST_SQL = f"""WITH t AS ({TURNS_SQL}), z AS (SELECT *, CASE WHEN length(coalesce(q, '')) = 0 THEN 0 ELSE greatest(1, length(q) // 4) END + CASE WHEN length(coalesce(a, '')) = 0 THEN 0 ELSE greatest(1, length(a) // 4) END + 32 AS n FROM t)
SELECT session_id, turn_id, CAST(sum(n) OVER (PARTITION BY session_id ORDER BY ts DESC NULLS LAST, turn_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM z QUALIFY running <= 200"""


def _ordered(s, d, mode):
    reached = g.distances(_edges(s, d), _seeds(s, d))
    seeds = reached.where("depth = 0").select("seed", "node", F.lit(1).alias("rank"))
    graph = reached.where("depth > 0")
    arrange = {"seed_first": c.seeds_then_rest, "graph_first": c.rest_then_seeds, "balanced": c.balanced}[mode]
    return arrange(seeds, graph, "seed", "node").select("seed", "node", "place")


_B = f"WITH {E_SQL}, {SEEDS_SQL}, {_bfs_sql()} "
NODE_COLS = ("canonical_id", "repo_relative_path", "class_name", "member_name", "text")

QUERIES = {
    "g01_expand": (_expand, f"WITH {E_SQL}, {SEEDS_SQL}, s1 AS (SELECT min(seed) AS seed FROM s GROUP BY string_split(seed, '::')[1]), {_bfs_sql('e', 's1', 3)} SELECT node, min(depth) AS depth FROM r GROUP BY 1"),
    "g01_distances": (lambda s, d: g.distances(_edges(s, d), _seeds(s, d)), _B + "SELECT * FROM r"),
    "g02_allowlist": (lambda s, d: g.distances(_edges(s, d), _seeds(s, d), 2, ["CALLS", "sql_ReadsFrom"]), f"WITH {E_SQL}, {SEEDS_SQL}, e2 AS (SELECT * FROM e WHERE edge_type IN ('calls','sql_calls','cs_calls','readsfrom','sql_readsfrom','cs_readsfrom')), {_bfs_sql('e2')} SELECT * FROM r"),
    "g03_seed_scope": (lambda s, d: g.one_scope(read(s, d, "rag_node")), "SELECT count(DISTINCT canonical_id) AS n_seeds, count(DISTINCT lower(string_split(canonical_id, '::')[1])) AS n_repos, count(DISTINCT string_split(canonical_id, '::')[2]) AS n_snapshots, n_repos <= 1 AND n_snapshots <= 1 AS consistent FROM rag_node WHERE len(string_split(canonical_id, '::')) >= 4"),
    "g04_travel": (lambda s, d: g.travel(_edges(s, d), _seeds(s, d), _visible(s, d)), f"WITH {E_SQL}, {SEEDS_SQL}, {VIS}, {INNER}, s2 AS (SELECT seed FROM s WHERE seed IN (SELECT canonical_id FROM v)), {_bfs_sql('i', 's2')} SELECT * FROM r"),
    "g05_clean_edges": (_edges, f"WITH {E_SQL} SELECT * FROM e"),
    "g05_malformed": (lambda s, d: g.malformed_edges(read(s, d, "rag_edge")), "SELECT count(*) AS n_edges, count(*) FILTER (coalesce(trim(from_canonical_id), '') = '' OR coalesce(trim(to_canonical_id), '') = '') AS n_malformed, count(*) FILTER (coalesce(trim(edge_type), '') = '') AS n_untyped FROM rag_edge"),
    "g06_parents": (lambda s, d: g.with_parents(_edges(s, d), g.distances(_edges(s, d), _seeds(s, d))), _B + "SELECT r.seed, r.node, r.depth, min(u.node) AS parent FROM r LEFT JOIN (SELECT DISTINCT src, dst FROM e) x ON x.dst = r.node LEFT JOIN r u ON u.seed = r.seed AND u.node = x.src AND u.depth = r.depth - 1 GROUP BY 1, 2, 3"),
    "g07_roots": (lambda s, d: n.roots(g.distances(_edges(s, d), _seeds(s, d))), _B + "SELECT node, arg_min(seed, (depth, seed)) AS root, min(depth) AS depth FROM r GROUP BY 1"),
    "j03_frontier": (lambda s, d: n.frontier(_edges(s, d), _seeds(s, d)), f"WITH {E_SQL}, {SEEDS_SQL} SELECT seed, dst, edge_type FROM s JOIN e ON seed = src"),
    "j04_inner_edges": (lambda s, d: g.inner_edges(_edges(s, d), _visible(s, d)).select("src", "dst", "edge_type"), f"WITH {E_SQL}, {VIS}, {INNER} SELECT * FROM i"),
    "ag02_edge_types": (lambda s, d: g.edge_type_counts(read(s, d, "rag_edge")), "SELECT coalesce(nullif(lower(trim(edge_type)), ''), 'unknown') AS edge_type, count(*) AS n FROM rag_edge GROUP BY 1"),
    "sc08_tenant_edges": (lambda s, d: n.tenant_edges(read(s, d, "rag_edge"), "961f94ce-8a65-553b-801e-f42ff2a283a7").select("from_canonical_id", "to_canonical_id", "edge_type"), "SELECT from_canonical_id, to_canonical_id, edge_type FROM rag_edge WHERE snapshot_id = '961f94ce-8a65-553b-801e-f42ff2a283a7'"),
    "sc09_fetch_nodes": (
        lambda s, d: n.fetched(_seeds(s, d).withColumnRenamed("seed", "canonical_id"), read(s, d, "rag_node"), ["text", "class_name"], clearance(10)),
        f"WITH {E_SQL}, {SEEDS_SQL} SELECT DISTINCT canonical_id, coalesce(text, '') AS text, coalesce(class_name, '') AS class_name FROM rag_node WHERE canonical_id IN (SELECT seed FROM s) AND (doc_level IS NULL OR doc_level <= 10)",
    ),
    "b01_budgeted": (_budgeted, BUDGET_SQL),
    "b03_seed_first": (lambda s, d: _ordered(s, d, "seed_first"), _B + "SELECT seed, node, CAST(row_number() OVER (PARTITION BY seed ORDER BY CASE WHEN depth = 0 THEN 0 ELSE 1 END, depth, node) AS INTEGER) AS place FROM r"),
    "b03_balanced": (lambda s, d: _ordered(s, d, "balanced"), _B + ", k AS (SELECT seed, node, depth > 0 AS side, row_number() OVER (PARTITION BY seed, depth > 0 ORDER BY depth, node) AS rank FROM r) SELECT seed, node, CAST(row_number() OVER (PARTITION BY seed ORDER BY rank, side) AS INTEGER) AS place FROM k"),
    "b04_blocks": (
        lambda s, d: read(s, d, "rag_node").where("canonical_id IS NOT NULL").select("canonical_id", "import_id", F.md5(c.node_block()).alias("block")),
        "SELECT canonical_id, import_id, md5(concat_ws(chr(10), '--- NODE ---', 'id: ' || canonical_id, CASE WHEN repo_relative_path <> '' THEN 'path: ' || repo_relative_path END, CASE WHEN class_name <> '' THEN 'class: ' || class_name END, CASE WHEN member_name <> '' THEN 'member: ' || member_name END, coalesce(text, ''), '--- END NODE ---')) AS block FROM rag_node WHERE canonical_id IS NOT NULL AND canonical_id <> '' UNION ALL SELECT canonical_id, import_id, md5(concat_ws(chr(10), '--- NODE ---', CASE WHEN repo_relative_path <> '' THEN 'path: ' || repo_relative_path END, CASE WHEN class_name <> '' THEN 'class: ' || class_name END, CASE WHEN member_name <> '' THEN 'member: ' || member_name END, coalesce(text, ''), '--- END NODE ---')) FROM rag_node WHERE canonical_id = ''",
    ),
    "b07_divider": (
        lambda s, d: read(s, d, "rag_node").where("text IS NOT NULL").select("canonical_id", "import_id", F.md5(c.with_divider("text", "//")).alias("with_one"), F.md5(c.without_divider("text", "//")).alias("without")),
        "SELECT canonical_id, import_id, md5(CASE WHEN starts_with(text, '//') THEN text ELSE '//' || chr(10) || text END) AS with_one, md5(CASE WHEN starts_with(text, '//' || chr(10)) THEN substr(text, 4) ELSE text END) AS without FROM rag_node WHERE text IS NOT NULL",
    ),
    "b08_tokens": (lambda s, d: read(s, d, "rag_node").select("canonical_id", "import_id", c.approx_tokens("text").alias("tokens")), "SELECT canonical_id, import_id, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens FROM rag_node"),
    "b09_history_trim": (_trimmed_history, HIST_SQL),
    "ag10_dialog_tokens": (lambda s, d: c.dialog_tokens(_turns(s, d), "session_id", "q", "a"), f"WITH t AS ({TURNS_SQL}) SELECT session_id, CAST(sum(CASE WHEN length(coalesce(q, '')) = 0 THEN 0 ELSE greatest(1, length(q) // 4) END + CASE WHEN length(coalesce(a, '')) = 0 THEN 0 ELSE greatest(1, length(a) // 4) END) AS BIGINT) AS tokens FROM t GROUP BY 1"),
    "b03_graph_first": (lambda s, d: _ordered(s, d, "graph_first"), _B + "SELECT seed, node, CAST(row_number() OVER (PARTITION BY seed ORDER BY CASE WHEN depth = 0 THEN 1 ELSE 0 END, depth, node) AS INTEGER) AS place FROM r"),
}
