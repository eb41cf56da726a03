"""Filter and search queries over documents, embeddings and nodes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwell.operators import evaluation, nodes
from strandwell.operators import filters as f
from strandwell.operators import ranking as r
from strandwell.records import read
from strandwell.streaming.trace import visibility

ACL, LABELS, LEVEL = ["finance", "security"], ["public", "internal", "secret"], 10
ACL_SQL, LABELS_SQL = "['finance','security']", "['public','internal','secret']"
N = "rag_node"


def _where(predicate, *cols):
    cols = cols or ("canonical_id", "import_id")
    return lambda s, d: read(s, d, N).where(predicate()).select(*cols)


def _sql(where: str, cols: str = "canonical_id, import_id") -> str:
    return f"SELECT {cols} FROM rag_node WHERE {where}"


def _docs(s, d):
    return read(s, d, "documents").select("doc_id", "text", "title", "source")


def _queries(s, d):
    """Every document whose id is divisible by 20 asks with its whole title."""
    return read(s, d, "documents").where("doc_id % 20 = 0 AND title IS NOT NULL").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))


def _whole(s, d):
    """Documents as one text of title and text."""
    return read(s, d, "documents").select("doc_id", F.concat_ws(" ", "title", "text").alias("text"), "source")


def _whole_queries(s, d):
    """Every document whose id is divisible by 20 asks with all tokens of its title and text."""
    return _whole(s, d).where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


def _vectors(s, d):
    return read(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def _query_vectors(s, d):
    return read(s, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


BM25_SQL = """
toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents WHERE text IS NOT NULL),
dls AS (SELECT doc_id, len(w) AS dl FROM toks WHERE len(w) > 0), st AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM dls),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM toks) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
qt AS (SELECT DISTINCT doc_id AS query_id, unnest(regexp_extract_all(lower(title), '[a-z0-9_]+')) AS term FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL),
bm AS (SELECT q.query_id, p.doc_id, round(sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * dls.dl / st.avg_dl))), 6) AS score, count(*) AS m
  FROM qt q JOIN post p USING (term) JOIN df USING (term) JOIN dls ON dls.doc_id = p.doc_id CROSS JOIN st GROUP BY 1, 2)
"""
VEC_SQL = """
nrm AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum([x * x FOR x IN CAST(embedding AS DOUBLE[])])) AS n FROM embeddings),
ve AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_dot_product(q.v, e.v) / (q.n * e.n), 6) AS score FROM nrm q, nrm e WHERE q.vec_id % 20 = 0)
"""


def _top(table: str, k: int) -> str:
    return f"SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM {table} QUALIFY rank <= {k}"


def _ranked(hits):
    return hits.select("query_id", "doc_id", "score", "rank")


VIS_SQL = f"(acl_allow IS NULL OR list_has_any(acl_allow, {ACL_SQL})) AND (classification_labels IS NULL OR list_has_all({LABELS_SQL}, classification_labels)) AND (doc_level IS NULL OR doc_level <= {LEVEL})"


def _visible_vectors(s, d):
    """Vectors of the nodes that may be seen, one a node and snapshot."""
    seen = f.acl_any(ACL) & f.labels_subset(LABELS) & f.clearance(LEVEL)
    rows = read(s, d, N).where(seen & F.col("embedding").isNotNull() & F.col("snapshot_id").isNotNull() & F.col("canonical_id").isNotNull())
    return rows.groupBy("snapshot_id", F.col("canonical_id").alias("doc_id")).agg(F.min("embedding").alias("vector"))


def _per_snapshot_topk(s, d):
    """For one node in twenty, by a hash of its id, the visible nodes of its snapshot that are nearest to it; all snapshots in one plan."""
    asking = F.conv(F.substring(F.md5("canonical_id"), 1, 8), 16, 10).cast("long") % 20 == 0
    rows = read(s, d, N).where(asking & F.col("embedding").isNotNull() & F.col("snapshot_id").isNotNull())
    queries = rows.groupBy("snapshot_id", "canonical_id").agg(F.min("embedding").alias("vector")).select("snapshot_id", F.concat_ws("|", "snapshot_id", "canonical_id").alias("query_id"), "vector")
    return _ranked(r.vector_search(_visible_vectors(s, d), queries, 5, part="snapshot_id"))


SNAP_SQL = f"""WITH v AS (SELECT snapshot_id, canonical_id AS doc_id, CAST(min(embedding) AS DOUBLE[]) AS v FROM rag_node WHERE {VIS_SQL} AND embedding IS NOT NULL AND snapshot_id IS NOT NULL AND canonical_id IS NOT NULL GROUP BY 1, 2),
q AS (SELECT snapshot_id, snapshot_id || '|' || canonical_id AS query_id, CAST(min(embedding) AS DOUBLE[]) AS q FROM rag_node WHERE CAST('0x' || substr(md5(canonical_id), 1, 8) AS UBIGINT) % 20 = 0 AND embedding IS NOT NULL AND snapshot_id IS NOT NULL GROUP BY snapshot_id, canonical_id),
s AS (SELECT query_id, doc_id, round(list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))), 6) AS score FROM v JOIN q USING (snapshot_id)) """ + _top("s", 5)

SERVERS = [(1, "local", False, 10, ["finance"], ["public", "internal"]), (2, "shared", False, 30, ["finance", "security", "hr"], ["public", "internal", "secret"]), (3, "vault", True, 0, None, None)]


def _servers(s, d):
    servers = s.createDataFrame(SERVERS, "position int, server_id string, trusted boolean, max_level int, acl array<string>, labels array<string>")
    req = read(s, d, N).where("canonical_id IS NOT NULL").groupBy("canonical_id").agg(F.max("doc_level").alias("doc_level"), F.max("acl_allow").alias("acl"), F.max("classification_labels").alias("labels"))
    return f.admissible_servers(req.withColumnRenamed("canonical_id", "request_id"), servers)


SERVERS_SQL = """WITH q AS (SELECT canonical_id AS request_id, coalesce(max(doc_level), 0) AS l, [lower(x) FOR x IN coalesce(max(acl_allow), [])] AS a, [lower(x) FOR x IN coalesce(max(classification_labels), [])] AS b FROM rag_node WHERE canonical_id IS NOT NULL GROUP BY 1)
SELECT request_id, CASE WHEN l <= 10 AND list_has_all(['finance'], a) AND list_has_all(['public','internal'], b) THEN 'local'
 WHEN l <= 30 AND list_has_all(['finance','security','hr'], a) AND list_has_all(['public','internal','secret'], b) THEN 'shared' ELSE 'vault' END AS server_id FROM q"""

QUERIES = {
    "f01_repo_scope": (_where(lambda: f.equals("repo", "harborline-core")), _sql("repo = 'harborline-core'")),
    "f02_snapshot_scope": (_where(lambda: f.in_snapshot("961f94ce-8a65-553b-801e-f42ff2a283a7")), _sql("snapshot_id = '961f94ce-8a65-553b-801e-f42ff2a283a7'")),
    "f03_acl_any": (_where(lambda: f.acl_any(ACL)), _sql(f"acl_allow IS NULL OR list_has_any(acl_allow, {ACL_SQL})")),
    "f04_labels_any": (_where(lambda: f.labels_any(LABELS, allow_unlabeled=False)), _sql(f"list_has_any(classification_labels, {LABELS_SQL})")),
    "f05_labels_subset": (_where(lambda: f.labels_subset(LABELS)), _sql(f"classification_labels IS NULL OR list_has_all({LABELS_SQL}, classification_labels)")),
    "f06_clearance": (_where(lambda: f.clearance(LEVEL)), _sql(f"doc_level IS NULL OR doc_level <= {LEVEL}")),
    "f07_owner": (_where(lambda: f.equals("owner_id", "team-node") | f.equals("source_system_id", "code.sql")), _sql("owner_id = 'team-node' OR source_system_id = 'code.sql'")),
    "f08_data_type": (_where(lambda: F.col("data_type").isin(f.normalized({"data_type": ["db_code"]})["data_type"])), _sql("data_type = 'sql_code'")),
    "f09_id_in": (
        lambda s, d: read(s, d, N).join(read(s, d, "rag_edge").select(F.col("to_canonical_id").alias("canonical_id")).distinct(), "canonical_id", "left_semi").select("canonical_id", "import_id"),
        _sql("canonical_id IN (SELECT to_canonical_id FROM rag_edge)"),
    ),
    "f10_universe": (_where(lambda: f.labels_within_universe(["public", "internal"], ["public", "internal", "secret"])), _sql("classification_labels IS NULL OR list_has_all(['public','internal'], classification_labels)")),
    "f14_snapshot_member": (lambda s, d: nodes.in_active_sets(read(s, d, N), read(s, d, "snapshot_set")).select("canonical_id", "import_id"), _sql("snapshot_id IN (SELECT unnest(allowed_snapshot_ids) FROM snapshot_set WHERE is_active)")),
    "f15_ref": (lambda s, d: read(s, d, "import_run").where(f.ref_is("develop")).select("import_id", "snapshot_id"), "SELECT import_id, snapshot_id FROM import_run WHERE tag = 'develop' OR ref_name = 'develop' OR branch = 'develop'"),
    "f16_visible": (_where(lambda: f.acl_any(ACL) & f.labels_subset(LABELS) & f.clearance(LEVEL)), _sql(VIS_SQL)),
    "f17_not_deleted": (lambda s, d: read(s, d, "conversation_turn").where(f.not_deleted("finalized_at_utc")).select("turn_id", "session_id"), "SELECT turn_id, session_id FROM conversation_turn WHERE finalized_at_utc IS NULL"),
    "f18_title": (lambda s, d: read(s, d, "documents").where(f.title_contains("Claim")).select("doc_id", "title"), "SELECT doc_id, title FROM documents WHERE contains(lower(title), 'claim')"),
    "f19_stage_visible": (lambda s, d: read(s, d, "events").where(visibility("allowed", "explicit", F.col("event_type") == "error")).select("event_id"), "SELECT event_id FROM events WHERE event_type = 'error'"),
    "f20_gates": (
        lambda s, d: read(s, d, N).select("canonical_id", "import_id", F.array_join(f.gate_reasons("doc_level", 10, "acl_allow", "classification_labels", ["secret"]), ",").alias("reasons")),
        "SELECT canonical_id, import_id, concat_ws(',', CASE WHEN coalesce(doc_level, 0) < 10 THEN 'low_score' END, CASE WHEN len(acl_allow) > 0 THEN 'problems' END, CASE WHEN list_contains(classification_labels, 'secret') THEN 'forbidden_category' END) AS reasons FROM rag_node",
    ),
    "f21_server_admission": (_servers, SERVERS_SQL),
    "d26_server_selection": (lambda s, d: _servers(s, d).groupBy("server_id").agg(F.count("*").alias("n")), f"SELECT server_id, count(*) AS n FROM ({SERVERS_SQL}) GROUP BY 1"),
    "m12_declared": (_where(lambda: f.declared_filter({"file_type": ["sql"], "permission_tags_all": ["finance"]})), _sql("file_type = 'sql' AND list_has_all(coalesce(acl_allow, []), ['finance'])")),
    "r01_bm25_or": (lambda s, d: _ranked(r.bm25(_docs(s, d), _queries(s, d), 10)), f"WITH {BM25_SQL} " + _top("bm", 10)),
    "r01_bm25_and": (lambda s, d: _ranked(r.bm25(_docs(s, d), _queries(s, d), 10, "and")), f"WITH {BM25_SQL}, ba AS (SELECT * FROM bm WHERE m = (SELECT count(*) FROM qt WHERE qt.query_id = bm.query_id)) " + _top("ba", 10)),
    "r01_bm25_filtered": (lambda s, d: _ranked(r.bm25(_docs(s, d), _queries(s, d), 10, keep=F.col("source") == "wiki")), f"WITH {BM25_SQL}, bf AS (SELECT * FROM bm WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'wiki')) " + _top("bf", 10)),
    "r02_vector": (lambda s, d: _ranked(r.vector_search(_vectors(s, d), _query_vectors(s, d), 10)), f"WITH {VEC_SQL} " + _top("ve", 10)),
    "r02_vector_index": (lambda s, d: _ranked(r.VectorIndex(_vectors(s, d)).search(_query_vectors(s, d), 10)), None),
    "r02_vector_recall": (lambda s, d: r.recall(r.VectorIndex(_vectors(s, d)).search(_query_vectors(s, d), 10), r.vector_search(_vectors(s, d), _query_vectors(s, d), 10)), None),
    "r03_weighted": (
        lambda s, d: _ranked(r.weighted(r.vector_search(_vectors(s, d), _query_vectors(s, d), 20), r.bm25(_docs(s, d), _queries(s, d), 20), 10)),
        f"WITH {BM25_SQL}, {VEC_SQL}, b AS ({_top('bm', 20)}), v AS ({_top('ve', 20)}), "
        "bs AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS t FROM b WINDOW w AS (PARTITION BY query_id)), "
        "vs AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS t FROM v WINDOW w AS (PARTITION BY query_id)), "
        "x AS (SELECT query_id, doc_id, round(0.7 * coalesce(vs.t, 0.0) + (1 - 0.7) * coalesce(bs.t, 0.0), 6) AS score FROM vs FULL JOIN bs USING (query_id, doc_id)) " + _top("x", 10),
    ),
    "r04_rrf": (
        lambda s, d: _ranked(r.search("hybrid", _docs(s, d), _queries(s, d), _vectors(s, d), _query_vectors(s, d), 10)),
        f"WITH {BM25_SQL}, {VEC_SQL}, b AS ({_top('bm', 20)}), v AS ({_top('ve', 20)}), x AS (SELECT query_id, doc_id, round(coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS score, coalesce(v.rank, 1000000000) AS ra, coalesce(b.rank, 1000000000) AS rb FROM v FULL JOIN b USING (query_id, doc_id)) "
        "SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ra, rb, doc_id) AS INTEGER) AS rank FROM x QUALIFY rank <= 10",
    ),
    "r05_dispatch_bm25": (lambda s, d: _ranked(r.search("bm25", _docs(s, d), _queries(s, d), None, None, 5)), f"WITH {BM25_SQL} " + _top("bm", 5)),
    "r06_search_visible_nodes": (_per_snapshot_topk, SNAP_SQL),
    "r09_widen": (lambda s, d: _ranked(r.widened(r.vector_search(_vectors(s, d), _query_vectors(s, d), 30), 5)), f"WITH {VEC_SQL} " + _top("ve", 5)),
    "r10_query_dedup": (
        lambda s, d: r.distinct_queries(read(s, d, "conversation_turn"), "question_neutral"),
        r"SELECT DISTINCT lower(trim(regexp_replace(question_neutral, '\s+', ' ', 'g'), ' ')) AS query FROM conversation_turn WHERE question_neutral IS NOT NULL AND lower(trim(regexp_replace(question_neutral, '\s+', ' ', 'g'), ' ')) <> ''",
    ),
    "r12_worst": (lambda s, d: evaluation.worst(read(s, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 50), "SELECT doc_id, n_chars FROM documents ORDER BY n_chars NULLS FIRST, doc_id DESC LIMIT 50"),
    "r13_tfidf": (
        lambda s, d: _ranked(r.tfidf_cosine(_docs(s, d), _queries(s, d), 10)),
        "WITH toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents WHERE text IS NOT NULL), n AS (SELECT count(*) AS n FROM toks WHERE len(w) > 0), post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM toks) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1), "
        "wt AS (SELECT doc_id, term, tf * (ln((1 + n.n) / (1 + df.df)) + 1) AS w FROM post JOIN df USING (term) CROSS JOIN n), nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM wt GROUP BY 1), "
        "q AS (SELECT query_id, term, count(*) * (ln((1 + any_value(n.n)) / (1 + any_value(df.df))) + 1) AS qw FROM (SELECT doc_id AS query_id, unnest(regexp_extract_all(lower(title), '[a-z0-9_]+')) AS term FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL) JOIN df USING (term) CROSS JOIN n GROUP BY 1, 2), "
        "qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qnorm FROM q GROUP BY 1), x AS (SELECT query_id, doc_id, round(sum(qw * w) / (any_value(norm) * any_value(qnorm)), 6) AS score FROM q JOIN wt USING (term) JOIN nm USING (doc_id) JOIN qn USING (query_id) GROUP BY 1, 2) " + _top("x", 10),
    ),
    # The same searches asked with whole documents. No SQL: tests compare them with brute force.
    "r01_bm25_or_whole": (lambda s, d: _ranked(r.bm25(_whole(s, d), _whole_queries(s, d), 10)), None),
    "r01_bm25_and_whole": (lambda s, d: _ranked(r.bm25(_whole(s, d), _whole_queries(s, d), 10, "and")), None),
    "r01_bm25_filtered_whole": (lambda s, d: _ranked(r.bm25(_whole(s, d), _whole_queries(s, d), 10, keep=F.col("source") == "wiki")), None),
    "r03_weighted_whole": (lambda s, d: _ranked(r.weighted(r.vector_search(_vectors(s, d), _query_vectors(s, d), 20), r.bm25(_whole(s, d), _whole_queries(s, d), 20), 10)), None),
    "r04_rrf_whole": (lambda s, d: _ranked(r.search("hybrid", _whole(s, d), _whole_queries(s, d), _vectors(s, d), _query_vectors(s, d), 10)), None),
    "r05_dispatch_bm25_whole": (lambda s, d: _ranked(r.search("bm25", _whole(s, d), _whole_queries(s, d), None, None, 5)), None),
    "r13_tfidf_whole": (lambda s, d: _ranked(r.tfidf_cosine(_whole(s, d), _whole_queries(s, d), 10)), None),
    "ag08_bm25_stats": (lambda s, d: r.bm25_statistics(_docs(s, d)), "SELECT count(*) AS n_docs, avg(dl) AS avg_dl FROM (SELECT len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS dl FROM documents WHERE text IS NOT NULL) WHERE dl > 0"),
}
