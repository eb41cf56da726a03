"""History, security, snapshot, aggregate and window queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandwell.operators import compression, context, evaluation, filters, nodes
from strandwell.operators import history as h
from strandwell.operators import security as sec
from strandwell.operators import snapshots as sn
from strandwell.plans import settings
from strandwell.records import instant, read
from strandwell.streaming import trace

TURN = "conversation_turn"
AT_SQL = "coalesce(TRY_CAST(nullif(finished_utc, '') AS TIMESTAMPTZ), TRY_CAST(nullif(started_utc, '') AS TIMESTAMPTZ))"


def _turn(s, d):
    return read(s, d, TURN).where("finalized_at_utc IS NOT NULL AND session_id IS NOT NULL AND turn_id IS NOT NULL").select("session_id", "turn_id", "identity_id", "finalized_at_utc", "question_neutral").dropDuplicates(["session_id", "turn_id"])


TURN_SQL = "t AS (SELECT DISTINCT ON (session_id, turn_id) session_id, turn_id, identity_id, finalized_at_utc FROM conversation_turn WHERE finalized_at_utc IS NOT NULL AND session_id IS NOT NULL AND turn_id IS NOT NULL)"


SESSION_SQL = "z AS (SELECT session_id, max(identity_id) AS identity_id FROM conversation_turn WHERE session_id IS NOT NULL GROUP BY 1)"


def _sessions(s, d):
    return read(s, d, TURN).where("session_id IS NOT NULL").groupBy("session_id").agg(F.max("identity_id").alias("identity_id"))


def _tags(s, d):
    """The channel of a turn's metadata as a tag of its session."""
    return read(s, d, TURN).where("session_id IS NOT NULL").select("session_id", F.col("metadata")["channel"].alias("tag")).where("tag IS NOT NULL").distinct()


def _messages(s, d):
    """Turns as messages: the time is the greatest text of created_at_utc, which only has to be the same here and in SQL."""
    t = read(s, d, TURN).where("turn_id IS NOT NULL")
    return t.groupBy(F.col("turn_id").alias("message_id")).agg(F.max("session_id").alias("session_id"), F.max("identity_id").alias("identity_id"), F.max("created_at_utc").alias("created_at"), F.max("question_neutral").alias("question"))


MESSAGE_SQL = "m AS (SELECT turn_id AS message_id, max(session_id) AS session_id, max(identity_id) AS identity_id, max(created_at_utc) AS created_at, max(question_neutral) AS question FROM conversation_turn WHERE turn_id IS NOT NULL GROUP BY 1)"
SESSION_ROW = "session_id string, identity_id string, title string, created_at string, updated_at string, deleted_at string"


def _stored_sessions(s, d):
    """Sessions as a chat history has them, for those whose id is in its first half."""
    known = _messages(s, d).where("session_id < 's' OR session_id < '8'")
    return h.new_sessions(s.createDataFrame([], SESSION_ROW), known)


_MADE_SQL = """SELECT session_id, first(identity_id ORDER BY created_at NULLS LAST, message_id) AS identity_id,
  substr(regexp_replace(regexp_replace(first(coalesce(question, '') ORDER BY created_at NULLS LAST, message_id), '\\s+', ' ', 'g'), '^ +| +$', '', 'g'), 1, 64) AS title, min(created_at) AS created_at, max(created_at) AS updated_at FROM m WHERE session_id IS NOT NULL GROUP BY 1"""


def _group_policies(s, d):
    """Groups are tags of nodes, policies the owners of the SQL nodes that bear them."""
    tags = read(s, d, "rag_node").select(F.explode("acl_allow").alias("group_name"), "data_type", "owner_id")
    return sec.groups_with_policies(tags.select("group_name").distinct(), tags.where("data_type = 'sql_code' AND owner_id <> ''").select("group_name", "owner_id").distinct(), "group_name")


def _policy_tables(s, d):
    """Policies of each repository, from its nodes, as the six tables of a policy store."""
    n = read(s, d, "rag_node").where("repo IS NOT NULL").withColumnRenamed("repo", "group_name")
    values = lambda c: n.select("group_name", F.col(c).alias("value"))
    each = lambda c: n.select("group_name", F.explode(c).alias("value"))
    tables = {"groups": n.select("group_name"), "users": values("owner_id"), "acl": each("acl_allow"), "labels": each("classification_labels"), "pipelines": values("branch"), "limits": n.select("group_name", F.col("doc_level").alias("level"), F.col("source_system_id").alias("owner"))}
    from strandwell.sources.policies import policies_from

    lists = [F.array_join(c, ",").alias(c) for c in ("users", "acl", "labels", "pipelines")]
    return policies_from(tables).select("group_name", *lists, "level", "owner")


def _list_sql(c, rows="n"):
    return f"coalesce((SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM {rows} x WHERE x.g = n0.g) WHERE v IS NOT NULL), '')"


def _chunks(s, d):
    """Nodes as retrieved chunks, one request a snapshot."""
    n = read(s, d, "rag_node").where("canonical_id IS NOT NULL AND snapshot_id IS NOT NULL AND repo_relative_path IS NOT NULL")
    one = n.groupBy("snapshot_id", "canonical_id").agg(*[F.max(c).alias(c) for c in ("repo_relative_path", "class_name", "member_name", "chunk_part", "doc_level", "text")])
    return one.select(
        F.col("snapshot_id").alias("request"), F.col("repo_relative_path").alias("path"), F.lit(None).cast("string").alias("namespace"), F.col("class_name").alias("class"), F.col("member_name").alias("member"), F.lit(None).cast("int").alias("start_line"),
        F.lit(None).cast("int").alias("end_line"), F.col("chunk_part").alias("rank"), F.col("doc_level").cast("double").alias("distance"), F.col("text").alias("content"), F.array().cast("array<int>").alias("hit_lines"), "canonical_id",
    )


def _headers(s, d):
    """Headers of each snapshot's chunks, deduplicated by path; chunks of one path and place are told apart by what they show."""
    c = _chunks(s, d).groupBy("request", "path").agg(F.min(F.struct(F.coalesce("rank", F.lit(10000)).alias("r"), F.coalesce("distance", F.lit(10000.0)).alias("t"), F.coalesce("class", F.lit("")).alias("c"), F.coalesce("member", F.lit("")).alias("m"))).alias("x"))
    none = F.lit(None)
    rows = c.select("request", "path", none.cast("string").alias("namespace"), F.col("x.c").alias("class"), F.col("x.m").alias("member"), none.cast("int").alias("start_line"), none.cast("int").alias("end_line"), F.col("x.r").alias("rank"), F.col("x.t").alias("distance"), F.lit("").alias("content"), F.array().cast("array<int>").alias("hit_lines"))
    return compression.compressed(rows, "metadata", budget=120)


HEADER_SQL = """WITH n AS (SELECT snapshot_id AS request, canonical_id, max(repo_relative_path) AS path, max(class_name) AS c, max(member_name) AS m, max(chunk_part) AS r, max(doc_level) AS t FROM rag_node WHERE canonical_id IS NOT NULL AND snapshot_id IS NOT NULL AND repo_relative_path IS NOT NULL GROUP BY 1, 2),
k AS (SELECT request, path, min((coalesce(r, 10000), coalesce(t, 10000), coalesce(c, ''), coalesce(m, ''))) AS x FROM n GROUP BY 1, 2),
o AS (SELECT request, row_number() OVER (PARTITION BY request ORDER BY x[1], x[2], length(path), path) AS p, '- ' || CASE WHEN path = '' THEN '<unknown>' ELSE path END || ' : ' || CASE WHEN x[3] <> '' AND x[4] <> '' THEN x[3] || '.' || x[4] WHEN x[3] <> '' THEN x[3] WHEN x[4] <> '' THEN x[4] ELSE '<symbol>' END AS h FROM k),
u AS (SELECT request, p, h, sum(greatest(1, (length(h) + 1) // 4)) OVER (PARTITION BY request ORDER BY p) AS used FROM o WHERE p <= 8)
SELECT request, coalesce(string_agg(h, chr(10) ORDER BY p) FILTER (used <= 120), '') || chr(10) AS context FROM u GROUP BY 1"""


def _policies(s, d):
    """Each import of a node as a group of that node's policies."""
    n = read(s, d, "rag_node").where("canonical_id IS NOT NULL")
    return n.select(F.col("canonical_id").alias("user_id"), F.col("import_id").alias("position"), F.col("acl_allow").alias("acl"), F.col("classification_labels").alias("labels"), F.col("doc_level").alias("level"), F.col("owner_id").alias("owner")).where("acl IS NOT NULL OR owner <> ''")


def _insert(s, d):
    """All stored turns, with repeats, inserted into the finalized ones, which stay as they are."""
    old = _turn(s, d).select("session_id", "turn_id", F.lit("old").alias("origin"))
    new = read(s, d, TURN).where("session_id IS NOT NULL AND turn_id IS NOT NULL").select("session_id", "turn_id", F.lit("new").alias("origin"))
    return h.insert_new(old, new, ["turn_id", "session_id"])


def _upsert(s, d):
    runs = read(s, d, "import_run").select("import_id", "snapshot_id", "status").dropDuplicates(["import_id"])
    return h.upsert(runs, runs.where("status = 'running'").withColumn("status", F.lit("failed")), ["import_id"])


def _finalize(s, d):
    t = read(s, d, TURN).where("turn_id IS NOT NULL").groupBy("turn_id").agg(F.max("question_neutral").alias("question_neutral"), F.lit(None).cast("string").alias("answer_neutral"), F.lit(None).cast("string").alias("finalized_at_utc"), F.first(F.create_map(F.lit("a"), F.lit("1"))).alias("metadata"))
    a = read(s, d, TURN).where("turn_id IS NOT NULL AND answer_neutral IS NOT NULL").groupBy("turn_id").agg(F.max("answer_neutral").alias("answer_neutral"), F.max("finalized_at_utc").alias("finalized_at_utc"), F.first(F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("3"))).alias("metadata"))
    return h.finalize_turns(t, a, ["turn_id"]).select("turn_id", "answer_neutral", "finalized_at_utc", F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e.key, e.value))), ",").alias("meta"))


def _told(s, d):
    """What a file is by its ending, and what its import took it for."""
    kind = F.lower(F.regexp_replace("file_type", r"^\.", ""))
    actual = F.when(kind == "cs", "dotnet").when(kind == "sql", "sql").otherwise("other")
    predicted = F.when(F.col("data_type") == "regular_code", "dotnet").when(F.col("data_type").isin("sql_code", "db_code"), "sql")
    return read(s, d, "rag_node").select(actual.alias("actual"), predicted.alias("predicted"))


TOLD_SQL = r"w AS (SELECT CASE lower(regexp_replace(file_type, '^\.', '')) WHEN 'cs' THEN 'dotnet' WHEN 'sql' THEN 'sql' ELSE 'other' END AS actual, CASE WHEN data_type = 'regular_code' THEN 'dotnet' WHEN data_type IN ('sql_code','db_code') THEN 'sql' END AS predicted FROM rag_node)"

QUERIES = {
    "l01_session_page": (lambda s, d: h.page(_turn(s, d), "finalized_at_utc", "turn_id", 50, ("2025-06-01", "")).select("turn_id", "finalized_at_utc"), f"WITH {TURN_SQL} SELECT turn_id, finalized_at_utc FROM t WHERE finalized_at_utc < '2025-06-01' ORDER BY finalized_at_utc DESC, turn_id DESC LIMIT 50"),
    "l02_message_page": (lambda s, d: h.last_messages(_turn(s, d), "session_id", "finalized_at_utc", "turn_id", 3, "2025-09").select("session_id", "turn_id", "position"), f"WITH {TURN_SQL}, n AS (SELECT * FROM t WHERE finalized_at_utc < '2025-09' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY finalized_at_utc DESC, turn_id DESC) <= 3) SELECT session_id, turn_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY finalized_at_utc, turn_id) AS INTEGER) AS position FROM n"),
    "l03_previews": (lambda s, d: nodes.previews(read(s, d, "rag_edge")), "SELECT from_canonical_id, to_canonical_id FROM rag_edge ORDER BY from_canonical_id NULLS FIRST, to_canonical_id NULLS FIRST LIMIT 200"),
    "l04_chunk_order": (
        lambda s, d: _chunks(s, d).withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy(*context.chunk_order(), "canonical_id"))).select("request", "canonical_id", "place"),
        "WITH n AS (SELECT snapshot_id AS request, canonical_id, max(repo_relative_path) AS path, max(chunk_part) AS r, max(doc_level) AS t FROM rag_node WHERE canonical_id IS NOT NULL AND snapshot_id IS NOT NULL AND repo_relative_path IS NOT NULL GROUP BY 1, 2) SELECT request, canonical_id, CAST(row_number() OVER (PARTITION BY request ORDER BY coalesce(r, 10000), coalesce(t, 10000), length(path), canonical_id) AS INTEGER) AS place FROM n",
    ),
    "t20_headers": (_headers, HEADER_SQL),
    "l06_stable_unique": (lambda s, d: h.latest(_turn(s, d), ["identity_id"], ["finalized_at_utc", "turn_id"]).select("identity_id", "turn_id"), f"WITH {TURN_SQL} SELECT identity_id, turn_id FROM t QUALIFY row_number() OVER (PARTITION BY identity_id ORDER BY finalized_at_utc, turn_id) = 1"),
    "w02_latest_run": (lambda s, d: sn.latest_run_per_ref(read(s, d, "import_run").dropDuplicates(["import_id"])).select("repo", "ref_type", "ref_name", "import_id"), f"SELECT repo, ref_type, ref_name, import_id FROM (SELECT DISTINCT ON (import_id) * FROM import_run) WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY repo, ref_type, ref_name ORDER BY {AT_SQL} DESC NULLS LAST, import_id) = 1"),
    "w03_last_turns": (lambda s, d: h.last_messages(_turn(s, d), "session_id", "finalized_at_utc", "turn_id", 30).select("session_id", "turn_id", "position"), f"WITH {TURN_SQL}, n AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY finalized_at_utc DESC, turn_id DESC) <= 30) SELECT session_id, turn_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY finalized_at_utc, turn_id) AS INTEGER) AS position FROM n"),
    "w04_first_wins": (lambda s, d: sn.first_wins(read(s, d, "rag_node").where("canonical_id IS NOT NULL"), ["canonical_id"], ["import_id"]).select("canonical_id", "import_id"), "SELECT canonical_id, min(import_id) AS import_id FROM rag_node WHERE canonical_id IS NOT NULL GROUP BY 1"),
    "w07_last_events": (lambda s, d: trace.last_events(read(s, d, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "n"), "SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS n FROM events QUALIFY n <= 600"),
    "j01_hits_to_nodes": (lambda s, d: nodes.hits_with_nodes(read(s, d, "rag_edge").select(F.col("to_canonical_id").alias("canonical_id")).distinct(), read(s, d, "rag_node"), ["class_name"]), "SELECT e.canonical_id, n.class_name FROM (SELECT DISTINCT to_canonical_id AS canonical_id FROM rag_edge) e LEFT JOIN (SELECT canonical_id, max(class_name) AS class_name FROM rag_node WHERE canonical_id IS NOT NULL GROUP BY 1) n USING (canonical_id)"),
    "j05_sessions_with_tag": (lambda s, d: h.with_tag(_sessions(s, d), _tags(s, d), "ide"), f"WITH {SESSION_SQL} SELECT * FROM z WHERE session_id IN (SELECT session_id FROM conversation_turn WHERE metadata['channel'] = 'ide')"),
    "j06_groups_policies": (_group_policies, "WITH t AS (SELECT unnest(acl_allow) AS group_name, data_type, owner_id FROM rag_node), g AS (SELECT DISTINCT group_name FROM t), p AS (SELECT DISTINCT group_name, owner_id FROM t WHERE data_type = 'sql_code' AND owner_id <> '') SELECT g.group_name, p.owner_id FROM g LEFT JOIN p USING (group_name)"),
    "j07_mapping_entries": (
        lambda s, d: sec.with_entries(read(s, d, "region").withColumnRenamed("r_regionkey", "k"), read(s, d, "nation").select(F.col("n_regionkey").alias("k"), "n_name", F.col("n_nationkey").cast("string").alias("v")), "k", "n_name", "v").select("k", F.array_join(F.transform(F.map_entries("entries"), lambda e: F.concat_ws("=", e.key, e.value)), ";").alias("entries")),
        "SELECT r_regionkey AS k, string_agg(n_name || '=' || n_nationkey, ';' ORDER BY n_name) AS entries FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "j08_messages_sessions": (lambda s, d: h.messages_of_sessions(read(s, d, TURN).select("session_id", "turn_id"), _sessions(s, d)).groupBy("identity_id").agg(F.count("*").alias("n"), F.countDistinct("turn_id").alias("turns")), f"WITH {SESSION_SQL} SELECT z.identity_id, count(*) AS n, count(DISTINCT turn_id) AS turns FROM conversation_turn JOIN z USING (session_id) GROUP BY 1"),
    "j09_snapshot_labels": (lambda s, d: sn.snapshot_labels(read(s, d, "import_run")), f"SELECT snapshot_id, coalesce(nullif(trim(friendly_name), ''), nullif(trim(tag), ''), nullif(trim(ref_name), ''), nullif(trim(branch), '')) AS label FROM import_run QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY {AT_SQL} DESC NULLS LAST, import_id) = 1"),
    "j10_claims_groups": (
        lambda s, d: sec.groups_of_claims(read(s, d, "documents").where("source IS NOT NULL").select(F.col("doc_id").alias("user_id"), F.col("source").alias("claim")).distinct(), read(s, d, "mix_target").select(F.col("source").alias("group_name")).distinct()),
        "WITH g AS (SELECT DISTINCT source AS group_name FROM mix_target) SELECT DISTINCT doc_id AS user_id, group_name FROM documents d JOIN g ON g.group_name = d.source OR (d.source NOT IN (SELECT group_name FROM g) AND lower(trim(d.source)) = lower(g.group_name))",
    ),
    "j12_insert_new": (_insert, f"WITH {TURN_SQL} SELECT DISTINCT session_id, turn_id, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.session_id = c.session_id AND t.turn_id = c.turn_id) THEN 'old' ELSE 'new' END AS origin FROM conversation_turn c WHERE session_id IS NOT NULL AND turn_id IS NOT NULL"),
    "sk03_upsert_runs": (_upsert, "SELECT import_id, any_value(snapshot_id) AS snapshot_id, any_value(CASE WHEN status = 'running' THEN 'failed' ELSE status END) AS status FROM import_run GROUP BY 1"),
    "sk05_purge": (lambda s, d: sn.purged(read(s, d, "rag_edge"), "harborline-core", "961f94ce-8a65-553b-801e-f42ff2a283a7").groupBy("snapshot_id").agg(F.count("*").alias("n")), "SELECT snapshot_id, count(*) AS n FROM rag_edge WHERE NOT (coalesce(repo, '') = 'harborline-core' AND coalesce(snapshot_id, '') = '961f94ce-8a65-553b-801e-f42ff2a283a7') GROUP BY 1"),
    "sk06_cascade_sets": (lambda s, d: sn.without_snapshot(read(s, d, "snapshot_set"), ["961f94ce-8a65-553b-801e-f42ff2a283a7"]).select("snapshot_set_id", F.size("allowed_snapshot_ids").alias("n")), "SELECT snapshot_set_id, CASE WHEN allowed_snapshot_ids IS NULL THEN -1 ELSE len([x FOR x IN allowed_snapshot_ids IF x <> '961f94ce-8a65-553b-801e-f42ff2a283a7']) END AS n FROM snapshot_set WHERE n <> 0 OR NOT list_contains(allowed_snapshot_ids, '961f94ce-8a65-553b-801e-f42ff2a283a7')"),
    "sk10_finalize": (_finalize, "SELECT turn_id, max(answer_neutral) AS answer_neutral, max(finalized_at_utc) FILTER (answer_neutral IS NOT NULL) AS finalized_at_utc, CASE WHEN max(answer_neutral) IS NULL THEN 'a1' ELSE 'a2,b3' END AS meta FROM conversation_turn WHERE turn_id IS NOT NULL GROUP BY 1"),
    "sc10_completed_runs": (lambda s, d: sn.completed_runs(read(s, d, "import_run")).select("import_id", "snapshot_id"), f"SELECT import_id, snapshot_id FROM (SELECT DISTINCT ON (import_id) * FROM import_run WHERE status = 'completed') ORDER BY {AT_SQL} DESC, import_id LIMIT 200"),
    "ag01_label_union": (
        lambda s, d: nodes.label_union(read(s, d, "rag_node"), "snapshot_id"),
        "SELECT snapshot_id, coalesce((SELECT list_sort(list_distinct(flatten(list(a.acl_allow)))) FROM rag_node a WHERE a.snapshot_id IS NOT DISTINCT FROM r.snapshot_id AND a.acl_allow IS NOT NULL), []) AS acl, coalesce((SELECT list_sort(list_distinct(flatten(list(a.classification_labels)))) FROM rag_node a WHERE a.snapshot_id IS NOT DISTINCT FROM r.snapshot_id AND a.classification_labels IS NOT NULL), []) AS labels, max(doc_level) AS level FROM rag_node r GROUP BY 1",
    ),
    "ag03_import_stats": (lambda s, d: sn.import_stats(read(s, d, "rag_node"), "canonical_id", ["data_type"]), "SELECT data_type, count(*) AS raw, count(DISTINCT canonical_id) AS n_unique, raw - n_unique AS dupes FROM rag_node GROUP BY ROLLUP (data_type)"),
    "ag04_message_count": (lambda s, d: h.message_counts(read(s, d, TURN).where("finalized_at_utc IS NOT NULL"), "session_id"), "SELECT session_id, count(*) AS n FROM conversation_turn WHERE finalized_at_utc IS NOT NULL AND session_id IS NOT NULL GROUP BY 1"),
    "ag05_confusion": (lambda s, d: evaluation.confusion(_told(s, d), "actual", "predicted"), f"WITH {TOLD_SQL} SELECT actual, predicted, count(*) AS n FROM w GROUP BY 1, 2"),
    "ag05_accuracy": (lambda s, d: evaluation.accuracy(_told(s, d), "actual", "predicted"), f"WITH {TOLD_SQL} SELECT actual, count(*) AS n, count(*) FILTER (actual = predicted) AS n_right, round(n_right / n, 6) AS accuracy FROM w GROUP BY 1"),
    "ag06_summary": (lambda s, d: evaluation.category_summary(read(s, d, "documents"), "source", "n_chars"), "SELECT source AS category, count(*) AS n, round(avg(n_chars), 6) AS mean, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY 1"),
    "m06_assessed": (
        lambda s, d: evaluation.assessed(read(s, d, "documents").select("doc_id", F.concat_ws(" ", "text", F.concat(F.lit('rated {"score": '), F.col("n_chars") % 13 - 1, F.lit("}"))).alias("report")).where("doc_id % 3 > 0").unionByName(read(s, d, "documents").where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("it is "), F.col("n_chars") % 11, F.lit(" / 10")).alias("report")))).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("score").alias("total")),
        """WITH x AS (SELECT CASE WHEN doc_id % 3 = 0 THEN n_chars % 11 ELSE CASE WHEN contains(coalesce(text, ''), '"score"') THEN NULL ELSE greatest(0, least(10, n_chars % 13 - 1)) END END AS s FROM documents) SELECT CASE WHEN s = 0 THEN '0' WHEN s = 10 THEN '10' ELSE '0' || s END AS bucket, count(*) AS n, CAST(sum(s) AS BIGINT) AS total FROM x GROUP BY 1""",
    ),
    "ag07_policy_merge": (
        lambda s, d: sec.merged_policies(_policies(s, d)).select("user_id", F.sort_array("acl").alias("acl"), "level", "owner"),
        "WITH p AS (SELECT canonical_id AS user_id, import_id AS position, acl_allow, doc_level, nullif(trim(owner_id), '') AS owner FROM rag_node WHERE canonical_id IS NOT NULL AND (acl_allow IS NOT NULL OR owner_id <> '')) SELECT user_id, list_sort(list_distinct(flatten(list(coalesce(acl_allow, []))))) AS acl, max(doc_level) AS level, arg_min(owner, position) FILTER (owner IS NOT NULL) AS owner FROM p GROUP BY 1",
    ),
    "ag11_counts": (lambda s, d: sn.set_counts(read(s, d, "snapshot_set")), "SELECT count(*) AS n_sets, count(*) FILTER (is_active) AS n_active FROM snapshot_set"),
    "ag12_event_counts": (lambda s, d: trace.event_counts(read(s, d, "events"), "event_type", "value"), "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1"),
    "s01_union_parts": (lambda s, d: context.union_in_order(read(s, d, "rag_edge").select(F.col("from_canonical_id").alias("id")).where("id IS NOT NULL"), read(s, d, "rag_edge").select(F.col("to_canonical_id").alias("id")).where("id IS NOT NULL"), "id"), "SELECT id, min(part) AS part FROM (SELECT from_canonical_id AS id, 0 AS part FROM rag_edge UNION ALL SELECT to_canonical_id, 1 FROM rag_edge) WHERE id IS NOT NULL GROUP BY 1"),
    "s02_array_except": (lambda s, d: read(s, d, "rag_node").where("acl_allow IS NOT NULL").select("canonical_id", "import_id", sec.missing_tags(["finance", "hr"]).alias("missing")), "SELECT canonical_id, import_id, list_sort([x FOR x IN ['finance','hr'] IF NOT list_contains(acl_allow, x)]) AS missing FROM rag_node WHERE acl_allow IS NOT NULL"),
    "s05_in_plan_order": (lambda s, d: sn.in_plan_order(read(s, d, "import_run").select("repo", "branch", "snapshot_id").distinct(), "repo", ["branch", "snapshot_id"]), "SELECT repo, branch, snapshot_id, CAST(row_number() OVER (PARTITION BY repo ORDER BY branch NULLS FIRST, snapshot_id NULLS FIRST) AS INTEGER) AS ordinal FROM (SELECT DISTINCT repo, branch, snapshot_id FROM import_run)"),
    "s06_inbox_split": (lambda s, d: trace.inbox_split(read(s, d, "events").select("event_id", "event_type"), "event_type", "click").select("event_id", "part"), "SELECT event_id, CASE WHEN event_type = 'click' THEN 'taken' ELSE 'kept' END AS part FROM events"),
    "st09_retention": (lambda s, d: h.retained(_turn(s, d), "session_id", [F.desc("finalized_at_utc"), "turn_id"], 2, "finalized_at_utc", "2025-04").select("session_id", "turn_id"), f"WITH {TURN_SQL} SELECT session_id, turn_id FROM t WHERE finalized_at_utc >= '2025-04' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY finalized_at_utc DESC, turn_id) <= 2"),
    "h05_tag": (lambda s, d: h.retag(read(s, d, "mix_target").select(F.col("source").alias("id"), F.col("mix_name").alias("tag")), read(s, d, "mix_target").select(F.col("source").alias("id")), "important", True), "SELECT source AS id, mix_name AS tag FROM mix_target UNION ALL SELECT DISTINCT source, 'important' FROM mix_target"),
    "h11_fallback": (lambda s, d: h.with_fallback(_turn(s, d).where("finalized_at_utc > '2025-06'").select("session_id", "turn_id"), _turn(s, d).select("session_id", "turn_id"), "session_id"), f"WITH {TURN_SQL}, p AS (SELECT session_id, turn_id FROM t WHERE finalized_at_utc > '2025-06') SELECT * FROM p UNION ALL SELECT session_id, turn_id FROM t WHERE session_id NOT IN (SELECT session_id FROM p)"),
    "h13_valid_version": (
        lambda s, d: sec.valid_at(read(s, d, "import_run").dropDuplicates(["import_id"]).select("snapshot_id", instant("started_utc").alias("valid_from"), instant("finished_utc").alias("valid_to"), F.col("import_id").alias("version")), ["snapshot_id"], __import__("datetime").datetime(2024, 6, 4, 2, 55)).select("snapshot_id", "version"),
        "SELECT snapshot_id, max(import_id) AS version FROM import_run WHERE TRY_CAST(nullif(started_utc, '') AS TIMESTAMPTZ) <= TIMESTAMPTZ '2024-06-04 02:55:00+00' AND (nullif(finished_utc, '') IS NULL OR TRY_CAST(nullif(finished_utc, '') AS TIMESTAMPTZ) > TIMESTAMPTZ '2024-06-04 02:55:00+00') GROUP BY 1",
    ),
    "h08_set_members": (lambda s, d: sn.set_members(read(s, d, "snapshot_set")), "SELECT DISTINCT snapshot_set_id, unnest(allowed_snapshot_ids) AS snapshot_id FROM snapshot_set WHERE is_active"),
    "x19_set_id": (lambda s, d: read(s, d, "documents").select("doc_id", sn.set_id_of("title").alias("set_id")), r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(title, '[^A-Za-z0-9_.-]+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') AS set_id FROM documents"),
    "x26_nested_path": (
        lambda s, d: read(s, d, "events").select("event_id", F.array_join(F.array_sort(sec.claim_values(F.concat(F.lit('{"a":{"x":{"p":{"v":"'), "event_type", F.lit('"},"q":{"w":1}},"y":{"r":{"v":"'), F.col("user_id").cast("string"), F.lit('"}}},"b":{"v":"no"}}')), "a.*.*.v")), ",").alias("out")),
        "SELECT event_id, CASE WHEN CAST(user_id AS VARCHAR) < event_type THEN user_id || ',' || event_type ELSE event_type || ',' || user_id END AS out FROM events",
    ),
    "x26_claim_path": (lambda s, d: read(s, d, "import_run").where("stats_json <> ''").select("import_id", F.array_join(F.array_sort(sec.claim_values("stats_json", "*.raw")), ",").alias("raw")).distinct(), "SELECT DISTINCT import_id, list_aggregate(list_sort(stats_json->>'$.*.raw'), 'string_agg', ',') AS raw FROM import_run WHERE stats_json <> ''"),
    "sk09_sessions": (lambda s, d: h.new_sessions(s.createDataFrame([], SESSION_ROW), _messages(s, d)).select("session_id", "identity_id", "title", "created_at", "updated_at"), f"WITH {MESSAGE_SQL} {_MADE_SQL}"),
    "h03_patched": (
        lambda s, d: h.patched(_stored_sessions(s, d), _sessions(s, d).select("session_id", F.when(F.col("identity_id").isNotNull(), F.concat(F.lit(" of "), "identity_id")).otherwise(" ").alias("title"), F.lit("9").alias("updated_at"))).select("session_id", "title", "updated_at"),
        f"WITH {MESSAGE_SQL}, {SESSION_SQL}, k AS (SELECT * FROM ({_MADE_SQL}) WHERE session_id < 's' OR session_id < '8') SELECT k.session_id, CASE WHEN z.identity_id IS NOT NULL THEN 'of ' || z.identity_id ELSE k.title END AS title, CASE WHEN z.identity_id IS NOT NULL THEN '9' ELSE k.updated_at END AS updated_at FROM k LEFT JOIN z USING (session_id)",
    ),
    "h03_deleted": (
        lambda s, d: h.deleted(h.deleted(_stored_sessions(s, d), _tags(s, d).where("tag = 'ide'"), "1"), _tags(s, d), "2").select("session_id", "deleted_at"),
        f"WITH {MESSAGE_SQL}, k AS (SELECT DISTINCT session_id FROM m WHERE session_id < 's' OR session_id < '8') SELECT session_id, CASE WHEN session_id IN (SELECT session_id FROM conversation_turn WHERE metadata['channel'] = 'ide') THEN '1' WHEN session_id IN (SELECT session_id FROM conversation_turn WHERE metadata['channel'] IS NOT NULL) THEN '2' END AS deleted_at FROM k",
    ),
    "h04_messages": (
        lambda s, d: h.with_messages(_messages(s, d).where("message_id < '8'").withColumn("question", F.lit("kept")), _messages(s, d).unionByName(_messages(s, d))).groupBy("question").agg(F.count("*").alias("n")).where("n > 1 OR question = 'kept'"),
        f"WITH {MESSAGE_SQL} SELECT CASE WHEN message_id < '8' THEN 'kept' ELSE question END AS question, count(*) AS n FROM m GROUP BY 1 HAVING count(*) > 1 OR 'kept' = any_value(CASE WHEN message_id < '8' THEN 'kept' ELSE question END)",
    ),
    "h14_consistency": (
        lambda s, d: sn.access_consistency(read(s, d, "rag_node").select("canonical_id"), read(s, d, "import_run")),
        "WITH r AS (SELECT DISTINCT ON (import_id) * FROM import_run), x AS (SELECT * FROM r WHERE lower(trim(coalesce(status, ''))) IN ('', 'completed')) SELECT (SELECT count(*) FROM rag_node) AS n_nodes, count(*) AS n_completed, count(*) FILTER (NOT acl_enabled) AS n_without_access, count(*) FILTER (acl_enabled IS NULL) AS n_unknown, (SELECT count(*) FROM rag_node) = 0 OR (n_completed > 0 AND n_without_access = 0 AND n_unknown = 0) AS consistent FROM x",
    ),
    "sc15_policies": (
        _policy_tables,
        "WITH n AS (SELECT repo AS g, owner_id, acl_allow, classification_labels, branch, doc_level, source_system_id FROM rag_node WHERE repo IS NOT NULL), a AS (SELECT g, unnest(acl_allow) AS v FROM n), b AS (SELECT g, unnest(classification_labels) AS v FROM n), n0 AS (SELECT DISTINCT g FROM n) "
        f"SELECT g AS group_name, {_list_sql('owner_id')} AS users, {_list_sql('v', 'a')} AS acl, {_list_sql('v', 'b')} AS labels, {_list_sql('branch')} AS pipelines, (SELECT max(doc_level) FROM n x WHERE x.g = n0.g) AS level, (SELECT max(nullif(trim(source_system_id), '')) FROM n x WHERE x.g = n0.g) AS owner FROM n0",
    ),
    "sk04_without_sets": (lambda s, d: sn.without_sets(read(s, d, "snapshot_set"), ["mistral-yard-all"]).select("snapshot_set_id"), "SELECT snapshot_set_id FROM snapshot_set WHERE snapshot_set_id IS NULL OR snapshot_set_id <> 'mistral-yard-all'"),
    "m11_branches": (lambda s, d: settings.branches(read(s, d, "import_run")), "SELECT DISTINCT repo, trim(branch) AS branch FROM import_run WHERE lower(trim(status)) = 'completed' AND trim(branch) <> ''"),
    "h06_visible": (
        lambda s, d: sec.visible_for(read(s, d, "rag_node").select("canonical_id", "import_id", F.col("acl_allow").alias("groups")), "groups", ["Finance ", "hr"]).select("canonical_id", "import_id"),
        "SELECT canonical_id, import_id FROM rag_node WHERE coalesce(len(acl_allow), 0) = 0 OR list_has_any([lower(trim(x)) FOR x IN acl_allow], ['finance','hr'])",
    ),
    "f09_id_list": (
        lambda s, d: read(s, d, "rag_node").where(filters.id_in(["clearance::a", "harborline-core::961f94ce-8a65-553b-801e-f42ff2a283a7::cs::C0000001"])).select("canonical_id", "import_id"),
        "SELECT canonical_id, import_id FROM rag_node WHERE canonical_id IN ('clearance::a', 'harborline-core::961f94ce-8a65-553b-801e-f42ff2a283a7::cs::C0000001')",
    ),
}
