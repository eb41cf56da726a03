"""Stream and bundle queries, with their SQL. Streams run to the end of the table and are read back."""

from __future__ import annotations


from pyspark.sql import functions as F

from strandwell.plans import engine, loader
from strandwell.records import read
from strandwell.session import new_path
from strandwell.streaming import trace as t


def _stream(s, d):
    return s.readStream.schema(read(s, d, "events").schema).parquet(f"{d}/events.parque[t]")


def _ran(df, mode="append", fmt="parquet"):
    s = df.sparkSession
    out = new_path(s, "stream")
    query = df.writeStream.format(fmt).option("path", out).option("checkpointLocation", new_path(s, "stream-log")).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.schema(df.schema).parquet(out)


def _projected(s, d):
    return _ran(t.projected(_stream(s, d), t.visibility("allowed", "explicit", F.col("event_type") != "signup")))


def _last(s, d):
    """Every run's log through stateful streaming, as it stands at the end."""
    out = new_path(s, "logs")

    def keep(batch, n):
        batch.write.mode("append").parquet(out)

    query = t.run_logs(_stream(s, d)).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", new_path(s, "logs-log")).trigger(availableNow=True).start()
    query.awaitTermination()
    return t.newest_logs(s.read.schema(t._LOG).parquet(out))


def _details(s, d):
    """Events as steps of a run, with a payload for each action."""
    e = read(s, d, "events")
    action = F.when(F.col("event_type") == "view", "search_nodes").when(F.col("event_type") == "click", "call_model").when(F.col("event_type") == "purchase", "manage_context_budget").otherwise("finalize")
    payload = F.to_json(F.struct(F.col("event_type").alias("search_type"), F.col("user_id").alias("top_k"), F.repeat("event_type", 60).alias("query"), F.col("event_type").alias("prompt"), F.col("user_id").alias("context_blocks")))
    return e.select("event_id", t.step_details(action, payload).alias("details"))


def _tumbling_stream(s, d):
    """The watermarked stream emits windows that are closed; the batch form has all."""
    return _ran(t.tumbling(_stream(s, d), lateness="1 hour"))


def _trace(s, d):
    pipe = {"name": "t", "settings": {"max_turn_loops": 2}, "steps": [{"id": "loop", "action": "loop_guard", "on_allow": "loop", "on_deny": "end"}]}
    state = engine.run(loader.build(pipe), engine.State("q"), engine.Runtime(s, read(s, d, "rag_node")))
    return s.createDataFrame([(n, e["event_type"], e.get("step")) for n, e in enumerate(state.trace)], "n int, event_type string, step string")


def _bundle(s, d):
    """The C# nodes of the table written as a bundle and read again."""
    from strandwell.sources import bundles

    rows = read(s, d, "rag_node").where("data_type = 'regular_code' AND canonical_id IS NOT NULL").select(F.col("canonical_id").alias("Id"), F.col("source_file").alias("File"), F.col("class_name").alias("Class"), "acl_allow").distinct()
    out = new_path(s, "bundle")
    rows.write.json(out)
    return bundles.sql_nodes(s, out).select("local_id", "source_file", "class_name", F.coalesce(F.size("acl_allow"), F.lit(-1)).alias("n_acl"))


_W = "SELECT time_bucket(INTERVAL '1 hour', ts) AS from_ts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
QUERIES = {
    "st01_projected": (_projected, "SELECT event_id, ts, user_id, event_type AS kind, CASE event_type WHEN 'view' THEN 'k=' || (props->>'$.k') WHEN 'purchase' THEN printf('value %.2f', value) WHEN 'error' THEN substr(props, 1, 180) END AS detail FROM events WHERE event_type <> 'signup'"),
    "st02_run_logs": (_last, "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS position FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 600)"),
    "st04_replay": (
        lambda s, d: t.replay_and_done(read(s, d, "events").where("event_id < 5000").select("event_id", "user_id", "event_type"), read(s, d, "events").where("event_id >= 4000").select("event_id", "user_id", "event_type"), "user_id", ends=("purchase", "error")).select("event_id", "event_type", "done"),
        "SELECT event_id, event_type, event_type IN ('purchase','error') AND event_id = max(event_id) OVER (PARTITION BY user_id) AS done FROM events",
    ),
    "st06_details": (_details, """SELECT event_id, CASE event_type WHEN 'view' THEN '{"search_type":"view","top_k":"' || user_id || '","query":"' || substr(repeat(event_type, 60), 1, 180) || '"}' WHEN 'click' THEN '{"prompt":"click"}' WHEN 'purchase' THEN '{"context_blocks":"' || user_id || '"}' ELSE '{}' END AS details FROM events"""),
    "st_tumbling": (lambda s, d: t.tumbling(read(s, d, "events")), _W),
    "st_tumbling_stream": (_tumbling_stream, None),
    "st_sliding": (lambda s, d: t.sliding(read(s, d, "events")), "WITH e AS (SELECT time_bucket(INTERVAL '30 minutes', ts) AS b FROM events), x AS (SELECT b AS from_ts FROM e UNION ALL SELECT b - INTERVAL '30 minutes' FROM e) SELECT from_ts, count(*) AS n FROM x GROUP BY 1"),
    "st_sessions": (lambda s, d: t.sessions(read(s, d, "events")), "WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, min(ts) AS from_ts, max(ts) + INTERVAL '30 minutes' AS to_ts, count(*) AS n FROM g GROUP BY user_id, g"),
    "d09_loop_guard": (_trace, "SELECT * FROM (VALUES (0, 'STEP', 'loop'), (1, 'STEP', 'loop'), (2, 'STEP', 'loop'), (3, 'RUN_END', NULL)) AS t(n, event_type, step)"),
    "sc03_bundle_nodes": (_bundle, "SELECT DISTINCT canonical_id AS local_id, nullif(trim(source_file), '') AS source_file, nullif(trim(class_name), '') AS class_name, CASE WHEN len(acl_allow) > 0 THEN len(acl_allow) ELSE -1 END AS n_acl FROM rag_node WHERE data_type = 'regular_code' AND canonical_id IS NOT NULL AND trim(canonical_id) <> ''"),
}
