import json

import pytest

from strandwell.functions import markup
from strandwell.operators import compression, context, evaluation, filters, graph, history, nodes, ranking, security, snapshots
from strandwell.plans import engine, loader, registries, requests, settings
from strandwell.sources import policies, tables
from strandwell.streaming import control, trace

CHUNK = "request string, path string, namespace string, class string, member string, start_line int, end_line int, rank int, distance double, content string, hit_lines array<int>, clash string"


def chunk(path, member=None, rank=None, content="", hits=(), lines=(None, None)):
    return ("r", path, "N", "C", member, *lines, rank, None, content, list(hits), "x")


def context_of(spark, rows, **kw):
    return {r.request: r.context for r in compression.compressed(spark.createDataFrame(rows, CHUNK), **kw).collect()}


def test_compressed_chunks(spark):
    body = "// note\nint a = 1;\n\n\nint b = 2;\n"
    rows = [chunk("b.cs", "M", 1, body, lines=(3, 9)), chunk("a.cs", "K", None, "x();"), chunk("b.cs", "M", 2, "late();"), chunk("c.cs", "M", 3, body)]
    assert context_of(spark, rows, mode="metadata") == {"r": "- b.cs : N.C.M (L3-9)\n- c.cs : N.C.M\n- a.cs : N.C.K\n"}
    # The second copy of a snippet is a header only; code is left out whole where it does not fit.
    want = "- b.cs : N.C.M (L3-9)\n```csharp\nint a = 1;\nint b = 2;\n```\n- c.cs : N.C.M\n- a.cs : N.C.K\n```csharp\nx();\n```\n"
    assert context_of(spark, rows, mode="snippets", budget=60) == {"r": want}
    assert context_of(spark, rows, mode="snippets", budget=8) == {"r": "- b.cs : N.C.M (L3-9)\n"}
    assert context_of(spark, rows, mode="two_stage", max_chunks=1) == {"r": "- b.cs : N.C.M (L3-9)\n"}
    assert context_of(spark, []) == {}
    assert context_of(spark, [chunk(None, None, None, None, ())]) == {"r": "- <unknown> : N.C\n"}
    with pytest.raises(ValueError):
        compression.compressed(spark.createDataFrame([], CHUNK), "other")


def test_snippets_show_what_is_near_a_hit(spark):
    text = "\n".join(str(n) for n in range(1, 101))
    cases = [([50], 2, "48 49 50 51 52"), ([50, 57], 2, "48 49 50 51 52 53 54 55 56 57 58 59"), ([50, 60], 2, "48 49 50 51 52 58 59 60 61 62"), ([500, -3], 1, "1 2 99 100"), ([], 2, " ".join(text.split("\n")))]
    for hits, window, want in cases:
        got = spark.createDataFrame([(text, hits)], "t string, h array<int>").select(compression.snippet("t", "h", window).alias("s")).first().s
        assert got.split("\n") == want.split()


def test_scores_of_reports(spark):
    rows = spark.createDataFrame([("a", 'x {"score": 7} 3/10'), ("b", "rated 9 / 10"), ("c", "nothing"), ("d", None), ("e", '{"score": "12"}'), ("f", '{"score": -2}')], "k string, report string")
    assert {r.k: (r.score, r.bucket) for r in evaluation.assessed(rows).collect()} == {"a": (7, "07"), "b": (9, "09"), "c": (0, "0"), "d": (0, "0"), "e": (10, "10"), "f": (0, "0")}


def test_sessions_are_made_changed_and_deleted(spark):
    row = "session_id string, identity_id string, title string, created_at string, updated_at string, deleted_at string"
    old = spark.createDataFrame([("s1", "u", "mine", "1", "1", None)], row)
    msgs = spark.createDataFrame([("m1", "s2", "u", "2", "  a  long " + "question " * 20), ("m2", "s2", "u", "1", None), ("m3", "s1", "u", "5", "q"), ("m4", None, "u", "5", "q")], "message_id string, session_id string, identity_id string, created_at string, question string")
    made = history.new_sessions(old, msgs)
    assert {r.session_id: (r.title, r.created_at, r.updated_at) for r in made.collect()} == {"s1": ("mine", "1", "1"), "s2": ("", "1", "2")}
    assert {r.session_id: r.updated_at for r in history.touched(made, msgs).collect()} == {"s1": "5", "s2": "2"}
    assert history.with_messages(msgs, msgs.unionByName(msgs)).count() == 4
    changes = spark.createDataFrame([("s1", " new ", "7"), ("s1", "older", "6"), ("s2", " ", "7"), ("zz", "t", "7")], "session_id string, title string, updated_at string")
    assert {r.session_id: (r.title, r.updated_at) for r in history.patched(made, changes).collect()} == {"s1": ("new", "7"), "s2": ("", "2")}
    gone = history.deleted(made, spark.createDataFrame([("s1",), ("zz",)], "session_id string"), "9")
    assert {r.session_id: r.deleted_at for r in history.deleted(gone, gone.select("session_id"), "10").collect()} == {"s1": "9", "s2": "10"}


NODE = "canonical_id string, import_id string, repo string, branch string, snapshot_id string, data_type string, file_type string, owner_id string, source_system_id string, acl_allow array<string>, classification_labels array<string>, doc_level int, text string, embedding array<float>"


def test_requests_are_checked_and_run(spark):
    def node(n, text, acl=None, snap="s1", level=None):
        return (f"r::{snap}::cs::{n}", "i", "r", "main", snap, "regular_code", "cs", "", "", acl, None, level, text, None)

    rt = engine.Runtime(spark, spark.createDataFrame([node("a", "alpha one"), node("b", "alpha two", ["hr"]), node("c", "alpha three", None, "s2"), node("d", "alpha four", None, "s1", 30)], NODE))
    sets = spark.createDataFrame([("set", "r", ["s1"], True), ("pair", "r", ["s1", "s2"], True), ("off", "r", ["s1"], False)], "snapshot_set_id string, repo string, allowed_snapshot_ids array<string>, is_active boolean")
    steps = [{"id": "s", "action": "search_nodes", "next": "f"}, {"id": "f", "action": "fetch_node_texts", "next": "end"}]
    fork = [{"id": "k", "action": "fork_action", "next": "s"}, *steps]
    pipes = {"one": loader.build({"name": "one", "settings": {"default_search_method": "bm25", "top_k": 5}, "steps": steps}), "two": loader.build({"name": "two", "settings": {"default_search_method": "bm25", "top_k": 5}, "steps": fork})}
    me = requests.Access("u", ["one", "two"], ["dev"], [], 10)
    ask = {"query": "alpha", "pipeline": "one", "snapshot_set_id": "set"}
    assert [t["text"] for t in requests.answer(ask, me, pipes, rt, sets).node_texts] == ["alpha one"]
    wide = {**ask, "filters": {"user_level": 99, "acl_tags_any": ["hr"]}}  # a request can't widen access
    assert [t["text"] for t in requests.answer(wide, me, pipes, rt, sets).node_texts] == ["alpha one"]
    both = {"query": "alpha", "pipeline": "two", "snapshot_set_id": "pair", "snapshot_id": "s2", "snapshot_id_b": "s1"}
    assert [t["text"] for t in requests.answer(both, me, pipes, rt, sets).node_texts] == ["alpha three", "alpha one"]
    for bad, error in (({**ask, "query": " "}, ValueError), ({**ask, "filters": {"x": 1}}, ValueError), ({**ask, "snapshot_set_id": ""}, ValueError), ({**ask, "snapshot_set_id": "pair"}, ValueError), ({**ask, "snapshot_id": "s2"}, PermissionError), ({**ask, "snapshot_set_id": "off", "snapshot_id": "s1"}, PermissionError)):
        with pytest.raises(error):
            requests.answer(bad, me, pipes, rt, sets)
    with pytest.raises(PermissionError):
        requests.answer(ask, requests.Access("u", ["two"]), pipes, rt, sets)


def test_policies_from_tables_and_files(spark, tmp_path):
    two = "group_name string, value string"
    one = {"groups": [("a",), ("b",)], "limits": [("a", 10, " "), ("a", 20, "me")]}
    parts = {t: spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x"), ("a", None), ("zz", "q")], two) for t in ("users", "acl", "labels", "pipelines")}
    parts |= {"groups": spark.createDataFrame(one["groups"], "group_name string"), "limits": spark.createDataFrame(one["limits"], "group_name string, level int, owner string")}
    for name, df in parts.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r.group_name: (r.users, r.acl, r.level, r.owner) for r in policies.read_policy_tables(spark, str(tmp_path)).collect()}
    assert got == {"a": (["x", "y"], ["x", "y"], 20, "me"), "b": ([], [], None, None)}
    with pytest.raises(ValueError):
        policies.policies_from({"groups": parts["groups"]})
    (tmp_path / "p.json").write_text(json.dumps({"a": {"users": ["v", "u", "u"], "level": 5, "more": 1}, " ": {}}))
    assert [(r.group_name, r.users, r.acl, r.level, r.owner) for r in policies.read_policy_file(spark, str(tmp_path / "p.json")).collect()] == [("a", ["u", "v"], [], 5, None)]


def test_settings(spark):
    configs = spark.createDataFrame([("c1", "p1", "set", [" Dev"]), ("c2", "p2", None, None), ("c3", "p3", "set", ["hr"])], "consultant_id string, pipeline string, snapshot_set_id string, groups array<string>")
    sets = spark.createDataFrame([("set", ["s2", "s1"], True)], "snapshot_set_id string, allowed_snapshot_ids array<string>, is_active boolean")
    runs = spark.createDataFrame([("i1", "s1", "r", "main", None, None, None, "completed", "2025-01-01T00:00:00Z", None)], "import_id string, snapshot_id string, repo string, branch string, friendly_name string, tag string, ref_name string, status string, finished_utc string, started_utc string")
    got = {r.consultant_id: [(x.label, x.id) for x in r.snapshots] for r in settings.consultants(configs, ["dev"], sets, runs).collect()}
    assert got == {"c1": [("main", "s1"), ("s2", "s2")], "c2": []}
    names = spark.createDataFrame([("p1",), ("p2",)], "pipeline string")
    assert settings.allowed_pipelines(names, names.where("false")).count() == 2 and settings.allowed_pipelines(names, names.where("pipeline = 'p2'")).count() == 1
    assert settings.snapshot_sets_of({"p": loader.build({"name": "p", "settings": {"snapshot_set_id": "s"}, "steps": [{"id": "a", "action": "finalize"}]})}) == {"p": "s"}
    assert [tuple(r) for r in settings.branches(runs).collect()] == [("r", "main")] and settings.branches(runs, ["other"]).count() == 0
    assert settings.connection_settings({"port": "70", "tls": "no"}, {"X_HOST": "h"}, {"host": "", "port": 80, "tls": True, "grpc": 1}, "x") == {"host": "h", "port": 70, "tls": False, "grpc": 1}


def test_access_consistency(spark):
    runs = "import_id string, status string, acl_enabled boolean"
    held = spark.createDataFrame([("a",)], "canonical_id string")
    for rows, good in (([("1", "completed", True), ("1", "completed", True), ("2", "failed", False)], True), ([("1", None, False)], False), ([("1", "Completed", None)], False), ([], False)):
        assert snapshots.access_consistency(held, spark.createDataFrame(rows, runs)).first().consistent is good
    assert snapshots.access_consistency(held.where("false"), spark.createDataFrame([], runs)).first().consistent
    with pytest.raises(RuntimeError):
        snapshots.require_access_consistency(held, spark.createDataFrame([], runs))


def test_pipelines_of_a_folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text(json.dumps({"name": "a", "steps": []}))
    (tmp_path / "sub/b.yaml").write_text("name: b\nsteps: []\n")
    (tmp_path / "note.txt").write_text("no pipeline")
    assert sorted(loader.load([tmp_path])) == ["a", "b"]
    with pytest.raises(ValueError, match="two pipelines are named a"):
        loader.load([tmp_path, json.dumps({"name": "a", "steps": []})])


def test_a_cancelled_step_goes_nowhere(spark):
    calls = []
    rt = engine.Runtime(spark, spark.range(0), cancelled=lambda: len(calls) > 0, model=lambda p: calls.append(p) or "answer")
    p = loader.build({"name": "p", "settings": {}, "steps": [{"id": "m", "action": "call_model", "next": "f"}, {"id": "f", "action": "finalize", "next": "end"}]})
    state = engine.State("q", run_id="run-1")
    with pytest.raises(engine.Cancelled):
        engine.run(p, state, rt)
    assert len(calls) == 1 and not state.final_answer and state.trace[-1] == {"event_type": "CANCELLED", "step": "m"}


def test_registries_and_key_values(spark):
    assert registries.query_parsers.get(None)("alpha")["query"] == "alpha" and "plain" in list(registries.prompt_builders)
    with pytest.raises(ValueError):
        registries.query_parsers.get("nope")
    with pytest.raises(ValueError):
        registries.query_parsers.register("plain")(lambda t: t)
    kv = registries.KeyValueHistory(spark)
    kv.set("a", {"x": [1]})
    kv.set("a", {"x": [2]})
    kv.set("b", None)
    kv.delete("zz")
    assert kv.get("a") == {"x": [2]} and kv.get("b") is None and kv.get("zz") is None
    kv.delete("a")
    assert kv.get("a") is None
    ask = registries.hybrid_model([{"id": "far", "max_level": 10, "acl": ["dev"]}, {"id": "vault", "trusted": True}], lambda p: "me", {"far": lambda p: "f", "vault": lambda p: "v"})
    assert [ask("p", 5, ["Dev"])[0], ask("p", 20)[0]] == ["far", "vault"] and registries.hybrid_model([], lambda p: "me", {})("p") == ("local", "me")


def test_cancelling_and_pacing():
    now = [0.0]
    reg = control.CancelRegistry(10, lambda: now[0])
    reg.cancel("r", "asked")
    reg.cancel("r", "again")
    assert reg.reason("r") == "asked" and reg.reason("other") is None
    now[0] = 11.0
    assert reg.reason("r") is None
    waits, fails = [], [control.Busy(after=5), control.Busy(), None]

    def call():
        e = fails.pop(0)
        if e:
            raise e
        return "done"

    assert control.Paced(call, sleep=waits.append, first=1)() == "done" and waits == [5, 2]
    with pytest.raises(control.Busy):
        control.Paced(lambda: (_ for _ in ()).throw(control.Busy()), most_tries=2, sleep=lambda s: None)()
    assert control.backoff(9, 1, 2, 30) == 30


def test_run_logs_hold_over_many_batches(spark, tmp_path):
    rows = [(n, f"2025-01-01 {n % 24:02d}:00:00", n % 2) for n in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long").selectExpr("event_id", "timestamp(ts) AS ts", "user_id")
    df.repartition(5).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    out = str(tmp_path / "logs")
    trace.run_logs(stream, "2 days").writeStream.foreachBatch(lambda b, n: b.write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in trace.newest_logs(spark.read.parquet(out)).collect())
    want = sorted((u, i, p) for u in (0, 1) for p, (_, i) in enumerate(sorted((t, n) for n, t, x in rows if x == u), 1))
    assert got == want


def test_kept_turns(spark, tmp_path):
    df = spark.createDataFrame([("s", f"t{n}", f"2025-01-01 00:{n:02d}:00") for n in range(6)], "session_id string, turn_id string, ts string").selectExpr("session_id", "turn_id", "timestamp(ts) AS ts")
    df.repartition(3).write.parquet(str(tmp_path / "t"))
    out = str(tmp_path / "o")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    trace.kept_turns(stream, most=2).writeStream.foreachBatch(lambda b, n: b.write.mode("append").parquet(out)).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).collect()
    last = max(r.version for r in rows)
    assert sorted((r.position, r.turn_id) for r in rows if r.version == last) == [(1, "t4"), (2, "t5")]


def test_plantuml_codes(spark):
    for text in ("", "a", "ab", "abc", "@startuml\nA --> B\n@enduml" * 5):
        assert markup.plantuml_decoded(markup.plantuml_encoded(text)) == text
    assert len(markup.plantuml_encoded("a")) % 4 != 0 or len(markup.plantuml_encoded("ab")) % 4 != 0


def test_vector_search_ways_agree(spark):
    import random

    rng = random.Random(1)
    rows = [(n, [rng.choice([0.0, 1.0, -1.0]) for _ in range(4)], n % 3) for n in range(300)] + [(999, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, vector array<double>, p int")
    queries = spark.createDataFrame([(n, v, p) for n, v, p in rows if n % 20 == 0 and v], "query_id long, vector array<double>, p int")
    for part in (None, "p"):
        for own in (False, True):
            a, b = (sorted(map(tuple, ranking.vector_search(docs, queries, 7, own, part, most).select("query_id", "doc_id", "score", "rank").collect())) for most in (1 << 20, 0))
            assert a == b and len(a) == 15 * 7


def test_index_recall(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    vectors = centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 0.4
    docs = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(vectors)] + [(9999, None)], "doc_id long, vector array<double>")
    queries = docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    index = ranking.VectorIndex(docs, sample=500)
    assert index.rows.count() == 3000
    found = ranking.recall(index.search(queries, 10), ranking.vector_search(docs, queries, 10)).first()
    assert found.n == 1500 and found.recall >= 0.9
    assert ranking.VectorIndex(docs.where("false")).search(queries, 3).count() == 0


def test_latest_trace_and_logs(spark, tmp_path):
    events = spark.createDataFrame([("r1", "2025-01-01", "a"), ("r2", "2025-01-02", "b")], "run_id string, ts string, kind string")
    for _ in range(2):
        tables.write_trace(events, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 2
    assert [r.kind for r in tables.latest_trace(spark, str(tmp_path / "t")).collect()] == ["b"]


def test_claims_pages_and_edges(spark):
    claims = spark.createDataFrame([("u1", "Dev"), ("u2", "/dev/"), ("u3", "role: boss,ops"), ("u4", "none"), ("u5", None)], "user_id string, claim string")
    groups = spark.createDataFrame([("Dev",), ("Ops",)], "group_name string")
    aliases = spark.createDataFrame([("Boss", "Dev"), (" ", "Ops")], "alias string, group_name string")
    assert sorted(tuple(r) for r in security.groups_of_claims(claims, groups, aliases).collect()) == [("u1", "Dev"), ("u2", "Dev"), ("u3", "Dev")]
    row = spark.createDataFrame([('{"a":{"b":"1"}}',), ("no json",), (None,)], "j string")
    assert [r.v for r in row.select(security.claim_values("j", "*.b").alias("v")).collect()] == [["1"], [], None]
    rows = spark.createDataFrame([(n, f"k{n}", "t") for n in range(5)], "at int, id string, title string")
    assert [r.at for r in history.page(rows, "at", "id", 2, (3, "a")).collect()] == [2, 1]
    assert [r.at for r in history.page(rows, "at", "id", 2, (9, "gone"), restart=True).collect()] == [4, 3]
    assert [r.at for r in history.page(rows, "at", "id", 2, (3, "k3"), restart=True).collect()] == [2, 1]
    edges = spark.createDataFrame([("a", "b", "x"), ("a", " ", "x")], "from_canonical_id string, to_canonical_id string, edge_type string")
    graph.require_clean_edges(edges.limit(1).where("to_canonical_id = 'b'"))
    with pytest.raises(ValueError):
        graph.require_clean_edges(edges)


def test_small_rules(spark):
    assert context.compaction_rule([{"language": "sql", "n": 1}, {"n": 2}], "cs") == {"n": 2} and context.compaction_rule([], "cs") is None
    with pytest.raises(ValueError):
        filters.in_snapshot(["a", "b"])
    sets = spark.createDataFrame([("set", "r", ["s1"], True)], "snapshot_set_id string, repo string, allowed_snapshot_ids array<string>, is_active boolean")
    nodes.check_membership(sets, "set", ["s1", ""])
    with pytest.raises(PermissionError):
        nodes.check_membership(sets, "set", ["s1"], "other")
    assert security.visible_for(spark.createDataFrame([(None,), (["A"],), (["b"],)], "g array<string>"), "g", ["a "]).count() == 2
