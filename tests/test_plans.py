import json

import pytest

from strandwell.plans import engine, loader
from strandwell.sources import bundles, tables
from strandwell.streaming import trace

NODE = "canonical_id string, import_id string, repo string, branch string, snapshot_id string, data_type string, file_type string, owner_id string, source_system_id string, acl_allow array<string>, classification_labels array<string>, doc_level int, text string, embedding array<float>"


def node(n, text, snap="s1", level=None):
    return (f"r::{snap}::cs::{n}", "i", "r", "main", snap, "regular_code", "cs", "", "", None, None, level, text, None)


def test_inheritance_lock_and_checks():
    found = loader.load([json.dumps({"name": "base", "settings": {"a": {"x": 1, "y": 2}}, "steps": [{"id": "one", "action": "finalize", "next": "two"}, {"id": "two", "action": "finalize", "next": "end"}]}), json.dumps({"name": "kid", "extends": "base", "settings": {"a": {"y": 3}}, "steps": [{"id": "two", "next": "three"}, {"id": "three", "action": "finalize", "next": "end"}]})])
    raw = loader.resolve("kid", found)
    assert [s["id"] for s in raw["steps"]] == ["one", "two", "three"] and raw["settings"] == {"a": {"x": 1, "y": 3}}
    p = loader.build(raw)
    assert loader.problems(p, set(engine.ACTIONS)) == []
    assert loader.apply_lock(p, loader.lock(p)).settings["top_k"] == 5
    assert "one --> two" in loader.plantuml(p)
    bad = loader.build({"name": "b", "steps": [{"id": "a", "action": "nope", "next": "c"}, {"id": "z", "action": "finalize"}]})
    assert len(loader.problems(bad, set(engine.ACTIONS))) == 4
    with pytest.raises(ValueError):
        loader.resolve("x", {"x": {"name": "x", "extends": "x"}})


def test_a_whole_run(spark):
    nodes = spark.createDataFrame([node("a", "alpha beta"), node("b", "beta gamma"), node("c", "delta"), node("d", "alpha alpha", level=99), node("e", "alpha", "s2")], NODE)
    edges = spark.createDataFrame([("r::s1::cs::a", "r::s1::cs::c", "cs_dep"), ("r::s1::cs::a", "r::s1::cs::d", "cs_dep")], "from_canonical_id string, to_canonical_id string, edge_type string")
    steps = [
        {"id": "in", "action": "translate_in_if_needed", "next": "route"}, {"id": "route", "action": "call_model", "next": "pre"}, {"id": "pre", "action": "prefix_router", "routes": {"S:": "guard"}, "on_other": "out"},
        {"id": "guard", "action": "repeat_query_guard", "on_ok": "search", "on_repeat": "out"}, {"id": "search", "action": "search_nodes", "next": "tree"}, {"id": "tree", "action": "expand_dependency_tree", "next": "fetch"},
        {"id": "fetch", "action": "fetch_node_texts", "next": "ctx"}, {"id": "ctx", "action": "manage_context_budget", "on_ok": "loop", "on_over": "out"}, {"id": "loop", "action": "loop_guard", "on_allow": "route", "on_deny": "out"},
        {"id": "out", "action": "translate_out_if_needed", "next": "fin"}, {"id": "fin", "action": "finalize", "next": "end"},
    ]
    p = loader.build({"name": "p", "settings": {"default_search_method": "bm25", "top_k": 2, "max_turn_loops": 1, "model_language": "neutral"}, "steps": steps})
    assert loader.problems(p, set(engine.ACTIONS)) == []
    answers = iter(["S: alpha", "S: alpha", "done"])
    state = engine.run(p, engine.State("what is alpha?", {"snapshot_id": "s1", "user_level": 5}), engine.Runtime(spark, nodes, edges, model=lambda _: next(answers)))
    assert state.seeds == ["r::s1::cs::a"]
    assert state.context_blocks == ["alpha beta", "delta"]
    assert [e["step"] for e in state.trace if e["event_type"] == "STEP"].count("route") == 2
    with pytest.raises(engine.Cancelled):
        engine.run(p, engine.State("q"), engine.Runtime(spark, nodes, cancelled=lambda: True))


def test_nothing_hidden_is_reached_or_read(spark):
    def row(n, acl=None, labels=None, snap="s1"):
        return (f"r::{snap}::cs::{n}", "i", "r", "main", snap, "regular_code", "cs", "", "", acl, labels, None, f"alpha {n}" if n in "ax" else n, None)

    # a -> b (hidden) -> c; a -> d, which has an allowed and a forbidden label; a -> e; a -> f of another snapshot; h holds a null tag only
    nodes = spark.createDataFrame([row("a"), row("b", ["hr"]), row("c"), row("d", None, ["public", "secret"]), row("e", ["dev"], ["public"]), row("f", None, None, "s2"), row("h", [None]), row("x", None, None, "s2"), row("x2", None, None, "s3")], NODE)
    to = [("a", "b"), ("b", "c"), ("a", "d"), ("a", "e"), ("a", "h")]
    edges = spark.createDataFrame([(f"r::s1::cs::{a}", f"r::s1::cs::{b}", "cs_dep") for a, b in to] + [("r::s1::cs::a", "r::s2::cs::f", "cs_dep")], "from_canonical_id string, to_canonical_id string, edge_type string")
    steps = [{"id": "search", "action": "search_nodes", "next": "tree"}, {"id": "tree", "action": "expand_dependency_tree", "next": "fetch"}, {"id": "fetch", "action": "fetch_node_texts", "next": "end"}]
    access = {"acl_tags_any": ["dev"], "classification_labels_all": ["public"]}
    p = loader.build({"name": "p", "settings": {"default_search_method": "bm25", "top_k": 2}, "steps": steps})
    state = engine.run(p, engine.State("alpha", {"snapshot_id": "s1", **access}), engine.Runtime(spark, nodes, edges))
    assert [t["text"] for t in state.node_texts] == ["alpha a", "e"]
    assert sorted((r.src[-1], r.dst[-1]) for r in state.graph_edges.collect()) == [("a", "e")]
    fork = loader.build({"name": "p", "settings": {"default_search_method": "bm25", "top_k": 2}, "steps": [{"id": "fork", "action": "fork_action", "snapshots": ["s2", "s1"], "next": "search"}, *steps]})
    state = engine.run(fork, engine.State("alpha", dict(access)), engine.Runtime(spark, nodes, edges))
    assert state.seeds == ["r::s2::cs::x", "r::s1::cs::a"]
    assert [t["text"] for t in state.node_texts] == ["alpha x", "alpha a", "e", "f"]
    state.seeds = ["r::s1::cs::b", "r::s3::cs::x2"]  # names do not open what is hidden or in no snapshot of the plan
    state.graph_nodes = None
    engine.ACTIONS["fetch_node_texts"](fork.steps["fetch"], state, engine.Runtime(spark, nodes, edges), fork.settings)
    assert state.node_texts == []


def test_history_is_the_sessions_own(spark):
    turns = spark.createDataFrame([("t1", "s", "q1", "a1", "2025-01-01"), ("t2", "s", "q2", "a2", "2025-01-02"), ("t3", "other", "q3", "a3", "2025-01-03")], "turn_id string, session_id string, question_neutral string, answer_neutral string, finalized_at_utc string")
    p = loader.build({"name": "p", "settings": {}, "steps": [{"id": "h", "action": "load_conversation_history", "next": "end"}]})
    for session, want in (("s", [("q1", "a1"), ("q2", "a2")]), ("", [])):
        assert engine.run(p, engine.State("q", session_id=session), engine.Runtime(spark, turns, history=turns)).dialog == want


def test_bundle_and_tables(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b/repo_meta.json").write_text(json.dumps({"RepoName": "r", "HeadSha": "h"}))
    (tmp_path / "b/chunks.json").write_text(json.dumps([{"Id": "C1", "Text": "t", "acl_allow": [], "clearance_level": -1}, {"Id": "C1", "Text": "u"}, {"Text": "no id"}]))
    (tmp_path / "b/deps.json").write_text(json.dumps({"C1": ["C2", "C3"]}))
    (tmp_path / "b/edges.csv").write_text("from,to,relation\nA,B,Calls\nA,,Calls\nA,C,\n")
    root, meta = bundles.open_bundle(str(tmp_path / "b"))
    assert meta == {"repo": "r", "branch": "(unknown)", "head_sha": "h", "fingerprint": None}
    rows = bundles.as_records(bundles.cs_nodes(spark, str(root / "chunks.json")), meta, "s", "i")
    r = rows.collect()
    assert [(x.canonical_id, x.acl_allow, x.doc_level) for x in r] == [("r::s::cs::C1", None, None)]
    assert bundles.cs_edges(spark, str(root / "deps.json")).count() == 2
    assert sorted(x.edge_type for x in bundles.sql_edges(spark, str(root / "edges.csv")).collect()) == ["sql_Calls", "sql_edge"]
    out = str(tmp_path / "nodes")
    df = spark.createDataFrame([("a", "i1", "s1", "x"), ("a", "i2", "s1", "y"), ("b", "i1", "s2", "z")], "canonical_id string, import_id string, snapshot_id string, text string")
    assert tables.write_nodes(df, out) == {"raw": 3, "unique": 2, "dupes": 1}
    tables.upsert_rows(spark, out, spark.createDataFrame([("a", "i3", "s1", "new")], df.schema), ["canonical_id"], "snapshot_id")
    assert sorted((x.canonical_id, x.text) for x in spark.read.parquet(out).collect()) == [("a", "new"), ("b", "z")]
    tables.drop_snapshot(spark, out, "s1")
    assert [x.canonical_id for x in spark.read.parquet(out).collect()] == ["b"]


def test_visibility(spark):
    df = spark.range(1)
    assert [df.select(trace.visibility(g, p, trace.F.lit(True)).alias("v")).first().v for g, p in (("forbidden", "allowed"), ("allowed", "allowed"), ("allowed", "explicit"))] == [False, True, True]
