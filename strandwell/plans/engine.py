"""Running a step pipeline over DataFrames.

The interpreter runs on the driver and only moves lazy DataFrames between steps; rows are collected where a decision
needs them: at most top_k hits, a capped graph, the texts a budget lets through. All snapshots of a fork are one plan.
"""

from __future__ import annotations

import functools
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwell.functions import markup
from strandwell.operators import context, filters, graph, ranking
from strandwell.plans.loader import END, Pipeline, Step, step_setting


class Cancelled(RuntimeError):
    pass


@dataclass
class Runtime:
    """What a run is given: tables, a model, translators, and hooks. Every one of them can be replaced."""

    spark: SparkSession
    nodes: DataFrame
    edges: DataFrame | None = None
    vectors: DataFrame | None = None
    history: DataFrame | None = None
    model: Callable[[str], str] = lambda prompt: "[Answer:] " + prompt[-40:]
    translate_in: Callable[[str], str] = lambda t: t
    translate_out: Callable[[str], str] = lambda t: t
    embed: Callable[[str], list[float]] | None = None
    count: Callable[[str], int] = lambda t: max(1, len(t) // 4) if t else 0
    prompts: dict[str, str] = field(default_factory=dict)
    cancelled: Callable[[], bool] = lambda: False
    commands: dict[str, tuple[str, Callable[[str], str]]] = field(default_factory=dict)


@dataclass
class State:
    question: str
    filters: dict = field(default_factory=dict)
    permissions: set = field(default_factory=set)
    session_id: str = ""
    run_id: str = ""
    question_neutral: str = ""
    last_answer: str = ""
    final_answer: str = ""
    search_type: str | None = None
    hits: DataFrame | None = None
    seeds: list[str] = field(default_factory=list)
    graph_nodes: DataFrame | None = None
    graph_edges: DataFrame | None = None
    node_texts: list[dict] = field(default_factory=list)
    context_blocks: list[str] = field(default_factory=list)
    dialog: list[tuple[str, str]] = field(default_factory=list)
    asked: set = field(default_factory=set)
    loops: dict[str, int] = field(default_factory=dict)
    inbox: list[dict] = field(default_factory=list)
    plan: list[str] = field(default_factory=list)
    branches: dict[str, list[str]] = field(default_factory=dict)
    variables: dict = field(default_factory=dict)
    trace: list[dict] = field(default_factory=list)


Action = Callable[[Step, State, Runtime, dict], str | None]
ACTIONS: dict[str, Action] = {}


def action(*names: str) -> Callable[[Action], Action]:
    """Registers a step's action and wraps it: inbox taken, events traced, failures named."""

    def register(fn: Action) -> Action:
        @functools.wraps(fn)
        def run(step: Step, state: State, rt: Runtime, settings: dict) -> str | None:
            mine = [m for m in state.inbox if m["target_step_id"] == step.id]
            state.inbox = [m for m in state.inbox if m["target_step_id"] != step.id]
            state.trace += [{"event_type": "CONSUME", "step": step.id, "topic": m["topic"]} for m in mine]
            began = time.time()
            step = Step(step.id, step.action, step.next, {**step.raw, "_inbox": mine})
            try:
                goes = fn(step, state, rt, settings)
            except Cancelled:
                raise
            except Exception as e:
                state.trace.append({"event_type": "ERROR", "step": step.id, "action": step.action, "error": str(e)[:400]})
                raise
            state.trace.append({"event_type": "STEP", "step": step.id, "action": step.action, "next": goes or step.next, "ms": int((time.time() - began) * 1000)})
            return goes

        for n in names:
            ACTIONS[n] = run
        return run

    return register


def run(pipeline: Pipeline, state: State, rt: Runtime, most_steps: int = 1000) -> State:
    """From the entry step until `end` or a step without a next one. With a run id the run's Spark jobs are its job group, which a CancelRegistry ends."""
    if state.run_id:
        rt.spark.sparkContext.setJobGroup(state.run_id, pipeline.name, interruptOnCancel=True)
    at, n = pipeline.entry, 0
    state.question_neutral = state.question_neutral or state.question
    while at and at != END:
        if at not in pipeline.steps:
            raise ValueError(f"no step is named {at}")
        n += 1
        if n > most_steps:
            raise RuntimeError("the pipeline does not end")
        if rt.cancelled():
            state.trace.append({"event_type": "CANCELLED", "step": at})
            raise Cancelled(at)
        step = pipeline.steps[at]
        goes = ACTIONS[step.action](step, state, rt, pipeline.settings) or step.next
        if rt.cancelled():  # what a cancelled step has found goes nowhere
            state.trace.append({"event_type": "CANCELLED", "step": at})
            raise Cancelled(at)
        at = goes
    state.trace.append({"event_type": "RUN_END", "step": None})
    return state


def send(state: State, target: str, topic: str, payload: object = None) -> None:
    state.inbox.append({"target_step_id": target, "topic": topic, "payload": json.loads(json.dumps(payload))})
    state.trace.append({"event_type": "ENQUEUE", "step": target, "topic": topic})


#: Fields of a node that keyword search reads beside its text.
NODE_FIELDS = ("repo_relative_path", "source_file", "project_name", "class_name", "member_name", "symbol_type", "signature", "sql_kind", "sql_schema", "sql_name")


def _snapshots(state: State, asked: dict | None = None) -> list[str]:
    """The snapshots a step works in: the plan's, else the one of the filters. Without any there is nothing to be seen."""
    return state.plan or filters.strings((asked or state.filters).get("snapshot_id"))


def visible_nodes(rt: Runtime, state: State, settings: dict, asked: dict | None = None) -> DataFrame:
    """The node rows of the step's snapshots that the asker may see. Every step reads nodes through this."""
    access = filters.may_see(asked or state.filters, settings.get("acl_enabled", True), settings.get("label_universe"))
    return rt.nodes.where(F.col("snapshot_id").isin(_snapshots(state, asked)) & access)


@action("search_nodes")
def search_nodes(step: Step, state: State, rt: Runtime, settings: dict) -> str | None:
    """Filtered top-k of nodes, over text and NODE_FIELDS. Every snapshot is a corpus of its own with its own statistics; all are one
    plan, with the snapshot as the query's id. Older context stays."""
    request = json.loads(markup.query_payload(state.last_answer or state.question_neutral))
    mode = ranking.resolved_search_type(request.get("search_type"), state.search_type, step.raw.get("search_type"), settings.get("default_search_method", "bm25"))
    k = ranking.resolved_top_k(step.raw.get("top_k"), settings.get("top_k", 5), request.get("top_k"))
    wide = k * int(step.raw.get("widen", 1))
    query = request["query"] or state.question_neutral
    state.asked.add(" ".join(query.lower().split()))
    asked = filters.merged(request.get("filters", {}), state.filters)
    ids = _snapshots(state, asked)
    if not ids:
        raise ValueError("a snapshot_id is required")
    access = filters.may_see(asked, settings.get("acl_enabled", True), settings.get("label_universe"))
    columns = ("text", *[c for c in NODE_FIELDS if c in rt.nodes.columns])
    rows = rt.nodes.where(F.col("snapshot_id").isin(ids) & F.col("canonical_id").isNotNull())
    docs = rows.groupBy("snapshot_id", F.col("canonical_id").alias("doc_id")).agg(*[F.max(c).alias(c) for c in columns], F.max(access & filters.asked_for(asked)).alias("visible"))
    queries = rt.spark.createDataFrame([(sid, sid, query) for sid in ids], "query_id string, snapshot_id string, query string")
    vectors = query_vectors = None
    if mode != "bm25" and rt.embed is not None:
        asking = [float(x) for x in rt.embed(query)]
        query_vectors = rt.spark.createDataFrame([(sid, sid, asking) for sid in ids], "query_id string, snapshot_id string, vector array<double>")
        vectors = rows.where(access & filters.asked_for(asked) & F.col("embedding").isNotNull()).groupBy("snapshot_id", F.col("canonical_id").alias("doc_id")).agg(F.max("embedding").alias("vector"))
    else:
        mode = "bm25"
    found = ranking.search(mode, docs, queries, vectors, query_vectors, wide, int(settings.get("rrf_k", 60)), 2, step.raw.get("match_operator", "or"), F.col("visible"), columns, "snapshot_id")
    state.hits = ranking.widened(found.select("query_id", "doc_id", "score", "rank"), k)
    place = {sid: n for n, sid in enumerate(ids)}
    state.seeds = [r.doc_id for r in sorted(state.hits.collect(), key=lambda r: (place[r.query_id], r["rank"]))]  # at most k a snapshot
    return None


@action("expand_dependency_tree")
def expand_dependency_tree(step: Step, state: State, rt: Runtime, settings: dict) -> str | None:
    """Around the seeds, over visible nodes only: what lies behind a hidden node is not reached."""
    if not state.seeds or rt.edges is None:
        return None
    depth = step_setting(step, settings, "graph_max_depth", int, 2)
    visible = visible_nodes(rt, state, settings).select("canonical_id")
    state.graph_nodes, state.graph_edges = graph.expand(graph.clean_edges(rt.edges), state.seeds, depth, step_setting(step, settings, "graph_max_nodes", int, 200), settings.get("graph_edge_allowlist"), visible)
    return None


@action("fetch_node_texts")
def fetch_node_texts(step: Step, state: State, rt: Runtime, settings: dict) -> str | None:
    """Texts of seeds and graph nodes that the asker may see, in the step's order (seed_first, graph_first, balanced), as many as the
    budget takes; a larger one is skipped."""
    cap = context.budget_tokens(step.raw.get("max_chars"), step.raw.get("budget_tokens"), step_setting(step, settings, "max_context_tokens", int, 4000))
    if not state.seeds:
        state.node_texts = []
        return None
    seeds = rt.spark.createDataFrame([("r", s, n) for n, s in enumerate(state.seeds, 1)], "request string, node string, rank int")
    order = seeds.select("request", "node", F.col("rank").alias("place"))
    if state.graph_nodes is not None:
        rest = state.graph_nodes.select(F.lit("r").alias("request"), "node", "depth").join(seeds.select("node"), "node", "left_anti")
        arrange = {"balanced": context.balanced, "graph_first": context.rest_then_seeds}.get(step.raw.get("mode"), context.seeds_then_rest)
        order = arrange(seeds, rest, "request", "node").select("request", "node", "place")
    # The order has at most the seeds and max_nodes rows.
    wanted = F.broadcast(order.select(F.col("node").alias("canonical_id")))
    texts = visible_nodes(rt, state, settings).join(wanted, "canonical_id", "left_semi").groupBy(F.col("canonical_id").alias("node")).agg(F.max("text").alias("text"))
    items = order.join(texts, "node").withColumn("tokens", context.approx_tokens("text"))
    state.node_texts = [r.asDict() for r in context.greedy_fit(items, "request", "place", "tokens", cap).orderBy("place").collect()]  # within the budget
    return None


@action("manage_context_budget")
def manage_context_budget(step: Step, state: State, rt: Runtime, settings: dict) -> str | None:
    """All new texts are appended, or none."""
    divider = step.raw.get("divider", "")
    blocks = [f"{divider}\n{t['text']}" if divider and not (t["text"] or "").startswith(divider) else (t["text"] or "") for t in state.node_texts]
    mode, used = step.raw.get("compact", "never"), sum(map(rt.count, state.context_blocks))
    budget = step_setting(step, settings, "max_context_tokens", int, 4000)
    if context.needs_compaction(mode, used, budget, float(step.raw.get("threshold", 1.0)), any(m["topic"] == "compact" for m in step.raw["_inbox"])):
        blocks = ["\n".join(line.rstrip() for line in b.splitlines() if line.strip()) for b in blocks]
    state.context_blocks, how = context.transactional_append(state.context_blocks, blocks, budget, rt.count)
    if how == "ok":
        state.node_texts = []
        return step.raw.get("on_ok")
    return step.raw.get("on_over")


@action("call_model")
def call_model(step: Step, state: State, rt: Runtime, settings: dict) -> str | None:
    dialog, room = [], step_setting(step, settings, "max_history_tokens", int, 800)
    for q, a in reversed(state.dialog):  # oldest turns are dropped first
        room -= rt.count(q) + rt.count(a) + 32
        if room < 0:
            break
        dialog.insert(0, (q, a))
    parts = [(spec.get("template") or "{}").replace("{}", _source(state, spec.get("source", name))) for name, spec in (step.raw.get("user_parts") or {"question": {"source": "question_neutral"}}).items()]
    prompt = markup.chat_prompt(rt.prompts.get(step.raw.get("prompt_key", ""), ""), dialog, "".join(parts))
    if rt.cancelled():
        raise Cancelled(step.id)
    state.last_answer = rt.model(prompt)
    return None


def _source(state: State, name: str) -> str:
    if name in ("user_question_neutral", "question"):
        return state.question_neutral
    value = getattr(state, name, state.variables.get(name, ""))
    return "\n\n".join(map(str, value)) if isinstance(value, list) else str(value or "")


@action("prefix_router")
def prefix_router(step: Step, state: State, rt: Runtime, settings: dict) -> str | None:
    """The first prefix the answer begins with is taken off and its route taken."""
    for prefix, target in (step.raw.get("routes") or {}).items():
        if state.last_answer.lstrip().startswith(prefix):
            state.last_answer = state.last_answer.lstrip()[len(prefix) :].strip()
            state.search_type = step.raw.get("search_types", {}).get(prefix, state.search_type)
            return target
    return step.raw.get("on_other")


@action("json_decision_router")
def json_decision_router(step: Step, state: State, rt: Runtime, settings: dict) -> str | None:
    name, payload = markup.decision(state.last_answer)
    state.last_answer = payload or state.last_answer
    return (step.raw.get("routes") or {}).get(name) or step.raw.get("on_other")


@action("repeat_query_guard")
def repeat_query_guard(step: Step, state: State, rt: Runtime, settings: dict) -> str | None:
    query = " ".join(json.loads(markup.query_payload(state.last_answer))["query"].lower().split())
    return step.raw.get("on_repeat") if not query or query in state.asked else step.raw.get("on_ok")


@action("loop_guard")
def loop_guard(step: Step, state: State, rt: Runtime, settings: dict) -> str | None:
    state.loops[step.id] = state.loops.get(step.id, 0) + 1
    return step.raw.get("on_allow") if state.loops[step.id] <= int(settings.get("max_turn_loops", 4)) else step.raw.get("on_deny")


@action("set_variables")
def set_variables(step: Step, state: State, rt: Runtime, settings: dict) -> str | None:
    for rule in step.raw.get("rules", []):
        if ("from" in rule) == ("value" in rule) or "." in rule["set"]:
            raise ValueError("a rule has either from or value, and a plain name")
        value = rule["value"] if "value" in rule else getattr(state, rule["from"], state.variables.get(rule["from"]))
        how = rule.get("transform", "copy")
        value = {
            "copy": lambda v: v, "to_list": lambda v: v if isinstance(v, list) else [] if v is None else [v], "split_lines": lambda v: [x for x in str(v or "").splitlines() if x.strip()],
            "parse_json": lambda v: json.loads(markup.lenient_json(v) or "null"), "to_context_blocks": lambda v: [str(t.get("text") or "") if isinstance(t, dict) else str(t) for t in v or []], "clear": lambda v: None,
        }[how](value)
        if hasattr(state, rule["set"]):
            setattr(state, rule["set"], value if value is not None else type(getattr(state, rule["set"]) or "")())
        else:
            state.variables[rule["set"]] = value
    return None


@action("inbox_dispatcher", "json_inbox_dispatcher")
def inbox_dispatcher(step: Step, state: State, rt: Runtime, settings: dict) -> str | None:
    """Directives of the answer go to the steps that may have them, under their new names."""
    data = json.loads(markup.lenient_json(markup.first_object(state.last_answer) or "") or "null")
    given = data.get(step.raw.get("directives_key", "dispatch"), []) if isinstance(data, dict) else []
    for d in given if isinstance(given, list) else []:
        rule = (step.raw.get("rules") or {}).get(d.get("target_step_id") or d.get("id"))
        if rule is not None:
            topic = (rule.get("rename") or {}).get(d.get("topic"), d.get("topic"))
            if topic in (rule.get("allow_topics") or [topic]):
                send(state, d.get("target_step_id") or d.get("id"), topic, d.get("payload"))
    return None


@action("load_conversation_history")
def load_conversation_history(step: Step, state: State, rt: Runtime, settings: dict) -> str | None:
    """The session's last finalized turns, history_limit of them; without a session there is no history."""
    if rt.history is None or not state.session_id:
        return None
    mine = rt.history.where((F.col("session_id") == state.session_id) & F.col("finalized_at_utc").isNotNull())
    rows = mine.orderBy(F.desc("finalized_at_utc"), F.desc("turn_id")).limit(step_setting(step, settings, "history_limit", int, 30)).collect()
    state.dialog = [(r.question_neutral, r.answer_neutral) for r in reversed(rows) if r.question_neutral and r.answer_neutral]
    return None


@action("translate_in_if_needed")
def translate_in_if_needed(step: Step, state: State, rt: Runtime, settings: dict) -> str | None:
    state.question_neutral = state.question if settings.get("model_language") in (None, "neutral") else rt.translate_in(state.question)
    return None


@action("translate_out_if_needed")
def translate_out_if_needed(step: Step, state: State, rt: Runtime, settings: dict) -> str | None:
    try:
        state.final_answer = markup.translated_markdown(state.last_answer, rt.translate_out)
    except Exception:  # the original is better than nothing
        state.final_answer = state.last_answer
    return None


@action("add_command_action")
def add_command_action(step: Step, state: State, rt: Runtime, settings: dict) -> str | None:
    for name in step.raw.get("commands", []):
        permission, link = rt.commands.get(name, ("", None))
        if link and (not permission or permission in state.permissions):
            state.last_answer += "\n" + link(state.last_answer)
    return None


@action("finalize")
def finalize(step: Step, state: State, rt: Runtime, settings: dict) -> str | None:
    state.final_answer = "\n\n".join(x for x in (settings.get("banner"), state.final_answer or state.last_answer) if x)
    return None


@action("parallel_roads_action")
def parallel_roads_action(step: Step, state: State, rt: Runtime, settings: dict) -> str | None:
    state.branches = {}
    return None


@action("fork_action")
def fork_action(step: Step, state: State, rt: Runtime, settings: dict) -> str | None:
    """All snapshots at once: the plan is set, and what follows ranks each within one job."""
    state.plan = filters.strings(step.raw.get("snapshots") or state.variables.get("snapshots"))
    return None if state.plan else step.raw.get("on_done")


@action("merge_action")
def merge_action(step: Step, state: State, rt: Runtime, settings: dict) -> str | None:
    """A label and the texts of each snapshot, in the plan's order; the plan is done."""
    for sid in state.plan:
        state.branches[sid] = [t["text"] or "" for t in state.node_texts if f"::{sid}::" in t["node"]]
        state.context_blocks += [step.raw.get("label", "Snapshot {}").replace("{}", sid), *state.branches[sid]]
    state.plan, state.node_texts = [], []
    return None
