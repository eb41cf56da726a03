"""Step pipelines as plain data: loading, inheritance, pinning, checks, export.

A pipeline is {name, settings, steps}; a step is {id, action, next, ...}. `extends` takes the parent's steps in their
order, merged by id, and appends the child's own; maps are merged deeply, lists replaced.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

END = "end"


@dataclass
class Step:
    id: str
    action: str
    next: str | None = None
    raw: dict = field(default_factory=dict)


@dataclass
class Pipeline:
    name: str
    settings: dict
    steps: dict[str, Step]

    @property
    def entry(self) -> str:
        return self.settings.get("entry_step_id") or next(iter(self.steps))


def deep_merge(parent: object, child: object) -> object:
    """child over parent; maps by key, everything else replaced."""
    if isinstance(parent, Mapping) and isinstance(child, Mapping):
        return {k: deep_merge(parent.get(k), child[k]) if k in child else parent[k] for k in [*parent, *[c for c in child if c not in parent]]}
    return child


def with_env(value: object) -> object:
    """${NAME} from the environment, through maps and lists; an unset one stays as it is."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m.group(1), m.group()), value)
    if isinstance(value, Mapping):
        return {k: with_env(v) for k, v in value.items()}
    return [with_env(v) for v in value] if isinstance(value, list) else value


def parse(text: str) -> list[dict]:
    """YAML if that can be read here, else JSON; one pipeline or several under `pipelines`."""
    text = text.removeprefix("YAML") if text.startswith("YAMLpipeline:") else text
    try:
        import yaml

        docs = [d for d in yaml.safe_load_all(text) if d]
    except ImportError:
        docs = [json.loads(text)]
    out = []
    for d in docs:
        out += d["pipelines"] if "pipelines" in d else [d.get("pipeline", d)]
    return out


def load(sources: list[str | Path]) -> dict[str, dict]:
    """Pipelines by name from texts, files, or folders with all their YAML and JSON files; a name that comes twice is an error."""
    found: dict[str, dict] = {}
    origin: dict[str, str] = {}
    parts: list[tuple[str, str]] = []
    for s in sources:
        if not isinstance(s, Path):
            parts.append(("a text", s))
        elif s.is_dir():
            parts += [(str(f), f.read_text()) for f in sorted(s.rglob("*")) if f.suffix.lower() in (".yaml", ".yml", ".json") and f.is_file()]
        else:
            parts.append((str(s), s.read_text()))
    for where, text in parts:
        for p in parse(text):
            name = p.get("name") or p.get("YAMLpipeline", {}).get("name")
            if not name:
                raise ValueError(f"a pipeline of {where} has no name")
            if name in found:
                raise ValueError(f"two pipelines are named {name}: in {origin[name]} and in {where}")
            found[name], origin[name] = p, where
    return found


def resolve(name: str, found: Mapping[str, dict], seen: tuple[str, ...] = ()) -> dict:
    """A pipeline with all it extends merged in."""
    if name in seen:
        raise ValueError(f"pipelines extend each other: {' -> '.join((*seen, name))}")
    if name not in found:
        raise ValueError(f"no pipeline is named {name}")
    child = found[name]
    if not child.get("extends"):
        return child
    parent = resolve(child["extends"], found, (*seen, name))
    steps = {s["id"]: s for s in parent.get("steps", [])}
    for s in child.get("steps", []):
        steps[s["id"]] = deep_merge(steps[s["id"]], s) if s["id"] in steps else s
    return {"name": name, "settings": deep_merge(parent.get("settings", {}), child.get("settings", {})), "steps": list(steps.values())}


def build(raw: Mapping) -> Pipeline:
    ids = [s["id"] for s in raw.get("steps", [])]
    if len(ids) != len(set(ids)):
        raise ValueError("a step id comes twice")
    return Pipeline(raw["name"], dict(with_env(raw.get("settings", {}))), {s["id"]: Step(s["id"], s["action"], s.get("next"), dict(with_env(s))) for s in raw["steps"]})


TARGETS = ("next", "on_ok", "on_over", "on_repeat", "on_done", "on_deny", "on_allow", "on_other", "on_missing")


def problems(p: Pipeline, actions: set[str]) -> list[str]:
    """What is wrong: unknown actions or targets, steps never reached, forks without merges, loops without a way out."""
    out = []
    edges = {s.id: [v for k, v in s.raw.items() if k in TARGETS and isinstance(v, str)] + list((s.raw.get("routes") or {}).values()) for s in p.steps.values()}
    for s in p.steps.values():
        if s.action not in actions:
            out.append(f"{s.id}: no action is named {s.action}")
        out += [f"{s.id}: no step is named {t}" for t in edges[s.id] if t not in p.steps and t != END]
    if p.entry not in p.steps:
        return [*out, f"no step is named {p.entry}"]
    reached, todo = set(), [p.entry]
    while todo:
        s = todo.pop()
        if s in reached or s not in p.steps:
            continue
        reached.add(s)
        todo += edges[s]
    out += [f"{s}: is never reached" for s in p.steps if s not in reached]
    kinds = {s.action for s in p.steps.values()}
    if ("fork_action" in kinds) != ("merge_action" in kinds):
        out.append("a fork and its merge go together")
    if reached and not any(END in edges[s] or not edges[s] for s in reached):
        out.append("no step ends the pipeline")
    return out


DEFAULTS = {"behavior_version": "1", "max_turn_loops": 4, "top_k": 5, "rrf_k": 60, "max_context_tokens": 4000, "max_history_tokens": 800, "graph_max_depth": 2, "graph_max_nodes": 200}


def lock(p: Pipeline) -> str:
    """Everything a run depends on, defaults pinned, as sorted JSON."""
    return json.dumps({"name": p.name, "settings": {**DEFAULTS, **p.settings}, "steps": [s.raw for s in p.steps.values()]}, sort_keys=True, indent=1, default=str)


def apply_lock(p: Pipeline, locked: str) -> Pipeline:
    """The pipeline with the locked settings; a setting the lock does not know is refused."""
    pinned = json.loads(locked)["settings"]
    unknown = sorted(set(p.settings) - set(pinned))
    if unknown:
        raise ValueError(f"settings are not in the lock: {unknown}")
    return Pipeline(p.name, {**pinned, **{k: v for k, v in p.settings.items() if k not in DEFAULTS}}, p.steps)


def plantuml(p: Pipeline) -> str:
    rows = ["@startuml", f"[*] --> {p.entry}"]
    for s in p.steps.values():
        rows.append(f"state {s.id} : {s.action}")
        for k, v in s.raw.items():
            if k in TARGETS and isinstance(v, str):
                rows.append(f"{s.id} --> {'[*]' if v == END else v}" + ("" if k == "next" else f" : {k}"))
        rows += [f"{s.id} --> {v} : {k}" for k, v in (s.raw.get("routes") or {}).items()]
    return "\n".join([*rows, "@enduml"])


def step_setting(step: Step, settings: Mapping, name: str, kind: type, default: object = None) -> object:
    """A typed value of the step, else of the settings, else the default."""
    value = step.raw.get(name, settings.get(name, default))
    if value is None:
        return None
    if kind is bool:
        return str(value).strip().lower() in ("1", "true", "yes", "y", "on")
    return kind(value)
