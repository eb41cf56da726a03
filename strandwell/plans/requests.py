"""A query from its request to its answer: validated, its snapshot resolved, access enforced, its pipeline run.

Nothing of a request widens access: filters of the user's access overwrite those of the request, and a snapshot must be a
member of its set. Errors are ValueError for what is malformed and PermissionError for what is not allowed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from strandwell.operators import filters
from strandwell.operators.nodes import check_membership
from strandwell.operators.snapshots import resolve_snapshot, set_members
from strandwell.plans import engine
from strandwell.plans.loader import Pipeline


@dataclass
class Access:
    """What a user may do: empty pipelines mean all of them; tags, labels and level go into every search."""

    user_id: str = ""
    pipelines: list[str] = field(default_factory=list)
    acl: list[str] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    level: int | None = None
    permissions: set[str] = field(default_factory=set)

    def filters(self) -> dict:
        out = {"acl_tags_any": self.acl, "classification_labels_all": self.labels, "user_level": self.level}
        return {k: v for k, v in out.items() if v not in (None, [])}


@dataclass
class Request:
    query: str
    pipeline: str
    session_id: str = ""
    snapshot_set_id: str = ""
    snapshot_id: str = ""
    snapshot_id_b: str = ""
    repo: str = ""
    overrides: dict = field(default_factory=dict)


def validated(raw: dict) -> Request:
    """A request from JSON; unknown override keys, an empty query and a pair of equal snapshots are errors."""
    text = lambda *names: next((str(raw[n]).strip() for n in names if raw.get(n) not in (None, "")), "")
    r = Request(text("query", "question"), text("pipeline", "pipelineName", "consultant"), text("session_id", "sessionId"), text("snapshot_set_id", "snapshotSetId"), text("snapshot_id", "snapshotId"), text("snapshot_id_b", "snapshotIdB"), text("repo", "repository"), filters.checked_overrides(raw.get("filters") or {}))
    if not r.query:
        raise ValueError("a query is required")
    if not r.pipeline:
        raise ValueError("a pipeline is required")
    if r.snapshot_id_b and r.snapshot_id_b == r.snapshot_id:
        raise ValueError("the two snapshots are the same")
    return r


def enforce(request: Request, access: Access, sets: DataFrame | None) -> None:
    """The pipeline must be the user's, and the snapshots those of the set."""
    if access.pipelines and request.pipeline not in access.pipelines:
        raise PermissionError(f"pipeline_not_allowed: {request.pipeline}")
    asked = [request.snapshot_id, request.snapshot_id_b]
    if request.snapshot_set_id and any(asked):
        if sets is None:
            raise RuntimeError("snapshots can't be checked: there is no table of sets")
        check_membership(sets, request.snapshot_set_id, asked, request.repo or None)


def snapshots_of(request: Request, sets: DataFrame | None) -> list[str]:
    """The one or two snapshots a request asks for; of a set with a single one that one."""
    given = [s for s in (request.snapshot_id, request.snapshot_id_b) if s]
    if given:
        return given
    if not request.snapshot_set_id or sets is None:
        raise ValueError("a snapshot_id or a snapshot_set_id is required")
    return [resolve_snapshot(set_members(sets), request.snapshot_set_id)]


def answer(raw: dict, access: Access, pipelines: dict[str, Pipeline], rt: engine.Runtime, sets: DataFrame | None = None) -> engine.State:
    """Runs a request's pipeline as the user; the state has the answer, its trace and what was read."""
    request = validated(raw)
    enforce(request, access, sets)
    if request.pipeline not in pipelines:
        raise ValueError(f"no pipeline is named {request.pipeline}")
    ids = snapshots_of(request, sets)
    mine = filters.merged({**request.overrides, **({"repo": request.repo} if request.repo else {})}, {**access.filters(), "snapshot_id": ids[0]})
    state = engine.State(request.query, {k: v for k, v in mine.items() if v not in (None, [])}, set(access.permissions), request.session_id, variables={"snapshots": ids})
    return engine.run(pipelines[request.pipeline], state, rt)
