"""Application settings as tables and maps: consultants and templates by group, snapshot sets of pipelines, branches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwell.operators.security import visible_for
from strandwell.operators.snapshots import set_members, snapshot_labels
from strandwell.plans.loader import Pipeline


def snapshot_sets_of(pipelines: Mapping[str, Pipeline]) -> dict[str, str]:
    """Pipeline name to the snapshot set that its settings name; pipelines without one are left out."""
    return {name: str(p.settings["snapshot_set_id"]) for name, p in sorted(pipelines.items()) if p.settings.get("snapshot_set_id")}


def allowed_pipelines(pipelines: DataFrame, allowed: DataFrame, key: str = "pipeline") -> DataFrame:
    """The pipelines that a user's policies name; if they name none, all."""
    if allowed.where(F.col(key).isNotNull()).isEmpty():
        return pipelines
    return pipelines.join(allowed.select(key).distinct(), key, "left_semi")


def consultants(configs: DataFrame, groups: list[str], sets: DataFrame, runs: DataFrame) -> DataFrame:
    """(consultant_id, pipeline, snapshot_set_id, snapshots): what a user's groups may see, with the set's snapshots as (id, label), by label.

    configs has consultant_id, pipeline, snapshot_set_id and groups; a set without snapshots gives an empty list.
    """
    mine = visible_for(configs, "groups", groups)
    members = set_members(sets).join(snapshot_labels(runs), "snapshot_id", "left").select("snapshot_set_id", F.struct(F.coalesce("label", "snapshot_id").alias("label"), F.col("snapshot_id").alias("id")).alias("s"))
    lists = members.groupBy("snapshot_set_id").agg(F.sort_array(F.collect_set("s")).alias("snapshots"))  # a set's members are a settings list
    kind = lists.schema["snapshots"].dataType
    return mine.join(lists, "snapshot_set_id", "left").select("consultant_id", "pipeline", "snapshot_set_id", F.coalesce("snapshots", F.array().cast(kind)).alias("snapshots"))


def branches(runs: DataFrame, configured: list[str] | None = None) -> DataFrame:
    """(repo, branch) of completed runs; of the configured branches only, if there are any."""
    found = runs.where(F.lower(F.trim("status")) == "completed").select("repo", F.trim("branch").alias("branch")).where("branch <> ''").distinct()
    return found.where(F.col("branch").isin(configured)) if configured else found


def connection_settings(config: Mapping[str, object], environment: Mapping[str, str], defaults: Mapping[str, object], prefix: str) -> dict[str, object]:
    """Each setting from the environment, else the config, else its default; numbers and booleans keep the default's type."""
    out = {}
    for name, default in defaults.items():
        value = environment.get(f"{prefix}_{name}".upper(), config.get(name))
        if value in (None, ""):
            value = default
        elif isinstance(default, bool):
            value = str(value).strip().lower() in ("1", "true", "yes", "on")
        elif isinstance(default, (int, float)):
            value = type(default)(str(value).strip())
        out[name] = value
    return out
