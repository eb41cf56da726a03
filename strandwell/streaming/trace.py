"""Trace events as streams: policy projection, bounded run logs, retention, and event-time windows.

The functions take streaming and static DataFrames alike. Event times are cast from TIMESTAMP_NTZ, as watermarks need a
timestamp; the session's zone is UTC.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST_EVENTS = 600
RETENTION_MS = 20 * 60 * 1000


def visibility(global_policy: str, pipeline: str, explicit: str | Column) -> Column:
    """forbidden anywhere wins; allowed everywhere shows all; else only what a step marks."""
    if "forbidden" in (global_policy, pipeline):
        return F.lit(False)
    if global_policy == "allowed" and pipeline == "allowed":
        return F.lit(True)
    return F.coalesce(F.col(explicit) if isinstance(explicit, str) else explicit, F.lit(False))


def projected(events: DataFrame, shown: Column) -> DataFrame:
    """(event_id, ts, user_id, kind, detail) of shown events: what a listener is told depends on the event."""
    detail = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("k="), F.get_json_object("props", "$.k")))
        .when(F.col("event_type") == "purchase", F.format_string("value %.2f", F.col("value")))
        .when(F.col("event_type") == "error", F.substring("props", 1, 180))
    )
    return events.where(shown).select("event_id", "ts", "user_id", F.col("event_type").alias("kind"), detail.alias("detail"))


def timed(events: DataFrame, lateness: str | None = None) -> DataFrame:
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", lateness) if lateness else out


def tumbling(events: DataFrame, size: str = "1 hour", lateness: str | None = None) -> DataFrame:
    g = timed(events, lateness).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("from_ts"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes", lateness: str | None = None) -> DataFrame:
    g = timed(events, lateness).groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("from_ts"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str | None = None) -> DataFrame:
    g = timed(events, lateness).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("from_ts"), F.col("session_window.end").alias("to_ts"), "n")


_LOG = "user_id bigint, event_id bigint, position int, version bigint"


def _bounded(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    times, ids, version = ([int(x) for x in state.get[0]], [int(x) for x in state.get[1]], int(state.get[2])) if state.exists else ([], [], 0)
    new = [(int(t), int(i)) for b in batches for t, i in zip(b["ms"], b["event_id"])]
    # By time over all batches: an event that comes late takes its place, or none if the log is full of later ones.
    kept = sorted({*zip(times, ids), *new})[-MOST_EVENTS:]
    state.update(([t for t, _ in kept], [i for _, i in kept], version + 1))
    state.setTimeoutTimestamp(max(kept[-1][0], state.getCurrentWatermarkMs()) + RETENTION_MS)
    yield pd.DataFrame({"user_id": key[0], "event_id": [i for _, i in kept], "position": range(1, len(kept) + 1), "version": version + 1})


def run_logs(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each run's last MOST_EVENTS events as they stand after a batch, with a version that rises; a run is dropped RETENTION_MS after its last event.

    State holds event ids and times only and is bounded by MOST_EVENTS a run, whatever the run's length. `newest_logs` keeps what stands.
    """
    keyed = timed(events, lateness).select("user_id", "event_id", F.unix_millis("ts").alias("ms"), "ts")
    return keyed.groupBy("user_id").applyInPandasWithState(_bounded, _LOG, "times array<bigint>, ids array<bigint>, version bigint", "update", GroupStateTimeout.EventTimeTimeout)


def newest_logs(emitted: DataFrame) -> DataFrame:
    """Of every version of each run's log that was emitted, the newest: (user_id, event_id, position)."""
    last = emitted.groupBy("user_id").agg(F.max("version").alias("version"))
    return emitted.join(last, ["user_id", "version"]).select("user_id", "event_id", "position")


def last_events(events: DataFrame, run: str, time: str, key: str, most: int = MOST_EVENTS) -> DataFrame:
    """The batch form of run_logs: each run's last events, n from 1 for the newest."""
    order = Window.partitionBy(run).orderBy(F.desc(time), F.desc(key))
    return events.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)


def event_counts(events: DataFrame, kind: str, value: str) -> DataFrame:
    """(kind, n, mean)."""
    return events.groupBy(kind).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))


def inbox_split(messages: DataFrame, target: str, step: str) -> DataFrame:
    """messages with part: `taken` by the step they are for, else `kept`."""
    return messages.withColumn("part", F.when(F.coalesce(F.col(target) == step, F.lit(False)), "taken").otherwise("kept"))


#: What a listener is told of each action: the fields of its details, with the most characters of texts.
DETAILS: dict[str, list[tuple[str, int]]] = {
    "search_nodes": [("search_type", 0), ("top_k", 0), ("query", 180), ("hits", 0)],
    "fetch_node_texts": [("node_texts", 0)],
    "manage_context_budget": [("context_blocks", 0), ("context_tokens", 0)],
    "call_model": [("prompt", 0), ("max_output_tokens", 0)],
}


def step_details(action: str | Column = "action", payload: str | Column = "payload") -> Column:
    """JSON of an event's details by its action, from the JSON text of its payload; fields that are not there are left out; other actions have none."""
    a, p = (F.col(c) if isinstance(c, str) else c for c in (action, payload))
    out = F.lit("{}")
    for name, fields in DETAILS.items():
        value = lambda f, most: F.substring(F.get_json_object(p, f"$.{f}"), 1, most) if most else F.get_json_object(p, f"$.{f}")
        out = F.when(a == name, F.to_json(F.struct(*[value(f, most).alias(f) for f, most in fields]))).otherwise(out)
    return out


def replay_and_done(stored: DataFrame, live: DataFrame, run: str = "run_id", key: str = "event_id", kind: str = "event_type", ends: tuple[str, ...] = ("RUN_END", "ERROR", "CANCELLED")) -> DataFrame:
    """What is stored, then what is new, nothing twice, with `done` on the last event of each run that has ended."""
    both = replay_then_tail(stored, live, key)
    last = Window.partitionBy(run).orderBy(F.desc(key))
    return both.withColumn("done", (F.row_number().over(last) == 1) & F.col(kind).isin(*ends))


def kept_turns(turns: DataFrame, lateness: str = "1 day", most: int = 200, ttl_ms: int = 30 * 24 * 3600 * 1000) -> DataFrame:
    """A stream of turns (session_id, turn_id, ts) as each session's last `most` turns after every batch; a silent session is dropped after ttl_ms."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(zip(*(list(x) for x in state.get[:2]))) if state.exists else []
        version = int(state.get[2]) + 1 if state.exists else 1
        kept = sorted({(int(t), str(i)) for t, i in held} | {(int(t), i) for b in batches for t, i in zip(b["ms"], b["turn_id"])})[-most:]
        state.update(([t for t, _ in kept], [i for _, i in kept], version))
        state.setTimeoutTimestamp(max(kept[-1][0], state.getCurrentWatermarkMs()) + ttl_ms)
        yield pd.DataFrame({"session_id": key[0], "turn_id": [i for _, i in kept], "position": range(1, len(kept) + 1), "version": version})

    keyed = timed(turns, lateness).select("session_id", "turn_id", F.unix_millis("ts").alias("ms"), "ts")
    return keyed.groupBy("session_id").applyInPandasWithState(step, "session_id string, turn_id string, position int, version bigint", "times array<bigint>, ids array<string>, version bigint", "update", GroupStateTimeout.EventTimeTimeout)


def replay_then_tail(stored: DataFrame, live: DataFrame, key: str = "event_id") -> DataFrame:
    """What is stored, then what is new; nothing twice."""
    return stored.unionByName(live.join(stored.select(key), key, "left_anti"))
