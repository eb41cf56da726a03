"""Sessions, messages and turns as tables: paging, idempotent writes, joins, retention.

Writes return the table as it is after the write; storing it is the caller's (see sources.tables). Paging is by key, not
by offset: the next page begins after the last (time, id), so ties are never skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, time: str, key: str, limit: int, after: tuple[object, object] | None = None, q: str | None = None, title: str = "title", restart: bool = False) -> DataFrame:
    """Newest first, 1 to 200 rows after the cursor (time, id); the cursor of the next page is the last row if it is full.

    A cursor whose row is gone goes on from its place; with restart it begins anew.
    """
    limit = max(1, min(200, limit))
    if q:
        rows = rows.where(F.lower(title).contains(q.lower()))
    if after and restart and rows.where((F.col(time) == F.lit(after[0])) & (F.col(key) == F.lit(after[1]))).isEmpty():
        after = None
    if after:
        t, k = (F.lit(v) for v in after)
        rows = rows.where((F.col(time) < t) | ((F.col(time) == t) & (F.col(key) < k)))
    return rows.orderBy(F.desc(time), F.desc(key)).limit(limit)


def last_messages(rows: DataFrame, session: str, time: str, key: str, n: int, before: object = None) -> DataFrame:
    """The last n rows of each session before a time, numbered in ascending order of time."""
    if before is not None:
        rows = rows.where(F.col(time) < F.lit(before))
    newest = Window.partitionBy(session).orderBy(F.desc(time), F.desc(key))
    oldest = Window.partitionBy(session).orderBy(time, key)
    return rows.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= n).withColumn("position", F.row_number().over(oldest)).drop("n")


def new_sessions(sessions: DataFrame, messages: DataFrame, session: str = "session_id", title_chars: int = 64) -> DataFrame:
    """sessions (session_id, identity_id, title, created_at, updated_at, deleted_at) with a row for each session that only messages know.

    Its title is the start of its first question; sessions that are there stay as they are.
    """
    first = F.min(F.struct(F.col("created_at").isNull(), "created_at", "message_id", "identity_id", "question"))
    made = messages.where(F.col(session).isNotNull()).groupBy(session).agg(first.alias("m"), F.max("created_at").alias("updated_at"))
    title = F.substring(F.trim(F.regexp_replace(F.coalesce("m.question", F.lit("")), r"\s+", " ")), 1, title_chars)
    rows = made.select(session, "m.identity_id", title.alias("title"), "m.created_at", "updated_at", F.lit(None).cast(sessions.schema["deleted_at"].dataType).alias("deleted_at"))
    return insert_new(sessions, rows.select(*sessions.columns), [session])


def with_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """messages and the new ones whose message_id is not there yet: sending twice is once."""
    return insert_new(messages, new.select(*messages.columns), ["message_id"])


def touched(sessions: DataFrame, messages: DataFrame, session: str = "session_id") -> DataFrame:
    """sessions whose updated_at is that of their last message, if that is later."""
    last = messages.groupBy(session).agg(F.max("created_at").alias("_last"))
    return sessions.join(last, session, "left").withColumn("updated_at", F.greatest("updated_at", "_last")).drop("_last")


def patched(sessions: DataFrame, changes: DataFrame, session: str = "session_id") -> DataFrame:
    """sessions with the title and the time of each change (session_id, title, updated_at); blank titles and unknown or deleted sessions change nothing."""
    new = changes.where(F.trim("title") != "").groupBy(session).agg(F.max(F.struct("updated_at", "title")).alias("_c"))
    due = F.col("_c").isNotNull() & F.col("deleted_at").isNull()
    out = sessions.join(new, session, "left")
    return out.withColumns({"title": F.when(due, F.trim("_c.title")).otherwise(F.col("title")), "updated_at": F.when(due, F.col("_c.updated_at")).otherwise(F.col("updated_at"))}).drop("_c")


def deleted(sessions: DataFrame, ids: DataFrame, at: object, session: str = "session_id") -> DataFrame:
    """sessions with deleted_at set for those named; what is deleted already keeps its time."""
    gone = ids.select(session).distinct().withColumn("_gone", F.lit(True))
    return sessions.join(gone, session, "left").withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("_gone"), F.lit(at)))).drop("_gone")


def message_counts(messages: DataFrame, session: str) -> DataFrame:
    return messages.where(F.col(session).isNotNull()).groupBy(session).agg(F.count("*").alias("n"))


def with_tag(sessions: DataFrame, tags: DataFrame, tag: str, session: str = "session_id") -> DataFrame:
    """The sessions that bear a tag."""
    return sessions.join(tags.where(F.col("tag") == tag).select(session), session, "left_semi")


def messages_of_sessions(messages: DataFrame, sessions: DataFrame, session: str = "session_id") -> DataFrame:
    """Messages with their session's identity; messages of no session are left out."""
    return messages.join(sessions.select(session, "identity_id"), session)


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table and those rows whose key it does not hold; of repeated new keys one row."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows replace those of the same key."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def finalize_turns(turns: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Answers and metadata written over turns of the same key; metadata is merged, the new value wins."""
    new = answers.select(*keys, F.col("answer_neutral").alias("_a"), F.col("finalized_at_utc").alias("_f"), F.col("metadata").alias("_m"))
    empty = F.create_map().cast("map<string,string>")
    old, add = F.coalesce("metadata", empty), F.coalesce("_m", empty)
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(add), k))
    return turns.join(new, keys, "left").withColumns({"answer_neutral": F.coalesce("_a", "answer_neutral"), "finalized_at_utc": F.coalesce("_f", "finalized_at_utc"), "metadata": F.map_concat(kept, add)}).drop("_a", "_f", "_m")


def retained(rows: DataFrame, session: str, order: list, most: int, time: str, oldest: object) -> DataFrame:
    """At most `most` rows of a session, none older than `oldest`."""
    return rows.where(F.col(time) >= F.lit(oldest)).withColumn("_n", F.row_number().over(Window.partitionBy(session).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def with_fallback(primary: DataFrame, durable: DataFrame, key: str) -> DataFrame:
    """primary's rows, and durable's of the keys that primary has none of."""
    return primary.unionByName(durable.join(primary.select(key).distinct(), key, "left_anti"))


def retag(tags: DataFrame, keys: DataFrame, tag: str, on: bool) -> DataFrame:
    """(id, tag) rows after setting or unsetting a tag; setting twice is once."""
    wanted = keys.select("id").distinct().withColumn("tag", F.lit(tag))
    return insert_new(tags, wanted, ["id", "tag"]) if on else tags.join(wanted, ["id", "tag"], "left_anti")
