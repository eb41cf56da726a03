"""Rebuilding conversations from message rows (problem 3), with keyed streaming state.

Rows are read as a stream. A session's turns are buffered in the state of the session's key until event time has passed
its last turn by the idle gap; then the conversation is closed: its turns are judged, numbered by time and emitted, and
leave the state. Keys are hashes of session ids, so that one call merges the rows of many sessions by columns; a session
with more rows than PART_ROWS is spread over several keys by turn, each of which emits its part.

* `conversation_stream` is the streaming step, for bounded and unbounded sources alike. Rows later than `lateness` are
  dropped by the watermark; a row without a readable time has no event time and is never late.
* `conversations` runs a bounded source through it. The lateness is then the source's own span of time, so that no row is
  late and nothing closes early in whatever micro-batches the rows come; a row after all others closes what is open.
* `reconciled` joins what one session has emitted in parts or closures: turns are merged by turn_id and judged anew, and
  numbered by sorted ranges, so that no session is ever in a single task.

Defined cases: sessions are equal after trimming white space and ignoring case; rows without one, and rows with a null
turn_id, belong to no conversation; a question or answer is absent if null, without letter or digit, or a written-out
null; copies of a turn that disagree keep the earliest readable time and the least text; equal times are ordered by
turn_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandwell.records import instant, trimmed
from strandwell.session import materialize, new_path

IDLE_GAP_MS = 24 * 3600 * 1000
LATENESS_MS = 7 * 24 * 3600 * 1000
PART_ROWS = 100_000  # rows of a session that one key may hold, by count
BUCKET_ROWS = 2_000  # rows a key holds on the average
BUCKETS = 512  # keys where nothing is known of the source's size
NO_TIME = 2**63 - 1
_STATE = "turns binary"
_OUT = "session_id string, part int, closed_ms bigint, whole boolean, turn_no int, turn_id string, at_us bigint, question string, answer string"
_KEY = ["session_id", "part", "turn_id"]
COLUMNS = ("turn_id", "session_id", "created_at_utc", "question_neutral", "answer_neutral")


def present(text: str | Column) -> Column:
    """Text that is there: has a letter or digit and isn't a written-out null."""
    c = trimmed(text)
    return F.coalesce(c.rlike(r"[\p{L}\p{N}]") & ~F.lower(c).isin("null", "none"), F.lit(False))


def merged(turns: pd.DataFrame) -> pd.DataFrame:
    """One row for each turn of each session: earliest time, least texts, latest event."""
    code = turns.groupby(_KEY, sort=False, dropna=False).ngroup().to_numpy()
    if len(code) == 0 or code.max() + 1 == len(code):
        return turns.reset_index(drop=True)
    first = np.unique(code, return_index=True)[1]
    out = turns.iloc[first].reset_index(drop=True)
    at, event = np.full(len(first), NO_TIME), np.full(len(first), -1)
    np.minimum.at(at, code, turns["at_us"].to_numpy(np.int64))
    np.maximum.at(event, code, turns["event_ms"].to_numpy(np.int64))
    out["at_us"], out["event_ms"] = at, event
    for c in ("question", "answer"):
        given = pd.DataFrame({"code": code, c: turns[c].to_numpy(object)}).dropna().sort_values(["code", c]).drop_duplicates("code")
        values = np.full(len(first), None, object)
        values[given["code"].to_numpy()] = given[c].to_numpy(object)
        out[c] = values
    return out


def judged(turns: pd.DataFrame, closed_ms: int) -> pd.DataFrame:
    """Turns of closed sessions in the form of _OUT; a part of a session is numbered later, with the others."""
    session = turns.groupby(["session_id", "part"], sort=False).ngroup().to_numpy()
    at = turns["at_us"].to_numpy(np.int64)
    good = (at != NO_TIME) & turns["question"].notna().to_numpy() & turns["answer"].notna().to_numpy()
    broken = np.bincount(session[~good], minlength=session.max() + 1) > 0
    turn = pd.factorize(turns["turn_id"], sort=True)[0]
    order = np.lexsort((turn, at, session))
    starts = np.flatnonzero(np.concatenate(([True], np.diff(session[order]) != 0)))
    number = np.arange(1, len(order) + 1) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    out = turns.iloc[order].reset_index(drop=True)
    out["closed_ms"], out["whole"] = closed_ms, ~broken[session[order]]
    out["turn_no"] = np.where(out["part"].to_numpy() == 0, number, 0).astype(np.int32)
    return out[[c.split()[0] for c in _OUT.split(", ")]]


_TURNS = pa.schema([("session_id", pa.string()), ("part", pa.int32()), ("turn_id", pa.string()), ("at_us", pa.int64()), ("question", pa.string()), ("answer", pa.string()), ("event_ms", pa.int64())])


def _packed(turns: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _TURNS, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(pa.Table.from_pandas(turns[_TURNS.names], _TURNS, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_all().to_pandas()


def _buffer(gap_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [_unpacked(state.get[0])] if state.exists else []
        if not state.hasTimedOut:
            parts += [b[_TURNS.names] for b in batches]
        turns = merged(pd.concat(parts, ignore_index=True))
        now = state.getCurrentWatermarkMs()
        if now > 0:  # a row without a time came at the latest now
            turns["event_ms"] = np.where(turns["event_ms"] < 0, now, turns["event_ms"])
        last = turns.groupby(["session_id", "part"], sort=False)["event_ms"].transform("max").to_numpy(np.int64)
        closed = (last >= 0) & (last + gap_ms < now)
        if closed.any():
            yield judged(turns[closed].reset_index(drop=True), now)
        rest = turns[~closed]
        if len(rest):
            state.update((_packed(rest),))
            state.setTimeoutTimestamp(max(int(last[~closed].min()) + gap_ms, now) + 1)
        else:
            state.remove()

    return step


def keyed_rows(rows: DataFrame, hot: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Message rows with what the state needs; hot (session_id, parts) names the sessions that are spread."""
    found = rows.select(
        F.lower(trimmed("session_id")).alias("session_id"),
        "turn_id",
        instant("created_at_utc").alias("event"),
        F.when(present("question_neutral"), F.col("question_neutral")).alias("question"),
        F.when(present("answer_neutral"), F.col("answer_neutral")).alias("answer"),
    ).where((F.length("session_id") > 0) & F.col("turn_id").isNotNull())
    part = F.lit(0)
    if hot is not None:
        found = found.join(hot, "session_id", "left")
        part = F.when(F.col("parts").isNotNull(), 1 + F.pmod(F.xxhash64("turn_id"), F.col("parts")).cast("int")).otherwise(0)
    found = found.withColumn("part", part.cast("int"))
    return found.select(
        F.pmod(F.xxhash64("session_id", "part"), F.lit(buckets)).cast("int").alias("bucket"), "session_id", "part", "turn_id",
        F.coalesce(F.unix_micros("event"), F.lit(NO_TIME)).alias("at_us"), "question", "answer", F.coalesce(F.unix_millis("event"), F.lit(-1)).cast("bigint").alias("event_ms"), "event",
    )


def conversation_stream(keyed: DataFrame, lateness_ms: int = LATENESS_MS, gap_ms: int = IDLE_GAP_MS) -> DataFrame:
    """The streaming step over keyed_rows: every turn of each closed conversation, judged, in the form of _OUT."""
    return keyed.withWatermark("event", f"{lateness_ms} milliseconds").groupBy("bucket").applyInPandasWithState(_buffer(gap_ms), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def replayed(spark: SparkSession, path: str, part_rows: int = PART_ROWS, files_per_batch: int | None = None) -> tuple[DataFrame, bool]:
    """What the stream emits of a bounded folder or file of message rows, and whether sessions were spread."""
    source = spark.read.parquet(path).select(*COLUMNS)
    at = F.unix_millis("event")
    sessions = materialize(keyed_rows(source).groupBy("session_id").agg(F.count("*").alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi")), "sessions")
    seen = sessions.agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("most")).first()
    lo, hi = (seen.lo, seen.hi) if seen.lo is not None else (0, 0)
    spread = (seen.most or 0) > part_rows
    hot = sessions.where(F.col("n") > part_rows).select("session_id", F.ceil(F.col("n") / part_rows).cast("int").alias("parts")) if spread else None
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(seen.n or 0) // BUCKET_ROWS))
    span = hi - lo + 1
    gap = max(IDLE_GAP_MS, span)
    reader = spark.readStream.schema(source.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A stream takes folders and patterns; a pattern that only this name fits stands for a file too.
    bare = path.rstrip("/")
    rows = keyed_rows(reader.parquet(path if "*" in path else f"{bare[:-1]}[{bare[-1]}]"), hot, buckets)
    closing = new_path(spark, "closing")
    end = F.timestamp_millis(F.lit(hi + 2 * (span + gap) + 1))
    last = spark.range(1).select(*[(end if c == "event" else F.lit("closing") if c == "session_id" else F.lit(0) if t in ("int", "bigint") else F.lit(None)).cast(t).alias(c) for c, t in rows.dtypes])
    last.where("false").write.parquet(closing)
    out, log = new_path(spark, "conversations"), new_path(spark, "conversations-log")
    # The closing row comes in a run of its own, after all rows, in however many micro-batches those came.
    for closes in (False, True):
        if closes:
            last.coalesce(1).write.mode("append").parquet(closing)
        both = rows.unionByName(spark.readStream.schema(last.schema).parquet(closing))
        query = conversation_stream(both, span, gap).writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(_OUT).parquet(out).where(F.col("turn_id").isNotNull()), spread


def numbered(turns: DataFrame) -> DataFrame:
    """turn_no by session in the order of time and turn_id: ranges of the sorted table are counted, then numbered each on its own."""
    order = ["session_id", "at_us", "turn_id"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(turns.repartitionByRange(parts, *order).withColumn("rng", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("session_id", "rng").agg(F.count("*").alias("n"))  # a session has at most as many rows here as there are ranges
    before = F.coalesce(F.sum("n").over(Window.partitionBy("session_id").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("session_id", "rng").orderBy("at_us", "turn_id"))
    return ranged.join(counts.select("session_id", "rng", before.alias("before")), ["session_id", "rng"]).withColumn("turn_no", (F.col("before") + place).cast("int")).drop("rng", "before")


def reconciled(emitted: DataFrame) -> DataFrame:
    """The turns of whole conversations; a session emitted in several parts or closures is merged by turn_id and judged anew."""
    kept = ["session_id", "turn_no", "turn_id", "at_us", "question", "answer"]
    again = emitted.groupBy("session_id").agg(F.min(F.struct("part", "closed_ms")).alias("a"), F.max(F.struct("part", "closed_ms")).alias("b")).where("a <> b or a.part > 0").select("session_id")
    turns = emitted.join(again, "session_id", "left_semi").groupBy("session_id", "turn_id").agg(*[F.min(c).alias(c) for c in ("at_us", "question", "answer")])
    whole = turns.groupBy("session_id").agg(F.min((F.col("at_us") != NO_TIME) & F.col("question").isNotNull() & F.col("answer").isNotNull()).alias("whole")).where("whole").select("session_id")
    late = numbered(turns.join(whole, "session_id", "left_semi"))
    return emitted.where("whole").join(again, "session_id", "left_anti").select(*kept).unionByName(late.select(*kept))


def conversations(spark: SparkSession, path: str, part_rows: int = PART_ROWS, files_per_batch: int | None = None) -> DataFrame:
    """(session_id, turn_no, turn_id, at_us, question, answer) of every turn of the conversations that are kept."""
    emitted, spread = replayed(spark, path, part_rows, files_per_batch)
    return reconciled(emitted) if spread else emitted.where("whole").select("session_id", "turn_no", "turn_id", "at_us", "question", "answer")


def conversations_found(spark: SparkSession, path: str) -> DataFrame:
    return conversations(spark, path).select("session_id", "turn_no", "turn_id")


def conversation_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of the kept conversations: user and assistant alternate, position from 1."""
    both = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    turns = conversations(spark, path).select("session_id", "turn_no", F.posexplode(both).alias("k", "m"))
    return turns.select("session_id", (F.col("turn_no") * 2 - 1 + F.col("k")).alias("position"), "m.role", "m.content")
