"""Writing and changing stored tables: partitioned node and edge tables, upserts, JSON and CSV logs.

Parquet has no MERGE; a change rewrites only the partitions it touches, into a new folder that takes the old one's
place at the end, so that a reader or a failed job never sees half of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwell.operators.history import upsert
from strandwell.operators.snapshots import first_wins
from strandwell.session import materialize


def write_nodes(nodes: DataFrame, path: str, embed: Callable | None = None) -> dict[str, int]:
    """First row of each id, embedded if asked; each snapshot's partition is replaced, so that writing twice is once. Raw, unique and duplicate counts."""
    counted = materialize(nodes.where("canonical_id IS NOT NULL").withColumn("_raw", F.count("*").over(Window.partitionBy("canonical_id"))), "import")  # read once
    out = first_wins(counted, ["canonical_id"], ["import_id"])
    found = out.agg(F.coalesce(F.sum("_raw"), F.lit(0)).alias("raw"), F.count("*").alias("n")).first()
    out = out.drop("_raw")
    if embed is not None:
        out = out.withColumn("embedding", embed(F.col("text")))
    replace_partitions(out.repartition("snapshot_id", F.pmod(F.xxhash64("canonical_id"), F.lit(8))), path, "snapshot_id")
    return {"raw": found.raw, "unique": found.n, "dupes": found.raw - found.n}


def write_edges(edges: DataFrame, path: str) -> None:
    """Each edge once; each snapshot's partition is replaced."""
    keys = ["snapshot_id", "edge_type", "from_canonical_id", "to_canonical_id"]
    replace_partitions(edges.dropDuplicates(keys), path, "snapshot_id")


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """The partitions that rows hold are replaced, the others stay."""
    rows.write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def upsert_rows(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], by: str) -> None:
    """rows over the table at path, in the partitions they touch only."""
    touched = rows.select(by).distinct()
    old = spark.read.parquet(path).join(touched, by, "left_semi")
    replace_partitions(materialize(upsert(old, rows.select(*old.columns), keys), "upsert"), path, by)


def drop_snapshot(spark: SparkSession, path: str, snapshot_id: str) -> None:
    """The snapshot's folder is deleted; nothing else is read or written."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/snapshot_id={snapshot_id}")
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def write_trace(events: DataFrame, path: str) -> None:
    """Events as JSON lines, a folder a run; columns in the order of their names. A run's folder is replaced as a whole."""
    events.select(*sorted(events.columns)).write.partitionBy("run_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def latest_trace(spark: SparkSession, path: str, time: str = "ts") -> DataFrame:
    """The events of the run that ended last."""
    events = spark.read.json(path)
    last = events.agg(F.max(F.struct(time, "run_id")).alias("m")).select("m.run_id")
    return events.join(F.broadcast(last), "run_id", "left_semi")  # one row


def append_query_log(queries: DataFrame, path: str, preview: int = 200) -> None:
    """A day's folder of JSON lines with shortened texts and, where began and ended are given, the duration in milliseconds (queries, model calls, interactions)."""
    rows = queries.withColumns({"query": F.substring("query", 1, preview), "day": F.to_date("at")})
    if {"began", "ended"} <= set(queries.columns):
        rows = rows.withColumn("duration_ms", F.unix_millis("ended") - F.unix_millis("began"))
    rows.write.partitionBy("day").mode("append").json(path)


EVALUATION = ["case_id", "path", "kind", "score", "verdict", "n_problems", "categories", "seconds", "report"]


def write_evaluation(rows: DataFrame, path: str) -> None:
    """An index of evaluated cases, fixed columns, with a header."""
    rows.select(*EVALUATION).write.mode("overwrite").option("header", True).csv(path)
