"""What changed between consecutive full snapshots (problem 1).

States are compared as (snapshot, key, digest) rows: EXCEPT ALL both ways drops what stayed equal, and a full join of
the two residues by key labels the rest. Only digests are shuffled, never texts, so the plan moves about 100 bytes a
record whatever the texts weigh, and its keys are spread evenly even if one repo holds a third of all rows.

Defined cases: null text equals the empty text; repeated rows of a record count once (a record whose rows disagree
keeps the least digest); snapshots without a completed run, or outside any chain, give and receive nothing; the first
snapshot of a chain has no predecessor and gives nothing; equal finish times are ordered by snapshot id. Empty tables
give an empty result. Columns beyond the ones named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwell.records import instant, key_of, snapshot_of, trimmed, valid_rows


def settled(text: str | Column) -> Column:
    """text with LF line ends, no blanks at line ends, no empty lines at the end; null as the empty text."""
    lf = F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"\r\n?", "\n")
    bare = F.regexp_replace(lf, r"(?U)(?<![\s&&[^\n]])[\s&&[^\n]]++(?=\n|\z)", "")
    return F.regexp_replace(bare, r"(?<!\n)\n+\z", "")


def snapshot_chain(runs: DataFrame) -> DataFrame:
    """(before, after) of consecutive complete snapshots of each repo and branch, by earliest finish of a completed run."""
    done = (
        runs.where((F.lower(trimmed("status")) == "completed") & F.col("snapshot_id").isNotNull())
        .groupBy(F.lower(trimmed("repo")).alias("repo"), trimmed("branch").alias("branch"), trimmed("snapshot_id").alias("after"))
        .agg(F.min(instant("finished_utc")).alias("finished"))
        .where(F.col("finished").isNotNull())
    )
    order = Window.partitionBy("repo", "branch").orderBy("finished", "after")
    return done.select(F.lag("after").over(order).alias("before"), "after").where(F.col("before").isNotNull())


def snapshot_changes(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """(snapshot_id, record_key, change_kind) of every complete snapshot against the one before it."""
    chain = snapshot_chain(runs)
    state = (
        valid_rows(nodes)
        .select(snapshot_of().alias("snap"), key_of().alias("record_key"), F.md5(settled("text")).alias("digest"))
        .groupBy("snap", "record_key")
        .agg(F.min("digest").alias("digest"))
    )
    now = state.join(chain, state.snap == chain.after).select(F.col("after").alias("snapshot_id"), "record_key", "digest")
    past = state.join(chain, state.snap == chain.before).select(F.col("after").alias("snapshot_id"), "record_key", "digest")
    new = now.exceptAll(past).withColumnRenamed("digest", "new")
    old = past.exceptAll(now).withColumnRenamed("digest", "old")
    return new.join(old, ["snapshot_id", "record_key"], "full_outer").select(
        "snapshot_id", "record_key", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change_kind")
    )
