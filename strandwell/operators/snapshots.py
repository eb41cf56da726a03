"""Import runs and snapshot sets: latest runs, labels, set upkeep, purging."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwell.operators.filters import strings
from strandwell.records import instant, trimmed


def completed_runs(runs: DataFrame, repo: str | None = None, limit: int = 200) -> DataFrame:
    """Completed runs, newest first."""
    done = runs.where("status = 'completed'")
    if repo:
        done = done.where(F.col("repo") == repo)
    return done.dropDuplicates(["import_id"]).withColumn("at", F.coalesce(instant("finished_utc"), instant("started_utc"))).orderBy(F.desc("at"), "import_id").limit(limit)


def latest_run_per_ref(runs: DataFrame) -> DataFrame:
    """The newest completed run of each repo, ref type and ref name."""
    at = F.coalesce(instant("finished_utc"), instant("started_utc"))
    order = Window.partitionBy("repo", "ref_type", "ref_name").orderBy(F.desc_nulls_last("at"), "import_id")
    return runs.where("status = 'completed'").withColumn("at", at).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def label_of_run() -> Column:
    """friendly_name, tag, ref_name or branch: the first that is set."""
    return F.coalesce(*[F.nullif(trimmed(c), F.lit("")) for c in ("friendly_name", "tag", "ref_name", "branch")])


def snapshot_labels(runs: DataFrame) -> DataFrame:
    """(snapshot_id, label) by the newest run of each snapshot."""
    at = F.coalesce(instant("finished_utc"), instant("started_utc"))
    order = Window.partitionBy("snapshot_id").orderBy(F.desc_nulls_last("at"), "import_id")
    return runs.withColumn("at", at).withColumn("n", F.row_number().over(order)).where("n = 1").select("snapshot_id", label_of_run().alias("label"))


def set_members(sets: DataFrame) -> DataFrame:
    """(snapshot_set_id, snapshot_id) of active sets."""
    return sets.where("is_active").select("snapshot_set_id", F.explode("allowed_snapshot_ids").alias("snapshot_id")).distinct()


def without_snapshot(sets: DataFrame, snapshot_ids: Iterable[str]) -> DataFrame:
    """Sets after these snapshots are gone; sets that held nothing else are deleted."""
    gone = F.array(*[F.lit(s) for s in strings(snapshot_ids)]).cast("array<string>")
    left = F.filter("allowed_snapshot_ids", lambda x: ~F.array_contains(gone, x))
    touched = F.coalesce(F.arrays_overlap("allowed_snapshot_ids", gone), F.lit(False))
    return sets.where(~(touched & (F.size(left) == 0))).withColumn("allowed_snapshot_ids", F.when(touched, left).otherwise(F.col("allowed_snapshot_ids")))


def purged(rows: DataFrame, repo: str, snapshot_id: str) -> DataFrame:
    """rows without those of a snapshot."""
    return rows.where(~(F.coalesce(F.col("repo") == repo, F.lit(False)) & F.coalesce(F.col("snapshot_id") == snapshot_id, F.lit(False))))


def resolve_snapshot(members: DataFrame, set_id: str, wanted: str | None = None) -> str:
    """The one snapshot of a set, or the wanted one if it is in it; else an error."""
    mine = members.where(F.col("snapshot_set_id") == set_id).select("snapshot_id").distinct()
    if wanted:
        if mine.where(F.col("snapshot_id") == wanted).isEmpty():
            raise ValueError("the snapshot is not in the set")
        return wanted
    ids = [r.snapshot_id for r in mine.limit(2).collect()]  # enough to see whether it is the only one
    if len(ids) != 1:
        raise ValueError(f"{'no' if not ids else 'several'} snapshots in the set; one must be named")
    return ids[0]


def without_sets(sets: DataFrame, set_ids: Iterable[str]) -> DataFrame:
    """The sets but those named."""
    return sets.where(~F.coalesce(F.col("snapshot_set_id").isin(strings(set_ids)), F.lit(False)))


def set_counts(sets: DataFrame) -> DataFrame:
    return sets.agg(F.count("*").alias("n_sets"), F.count_if("is_active").alias("n_active"))


def in_plan_order(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """rows with their ordinal within a plan."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def access_consistency(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """(n_nodes, n_completed, n_without_access, n_unknown, consistent): whether all completed imports were made with access lists.

    A run without a status counts as completed. Without nodes everything is consistent, with nodes but no completed run nothing is.
    """
    done = runs.dropDuplicates(["import_id"]).where(F.coalesce(F.lower(trimmed("status")), F.lit("")).isin("", "completed"))
    counts = done.select(F.lit(0).alias("n_nodes"), F.lit(1).alias("n_completed"), F.coalesce(~F.col("acl_enabled"), F.lit(False)).cast("int").alias("n_without_access"), F.col("acl_enabled").isNull().cast("int").alias("n_unknown"))
    held = nodes.select(F.lit(1).alias("n_nodes"), *[F.lit(0).alias(c) for c in ("n_completed", "n_without_access", "n_unknown")])
    found = counts.unionByName(held).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_nodes", "n_completed", "n_without_access", "n_unknown")])
    return found.withColumn("consistent", (F.col("n_nodes") == 0) | ((F.col("n_completed") > 0) & (F.col("n_without_access") == 0) & (F.col("n_unknown") == 0)))


def require_access_consistency(nodes: DataFrame, runs: DataFrame) -> None:
    found = access_consistency(nodes, runs).first()
    if not found.consistent:
        raise RuntimeError(f"access lists are on, but of {found.n_completed} completed imports {found.n_without_access} were made without them and {found.n_unknown} do not tell")


def set_id_of(text: str | Column) -> Column:
    """A set id: non-word characters as `-`, squeezed and stripped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "-"), "-{2,}", "-"), "^-+|-+$", "")


def import_stats(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Raw rows, distinct keys and duplicates, rolled up to the total."""
    return rows.rollup(*by).agg(F.count("*").alias("raw"), F.countDistinct(key).alias("n_unique")).withColumn("dupes", F.col("raw") - F.col("n_unique"))


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
