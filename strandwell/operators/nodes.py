"""Nodes and edges by id and scope: lookups, previews, label unions, membership of snapshot sets.

A node may have several rows, one for each import; lookups give one row an id, the greatest value of each column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row(nodes: DataFrame, columns: list[str], key: str = "canonical_id") -> DataFrame:
    """(key, columns): one row for each id; null ids are left out."""
    return nodes.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(c).alias(c) for c in columns])


def hits_with_nodes(hits: DataFrame, nodes: DataFrame, columns: list[str], key: str = "canonical_id") -> DataFrame:
    """Hits with their nodes' columns; a hit without a node keeps its row, with nulls."""
    return hits.join(one_row(nodes, columns, key), key, "left")


def fetched(ids: DataFrame, nodes: DataFrame, columns: list[str], visible=None, key: str = "canonical_id") -> DataFrame:
    """The asked nodes that may be seen, with empty text for null columns; unknown ids have no row."""
    seen = nodes if visible is None else nodes.where(visible)
    found = seen.join(ids.select(key).distinct(), key, "left_semi")
    return found.select(key, *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns]).distinct()


def tenant_edges(edges: DataFrame, snapshot_id: str, repo: str | None = None) -> DataFrame:
    """The edges of one snapshot, and repository if one is named."""
    out = edges.where(F.col("snapshot_id") == snapshot_id)
    return out.where(F.col("repo") == repo) if repo else out


def frontier(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, dst, edge_type): one level out of each seed."""
    return seeds.select("seed").distinct().join(edges, F.col("seed") == F.col("src")).select("seed", "dst", "edge_type")


def roots(reached: DataFrame) -> DataFrame:
    """(node, root, depth): of each reached node the nearest seed, the least of equals."""
    return reached.groupBy("node").agg(F.min(F.struct("depth", "seed")).alias("m")).select("node", F.col("m.seed").alias("root"), "m.depth")


def previews(edges: DataFrame, most: int = 200) -> DataFrame:
    """The first edges in the order of their ends: a report, not a result to go on with."""
    return edges.select("from_canonical_id", "to_canonical_id").orderBy("from_canonical_id", "to_canonical_id").limit(most)


def label_union(nodes: DataFrame, by: str) -> DataFrame:
    """(by, acl, labels, level): all tags and labels of a scope, sorted, and its highest level."""
    rows = nodes.select(by, F.explode_outer("acl_allow").alias("tag"), F.col("classification_labels").alias("ls"), "doc_level")
    tags = rows.where("tag IS NOT NULL").select(by, F.lit("acl").alias("kind"), F.col("tag").alias("v"))
    labels = nodes.select(by, F.lit("labels").alias("kind"), F.explode("classification_labels").alias("v")).where("v IS NOT NULL")
    # Distinct values are few; they are found before anything is gathered.
    lists = tags.unionByName(labels).distinct().groupBy(by).agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("v")))).alias(k) for k in ("acl", "labels")])
    levels = nodes.groupBy(by).agg(F.max("doc_level").alias("level"))
    empty = F.array().cast("array<string>")
    both = levels.join(lists.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")), "left")
    return both.select(by, F.coalesce("acl", empty).alias("acl"), F.coalesce("labels", empty).alias("labels"), "level")


def in_active_sets(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of snapshots that an active set holds."""
    held = sets.where("is_active").select(F.explode("allowed_snapshot_ids").alias("snapshot_id")).distinct()
    return nodes.join(held, "snapshot_id", "left_semi")


def check_membership(sets: DataFrame, set_id: str, snapshot_ids: list[str], repo: str | None = None) -> None:
    """Raises PermissionError, which names the reason, if a snapshot is not in the active set."""
    asked = [s for s in snapshot_ids if s]
    if not set_id or not asked:
        return
    rows = sets.where((F.col("snapshot_set_id") == set_id) & F.col("is_active"))
    if repo:
        rows = rows.where(F.col("repo") == repo)
    held = {r.s for r in rows.select(F.explode("allowed_snapshot_ids").alias("s")).where(F.col("s").isin(asked)).distinct().collect()}  # some of those asked for
    for s in asked:
        if s not in held:
            raise PermissionError(f"snapshot_not_in_snapshot_set: {s}")
