"""Graph operators over typed edge tables: clean edges, bounded breadth-first expansion, reachability.

Expansion is a driver loop of joins, one a level; a level's frontier is at most max_nodes ids. Discovery order is
(depth, parent's place, edge's place), so results do not depend on partitioning. Null or blank ends are malformed edges
and are left out; a blank edge type is `unknown`; repeated edges count once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwell.operators.filters import strings
from strandwell.records import trimmed
from strandwell.session import materialize


def clean_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, edge_type): lower-case types, `unknown` for blank ones, each edge once."""
    kind = F.coalesce(F.nullif(F.lower(trimmed("edge_type")), F.lit("")), F.lit("unknown"))
    ends = edges.select(trimmed("from_canonical_id").alias("src"), trimmed("to_canonical_id").alias("dst"), kind.alias("edge_type"))
    return ends.where((F.length("src") > 0) & (F.length("dst") > 0)).distinct()


def stored_edges(edges: DataFrame, snapshot_id: str) -> DataFrame:
    """The clean edges of one snapshot, written once for the many expansions that read them."""
    return materialize(clean_edges(edges.where(F.col("snapshot_id") == snapshot_id)).repartition("src"), "adjacency")


def malformed_edges(edges: DataFrame) -> DataFrame:
    """(n_edges, n_malformed, n_untyped)."""
    blank = lambda c: F.coalesce(F.length(trimmed(c)) == 0, F.lit(True))
    return edges.agg(
        F.count("*").alias("n_edges"),
        F.count_if(blank("from_canonical_id") | blank("to_canonical_id")).alias("n_malformed"),
        F.count_if(blank("edge_type")).alias("n_untyped"),
    )


def require_clean_edges(edges: DataFrame) -> None:
    """Raises ValueError where edges lack an end; for imports that must be whole."""
    found = malformed_edges(edges).first()
    if found.n_malformed:
        raise ValueError(f"{found.n_malformed} of {found.n_edges} edges lack an end")


def type_allowed(allowlist: Iterable[str] | None) -> Column:
    """Regardless of case, with or without the sql_ or cs_ prefix; an empty list or `*` allows all."""
    names = [n.lower() for n in strings(allowlist)]
    if not names or "*" in names:
        return F.lit(True)
    bare = [n.removeprefix("sql_").removeprefix("cs_") for n in names]
    return F.col("edge_type").isin(names) | F.regexp_replace("edge_type", "^(sql|cs)_", "").isin(bare)


def edge_type_counts(edges: DataFrame) -> DataFrame:
    kind = F.coalesce(F.nullif(F.lower(trimmed("edge_type")), F.lit("")), F.lit("unknown"))
    return edges.groupBy(kind.alias("edge_type")).agg(F.count("*").alias("n"))


def inner_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are among nodes (canonical_id)."""
    ids = nodes.select("canonical_id").where("canonical_id IS NOT NULL").distinct()
    return edges.join(ids.withColumnRenamed("canonical_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("canonical_id", "dst"), "dst", "left_semi")


def one_scope(seeds: DataFrame) -> DataFrame:
    """Whether all seeds have one repo (regardless of case) and one snapshot: (n_seeds, n_repos, n_snapshots, consistent)."""
    parts = F.split("canonical_id", "::")
    out = seeds.where(F.size(parts) >= 4).agg(F.countDistinct("canonical_id").alias("n_seeds"), F.countDistinct(F.lower(parts[0])).alias("n_repos"), F.countDistinct(parts[1]).alias("n_snapshots"))
    return out.withColumn("consistent", (F.col("n_repos") <= 1) & (F.col("n_snapshots") <= 1))


def expand(edges: DataFrame, seeds: list[str], max_depth: int = 2, max_nodes: int = 200, allowlist: Iterable[str] | None = None, visible: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first from seeds over edges (src, dst, edge_type): nodes (node, depth, parent, root, place) and edges met.

    Seeds are all returned even above max_nodes; nodes at max_depth are not expanded; edges to known nodes are returned
    too; expansion stops when max_nodes are known. The first parent in order wins. With visible (canonical_id), nodes that are
    not among them are not there: no seed, no target, no way to others, and they take no place under max_nodes.
    """
    spark = edges.sparkSession
    allowed = edges.where(type_allowed(allowlist)).select("src", "dst", "edge_type")
    known: dict[str, tuple[int, str | None, str, int]] = {}
    seeds = strings(seeds)
    if visible is not None:
        visible = visible.select(F.col("canonical_id").alias("dst")).distinct()
        seen = {r.dst for r in visible.where(F.col("dst").isin(seeds)).collect()}  # some of the seeds
        seeds = [s for s in seeds if s in seen]
    for s in seeds:
        known.setdefault(s, (0, None, s, len(known)))
    met: list[tuple[str, str, str]] = []
    frontier = list(known)
    for depth in range(max_depth):
        if not frontier or len(known) >= max_nodes:
            break
        table = spark.createDataFrame([(s, known[s][3]) for s in frontier], "src string, at int")
        # Hubs: of a parent's targets, only the first max_nodes + known are fetched, each with all its edges, so that targets
        # already known can't crowd out new ones.
        order = Window.partitionBy("src").orderBy("dst")
        step = allowed.join(F.broadcast(table), "src")
        if visible is not None:
            step = step.join(visible, "dst", "left_semi")
        step = step.withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= max_nodes + len(known)).orderBy("at", "dst", "edge_type")
        fresh: list[str] = []
        full = False
        last = None
        for r in step.collect():  # at most frontier x (max_nodes + known) targets, each with its edge types
            if r.src != last and len(known) >= max_nodes:
                full = True
            if full:
                break
            last = r.src
            met.append((r.src, r.dst, r.edge_type))
            if r.dst not in known and len(known) < max_nodes:
                known[r.dst] = (depth + 1, r.src, known[r.src][2], len(known))
                fresh.append(r.dst)
        frontier = fresh
    nodes = spark.createDataFrame([(k, *v) for k, v in known.items()], "node string, depth int, parent string, root string, place int")
    return nodes, spark.createDataFrame(met, "src string, dst string, edge_type string").distinct()


def distances(edges: DataFrame, seeds: DataFrame, max_depth: int = 2, allowlist: Iterable[str] | None = None) -> DataFrame:
    """(seed, node, depth) of all nodes within max_depth of each seed: all seeds at once, unbounded in size.

    One join a level; each level is written to the shared folder, so lineage stays short and a lost executor costs one level.
    """
    allowed = edges.where(type_allowed(allowlist)).select("src", "dst").distinct()
    reached = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct()
    frontier = reached
    for depth in range(1, max_depth + 1):
        step = frontier.select("seed", F.col("node").alias("src")).join(allowed, "src").select("seed", F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)), "bfs")
        reached = reached.unionByName(frontier)
    return reached


def travel(edges: DataFrame, seeds: DataFrame, visible: DataFrame, max_depth: int = 2, allowlist: Iterable[str] | None = None) -> DataFrame:
    """distances over visible nodes (canonical_id) only: no path through a hidden node; hidden seeds reach nothing."""
    ids = visible.select(F.col("canonical_id").alias("seed")).distinct()
    return distances(inner_edges(edges, visible), seeds.join(ids, "seed", "left_semi"), max_depth, allowlist)


def with_parents(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(seed, node, depth, parent): the least node one level up that has an edge to it."""
    up = reached.select("seed", F.col("node").alias("src"), (F.col("depth") + 1).alias("depth"))
    back = reached.join(edges.select("src", F.col("dst").alias("node")).distinct(), "node").join(up, ["seed", "src", "depth"]).groupBy("seed", "node", "depth").agg(F.min("src").alias("parent"))
    return reached.join(back, ["seed", "node", "depth"], "left")
