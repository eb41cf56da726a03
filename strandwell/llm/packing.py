"""Filling fixed-capacity containers with texts (problem 8), by Karmarkar-Karp multiway differencing.

Texts are spread by hash over groups whose contents fill about GROUP_CONTAINERS containers, so every group is small
whatever the data's size and no key can be hot. In each group the number of containers is the least that could hold its tokens; partial partitions
with the largest differences are merged, large sums on small ones, until one is left. Where a container of the result
exceeds the capacity, items are moved and exchanged into the gaps of others, and what still has no place gets containers
of its own, packed in the same way.

A text larger than the capacity is cut into full containers and a rest, which is packed like any text; no other text
is split. Defined cases: texts without tokens (null, empty) need no place and have no row; several rows of one doc_id
are placed each; a capacity under one token is refused; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwell.llm.tokens import TOKENIZERS, with_tokens
from strandwell.session import materialize

GROUP_CONTAINERS = 512
GROUP_ITEMS = 20_000  # above, a group's smallest items are bundled
SEED = 7
_OUT = "container_kind string, capacity_tokens bigint, container_id string, doc_id bigint, from_token bigint, to_token bigint"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The items of k near-equal windows."""
    if not sizes or k == 1:
        return [list(range(len(sizes)))] + [[] for _ in range(k - 1)]
    n = len(sizes)
    # A partial partition holds its k sums in descending order; one of a single item is only its size.
    heap = [(-size, i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}
    merges: list[tuple[int, int, np.ndarray]] = []

    def taken() -> tuple[int, np.ndarray]:
        _, i = heapq.heappop(heap)
        if i >= n:
            return i, sums.pop(i)
        alone = np.zeros(k, np.int64)
        alone[0] = sizes[i]
        return i, alone

    while len(heap) > 1:
        (i, a), (j, b) = taken(), taken()
        both = a + b[::-1]
        order = np.argsort(-both, kind="stable")
        sums[n + len(merges)] = both = both[order]
        heapq.heappush(heap, (int(both[-1] - both[0]), n + len(merges)))
        merges.append((i, j, order))
    windows: list[list[int]] = [[] for _ in range(k)]
    stack = [(heap[0][1], np.arange(k))]
    while stack:  # from the last partition back to the items
        i, at = stack.pop()
        if i < n:
            windows[at[0]].append(i)
        else:
            left, right, order = merges[i - n]
            was = np.empty(k, np.int64)
            was[order] = at
            stack += [(left, was), (right, was[::-1])]
    return windows


def repaired(windows: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows within capacity.

    Full windows give up their smallest items. These are placed again together with the items of the emptiest windows, each into
    the gap it fits best, the largest first; of such windows as few are opened, twice as many at each try, as hold them all. If even
    all windows can't, there must be more of them.
    """
    sums = [sum(sizes[i] for i in w) for w in windows]
    kept, loose = [], []
    for w, total in zip(windows, sums):
        w = sorted(w, key=lambda i: -sizes[i])
        while total > capacity:
            loose.append(w.pop())
            total -= sizes[loose[-1]]
        kept.append((capacity - total, w))
    if not loose:
        return [w for _, w in kept]
    kept.sort(key=lambda p: -p[0])
    opened = 1
    while True:
        opened = min(len(kept), opened * 2)
        items = sorted([*loose, *(i for _, w in kept[:opened] for i in w)], key=lambda i: -sizes[i])
        whole = [list(w) for _, w in kept[opened:]] + [[] for _ in range(opened)]
        gap = np.array([g for g, _ in kept[opened:]] + [capacity] * opened, np.int64)
        left = []
        for i in items:
            room = np.where(gap >= sizes[i], gap, capacity + 1)
            w = int(room.argmin())
            if room[w] > capacity:
                left.append(i)
            else:
                gap[w] -= sizes[i]
                whole[w].append(i)
        if not left:
            return whole
        if opened == len(kept):
            return whole + packed_items(left, sizes, capacity)


def packed_items(items: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    return [[items[i] for i in w] for w in packed([sizes[i] for i in items], capacity)]


def packed(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most capacity; sizes are at most capacity each. What the least number of windows leaves over gets windows of its own."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity), sum(s * 2 > capacity for s in sizes))
    return [w for w in repaired(differencing(sizes, k), sizes, capacity) if w]


def bundled(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bundle of each item; only where a group has very many items are its small ones taken together, up to a 64th of the capacity."""
    number = np.arange(len(sizes))
    small = sizes * 128 <= capacity
    if len(sizes) > GROUP_ITEMS and small.any():
        number[small] = len(sizes) + (np.cumsum(sizes[small]) * 128) // capacity
    return np.unique(number, return_inverse=True)[1]


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["size", "doc_id", "from_token"], ascending=[False, True, True], ignore_index=True)
    capacity = int(group["capacity_tokens"].iloc[0])
    name = f"{group['container_kind'].iloc[0]}-{group['grp'].iloc[0]}"
    sizes = group["size"].to_numpy(np.int64)
    bundle = bundled(sizes, capacity)
    at = np.zeros(bundle.max() + 1, np.int64)
    for c, window in enumerate(packed(np.bincount(bundle, weights=sizes).astype(np.int64).tolist(), capacity)):
        at[window] = c
    group["container_id"] = [f"{name}-{c}" for c in at[bundle]]
    group["to_token"] = group["from_token"] + group["size"]
    return group[["container_kind", "capacity_tokens", "container_id", "doc_id", "from_token", "to_token"]]


def containers(documents: DataFrame, specs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Every text's place: container_kind, capacity_tokens, container_id, doc_id, from_token, to_token."""
    kinds = [(r.container_kind, int(r.capacity_tokens)) for r in specs.where("capacity_tokens >= 1").select("container_kind", "capacity_tokens").distinct().collect()]  # a settings table
    docs = documents.where(F.length("text") > 0).select(F.col("doc_id").cast("bigint").alias("key"), "text")
    sizes = materialize(with_tokens(docs, tokenizers).where("tokens > 0").withColumnRenamed("key", "doc_id"), "token-counts")
    spark = documents.sparkSession
    if not kinds:
        return spark.createDataFrame([], _OUT)
    rests = [F.sum(F.col("tokens") % F.lit(c)).alias(f"r{n}") for n, (_, c) in enumerate(kinds)]
    totals = sizes.agg(*rests).first()
    spec = F.explode(F.array(*[F.struct(F.lit(kind).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity_tokens"), F.lit(max(1, round((totals[n] or 0) / c / GROUP_CONTAINERS))).cast("bigint").alias("groups")) for n, (kind, c) in enumerate(kinds)]))
    items = sizes.select("doc_id", "tokens", spec.alias("s")).select("doc_id", "tokens", "s.*")
    full = F.floor(F.col("tokens") / F.col("capacity_tokens"))
    filled = items.where(full > 0).withColumn("n", F.explode(F.sequence(F.lit(0).cast("bigint"), full - 1))).select(
        "container_kind", "capacity_tokens", F.concat_ws("-", "container_kind", F.lit("full"), F.col("doc_id").cast("string"), F.col("n").cast("string")).alias("container_id"), "doc_id",
        (F.col("n") * F.col("capacity_tokens")).alias("from_token"), ((F.col("n") + 1) * F.col("capacity_tokens")).alias("to_token"),
    )
    rest = items.withColumn("size", F.col("tokens") % F.col("capacity_tokens")).where("size > 0").withColumns({"from_token": F.col("tokens") - F.col("size"), "grp": F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.col("groups"))})
    placed = rest.select("container_kind", "capacity_tokens", "grp", "doc_id", "from_token", "size").groupBy("container_kind", "grp").applyInPandas(_pack, _OUT)
    return filled.unionByName(placed)


def container_fill(documents: DataFrame, specs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(container_kind, capacity_tokens, containers, tokens, fill) of each kind: how full its containers are on the whole."""
    each = containers(documents, specs, tokenizers).groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("t"))
    return each.groupBy("container_kind", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.round(F.sum("t") / F.sum("capacity_tokens"), 6).alias("fill"))
