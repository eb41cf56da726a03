"""Text, vector and hybrid top-k search, and rank fusion.

A batch of queries is a table (query_id, ...); results are (query_id, doc_id, score, rank), rank from 1. Scores are
rounded to six places before ranking and ties broken by doc_id, so ranks are the same whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwell.operators.keyword import bm25_hits
from strandwell.session import materialize

K1, B = 1.2, 0.75
RRF_K = 60
MISSING_RANK = 10**9
TOKEN = r"[a-z0-9_]+"
QUERY_BYTES = 32 << 20  # query vectors that are broadcast
QUERY_BLOCK = 512  # query vectors of a block
ROW_BLOCK = 8192
SCORES_HELD = 1 << 21
INDEX_SAMPLE = 20_000  # vectors that an index's cells are fitted on, about


def tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def top_k(scored: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Ranks within each query; Spark prunes each partition to k rows a query before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *(by or ["doc_id"]))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def postings(docs: DataFrame, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """(doc_id, term, tf, dl) over the given columns taken together."""
    words = tokens(F.concat_ws(" ", *columns))
    each = docs.select("doc_id", words.alias("w")).select("doc_id", F.size("w").cast("long").alias("dl"), F.explode("w").alias("term"))
    return each.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25_statistics(docs: DataFrame) -> DataFrame:
    """(n_docs, avg_dl) over documents with a token."""
    return docs.select(F.size(tokens("text")).alias("dl")).where("dl > 0").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, operator: str = "or", keep: Column | None = None, columns: tuple[str, ...] = ("text",), part: str | None = None) -> DataFrame:
    """Okapi BM25 of (query_id, query) over docs; statistics over all docs, keep filters what may be returned.

    operator "and" asks for every query term. No pair of query and document is shuffled, see keyword.py. With part, a column of
    docs and queries, each part is a corpus of its own with statistics of its own, all in one plan of joins.
    """
    words = docs.select("doc_id", *([part] if part else []), (F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))).alias("kept"), tokens(F.concat_ws(" ", *columns)).alias("w"))
    if not part:
        return top_k(bm25_hits(words, queries.select("query_id", "query", tokens("query").alias("w")), k, operator == "and", K1, B), k)
    terms = queries.select("query_id", part, F.explode(F.array_distinct(tokens("query"))).alias("term"))
    words = words.withColumn("dl", F.size("w").cast("long"))
    stats = words.where("dl > 0").groupBy(part).agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"))
    # Only postings of query terms are kept before anything is shuffled.
    each = words.select("doc_id", part, "kept", "dl", F.explode("w").alias("term")).join(terms.select(part, "term").distinct(), [part, "term"], "left_semi")
    posts = each.groupBy("doc_id", part, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.first("kept").alias("kept"))
    df = posts.groupBy(part, "term").agg(F.count("*").alias("df"))
    found = terms.join(posts.where("kept"), [part, "term"]).join(df, [part, "term"]).join(stats, part)
    n, avg = F.col("n"), F.col("avg_dl")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avg))
    hits = found.groupBy("query_id", "doc_id").agg(F.round(F.sum(gain), 6).alias("score"), F.count("*").alias("matched"))
    if operator == "and":
        need = terms.groupBy("query_id").agg(F.count("*").alias("need"))
        hits = hits.join(need, "query_id").where("matched = need")
    return top_k(hits.select("query_id", "doc_id", "score"), k)


def unit(vector: str | Column) -> Column:
    """A vector of length one, in doubles; a zero vector stays."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _kept_best(best: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (query number, score, id) arrays the k best of each query, by score, then id."""
    at, score, ids = best
    order = np.lexsort((ids, -score, at))
    at, score, ids = at[order], score[order], ids[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
    rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return [a[rank < k] for a in (at, score, ids)]


def _scores(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines; q is of length one already."""
    return np.round(q @ (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)).T, 6)


def _unit_rows(vectors) -> np.ndarray:
    a = np.stack([np.asarray(v, np.float64) for v in vectors])
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)


def vector_search(rows: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False, part: str | None = None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """Exact cosine top-k of (query_id, vector) against all rows (doc_id, vector); with part, a column of both, within each part.

    Query vectors of at most query_bytes in all, which is measured first, are broadcast: every task keeps k rows a query, and no
    vector is shuffled. More of them meet the rows block by block, each a matrix product that leaves k rows a query.
    """
    size = queries.agg(F.sum(F.size("vector") * F.lit(8).cast("long")).alias("b")).first().b or 0
    out = f"query_id {dict(queries.dtypes)['query_id']}, doc_id {dict(rows.dtypes)['doc_id']}, score double"
    hits = _against_broadcast(rows, queries, k, exclude_self, part, out) if size <= query_bytes else _by_blocks(rows, queries, k, exclude_self, part, out)
    return top_k(hits, k)


def _against_broadcast(rows: DataFrame, queries: DataFrame, k: int, exclude_self: bool, part: str | None, out: str) -> DataFrame:
    given = queries.collect()  # at most query_bytes of vectors
    if not given:
        return rows.sparkSession.createDataFrame([], out)
    names = np.array([r.query_id for r in given])
    shared = rows.sparkSession.sparkContext.broadcast((names, np.array([r[part] for r in given]) if part else None, _unit_rows([r.vector for r in given])))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts, q = shared.value
        least = np.full(len(names), -np.inf)
        kept: list[np.ndarray] = []
        kinds = ()
        for batch in batches:
            kinds = (batch.schema.field("doc_id").type,)
            step = max(1, SCORES_HELD // len(names))
            for i in range(0, batch.num_rows, step):
                piece = batch.slice(i, step)
                ids = np.array(piece.column("doc_id").to_pylist())
                vectors = piece.column("vector")
                flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                scores = _scores(q, flat.reshape(len(ids), -1))
                if exclude_self:
                    scores[names[:, None] == ids[None, :]] = -np.inf
                if parts is not None:
                    scores[parts[:, None] != np.array(piece.column(part).to_pylist())[None, :]] = -np.inf
                at, col = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
                new = [at, scores[at, col], ids[col]]
                kept = _kept_best([np.concatenate(x) for x in zip(kept, new)] if kept else new, k)
                full = np.bincount(kept[0], minlength=len(names)) >= k
                worst = np.full(len(names), np.inf)
                np.minimum.at(worst, kept[0], kept[1])
                least = np.where(full, worst, -np.inf)
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(names[kept[0]].tolist()), pa.array(kept[2].tolist(), kinds[0]), pa.array(kept[1])], names=["query_id", "doc_id", "score"])

    return rows.where("vector IS NOT NULL").select("doc_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"), *([part] if part else [])).mapInArrow(best, out)


def _by_blocks(rows: DataFrame, queries: DataFrame, k: int, exclude_self: bool, part: str | None, out: str) -> DataFrame:
    by = [part] if part else []
    wanted = queries.select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"), *by)
    held = rows.where("vector IS NOT NULL").select("doc_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"), *by)
    if part:
        sizes = queries.groupBy(part).agg(F.count("*").alias("nq")).join(rows.groupBy(part).agg(F.count("*").alias("nr")), part)
        wanted, held = wanted.join(sizes, part), held.join(sizes, part)
    else:
        sizes = {"nq": F.lit(queries.count()), "nr": F.lit(rows.count())}
        wanted, held = wanted.withColumns(sizes), held.withColumns(sizes)
    q_blocks, r_blocks = F.ceil(F.col("nq") / QUERY_BLOCK), F.ceil(F.col("nr") / ROW_BLOCK)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    wanted = wanted.select("query_id", "vector", *by, F.pmod(F.xxhash64("query_id"), q_blocks).alias("qb"), each(r_blocks).alias("rb"))
    held = held.select("doc_id", "vector", *by, F.pmod(F.xxhash64("doc_id"), r_blocks).alias("rb"), each(q_blocks).alias("qb"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": left["query_id"][:0], "doc_id": right["doc_id"][:0], "score": np.zeros(0)})
        names, ids = left["query_id"].to_numpy(), np.array(right["doc_id"].tolist())
        scores = _scores(_unit_rows(left["vector"]), np.stack(right["vector"].to_numpy()))
        if exclude_self:
            scores[names[:, None] == ids[None, :]] = -np.inf
        at = np.repeat(np.arange(len(names)), min(k * 4, len(ids)))
        col = np.argpartition(-scores, min(k * 4, len(ids)) - 1, axis=1)[:, : k * 4].ravel()
        cut = np.partition(-scores, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
        tied = (-scores <= cut[:, None]).sum(1) > min(k * 4, len(ids))  # more equal scores at the end than were taken
        if tied.any():
            at, col = np.nonzero(-scores <= cut[:, None])
        at, score, ids = _kept_best([at, scores[at, col], ids[col]], k)
        good = np.isfinite(score)
        return pd.DataFrame({"query_id": names[at[good]], "doc_id": ids[good], "score": score[good]})

    return wanted.groupBy(*by, "qb", "rb").cogroup(held.groupBy(*by, "qb", "rb")).applyInPandas(best, out)


def _nearest(vectors: pa.Array, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each vector, nearest first."""
    rows = _unit_rows(vectors.to_pylist())
    return np.argsort(-(rows @ centres.T), axis=1, kind="stable")[:, :n]


class VectorIndex:
    """Approximate cosine search: every row is in the cell of its nearest centre, and a query looks into its nearest cells.

    How many cells that are is measured on the sample: enough for `target` of the ten nearest neighbours of its vectors. Neighbours
    in the whole table are nearer still, so its recall is no lower.

    Centres are fitted by k-means on about INDEX_SAMPLE rows, chosen by a hash of their ids; every row is indexed, and the index is a
    table. Within the cells the search is exact, by vector_search, which also splits large cells into blocks.
    """

    def __init__(self, rows: DataFrame, cells: int | None = None, sample: int = INDEX_SAMPLE, rounds: int = 12, seed: int = 5, target: float = 0.95) -> None:
        held = rows.where("vector IS NOT NULL").select("doc_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
        total = held.count()
        limit = min(1 << 30, -(-(1 << 30) * sample // max(1, total)))
        few = held.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < limit).orderBy("doc_id").collect()  # about `sample` vectors
        self.empty = not few
        points = _unit_rows([r.vector for r in few]) if few else np.zeros((1, 1))
        self.cells = max(1, min(cells or round(total**0.5), len(points)))
        random = np.random.default_rng(seed)
        centres = points[random.choice(len(points), self.cells, replace=False)]
        for _ in range(rounds):
            near = np.concatenate([(points[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(points), 4096)])
            sums = np.zeros_like(centres)
            np.add.at(sums, near, points)
            full = np.bincount(near, minlength=self.cells) > 0
            centres = np.where(full[:, None], sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300), centres)
        asking = points[random.choice(len(points), min(500, len(points)), replace=False)]
        scores = asking @ points.T
        best = np.argsort(-scores, axis=1, kind="stable")[:, 1:11]  # the first is the vector itself
        place = np.argsort(np.argsort(-(asking @ centres.T), axis=1, kind="stable"), axis=1)
        home = (points @ centres.T).argmax(1)
        ranks = np.sort(np.take_along_axis(place, home[best], axis=1).ravel()) if best.size else np.zeros(1, np.int64)
        self.probes = int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))]) + 1
        self._centres = rows.sparkSession.sparkContext.broadcast(centres)
        kind = dict(rows.dtypes)["doc_id"]
        self.rows = materialize(self._celled(held, "doc_id", 1).select("doc_id", "vector", F.col("cells")[0].alias("cell")) if few else held.withColumn("cell", F.lit(0)).selectExpr(f"cast(doc_id as {kind}) doc_id", "vector", "cell"), "vector-index")

    def _celled(self, rows: DataFrame, key: str, n: int) -> DataFrame:
        shared = self._centres

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cells = pa.array(_nearest(b.column("vector"), shared.value, n).tolist(), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([b.column(key), b.column("vector"), cells], names=[key, "vector", "cells"])

        return rows.select(key, "vector").mapInArrow(assign, f"{key} {dict(rows.dtypes)[key]}, vector array<double>, cells array<int>")

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank) of (query_id, vector)."""
        if self.empty:
            return vector_search(self.rows, queries, k)
        asked = queries.where("vector IS NOT NULL").select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
        wide = self._celled(asked, "query_id", min(probes or self.probes, self.cells)).select("query_id", "vector", F.explode("cells").alias("cell"))
        return vector_search(self.rows, wide, k, part="cell")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n, n_found, recall) of the exact hits that are among those found."""
    both = exact.select("query_id", "doc_id").join(found.select("query_id", "doc_id").withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return both.agg(F.count("*").alias("n"), F.count("hit").alias("n_found")).withColumn("recall", F.round(F.col("n_found") / F.col("n"), 6))


def rrf(a: DataFrame, b: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; ties by a's rank, b's rank, doc_id; a missing rank is last."""
    both = a.select("query_id", "doc_id", F.col("rank").alias("ra")).join(b.select("query_id", "doc_id", F.col("rank").alias("rb")), ["query_id", "doc_id"], "full_outer")
    part = lambda r: F.coalesce(1.0 / (F.lit(rrf_k) + F.col(r)), F.lit(0.0))
    scored = both.withColumns({"score": F.round(part("ra") + part("rb"), 9), "ra": F.coalesce("ra", F.lit(MISSING_RANK)), "rb": F.coalesce("rb", F.lit(MISSING_RANK))})
    return top_k(scored, k, ["ra", "rb", "doc_id"]).select("query_id", "doc_id", "score", "rank")


def scaled(hits: DataFrame) -> DataFrame:
    """Scores to 0..1 within each query by their least and most; equal scores are 1."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))


def weighted(semantic: DataFrame, keyword: DataFrame, k: int, alpha: float = 0.7) -> DataFrame:
    """alpha times the scaled semantic score and the rest of the scaled keyword score; missing is 0."""
    s, t = scaled(semantic).select("query_id", "doc_id", F.col("score").alias("s")), scaled(keyword).select("query_id", "doc_id", F.col("score").alias("t"))
    both = s.join(t, ["query_id", "doc_id"], "full_outer")
    return top_k(both.select("query_id", "doc_id", F.round(alpha * F.coalesce("s", F.lit(0.0)) + (1 - alpha) * F.coalesce("t", F.lit(0.0)), 6).alias("score")), k)


def tfidf_cosine(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Cosine of TF-IDF vectors, idf ln((1+N)/(1+df))+1; only shared terms are joined, norms are kept by document."""
    n = float(docs.where(F.size(tokens("text")) > 0).count())
    posts = postings(docs)
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)
    w = posts.join(df, "term").select("doc_id", "term", weight.alias("w"))
    norms = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    q = queries.select("query_id", F.explode(tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf")).join(df, "term").select("query_id", "term", weight.alias("qw"))
    qn = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    sums = q.join(w, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("w")).alias("s"))
    return top_k(sums.join(norms, "doc_id").join(qn, "query_id").select("query_id", "doc_id", F.round(F.col("s") / (F.col("norm") * F.col("qnorm")), 6).alias("score")), k)


def distinct_queries(rows: DataFrame, column: str) -> DataFrame:
    """(query): queries that differ in more than case and blanks, without empty ones."""
    return rows.where(F.col(column).isNotNull()).select(F.lower(F.trim(F.regexp_replace(column, r"\s+", " "))).alias("query")).where("query <> ''").distinct()


def widened(hits: DataFrame, k: int) -> DataFrame:
    """What is left of a list fetched wider than k: its first k, in the same order."""
    return hits.where(F.col("rank") <= k)


def resolved_top_k(step: object, settings: object, payload: object = None) -> int:
    """The step's k, else the settings'; a query may only lower it."""
    from strandwell.operators.filters import coerced_int

    k = coerced_int(step) if step is not None else coerced_int(settings)
    if k is None or k < 1:
        raise ValueError("top_k must be a whole number of at least 1")
    asked = coerced_int(payload)
    return min(k, asked) if asked and asked > 0 else k


def resolved_search_type(payload: str | None, prefix: str | None, step: str | None, pipeline: str | None) -> str:
    """The first that is given and known: bm25, semantic or hybrid."""
    for value in (payload, prefix, step, pipeline):
        v = (value or "").strip().lower()
        if v in ("bm25", "semantic", "hybrid"):
            return v
    raise ValueError("no search_type was given")


def search(
    mode: str, docs: DataFrame, queries: DataFrame, vectors: DataFrame | None, query_vectors: DataFrame | None, k: int, rrf_k: int = RRF_K, widen: int = 2,
    operator: str = "or", keep: Column | None = None, columns: tuple[str, ...] = ("text",), part: str | None = None,
) -> DataFrame:
    """One entry for all modes; hybrid fuses lists of widen*k and takes a single list if the other is empty. Unknown: semantic."""
    if mode == "bm25":
        return bm25(docs, queries, k, operator, keep, columns, part)
    if mode == "hybrid":
        return rrf(vector_search(vectors, query_vectors, k * widen, part=part), bm25(docs, queries, k * widen, operator, keep, columns, part), k, rrf_k)
    return vector_search(vectors, query_vectors, k, part=part)
