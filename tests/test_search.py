"""Registered searches against brute force on small tables."""

import collections
import math
import re

import random
import types

import numpy as np
import pyarrow as pa
import pytest

from strandwell import catalog
from strandwell.operators import keyword, ranking

DOCS = [
    (20, "Ab cd", "ef gh ab", "wiki"),
    (40, None, "one two three four five six seven eight nine ten eleven", "wiki"),
    (60, "internationalization", None, "code"),
    (80, "characteristic intermediate", "representation initialization configuration eleven zz", "code"),
    (1, None, "zz eleven", "wiki"),
    (2, "zz", "ten ab ab", "wiki"),
    (3, None, "configuration zz ef internationalization", "code"),
    (4, None, None, "code"),
    (100, None, "", "wiki"),
]


def words(doc):
    return re.findall("[a-z0-9_]+", " ".join(x for x in doc[1:3] if x is not None).lower())


def ranked(scores, k):
    out = set()
    for q, found in scores.items():
        found = sorted((-round(x, 6), d) for d, x in found.items())
        out |= {(q, d, round(-x, 6), n + 1) for n, (x, d) in enumerate(found[:k])}
    return out


def brute_bm25(k, need_all=False, source=None):
    tf = {d[0]: collections.Counter(words(d)) for d in DOCS if words(d)}
    avg = sum(sum(c.values()) for c in tf.values()) / len(tf)
    df = collections.Counter(t for c in tf.values() for t in c)
    kept = {d[0] for d in DOCS if source in (None, d[3])}
    scores = {}
    for q in (d for d in DOCS if d[0] % 20 == 0):
        terms = set(words(q))
        for d, c in tf.items():
            hit = terms & set(c)
            if d in kept and hit and (hit == terms or not need_all):
                x = sum(math.log(1 + (len(tf) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg)) for t in hit)
                scores.setdefault(q[0], {})[d] = x
    return ranked(scores, k)


def brute_tfidf(k):
    tf = {d[0]: collections.Counter(words(d)) for d in DOCS if words(d)}
    df = collections.Counter(t for c in tf.values() for t in c)
    w = {d: {t: n * (math.log((1 + len(tf)) / (1 + df[t])) + 1) for t, n in c.items()} for d, c in tf.items()}
    norm = {d: math.sqrt(sum(x * x for x in v.values())) for d, v in w.items()}
    scores = {q: {d: sum(w[q][t] * w[d][t] for t in w[q].keys() & w[d].keys()) / norm[q] / norm[d] for d in w if w[q].keys() & w[d].keys()} for q in w if q % 20 == 0}
    return ranked(scores, k)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("search"))
    spark.createDataFrame(DOCS, "doc_id long, title string, text string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d


def rows(spark, folder, name):
    return {(r.query_id, r.doc_id, round(r.score, 6), r.rank) for r in catalog.queries()[name](spark, folder).collect()}


def test_searches_ask_with_whole_documents(spark, folder):
    assert rows(spark, folder, "r01_bm25_or_whole") == brute_bm25(10)
    assert rows(spark, folder, "r01_bm25_and_whole") == brute_bm25(10, need_all=True)
    assert rows(spark, folder, "r01_bm25_filtered_whole") == brute_bm25(10, source="wiki")
    assert rows(spark, folder, "r05_dispatch_bm25_whole") == brute_bm25(5)
    assert rows(spark, folder, "r13_tfidf_whole") == brute_tfidf(10)
    # Hybrids: the keyword hits of each query are in, also where there is no vector.
    for name in ("r03_weighted_whole", "r04_rrf_whole"):
        assert {x[:2] for x in rows(spark, folder, name)} == {x[:2] for x in brute_bm25(20)} | {(20, 20), (20, 1)}


#: Keyword searches of whole documents that shuffle no pairs of query and document.
UNPAIRED = ["r01_bm25_and_whole", "r01_bm25_or_whole", "r01_bm25_filtered_whole", "r03_weighted_whole", "r04_rrf_whole", "r05_dispatch_bm25_whole"]


@pytest.mark.parametrize("name", UNPAIRED)
def test_no_pairs_of_query_and_document_are_shuffled(spark, folder, name):
    plan = catalog.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # What is joined or shuffled are the hits a task keeps, by query; not postings by term or document.
    assert exchanged and not any("term" in line for line in exchanged) and "term#" not in "".join(line for line in plan.splitlines() if "Join" in line)


def scored(docs, queries, k, need_all, monkeypatch, **sizes):
    """Hits of (id, tokens) lists by keyword.Scorer, in this process, with chunks and blocks of the given sizes."""
    for name, value in sizes.items():
        monkeypatch.setattr(keyword, name, value)
    asked = keyword.Asked(pa.table({"query_id": [q for q, _ in queries], "w": [sorted(set(w)) for _, w in queries]}))
    df = np.array([sum(t in w for _, w in docs) for t in asked.vocabulary.to_pylist()])
    avg = sum(len(w) for _, w in docs) / len(docs)
    idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
    shared = types.SimpleNamespace(value=(asked, df, idf, avg))
    batches = pa.table({"doc_id": [d for d, _ in docs], "w": [w for _, w in docs]}).to_batches(max_chunksize=11)
    counted = {t: n for b in keyword._counted(types.SimpleNamespace(value=asked.vocabulary))(iter(batches)) for t, n in zip(*(c.to_pylist() for c in b.columns))}
    assert counted == {-1: len(docs), -2: sum(len(w) for _, w in docs), **{t: n for t, n in enumerate(df.tolist()) if n}}
    found = {}
    for b in keyword._scored(shared, k, need_all, 1.2, 0.75)(iter(batches)):
        for q, d, x in zip(*(c.to_pylist() for c in b.columns)):
            found.setdefault(q, {})[d] = x
    return ranked(found, k)


@pytest.mark.parametrize("dense", [0.0, 0.05, 2.0])
@pytest.mark.parametrize("need_all", [False, True])
def test_scores_of_blocks_equal_brute_force(monkeypatch, dense, need_all):
    rng = random.Random(3)
    words = [f"w{n}" for n in range(60)]
    docs = [(f"d{n:03}", rng.choices(words, [1 / (n + 1) for n in range(60)], k=rng.randint(1, 30))) for n in range(90)]
    docs += [(f"c{n:03}", docs[n % 7][1]) for n in range(40)]  # equal scores, beyond k
    queries = [(d, list(dict.fromkeys(w))[: 3 if need_all else 99]) for d, w in docs[::4]] + [("none", ["unheard"]), ("half", ["unheard", "w0"])]
    expected = {}
    df = {t: sum(t in w for _, w in docs) for _, q in queries for t in q}
    avg = sum(len(w) for _, w in docs) / len(docs)
    for q, terms in queries:
        for d, w in docs:
            hit = set(terms) & set(w)
            if hit and (len(hit) == len(set(terms)) or not need_all):
                expected.setdefault(q, {})[d] = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / avg)) for t in sorted(hit))
    assert scored(docs, queries, 5, need_all, monkeypatch, DENSE=dense, CHUNK_DOCS=16, QUERY_BLOCK=5, SLICE=50) == ranked(expected, 5)


def test_queries_in_rounds_and_rows_of_one_query(spark, folder, monkeypatch):
    docs = spark.createDataFrame([(1, "red green"), (2, None), (3, ""), (4, "red red blue"), (None, "red")], "doc_id long, text string")
    asks = spark.createDataFrame([("q", "red"), ("q", "RED green"), ("n", None), ("e", ""), ("b", "blue"), ("u", "unheard")], "query_id string, query string")
    once = sorted(ranking.bm25(docs, asks, 5).collect())
    assert {(r.query_id, r.doc_id) for r in once} == {("q", 1), ("q", 4), ("b", 4)}
    monkeypatch.setattr(keyword, "QUERY_BYTES", 4)
    assert sorted(ranking.bm25(docs, asks, 5).collect()) == once
    assert ranking.bm25(docs.where("false"), asks, 5).count() == 0 and ranking.bm25(docs, asks.where("false"), 5).count() == 0
