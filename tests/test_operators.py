import datetime

import pytest
from pyspark.sql import functions as F

from strandwell.operators import context, filters, graph, history, ranking, security, snapshots
from strandwell.records import instant

NODE = "canonical_id string, acl_allow array<string>, classification_labels array<string>, doc_level int"


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([("a", None, None, None), ("b", ["hr"], ["public"], 5), ("c", ["finance"], ["secret"], 20), ("d", [], ["odd"], 0)], NODE)


def ids(df):
    return sorted(r[0] for r in df.select("canonical_id").collect())


def test_null_acl_is_public_and_more_tags_show_more(nodes):
    assert ids(nodes.where(filters.acl_any(["hr"]))) == ["a", "b"]
    assert ids(nodes.where(filters.acl_any(["hr", "finance"]))) == ["a", "b", "c"]
    assert ids(nodes.where(filters.acl_any([]))) == ["a", "b", "c", "d"]


def test_labels_and_levels(nodes):
    assert ids(nodes.where(filters.labels_subset(["public"]))) == ["a", "b"]
    assert ids(nodes.where(filters.labels_any(["public"], allow_unlabeled=False))) == ["b"]
    assert ids(nodes.where(filters.labels_within_universe(["public"], ["public", "secret"]))) == ["a", "b"]
    assert ids(nodes.where(filters.clearance(5))) == ["a", "b", "d"]
    assert ids(nodes.where(filters.clearance(None))) == ["a", "b", "c", "d"]


def test_scope_rules():
    with pytest.raises(ValueError):
        filters.in_snapshot(" ")
    with pytest.raises(ValueError):
        filters.id_in([])
    with pytest.raises(ValueError):
        filters.checked_overrides({"nope": 1})
    assert filters.normalized({"data_type": "db_code", "x": []}) == {"data_type": "sql_code"}
    assert filters.merged({"repo": "a"}, {"repo": "b"}) == {"repo": "b"}
    assert ranking.resolved_top_k(None, 5, 3) == 3 and ranking.resolved_top_k(4, 5, 9) == 4


def test_rrf_is_symmetric_in_scores(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, doc_id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "query_id string, doc_id string, rank int")
    one = {r.doc_id: r.score for r in ranking.rrf(a, b, 5).collect()}
    assert one == {r.doc_id: r.score for r in ranking.rrf(b, a, 5).collect()}
    assert max(one, key=one.get) == "y"


def test_bm25_and_vector_on_nulls(spark):
    docs = spark.createDataFrame([(1, "red green"), (2, None), (3, ""), (4, "red red")], "doc_id long, text string")
    q = spark.createDataFrame([("q", "RED green"), ("n", None)], "query_id string, query string")
    assert [r.doc_id for r in ranking.bm25(docs, q, 5).orderBy("rank").collect()] == [1, 4]
    assert [r.doc_id for r in ranking.bm25(docs, q, 5, "and").collect()] == [1]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "doc_id long, vector array<double>")
    found = ranking.vector_search(v, v.selectExpr("doc_id AS query_id", "vector").where("query_id = 1"), 2, exclude_self=True).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in found] == [(2, 0.0), (3, 0.0)]


def test_expansion_keeps_order_caps_and_seeds(spark):
    edges = graph.clean_edges(spark.createDataFrame([("a", "b", "cs_dep"), ("b", "c", "CS_DEP"), ("a", "b", "cs_dep"), ("c", "a", None), ("c", "d", " "), ("", "x", "y"), (None, "x", "y")], "from_canonical_id string, to_canonical_id string, edge_type string"))
    n, e = graph.expand(edges, ["a"], 2)
    assert [(r.node, r.depth, r.parent) for r in n.orderBy("place").collect()] == [("a", 0, None), ("b", 1, "a"), ("c", 2, "b")]
    assert e.count() == 2
    assert graph.expand(edges, ["a", "b", "c"], 2, 2)[0].count() == 3
    assert graph.expand(edges, ["c"], 1, 9, ["dep"])[0].count() == 1
    assert graph.expand(edges, [], 2)[0].count() == 0
    hidden = spark.createDataFrame([("a",), ("c",)], "canonical_id string")
    assert graph.travel(edges, spark.createDataFrame([("a",)], "seed string"), hidden).count() == 1


def test_expansion_of_a_hub_counts_targets_not_edges(spark):
    rows = [("hub", f"t{n:03}", kind) for n in range(300) for kind in ("a", "b", "c")]
    n, e = graph.expand(spark.createDataFrame(rows, "src string, dst string, edge_type string"), ["hub"], 1, 200)
    assert [r.node for r in n.orderBy("place").collect()] == ["hub"] + [f"t{n:03}" for n in range(199)]
    assert e.where("dst < 't199'").count() == 199 * 3


def test_budget_skips_what_is_too_large(spark):
    items = spark.createDataFrame([("r", n, s) for n, s in enumerate([3, 5, 2, 4, 1])], "request string, place int, size int")
    assert [r.size for r in context.greedy_fit(items, "request", "place", "size", 8).orderBy("place").collect()] == [3, 5]
    assert [r.size for r in context.greedy_fit(items, "request", "place", "size", 6).orderBy("place").collect()] == [3, 2, 1]
    with pytest.raises(ValueError):
        context.budget_contract(100, 50, 20, 20, 20)
    assert context.budget_contract(300, 50, 60, 90, 60, 100, "auto_clamp")["context"] == 30
    assert context.transactional_append(["a"], ["bb"], 2, len) == (["a"], "over")


def test_paging_passes_ties(spark):
    rows = spark.createDataFrame([(str(n), 1 if n < 5 else 2) for n in range(8)], "id string, at int")
    seen, after = [], None
    while got := history.page(rows, "at", "id", 3, after).collect():
        seen += [r.id for r in got]
        after = (got[-1].at, got[-1].id)
    assert sorted(seen) == [str(n) for n in range(8)] and len(seen) == 8


def test_policies_and_claims(spark):
    rows = spark.createDataFrame([("u", 2, ["b", "a"], None, 3, " "), ("u", 1, ["a"], ["x"], None, None), ("u", 3, None, ["y", "x"], 1, "o")], "user_id string, position int, acl array<string>, labels array<string>, level int, owner string")
    r = security.merged_policies(rows).first()
    assert (r.acl, r.labels, r.level, r.owner) == (["a", "b"], ["x", "y"], 3, "o")
    j = spark.createDataFrame([('{"a":{"x":{"r":[1]},"y":{"r":"z"}}}',)], "j string")
    assert sorted(j.select(security.claim_values("j", "a.*.r").alias("v")).first().v) == ["[1]", "z"]


def test_sets(spark):
    sets = spark.createDataFrame([("s", ["a", "b"]), ("t", ["a"]), ("n", None), ("e", [])], "snapshot_set_id string, allowed_snapshot_ids array<string>")
    assert sorted(r[0] for r in snapshots.without_snapshot(sets, ["a"]).collect()) == ["e", "n", "s"]


def test_instants(spark):
    forms = ["2025-01-06T17:08:58Z", "2025-01-06T19:08:58+02:00", "2025-01-06 17:08:58", "1736183338000", "Mon, 06 Jan 2025 17:08:58 GMT", "2025-01-06T17:08:58.000+00:00", " 2025-01-06T12:08:58-05:00\t"]
    bad = ["", " ", "NaN", "not set", None, "2025-02-30T25:61:00Z", "12"]
    df = spark.createDataFrame([(x,) for x in forms + bad], "t string").select(F.unix_seconds(instant("t")).alias("s"))
    got = [r.s for r in df.collect()]
    assert got[: len(forms)] == [int(datetime.datetime(2025, 1, 6, 17, 8, 58, tzinfo=datetime.timezone.utc).timestamp())] * len(forms)
    assert got[len(forms) :] == [None] * len(bad)
