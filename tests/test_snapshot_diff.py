from strandwell.operators.snapshot_diff import snapshot_changes, snapshot_chain

NODE = "canonical_id string, text string, digest string, snapshot_id string, repo string"
RUN = "import_id string, repo string, branch string, snapshot_id string, status string, finished_utc string, text string"


def run(s, status="completed", at="2024-01-01T00:00:00Z", repo="r", branch="main"):
    return ("i", repo, branch, s, status, at, "clash")


def changes(spark, nodes, runs):
    n = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in nodes], NODE)
    return sorted(tuple(r) for r in snapshot_changes(n, spark.createDataFrame(runs, RUN)).collect())


def test_added_removed_changed_and_line_ends(spark):
    nodes = [("r::s1::cs::a", "x \r\ny\n\n"), ("r::s1::cs::b", "1"), ("r::s1::cs::c::d", "1"), ("r::s1::cs::n", None), ("r::s2::cs::a", "x\ny"), ("r::s2::cs::a", "x\ny"), ("r::s2::cs::c::d", "2"), ("r::s2::cs::e", ""), ("r::s2::cs::n", "")]
    runs = [run("s2", at="2024-01-02T00:30:00+02:00"), run("s1", at="2024-01-01T20:00:00Z"), run("s1", at="2025-01-01T00:00:00Z"), run("s0", "failed")]
    assert changes(spark, nodes, runs) == [("s2", "cs::b", "removed"), ("s2", "cs::c::d", "changed"), ("s2", "cs::e", "added")]


def test_refused_ids_partial_snapshots_and_empty_tables(spark):
    nodes = [(None, "a"), ("", "a"), ("r::s1::x", "a"), ("r::s9::cs::a", "a"), ("r::s1::cs::a", "a"), ("r::s2::cs::a", "a")]
    assert changes(spark, nodes, [run("s1"), run("s2", at="2024-02-01 00:00:00"), run("s9", "running", "")]) == []
    assert changes(spark, [], [run("s1")]) == []
    assert changes(spark, nodes, []) == []


def test_chain_is_per_branch_with_ties_by_id(spark):
    runs = spark.createDataFrame([run("b"), run("a"), run("c", branch="dev"), run("d", branch="dev", at="2024-03-01T00:00:00.000+00:00")], RUN)
    assert sorted(tuple(r) for r in snapshot_chain(runs).collect()) == [("a", "b"), ("c", "d")]


def test_long_blank_runs_end(spark):
    assert changes(spark, [("r::s1::cs::a", "x" + " " * 200000 + "y"), ("r::s2::cs::a", "x" + " " * 200000 + "y  \n")], [run("s1"), run("s2", at="2024-02-01T00:00:00Z")]) == []
