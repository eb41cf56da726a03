from strandwell.llm.sampling import hash_sample


def test_samples_are_about_as_large_as_asked_and_do_not_depend_on_partitions(spark):
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN 'few' WHEN id % 10 < 9 THEN 'many' END AS lang")
    a, b = ({r.id for r in hash_sample(rows.repartition(n), "id", 200).collect()} for n in (2, 7))
    assert a == b and 140 < len(a) < 260
    by = {r.lang: r["count"] for r in hash_sample(rows, "id", 100, "lang").groupBy("lang").count().collect()}
    assert set(by) == {"few", "many", None} and all(60 < n < 145 for n in by.values())
    assert hash_sample(rows.where("id < 50"), "id", 100).count() == 50  # all where there are fewer
    assert hash_sample(rows.where("false"), "id", 100).count() == 0 and hash_sample(rows.where("false"), "id", 100, "lang").count() == 0
