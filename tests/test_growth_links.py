"""What keeps joins on heavy keys and linked items in proportion to their input."""

from pyspark.sql import functions as F

from evidgrid.operators.graph import connected_components, star_edges
from evidgrid.operators.skew import join_back


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_join_back_does_not_shuffle_facts_for_hot_keys(spark):
    facts = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    lookup = facts.groupBy("k").agg(F.count("*").alias("rows"), F.max("id").alias("m"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_back(facts, lookup, "k", "rows", F.col("id"), hot_rows=100)
        assert "BroadcastHashJoin" in plan(joined)
        assert {(r.k, r.m) for r in joined.collect()} == {(0, 999), (1, 997), (2, 998)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_star_edges_of_two_rows_do_not_go_back(spark):
    rows = [("a", 1), ("a", 2), ("b", 2), ("b", 2), ("c", 3), ("d", 4), ("d", 5), ("d", 6), (None, 7), (None, 8)]
    edges = star_edges(spark.createDataFrame(rows, "k string, n long"), "k", "n")
    assert "Union" in plan(edges)
    found = {(r.a, r.b) for r in edges.collect()}
    assert found == {(1, 2), (4, 5), (4, 6)}
    assert {(r.node, r.component) for r in connected_components(edges).collect()} == {
        (1, 1), (2, 1), (4, 4), (5, 4), (6, 4)
    }
