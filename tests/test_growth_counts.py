"""Rows that are counted before they are joined, and texts that leave the JVM in small groups."""

from evidgrid.operators import segment as sg
from evidgrid.operators.ingest import compose_unicode
from evidgrid.queries import QUERIES


def test_counted_signatures_give_the_same_parts(spark):
    rows = [(1, 1, "a", 2), (1, 1, "b", 1), (1, 2, "a", 2), (1, 3, "a", 3), (2, 4, "c", 1), (2, 5, "d", 1)]
    counted = spark.createDataFrame(rows, "group int, part int, signature string, n long")
    primaries = spark.createDataFrame([(1, 1), (2, 4)], "group int, part int")
    found = {(r.part, r.represented) for r in sg.represented_parts(counted, primaries).collect()}
    assert found == {(2, True), (3, False), (5, False)}
    single = counted.selectExpr("group", "part", "signature", "explode(sequence(1, n)) AS i").drop("i")
    assert {(r.part, r.represented) for r in sg.represented_parts(single, primaries).collect()} == found


def test_lines_are_read_once(spark):
    frame = QUERIES["multiset_containment"](spark, "/root/testdata/sf0.001")
    assert "l_returnflag" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_composition_takes_few_rows_at_a_time(spark):
    rows = spark.createDataFrame([("é",), ("plain",), (None,)], "t string")
    composed = compose_unicode(rows, "t")
    assert [r.t for r in composed.collect()] == ["é", "plain", None]
    assert "BatchEvalPython" in composed._jdf.queryExecution().executedPlan().toString()
