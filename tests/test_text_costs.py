"""Text functions evaluate their input once and search for plain letters before word boundaries."""

import re

from evidgrid import lexicon as lx
from evidgrid.functions import text as tx
from evidgrid.functions.exprs import NOT_SPACE, led


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_catch_alls_normalize_a_text_once(spark):
    texts = ["x And  Similar, etc. and etcetera", "other applicable action and so on", "Etc", "betc", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    found = rows.select(tx.catch_alls("t").alias("f"))
    assert plan(found).count("lower(") == 1
    assert [r.f for r in found.collect()] == [
        ["and similar", "etc"], ["other applicable action", "and so on"], ["etc"], [], None,
    ]


def test_gates_lower_a_text_once_per_predicate(spark):
    rows = spark.createDataFrame([("order available",), (None,)], "t string").repartition(1)
    gate = rows.select(tx.has_stage_gate("t").alias("g"))
    assert plan(gate).count("lower(") == 2
    assert [r.g for r in gate.collect()] == [False, None]


def test_led_patterns_find_the_same():
    words = "etc. betc etc andsimilar and similaré and similar order border éorder available"
    for pattern in (*lx.CATCH_ALL_PATTERNS, *lx.GATE_WORDS):
        plain, first = (p.replace("(?U)", "") for p in (pattern, led(pattern)))
        assert plain != first
        assert re.findall(plain, words) == re.findall(first, words)
    assert led(r"\betc\b|\bx\b") == r"\betc\b|\bx\b"
    assert led(r"\bs?he\b") == r"\bs?he\b"


def test_single_blanks_are_left_alone(spark):
    points = spark.range(1, 0x110000).where("id NOT BETWEEN 55296 AND 57343 AND id <> 65279")
    one = points.selectExpr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c")
    joined = one.selectExpr("c", "concat('a', c, c, 'b ', c, 'c') AS t")
    folded = joined.select("c", tx.collapse_spaces("t").alias("f"))
    assert "{2,}" in plan(folded)
    assert folded.where((folded.f == "a b c") == folded.c.rlike(NOT_SPACE)).count() == 0
