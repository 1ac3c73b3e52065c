"""What is looked at in a text, and what is not."""

from pyspark.sql import functions as F

from evidgrid import lexicon as lx
from evidgrid.functions import text as tx
from evidgrid.functions.exprs import led

TRICKY = [
    "ARCHIVE, commit; deleted Deploy_1 revtest rev. teſt ſtop DO NOT ſolely", "cafétest testé é test",
    "never\nmust not only", "either this, or that; vs. versus rather than", "", "with und desWith", "Keep theſe",
]


def test_led_patterns_match_the_same(spark):
    rows = spark.createDataFrame([(t,) for t in TRICKY], "t string")
    names = [n for n in dir(lx) if n.endswith("_PATTERN") and n != "CONSEQUENTIAL_PATTERN"]
    for name in names:
        pattern = getattr(lx, name)
        if r"\b" not in pattern:
            continue
        assert "(?=" in led(pattern), name
        both = rows.select(
            F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("a"),
            F.regexp_extract_all("t", F.lit(led(pattern)), F.lit(0)).alias("b"),
        )
        assert both.where("NOT a <=> b").count() == 0, name
    for pattern in ("x?y|z", "[ab]|c", "a|", r"\Qa|b\E", "(a|b)c"):
        assert led(pattern) == pattern


def test_fingerprint_reads_on_only_where_the_head_has_too_few(spark):
    wanted = lx.DEFAULT_LEXICON.fingerprint_tokens
    full = " ".join(f"word{i}" for i in range(400))
    late = "." * 2000 + full
    cut = "." * (tx.HEAD_CHARS - 3) + "cutting " + full
    long = "x" * 3000 + " tail"
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([full, late, cut, long, "", None])], "i int, t string")
    got = {r.i: r.f for r in rows.select("i", tx.fingerprint_tokens("t").alias("f")).collect()}
    words = [f"word{i}" for i in range(400)]
    assert got[0] == words[:wanted] and got[1] == words[:wanted]
    assert got[2] == ["cutting", *words[: wanted - 1]]
    assert got[3] == ["x" * 3000, "tail"] and got[4] == [] and got[5] is None
    shown = rows.select(tx.fingerprint_tokens("t").alias("f"))._jdf.queryExecution().toString()
    assert f"left(t#" in shown


def test_terms_are_looked_at_once(spark):
    rows = spark.createDataFrame([("The Rule the rule RULE uses Uses",)], "t string")
    for profile in ("decision", "blocks"):
        frame = rows.select(tx.subject_terms("t", profile).alias("x"))
        assert "array_distinct(regexp_extract_all" in frame._jdf.queryExecution().analyzed().toString()
        assert len(frame.first().x) == len(set(frame.first().x))
