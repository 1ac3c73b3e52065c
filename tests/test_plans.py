"""Whole compositions on small inputs, and stability of a finished edit."""

from pyspark.sql import functions as F

from evidgrid.operators import clusters as cl
from evidgrid.operators import segment as sg
from evidgrid.plans.inspection import inspect, verify


def test_inspection(spark):
    columns = "source_kind string, authority int, t string, session_id string, scope string, text string, locator string, file string, size long, outcome string"
    rows = [
        ("history", 3, "2026-08-18", "n", "global", "New rule: commit, merge, push, and deploy completed work by default.", "f:1", "f", 70, "candidate"),
        ("history", 3, "2026-08-17", "n", "global", "New rule: commit, merge, push, and deploy completed work by default.", "f:2", "f", 70, "candidate"),
        ("history", 3, "2026-08-17", "n", "global", "password = abcdefghijk", "f:3", "f", 30, "candidate"),
        ("history", 3, "2026-08-17", "n", "global", None, "f:4", "f", 30, "malformed"),
    ]
    raw = spark.createDataFrame(rows, columns).withColumn("ts", F.to_timestamp("t")).drop("t")
    docs = spark.createDataFrame([("d", "# Git\n\n- Commit only when asked.\n- Same text.\n- Same text.\n")], "doc string, content string")
    found = inspect(raw, sg.segment(docs), F.lit("2026-09-01").cast("timestamp"))
    assert found.selected.count() == 1
    assert [r.n_shared for r in found.overlaps.collect()] == [1]
    assert [(r.reason, r.members) for r in found.clusters.collect()] == [("exact_duplicate", 2)]
    stats = found.stats.first()
    assert (stats.records_seen, stats.records_emitted, stats.sensitive_records_excluded, stats.malformed_records) == (4, 2, 1, 1)
    assert stats.degraded == ["malformed_ratio_exceeded"]


def test_verify(spark):
    cases = spark.createDataFrame(
        [("c", ["test", "ship"], ["test"], [], ["test", "ship"], True)],
        "case_id string, allowed array<string>, required array<string>, forbidden array<string>, ordered array<string>, control_must_underperform boolean",
    )
    rows = [("pre", "c", ["run checks then ship it"]), ("post", "c", ["run checks", "ship it"]), ("control", "c", ["ship it"])]
    results = spark.createDataFrame(rows, "condition string, case_id string, steps array<string>")
    row = verify(results, cases, {"test": ["run checks"], "ship": ["ship it"]}, 1).first()
    assert (row.pre, row.post, row.control, row.reasons) == (1, 1, 0, [])


def test_a_repaired_document_is_a_fixed_point(spark):
    docs = spark.createDataFrame([("d", "# R\n\n- Same.\n- Other.\n- Same.\n")], "doc string, content string")
    for expected in (1, 0, 0):
        blocks = sg.segment(docs)
        summaries, members = cl.exact_duplicates(blocks)
        assert summaries.count() == expected
        later = members.join(summaries.select("cluster_id", "first_block"), "cluster_id").where("block_id <> first_block")
        edits = later.join(blocks.select("block_id", "doc", "end"), "block_id").select("doc", "start", "end", F.lit("").alias("text"))
        docs = spark.createDataFrame([tuple(r) for r in sg.splice(docs, edits).collect()], "doc string, content string")
    assert docs.first().content == "# R\n\n- Same.\n- Other.\n"
