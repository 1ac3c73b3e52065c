"""Entries of runs travel and wait in packs; witnesses are told apart without Python."""

import pyarrow as pa
import pytest

from evidgrid.operators import runs as rn
from evidgrid.lexicon import RUN_TRANSITIONS, Lexicon
from evidgrid.streaming import stateful as sf
from test_stateful import LOG, arriving, entries, landed, shuffled_log


def test_one_row_for_many_entries():
    pack_parts, unpack_steps, packs_of, rows_of = sf.packing()
    rows = [(i % 3, f"run{i % 7}", i, i, "planned") for i in range(500)]
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["part", "run_id", "at", "event_id", "state"]
    )
    packed = [row for found in pack_parts([batch, batch.slice(0, 0)]) for row in found.to_pylist()]
    assert sorted((row["part"], row["at"]) for row in packed) == [(0, 498), (1, 499), (2, 497)]
    assert sorted(x for row in packed for x in rows_of(row["pack"])) == sorted(row[1:] for row in rows)
    assert list(pack_parts([])) == []


@pytest.mark.parametrize("parts", [1, 3])
def test_runs_of_one_part_do_not_mix(spark, tmp_path, parts):
    rows = shuffled_log(5)
    closing = [("", entries([("", 10_000, "")])[0][1], -1, "")]
    stream = arriving(spark, str(tmp_path), LOG, [rows[:40], rows[40:], closing])
    steps = landed(sf.run_steps(stream, delay="60 minutes", parts=parts), str(tmp_path)).where("run_id <> ''")
    legal = spark.createDataFrame(list(RUN_TRANSITIONS), "from_state string, to_state string")
    batch = rn.illegal_transitions(spark.createDataFrame(rows, LOG), legal)
    pick = ["run_id", "event_id", "from_state", "state"]
    assert {tuple(r) for r in steps.where("NOT legal").select(*pick).collect()} == {
        tuple(r) for r in batch.select(*pick).collect()
    }
    assert steps.count() == len(rows)


def test_late_entries_of_one_part(spark, tmp_path):
    batches = [
        entries([("a", 10, "applying"), ("a", 0, "planned")]),
        entries([("a", 20, "applied")]),
        entries([("z", 200, "planned")]),
        entries([("a", 190, "planned")]),
        entries([("z", 900, "applying"), ("a", 15, "restored")]),
    ]
    stream = arriving(spark, str(tmp_path), LOG, batches)
    steps = sf.run_steps(stream, delay="30 minutes", finished=["applied"], keep=60 * 60, parts=1)
    got = landed(steps, str(tmp_path)).orderBy("run_id", "ts").select("run_id", "from_state", "state", "legal")
    assert [tuple(r) for r in got.collect()] == [
        ("a", None, "planned", True),
        ("a", "planned", "applying", True),
        ("a", "applying", "applied", True),
        ("a", None, "planned", True),
        ("z", None, "planned", True),
    ]


def test_copies_share_keys_of_the_stream(spark, tmp_path):
    from test_stateful import EVENT, event

    rows = [event("s", f"x{i}", i % 5, i) for i in range(60)]
    stream = arriving(spark, str(tmp_path), EVENT, [rows, rows])
    changes = sf.latest_rows(stream)
    assert "part" in changes._jdf.queryExecution().analyzed().toString()
    assert landed(changes, str(tmp_path)).count() == 60


CORROBORATED = "session_id string, text string"


def test_witnesses_cost_no_python_call_per_key(spark, tmp_path):
    batches = [
        [("s", "alpha beta"), ("s", "alpha beta"), (None, "alpha beta"), ("s", None), ("s", "")],
        [("s", "alpha beta"), ("t", "alpha beta"), ("", "alpha beta"), ("t", "gamma")],
    ]
    changes = sf.session_counts(arriving(spark, str(tmp_path), CORROBORATED, batches), parts=3)
    assert "TransformWithState" not in changes._jdf.queryExecution().analyzed().toString()
    rows = landed(changes, str(tmp_path)).collect()
    # A row for every further session of a key, once over all batches.
    assert sorted(r.session for r in rows) == ["", "s", "t", "t"]
    totals = sf.witness_totals(spark.createDataFrame(rows))
    assert sorted(r.witnesses for r in totals.collect()) == [1, 3]


def test_equal_anchors_of_a_session_are_expanded_once(spark, tmp_path):
    lexicon = Lexicon(stop=[], anchors=["north", "south", "east", "west"])
    rows = [("s", f"north word{i} south east west") for i in range(60)]
    changes = sf.session_counts(arriving(spark, str(tmp_path), CORROBORATED, [rows]), lexicon)
    started = (
        changes.writeStream.format("parquet").option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    )
    started.awaitTermination()
    states = [p.stateOperators[0] for p in started.recentProgress if p.numInputRows]
    assert [(s.operatorName, s.numRowsUpdated) for s in states] == [("dedupe", 60 + 4)]
    # The state gets every pair of key and session once, not once for every fingerprint.
    assert sum(int(s.customMetrics["numDroppedDuplicateRows"]) for s in states) == 0
