"""Stateful streams against the batch operators, with rows that arrive out of order."""

import random

import pytest

from evidgrid.lexicon import RUN_TRANSITIONS, Lexicon
from evidgrid.operators import evidence as ev
from evidgrid.operators import ingest as ing
from evidgrid.operators import runs as rn
from evidgrid.functions.text import fingerprint_tokens
from evidgrid.streaming import stateful as sf


def arriving(spark, folder, schema, batches):
    """A stream whose batches are the given lists of rows."""
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{number}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def landed(rows, folder, idle=True):
    return sf.land(rows, f"{folder}/out", f"{folder}/log", idle)


EVENT = "session_id string, content_sha256 string, ts timestamp, event_id string"


def event(session, sha, day, number):
    import datetime

    return session, sha, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day), f"e{number}"


def test_late_newer_row_replaces_the_old_one_across_days(spark, tmp_path):
    batches = [
        [event("s", "x", 1, 1), event("s", "y", 1, 2), event(None, "x", 5, 3)],
        [event("s", "x", 40, 4), event("s", "y", 0, 5), event("t", "x", 2, 6)],
        [event("s", "x", 40, 0), event(None, "x", 3, 7), event("s", "y", 9, 8)],
    ]
    stream = arriving(spark, str(tmp_path), EVENT, batches)
    changes = landed(sf.latest_rows(stream), str(tmp_path)).collect()
    assert sum(r.content_sha256 == "x" and r.session_key == "s" for r in changes) == 3
    final = sf.newest_of(spark.createDataFrame(changes)).collect()
    whole = spark.createDataFrame([row for rows in batches for row in rows], EVENT)
    batch = ing.dedup_latest(whole).collect()
    want = {(r.session_id or "", r.content_sha256, r.ts, r.event_id) for r in batch}
    assert {tuple(r) for r in final} == want and len(final) == len(want) == 4


def test_shuffled_events_give_the_batch_result(spark, tmp_path):
    draw = random.Random(7)
    rows = [
        event(draw.choice(["a", "b", None]), draw.choice("pqrs"), draw.randint(0, 60), i)
        for i in range(200)
    ]
    draw.shuffle(rows)
    stream = arriving(spark, str(tmp_path), EVENT, [rows[:70], rows[70:130], rows[130:]])
    final = sf.newest_of(landed(sf.latest_rows(stream, keep=3600), str(tmp_path), idle=False))
    batch = ing.dedup_latest(spark.createDataFrame(rows, EVENT))
    assert {tuple(r) for r in final.select("content_sha256", "ts", "event_id").collect()} == {
        tuple(r) for r in batch.select("content_sha256", "ts", "event_id").collect()
    }


LOG = "run_id string, ts timestamp, event_id bigint, state string"


def entries(steps):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    return [
        (run, start + datetime.timedelta(minutes=minute), number, state)
        for number, (run, minute, state) in enumerate(steps)
    ]


def shuffled_log(seed):
    draw = random.Random(seed)
    names = sorted({state for pair in RUN_TRANSITIONS for state in pair})
    steps = [(f"run{i % 5}", draw.randint(0, 50), draw.choice(names)) for i in range(90)]
    rows = entries(steps)
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_arrival_gives_the_batch_transitions(spark, tmp_path, seed):
    rows = shuffled_log(seed)
    closing = [("", entries([("", 10_000, "")])[0][1], -1, "")]
    stream = arriving(spark, str(tmp_path), LOG, [rows[:30], rows[30:60], rows[60:], closing])
    steps = landed(sf.run_steps(stream, delay="60 minutes"), str(tmp_path)).where("run_id <> ''")
    legal = spark.createDataFrame(list(RUN_TRANSITIONS), "from_state string, to_state string")
    batch = rn.illegal_transitions(spark.createDataFrame(rows, LOG), legal)
    pick = ["run_id", "event_id", "from_state", "state"]
    got = {tuple(r) for r in steps.where("NOT legal").select(*pick).collect()}
    assert got == {tuple(r) for r in batch.select(*pick).collect()}
    assert steps.count() == len(rows)


def test_entries_wait_for_the_watermark_and_finished_runs_are_forgotten(spark, tmp_path):
    batches = [
        entries([("a", 10, "applying"), ("a", 0, "planned")]),
        entries([("a", 20, "applied")]),
        entries([("z", 200, "planned")]),
        entries([("a", 190, "planned")]),  # starts anew
        entries([("z", 900, "applying"), ("a", 15, "restored")]),  # the last one is too late
    ]
    stream = arriving(spark, str(tmp_path), LOG, batches)
    steps = sf.run_steps(stream, delay="30 minutes", finished=["applied"], keep=60 * 60)
    got = landed(steps, str(tmp_path)).orderBy("run_id", "ts").select("run_id", "from_state", "state", "legal")
    assert [tuple(r) for r in got.collect()] == [
        ("a", None, "planned", True),
        ("a", "planned", "applying", True),
        ("a", "applying", "applied", True),
        ("a", None, "planned", True),
        ("z", None, "planned", True),
    ]


def test_corroboration_without_a_window_equals_the_batch(spark, tmp_path):
    lexicon = Lexicon(stop=["the"], anchors=["north", "south", "east", "west", "river"])
    draw = random.Random(3)
    words = ["north", "south", "east", "west", "river", "walk", "rest"]
    rows = [
        (f"e{i}", draw.choice(["s1", "s2", "s3", "s4", None]), " ".join(draw.sample(words, draw.randint(0, 6))))
        for i in range(150)
    ]
    schema = "event_id string, session_id string, text string"
    stream = arriving(spark, str(tmp_path), schema, [rows[:50], rows[50:51], rows[51:]])
    totals = sf.witness_totals(landed(sf.session_counts(stream, lexicon, parts=3), str(tmp_path)))
    counts = {(r.kind, r.key): r.witnesses for r in totals.collect()}
    keyed = spark.createDataFrame(rows, schema).select(
        "event_id", "session_id", *ev.corroboration_keys(fingerprint_tokens("text", lexicon), lexicon)
    )
    batch = {r.event_id: r.corroboration for r in ev.corroborate(keyed, lexicon).collect()}
    from itertools import combinations

    for row in keyed.collect():
        found = [1, counts.get(("fingerprint", row.fingerprint_key), 0)]
        for three in combinations((row.anchor_set or "").split(), 3):
            found.append(counts[("anchors", " ".join(three))])
        assert max(found) == batch[row.event_id]
    assert max(batch.values()) == 5


def test_empty_streams(spark, tmp_path):
    none = spark.createDataFrame([], EVENT)
    none.write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in/*")
    assert sf.newest_of(landed(sf.latest_rows(stream), str(tmp_path))).count() == 0
