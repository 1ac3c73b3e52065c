"""Streams give what the batch operators give on the same rows."""

import json
import os

from pyspark.sql import functions as F

from evidgrid.operators import ingest as ing
from evidgrid.operators import runs as rn
from evidgrid.sources import adapters as ad
from evidgrid.sources import jsonl as js
from evidgrid.streaming import streams as st


def run_all(query):
    query.awaitTermination(120)
    assert query.exception() is None


def memory(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    run_all(query)
    return df.sparkSession.table(name)


def lines(tmp_path, name, records):
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")
    return str(folder)


def test_ingest_redaction_and_counters_equal_batch(spark, tmp_path):
    path = lines(tmp_path, "a.jsonl", [{"text": f"Rule {i % 3} stays", "ts": 1_700_000_000 + i, "session_id": "s"} for i in range(6)])
    lines(tmp_path, "b.jsonl", [{"text": "password = hunter2hunter2", "ts": 5}, "{bad"])
    stream = st.stream_events(ad.from_history_b(st.stream_jsonl(spark, path, max_files=1)))
    got = memory(stream, "ingested")
    batch = ing.emitted_events(ing.classify(ad.from_history_b(js.scan_jsonl(spark, path))))
    pick = ["event_id", "session_id", "text", "content_sha256"]
    assert sorted(map(tuple, got.select(*pick).collect())) == sorted(map(tuple, batch.select(*pick).collect()))
    classified = ing.classify(ad.from_history_b(st.stream_jsonl(spark, path)))
    query = st.counted(classified, "quality").writeStream.format("noop").trigger(availableNow=True).start()
    run_all(query)
    seen = query.lastProgress["observedMetrics"]["quality"]
    assert (seen["records_seen"], seen["malformed_records"], seen["sensitive_records_excluded"], seen["records_emitted"]) == (8, 1, 1, 6)


def test_dedup_streams(spark, tmp_path):
    path = lines(tmp_path, "a.jsonl", [{"text": f"Rule {i % 2}", "ts": 1_700_000_000 + i, "session_id": "s"} for i in range(6)])
    events = st.stream_events(ad.from_history_b(st.stream_jsonl(spark, path)))
    assert memory(st.drop_copies(events), "copies").count() == 2
    latest = memory(st.latest_copies(events), "latest", "complete")
    batch = ing.dedup_latest(ing.emitted_events(ing.classify(ad.from_history_b(js.scan_jsonl(spark, path)))))
    assert sorted(r.event_id for r in latest.collect()) == sorted(r.event_id for r in batch.collect())


def test_latest_copies_forgets_closed_windows(spark, tmp_path):
    day, start = 86_400, 1_700_006_400  # a midnight
    batches = [
        [(start + 10, "same words"), (start + 20, "same words")],
        [(start + 3 * day, "same words")],
        [(start + 6 * day, "other words")],
        [(start + 30, "same words")],  # too late
        [(start + 9 * day, "last words")],
    ]
    for i, rows in enumerate(batches):
        path = lines(tmp_path, f"{i}.jsonl", [{"text": t, "ts": ts, "session_id": "s"} for ts, t in rows])
        os.utime(f"{path}/{i}.jsonl", (start + i, start + i))
    events = st.stream_events(ad.from_history_b(st.stream_jsonl(spark, path, max_files=1)))
    closed = memory(st.latest_copies(events), "closed")
    assert sorted((r.ts.day, r.copies) for r in closed.collect()) == [(15, 2), (18, 1), (21, 1)]


def test_windowed_corroboration(spark, tmp_path):
    records = [{"text": "verify release notes", "ts": 1_700_000_000 + i, "session_id": f"s{i % 3}"} for i in range(9)]
    records.append({"text": "much later entry", "ts": 1_700_900_000, "session_id": "z"})
    path = lines(tmp_path, "a.jsonl", records)
    lines(tmp_path, "b.jsonl", [{"text": "closing words", "ts": 1_701_900_000, "session_id": "z"}])
    events = st.stream_events(ad.from_history_b(st.stream_jsonl(spark, path, max_files=1)))
    exact = memory(st.windowed_corroboration(events), "exact")
    assert ("verify release notes", 3, 9) in {(r.fingerprint, r.sessions, r.copies) for r in exact.collect()}
    rough = memory(st.windowed_corroboration(events, exact=False), "rough")
    assert ("verify release notes", 3) in {(r.fingerprint, r.sessions) for r in rough.collect()}


def test_state_machine_equals_batch(spark, tmp_path):
    steps = [("a", 1, "planned"), ("a", 2, "applying"), ("a", 3, "applied"), ("a", 4, "planned"), ("b", 1, "applied"), ("b", 2, "rolling_back")]
    path = lines(tmp_path, "1.jsonl", [{"run_id": r, "ts": f"2024-01-01T00:00:0{t}", "state": s} for r, t, s in steps[:2] + steps[4:5]])
    lines(tmp_path, "2.jsonl", [{"run_id": r, "ts": f"2024-01-01T00:00:0{t}", "state": s} for r, t, s in steps[2:4] + steps[5:]])
    schema = "run_id string, ts timestamp, state string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(path)
    got = memory(st.run_state_machine(stream), "machine")
    illegal = sorted((r.run_id, r.from_state, r.state) for r in got.where("not legal").collect())
    from evidgrid.lexicon import RUN_TRANSITIONS

    legal = spark.createDataFrame(list(RUN_TRANSITIONS), "from_state string, to_state string")
    log = spark.read.schema(schema).json(path).withColumn("event_id", F.lit(0))
    batch = rn.illegal_transitions(log, legal)
    assert illegal == sorted((r.run_id, r.from_state, r.state) for r in batch.collect())
    assert illegal == [("a", "applied", "planned"), ("b", None, "applied")]


def test_alerts_and_log_sink(spark, tmp_path):
    path = lines(tmp_path, "a.jsonl", [{"text": "x"}] * 3 + ["{bad"])
    alerts = memory(st.malformed_alerts(st.stream_jsonl(spark, path)), "alerts", "complete")
    assert [(r.records, r.malformed_records) for r in alerts.collect()] == [(4, 1)]
    raw = st.stream_jsonl(spark, path).select("line_no", "malformed", "size")
    run_all(st.append_log_stream(raw, str(tmp_path / "out"), str(tmp_path / "cp")))
    run_all(st.append_log_stream(raw, str(tmp_path / "out"), str(tmp_path / "cp")))
    written = spark.read.text(str(tmp_path / "out")).collect()
    assert len(written) == 4 and list(json.loads(written[0].value)) == ["line_no", "malformed", "size"]
