"""Streams of evidence: the same column expressions as in batch, plus state where it is needed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidgrid import lexicon as lx
from evidgrid.functions.text import fingerprint
from evidgrid.lexicon import DEFAULT_LEXICON, Lexicon
from evidgrid.operators.ingest import classify, emitted_events
from evidgrid.sources.jsonl import parse_lines


def stream_jsonl(
    spark: SparkSession,
    path: str,
    max_line_bytes: int = lx.MAX_LINE_BYTES,
    max_files: int | None = None,
) -> DataFrame:
    """Lines of arriving JSONL files with quality columns.

    A file may be read in several splits, so the hash of a line stands in for its number.
    """
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("mtime"),
        F.xxhash64("value").alias("line_no"),
    )
    return parse_lines(lines, max_line_bytes).select(
        "file", "line_no", "mtime", "size", "rec", "malformed"
    )


def stream_events(
    raw: DataFrame, max_chars: int | None = lx.MAX_EXCERPT_CHARS, classified: bool = False
) -> DataFrame:
    """Redacted events of a stream of adapter rows; secret-bearing records never get through.

    ``classified``: the rows have been through ``classify`` before.
    """
    return emitted_events(raw if classified else classify(raw, max_chars=max_chars))


def counted(raw: DataFrame, name: str) -> DataFrame:
    """Attach per-batch quality counters, readable from the query progress under ``name``."""
    outcome = F.col("outcome")
    return raw.observe(
        name,
        F.count(F.lit(1)).alias("records_seen"),
        F.count_if(outcome == "malformed").alias("malformed_records"),
        F.count_if(outcome == "unknown").alias("unknown_records"),
        F.count_if(outcome == "sensitive").alias("sensitive_records_excluded"),
        F.count_if(outcome == "emitted").alias("records_emitted"),
    )


QUALITY = (
    "records_seen",
    "malformed_records",
    "unknown_records",
    "sensitive_records_excluded",
    "records_emitted",
)
QUALITY_SCHEMA = ", ".join(f"{name} bigint" for name in QUALITY)


def quality_totals(query: StreamingQuery, name: str) -> tuple[int, ...]:
    """The counters of ``counted`` summed over the batches that the query still reports."""
    seen = [p["observedMetrics"][name] for p in query.recentProgress if name in p["observedMetrics"]]
    return tuple(sum(metrics[counter] or 0 for metrics in seen) for counter in QUALITY)


def drop_copies(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Exact copies (session, content) are dropped while they arrive within the delay."""
    keyed = events.withColumn("session_key", F.coalesce("session_id", F.lit("")))
    watched = keyed.withWatermark("ts", delay)
    return watched.dropDuplicatesWithinWatermark(["session_key", "content_sha256"]).drop("session_key")


def latest_copies(events: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Newest row per (session, content) and window of event time, merged by key where it is written.

    A window is forgotten once the watermark has passed its end, so state does not grow for ever;
    the sink keeps the newest of the rows of a key. A heavily copied text is reduced inside every
    task first.
    """
    keyed = events.withColumn("session_key", F.coalesce("session_id", F.lit("")))
    watched = keyed.withWatermark("ts", delay)
    newest = F.max(F.struct("ts", "event_id"))
    grouped = watched.groupBy(F.window("ts", window), "session_key", "content_sha256")
    return grouped.agg(
        newest["ts"].alias("ts"), newest["event_id"].alias("event_id"), F.count("*").alias("copies")
    )


def windowed_corroboration(
    events: DataFrame,
    window: str = "1 day",
    delay: str = "1 hour",
    exact: bool = True,
    lexicon: Lexicon = DEFAULT_LEXICON,
) -> DataFrame:
    """Independent sessions per fingerprint and window.

    The exact form aggregates twice: first to distinct (fingerprint, session), then to counts, so
    a hot fingerprint is spread by its sessions. The approximate form keeps one sketch per
    fingerprint.
    """
    printed = events.withColumn("fingerprint", fingerprint("text", lexicon)).where("fingerprint <> ''")
    watched = printed.withWatermark("ts", delay).withColumn(
        "session_key", F.coalesce("session_id", F.lit(""))
    )
    if not exact:
        return watched.groupBy(F.window("ts", window), "fingerprint").agg(
            F.approx_count_distinct("session_key").alias("sessions")
        )
    distinct = watched.groupBy(F.window("ts", window), "fingerprint", "session_key").agg(
        F.count("*").alias("copies")
    )
    return distinct.groupBy(F.window("window", window), "fingerprint").agg(
        F.count("*").alias("sessions"), F.sum("copies").alias("copies")
    )


def malformed_alerts(
    classified: DataFrame,
    time: Column | str = "mtime",
    window: str = "10 minutes",
    delay: str = "10 minutes",
    max_ratio: float = lx.MAX_MALFORMED_RATIO,
) -> DataFrame:
    """Windows in which strictly more than ``max_ratio`` of the records are malformed."""
    bad = F.col("outcome") == "malformed" if "outcome" in classified.columns else F.col("malformed")
    timed = classified.withColumn("_t", F.col(time) if isinstance(time, str) else time)
    counts = (
        timed.withWatermark("_t", delay)
        .groupBy(F.window("_t", window))
        .agg(F.count("*").alias("records"), F.count_if(bad).alias("malformed_records"))
    )
    ratio = F.col("malformed_records") / F.greatest(F.lit(1), F.col("records"))
    return counts.withColumn("ratio", ratio).where(F.col("ratio") > max_ratio)


TRANSITION_SCHEMA = "run_id string, ts timestamp, from_state string, state string, legal boolean"


def run_state_machine(
    log: DataFrame,
    transitions: list[tuple[str, str]] | None = None,
    initial: str = "planned",
) -> DataFrame:
    """Every log entry with the state before it and whether the step is allowed.

    ``log``: run_id, ts, state. The state kept per run is its last state.
    """
    legal = set(transitions or lx.RUN_TRANSITIONS)

    def step(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "state"], kind="stable")
        before = [last, *rows["state"].iloc[:-1]]
        allowed = [
            (now == initial) if prior is None else (prior, now) in legal
            for prior, now in zip(before, rows["state"])
        ]
        state.update((rows["state"].iloc[-1],))
        yield pd.DataFrame(
            {
                "run_id": key[0],
                "ts": rows["ts"].to_numpy(),
                "from_state": before,
                "state": rows["state"].to_numpy(),
                "legal": allowed,
            }
        )

    return (
        log.select("run_id", "ts", "state")
        .groupBy("run_id")
        .applyInPandasWithState(
            step, TRANSITION_SCHEMA, "last string", "append", GroupStateTimeout.NoTimeout
        )
    )


def append_log_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream as JSON lines with sorted keys, exactly once per checkpoint."""
    return (
        rows.select(*sorted(rows.columns))
        .writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
