"""Adapters from raw records to classified evidence rows.

Every adapter keeps all input rows and writes an ``outcome`` for each, so that counters and events
come from one pass: malformed, unknown, empty, or candidate (see ``operators.ingest``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidgrid.functions.text import flatten_content, instant_from_text, normalize_instant
from evidgrid.sources.jsonl import field, is_number, is_text

RAW_COLUMNS = (
    "source_kind",
    "authority",
    "ts",
    "session_id",
    "scope",
    "text",
    "locator",
    "file",
    "size",
    "outcome",
)
# Authority ranks of the kinds of source.
REPEATED_PREFERENCE = 3
KNOWLEDGE_NODE = 5
AUTO_MEMORY = 6


def _blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def _record_time(rec: Column, name: str, fallback: Column) -> Column:
    number = F.when(is_number(rec, name), field(rec, name, "double"))
    text = F.when(is_text(rec, name), field(rec, name))
    return normalize_instant(number, text, fallback)


def _raw(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[columns[name].alias(name) for name in RAW_COLUMNS])


def _history(
    raw: DataFrame, kind: str, text_key: str, time_key: str, session_key: str, scope: Column
) -> DataFrame:
    rec = F.col("rec")
    usable = ~F.col("malformed") & is_text(rec, text_key)
    return _raw(
        raw,
        source_kind=F.lit(kind),
        authority=F.lit(REPEATED_PREFERENCE),
        ts=_record_time(rec, time_key, F.col("mtime")),
        session_id=_blank_to_null(field(rec, session_key)),
        scope=scope,
        text=field(rec, text_key),
        locator=F.concat_ws(":", "file", "line_no"),
        file=F.col("file"),
        size=F.col("size"),
        outcome=F.when(usable, "candidate").otherwise("malformed"),
    )


def from_history_a(raw: DataFrame, kind: str = "history_a_user") -> DataFrame:
    """Prompt history with display / timestamp / sessionId / project."""
    scope = F.coalesce(_blank_to_null(field(F.col("rec"), "project")), F.lit("global"))
    return _history(raw, kind, "display", "timestamp", "sessionId", scope)


def from_history_b(raw: DataFrame, kind: str = "history_b_user") -> DataFrame:
    """Prompt history with text / ts / session_id."""
    return _history(raw, kind, "text", "ts", "session_id", F.lit("global"))


def from_transcripts(raw: DataFrame, shape: str, kind: str | None = None) -> DataFrame:
    """User messages of session transcripts; records of other types are counted as unknown."""
    rec = F.col("rec")
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    if shape == "a":
        right_type = field(rec, "type") == "user"
        role = field(rec, "message.role")
        content = F.try_variant_get(rec, "$.message.content", "variant")
        session = F.coalesce(_blank_to_null(field(rec, "sessionId")), stem)
    elif shape == "b":
        right_type = field(rec, "type") == "response_item"
        role = field(rec, "payload.role")
        content = F.try_variant_get(rec, "$.payload.content", "variant")
        session = stem
    else:
        raise ValueError(f"unknown transcript shape {shape!r}")
    text = F.when(role == "user", flatten_content(content)).otherwise(F.lit(""))
    outcome = (
        F.when(F.col("malformed"), "malformed")
        .when(~F.coalesce(right_type, F.lit(False)), "unknown")
        .when(F.coalesce(text, F.lit("")) == "", "empty")
        .otherwise("candidate")
    )
    return _raw(
        raw,
        source_kind=F.lit(kind or f"transcript_{shape}_user"),
        authority=F.lit(REPEATED_PREFERENCE),
        ts=_record_time(rec, "timestamp", F.col("mtime")),
        session_id=session,
        scope=F.regexp_extract("file", r"^(.*)/[^/]*$", 1),
        text=text,
        locator=F.concat_ws(":", "file", "line_no"),
        file=F.col("file"),
        size=F.col("size"),
        outcome=outcome,
    )


def from_notes(spark: SparkSession, path: str, kind: str = "auto_memory") -> DataFrame:
    """One record per Markdown note: file time, session from its header line, folder as scope."""
    files = spark.read.text(path, wholetext=True).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("mtime"),
        F.col("_metadata.file_size").alias("size"),
    )
    session = F.regexp_extract("value", r"originSessionId:\s*[\"']?([0-9a-fA-F-]{20,})", 1)
    return _raw(
        files,
        source_kind=F.lit(kind),
        authority=F.lit(AUTO_MEMORY),
        ts=F.col("mtime"),
        session_id=_blank_to_null(session),
        scope=F.coalesce(F.try_element_at(F.split("file", "/"), F.lit(-3)), F.lit("")),
        text=F.col("value"),
        locator=F.col("file"),
        file=F.col("file"),
        size=F.col("size").cast("long"),
        outcome=F.when(F.is_valid_utf8("value"), "candidate").otherwise("malformed"),
    )


def top_hits(hits: DataFrame, top_k: int) -> DataFrame:
    """Ids among the best ``top_k`` of any query, each once (query, node_id, score)."""
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "node_id")
    ranked = hits.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= top_k)
    return ranked.select("node_id").distinct()


def from_nodes(
    nodes: DataFrame, hits: DataFrame, top_k: int = 20, kind: str = "node_active"
) -> DataFrame:
    """Active knowledge nodes found by any query; nodes without text are left aside."""
    found = nodes.join(top_hits(hits, top_k), "node_id", "left_semi")
    text = F.coalesce(_blank_to_null(F.col("content")), _blank_to_null(F.col("title")))
    active = F.coalesce(F.col("status"), F.lit("active")) == "active"
    ts = F.coalesce(
        instant_from_text("updated_at"),
        instant_from_text("created_at"),
        F.timestamp_micros(F.lit(0).cast("long")),
    )
    return _raw(
        found,
        source_kind=F.lit(kind),
        authority=F.lit(KNOWLEDGE_NODE),
        ts=ts,
        session_id=F.lit(None).cast("string"),
        scope=F.coalesce(F.array_join("tags", ","), F.lit("global")),
        text=text,
        locator=F.concat(F.lit("node:"), "node_id"),
        file=F.lit(None).cast("string"),
        size=F.lit(0).cast("long"),
        outcome=F.when(active & text.isNotNull(), "candidate").otherwise("skipped"),
    )
