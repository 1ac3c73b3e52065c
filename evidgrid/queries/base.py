"""Registry of the runnable queries and the SQL that states the same result.

Queries read the given tables as they are. The texts are invented prose in four languages, so the
vocabulary is passed in: words that do occur there, as plain patterns that mean the same in every
regex dialect.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidgrid.functions.identity import content_sha, event_id
from evidgrid.lexicon import Lexicon
from evidgrid.session import READ_CONF, checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-02-01 00:00:00"
FIXTURE_LEXICON = Lexicon(
    correction="with|und|des",
    directive="the|die|les",
    explicit="for the|mit der|par les",
    negative="with|und|dans",
    positive="from|der|que",
    exception="but|except|that|aber|auch|mais|sur",
    required_heading="src1",
    stop=["the", "and", "that", "der", "die", "und", "que", "des", "les"],
    block_stop=["the", "and", "that", "der", "die", "und", "que", "des", "les"],
    anchors=(
        "are for from this was with das den ein mit von zu dans est par pour sur une".split()
    ),
    strong=["with", "mit", "pour"],
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the equivalent statement on the same tables."""

    def register(function: Query) -> Query:
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(spark, sf_dir)

        QUERIES[name] = prepared
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table with long texts, dealt out as the session asks for."""
    keys = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}
    rows, parts = table(spark, sf_dir, name), spark.conf.get(READ_CONF, None)
    return rows.repartition(int(parts), keys[name]) if parts else rows


def workspace(spark: SparkSession) -> str:
    """A fresh folder that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/queries/{uuid.uuid4().hex}"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def document_events(
    spark: SparkSession, sf_dir: str, columns: list[Column] | None = None
) -> DataFrame:
    """Documents as events: the event with the same number gives the time, the source the session.

    ``columns`` are computed on the scan, before the join; without them the text comes along.
    """
    documents = texts(spark, sf_dir).select(
        "doc_id",
        F.col("lang").alias("source_kind"),
        F.col("source").alias("session_id"),
        content_sha("text").alias("content_sha256"),
        *(columns if columns is not None else [F.col("text")]),
    )
    times = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts")
    return documents.join(times, "doc_id").select(
        event_id("source_kind", "session_id", "ts", "content_sha256").alias("event_id"),
        F.lit(3).alias("authority"),
        F.lit("global").alias("scope"),
        F.concat(F.lit("documents:"), F.col("doc_id")).alias("locator"),
        *documents.columns,
        "ts",
    )


def benchmark_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as blocks under their own heading."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("block_id"),
        "text",
        F.array(F.lit("benchmark")).alias("heading_path"),
    )


# --- SQL fragments ------------------------------------------------------------------------------


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_tokens(text: str, lexicon: Lexicon = FIXTURE_LEXICON) -> str:
    return (
        f"list_filter(list_transform(regexp_extract_all({text}, '(?i)[a-z0-9][a-z0-9_-]*'), "
        f"lambda t: lower(t)), lambda t: length(t) >= {lexicon.min_token_chars} AND NOT "
        f"list_contains({sql_list(lexicon.stop)}, t))[1:{lexicon.fingerprint_tokens}]"
    )


def sql_count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def sql_correction(text: str, lexicon: Lexicon = FIXTURE_LEXICON) -> str:
    shouted = (
        f"len(list_filter(regexp_split_to_array({text}, '\\s+'), "
        "lambda t: length(t) > 3 AND upper(t) = t AND lower(t) <> t))"
    )
    return (
        f"CAST(least(30, {sql_count(text, lexicon.correction)} * 4 + "
        f"{sql_count(text, lexicon.explicit)} * 10 + least(3, {shouted})) AS BIGINT)"
    )


def sql_directive(text: str, lexicon: Lexicon = FIXTURE_LEXICON) -> str:
    return f"CAST(least(30, {sql_count(text, lexicon.directive)}) AS BIGINT)"


def sql_iso(ts: str) -> str:
    return (
        f"CASE WHEN strftime({ts}, '%f') = '000000' THEN strftime({ts}, '%Y-%m-%dT%H:%M:%SZ') "
        f"ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%fZ') END"
    )


DOCUMENT_EVENTS_SQL = f"""
base AS (
  SELECT d.doc_id, d.lang AS source_kind, d.source AS session_id, e.ts, d.text,
         sha256(d.text) AS content_sha256
  FROM documents d JOIN events e ON d.doc_id = e.event_id),
ev AS (
  SELECT *, 'evt_' || substr(sha256(source_kind || chr(0) || session_id || chr(0) ||
         {sql_iso('ts')} || chr(0) || content_sha256), 1, 18) AS event_id
  FROM base)"""
DEDUPED_SQL = """
latest AS (
  SELECT * FROM ev
  QUALIFY row_number() OVER (PARTITION BY session_id, content_sha256
                             ORDER BY ts DESC, event_id) = 1)"""
