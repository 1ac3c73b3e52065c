"""Streams over files that Spark writes from the given tables, in a folder of their own.

The rows of a table arrive in three batches, dealt by a hash, so times come shuffled; the SQL states what
the batch operator gives on the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidgrid.functions.text import iso_instant
from evidgrid.operators.ingest import classify
from evidgrid.queries.base import (
    DEDUPED_SQL,
    DOCUMENT_EVENTS_SQL,
    FIXTURE_LEXICON,
    document_events,
    query,
    sql_iso,
    sql_list,
    sql_tokens,
    table,
    texts,
    workspace,
)
from evidgrid.queries.run_queries import LEGAL, SQL_STATE, run_log
from evidgrid.sources.adapters import from_history_b
from evidgrid.streaming import stateful as sf
from evidgrid.streaming import streams as st

ARRIVALS = 3
ANCHORS = sql_list(FIXTURE_LEXICON.anchors)


def arriving(rows: DataFrame, place: str, key: str) -> DataFrame:
    """``rows`` as a stream whose batches are ``ARRIVALS`` disjoint parts of them."""
    for turn in range(ARRIVALS):
        part = rows.where(F.pmod(F.xxhash64(key), F.lit(ARRIVALS)) == turn)
        part.write.mode("append").parquet(f"{place}/in/part={turn}")
    spark = rows.sparkSession
    files = spark.read.parquet(f"{place}/in").select(F.input_file_name()).distinct().count()
    return (
        spark.readStream.schema(rows.schema)
        .option("maxFilesPerTrigger", max(1, -(-files // ARRIVALS)))
        .parquet(f"{place}/in/*")
    )


def landed(rows: DataFrame, place: str) -> DataFrame:
    return sf.land(rows, f"{place}/out", f"{place}/log")


@query(
    "stream_latest",
    f"""WITH {DOCUMENT_EVENTS_SQL}, {DEDUPED_SQL}
SELECT session_id, content_sha256, event_id, {sql_iso('ts')} AS ts FROM latest""",
)
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest event per session and content, from events that arrive out of order."""
    events = document_events(spark, sf_dir, []).select("session_id", "content_sha256", "ts", "event_id")
    place = workspace(spark)
    changes = landed(sf.latest_rows(arriving(events, place, "event_id")), place)
    return sf.newest_of(changes).select(
        F.col("session_key").alias("session_id"), "content_sha256", "event_id", iso_instant("ts").alias("ts")
    )


@query(
    "stream_transitions",
    f"""WITH l AS (SELECT user_id AS run_id, event_id, {SQL_STATE} AS state, lag({SQL_STATE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM events)
SELECT run_id, event_id, from_state, state, CASE WHEN from_state IS NULL THEN state = 'planned'
  ELSE from_state || '>' || state IN ({", ".join("'" + a + ">" + b + "'" for a, b in LEGAL)}) END AS legal FROM l""",
)
def stream_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of every run in the order of its time; a last entry lets the watermark pass the rest."""
    log = run_log(spark, sf_dir).select(
        F.col("run_id").cast("string").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("bigint").alias("event_id"), "state"
    )
    place = workspace(spark)
    # Any two entries may arrive in any order: the delay is longer than the whole log.
    span = log.agg(F.min("ts").alias("a"), F.max("ts").alias("z")).select(
        F.coalesce(F.unix_seconds("z") - F.unix_seconds("a"), F.lit(0)).alias("s"), "z"
    ).first()
    stream = arriving(log, place, "event_id")
    if span.z is not None:
        closing = log.where(F.col("ts") == span.z).limit(1).select(
            F.lit("").alias("run_id"),
            (F.col("ts") + F.make_dt_interval(secs=F.lit(2 * span.s + 10))).alias("ts"),
            F.lit(-1).cast("bigint").alias("event_id"),
            F.lit("closing").alias("state"),
        )
        closing.write.parquet(f"{place}/in/part={ARRIVALS}")
    steps = landed(sf.run_steps(stream, LEGAL, delay=f"{span.s + 1} seconds"), place)
    return steps.where("run_id <> ''").select(
        F.col("run_id").cast("bigint").alias("run_id"), "event_id", "from_state", "state", "legal"
    )


@query(
    "stream_corroboration",
    f"""WITH t AS (SELECT source, {sql_tokens('text')} AS tokens FROM documents),
f AS (SELECT source, array_to_string(tokens, ' ') AS fp,
             list_sort(list_distinct(list_filter(tokens, lambda t: list_contains({ANCHORS}, t)))) AS anchors FROM t),
a AS (SELECT source, i, unnest(anchors) AS a FROM (SELECT *, row_number() OVER () AS i FROM f WHERE len(anchors) >= 3)),
k AS (SELECT x.source, x.a || ' ' || y.a || ' ' || z.a AS key
      FROM a x JOIN a y ON x.i = y.i AND x.a < y.a JOIN a z ON y.i = z.i AND y.a < z.a)
SELECT 'anchors' AS kind, key, CAST(count(DISTINCT source) AS BIGINT) AS witnesses FROM k GROUP BY key
UNION ALL SELECT 'fingerprint', sha256(fp), CAST(count(DISTINCT source) AS BIGINT) FROM f WHERE fp <> '' GROUP BY fp""",
)
def stream_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent sources per fingerprint and per combination of three anchors."""
    events = texts(spark, sf_dir).select("doc_id", F.col("source").alias("session_id"), "text")
    place = workspace(spark)
    stream = arriving(events, place, "doc_id")
    return sf.witness_totals(landed(sf.session_counts(stream, FIXTURE_LEXICON), place))


# --- ingest ---------------------------------------------------------------------------------------

SECRET, NUMBERED = "password = hunter2hunter2 ", " 123e4567-e89b-12d3-a456-426614174000"


def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as lines of a prompt history.

    Every fifth turn is cut off in the middle, every seventh holds a secret, every third a number of a
    kind that is masked.
    """
    said = F.concat(
        F.when(F.col("turn") % 7 == 3, F.lit(SECRET)).otherwise(""),
        "text",
        F.when(F.col("turn") % 3 == 1, F.lit(NUMBERED)).otherwise(""),
    )
    line = F.to_json(
        F.struct(
            said.alias("text"),
            (F.lit(1_700_000_000) + F.col("conv_id") * 100 + F.col("turn")).alias("ts"),
            F.col("conv_id").cast("string").alias("session_id"),
        )
    )
    cut = F.when(F.col("turn") % 5 == 4, F.substr(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", cut.alias("value"))


def arriving_lines(spark: SparkSession, sf_dir: str, place: str) -> DataFrame:
    """The lines as a JSONL stream."""
    lines = prompt_lines(spark, sf_dir)
    for turn in range(ARRIVALS):
        part = lines.where(F.pmod(F.xxhash64("conv_id"), F.lit(ARRIVALS)) == turn)
        part.select("value").write.mode("append").text(f"{place}/lines")
    return classify(from_history_b(st.stream_jsonl(spark, f"{place}/lines")), max_chars=None)


LINES_SQL = f"""
l AS (SELECT conv_id, turn, turn % 7 = 3 AS secret, turn % 5 = 4 AS cut,
  CASE WHEN turn % 7 = 3 THEN '{SECRET}' ELSE '' END || text || CASE WHEN turn % 3 = 1 THEN '{NUMBERED}' ELSE '' END AS said,
  CASE WHEN turn % 3 = 1 THEN text || ' [REDACTED:uuid:' || substr(sha256('{NUMBERED.strip()}'), 1, 10) || ']' ELSE text END AS shown,
  strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(1700000000 + conv_id * 100 + turn), '%Y-%m-%dT%H:%M:%SZ') AS said_at FROM conversations)"""


@query(
    "stream_ingest",
    f"""WITH {LINES_SQL}
SELECT 'evt_' || substr(sha256('history_b_user' || chr(0) || conv_id || chr(0) || said_at || chr(0) || sha256(said)), 1, 18) AS event_id,
  CAST(conv_id AS VARCHAR) AS session_id, sha256(said) AS content_sha256, shown AS text
FROM l WHERE NOT cut AND NOT secret AND regexp_matches(said, '[^\\s]')""",
)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of arriving lines, redacted, without secrets, appended as JSON lines and read again."""
    place = workspace(spark)
    events = st.stream_events(arriving_lines(spark, sf_dir, place), classified=True).select(
        "event_id", "session_id", "content_sha256", "text"
    )
    st.append_log_stream(events, f"{place}/log-lines", f"{place}/log").awaitTermination()
    return spark.read.schema(events.schema).json(f"{place}/log-lines").select(*events.columns)


@query(
    "stream_quality",
    f"""WITH {LINES_SQL},
o AS (SELECT *, NOT regexp_matches(said, '[^\\s]') AS blank FROM l)
SELECT CAST(count(*) AS BIGINT) AS records_seen, CAST(count(*) FILTER (cut) AS BIGINT) AS malformed_records,
  CAST(0 AS BIGINT) AS unknown_records, CAST(count(*) FILTER (NOT cut AND secret) AS BIGINT) AS sensitive_records_excluded,
  CAST(count(*) FILTER (NOT cut AND NOT secret AND NOT blank) AS BIGINT) AS records_emitted FROM o""",
)
def stream_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counters of the whole stream: those of its batches, summed up."""
    place = workspace(spark)
    counted = st.counted(arriving_lines(spark, sf_dir, place), "quality").select("outcome")
    landing = counted.writeStream.format("parquet").option("path", f"{place}/out")
    started = landing.option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.createDataFrame([st.quality_totals(started, "quality")], st.QUALITY_SCHEMA)


@query(
    "stream_alerts",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS records, count(*) FILTER (event_type = 'error') AS malformed FROM events GROUP BY day)
SELECT strftime(day, '%Y-%m-%d') AS day, CAST(records AS BIGINT) AS records, CAST(malformed AS BIGINT) AS malformed_records,
  malformed / records AS ratio FROM d WHERE malformed / records > 0.2""",
)
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which more than a fifth of the events are errors."""
    failed = F.when(F.col("event_type") == "error", "malformed").otherwise("emitted")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), failed.alias("outcome")
    )
    place = workspace(spark)
    stream = arriving(rows, place, "event_id")
    # The days close when a much later record comes.
    rows.orderBy(F.col("ts").desc()).limit(1).select(
        F.lit(-1).cast(rows.schema["event_id"].dataType).alias("event_id"),
        (F.col("ts") + F.expr("INTERVAL 4000 DAYS")).alias("ts"), F.lit("emitted").alias("outcome"),
    ).write.parquet(f"{place}/in/part={ARRIVALS}")
    alerts = st.malformed_alerts(stream, "ts", "1 day", "2000 days", 0.2)
    return landed(alerts, place).select(
        F.date_format("window.start", "yyyy-MM-dd").alias("day"), "records", "malformed_records", "ratio"
    )
