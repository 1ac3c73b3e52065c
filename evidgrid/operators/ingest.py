"""From classified raw rows to events: filters, redaction, identity, counters, dedup."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidgrid import lexicon as lx
from evidgrid.functions.identity import content_sha, event_id
from evidgrid.functions.redaction import is_sensitive, redact

EVENT_COLUMNS = (
    "event_id",
    "source_kind",
    "authority",
    "ts",
    "session_id",
    "scope",
    "text",
    "locator",
    "content_sha256",
    "redactions",
)
STAT_COLUMNS = (
    "files_seen",
    "bytes_seen",
    "records_seen",
    "records_emitted",
    "malformed_records",
    "unknown_records",
    "sensitive_records_excluded",
)


def within_lookback(ts: Column, as_of: Column, days: int) -> Column:
    """Always true for 0 days; a row without usable time is kept."""
    if days <= 0:
        return F.lit(True)
    return F.coalesce(ts >= as_of - F.make_dt_interval(F.lit(days)), F.lit(True))


def classify(
    raw: DataFrame,
    as_of: Column | None = None,
    lookback_days: int = 0,
    max_chars: int | None = lx.MAX_EXCERPT_CHARS,
) -> DataFrame:
    """Finish the outcome of every raw row: cheap filters first, redaction only for what is left."""
    recent = within_lookback(F.col("ts"), as_of, lookback_days) if lookback_days else F.lit(True)
    outcome = (
        F.when(F.col("outcome") != "candidate", F.col("outcome"))
        .when(~recent, "outside")
        .when(F.coalesce(F.trim("text"), F.lit("")).rlike(r"(?U)^\s*$"), "blank")
        .otherwise("candidate")
    )
    first = raw.withColumn("outcome", outcome)
    redacted = first.withColumn(
        "_redacted", F.when(F.col("outcome") == "candidate", redact("text", max_chars))
    )
    final = F.when(F.col("outcome") != "candidate", F.col("outcome")).otherwise(
        F.when(is_sensitive("_redacted"), "sensitive").otherwise("emitted")
    )
    return redacted.withColumn("outcome", final)


def emitted_events(classified: DataFrame) -> DataFrame:
    """Event rows; hash and id come from the original text, the stored text is the redacted one."""
    sha = content_sha("text")
    rows = classified.where(F.col("outcome") == "emitted").withColumn("content_sha256", sha)
    identified = rows.withColumn(
        "event_id", event_id("source_kind", "session_id", "ts", "content_sha256")
    ).withColumn("redactions", F.col("_redacted")["findings"])
    return identified.withColumn("text", F.col("_redacted")["text"]).select(*EVENT_COLUMNS)


def source_stats(classified: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Additive counters of one or more sources; several sources merge by summing.

    Files are counted through a first aggregate per file, so no distinct set grows anywhere.
    """
    keys = list(by or [])

    def count_of(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome)

    per_file = classified.groupBy(*keys, "file").agg(
        F.sum("size").alias("b"),
        F.count("*").alias("n"),
        count_of("emitted").alias("e"),
        count_of("malformed").alias("m"),
        count_of("unknown").alias("u"),
        count_of("sensitive").alias("s"),
    )
    sums = {"bytes_seen": "b", "records_seen": "n", "records_emitted": "e"}
    sums |= {"malformed_records": "m", "unknown_records": "u", "sensitive_records_excluded": "s"}
    return per_file.groupBy(*keys).agg(
        F.count("file").alias("files_seen"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in sums.items()],
    )


def merge_stats(*parts: DataFrame) -> DataFrame:
    united = reduce(DataFrame.unionByName, parts)
    return united.agg(*[F.sum(name).alias(name) for name in STAT_COLUMNS])


def quality_flags(stats: DataFrame, max_ratio: float = lx.MAX_MALFORMED_RATIO) -> DataFrame:
    """Label a run as degraded when strictly more than ``max_ratio`` of its records are malformed."""
    ratio = F.col("malformed_records") / F.greatest(F.lit(1), F.col("records_seen"))
    return stats.withColumn("malformed_ratio", ratio).withColumn(
        "degraded",
        F.when(ratio > max_ratio, F.array(F.lit("malformed_ratio_exceeded"))).otherwise(
            F.array().cast("array<string>")
        ),
    )


def dedup_latest(
    events: DataFrame,
    keys: list[Column] | None = None,
    ts: str = "ts",
    arrival: str = "event_id",
) -> DataFrame:
    """Newest row per (session or '', content hash); on equal times the first arrival stays.

    Spark limits each task to one row per key before the shuffle, so a heavily copied text sends
    at most one row per task.
    """
    keys = keys or [F.coalesce(F.col("session_id"), F.lit("")), F.col("content_sha256")]
    newest = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(arrival))
    ranked = events.withColumn("_rank", F.row_number().over(newest))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def duplicate_count(events: DataFrame, keys: list[Column] | None = None) -> DataFrame:
    keys = keys or [F.coalesce(F.col("session_id"), F.lit("")), F.col("content_sha256")]
    groups = events.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        (F.count("*") - 1).alias("d")
    )
    return groups.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("duplicate_records"))


def flag_eligible(events: DataFrame, allowed: DataFrame) -> DataFrame:
    """``eligible`` is true for the ids of an allow list (column event_id)."""
    marks = allowed.select("event_id").distinct().withColumn("_ok", F.lit(True))
    joined = events.join(marks, "event_id", "left")
    return joined.withColumn("eligible", F.coalesce("_ok", F.lit(False))).drop("_ok")


def collect_events(
    sources: list[DataFrame],
    as_of: Column | None = None,
    lookback_days: int = 0,
    max_chars: int | None = lx.MAX_EXCERPT_CHARS,
) -> tuple[DataFrame, DataFrame]:
    """(events, counters) of all sources: deduplicated events in the order of (ts, event_id), and one
    row of counters that are summed over the sources."""
    classified = [classify(source, as_of, lookback_days, max_chars) for source in sources]
    united = reduce(DataFrame.unionByName, [emitted_events(rows) for rows in classified])
    counters = merge_stats(*[source_stats(rows) for rows in classified])
    return dedup_latest(united).orderBy("ts", "event_id"), counters


def redaction_totals(events: DataFrame, findings: str = "redactions") -> DataFrame:
    """Number of findings by kind and confidence."""
    # The outer form keeps the optimizer from computing the array a second time for a size filter.
    return (
        events.select(F.explode_outer(findings).alias("f"))
        .where(F.col("f").isNotNull())
        .groupBy(F.col("f.kind").alias("kind"), F.col("f.confidence").alias("confidence"))
        .agg(F.count("*").alias("findings"))
    )


NEEDS_COMPOSITION = r"[\p{M}\u1100-\u11ff\u0340\u0341\u2126\u212a\u212b\uf900-\ufaff]"


def compose_unicode(df: DataFrame, column: str) -> DataFrame:
    """Unicode NFC. Spark has no such function, so only texts that may change leave the JVM.

    They go in small groups of rows: an Arrow batch would hold 10,000 whole texts several times over.
    """

    @F.udf("string", useArrow=False)
    def nfc(value: str | None) -> str | None:
        return value if value is None else unicodedata.normalize("NFC", value)

    candidate = F.when(F.col(column).rlike(NEEDS_COMPOSITION), F.col(column))
    return df.withColumn(column, F.coalesce(nfc(candidate), F.col(column)))
