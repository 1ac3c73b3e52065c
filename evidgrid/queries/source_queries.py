"""File sources and logs: files are written from the given tables and scanned again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidgrid.functions.identity import content_sha
from evidgrid.functions.text import iso_instant
from evidgrid.operators import ingest as ing
from evidgrid.operators.skew import running_total
from evidgrid.queries.base import query, table, workspace
from evidgrid.sources import adapters as ad
from evidgrid.sources import jsonl as js
from evidgrid.sources import sinks as sk

#: Longest line that a scan of ``scanned_lines`` takes.
LINE_BYTES = 600


def written(lines: DataFrame, path: str) -> str:
    lines.select("value").write.text(path)
    return path


@query(
    "scanned_lines",
    f"""WITH l AS (SELECT conv_id, turn, '{{"conv_id":' || conv_id || ',"turn":' || turn || ',"pad":"' || repeat('x', length(text)) || '"}}' AS line FROM conversations),
s AS (SELECT conv_id, turn, CASE turn % 5 WHEN 1 THEN length(line) - 1 WHEN 2 THEN length(line) + 2 WHEN 3 THEN length(line) + 1 ELSE length(line) END + 1 AS size FROM l),
m AS (SELECT *, turn % 5 IN (1, 2, 3) OR size > {LINE_BYTES} AS malformed FROM s)
SELECT CASE WHEN NOT malformed THEN conv_id END AS conv_id, CASE WHEN NOT malformed THEN turn END AS turn, CAST(size AS BIGINT) AS size, malformed FROM m""",
)
def scanned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a JSONL file: objects, cut-off objects, arrays, bad bytes, and lines that are too long."""
    pad = F.repeat(F.lit("x"), F.length("text"))
    line = F.concat(
        F.lit('{"conv_id":'), F.col("conv_id").cast("string"), F.lit(',"turn":'),
        F.col("turn").cast("string"), F.lit(',"pad":"'), pad, F.lit('"}'),
    )
    kind = F.col("turn") % 5
    bad_bytes = F.concat(F.unhex(F.lit("FF")), line.cast("binary")).cast("string")
    value = (
        F.when(kind == 1, F.substr(line, F.lit(1), F.length(line) - 1))
        .when(kind == 2, F.concat(F.lit("["), line, F.lit("]")))
        .when(kind == 3, bad_bytes)
        .otherwise(line)
    )
    turns = table(spark, sf_dir, "conversations").withColumn("value", value)
    raw = js.scan_jsonl(spark, written(turns, f"{workspace(spark)}/lines"), LINE_BYTES)
    return raw.select(
        js.field(F.col("rec"), "conv_id", "bigint").alias("conv_id"),
        js.field(F.col("rec"), "turn", "bigint").alias("turn"),
        "size",
        "malformed",
    )


def seen(raw: DataFrame, *columns: str | Column) -> DataFrame:
    """Adapter rows without their place and without texts."""
    usable = F.col("outcome") == "candidate"
    return raw.select(
        *columns,
        "source_kind",
        "authority",
        "outcome",
        F.when(usable, content_sha("text")).alias("content_sha256"),
    )


@query(
    "history_a_rows",
    """SELECT CAST(conv_id AS VARCHAR) AS session_id, CASE WHEN turn % 2 = 0 THEN '/work/' || role ELSE 'global' END AS scope,
  strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(1700000000 + conv_id * 100 + turn), '%Y-%m-%dT%H:%M:%SZ') AS ts,
  'history_a_user' AS source_kind, 3 AS authority, CASE WHEN turn % 4 = 3 THEN 'malformed' ELSE 'candidate' END AS outcome,
  CASE WHEN turn % 4 <> 3 THEN sha256(text) END AS content_sha256 FROM conversations""",
)
def history_a_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = history_a(spark, sf_dir)
    return seen(ad.from_history_a(raw), "session_id", "scope", iso_instant("ts").alias("ts"))


def history_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt history with display, timestamp in milliseconds, session and project."""
    at = ((F.lit(1_700_000_000) + F.col("conv_id") * 100 + F.col("turn")) * 1000).alias("timestamp")
    session = F.col("conv_id").cast("string").alias("sessionId")
    project = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("/work/"), "role")).alias("project")
    good = F.to_json(F.struct(F.col("text").alias("display"), at, session, project))
    number = F.to_json(F.struct(F.col("turn").alias("display"), at, session, project))
    turns = table(spark, sf_dir, "conversations").withColumn(
        "value", F.when(F.col("turn") % 4 == 3, number).otherwise(good)
    )
    return js.scan_jsonl(spark, written(turns, f"{workspace(spark)}/a"), numbered=False)


@query(
    "history_b_rows",
    """SELECT CASE WHEN turn % 3 <> 0 THEN CAST(conv_id AS VARCHAR) END AS session_id, 'global' AS scope,
  strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(1700000000 + conv_id * 100 + turn), '%Y-%m-%dT%H:%M:%SZ') AS ts,
  'history_b_user' AS source_kind, 3 AS authority, 'candidate' AS outcome, sha256(text) AS content_sha256 FROM conversations""",
)
def history_b_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = history_b(spark, sf_dir)
    return seen(ad.from_history_b(raw), "session_id", "scope", iso_instant("ts").alias("ts"))


def history_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt history with text, ts in seconds and, in two of three lines, a session."""
    at = (F.lit(1_700_000_000) + F.col("conv_id") * 100 + F.col("turn")).alias("ts")
    session = F.when(F.col("turn") % 3 != 0, F.col("conv_id").cast("string")).otherwise("")
    line = F.to_json(F.struct("text", at, session.alias("session_id")))
    turns = table(spark, sf_dir, "conversations").withColumn("value", line)
    return js.scan_jsonl(spark, written(turns, f"{workspace(spark)}/b"))


TURN_SQL = """
t AS (SELECT conv_id, turn, text, strftime(TIMESTAMP '1970-01-01 00:00:00' + to_seconds(1700000000 + conv_id * 100 + turn), '%Y-%m-%dT%H:%M:%SZ') AS said_at FROM conversations),
u AS (SELECT 'history_a_user' AS kind, CAST(conv_id AS VARCHAR) AS session, turn, text, said_at FROM t WHERE turn % 4 <> 3
  UNION ALL SELECT 'history_b_user', CASE WHEN turn % 3 <> 0 THEN CAST(conv_id AS VARCHAR) ELSE '' END, turn, text, said_at FROM t),
e AS (SELECT *, sha256(text) AS sha, 'evt_' || substr(sha256(kind || chr(0) || session || chr(0) || said_at || chr(0) || sha256(text)), 1, 18) AS event_id
  FROM u WHERE regexp_matches(text, '[^\\s]'))"""


@query(
    "collected_events",
    f"""WITH {TURN_SQL},
l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY session, sha ORDER BY said_at DESC, event_id) = 1)
SELECT event_id, kind AS source_kind, CASE WHEN session <> '' THEN session END AS session_id, said_at AS ts, sha AS content_sha256,
  CAST(row_number() OVER (ORDER BY said_at, event_id) AS INTEGER) AS place FROM l""",
)
def collected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two prompt histories collected: events once, in their order."""
    raws = [ad.from_history_a(history_a(spark, sf_dir)), ad.from_history_b(history_b(spark, sf_dir))]
    events, _ = ing.collect_events(raws, max_chars=None)
    kept = events.select("event_id", "source_kind", "session_id", "ts", "content_sha256")
    placed = running_total(kept, [], ["ts", "event_id"], F.lit(1), "place")
    return placed.withColumn("ts", iso_instant("ts")).withColumn("place", F.col("place").cast("int"))


@query(
    "collected_stats",
    f"""WITH {TURN_SQL}
SELECT CAST(2 * count(*) AS BIGINT) AS records_seen, CAST((SELECT count(*) FROM e) AS BIGINT) AS records_emitted,
  CAST(count(*) FILTER (turn % 4 = 3) AS BIGINT) AS malformed_records, CAST(0 AS BIGINT) AS unknown_records,
  CAST(0 AS BIGINT) AS sensitive_records_excluded FROM t""",
)
def collected_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the two histories, merged."""
    raws = [ad.from_history_a(history_a(spark, sf_dir)), ad.from_history_b(history_b(spark, sf_dir))]
    _, counters = ing.collect_events(raws, max_chars=None)
    return counters.drop("files_seen", "bytes_seen")


TRANSCRIPT_SQL = """
SELECT '{shape}' AS shape, {session} AS session_id, 'transcript_{shape}_user' AS source_kind, 3 AS authority,
  CASE WHEN {unknown} THEN 'unknown' WHEN role <> 'user' OR text = '' THEN 'empty' ELSE 'candidate' END AS outcome,
  CASE WHEN NOT ({unknown}) AND role = 'user' AND text <> '' THEN sha256(text) END AS content_sha256 FROM conversations"""


@query(
    "transcript_rows",
    TRANSCRIPT_SQL.format(shape="a", session="CAST(conv_id AS VARCHAR)", unknown="role = 'system'")
    + " UNION ALL "
    + TRANSCRIPT_SQL.format(shape="b", session="CAST(NULL AS VARCHAR)", unknown="turn % 4 = 3"),
)
def transcript_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of both shapes; only user messages of the right record type are candidates."""
    turns, place = table(spark, sf_dir, "conversations"), workspace(spark)
    block = F.struct(F.lit("text").alias("type"), "text")
    record_type = F.when(F.col("role") == "system", "summary").otherwise("user")
    shape_a = F.to_json(
        F.struct(
            record_type.alias("type"),
            F.col("conv_id").cast("string").alias("sessionId"),
            F.struct("role", F.array(block).alias("content")).alias("message"),
        )
    )
    kind = F.when(F.col("turn") % 4 == 3, "event").otherwise("response_item")
    shape_b = F.to_json(
        F.struct(kind.alias("type"), F.struct("role", F.col("text").alias("content")).alias("payload"))
    )
    parts = []
    for shape, line in (("a", shape_a), ("b", shape_b)):
        path = written(turns.withColumn("value", line), f"{place}/{shape}")
        rows = ad.from_transcripts(js.scan_jsonl(spark, path, numbered=False), shape)
        # The second shape has its session from the name of the file.
        session = F.col("session_id") if shape == "a" else F.lit(None).cast("string")
        parts.append(seen(rows, F.lit(shape).alias("shape"), session.alias("session_id")))
    return parts[0].union(parts[1])


def one_file_each(rows: DataFrame, path: str, *keys: str) -> str:
    """A file per row with the column ``value`` in a folder that is named by ``keys``."""
    rows.select(*keys, "value").write.partitionBy(*keys).text(path)
    return path


#: Rows of a task of ``a_file_per_row``.
FILES_PER_TASK = 1_000


def a_file_per_row(rows: DataFrame, path: str) -> str:
    """A JSON file per row, all in one folder.

    The rows are dealt out by their number, not by their bytes, and every task moves its own files to
    their place: neither one task nor the driver handles all files. A task that is run again writes the
    same names.
    """
    tasks = -(-rows.count() // FILES_PER_TASK)
    writer = rows.repartition(max(1, tasks)).write.option("maxRecordsPerFile", 1)
    writer = writer.option("mapreduce.fileoutputcommitter.algorithm.version", 2)
    writer.option("ignoreNullFields", "false").json(path)
    return path


@query(
    "note_rows",
    """SELECT item_id, 'kind=note' AS scope, 'auto_memory' AS source_kind, 6 AS authority,
  CASE WHEN item_id % 5 = 4 THEN 'malformed' ELSE 'candidate' END AS outcome,
  CASE WHEN item_id % 5 <> 4 THEN sha256('originSessionId: "00000000-0000-4000-8000-' || lpad(CAST(item_id AS VARCHAR), 12, '0') || '"' || chr(10) || text || chr(10)) END AS content_sha256
FROM benchmark""",
)
def note_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes, a file each; the session stands in the header, some hold bad bytes."""
    number = F.lpad(F.col("item_id").cast("string"), 12, "0")
    note = F.concat(F.lit('originSessionId: "00000000-0000-4000-8000-'), number, F.lit('"\n'), "text")
    bad = F.concat(note.cast("binary"), F.unhex(F.lit("FE"))).cast("string")
    rows = table(spark, sf_dir, "benchmark").select(
        F.lit("note").alias("kind"),
        "item_id",
        F.when(F.col("item_id") % 5 == 4, bad).otherwise(note).alias("value"),
    )
    path = one_file_each(rows, f"{workspace(spark)}/notes", "kind", "item_id")
    found = ad.from_notes(spark, f"{path}/*/*/*.txt")
    item = F.regexp_extract("session_id", "([0-9]{12})$", 1).cast("bigint")
    return seen(found, item.alias("item_id"), "scope")


@query(
    "newest_file_rows",
    "SELECT conv_id, turn FROM conversations WHERE turn % 3 = 2",
)
def newest_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the files that were written last, found by their time."""
    turns, place = table(spark, sf_dir, "conversations"), workspace(spark)
    line = F.to_json(F.struct("conv_id", "turn"))
    for part in range(3):
        lines = turns.where(F.col("turn") % 3 == part).select(line.alias("value"))
        lines.write.text(f"{place}/part={part}")
    last = spark.read.text(f"{place}/part=2").select(F.input_file_name()).distinct().count()
    newest = js.newest_files(spark, place, last, ".txt").select(F.regexp_replace("file", "^file:/+", "/").alias("f"))
    raw = js.scan_jsonl(spark, f"{place}/*", numbered=False)
    rows = raw.withColumn("f", F.regexp_replace("file", "^file:/+", "/")).join(newest, "f", "left_semi")
    return rows.select(
        js.field(F.col("rec"), "conv_id", "bigint").alias("conv_id"),
        js.field(F.col("rec"), "turn", "bigint").alias("turn"),
    )


@query(
    "scanned_documents",
    """WITH d AS (SELECT item_id, '---' || chr(10) || 'paths: [src/' || item_id || ', docs]' || chr(10) || '---' || chr(10) || text || chr(10) AS content FROM benchmark)
SELECT item_id, item_id % 4 <> 3 AS utf8,
  CASE WHEN item_id % 4 = 3 THEN sha256('\\xFF'::BLOB || encode(content)) ELSE sha256(content) END AS sha256,
  CASE WHEN item_id % 4 <> 3 THEN 'src/' || item_id || ',docs' END AS scope_paths,
  CASE WHEN item_id % 4 <> 3 THEN sha256(substr(content, strpos(content, 'docs]') + 10)) END AS body_sha256 FROM d""",
)
def scanned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with front matter, a file each; some are not UTF-8."""
    whole = F.concat(
        F.lit("---\npaths: [src/"), F.col("item_id").cast("string"), F.lit(", docs]\n---\n"), "text"
    )
    bad = F.concat(F.unhex(F.lit("FF")), whole.cast("binary")).cast("string")
    rows = table(spark, sf_dir, "benchmark").select(
        "item_id", F.when(F.col("item_id") % 4 == 3, bad).otherwise(whole).alias("value")
    )
    path = one_file_each(rows, f"{workspace(spark)}/docs", "item_id")
    found = sk.scan_documents(spark, f"{path}/*", "*.txt")
    return found.select(
        F.regexp_extract("doc", r"item_id=(\d+)/", 1).cast("bigint").alias("item_id"),
        "utf8",
        "sha256",
        F.when(F.col("utf8"), F.array_join("scope_paths", ",")).alias("scope_paths"),
        F.when(F.col("utf8"), content_sha("body")).alias("body_sha256"),
    )


RUN_SQL = "strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds({n}), '%Y%m%dT%H%M%SZ') || '-' || lpad(CAST({n} AS VARCHAR), 8, '0')"


def run_name(number: Column) -> Column:
    at = F.timestamp_seconds(F.lit(1_704_067_200) + number)
    stamp = F.concat(F.date_format(at, "yyyyMMdd"), F.lit("T"), F.date_format(at, "HHmmss"), F.lit("Z-"))
    return F.concat(stamp, F.lpad(number.cast("string"), 8, "0"))


@query(
    "scanned_runs",
    f"""SELECT {RUN_SQL.format(n='p_partkey % 500')} AS run_id, CAST(max(p_size) AS BIGINT) AS size, max(p_brand) AS brand
FROM part WHERE (p_partkey % 500) % 3 <> 0 GROUP BY p_partkey % 500""",
)
def scanned_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of run folders; a third of the plans is cut off, one folder is no run."""
    number = (F.col("p_partkey") % 500).cast("int")
    plans = (
        table(spark, sf_dir, "part")
        .groupBy(number.alias("n"))
        .agg(F.max("p_size").alias("size"), F.max("p_brand").alias("brand"))
    )
    plan = F.to_json(F.struct("size", "brand"))
    cut = F.when(F.col("n") % 3 == 0, F.substr(plan, F.lit(1), F.length(plan) - 1)).otherwise(plan)
    rows = plans.select(run_name(F.col("n")).alias("run_id"), cut.alias("value"))
    path = one_file_each(rows, f"{workspace(spark)}/runs", "run_id")
    rows.limit(1).select(F.lit("{}").alias("value")).write.text(f"{path}/notes")
    found = sk.scan_runs(spark, path, "*.txt")
    return found.select(
        "run_id",
        js.field(F.col("plan"), "size", "bigint").alias("size"),
        js.field(F.col("plan"), "brand").alias("brand"),
    )


@query(
    "scanned_tombstones",
    f"""SELECT {RUN_SQL.format(n='s_suppkey')} AS parent_run_id, {RUN_SQL.format(n='s_suppkey + 1')} AS successor_run_id,
  'decision-' || substr(sha256(s_name), 1, 16) AS request_id, sha256(s_name) AS parent_sha256 FROM supplier WHERE s_suppkey % 4 <> 0""",
)
def scanned_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tombstones, a file each; a quarter of them has no marker."""
    sha = F.sha2("s_name", 256)
    marker = F.struct(
        run_name(F.col("s_suppkey")).alias("parent_run_id"),
        run_name(F.col("s_suppkey") + 1).alias("successor_run_id"),
        F.concat(F.lit("decision-"), F.left(sha, F.lit(16))).alias("request_id"),
        sha.alias("parent_plan_sha256"),
        F.sha2(F.concat("s_name", F.lit("+")), 256).alias("successor_plan_sha256"),
        F.sha2(F.concat("s_name", F.lit("?")), 256).alias("conflict_fingerprint"),
        F.sha2(F.concat("s_name", F.lit("!")), 256).alias("response_sha256"),
    )
    rows = table(spark, sf_dir, "supplier").select(
        F.when(F.col("s_suppkey") % 4 != 0, marker).alias("decision_resolution")
    )
    path = a_file_per_row(rows, f"{workspace(spark)}/stones")
    return sk.scan_tombstones(spark, path).select(
        "parent_run_id", "successor_run_id", "request_id", "parent_sha256"
    )


@query(
    "appended_log",
    """WITH l AS (SELECT '{"at":"' || strftime(o_orderdate, '%Y-%m-%d') || '","run":' || o_orderkey || ',"state":"' || o_orderstatus || '"}' AS line FROM orders)
SELECT line, CAST(2 AS BIGINT) AS n FROM l""",
)
def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders appended to a log twice, as lines with sorted keys."""
    path = f"{workspace(spark)}/log"
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("state"),
        F.col("o_orderkey").alias("run"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"),
    )
    for _ in range(2):
        sk.append_log(rows, path)
    lines = spark.read.text(path)
    return lines.groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query(
    "blob_store",
    "SELECT DISTINCT sha256(text) AS sha256, CAST(length(text) AS BIGINT) AS chars, FALSE AS corrupt FROM documents",
)
def blob_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts put into a store in two overlapping steps: each is there once, under its hash."""
    payloads = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("payload"))
    path = f"{workspace(spark)}/blobs"
    for part in (F.col("doc_id") % 3 != 0, F.col("doc_id") % 3 != 1):
        sk.put_blobs(payloads.where(part).select("payload"), path)
    corrupt = sk.verify_blobs(spark, path).select("sha256", F.lit(True).alias("corrupt"))
    stored = spark.read.parquet(path).join(corrupt, "sha256", "left")
    return stored.select(
        "sha256", F.length("payload").cast("bigint").alias("chars"),
        F.coalesce("corrupt", F.lit(False)).alias("corrupt"),
    )
