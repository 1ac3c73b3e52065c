"""Citations, grounding, support, ties, metrics, budgets and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidgrid.functions.exprs import strings
from evidgrid.functions.text import extract_terms, normalize_block, utf8_bytes
from evidgrid.operators import metrics as mt
from evidgrid.operators import rules as ru
from evidgrid.queries.base import ORACLES, query, sql_list, table, texts
from evidgrid.queries.text_queries import SQL_NORMAL

WORDS = "with from mit von dans avec sur par para una".split()
WORD_PATTERN = "(?i)(?:" + "|".join(WORDS) + ")"
SQL_WORDS = f"list_distinct(list_transform(regexp_extract_all(text, '{WORD_PATTERN}'), lambda t: lower(t)))"
SYNONYMS = ["with", "mit", "avec"]


@query(
    "citations",
    """WITH c AS (SELECT doc_id AS cite, unnest([doc_id, doc_id + 1, doc_id * 2]) AS id FROM labels),
n AS (SELECT cite, id, count(*) AS n FROM c GROUP BY ALL)
SELECT cite, id, CASE WHEN d.doc_id IS NULL THEN 'unknown' ELSE 'duplicate' END AS code
FROM n LEFT JOIN documents d ON n.id = d.doc_id WHERE d.doc_id IS NULL OR n.n > 1""",
)
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label cites three documents; unknown and repeated citations are reported."""
    ids = F.array(F.col("doc_id"), F.col("doc_id") + 1, F.col("doc_id") * 2)
    citing = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("cite"), ids.alias("ids"))
    return ru.citation_problems(citing, "cite", "ids", table(spark, sf_dir, "documents"), "doc_id")


@query(
    "total_disposition",
    """WITH d AS (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT -1 - doc_id FROM labels WHERE quality = 1),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id)
SELECT coalesce(d.doc_id, n.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'unknown' WHEN n.n IS NULL THEN 'missing' ELSE 'duplicate' END AS code
FROM documents d FULL JOIN n ON d.doc_id = n.doc_id WHERE d.doc_id IS NULL OR n.n IS NULL OR n.n > 1""",
)
def total_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document must be disposed of exactly once by labels and multiples of three."""
    blocks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id"))
    labels = table(spark, sf_dir, "labels")
    dispositions = (
        labels.select(F.col("doc_id").alias("block_id"))
        .union(blocks.where("block_id % 3 = 0"))
        .union(labels.where("quality = 1").select(-1 - F.col("doc_id")))
    )
    found = ru.disposition_problems(blocks, dispositions)
    return found.withColumnRenamed("block_id", "doc_id")


@query(
    "allow_list",
    """SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)""",
)
def allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose nation is not the nation of a supplier with a high balance."""
    allowed = table(spark, sf_dir, "supplier").where("s_acctbal > 8000")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return ru.outside_allow_list(rows, "c_nationkey", allowed, "s_nationkey").select("c_custkey", "c_nationkey")


@query(
    "grounding_terms",
    f"""WITH d AS (SELECT doc_id, source, {SQL_WORDS} AS terms FROM documents),
p AS (SELECT doc_id, terms, lead(terms) OVER (PARTITION BY source ORDER BY doc_id) AS other FROM d),
q AS (SELECT doc_id, terms, other, list_filter(terms, lambda t: NOT list_contains(other, t)) AS missing,
  list_has_any(other, ['with', 'mit', 'avec']) AS syn FROM p WHERE other IS NOT NULL)
SELECT doc_id, array_to_string(list_sort(CASE WHEN syn THEN list_filter(missing, lambda t: NOT list_contains(['with', 'mit', 'avec'], t)) ELSE missing END), ' ') AS unsupported,
  array_to_string(list_sort(list_filter(other, lambda t: NOT list_contains(terms, t))), ' ') AS dropped FROM q""",
)
def grounding_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a document that the next one of its source lacks, and the other way round."""
    from evidgrid.operators.skew import previous_value

    terms = texts(spark, sf_dir).select(
        "doc_id", "source", (-F.col("doc_id")).alias("back"), extract_terms("text", WORD_PATTERN).alias("terms")
    )
    paired = previous_value(terms, ["source"], ["back"], "terms", "other").where("other is not null")
    missing = ru.unsupported_terms(F.col("terms"), F.col("other"), synonyms=SYNONYMS)
    return paired.select(
        "doc_id",
        F.array_join(F.sort_array(missing), " ").alias("unsupported"),
        F.array_join(F.sort_array(ru.dropped_terms(F.col("other"), F.col("terms"))), " ").alias("dropped"),
    )


@query(
    "best_support",
    f"""WITH w AS (SELECT item_id, {SQL_WORDS} AS terms FROM benchmark),
e AS (SELECT doc_id, n_chars, {SQL_WORDS} AS terms FROM documents),
x AS (SELECT item_id, terms AS need, unnest(terms) AS term FROM w),
y AS (SELECT doc_id, n_chars, terms AS have, unnest(terms) AS term FROM e),
c AS (SELECT item_id, term, doc_id, n_chars, len(list_intersect(need, have)) AS overlap FROM x JOIN y USING (term))
SELECT item_id, term, doc_id FROM c WHERE overlap >= 2
QUALIFY row_number() OVER (PARTITION BY item_id, term ORDER BY overlap DESC, n_chars DESC, doc_id DESC) = 1""",
)
def best_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every word of a passage the document that shares most of the passage's words."""
    wanted = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("key"), extract_terms("text", WORD_PATTERN).alias("terms")
    )
    events = texts(spark, sf_dir).select(
        F.col("doc_id").alias("event_id"),
        extract_terms("text", WORD_PATTERN).alias("terms"),
        F.lit(3).alias("authority"),
        F.col("n_chars").alias("correction_score"),
        F.lit(1).alias("corroboration"),
        F.lit(0).alias("ts"),
    )
    found = ru.best_support(wanted.withColumn("all_terms", F.col("terms")), events, 2)
    return found.select(F.col("key").alias("item_id"), "term", F.col("event_id").alias("doc_id"))


@query(
    "baseline_support",
    f"""WITH w AS (SELECT DISTINCT unnest({SQL_WORDS}) AS term FROM benchmark),
d AS (SELECT doc_id, unnest({SQL_WORDS}) AS term FROM documents)
SELECT term, CAST(count(*) AS BIGINT) AS blocks, CAST(min(doc_id) AS BIGINT) AS first_block FROM d JOIN w USING (term) GROUP BY term""",
)
def baseline_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "benchmark").select(extract_terms("text", WORD_PATTERN).alias("terms"))
    kept = texts(spark, sf_dir).select(
        F.col("doc_id").alias("block_id"), extract_terms("text", WORD_PATTERN).alias("terms")
    )
    return ru.baseline_support(wanted, kept)


@query(
    "tie_detection",
    """WITH o AS (SELECT o_custkey, o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INT) AS authority, o_orderstatus AS scope, o_orderdate AS ts FROM orders),
g AS (SELECT o_custkey, count(*) AS n, min(authority) = max(authority) AS a, min(scope) = max(scope) AS s, min(ts) = max(ts) AS t FROM o GROUP BY o_custkey),
w AS (SELECT o_custkey, o_orderkey FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY authority, ts DESC, o_orderkey DESC) = 1)
SELECT g.o_custkey AS conflict_id, CASE WHEN n < 2 THEN 'invalid_decision_request' WHEN a AND s AND t THEN 'unresolved' ELSE 'decision_precedence_determined' END AS status,
  CASE WHEN n < 2 THEN NULL WHEN NOT a THEN 'authority' WHEN NOT s THEN 'scope' WHEN NOT t THEN 'time' END AS decided_by,
  CASE WHEN n >= 2 AND NOT (a AND s AND t) THEN w.o_orderkey END AS winner
FROM g JOIN w ON g.o_custkey = w.o_custkey""",
)
def tie_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as evidence of one conflict: priority, status and date decide."""
    orders = table(spark, sf_dir, "orders")
    events = orders.select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_custkey").alias("conflict_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("authority"),
        F.col("o_orderstatus").alias("scope"),
        F.col("o_orderdate").alias("ts"),
    )
    conflicts = orders.groupBy(F.col("o_custkey").alias("conflict_id")).agg(
        F.sort_array(F.collect_list("o_orderkey")).alias("evidence_ids")
    ).withColumn("block_ids", F.array(F.lit(1), F.lit(2)))
    found = ru.conflict_ties(conflicts, events.drop("conflict_id"))
    return found.select("conflict_id", "status", "decided_by", "winner")


@query(
    "evidence_fingerprint",
    """WITH t AS (SELECT conv_id, '{"content_sha256":"' || sha256(text) || '","id":"' || lpad(CAST(turn AS VARCHAR), 4, '0') || '","timestamp":"' ||
  strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(turn), '%Y-%m-%dT%H:%M:%SZ') || '"}' AS m, turn FROM conversations)
SELECT conv_id, sha256('[' || string_agg(m, ',' ORDER BY turn) || ']' || chr(10)) AS evidence_fingerprint FROM t GROUP BY conv_id""",
)
def evidence_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the ordered (hash, id, time) list per conversation."""
    from evidgrid.functions.identity import content_sha

    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    events = table(spark, sf_dir, "conversations").select(
        "conv_id",
        F.lpad(F.col("turn").cast("string"), 4, "0").alias("event_id"),
        (start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("turn"))).alias("ts"),
        content_sha("text").alias("content_sha256"),
    )
    return ru.evidence_fingerprint(events, ["conv_id"])


@query(
    "defect_algebra",
    """WITH o AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderstatus = 'F'))) AS confirmed,
  list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderstatus = 'O'))) AS remaining FROM orders GROUP BY o_custkey)
SELECT o_custkey, array_to_string(list_filter(coalesce(confirmed, []), lambda t: NOT list_contains(coalesce(remaining, []), t)), ',') AS resolved,
  array_to_string(list_filter(coalesce(confirmed, []), lambda t: list_contains(coalesce(remaining, []), t)), ',') AS unresolved FROM o""",
)
def defect_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set algebra of classes: priorities of finished orders against those of open ones."""
    orders = table(spark, sf_dir, "orders")
    sets = orders.groupBy("o_custkey").agg(
        F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("confirmed"),
        F.collect_set(F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))).alias("remaining"),
    )
    none = strings([])
    result = ru.defect_outcome(F.col("confirmed"), none, F.col("remaining"), none)
    return sets.select("o_custkey", result.alias("r")).select(
        "o_custkey",
        F.array_join("r.resolved", ",").alias("resolved"),
        F.array_join("r.unresolved", ",").alias("unresolved"),
    )


SIZES_SQL = f"""
p AS (SELECT doc_id, source, text, {SQL_NORMAL} AS post FROM documents),
m AS (SELECT source, octet_length(encode(text)) AS pre_bytes, octet_length(encode(post)) AS post_bytes,
  CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END AS pre_lines,
  CASE WHEN post = '' THEN 0 ELSE 1 END AS post_lines FROM p)"""


@query(
    "before_after_metrics",
    f"""WITH {SIZES_SQL}
SELECT source AS doc, CAST(grouping(source) AS INTEGER) AS is_total, CAST(sum(pre_bytes) AS BIGINT) AS pre_bytes, CAST(sum(post_bytes) AS BIGINT) AS post_bytes,
  CAST(sum(post_bytes) - sum(pre_bytes) AS BIGINT) AS bytes_delta, CAST(sum(pre_lines) AS BIGINT) AS pre_lines, CAST(sum(post_lines) AS BIGINT) AS post_lines,
  CAST(sum(post_lines) - sum(pre_lines) AS BIGINT) AS lines_delta, CAST(count(*) AS BIGINT) AS pre_blocks
FROM m GROUP BY GROUPING SETS ((source), ())""",
)
def before_after_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes per source and in total before and after normalization."""
    documents = texts(spark, sf_dir).select("source", "text", normalize_block("text").alias("post"))

    def sizes(column: str) -> DataFrame:
        parts = documents.select(F.col("source").alias("doc"), F.col(column).alias("content"))
        return (
            mt.document_sizes(parts)
            .groupBy("doc")
            .agg(F.count("*").alias("blocks"), F.sum("bytes").alias("bytes"), F.sum("lines").alias("lines"))
        )

    found = mt.before_after(sizes("text"), sizes("post"))
    return found.select(
        "doc",
        F.col("is_total").cast("int").alias("is_total"),
        "pre_bytes",
        "post_bytes",
        "bytes_delta",
        "pre_lines",
        "post_lines",
        "lines_delta",
        "pre_blocks",
    )


@query(
    "document_gates",
    """WITH p AS (SELECT doc_id, text, CASE WHEN doc_id % 10 = 0 THEN substr(text, 1, length(text) // 3) WHEN doc_id % 10 = 1 THEN '' WHEN doc_id % 10 = 2 THEN text || repeat('x', 5000) ELSE text END AS post FROM documents),
z AS (SELECT doc_id, octet_length(encode(text)) AS a, octet_length(encode(post)) AS b, regexp_matches(text, '[^\\s]') AS x, regexp_matches(post, '[^\\s]') AS y FROM p)
SELECT doc_id, CASE WHEN x AND NOT y THEN 'empty_target' WHEN a > 0 AND (b < a * 0.4 OR b > greatest(a * 1.2, a + 4096)) THEN 'size_ratio' END AS code FROM z""",
)
def document_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates over shortened, emptied, grown and untouched documents."""
    kind = F.col("doc_id") % 10
    post = (
        F.when(kind == 0, F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 3).cast("int")))
        .when(kind == 1, "")
        .when(kind == 2, F.concat("text", F.repeat(F.lit("x"), F.lit(5000))))
        .otherwise(F.col("text"))
    )
    pairs = texts(spark, sf_dir).select("doc_id", F.col("text").alias("pre"), post.alias("post"))
    return mt.document_gates(pairs).select("doc_id", "code")


@query(
    "byte_budget",
    """SELECT CAST(count(*) AS BIGINT) AS documents, CAST(sum(octet_length(encode(text))) AS BIGINT) AS post_bytes, CAST(1000000 AS BIGINT) AS "limit",
  CASE WHEN sum(octet_length(encode(text))) > 1000000 THEN 'instruction_budget' ELSE 'within_budget' END AS status FROM documents WHERE lang = 'en'""",
)
def byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = texts(spark, sf_dir).select("lang", utf8_bytes("text").alias("bytes"))
    return mt.byte_budget(sized, F.col("lang") == "en", 1_000_000)


@query(
    "budget_packing",
    """WITH t AS (SELECT conv_id, turn, role, octet_length(encode(text)) AS cost, role = 'system' AS req FROM conversations),
f AS (SELECT conv_id, coalesce(sum(cost) FILTER (req), 0) AS fixed FROM t GROUP BY conv_id),
r AS (SELECT t.*, fixed, sum(CASE WHEN req THEN 0 ELSE cost END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS run FROM t JOIN f USING (conv_id))
SELECT conv_id, turn, req OR run + fixed <= 3000 AS kept, fixed > 3000 AS over_budget FROM r""",
)
def budget_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest turns of a conversation within 3000 bytes; system turns always stay."""
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", (-F.col("turn")).alias("age"), "role", utf8_bytes("text").alias("cost")
    )
    packed = mt.pack_budget(turns, ["conv_id"], ["age"], F.col("cost"), 3000, F.col("role") == "system")
    return packed.select("conv_id", "turn", "kept", "over_budget")


@query(
    "consistent_overlaps",
    """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def consistent_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose reference was kept (semi join)."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), "l_linenumber")
    kept = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return mt.keep_consistent(lines, kept).select(F.col("event_id").alias("l_orderkey"), "l_linenumber")


@query(
    "dropped_ids",
    """SELECT doc_id AS event_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM documents WHERE n_chars < 400""",
)
def dropped_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("event_id"))
    short = table(spark, sf_dir, "documents").where("n_chars < 400").select(F.col("doc_id").alias("event_id"))
    return mt.dropped_ids(toxic, short)


@query(
    "disposition_counts",
    """WITH c AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'replace' WHEN 'O' THEN 'remove' ELSE 'relocate' END AS action, 1 + o_orderkey % 3 AS n FROM orders)
SELECT CAST((SELECT count(*) FROM customer) AS BIGINT) AS keep, CAST(coalesce(sum(n) FILTER (action = 'replace'), 0) AS BIGINT) AS replace,
  CAST(coalesce(sum(n) FILTER (action = 'remove'), 0) AS BIGINT) AS remove, CAST(coalesce(sum(n) FILTER (action = 'relocate'), 0) AS BIGINT) AS relocate, CAST(0 AS BIGINT) AS escalate FROM c""",
)
def disposition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    action = F.when(F.col("o_orderstatus") == "F", "replace").when(F.col("o_orderstatus") == "O", "remove").otherwise("relocate")
    sources = F.sequence(F.lit(0), (F.col("o_orderkey") % 3).cast("int"))
    changes = orders.select(action.alias("action"), sources.alias("source_ids"))
    return mt.disposition_counts(table(spark, sf_dir, "customer"), changes)


RUNS_SQL = """
r AS (SELECT o_custkey AS run_id, count(*) AS pre_blocks, count(*) FILTER (o_orderstatus = 'F') AS changed, count(*) FILTER (o_orderpriority LIKE '1%') AS escalated,
  count(*) FILTER (o_orderstatus = 'P') AS confirmed_left, count(*) FILTER (o_orderpriority LIKE '5%') AS nominations, count(*) FILTER (o_orderpriority LIKE '4%') AS rejected
  FROM orders GROUP BY o_custkey)"""


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs, their orders as dispositions."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(
        F.count("*").alias("pre_blocks"),
        F.count_if(status == "F").alias("changed"),
        F.count_if(priority.startswith("1")).alias("escalated"),
        F.count_if(status == "P").alias("confirmed_left"),
        F.count_if(priority.startswith("5")).alias("nominations"),
        F.count_if(priority.startswith("4")).alias("nominations_rejected"),
    )


@query(
    "run_gates",
    f"""WITH {RUNS_SQL}
SELECT run_id, CASE WHEN changed > 0 AND confirmed_left > 0 THEN 'non_idempotent_proposal'
  WHEN changed > greatest(1, floor(pre_blocks * 0.65)) THEN 'excessive_churn' END AS code FROM r""",
)
def run_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = order_runs(spark, sf_dir).withColumn("post_blocks", F.col("pre_blocks")).withColumn("introductions", F.lit(0))
    return mt.run_gates(runs).select("run_id", "code")


@query(
    "run_outcomes",
    f"""WITH {RUNS_SQL},
o AS (SELECT run_id, escalated, CASE WHEN changed > 3 THEN 'reversible_change_ready' WHEN escalated > 0 THEN 'enforcement_candidates'
  WHEN confirmed_left = 0 AND nominations = 0 AND rejected > 0 THEN 'semantic_analysis_inconclusive' WHEN confirmed_left = 0 AND nominations = 0 THEN 'stable_noop'
  WHEN confirmed_left > 0 THEN 'reviewed_noop' ELSE 'semantic_review_required' END AS outcome FROM r)
SELECT run_id, outcome, outcome IN ('enforcement_candidates', 'reviewed_noop', 'semantic_analysis_inconclusive', 'semantic_review_required') OR escalated > 0 AS action_required FROM o""",
)
def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = order_runs(spark, sf_dir)
    classes = F.when(F.col("confirmed_left") > 0, F.array(F.lit("exact_duplicate"))).otherwise(strings([]))
    prepared = (
        runs.withColumn("changed", F.greatest(F.col("changed") - 3, F.lit(0)))
        .withColumn("rejected", F.lit(False))
        .withColumn("defect_classes", classes)
        .withColumn("confirmed_classes", classes)
    )
    return mt.run_outcome(prepared).select("run_id", "outcome", "action_required")


@query(
    "reversibility",
    f"""WITH {RUNS_SQL}
SELECT run_id, CASE WHEN changed > 0 AND changed <= 2 AND changed <= greatest(1, floor(pre_blocks * 0.25)) AND confirmed_left = 0 AND escalated = 0 THEN 'unattended' ELSE 'attended' END AS mode FROM r""",
)
def reversibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    false = F.lit(False)
    runs = order_runs(spark, sf_dir).select(
        "run_id",
        "pre_blocks",
        "changed",
        F.col("changed").alias("writable_changes"),
        F.col("changed").alias("changed_sources"),
        F.lit(0).alias("suggestions"),
        (F.col("escalated") == 0).alias("harmless"),
        F.lit(0).alias("confirmations"),
        (F.col("confirmed_left") > 0).alias("blocked"),
        F.lit(0).alias("conflicts"),
        false.alias("decision"),
        false.alias("operator_decision"),
    )
    return mt.reversibility(runs).select("run_id", "mode")


@query(
    "usage_totals",
    """WITH u AS (SELECT user_id, count(*) AS calls, sum(CAST(floor(value) AS BIGINT)) AS input_tokens, sum(CAST(floor(value / 2) AS BIGINT)) AS output_tokens FROM events GROUP BY user_id)
SELECT user_id, CAST(calls AS BIGINT) AS calls, CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens,
  CASE WHEN calls > 70 THEN 'call_budget_exceeded' WHEN input_tokens > 1300 THEN 'input_budget_exceeded' WHEN output_tokens > 600 THEN 'output_budget_exceeded' END AS code FROM u""",
)
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.floor("value").cast("long")
    calls = table(spark, sf_dir, "events").select(
        "user_id",
        F.lit(1).alias("calls"),
        tokens.alias("estimated_input"),
        tokens.alias("input_tokens"),
        F.floor(F.col("value") / 2).cast("long").alias("output_tokens"),
    )
    return mt.usage_totals(calls, ["user_id"], 70, 1300, 600).select(
        "user_id", "calls", "input_tokens", "output_tokens", "code"
    )


# --- rule tables over proposals derived from the labels ---------------------------------------------


def cited_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as blocks and as events."""
    documents = texts(spark, sf_dir)
    key = F.col("doc_id").cast("string")
    blocks = documents.select(
        key.alias("block_id"),
        F.col("lang").alias("doc"),
        F.array("source").alias("heading_path"),
        F.col("text").alias("raw"),
        (F.col("doc_id") % 13 == 0).alias("protected"),
    )
    events = documents.select(
        key.alias("event_id"),
        "text",
        F.lit("history").alias("source_kind"),
        F.col("source").alias("session_id"),
        F.concat(F.lit("documents:"), key).alias("locator"),
        (F.col("doc_id") % 3).cast("int").alias("correction_score"),
        (F.col("doc_id") % 2).cast("int").alias("directive_score"),
        F.lit(3).alias("authority"),
        F.lit(1).alias("corroboration"),
        F.lit("2024-01-01").cast("timestamp").alias("ts"),
        F.sha2("text", 256).alias("content_sha256"),
    )
    return blocks, events


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the letters of the shortest line of their document, the first one among equals."""
    from evidgrid.functions.text import collapse_spaces

    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(F.length(line).alias("n"), i.alias("i"), line.alias("line")),
    )
    heads = texts(spark, sf_dir).select(
        "doc_id",
        "lang",
        "source",
        collapse_spaces(F.regexp_replace(F.array_min(lines)["line"], r"[^\p{L} ]", " ")).alias("head"),
    )
    return table(spark, sf_dir, "labels").join(heads, "doc_id")


def sql_analyst_terms(text: str) -> str:
    from evidgrid import lexicon as lx
    from evidgrid.queries.text_queries import SQL_NORMAL

    normal = SQL_NORMAL.replace("(text,", f"({text},")
    return (
        f"list_distinct(list_filter(regexp_extract_all({normal}, '[\\p{{L}}\\p{{N}}]+'), "
        f"lambda t: length(t) >= 3 AND NOT list_contains({sql_list(lx.ANALYST_STOP)}, t)))"
    )


def checked_nominations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nominations built from all labels: class by number, one source, evidence of twice the number."""
    from evidgrid import lexicon as lx

    blocks, events = cited_tables(spark, sf_dir)
    key = F.col("doc_id").cast("string")
    kinds = strings(list(lx.CANDIDATE_CLASSES))
    kind = F.element_at(kinds, (F.col("doc_id") % len(lx.CANDIDATE_CLASSES) + 1).cast("int"))
    planted = F.when(F.col("doc_id") % 17 == 0, " password=planted-value-9").otherwise("")
    nominations = labelled(spark, sf_dir).select(
        F.col("doc_id").alias("index"),
        kind.alias("candidate_class"),
        F.when(F.col("quality") == 1, "git").otherwise("other").alias("domain"),
        F.when(kind == "missing_rule", strings([])).otherwise(F.array(key)).alias("source_ids"),
        F.array(key, (F.col("doc_id") * 2).cast("string")).alias("evidence_ids"),
        F.concat("head", planted).alias("behavioral_intent"),
        F.lit("from a label").alias("reason"),
        F.col("lang").alias("applies_when"),
        F.col("source").alias("does_not_apply_when"),
    )
    return ru.validate_nominations(nominations, blocks, events)


@query(
    "nomination_checks",
    f"""WITH h AS (SELECT doc_id, arg_min(line, length(line) * 1000000 + i) AS line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY doc_id),
d AS (SELECT doc_id, source, text, {sql_analyst_terms("text")} AS terms FROM documents),
n AS (SELECT l.doc_id, ['contradiction', 'temporal_supersession', 'underspecified', 'overspecified', 'wrong_scope', 'enforcement_candidate', 'missing_rule'][CAST(l.doc_id % 7 + 1 AS INTEGER)] AS kind,
  trim(regexp_replace(regexp_replace(h.line, '[^\\p{{L}} ]', ' ', 'g'), '\\s+', ' ', 'g')) || CASE WHEN l.doc_id % 17 = 0 THEN ' password=planted-value-9' ELSE '' END AS head
  FROM labels l JOIN h USING (doc_id)),
j AS (SELECT n.*, a.source AS s1, b.source AS s2, b.doc_id IS NULL AS unknown, {sql_analyst_terms("n.head")} AS intent,
  list_concat(a.terms, coalesce(b.terms, [])) AS grounds,
  length(trim(a.text)) < 12 OR len(a.terms) < 2 OR coalesce(length(trim(b.text)) < 12 OR len(b.terms) < 2, false) AS small
  FROM n JOIN d a USING (doc_id) LEFT JOIN d b ON b.doc_id = 2 * n.doc_id)
SELECT doc_id AS index, kind AS candidate_class,
  CASE WHEN kind <> 'missing_rule' AND doc_id % 13 = 0 THEN 'protected_change'
    WHEN unknown THEN 'unknown_evidence'
    WHEN doc_id = 0 THEN 'duplicate_evidence'
    WHEN small THEN 'insufficient_evidence_text'
    WHEN head = '' OR length(head) > 2000 THEN 'invalid_semantic_nomination'
    WHEN doc_id % 17 = 0 THEN 'secret_in_semantic_nomination'
    WHEN len(list_intersect(intent, grounds)) < 3 THEN 'ungrounded_semantic_intent'
    WHEN kind = 'missing_rule' AND (doc_id % 3 = 0 OR s1 = s2) THEN 'insufficient_missing_rule_evidence'
    WHEN kind = 'temporal_supersession' AND doc_id % 3 = 0 THEN 'unproven_temporal_supersession'
    WHEN kind = 'enforcement_candidate' AND s1 = s2 THEN 'insufficient_escalation_lineage' END AS code,
  CASE WHEN kind = 'missing_rule' THEN 'suggestion_candidate' ELSE 'mutable_candidate' END AS admission,
  CASE WHEN kind = 'missing_rule' THEN 'evidence_grounded_reversible_introduction' ELSE 'same_target_same_heading_sources' END AS admission_reason
FROM j""",
)
def nomination_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nominations built from all labels: class by number, one source, evidence of twice the number."""
    checked = checked_nominations(spark, sf_dir)
    return checked.select("index", "candidate_class", "code", "admission", "admission_reason")


def sql_pattern(pattern: str) -> str:
    """A pattern of the lexicon as an SQL literal; DuckDB has no flag U."""
    return "'" + pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''") + "'"


def sql_found(text: str, pattern: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({text}, {sql_pattern(pattern)}), lambda t: lower(t)))"


def sql_lacking(terms: str, *known: str) -> str:
    """Whether a term stands in none of the known lists."""
    held = " OR ".join(f"list_contains({k}, t)" for k in known)
    return f"len(list_filter({terms}, lambda t: NOT coalesce({held}, false))) > 0"


def sql_matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {sql_pattern(pattern)})"


def sql_phrases(text: str) -> str:
    """Open-ended phrases of a text."""
    from evidgrid import lexicon as lx

    either = "|".join(f"(?:{p.replace('(?U)', '')})" for p in lx.CATCH_ALL_PATTERNS)
    return sql_found(SQL_NORMAL.replace("(text,", f"({text},"), either)


def sql_changes() -> str:
    """Reject codes of the changes of ``change_checks``, one source and one piece of evidence each."""
    from evidgrid import lexicon as lx

    def words(text: str) -> str:
        return f"regexp_extract_all({SQL_NORMAL.replace('(text,', f'({text},')}, '[\\p{{L}}\\p{{N}}]+')"

    phrases, matches = sql_phrases, sql_matches
    scope = sql_list(lx.UNIVERSAL_SCOPE_TERMS)
    return f"""WITH h AS (SELECT doc_id, arg_min(line, length(line) * 1000000 + i) AS line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY doc_id),
d AS (SELECT doc_id, text, {sql_found("text", lx.ACTION_PATTERN)} AS actions, {sql_found("text", lx.INTENSIFIER_PATTERN)} AS force, {phrases("text")} AS loose,
  length(trim(text)) >= 12 AND len(list_distinct(list_filter({words("text")}, lambda t: length(t) >= 3))) >= 2 AS solid FROM documents),
known AS (SELECT list_distinct(flatten(list(actions))) AS actions FROM d),
c AS (SELECT l.doc_id, l.toxic, CASE WHEN l.doc_id % 2 = 0 THEN 'remove' ELSE 'replace' END AS action,
  CASE WHEN l.doc_id % 2 = 0 THEN '' ELSE trim(regexp_replace(regexp_replace(h.line, '[^\\p{{L}} ]', ' ', 'g'), '\\s+', ' ', 'g')) END AS body
  FROM labels l JOIN h USING (doc_id)),
j AS (SELECT c.*, {words("c.body")} AS w, {sql_found("c.body", lx.ACTION_PATTERN)} AS acts, {sql_found("c.body", lx.INTENSIFIER_PATTERN)} AS strong, {phrases("c.body")} AS open,
  a.text AS src, a.actions AS src_acts, a.loose AS src_loose, b.text AS ev, b.solid, coalesce(b.actions, []) AS ev_acts, coalesce(b.loose, []) AS ev_loose,
  CASE WHEN list_has_any(list_concat(a.force, coalesce(b.force, [])), {scope}) THEN list_concat(a.force, coalesce(b.force, []), {scope})
    ELSE list_concat(a.force, coalesce(b.force, [])) END AS known_force, known.actions AS known_acts
  FROM c JOIN d a USING (doc_id) LEFT JOIN d b ON b.doc_id = 2 * c.doc_id CROSS JOIN known)
SELECT doc_id AS index, action,
  CASE WHEN doc_id % 13 = 0 THEN 'protected_change'
    WHEN action = 'replace' AND len(w) > 8 AND len(list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')))) < len(w) - 7 THEN 'repeated_replacement_phrase'
    WHEN action = 'replace' AND body = '' THEN 'empty_replacement'
    WHEN {matches("body", lx.SELF_ATTESTED_PATTERN)} AND NOT {matches("body", lx.EXTERNAL_CRITERION_PATTERN)} THEN 'undefined_verification_gate'
    WHEN toxic = 1 THEN 'missing_reason'
    WHEN ev IS NULL THEN 'unknown_evidence'
    WHEN NOT solid THEN 'insufficient_evidence_text'
    WHEN {matches("src", lx.OPT_IN_PATTERN)} AND {matches("ev", lx.CHANGE_REVERSAL_PATTERN)} AND {matches("body", lx.OPT_IN_PATTERN)} THEN 'retained_reversed_clause'
    WHEN {sql_lacking("strong", "known_force")} THEN 'unsupported_intensifier'
    WHEN {matches("ev", lx.CHANGE_REVERSAL_PATTERN)} AND {sql_lacking("ev_acts", "acts")} THEN 'dropped_explicit_action'
    WHEN {sql_lacking("open", "src_loose", "ev_loose")} THEN 'unsupported_action_catch_all'
    WHEN {sql_lacking("acts", "src_acts", "ev_acts", "known_acts")} THEN 'ungrounded_operational_action'
    WHEN len(list_filter(list_intersect(acts, {sql_list(lx.HIGH_IMPACT_ACTIONS)}), lambda t: NOT list_contains(src_acts, t))) > 0 THEN 'undefined_high_impact_gate' END AS code,
  CAST(0 AS BIGINT) AS lineage_depth, false AS source_only_consolidation FROM j"""


@query("change_checks", sql_changes())
def change_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes built from all labels: removals and replacements with evidence of twice the number."""
    blocks, events = cited_tables(spark, sf_dir)
    key = F.col("doc_id").cast("string")
    action = F.when(F.col("doc_id") % 2 == 0, "remove").otherwise("replace")
    rows = labelled(spark, sf_dir)
    changes = rows.select(
        F.col("doc_id").alias("index"),
        action.alias("action"),
        F.array(key).alias("source_ids"),
        F.when(action == "replace", F.col("head")).otherwise("").alias("replacement"),
        F.lit(None).cast("string").alias("screened"),
        F.col("lang").alias("destination"),
        F.array("source").alias("heading_path"),
        F.array((F.col("doc_id") * 2).cast("string")).alias("evidence_ids"),
        F.when(F.col("toxic") == 1, " ").otherwise("from a label").alias("reason"),
        F.lit("attended").alias("minimum_apply_mode"),
        F.lit("").alias("enforcement_target"),
        F.lit("").alias("deterministic_check"),
        F.lit("").alias("relocation_basis"),
    )
    keep = blocks.select("block_id").join(rows.select(key.alias("block_id")), "block_id", "left_anti")
    targets = table(spark, sf_dir, "documents").select(F.col("lang").alias("doc"), F.lit(False).alias("scoped")).distinct()
    checked = ru.validate_changes(changes, keep, blocks, events, targets)
    return checked.select("index", "action", "code", "lineage_depth", "source_only_consolidation")


def sql_suggestions() -> str:
    """Reject codes of the suggestions of ``suggestion_checks``, on the SQL of the nominations."""
    from evidgrid import lexicon as lx

    return f"""WITH n AS ({ORACLES["nomination_checks"]}),
h AS (SELECT doc_id, arg_min(line, length(line) * 1000000 + i) AS line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY doc_id),
r AS (SELECT l.doc_id, l.toxic, again, d.source, l.doc_id + again * 1000000000 AS index,
  trim(regexp_replace(regexp_replace(h.line, '[^\\p{{L}} ]', ' ', 'g'), '\\s+', ' ', 'g')) || CASE WHEN l.doc_id % 4 = 1 THEN ' and so on' ELSE '' END
    || CASE WHEN l.doc_id % 5 = 1 THEN ' then deploy' ELSE '' END AS rendered, d.text || chr(10) || coalesce(b.text, '') AS support, n.index IS NOT NULL AS known
  FROM labels l JOIN h USING (doc_id) JOIN documents d USING (doc_id) LEFT JOIN documents b ON b.doc_id = 2 * l.doc_id
  JOIN (VALUES (0), (1)) AS t(again) ON again = 0 OR l.doc_id % 3 = 1
  LEFT JOIN n ON n.index = l.doc_id AND n.code IS NULL AND n.candidate_class = 'missing_rule' AND n.admission = 'suggestion_candidate')
SELECT index, CASE WHEN NOT known THEN 'unknown_missing_rule_nomination'
    WHEN again = 1 THEN 'duplicate_new_rule_suggestion'
    WHEN doc_id % 9 = 0 THEN 'target_not_allowlisted'
    WHEN toxic = 1 THEN 'missing_reason'
    WHEN {sql_lacking(sql_found("rendered", lx.ACTION_PATTERN), sql_found("support", lx.ACTION_PATTERN))} THEN 'ungrounded_operational_action'
    WHEN {sql_lacking(sql_phrases("rendered"), sql_phrases("support"))} THEN 'unsupported_action_catch_all'
    WHEN doc_id % 2 = 0 AND NOT {sql_matches("support", lx.INVARIANT_SUPPORT_PATTERN)} THEN 'unsupported_normative_force' END AS code,
  {sql_matches("source || chr(10) || rendered || chr(10) || CASE WHEN toxic = 1 THEN ' ' ELSE 'from a label' END", lx.CONSEQUENTIAL_PATTERN)} AS requires_confirmation FROM r"""


@query("suggestion_checks", sql_suggestions())
def suggestion_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or two suggestions for every label, each for the checked nomination of its number."""
    _, events = cited_tables(spark, sf_dir)
    number = F.col("doc_id")
    nominations = checked_nominations(spark, sf_dir).withColumn("nomination_id", F.col("index").cast("string"))
    again = F.when(number % 3 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    endings = [F.when(number % 4 == 1, " and so on").otherwise(""), F.when(number % 5 == 1, " then deploy").otherwise("")]
    suggestions = labelled(spark, sf_dir).withColumn("again", F.explode(again)).select(
        (number + F.col("again") * 1_000_000_000).alias("index"),
        number.cast("string").alias("nomination_id"),
        F.when(number % 2 == 0, "MUST").otherwise("SHOULD").alias("keyword"),
        F.concat("head", *endings).alias("rendered"),
        F.when(F.col("toxic") == 1, " ").otherwise("from a label").alias("reason"),
        F.when(number % 9 == 0, "elsewhere").otherwise(F.col("lang")).alias("destination"),
        F.array("source").alias("heading_path"),
    )
    targets = table(spark, sf_dir, "documents").select(F.col("lang").alias("doc"))
    checked = ru.validate_suggestions(suggestions, nominations, events, targets)
    return checked.select("index", "code", "requires_confirmation")


def sql_collisions(first: list[str], second: list[str]) -> str:
    """Collisions as defined: every text with a sign or an exclusive word against the others of its source."""
    from evidgrid import lexicon as lx

    families = " ".join(f"WHEN '{word}' THEN '{family}'" for word, family in lx.DECISION_FAMILIES.items())
    terms = (
        "list_distinct(list_transform(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_-]*'), lambda t: lower(t)), "
        f"lambda t: length(t) >= 3 AND NOT list_contains({sql_list(lx.DECISION_STOP)}, t)), lambda t: CASE t {families} ELSE t END))"
    )
    a, b, both = sql_list(first), sql_list(second), sql_list(first + second)
    return f"""WITH d AS (SELECT source, {terms} AS terms,
  CASE WHEN regexp_matches(text, {sql_pattern(lx.DECISION_NEGATIVE_PATTERN)}) THEN -1 WHEN regexp_matches(text, {sql_pattern(lx.DECISION_POSITIVE_PATTERN)}) THEN 1 ELSE 0 END AS sign,
  regexp_matches(text, {sql_pattern(lx.DECISION_INCOMPATIBLE_PATTERN)}) AS stated, regexp_matches(text, {sql_pattern(lx.DECISION_EXCLUSIVE_PATTERN)}) AS exclusive FROM documents),
t AS (SELECT *, list_intersect(terms, {both}) AS hit FROM d),
g AS (SELECT source, bool_or(list_has_any(terms, {a})) AND bool_or(list_has_any(terms, {b})) AS grounded,
  bool_or(stated AND list_has_any(terms, {a}) AND list_has_any(terms, {b})) AS stated FROM t GROUP BY source),
p AS (SELECT DISTINCT x.source FROM t x JOIN t y ON x.source = y.source AND len(list_intersect(x.hit, y.hit)) >= 2
  AND (x.sign = 1 AND y.sign = -1 OR x.exclusive AND len(list_intersect(x.terms, y.terms)) < least(len(x.terms), len(y.terms)))
  WHERE len(x.hit) >= 2 AND len(y.hit) >= 2 AND (x.sign = 1 OR x.exclusive))
SELECT g.source AS conflict_id, grounded AND (stated OR p.source IS NOT NULL) AS collides FROM g LEFT JOIN p USING (source)"""


@query("structural_collisions", sql_collisions(["tion"], ["mit", "der", "von"]))
def structural_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the documents of a source contain texts that exclude each other on two subjects."""
    documents = texts(spark, sf_dir)
    conflicts = documents.select(F.col("source").alias("conflict_id")).distinct().select(
        "conflict_id", F.lit("with the tion").alias("subject_a"), F.lit("mit der von").alias("subject_b")
    )
    grounding = documents.select(
        F.col("source").alias("conflict_id"), F.col("doc_id").alias("text_id"), "text"
    )
    return ru.structural_collisions(conflicts, grounding)
