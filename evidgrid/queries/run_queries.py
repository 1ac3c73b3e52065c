"""Suites over recorded actions, run logs, snapshots and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidgrid.functions.exprs import strings
from evidgrid.functions.identity import content_sha
from evidgrid.functions.text import normalize_block
from evidgrid.operators import ingest as ing
from evidgrid.operators import runs as rn
from evidgrid.operators import suite as su
from evidgrid.queries.base import query, table, texts
from evidgrid.queries.text_queries import SQL_NORMAL

TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "sequence_conformance",
    """WITH p AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, min(ts) AS t FROM events GROUP BY ALL),
d AS (SELECT user_id, day, array_to_string(list(event_type ORDER BY t, event_type), '>') AS actions,
  max(t) FILTER (event_type = 'view') AS v, max(t) FILTER (event_type = 'click') AS c, max(t) FILTER (event_type = 'purchase') AS b,
  max(t) FILTER (event_type = 'error') AS e FROM p GROUP BY user_id, day)
SELECT user_id, day, actions, concat_ws(';',
  CASE WHEN v IS NULL OR b IS NULL THEN 'missing:' || concat_ws(',', CASE WHEN v IS NULL THEN 'view' END, CASE WHEN b IS NULL THEN 'purchase' END) END,
  CASE WHEN e IS NOT NULL THEN 'forbidden:error' END,
  CASE WHEN v IS NOT NULL AND c IS NOT NULL AND b IS NOT NULL AND NOT (v < c AND c < b) THEN 'order' END) AS failures FROM d""",
)
def sequence_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First actions of every user and day against view -> click -> purchase without errors."""
    events = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    found = su.first_positions(events, ["user_id", "day"], "event_type", F.col("ts"), TYPES)
    failures = su.conformance(
        F.col("actions"),
        strings(["view", "purchase"]),
        strings(["error"]),
        strings(["view", "click", "purchase"]),
    )
    judged = found.withColumn("failures", F.array_join(failures, ";"))
    return judged.withColumn("actions", F.array_join("actions", ">"))


MATRIX_SQL = """
o AS (SELECT d.source AS case_id, CASE WHEN d.doc_id % 3 = 0 THEN 'control' WHEN d.doc_id % 3 = 1 THEN 'pre' ELSE 'post' END AS condition, l.quality = 1 AS passed
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
m AS (SELECT case_id, count(*) FILTER (condition = 'control' AND passed) AS control, count(*) FILTER (condition = 'pre' AND passed) AS pre,
  count(*) FILTER (condition = 'post' AND passed) AS post FROM o GROUP BY case_id)"""


def label_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    condition = F.element_at(
        F.array(F.lit("control"), F.lit("pre"), F.lit("post")), (F.col("doc_id") % 3 + 1).cast("int")
    )
    return table(spark, sf_dir, "labels").join(documents, "doc_id").select(
        F.col("source").alias("case_id"), condition.alias("condition"), (F.col("quality") == 1).alias("passed")
    )


@query("pass_matrix", f"WITH {MATRIX_SQL} SELECT case_id, control, pre, post FROM m")
def pass_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return su.pass_matrix(label_outcomes(spark, sf_dir))


@query(
    "verdicts",
    f"""WITH {MATRIX_SQL}
SELECT case_id, concat_ws(',', CASE WHEN post <> 4 THEN 'candidate_failed' END, CASE WHEN post < pre THEN 'behavior_regression' END,
  CASE WHEN control >= post THEN 'control_not_weaker' END) AS reasons, pre <> 4 AS baseline_gap, post > pre AS improvement FROM m""",
)
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = su.pass_matrix(label_outcomes(spark, sf_dir)).withColumn("control_must_underperform", F.lit(True))
    judged = su.verdicts(matrix, 4)
    return judged.select("case_id", F.array_join("reasons", ",").alias("reasons"), "baseline_gap", "improvement")


@query(
    "suite_status",
    f"""WITH {MATRIX_SQL}, j AS (SELECT post <> 4 OR post < pre OR control >= post AS bad, pre <> 4 AS gap, post > pre AS up FROM m)
SELECT CASE WHEN bool_or(bad) THEN 'failed' ELSE 'passed' END AS status, CAST(count(*) FILTER (bad) AS BIGINT) AS failed_cases,
  CAST(count(*) FILTER (gap) AS BIGINT) AS baseline_gaps, CAST(count(*) FILTER (up) AS BIGINT) AS improvements FROM j""",
)
def suite_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = su.pass_matrix(label_outcomes(spark, sf_dir)).withColumn("control_must_underperform", F.lit(True))
    return su.suite_status(su.verdicts(matrix, 4))


@query(
    "coverage_gaps",
    """SELECT page_id FROM pages WHERE NOT ((ends_with(url, '#top')) OR (ends_with(url, 'ref=x') AND contains(lower(regexp_extract(html, '<html[^>]*>')), 'lang="fr"')))""",
)
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that no (suffix, text) selector covers."""
    pages = texts(spark, sf_dir, "pages").select(
        "page_id", F.col("url").alias("doc"), F.array(F.regexp_extract("html", "<html[^>]*>", 0)).alias("heading_path")
    )
    selectors = spark.sql("""SELECT * FROM VALUES ('#top', '*'), ('ref=x', 'lang="fr"') AS s(suffix, contained)""")
    return su.coverage_gaps(pages, selectors).select("page_id")


@query(
    "contamination",
    """WITH d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents),
b AS (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS p FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON contains(t, p)""",
)
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages that occur verbatim in documents."""
    documents = texts(spark, sf_dir).select(F.col("doc_id").alias("text_id"), "text")
    phrases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase"))
    found = su.contained_phrases(documents, phrases)
    return found.select(F.col("text_id").alias("doc_id"), F.col("phrase_id").alias("item_id"))


@query(
    "detected_actions",
    """WITH t AS (SELECT conv_id, turn, lower(trim(regexp_replace(CASE WHEN conv_id % 4 = 0 THEN 'Never ' || text ELSE text END, '\\s+', ' ', 'g'))) AS t FROM conversations),
k AS (SELECT conv_id, turn, t, unnest(regexp_extract_all(t, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+')) AS w,
  generate_subscripts(regexp_extract_all(t, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+'), 1) AS i FROM t),
p AS (SELECT *, coalesce(sum(length(w)) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM k),
d(action, phrase) AS (VALUES ('link_with', 'with'), ('link_with', 'mit'), ('link_with', 'avec'), ('place_in', 'in'), ('place_in', 'dans'),
  ('and_then', 'and'), ('and_then', 'und'), ('and_then', 'et')),
c AS (SELECT conv_id, turn, action, pos, regexp_replace(regexp_split_to_array(substr(t, CAST(pos - least(pos, 160) + 1 AS BIGINT), CAST(least(pos, 160) AS BIGINT)),
  '[.;:!?\\n]|,\\s*(?:and|but|then)\\s+')[-1], '[`*_~()\\[\\]{}]', ' ', 'g') AS clause FROM p JOIN d ON p.w = d.phrase),
f AS (SELECT conv_id, turn, action, min(pos) AS pos FROM c WHERE NOT coalesce(regexp_matches(clause,
  '(?:^|[^\\p{L}\\p{N}_])(?:do not|don''t|never|avoid|without|rather than|instead of|not)(?:$|[^\\p{L}\\p{N}_])'), false) GROUP BY ALL),
g AS (SELECT conv_id, turn, string_agg(action, '>' ORDER BY pos) AS actions FROM f GROUP BY ALL)
SELECT conv_id, turn, coalesce(actions, '') AS actions FROM t LEFT JOIN g USING (conv_id, turn)""",
)
def detected_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affirmed phrases in all conversation turns; a quarter of the conversations starts negated."""
    detectors = {"link_with": ["with", "mit", "avec"], "place_in": ["in", "dans"], "and_then": ["and", "und", "et"]}
    said = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("Never "), "text")).otherwise(F.col("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array(said).alias("steps"))
    return su.detect(turns, detectors).select("conv_id", "turn", F.array_join("actions", ">").alias("actions"))


@query(
    "phrase_conflicts",
    """WITH p AS (SELECT lower(trim(p_type)) AS phrase, p_brand AS action FROM part)
SELECT phrase, min(action) AS first_action, max(action) AS last_action FROM p GROUP BY phrase HAVING min(action) <> max(action)""",
)
def phrase_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types that belong to more than one brand."""
    detectors = table(spark, sf_dir, "part").select(F.col("p_type").alias("phrase"), F.col("p_brand").alias("action"))
    return su.phrase_conflicts(detectors)


# --- runs -----------------------------------------------------------------------------------------


@query(
    "snapshot_drift",
    """WITH n AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 0
  UNION ALL SELECT -1 - o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 20 = 0)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed'
  WHEN o.o_totalprice = n.o_totalprice AND o.o_orderstatus = n.o_orderstatus THEN 'same' ELSE 'changed' END AS status
FROM orders o FULL JOIN n ON o.o_orderkey = n.o_orderkey""",
)
def snapshot_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against an edited copy of them."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    price = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    edited = orders.where("o_orderkey % 10 <> 0").withColumn("o_totalprice", price).union(
        orders.where("o_orderkey % 20 = 0").withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    )
    return rn.drift(orders, edited, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query(
    "snapshot_table",
    f"""SELECT doc_id, sha256(text) AS pre_sha256, sha256({SQL_NORMAL}) AS post_sha256, CAST(octet_length(encode(text)) AS BIGINT) AS pre_bytes,
  CAST(octet_length(encode({SQL_NORMAL})) AS BIGINT) AS post_bytes, text <> {SQL_NORMAL} AS changed FROM documents""",
)
def snapshot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = texts(spark, sf_dir)
    pre = documents.select("doc_id", F.col("text").alias("content"))
    post = documents.select("doc_id", normalize_block("text").alias("content"))
    return rn.snapshot(pre, post, ["doc_id"]).select(
        "doc_id", "pre_sha256", "post_sha256", "pre_bytes", "post_bytes", "changed"
    )


@query(
    "restore_plan",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'restorable' WHEN doc_id % 4 = 1 THEN 'already_restored' ELSE 'diverged' END AS status,
  doc_id % 4 <> 0 AS needs_force, sha256(text) AS result_sha256 FROM documents WHERE text <> ''""",
)
def restore_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live states: as applied, already restored, edited, missing."""
    documents = texts(spark, sf_dir).where("text <> ''")
    applied = content_sha(F.concat("text", F.lit("+")))
    targets = documents.select(
        "doc_id", F.lit(True).alias("existed"), F.lit(True).alias("changed"),
        content_sha("text").alias("pre_sha256"), applied.alias("post_sha256"),
    )
    kind = F.col("doc_id") % 4
    live = documents.where(kind != 3).select(
        "doc_id",
        F.when(kind == 0, applied).when(kind == 1, content_sha("text")).otherwise(content_sha(F.lit("edited"))).alias("live_sha256"),
    )
    return rn.restore_plan(targets, live, ["doc_id"])


STATE_MAP = {"signup": "planned", "view": "applying", "click": "applied", "error": "rolling_back", "purchase": "restored"}
SQL_STATE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATE_MAP.items()) + " END"
LEGAL = [
    ("planned", "applying"), ("applying", "applied"), ("applying", "rolling_back"),
    ("rolling_back", "rolling_back"), ("rolling_back", "restored"), ("applied", "rolling_back"),
]


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a run log: users are runs, event types states."""
    states = F.create_map(*[F.lit(x) for pair in STATE_MAP.items() for x in pair])
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "ts", "event_id", states[F.col("event_type")].alias("state")
    )


@query(
    "run_states",
    f"""SELECT user_id AS run_id, arg_max({SQL_STATE}, ts) AS state, CAST(count(*) AS BIGINT) AS entries FROM events GROUP BY user_id""",
)
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.current_states(run_log(spark, sf_dir))


@query(
    "illegal_transitions",
    f"""WITH l AS (SELECT user_id AS run_id, event_id, {SQL_STATE} AS state, lag({SQL_STATE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM events)
SELECT run_id, event_id, from_state, state FROM l WHERE (from_state IS NULL AND state <> 'planned') OR (from_state IS NOT NULL AND from_state || '>' || state NOT IN ({", ".join("'" + a + ">" + b + "'" for a, b in LEGAL)}))""",
)
def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    legal = spark.createDataFrame(LEGAL, "from_state string, to_state string")
    return rn.illegal_transitions(run_log(spark, sf_dir), legal).select("run_id", "event_id", "from_state", "state")


@query(
    "purged_runs",
    f"""WITH s AS (SELECT user_id AS run_id, arg_max({SQL_STATE}, ts) AS state FROM events GROUP BY user_id)
SELECT run_id, state AS previous_state, FALSE AS restore_possible FROM s WHERE run_id % 2 = 0 AND state NOT IN ('applied', 'applying', 'rolling_back')""",
)
def purged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tombstones of the even runs that are not active."""
    states = rn.current_states(run_log(spark, sf_dir)).drop("entries")
    _, tombstones = rn.purge(states, states.where("run_id % 2 = 0"))
    return tombstones.select("run_id", "previous_state", "restore_possible")


@query(
    "incremental_todo",
    """SELECT DISTINCT sha256(text) AS cache_key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(d.text) FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
)
def incremental_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content digests that have no cached result yet."""
    keyed = texts(spark, sf_dir).select("doc_id", content_sha("text").alias("cache_key"))
    done = keyed.join(table(spark, sf_dir, "labels"), "doc_id").select(
        "cache_key", F.col("quality").cast("string").alias("response"), content_sha(F.col("quality").cast("string")).alias("response_sha256")
    ).distinct()
    _, todo, _ = rn.cache_lookup(keyed.select("cache_key").distinct(), done)
    return todo


@query(
    "new_blobs",
    """SELECT DISTINCT sha256(text) AS sha256, CAST(length(text) AS BIGINT) AS chars FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE source = 'src1')""",
)
def new_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = texts(spark, sf_dir)
    store = documents.where("source = 'src1'").select(content_sha("text").alias("sha256"))
    fresh = rn.new_blobs(documents.select(F.col("text").alias("payload")), store)
    return fresh.select("sha256", F.length("payload").cast("long").alias("chars"))


@query(
    "request_resolution",
    """WITH c AS (SELECT o_custkey, min(o_orderkey) FILTER (o_orderstatus = 'F') AS run, min(o_orderkey) FILTER (o_orderstatus = 'O') AS gone FROM orders GROUP BY o_custkey)
SELECT c_custkey, CASE WHEN run IS NOT NULL THEN 'available' WHEN gone IS NOT NULL THEN 'purged' ELSE 'pending' END AS status, coalesce(run, gone) AS successor_run_id
FROM customer LEFT JOIN c ON c_custkey = o_custkey""",
)
def request_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as requests, finished orders as successors, open orders as tombstones."""
    def keyed(df: DataFrame, key: str, *more) -> DataFrame:
        return df.select(
            F.col(key).alias("parent_run_id"), F.lit("p").alias("parent_sha256"), F.lit("d").alias("request_id"), *more
        )

    orders = table(spark, sf_dir, "orders")
    run = F.col("o_orderkey").alias("successor_run_id")
    requests = keyed(table(spark, sf_dir, "customer"), "c_custkey")
    found = rn.resolve_requests(
        requests,
        keyed(orders.where("o_orderstatus = 'F'"), "o_custkey", run),
        keyed(orders.where("o_orderstatus = 'O'"), "o_custkey", run),
    )
    return found.select(F.col("parent_run_id").alias("c_custkey"), "status", "successor_run_id")


@query(
    "field_disagreements",
    """WITH a AS (SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS n, c_mktsegment AS s FROM customer),
b AS (SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS VARCHAR) AS n, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS s FROM customer)
SELECT c_custkey, 'c_nationkey' AS field FROM a JOIN b USING (c_custkey) WHERE a.n IS DISTINCT FROM b.n
UNION ALL SELECT c_custkey, 'c_mktsegment' FROM a JOIN b USING (c_custkey) WHERE a.s IS DISTINCT FROM b.s""",
)
def field_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    edited = customer.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("c_nationkey"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    return rn.field_disagreements(customer, edited, "c_custkey", ["c_nationkey", "c_mktsegment"])


@query(
    "integrity_audit",
    """SELECT CAST(doc_id AS VARCHAR) AS run_id, 'text' AS "check" FROM documents WHERE doc_id % 13 = 0""",
)
def integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored hashes are recomputed; those of every thirteenth document are wrong."""
    stored = F.when(F.col("doc_id") % 13 == 0, content_sha(F.lit("other"))).otherwise(content_sha("text"))
    runs = texts(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("run_id"), "text", stored.alias("text_sha"), "source", content_sha("source").alias("source_sha")
    )
    return rn.integrity_audit(runs, {"text": ("text", "text_sha"), "source": ("source", "source_sha")})


def order_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").alias("at"),
        F.when(F.col("o_orderstatus") == "F", "attended").otherwise("unattended").alias("mode"),
    )


@query(
    "ledger",
    """SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'F' THEN 'attended' ELSE 'unattended' END AS mode
FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1000""",
)
def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 1000 orders as a ledger."""
    newest, _ = rn.ledger(order_entries(spark, sf_dir))
    return newest.select("run_id", "mode")


@query(
    "ledger_totals",
    """SELECT CAST(count(*) AS BIGINT) AS entries, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS attended_applies FROM orders""",
)
def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, totals = rn.ledger(order_entries(spark, sf_dir))
    return totals


@query(
    "validated_responses",
    """WITH t AS (SELECT conv_id, turn, length(text) <= 2000 AND regexp_matches(text, '[^ ]') AS ok FROM conversations),
e AS (SELECT count(DISTINCT turn) AS n FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS run_id, CASE WHEN NOT (bool_and(ok) AND count(*) = (SELECT n FROM e)) THEN 'invalid_verification_output' END AS code FROM t GROUP BY conv_id""",
)
def validated_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as runs that must answer every turn number exactly once."""
    turns = table(spark, sf_dir, "conversations")
    results = turns.select(
        F.col("conv_id").cast("string").alias("run_id"), F.col("turn").alias("case_ref"), F.array("text").alias("steps")
    )
    return su.validate_responses(results, turns.select(F.col("turn").alias("case_ref")))


# --- ingest ---------------------------------------------------------------------------------------


@query(
    "ingest_stats",
    """SELECT role AS scope, CAST(count(DISTINCT conv_id) AS BIGINT) AS files_seen, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes_seen, CAST(count(*) AS BIGINT) AS records_seen,
  CAST(count(*) FILTER (role = 'user' AND regexp_matches(text, '[^\\s]')) AS BIGINT) AS records_emitted, CAST(count(*) FILTER (role <> 'user') AS BIGINT) AS unknown_records FROM conversations GROUP BY role""",
)
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters per role: only user turns become events, other roles are counted as unknown."""
    turns = texts(spark, sf_dir, "conversations")
    raw = turns.select(
        F.lit("conversation").alias("source_kind"),
        F.lit(3).alias("authority"),
        F.lit(None).cast("timestamp").alias("ts"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("role").alias("scope"),
        "text",
        F.concat_ws(":", "conv_id", "turn").alias("locator"),
        F.col("conv_id").cast("string").alias("file"),
        F.octet_length("text").cast("long").alias("size"),
        F.when(F.col("role") == "user", "candidate").otherwise("unknown").alias("outcome"),
    )
    stats = ing.source_stats(ing.classify(raw), ["scope"])
    return stats.select("scope", "files_seen", "bytes_seen", "records_seen", "records_emitted", "unknown_records")


@query(
    "knowledge_nodes",
    """WITH h AS (SELECT lang AS query, doc_id AS node_id, n_chars AS score FROM documents UNION ALL SELECT source, doc_id, n_chars FROM documents),
k AS (SELECT DISTINCT node_id FROM (SELECT node_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, node_id) AS r FROM h) WHERE r <= 20)
SELECT doc_id, lang || ',' || source AS scope, sha256(text) AS content_sha256 FROM documents WHERE doc_id IN (SELECT node_id FROM k) AND doc_id % 5 <> 0 AND text <> ''""",
)
def knowledge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest documents of every language and source as search hits on active nodes."""
    from evidgrid.sources.adapters import from_nodes

    documents = texts(spark, sf_dir)
    hits = documents.select(F.col("lang").alias("query"), F.col("doc_id").alias("node_id"), F.col("n_chars").alias("score")).union(
        documents.select("source", "doc_id", "n_chars")
    )
    nodes = documents.select(
        F.col("doc_id").alias("node_id"),
        F.col("text").alias("content"),
        F.lit("untitled").alias("title"),
        F.when(F.col("doc_id") % 5 == 0, "archived").alias("status"),
        F.array("lang", "source").alias("tags"),
        F.lit(None).cast("string").alias("updated_at"),
        F.lit("2024-01-01T00:00:00Z").alias("created_at"),
    ).where("content <> ''")
    found = from_nodes(nodes, hits, 20).where("outcome = 'candidate'")
    return found.select(
        F.regexp_extract("locator", r"(\d+)$", 1).cast("long").alias("doc_id"), "scope", content_sha("text").alias("content_sha256")
    )


@query(
    "inspection_report",
    """SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes,
  CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END AS BIGINT) AS lines, FALSE AS frontmatter FROM documents""",
)
def inspection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-document facts without any text."""
    from evidgrid.sources.sinks import document_facts

    documents = texts(spark, sf_dir).select(F.col("doc_id").alias("doc"), F.col("text").alias("content"))
    return document_facts(documents).select(F.col("doc").alias("doc_id"), "sha256", "bytes", "lines", "frontmatter")
