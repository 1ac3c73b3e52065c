"""Events: identity, dedup, scores, corroboration, relevance, sampling, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidgrid.functions.exprs import strings
from evidgrid.functions.identity import authority_label, content_sha, event_id, independence_key
from evidgrid.functions.text import (
    behavior_keys,
    correction_score,
    directive_score,
    fingerprint,
    fingerprint_tokens,
    iso_instant,
    recency_weight,
)
from evidgrid.lexicon import MAX_EVENTS
from evidgrid.operators import evidence as ev
from evidgrid.operators.ingest import dedup_latest, within_lookback
from evidgrid.session import cut_lineage
from evidgrid.queries.base import (
    AS_OF,
    DEDUPED_SQL,
    DOCUMENT_EVENTS_SQL,
    FIXTURE_LEXICON,
    as_of,
    benchmark_blocks,
    document_events,
    query,
    sql_correction,
    sql_directive,
    sql_iso,
    sql_list,
    sql_tokens,
    table,
    texts,
)

LX = FIXTURE_LEXICON
ANCHORS = sql_list(LX.anchors)

SCORED_SQL = f"""
WITH {DOCUMENT_EVENTS_SQL}, {DEDUPED_SQL},
tok AS (
  SELECT event_id, source_kind, session_id, ts,
         {sql_correction('text')} AS correction_score, {sql_directive('text')} AS directive_score,
         {sql_tokens('text')} AS tokens
  FROM latest),
fp AS (SELECT *, array_to_string(tokens, ' ') AS fp,
              list_sort(list_distinct(list_filter(tokens, lambda t: list_contains({ANCHORS}, t)))) AS anchors
       FROM tok),
fpc AS (SELECT fp, count(DISTINCT session_id) AS n FROM fp WHERE fp <> '' GROUP BY fp),
anc AS (SELECT event_id, session_id, unnest(anchors) AS a FROM fp WHERE len(anchors) >= 3),
keys AS (SELECT x.event_id, x.session_id, x.a || ' ' || y.a || ' ' || z.a AS k
         FROM anc x JOIN anc y ON x.event_id = y.event_id AND x.a < y.a
                    JOIN anc z ON y.event_id = z.event_id AND y.a < z.a),
kc AS (SELECT k, count(DISTINCT session_id) AS n FROM keys GROUP BY k),
kb AS (SELECT event_id, max(n) AS n FROM keys JOIN kc USING (k) GROUP BY event_id),
bt AS (SELECT item_id, unnest(list_distinct({sql_tokens('text')})) AS term FROM benchmark),
et AS (SELECT event_id, unnest(list_distinct(tokens)) AS term FROM fp),
rel AS (SELECT event_id, max(r) AS r FROM (
          SELECT event_id, item_id,
                 least(24, 2 * count(*) + 6 * count(*) FILTER (list_contains({ANCHORS}, term))) AS r
          FROM et JOIN bt USING (term) GROUP BY event_id, item_id) GROUP BY event_id),
scored AS (
  SELECT fp.event_id, source_kind, ts, correction_score, directive_score,
         greatest(1, coalesce(fpc.n, 0), coalesce(kb.n, 0)) AS corroboration,
         coalesce(rel.r, 0) AS target_relevance
  FROM fp LEFT JOIN fpc USING (fp) LEFT JOIN kb ON fp.event_id = kb.event_id
          LEFT JOIN rel ON fp.event_id = rel.event_id),
ranked AS (
  SELECT *, round(24 + correction_score * 3 + directive_score + least(5, corroboration) * 2
         + target_relevance * 2 + 8 * exp(-ln(2) * greatest(0.0,
             epoch_us(TIMESTAMP '{AS_OF}' - ts) / 86400000000.0) / 365.0), 6) AS rank_score
  FROM scored),
pos AS (SELECT *, row_number() OVER (ORDER BY rank_score DESC, ts DESC, event_id DESC) AS n,
               count(*) OVER () AS total FROM ranked)"""


def features() -> list[Column]:
    """What the scores need of a document, computed on the scan."""
    return [
        fingerprint_tokens("text", LX).alias("tokens"),
        correction_score("text", LX).cast("long").alias("correction_score"),
        directive_score("text", LX).cast("long").alias("directive_score"),
    ]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score table of the deduplicated documents; texts are read once, on the scan."""
    narrow = dedup_latest(document_events(spark, sf_dir, features()))
    kept = narrow.select("event_id", "doc_id", "source_kind", "authority", "ts", "session_id", *ev.FEATURES)
    return ev.score_events(kept, benchmark_blocks(spark, sf_dir), LX)


@query(
    "evidence_sample",
    SCORED_SQL
    + f""",
prim AS (SELECT event_id FROM pos WHERE n <= {int(MAX_EVENTS * 0.8)}),
breadth AS (
  SELECT event_id FROM (
    SELECT event_id, ts, row_number() OVER (PARTITION BY CAST(ts AS DATE), source_kind
                                            ORDER BY ts, event_id) AS g FROM pos)
  WHERE g = 1 AND event_id NOT IN (SELECT event_id FROM prim)
  ORDER BY ts, event_id LIMIT {MAX_EVENTS - int(MAX_EVENTS * 0.8)}),
final AS (
  SELECT pos.*, CASE WHEN event_id IN (SELECT event_id FROM prim) THEN 0
                     WHEN event_id IN (SELECT event_id FROM breadth) THEN 1 ELSE 2 END AS pick
  FROM pos)
SELECT event_id, source_kind, {sql_iso('ts')} AS ts, correction_score, directive_score,
       CAST(corroboration AS BIGINT) AS corroboration,
       CAST(target_relevance AS BIGINT) AS target_relevance, rank_score
FROM final ORDER BY pick, CASE WHEN pick = 1 THEN 0 ELSE n END, event_id LIMIT {MAX_EVENTS}""",
)
def evidence_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked quota sample of all documents with breadth over day and language."""
    breadth = [F.to_date("ts"), F.col("source_kind")]
    chosen = ev.select_events(scored(spark, sf_dir), as_of(), MAX_EVENTS, breadth)
    return chosen.select(
        "event_id",
        "source_kind",
        iso_instant("ts").alias("ts"),
        "correction_score",
        "directive_score",
        "corroboration",
        "target_relevance",
        "rank_score",
    )


@query(
    "evidence_scores",
    SCORED_SQL
    + """
SELECT event_id, CAST(correction_score AS BIGINT) AS correction_score,
       CAST(directive_score AS BIGINT) AS directive_score,
       CAST(corroboration AS BIGINT) AS corroboration,
       CAST(target_relevance AS BIGINT) AS target_relevance, rank_score
FROM ranked""",
)
def evidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rank parts of every deduplicated event."""
    return scored(spark, sf_dir).select(
        "event_id",
        "correction_score",
        "directive_score",
        "corroboration",
        "target_relevance",
        ev.rank_score(as_of()).alias("rank_score"),
    )


@query(
    "dedup_latest",
    f"""WITH {DOCUMENT_EVENTS_SQL}, {DEDUPED_SQL}
SELECT session_id, content_sha256, event_id, {sql_iso('ts')} AS ts FROM latest""",
)
def dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = dedup_latest(document_events(spark, sf_dir, []))
    return latest.select("session_id", "content_sha256", "event_id", iso_instant("ts").alias("ts"))


@query(
    "event_ids",
    """SELECT conv_id, turn, sha256(text) AS content_sha256,
  'evt_' || substr(sha256('conversation_' || role || chr(0) || CAST(conv_id AS VARCHAR) || chr(0) ||
    strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(turn), '%Y-%m-%dT%H:%M:%SZ') || chr(0) ||
    sha256(text)), 1, 18) AS event_id,
  CAST(conv_id AS VARCHAR) AS session_id, 'session:' || CAST(conv_id AS VARCHAR) AS witness
FROM conversations""",
)
def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    session = F.col("conv_id").cast("string")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    ts = start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("turn"))
    kind = F.concat(F.lit("conversation_"), "role")
    sha = content_sha("text")
    return turns.select(
        "conv_id",
        "turn",
        sha.alias("content_sha256"),
        event_id(kind, session, ts, sha).alias("event_id"),
        session.alias("session_id"),
        independence_key(session, kind, F.lit("conversations")).alias("witness"),
    )


@query(
    "lexical_scores",
    f"""SELECT doc_id, {sql_correction('text')} AS correction_score,
       {sql_directive('text')} AS directive_score FROM documents""",
)
def lexical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select(
        "doc_id",
        correction_score("text", LX).cast("long").alias("correction_score"),
        directive_score("text", LX).cast("long").alias("directive_score"),
    )


@query(
    "fingerprints",
    f"SELECT doc_id, array_to_string({sql_tokens('text')}, ' ') AS fingerprint FROM documents",
)
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select(
        "doc_id", fingerprint("text", LX).alias("fingerprint")
    )


@query(
    "fingerprint_corroboration",
    f"""WITH f AS (SELECT doc_id, source, array_to_string({sql_tokens('text')}, ' ') AS fp FROM documents)
SELECT doc_id, CAST(CASE WHEN fp = '' THEN 1 ELSE count(DISTINCT source) OVER (PARTITION BY fp) END AS BIGINT)
       AS corroboration FROM f""",
)
def fingerprint_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sources per fingerprint, joined back to every document."""
    documents = texts(spark, sf_dir)
    plain = FIXTURE_LEXICON.__class__(stop=LX.stop, anchors=[])
    tokened = documents.select(
        F.col("doc_id").alias("event_id"),
        F.col("source").alias("session_id"),
        *ev.corroboration_keys(fingerprint_tokens("text", plain), plain),
    )
    keyed = cut_lineage(tokened)
    found = ev.corroborate(keyed, plain)
    return found.select(F.col("event_id").alias("doc_id"), "corroboration")


@query(
    "key_combinations",
    f"""WITH t AS (SELECT doc_id, source, list_sort(list_distinct(list_filter({sql_tokens('text')},
                  lambda t: list_contains({ANCHORS}, t)))) AS anchors FROM documents),
a AS (SELECT doc_id, source, unnest(anchors) AS a FROM t),
k AS (SELECT x.doc_id, x.source, x.a || ' ' || y.a || ' ' || z.a AS behavior
      FROM a x JOIN a y ON x.doc_id = y.doc_id AND x.a < y.a
               JOIN a z ON y.doc_id = z.doc_id AND y.a < z.a)
SELECT behavior, CAST(count(DISTINCT source) AS BIGINT) AS sources, CAST(count(*) AS BIGINT) AS docs
FROM k GROUP BY behavior""",
)
def key_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and documents per combination of three anchors."""
    documents = ev.with_terms(texts(spark, sf_dir), "text", LX)
    # Counts per (anchor set, source) first: equal sets are expanded once.
    anchors = F.sort_array(F.array_intersect("tokens", strings(LX.anchors)))
    sets = (
        documents.select(anchors.alias("anchors"), "source")
        .where(F.size("anchors") >= 3)
        .groupBy("anchors", "source")
        .agg(F.count("*").alias("n"))
    )
    per_source = (
        sets.select("source", "n", F.explode(behavior_keys("anchors", LX)).alias("behavior"))
        .groupBy("behavior", "source")
        .agg(F.sum("n").alias("n"))
    )
    return per_source.groupBy("behavior").agg(
        F.count("*").alias("sources"), F.sum("n").alias("docs")
    )


@query(
    "target_relevance",
    f"""WITH bt AS (SELECT item_id, unnest(list_distinct({sql_tokens('text')})) AS term FROM benchmark),
et AS (SELECT doc_id, unnest(list_distinct({sql_tokens('text')})) AS term FROM documents),
r AS (SELECT doc_id, item_id, least(24, 2 * count(*) + 6 * count(*) FILTER (list_contains({ANCHORS}, term))) AS r
      FROM et JOIN bt USING (term) GROUP BY doc_id, item_id),
m AS (SELECT doc_id, max(r) AS r FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(m.r, 0) AS BIGINT) AS target_relevance
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id""",
)
def target_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = texts(spark, sf_dir).withColumnRenamed("doc_id", "event_id")
    terms = ev.with_terms(documents, "text", LX).select("event_id", "terms")
    found = ev.target_relevance(terms, benchmark_blocks(spark, sf_dir), LX)
    joined = terms.select("event_id").join(found, "event_id", "left")
    return joined.select(
        F.col("event_id").alias("doc_id"),
        F.coalesce("target_relevance", F.lit(0)).cast("long").alias("target_relevance"),
    )


@query(
    "polarity_overlap",
    SCORED_SQL
    + f""",
b AS (SELECT item_id, regexp_matches(text, '{LX.negative}') AS neg, regexp_matches(text, '{LX.positive}') AS pos,
             {sql_tokens('text')} AS tokens FROM benchmark),
e AS (SELECT s.event_id, s.ts, s.target_relevance, s.correction_score,
             regexp_matches(l.text, '{LX.negative}') AS neg, regexp_matches(l.text, '{LX.positive}') AS pos,
             tok.tokens
      FROM scored s JOIN latest l ON s.event_id = l.event_id JOIN tok ON s.event_id = tok.event_id),
b2 AS (SELECT item_id, neg, pos, unnest(list_distinct(tokens)) AS term FROM b),
e2 AS (SELECT event_id, ts, target_relevance, correction_score, neg, pos, unnest(list_distinct(tokens)) AS term FROM e),
p AS (SELECT item_id, event_id, any_value(e2.ts) AS ts, any_value(target_relevance) AS target_relevance,
             any_value(correction_score) AS correction_score, count(*) AS n_shared,
             bool_or(list_contains({sql_list(LX.strong)}, term)) AS strong,
             array_to_string(list_sort(list(term))[1:8], ' ') AS shared_terms
      FROM b2 JOIN e2 USING (term)
      WHERE (b2.neg AND e2.pos) OR (b2.pos AND e2.neg) GROUP BY item_id, event_id),
q AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY target_relevance DESC,
             correction_score DESC, n_shared DESC, ts DESC, event_id) AS n
      FROM p WHERE n_shared >= 2 OR strong)
SELECT item_id AS block_id, event_id, CAST(target_relevance AS BIGINT) AS target_relevance,
       CAST(correction_score AS BIGINT) AS correction_score, CAST(n_shared AS BIGINT) AS n_shared, shared_terms
FROM q WHERE n <= 3
ORDER BY q.target_relevance DESC, q.correction_score DESC, q.n_shared DESC, ts DESC, item_id, event_id LIMIT 30""",
)
def polarity_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top opposite-polarity pairs between benchmark passages and all documents."""
    blocks = benchmark_blocks(spark, sf_dir)
    narrow = dedup_latest(document_events(spark, sf_dir, [*features(), *ev.polarity_columns("text", LX)]))
    kept = narrow.select("event_id", "ts", "session_id", "neg", "pos", *ev.FEATURES)
    pairs = ev.opposite_polarity(blocks, ev.score_events(kept, blocks, LX, keep_tokens=True), LX)
    return pairs.select(
        "block_id",
        "event_id",
        "target_relevance",
        "correction_score",
        "n_shared",
        F.array_join("shared_terms", " ").alias("shared_terms"),
    )


@query(
    "recency_weight",
    f"""SELECT event_id, round(exp(-ln(2) * greatest(0.0, epoch_us(TIMESTAMP '{AS_OF}' - ts) / 86400000000.0)
       / 365.0), 6) AS weight, ts >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY AS recent FROM events""",
)
def recency_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.round(recency_weight("ts", as_of()), 6).alias("weight"),
        within_lookback(F.col("ts"), as_of(), 14).alias("recent"),
    )


@query(
    "oldest_per_group",
    f"""SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, min(ts) = max(ts) AS single,
       CAST(arg_min(event_id, ts) AS BIGINT) AS event_id FROM events GROUP BY ALL""",
)
def oldest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the earliest event per day and type is the only one, and which it is."""
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        (F.min("ts") == F.max("ts")).alias("single"),
        F.min(F.struct("ts", "event_id"))["event_id"].alias("event_id"),
    )


@query(
    "independent_groups",
    """SELECT lang, CAST(count(DISTINCT source) AS BIGINT) AS groups FROM documents GROUP BY lang""",
)
def independent_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = document_events(spark, sf_dir, [])
    return ev.independent_groups(events, ["source_kind"]).select(
        F.col("source_kind").alias("lang"), F.col("groups")
    )


@query(
    "missing_rule_signal",
    f"""WITH e AS (SELECT source, lang, {sql_correction('text')} AS c, {sql_directive('text')} AS d FROM documents)
SELECT lang, count(DISTINCT source) FILTER (c > 0 OR d > 0) >= 2 AS signal FROM e GROUP BY lang""",
)
def missing_rule_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a language has two independent scored sources (or an explicit durable wording)."""
    events = texts(spark, sf_dir).select(
        F.col("lang").alias("source_kind"),
        F.col("source").alias("session_id"),
        F.col("doc_id").alias("locator"),
        "text",
        correction_score("text", LX).alias("correction_score"),
        directive_score("text", LX).alias("directive_score"),
    )
    lang = F.col("source_kind")
    return ev.missing_rule_signal(events.withColumn("lang", lang), ["lang"])


@query(
    "authority_labels",
    """SELECT priority, authority, CASE authority WHEN 1 THEN 'explicit user correction with antecedent'
  WHEN 2 THEN 'current instruction baseline' WHEN 3 THEN 'repeated user preference'
  WHEN 4 THEN 'deterministic outcome' WHEN 5 THEN 'active knowledge node' ELSE 'unknown' END AS label,
  orders FROM (SELECT o_orderpriority AS priority, CAST(substr(o_orderpriority, 1, 1) AS INT) AS authority,
  CAST(count(*) AS BIGINT) AS orders FROM orders GROUP BY ALL)""",
)
def authority_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("priority"))
        .agg(F.count("*").alias("orders"))
    )
    authority = F.substring("priority", 1, 1).cast("int")
    return grouped.select(
        "priority", authority.alias("authority"), authority_label(authority).alias("label"), "orders"
    )
