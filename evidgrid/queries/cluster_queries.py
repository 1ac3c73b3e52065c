"""Duplicate clusters, exception components, merges and candidate splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidgrid.functions.exprs import led
from evidgrid.functions.text import normalize_block
from evidgrid.operators import clusters as cl
from evidgrid.queries.base import FIXTURE_LEXICON, query, sql_list, texts
from evidgrid.queries.text_queries import SQL_NORMAL

LX = FIXTURE_LEXICON.__class__(
    exception="nicht|with", required_heading="en|fr", block_stop=FIXTURE_LEXICON.block_stop
)


def document_blocks(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Documents as blocks of one place per language, with further columns of the documents."""
    return texts(spark, sf_dir).select(
        *more,
        F.col("lang").alias("doc"),
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("block_id"),
        F.array("lang").alias("heading_path"),
        F.col("doc_id").alias("start"),
        F.col("text").alias("raw"),
        normalize_block("text").alias("normalized"),
        (F.col("doc_id") % 11 == 0).alias("protected"),
    )


EXACT_SQL = f"""
n AS (SELECT doc_id, lang, text, {SQL_NORMAL} AS normalized FROM documents WHERE doc_id % 11 <> 0),
g AS (SELECT lang, normalized, count(*) AS members, sum(octet_length(encode(text))) AS pre_bytes, min(doc_id) AS first_doc
      FROM n WHERE normalized <> '' GROUP BY ALL HAVING count(*) >= 2)"""


@query(
    "exact_clusters",
    f"""WITH {EXACT_SQL}
SELECT lang, CAST(first_doc AS BIGINT) AS first_doc, CAST(members AS BIGINT) AS members, CAST(pre_bytes AS BIGINT) AS pre_bytes,
  CAST(80 + CASE WHEN regexp_matches(lang, 'en|fr') THEN 10 ELSE 0 END AS BIGINT) AS importance FROM g""",
)
def exact_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal unprotected documents with size and importance, most important first."""
    summaries, _ = cl.exact_duplicates(document_blocks(spark, sf_dir))
    scored = summaries.withColumn("evidence", F.lit(0)).withColumn("importance", cl.importance(LX))
    return scored.orderBy(*cl.cluster_order()).select(
        F.col("doc").alias("lang"),
        F.col("first_block").cast("long").alias("first_doc"),
        "members",
        "pre_bytes",
        "importance",
    )


@query(
    "cluster_members",
    f"""WITH {EXACT_SQL}
SELECT n.doc_id, CAST(g.first_doc AS BIGINT) AS first_doc FROM n JOIN g USING (lang, normalized)""",
)
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    summaries, members = cl.exact_duplicates(document_blocks(spark, sf_dir))
    joined = members.join(summaries.select("cluster_id", "first_block"), "cluster_id")
    return joined.select(
        F.col("block_id").cast("long").alias("doc_id"),
        F.col("first_block").cast("long").alias("first_doc"),
    )


@query(
    "candidate_summary",
    f"""WITH {EXACT_SQL}
SELECT CASE WHEN count(*) > 0 THEN 'defects_detected' ELSE 'no_detectable_defects' END AS status, CAST(count(*) AS BIGINT) AS clusters,
  CAST(coalesce(sum(members), 0) AS BIGINT) AS blocks, CAST(coalesce(sum(pre_bytes), 0) AS BIGINT) AS pre_bytes,
  CASE WHEN count(*) > 0 THEN 'exact_duplicate' ELSE '' END AS confirmed, '' AS review FROM g""",
)
def candidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summaries, _ = cl.exact_duplicates(document_blocks(spark, sf_dir))
    row = cl.candidate_summary(summaries.withColumn("reason_codes", F.array("reason")))
    return row.select(
        "status",
        "clusters",
        "blocks",
        "pre_bytes",
        F.array_join("confirmed_classes", ",").alias("confirmed"),
        F.array_join("review_classes", ",").alias("review"),
    )


def exception_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of every document as blocks of that document."""
    lines = F.transform(
        F.split("text", "\n"), lambda line, i: F.struct(i.alias("start"), line.alias("raw"))
    )
    exploded = texts(spark, sf_dir).select("doc_id", F.explode(lines).alias("r"))
    bearing = exploded.where(F.col("r")["raw"].rlike(led(LX.exception)))
    return bearing.select(
        F.col("doc_id").cast("string").alias("doc"),
        F.concat_ws(
            ":", F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lpad(F.col("r")["start"].cast("string"), 6, "0")
        ).alias("block_id"),
        F.array().cast("array<string>").alias("heading_path"),
        F.col("r")["start"].alias("start"),
        F.col("r")["raw"].alias("raw"),
        normalize_block(F.col("r")["raw"]).alias("normalized"),
        F.lit(False).alias("protected"),
    )


@query(
    "linked_components",
    f"""WITH RECURSIVE l AS (SELECT doc_id, i - 1 AS i, line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE regexp_matches(line, '{LX.exception}')),
b AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') || ':' || lpad(CAST(i AS VARCHAR), 6, '0') AS id, doc_id, line,
   lower(trim(regexp_replace(regexp_replace(line, '^(?:[-+*]|\\d+[.)])[ \\t]+([^\\s])', '\\1'), '\\s+', ' ', 'g'))) AS normalized FROM l),
dup AS (SELECT doc_id, normalized FROM b WHERE normalized <> '' GROUP BY ALL HAVING count(*) >= 2),
f AS (SELECT b.* FROM b ANTI JOIN dup USING (doc_id, normalized)),
t AS (SELECT id, doc_id, unnest(list_distinct(list_filter(regexp_extract_all(normalized, '[\\p{{L}}\\p{{N}}]+'),
   lambda t: length(t) >= 3 AND NOT list_contains({sql_list(LX.block_stop)}, t)))) AS term FROM f),
e AS (SELECT x.id AS a, y.id AS b FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.term = y.term AND x.id <> y.id
      GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a),
c AS (SELECT id, min(root) AS component FROM r GROUP BY id)
SELECT component, CAST(count(*) AS BIGINT) AS members, CAST(sum(octet_length(encode(f.line))) AS BIGINT) AS pre_bytes
FROM c JOIN f ON c.id = f.id GROUP BY component""",
)
def linked_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exception-bearing lines of a document, linked by two shared subject terms."""
    blocks = exception_lines(spark, sf_dir)
    _, claimed = cl.exact_duplicates(blocks)
    summaries, _ = cl.exception_components(blocks, claimed, LX)
    return summaries.select(F.col("first_block").alias("component"), "members", "pre_bytes")


def edge_clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two families of clusters: equal first lines and equal last lines of a language."""
    blocks = document_blocks(spark, sf_dir).withColumn("protected", F.lit(False))
    keyed = blocks.select(
        "doc",
        "heading_path",
        "block_id",
        F.explode(
            F.array(
                F.struct(F.lit("same_start").alias("reason"), F.substring_index("raw", "\n", 1).alias("k")),
                F.struct(F.lit("same_end").alias("reason"), F.substring_index("raw", "\n", -1).alias("k")),
            )
        ).alias("x"),
    ).select("doc", "heading_path", "block_id", "x.reason", "x.k")
    identity = F.sha2(F.concat_ws("\x00", "doc", "reason", "k"), 256)
    keyed = keyed.withColumn("cluster_id", identity)
    summaries = (
        keyed.groupBy("cluster_id", "reason", "doc", "heading_path")
        .agg(F.count("*").alias("n"))
        .where("n >= 2")
        .withColumn("importance", F.when(F.col("reason") == "same_start", 58).otherwise(50).cast("long"))
    )
    members = keyed.join(summaries.select("cluster_id"), "cluster_id", "left_semi")
    return blocks, summaries, members.select("cluster_id", "block_id")


EDGE_SQL = """
k AS (SELECT doc_id, lang, text, 'same_start' AS reason, split_part(text, chr(10), 1) AS k FROM documents
      UNION ALL SELECT doc_id, lang, text, 'same_end', split_part(text, chr(10), -1) FROM documents),
c AS (SELECT lang, reason, k, row_number() OVER (ORDER BY lang, reason, k) AS cid FROM k GROUP BY lang, reason, k HAVING count(*) >= 2),
m AS (SELECT c.cid, c.lang, c.reason, k.doc_id, k.text FROM k JOIN c USING (lang, reason, k))"""


@query(
    "merged_clusters",
    f"""WITH RECURSIVE {EDGE_SQL},
e AS (SELECT DISTINCT x.cid AS a, y.cid AS b FROM m x JOIN m y ON x.doc_id = y.doc_id),
r AS (SELECT a AS cid, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.cid = e.a),
q AS (SELECT cid, min(root) AS root FROM r GROUP BY cid),
d AS (SELECT DISTINCT root, doc_id, text FROM m JOIN q USING (cid)),
v AS (SELECT root, count(*) FILTER (doc_id % 3 = 0) AS evidence FROM d GROUP BY root),
s AS (SELECT root, count(*) AS members, sum(octet_length(encode(text))) AS pre_bytes, min(doc_id) AS first_doc FROM d GROUP BY root),
w AS (SELECT root, any_value(lang) AS lang, array_to_string(list_sort(list_distinct(list(reason))), ',') AS reasons,
   max(CASE WHEN reason = 'same_start' THEN 58 ELSE 50 END) AS importance FROM m JOIN q USING (cid) GROUP BY root)
SELECT lang, CAST(first_doc AS BIGINT) AS first_doc, reasons, CAST(members AS BIGINT) AS members, CAST(pre_bytes AS BIGINT) AS pre_bytes,
  CAST(least(100, importance + least(20, 4 * evidence)) AS BIGINT) AS importance
FROM s JOIN w USING (root) JOIN v USING (root)""",
)
def merged_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that share a document are merged to the fixed point."""
    blocks, summaries, members = edge_clusters(spark, sf_dir)
    # Every third document speaks for its clusters.
    evidence = members.where(F.col("block_id").cast("long") % 3 == 0).withColumn(
        "event_id", F.col("block_id")
    )
    merged, rows, _ = cl.merge_overlapping(
        summaries.drop("n"), members, evidence.select("cluster_id", "event_id"), blocks
    )
    first = rows.groupBy("cluster_id").agg(F.min("block_id").cast("long").alias("first_doc"))
    return merged.join(first, "cluster_id").select(
        F.col("doc").alias("lang"),
        "first_doc",
        F.array_join("reason_codes", ",").alias("reasons"),
        "members",
        "pre_bytes",
        "importance",
    )


@query(
    "cluster_boundaries",
    f"""WITH {EDGE_SQL}
SELECT 'overlapping_clusters' AS code, doc_id FROM m GROUP BY doc_id HAVING count(*) > 1""",
)
def cluster_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that sit in two clusters at once."""
    blocks, summaries, members = edge_clusters(spark, sf_dir)
    wrong = cl.boundary_violations(summaries, members, blocks)
    return wrong.select("code", F.col("block_id").cast("long").alias("doc_id"))


@query(
    "candidate_split",
    f"""WITH n AS (SELECT doc_id, lang, source, {SQL_NORMAL} AS normalized FROM documents),
d AS (SELECT lang, source, normalized FROM n WHERE normalized <> '' GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT DISTINCT lang FROM d)
SELECT n.doc_id, CASE WHEN d.lang IS NOT NULL THEN 'mutable' WHEN r.lang IS NOT NULL THEN 'context' ELSE 'keep' END AS role
FROM n LEFT JOIN d USING (lang, source, normalized) LEFT JOIN r ON n.lang = r.lang""",
)
def candidate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates inside a (language, source) section are mutable, the rest of the language context."""
    blocks = (
        document_blocks(spark, sf_dir, "source")
        .withColumn("heading_path", F.array(F.lit("all"), F.col("doc"), F.col("source")))
        .withColumn("heading_path", F.slice("heading_path", 2, 2))
        .withColumn("protected", F.lit(False))
        .drop("source")
    )
    summaries, members = cl.exact_duplicates(blocks)
    split = cl.split_by_candidates(blocks.drop("raw", "normalized"), summaries, members)
    return split.select(F.col("block_id").cast("long").alias("doc_id"), "role")
