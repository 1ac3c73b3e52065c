"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidgrid.functions import identity as ident
from evidgrid.functions import text as tx
from evidgrid.functions.exprs import extract_all
from evidgrid.functions.redaction import is_sensitive, redact
from evidgrid.lexicon import ENTROPY_BITS
from evidgrid.operators.ingest import redaction_totals
from evidgrid.queries.base import (
    FIXTURE_LEXICON,
    query,
    sql_iso,
    sql_list,
    table,
    texts,
)

LX = FIXTURE_LEXICON
SQL_NORMAL = (
    "lower(trim(regexp_replace(regexp_replace(text, '^(?:[-+*]|\\d+[.)])[ \\t]+([^\\s])', '\\1'), "
    "'\\s+', ' ', 'g')))"
)


@query(
    "text_metrics",
    """SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes,
  CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END AS BIGINT) AS lines,
  CAST(octet_length(encode(text)) AS BIGINT) AS token_bound, CAST(length(text) AS BIGINT) AS chars
FROM documents""",
)
def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select(
        "doc_id",
        tx.utf8_bytes("text").alias("bytes"),
        tx.line_count("text").alias("lines"),
        tx.utf8_bytes("text").alias("token_bound"),
        F.length("text").cast("long").alias("chars"),
    )


@query(
    "excerpts",
    """SELECT doc_id, CASE WHEN length(text) > 700 THEN
    text[1:329] || chr(10) || '[TRUNCATED:' || (length(text) - 658) || ' chars]' || chr(10) || right(text, 329)
  ELSE text END AS excerpt FROM documents""",
)
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", tx.excerpt("text").alias("excerpt"))


@query(
    "entropy_tokens",
    f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_+/=-]{{24,}}')) AS token FROM documents),
d AS (SELECT DISTINCT token FROM t),
c AS (SELECT token, unnest(string_split(token, '')) AS ch FROM d),
n AS (SELECT token, ch, count(*) AS k FROM c GROUP BY token, ch),
e AS (SELECT token, round(-sum(k / length(token) * log2(k / length(token))), 6) AS entropy FROM n GROUP BY token)
SELECT doc_id, token, entropy, entropy >= {ENTROPY_BITS} AND length(token) >= 40 AS flagged,
       CAST(count(*) AS BIGINT) AS n FROM t JOIN e USING (token) GROUP BY ALL""",
)
def entropy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long unbroken tokens with their entropy; hex digits alone stay below the threshold."""
    tokens = texts(spark, sf_dir).select(
        "doc_id", F.explode_outer(extract_all(F.col("text"), r"[A-Za-z0-9_+/=-]{24,}")).alias("token")
    ).where(F.col("token").isNotNull())
    counted = tokens.groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    entropy = F.round(tx.shannon_entropy("token"), 6)
    flagged = (F.col("entropy") >= ENTROPY_BITS) & (F.length("token") >= 40)
    return counted.withColumn("entropy", entropy).select(
        "doc_id", "token", "entropy", flagged.alias("flagged"), "n"
    )


@query(
    "normalized_blocks",
    f"""SELECT doc_id, sha256({SQL_NORMAL}) AS normalized_sha, CAST(length({SQL_NORMAL}) AS BIGINT) AS chars
FROM documents""",
)
def normalized_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = texts(spark, sf_dir).select("doc_id", tx.normalize_block("text").alias("n"))
    return normal.select(
        "doc_id",
        ident.content_sha("n").alias("normalized_sha"),
        F.length("n").cast("long").alias("chars"),
    )


@query(
    "clean_pages",
    """SELECT page_id, sha256(regexp_replace(replace(html, chr(0), chr(65533)), '[\\x01-\\x08\\x0b-\\x1f]', '', 'g')) AS clean_sha,
  CAST(length(regexp_replace(replace(html, chr(0), chr(65533)), '[\\x01-\\x08\\x0b-\\x1f]', '', 'g')) AS BIGINT) AS chars
FROM pages""",
)
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = texts(spark, sf_dir, "pages").select("page_id", tx.clean_controls("html").alias("c"))
    return cleaned.select(
        "page_id",
        ident.content_sha("c").alias("clean_sha"),
        F.length("c").cast("long").alias("chars"),
    )


@query(
    "repeated_phrase",
    f"""WITH w AS (SELECT doc_id, regexp_extract_all({SQL_NORMAL}, '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS phrase
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) > 8)),
r AS (SELECT doc_id, phrase, i, row_number() OVER (PARTITION BY doc_id, phrase ORDER BY i) AS k FROM s)
SELECT d.doc_id, f.phrase FROM documents d
LEFT JOIN (SELECT doc_id, arg_min(phrase, i) AS phrase FROM r WHERE k > 1 GROUP BY doc_id) f ON d.doc_id = f.doc_id""",
)
def repeated_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight-word run that a document repeats."""
    return texts(spark, sf_dir).select("doc_id", tx.repeated_phrase("text").alias("phrase"))


@query(
    "subject_terms",
    f"""WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(
  regexp_extract_all({SQL_NORMAL}, '[\\p{{L}}\\p{{N}}]+'),
  lambda t: length(t) >= 3 AND NOT list_contains({sql_list(LX.block_stop)}, t)))) AS term FROM documents)
SELECT term, CAST(count(*) AS BIGINT) AS docs FROM w GROUP BY term""",
)
def subject_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of every subject term."""
    terms = texts(spark, sf_dir).select(F.explode(tx.subject_terms("text", "blocks", LX)).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("docs"))


@query(
    "term_classes",
    """SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(
    regexp_extract_all(text, '(?i)(?:mit|von|with|from|avec|dans|sur)'), lambda t: lower(t)))), ' ') AS terms,
  CASE WHEN regexp_matches(text, 'nicht|not|pas') THEN -1 WHEN regexp_matches(text, 'with|und|avec') THEN 1 ELSE 0 END AS polarity,
  regexp_matches(text, '(?i)(?:token|license|copyright)') AS consequential
FROM documents""",
)
def term_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term class, the polarity sign and a flag pattern per document."""
    terms = tx.extract_terms("text", "(?i)(?:mit|von|with|from|avec|dans|sur)")
    return texts(spark, sf_dir).select(
        "doc_id",
        F.array_join(F.sort_array(terms), " ").alias("terms"),
        tx.polarity_sign("text", "nicht|not|pas", "with|und|avec").alias("polarity"),
        F.col("text").rlike("(?i)(?:token|license|copyright)").alias("consequential"),
    )


@query(
    "frontmatter",
    """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE '---' || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) || text END AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '---' || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) END AS frontmatter,
  sha256(text) AS body_sha FROM documents""",
)
def frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter is cut off again after it was put in front of two thirds of the documents."""
    head = F.concat(F.lit("---\nlang: "), "lang", F.lit("\n---\n"))
    stored = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(head, "text"))
    parts = texts(spark, sf_dir).select("doc_id", tx.split_frontmatter(stored).alias("p"))
    return parts.select(
        "doc_id",
        F.col("p")["frontmatter"].alias("frontmatter"),
        ident.content_sha(F.col("p")["body"]).alias("body_sha"),
    )


@query(
    "instants",
    f"""SELECT event_id, {sql_iso("date_trunc('second', ts)")} AS from_seconds,
  {sql_iso("date_trunc('millisecond', ts)")} AS from_millis, {sql_iso('ts')} AS from_text FROM events""",
)
def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch seconds, epoch milliseconds and ISO text lead to the same instants."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    micros = F.unix_micros("ts")
    millis = F.floor(micros / 1000).cast("double")
    seconds = F.floor(micros / 1_000_000).cast("double")
    none = F.lit(None).cast("timestamp")
    return events.select(
        "event_id",
        tx.iso_instant(tx.normalize_instant(seconds, None, none)).alias("from_seconds"),
        tx.iso_instant(tx.normalize_instant(millis, None, none)).alias("from_millis"),
        tx.iso_instant(
            tx.normalize_instant(None, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")), none)
        ).alias("from_text"),
    )


@query(
    "canonical_digests",
    """SELECT c_custkey, sha256('{"name":"' || c_name || '","nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}' || chr(10)) AS digest
FROM customer""",
)
def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.struct(
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
    )
    return table(spark, sf_dir, "customer").select(
        "c_custkey", ident.canonical_digest(record).alias("digest")
    )


@query(
    "shape_tests",
    """WITH r AS (SELECT o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '-' ||
    CASE WHEN o_orderkey % 5 = 0 THEN 'xyz' ELSE substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8) END AS run_id FROM orders)
SELECT o_orderkey, regexp_full_match(run_id, '\\d{8}T\\d{6}Z-[0-9a-f]{8}') AS valid FROM r""",
)
def shape_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-id shape over ids derived from the orders; every fifth is malformed."""
    suffix = F.when(F.col("o_orderkey") % 5 == 0, "xyz").otherwise(
        F.left(ident.content_sha(F.col("o_orderkey").cast("string")), F.lit(8))
    )
    run_id = F.concat(F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), suffix)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", ident.valid_run_id(run_id).alias("valid")
    )


@query(
    "safe_lines",
    """SELECT doc_id, NOT contains(text, chr(10)) AND NOT contains(text, chr(13)) AND trim(text) <> '' AND length(trim(text)) <= 2000 AS safe
FROM documents""",
)
def safe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", ident.safe_line("text").alias("safe"))


@query(
    "substantive_quotes",
    f"""WITH q AS (SELECT conv_id, turn, text, string_split(text, '. ')[-1] AS quote FROM conversations)
SELECT conv_id, turn, contains(text, quote) AND length(trim(quote)) >= 12 AND len(list_distinct(list_filter(
  regexp_extract_all(lower(quote), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 3))) >= 2 AS substantive FROM q""",
)
def substantive_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        tx.substantive_quote(F.element_at(F.split("text", r"\. "), -1), "text").alias("substantive"),
    )


@query(
    "behavioral_blocks",
    """SELECT doc_id, NOT (source IN ('src3', 'src7') OR starts_with(lower(ltrim(text)), 'the ')) AS behavioral FROM documents""",
)
def behavioral_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks under an excluded heading (here the source) or with an excluded beginning."""
    lexicon = LX.__class__(excluded_headings=["src3", "src7"], excluded_prefixes=["the "])
    return texts(spark, sf_dir).select(
        "doc_id", tx.is_behavioral(F.array("source"), "text", lexicon).alias("behavioral")
    )


@query(
    "redaction_totals",
    """WITH f AS (
  SELECT 'uuid' AS kind, 'low' AS confidence, len(regexp_extract_all(text, '\\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\\b')) AS n
  FROM (SELECT CASE WHEN doc_id % 4 = 1 THEN text || ' 123e4567-e89b-42d3-a456-42661417' || CAST(1000 + doc_id % 9000 AS VARCHAR) ELSE text END AS text FROM documents)
  UNION ALL
  SELECT 'credential_assignment', 'high', CASE WHEN doc_id % 7 = 2 THEN 1 ELSE 0 END FROM documents)
SELECT kind, confidence, CAST(sum(n) AS BIGINT) AS findings FROM f GROUP BY ALL HAVING sum(n) > 0""",
)
def redaction_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by kind over all documents, with secrets appended to some of them."""
    planted = F.concat(
        "text",
        F.when(
            F.col("doc_id") % 4 == 1,
            F.concat(F.lit(" 123e4567-e89b-42d3-a456-42661417"), (1000 + F.col("doc_id") % 9000).cast("string")),
        ).otherwise(""),
        F.when(F.col("doc_id") % 7 == 2, "\npassword = planted-value-9").otherwise(""),
    )
    redacted = texts(spark, sf_dir).select(redact(planted).alias("r"))
    return redaction_totals(redacted.select(F.col("r")["findings"].alias("redactions")))


@query(
    "sensitive_rows",
    """SELECT lang, CAST(count(*) AS BIGINT) AS seen, CAST(count(*) FILTER (doc_id % 7 = 2) AS BIGINT) AS excluded
FROM documents GROUP BY lang""",
)
def sensitive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are left out as a whole because of a high-confidence secret."""
    planted = F.when(
        F.col("doc_id") % 7 == 2, F.concat("text", F.lit("\nAuthorization: Bearer abcdefgh"))
    ).otherwise(F.col("text"))
    checked = texts(spark, sf_dir).select("lang", redact(planted).alias("r"))
    flagged = checked.select("lang", is_sensitive("r").alias("s"))
    return flagged.groupBy("lang").agg(
        F.count("*").alias("seen"), F.count_if("s").alias("excluded")
    )


#: A sentence with a term of every group of the gate predicate, in parts that can be left out.
GATE_PARTS = (
    "explicit", "loaded", "per-stage", "do not proceed", "handoff", "according to",
    "documented repository workflow", "project-required", "order", "available",
)
UNIVERSAL = "After all of ci is green, commit."


def sql_gate(text: str) -> str:
    """The gate predicate in SQL, for texts that state no universal prerequisite."""
    from evidgrid import lexicon as lx
    from evidgrid.functions.exprs import any_of

    tests = [any_of(terms) for terms in lx.GATE_TERM_GROUPS.values()]
    tests += [pattern.replace("(?U)", "") for pattern in lx.GATE_WORDS]
    return " AND ".join(f"regexp_matches(lower({text}), '{test}')" for test in tests)


@query(
    "stage_gates",
    f"""WITH p AS (SELECT doc_id, text || chr(10) || array_to_string(list_filter({list(GATE_PARTS)}, lambda x, i: i - 1 <> doc_id % 12), ' ') || '.' AS t FROM documents)
SELECT doc_id, {sql_gate('t')} AND doc_id % 5 <> 0 AS gate, doc_id % 5 = 0 AS universal FROM p""",
)
def stage_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate predicate on documents with a gate sentence, of which mostly one part is missing."""
    from evidgrid.functions.exprs import strings

    parts = F.filter(strings(list(GATE_PARTS)), lambda x, i: i != F.col("doc_id") % 12)
    gate = F.concat("text", F.lit("\n"), F.array_join(parts, " "), F.lit("."))
    stated = F.concat(gate, F.when(F.col("doc_id") % 5 == 0, f" {UNIVERSAL}").otherwise(""))
    return texts(spark, sf_dir).select(
        "doc_id", tx.has_stage_gate(stated).alias("gate"), tx.universal_prerequisite(stated).alias("universal")
    )


@query(
    "composed_texts",
    "SELECT doc_id, sha256(nfc_normalize(text || ' e' || chr(769) || 'a' || chr(776) || chr(4352) || chr(4449))) AS composed_sha256 FROM documents",
)
def composed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with some combining characters behind them, composed."""
    from evidgrid.operators.ingest import compose_unicode

    marked = F.concat("text", F.lit(" e\u0301a\u0308\u1100\u1161"))
    composed = compose_unicode(texts(spark, sf_dir).select("doc_id", marked.alias("t")), "t")
    return composed.select("doc_id", ident.content_sha("t").alias("composed_sha256"))
