"""Registered queries of the corpus operators and the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidgrid.llm import pii, quality, toxicity
from evidgrid.llm.byte_bpe import round_trip
from evidgrid.llm.common import Scratch, table
from evidgrid.llm.decontaminate import contamination
from evidgrid.llm.exact_dedup import mark_copies
from evidgrid.llm.hard_negatives import hard_negatives
from evidgrid.llm.html_extract import main_texts
from evidgrid.llm.jaccard_join import similar_documents
from evidgrid.llm.license_scan import COPYRIGHT_LINE, OTHER, SPELLINGS, known_digests, scan
from evidgrid.llm.simhash_neardup import near_duplicates
from evidgrid.llm.source_audit import source_audit
from evidgrid.llm.substring_dedup import repeated_spans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


SQL_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query(
    "op4_exact_dedup",
    f"""
    WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {SQL_UPPER})) AS text_sha256
               FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts; the largest doc_id of a group stays."""
    marked = mark_copies(table(spark, sf_dir, "documents"), Scratch(spark))
    return marked.select(
        F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {SQL_UPPER}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


@query(
    "op5_decontaminate",
    f"""
    WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {SQL_WORDS} AS w FROM benchmark),
    bw AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
    win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bw)),
    sizes AS (SELECT DISTINCT n FROM win),
    dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                 FROM d, sizes WHERE len(w) >= n)),
    hit AS (SELECT DISTINCT doc_id, n, i, item_id FROM dg JOIN win USING (n, g)),
    marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit
               FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
    listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
               FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit)
               GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit,
           coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
    FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN listed USING (doc_id)
    """,
)
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words that occur in windows of benchmark items."""
    found = contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark)
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to token ids and decoded again."""
    coded = round_trip(
        table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN
    )
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query(
    "op10_substring_dedup",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
               FROM documents),
    g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
    f AS (SELECT h, min(doc_id) AS earliest FROM g GROUP BY h),
    r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
          FROM g JOIN f USING (h) WHERE earliest < doc_id),
    c AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
           sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
             list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
    FROM d LEFT JOIN c USING (doc_id)
    """,
)
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the word windows that an earlier document already has."""
    spans = repeated_spans(table(spark, sf_dir, "documents"), Scratch(spark))
    return spans.drop("removed")


@query(
    "op1_ngram_jaccard_join",
    f"""
    WITH RECURSIVE d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {SQL_UPPER}),
                                        '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i
                FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
          FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
          WHERE 100 * c >= 85 * (a.n + b.n - c)),
    e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
    r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
    SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id
    FROM r JOIN d ON d.doc_id = r.x LEFT JOIN n USING (doc_id) GROUP BY doc_id
    """,
)
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component of documents that similarity links reach."""
    found = similar_documents(table(spark, sf_dir, "documents"), Scratch(spark))
    return found.select("doc_id", "n_shingles", "component_id")


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its expected severity and whether it counts as toxic."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.severity(docs, toxicity.train(docs, labels, Scratch(spark)))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score_documents(docs, quality.train(docs, labels, Scratch(spark)))


def joined_spans(name: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    parts = F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(parts, ",")


@query("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data."""
    docs = table(spark, sf_dir, "documents")
    found = pii.personal_data(docs, pii.train(docs, Scratch(spark)))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[number(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(joined_spans("base"), 256).alias("base_sha256"),
        joined_spans("spans").alias("spans"),
    )


@query("op3_html_extraction")
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its main text."""
    return main_texts(table(spark, sf_dir, "pages"), Scratch(spark))


def sql_canonical(text: str) -> str:
    """Canonical form of a license text in SQL."""
    out = f"translate(regexp_replace({text}, '{COPYRIGHT_LINE}', '', 'g'), {SQL_UPPER})"
    out = f"trim(regexp_replace({out}, '{OTHER}', ' ', 'g'))"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return out


KNOWN_SQL = ", ".join(f"('{digest}', '{name}')" for digest, name in known_digests())


@query(
    "op2_license_scan",
    f"""
    WITH known(digest, license) AS (VALUES {KNOWN_SQL}),
    units AS (
      SELECT DISTINCT doc_id, length(unit) = length(text) AS whole,
             sha256({sql_canonical('unit')}) AS digest
      FROM (SELECT doc_id, text, unnest(list_concat([text],
                   regexp_split_to_array(text, '\n[ \t\r]*\n'),
                   regexp_split_to_array(text, '\n'))) AS unit FROM documents)),
    found AS (
      SELECT doc_id, max(license) FILTER (whole) AS whole_license,
             count(DISTINCT digest) AS n_units,
             string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
      FROM units JOIN known USING (digest) GROUP BY doc_id)
    SELECT doc_id, whole_license, coalesce(n_units, 0) AS n_units,
           coalesce(licenses, '') AS licenses
    FROM documents LEFT JOIN found USING (doc_id)
    """,
)
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the known licenses that it is or quotes as a paragraph or line."""
    return scan(table(spark, sf_dir, "documents"))


@query(
    "op13_source_audit",
    f"""
    WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), {SQL_UPPER}),
                                         '[a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
    t AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS docs
          FROM (SELECT lang, source, k, unnest(w) AS term
                FROM (SELECT *, row_number() OVER () AS k FROM d)) GROUP BY ALL),
    kept AS (SELECT lang, term, sum(n) AS total FROM t GROUP BY ALL HAVING sum(docs) >= 30),
    l AS (SELECT lang, count(*) AS v, sum(total) AS total FROM kept GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT g.lang, g.source, kept.term, coalesce(t.n, 0)::HUGEINT AS n,
                 kept.total::HUGEINT AS m, l.v, l.total::HUGEINT AS lang_total,
                 sum(coalesce(t.n, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS group_total
          FROM g JOIN kept USING (lang) JOIN l USING (lang)
          LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = kept.term),
    p AS (SELECT *, 1 + (1000000000 * (n + 5)) // (group_total + 5 * v) AS p,
                 1 + (1000000000 * (m + 5)) // (lang_total + 5 * v) AS q FROM c),
    pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b USING (lang)
              WHERE a.source <> b.source),
    f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
          FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
    r AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value
          FROM pairs LEFT JOIN f USING (lang, source, item)
          UNION ALL
          SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
    o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part
                                       ORDER BY value DESC, item)::INTEGER AS rank FROM r)
    SELECT * FROM o WHERE part = 'pair' OR rank <= 50
    """,
)
def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (lang, source) group with its distance to other sources and its leading terms."""
    return source_audit(table(spark, sf_dir, "documents"), Scratch(spark))


@query(
    "op12_hard_negatives",
    """
    WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
               FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
                 list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
          FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id,
           row_number() OVER (PARTITION BY anchor_id, positive_id
                              ORDER BY score DESC, id)::INTEGER AS rank,
           id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY rank <= 5
    """,
)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor and positive with the rows of other labels that score almost as high."""
    return hard_negatives(table(spark, sf_dir, "embeddings"), Scratch(spark))


@query("op11_simhash_neardup")
def op11_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the component that near fingerprints reach."""
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark))
