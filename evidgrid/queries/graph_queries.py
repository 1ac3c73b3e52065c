"""References, closures, lineage and graph comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidgrid.functions.exprs import extract_all
from evidgrid.operators import graph as gr
from evidgrid.queries.base import query, table, texts


@query(
    "dangling_refs",
    """WITH h AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"#?]*)', 1)) AS dst FROM pages),
p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, dst FROM h WHERE dst NOT IN (SELECT path FROM p)""",
)
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that match no page path."""
    pages = texts(spark, sf_dir, "pages")
    edges = pages.select(
        "page_id", F.explode(extract_all(F.col("html"), r'href="([^"#?]*)', 1)).alias("dst")
    ).distinct()
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    nodes = pages.select(path.alias("doc")).distinct()
    return gr.dangling_edges(edges, nodes).select("page_id", "dst")


@query(
    "references",
    """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])@([^\\s`<>]+)', 1)) AS ref FROM (
  SELECT doc_id, regexp_replace(text, '(?i)([a-z0-9])@', '\\1 at ', 'g') || chr(10) || '@notes/' || lang || '.md, @../' || source || '/x.md' AS text FROM documents))
SELECT doc_id, regexp_replace(ref, '[.,;:!?)\\]}]+$', '') AS ref, CAST(count(*) AS BIGINT) AS n
FROM t WHERE regexp_replace(ref, '[.,;:!?)\\]}]+$', '') <> '' GROUP BY ALL""",
)
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``@path`` mentions, two of them appended to every document."""
    content = F.concat(
        F.regexp_replace("text", "(?i)([a-z0-9])@", "$1 at "),
        F.lit("\n@notes/"),
        "lang",
        F.lit(".md, @../"),
        "source",
        F.lit("/x.md"),
    )
    documents = texts(spark, sf_dir).select(F.col("doc_id").alias("doc"), content.alias("content"))
    found = gr.extract_references(documents)
    return found.groupBy(F.col("doc").alias("doc_id"), "ref").agg(F.count("*").alias("n"))


@query(
    "resolved_refs",
    """SELECT doc_id, '/docs/' || lang || '/notes/' || source || '.md' AS relative, '/docs/' || source || '/x.md' AS upward,
  '/home/user/' || lang || '.md' AS at_home FROM documents""",
)
def resolved_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    doc = F.concat(F.lit("/docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))

    def resolved(*parts):
        return gr.resolve_reference(doc, F.concat(*parts))

    return documents.select(
        "doc_id",
        resolved(F.lit("./notes//"), "source", F.lit(".md")).alias("relative"),
        resolved(F.lit("../"), "source", F.lit("/y/../x.md")).alias("upward"),
        resolved(F.lit("~/"), "lang", F.lit(".md")).alias("at_home"),
    )


def hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions as roots; region -> nation -> customer and supplier edges."""
    def named(kind: str, key: str):
        return F.concat(F.lit(kind), F.col(key).cast("string"))

    nation = table(spark, sf_dir, "nation")
    edges = (
        nation.select(named("r", "n_regionkey").alias("src"), named("n", "n_nationkey").alias("dst"))
        .union(
            table(spark, sf_dir, "customer").select(named("n", "c_nationkey"), named("c", "c_custkey"))
        )
        .union(
            table(spark, sf_dir, "supplier").select(named("n", "s_nationkey"), named("s", "s_suppkey"))
        )
        .union(table(spark, sf_dir, "orders").select(named("c", "o_custkey"), named("o", "o_orderkey")))
    )
    roots = table(spark, sf_dir, "region").select(named("r", "r_regionkey").alias("node"))
    return roots, edges


@query(
    "bounded_closure",
    """SELECT 'r' || r_regionkey AS node, 0 AS depth FROM region
UNION ALL SELECT DISTINCT 'n' || n_nationkey, 1 FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT DISTINCT 'c' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT DISTINCT 's' || s_suppkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT DISTINCT 'o' || o_orderkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def bounded_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots, edges = hierarchy(spark, sf_dir)
    return gr.bounded_closure(roots, edges)


@query(
    "closure_violations",
    """SELECT 'depth_exceeded' AS code, 'c' || o_custkey AS src, 'o' || o_orderkey AS dst
FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def closure_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With at most two hops from the regions every order is one reference too far."""
    roots, edges = hierarchy(spark, sf_dir)
    nodes = roots.union(edges.select("dst")).distinct().withColumnRenamed("node", "doc")
    return gr.closure_violations(roots, edges, nodes, max_depth=2)


@query(
    "reference_chains",
    """WITH c AS (SELECT c_custkey, 'r' || r_regionkey AS r, 'r' || r_regionkey || ' -> n' || n_nationkey || ' -> c' || c_custkey AS chain
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT 'circular_reference' AS code, chain || ' -> ' || r AS chain FROM c WHERE c_custkey % 50 = 0
UNION ALL SELECT 'dangling_reference', 'r' || r_regionkey || ' -> n' || n_nationkey || ' -> s' || s_suppkey || ' -> lost' || s_suppkey
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 10 = 0
UNION ALL SELECT 'depth_exceeded', chain || ' -> o' || o_orderkey || ' -> p' || o_orderkey || ' -> x' || o_orderkey
FROM orders JOIN c ON o_custkey = c_custkey WHERE o_orderkey % 100 = 0""",
)
def reference_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains to cut: some customers refer back to their region, some suppliers to nothing, and some
    orders go on for two more hops."""
    roots, edges = hierarchy(spark, sf_dir)
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")

    def named(kind: str, key: str):
        return F.concat(F.lit(kind), F.col(key).cast("string"))

    back = table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").join(nation, "c_nationkey")
    nowhere = table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0")
    deep = table(spark, sf_dir, "orders").where("o_orderkey % 100 = 0")
    documents = roots.union(edges.select("dst")).union(
        deep.select(F.explode(F.array(named("p", "o_orderkey"), named("x", "o_orderkey"))))
    )
    planted = (
        back.select(named("c", "c_custkey"), named("r", "n_regionkey"))
        .union(nowhere.select(named("s", "s_suppkey"), named("lost", "s_suppkey")))
        .union(deep.select(named("o", "o_orderkey"), named("p", "o_orderkey")))
        .union(deep.select(named("p", "o_orderkey"), named("x", "o_orderkey")))
    )
    found = gr.reference_chains(
        roots, edges.union(planted), documents.distinct().withColumnRenamed("node", "doc")
    )
    return found.select("code", F.array_join("chain", " -> ").alias("chain"))


@query(
    "graph_diff",
    """WITH a AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer),
b AS (SELECT 'c' || c_custkey AS src, 'n' || (CASE WHEN c_custkey % 10 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END) AS dst FROM customer)
SELECT 'added' AS change, src, dst FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
UNION ALL SELECT 'removed', src, dst FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
)
def graph_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    src = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    moved = F.when(F.col("c_custkey") % 10 == 0, (F.col("c_nationkey") + 1) % 25).otherwise(
        F.col("c_nationkey")
    )
    before = customer.select(src.alias("src"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"))
    after = customer.select(src.alias("src"), F.concat(F.lit("n"), moved.cast("string")).alias("dst"))
    return gr.graph_diff(before, after)


@query(
    "graph_digest",
    """WITH e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
n AS (SELECT 'r' || r_regionkey AS doc FROM region UNION SELECT dst FROM e),
nv AS (SELECT CAST('0x' || substr(sha256(doc), 1, 15) AS BIGINT) AS v FROM n),
ev AS (SELECT CAST('0x' || substr(sha256(src || chr(0) || dst), 1, 15) AS BIGINT) AS v FROM e),
a AS (SELECT count(*) AS c, bit_xor(v) AS x, sum(v % 2147483648) AS s FROM nv), b AS (SELECT count(*) AS c, bit_xor(v) AS x, sum(v % 2147483648) AS s FROM ev)
SELECT a.c AS nodes, sha256(a.c || ':' || a.x || ':' || a.s) AS node_digest, b.c AS edges, sha256(b.c || ':' || b.x || ':' || b.s) AS edge_digest FROM a, b""",
)
def graph_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the customer graph; it does not depend on the order of rows."""
    roots, edges = hierarchy(spark, sf_dir)
    nodes = roots.union(edges.select("dst")).distinct().withColumnRenamed("node", "doc")
    return gr.graph_digest(nodes, edges.distinct())


@query(
    "components",
    """SELECT 'c' || c_custkey AS node, 'c' || (min(c_custkey) OVER (PARTITION BY c_nationkey)) AS component
FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey) > 1""",
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers linked through their nation; numbers are padded so that text order is number order."""
    members = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("node"))
    found = gr.connected_components(gr.star_edges(members, "c_nationkey", "node"))
    return found.select(
        F.concat(F.lit("c"), F.col("node").cast("string")).alias("node"),
        F.concat(F.lit("c"), F.col("component").cast("string")).alias("component"),
    )


@query(
    "lineage_chain",
    """WITH r AS (SELECT o_orderkey AS run_id, o_orderpriority AS mark,
  lag(o_orderkey) OVER w AS parent, row_number() OVER w - 1 AS depth FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
c AS (SELECT a.run_id, least(a.depth, 4) AS depth, a.parent IS NOT NULL AND (coalesce(p.parent IS NOT NULL AND p.mark = a.mark, FALSE)
   OR coalesce(q.parent IS NOT NULL AND q.mark = a.mark, FALSE) OR coalesce(s.parent IS NOT NULL AND s.mark = a.mark, FALSE)) AS repeated
  FROM r a LEFT JOIN r p ON a.parent = p.run_id LEFT JOIN r q ON p.parent = q.run_id LEFT JOIN r s ON q.parent = s.run_id)
SELECT CAST(run_id AS VARCHAR) AS run_id, CAST(depth AS INTEGER) AS depth,
  CASE WHEN depth > 3 THEN 'decision_depth_exceeded' WHEN repeated THEN 'decision_replayed' ELSE 'accepted' END AS status FROM c""",
)
def lineage_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as a chain of runs; the priority stands for the request."""
    from evidgrid.operators.skew import previous_value

    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderdate", F.col("o_orderkey").cast("string").alias("run_id"), "o_orderkey", "o_orderpriority"
    )
    linked = previous_value(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "run_id", "parent_run_id")
    first = F.col("parent_run_id").isNull()
    runs = linked.select(
        "run_id",
        "parent_run_id",
        F.when(~first, F.col("o_orderpriority")).alias("request_id"),
        F.when(~first, F.sha2("o_orderpriority", 256)).alias("fingerprint"),
    )
    return gr.lineage_chain(runs)
