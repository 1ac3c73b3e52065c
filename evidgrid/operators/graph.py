"""Components, bounded reference closure, lineage chains and graph comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidgrid import lexicon as lx
from evidgrid.functions.exprs import col, extract_all, let
from evidgrid.functions.identity import digest_prefix, content_sha
from evidgrid.operators.skew import beside, join_back
from evidgrid.session import Tables, cut_lineage, cut_lineage_counted


def star_edges(members: DataFrame, key: str, node: str) -> DataFrame:
    """Edges (a, b) that link all nodes of a key through its smallest node.

    A key with n nodes gives n - 1 edges instead of all pairs.
    """
    tables = Tables(members.sparkSession)
    written = tables.save(members.select(key, node), "members")
    hubs = tables.save(
        written.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(node).alias("a"), F.max(node).alias("b"), F.count("*").alias("rows"))
        .where(F.col("rows") > 1),
        "hubs",
    )
    # Two rows are one edge; only larger keys go back to their rows.
    pairs = hubs.where("rows = 2 AND a != b").select("a", "b")
    larger = hubs.where("rows > 2").drop("b")
    linked = join_back(written, larger, key, "rows", F.col(node))
    stars = linked.where(F.col("a").isNotNull() & (F.col("a") != F.col(node)))
    return pairs.union(stars.select("a", F.col(node).alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node as component, for nodes that have an edge.

    Every round each label moves to the neighbour that comes first in an order, and the edges are
    contracted. In the first round that is the order of the nodes, so a star around its smallest node
    is one label at once. Later rounds take a hashed order, another one each: it breaks long chains
    into short ones, so the graph shrinks by a constant factor per round whatever its shape.
    Rounds are written to the checkpoint folder: the plan stays short and a lost executor costs
    one round.
    """
    tables = Tables(edges.sparkSession)
    links = tables.save(edges.where("a != b").select("a", "b").distinct(), "links-0")
    labels = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = tables.save(labels.withColumn("label", F.col("node")), "labels-0")
    turn = 0
    while links.count() > 0:
        turn += 1

        def ranked(name: str) -> Column:
            place = F.xxhash64(F.col(name), F.lit(turn)) if turn > 1 else F.lit(0).cast("long")
            return F.struct(place.alias("h"), F.col(name).alias("n"))

        both = links.union(links.select("b", "a"))
        step = both.groupBy(F.col("a").alias("label")).agg(
            F.min(ranked("b")).alias("low"), F.count("*").alias("rows")
        )
        step = step.withColumn("low", F.least(ranked("label"), F.col("low"))["n"])
        # One hop further: the target of the target comes no later.
        ahead = step.select(F.col("label").alias("low"), F.col("low").alias("next"))
        step = step.join(ahead, "low", "left").select(
            "label", F.coalesce("next", "low").alias("low"), "rows"
        )
        step = tables.save(step, f"step-{turn}")

        def moved(df: DataFrame, old: str, new: str, other: str) -> DataFrame:
            renamed = df.withColumnRenamed(old, "label")
            found = join_back(renamed, step, "label", "rows", F.col(other))
            return found.withColumn(new, F.coalesce("low", "label")).drop("label", "low")

        contracted = moved(moved(links, "a", "x", "b"), "b", "y", "x")
        ordered = contracted.where("x != y").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
        )
        links = tables.save(ordered.distinct(), f"links-{turn}")
        # A label stands for many nodes; its weight decides whether it is a heavy key.
        weights = labels.groupBy("label").agg(F.count("*").alias("rows"))
        mapped = join_back(labels, step.drop("rows").join(weights, "label"), "label", "rows", F.col("node"))
        labels = tables.save(
            mapped.select("node", F.coalesce("low", "label").alias("label")), f"labels-{turn}"
        )
        tables.release(f"links-{turn - 1}", f"labels-{turn - 1}", f"step-{turn}")
    names = labels.groupBy("label").agg(F.min("node").alias("component"), F.count("*").alias("rows"))
    return join_back(labels, names, "label", "rows", F.col("node")).select("node", "component")


# --- references -------------------------------------------------------------------------------


def visible_lines(content: Column | str) -> Column:
    """Text outside fenced code and without inline code spans."""
    unfenced = F.regexp_replace(
        col(content),
        r"(?sm)^[ \t]{0,3}(?:(`{3,})[^\n]*(?:\n|\z)(?:.*?^[ \t]{0,3}\1`*[ \t]*$|.*\z)"
        r"|(~{3,})[^\n]*(?:\n|\z)(?:.*?^[ \t]{0,3}\2~*[ \t]*$|.*\z))",
        "",
    )
    return F.regexp_replace(unfenced, r"(`+)[^\n]*?\1", "")


def extract_references(documents: DataFrame) -> DataFrame:
    """(doc, pos, ref) for every ``@path`` mention outside code."""
    found = extract_all(visible_lines("content"), r"(?<![A-Za-z0-9_])@([^\s`<>]+)", 1)
    cleaned = F.filter(
        F.transform(found, lambda r: F.regexp_replace(r, r"[.,;:!?)\]}]+$", "")), lambda r: r != ""
    )
    found = documents.select("doc", F.posexplode_outer(cleaned).alias("pos", "ref"))
    return found.where(F.col("pos").isNotNull())


def fold_path(path: Column) -> Column:
    """Remove ``.`` and resolve ``..`` in an absolute path."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def resolve_reference(doc: Column | str, ref: Column | str, home: str = "/home/user") -> Column:
    """Absolute path of a reference: absolute, below home, or next to the containing document."""
    target, base = col(ref), col(doc)
    parent = F.regexp_extract(base, r"^(.*)/[^/]*$", 1)
    chosen = (
        F.when(target.startswith("~/"), F.concat(F.lit(home), F.substr(target, F.lit(2))))
        .when(target.startswith("/"), target)
        .otherwise(F.concat_ws("/", parent, target))
    )
    return let(chosen, fold_path)


def reference_edges(documents: DataFrame, home: str = "/home/user") -> DataFrame:
    """Distinct (src, dst) references between documents, resolved."""
    refs = extract_references(documents)
    return refs.select(
        F.col("doc").alias("src"), resolve_reference("doc", "ref", home).alias("dst")
    ).distinct()


def dangling_edges(edges: DataFrame, nodes: DataFrame, node: str = "doc") -> DataFrame:
    """References whose target is not a node."""
    return edges.join(nodes.select(F.col(node).alias("dst")), "dst", "left_anti")


def bounded_closure(
    roots: DataFrame, edges: DataFrame, max_depth: int = lx.MAX_REFERENCE_DEPTH
) -> DataFrame:
    """(node, depth) for every depth at which a node is reached within ``max_depth`` hops.

    Levels hold distinct nodes, not paths, so a hub that many paths share is expanded once per
    level. The number of levels is fixed, the plan is one chain of joins.
    """
    links = edges.select("src", "dst").distinct()
    level = roots.select(F.col("node")).distinct().withColumn("depth", F.lit(0))
    reached = level
    for depth in range(1, max_depth + 1):
        level = (
            level.select(F.col("node").alias("src"))
            .join(links, "src")
            .select(F.col("dst").alias("node"))
            .distinct()
            .withColumn("depth", F.lit(depth))
        )
        reached = reached.unionByName(level)
    return reached


def closure_violations(
    roots: DataFrame, edges: DataFrame, nodes: DataFrame, max_depth: int = lx.MAX_REFERENCE_DEPTH
) -> DataFrame:
    """(code, src, dst): dangling targets, references beyond the last hop, edges on a cycle."""
    reached = cut_lineage(bounded_closure(roots, edges, max_depth))
    inside = reached.select(F.col("node").alias("src")).distinct()
    live = edges.select("src", "dst").distinct().join(inside, "src", "left_semi")
    existing = nodes.select(F.col("doc").alias("node"))
    dangling = dangling_edges(live, nodes).select(
        F.lit("dangling_reference").alias("code"), "src", "dst"
    )
    last = reached.where(F.col("depth") == max_depth).join(existing, "node", "left_semi")
    deep = live.join(last.select(F.col("node").alias("src")), "src", "left_semi").select(
        F.lit("depth_exceeded").alias("code"), "src", "dst"
    )
    # Peel nodes without incoming or outgoing edges; after max_depth + 1 rounds an edge that is
    # left lies on a cycle or on a path that is too long anyway.
    core, size = cut_lineage_counted(live)
    for _ in range(max_depth + 1):
        if size == 0:
            break
        core = core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        core = core.join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        before = size
        core, size = cut_lineage_counted(core.select("src", "dst"))
        if size == before:
            break
    found = dangling.unionByName(deep)
    if size == 0:
        return found
    walks = core.select(F.col("src").alias("start"), "src", "dst")
    cycles = walks.where("start = dst").select("src", "dst")
    frontier = walks.where("start != dst").select("start", F.col("dst").alias("node")).distinct()
    for _ in range(max_depth):
        nxt = frontier.join(core.withColumnRenamed("src", "node"), "node")
        cycles = cycles.union(nxt.where("start = dst").select(F.col("node").alias("src"), "dst"))
        frontier = nxt.where("start != dst").select("start", F.col("dst").alias("node")).distinct()
    circular = cycles.distinct().select(F.lit("circular_reference").alias("code"), "src", "dst")
    return found.unionByName(circular)


def reference_chains(
    roots: DataFrame, edges: DataFrame, nodes: DataFrame, max_depth: int = lx.MAX_REFERENCE_DEPTH
) -> DataFrame:
    """(code, chain): every chain of references from a root that must be cut.

    A chain ends at a document that it already holds (``circular_reference``), at a target that is no
    document (``dangling_reference``), or one hop beyond ``max_depth`` (``depth_exceeded``); what lies
    behind is not followed. Chains are carried as paths, so before each hop a path is kept only if its
    end still can lead to such a place in the hops that are left: a sound graph carries no paths.
    """
    links = cut_lineage(edges.select("src", "dst").distinct())
    loose = dangling_edges(links, nodes).select("dst").distinct().withColumn("loose", F.lit(True))

    def before(ends: DataFrame) -> DataFrame:
        named = ends.select(F.col("node").alias("dst"))
        return links.join(named, "dst", "left_semi").select(F.col("src").alias("node"))

    # By hops: nodes with a walk of so many references, and with a dangling target in at most so many.
    opened = [None, cut_lineage(links.select(F.col("src").alias("node")).distinct())]
    nearby = [None, cut_lineage(before(loose.select(F.col("dst").alias("node"))).distinct())]
    for _ in range(max_depth):
        opened.append(cut_lineage(before(opened[-1]).distinct()))
        nearby.append(cut_lineage(before(nearby[-1]).union(nearby[-1]).distinct()))
    paths = roots.select(F.col("node").alias("src"), F.array("node").alias("path")).distinct()
    found = None
    for depth in range(max_depth + 1):
        left = max_depth + 1 - depth
        useful = opened[left].union(nearby[left]).distinct().withColumnRenamed("node", "src")
        steps = (
            paths.join(useful, "src", "left_semi")
            .join(links, "src")
            .join(loose, "dst", "left")
            .select(
                "path", "dst",
                F.when(F.array_contains("path", F.col("dst")), "circular_reference")
                .when(F.lit(depth == max_depth), "depth_exceeded")
                .when(F.coalesce("loose", F.lit(False)), "dangling_reference")
                .alias("code"),
                F.concat("path", F.array("dst")).alias("chain"),
            )
        )
        steps = cut_lineage(steps)
        ended = steps.where("code IS NOT NULL").select("code", "chain")
        found = ended if found is None else found.union(ended)
        paths = steps.where("code IS NULL").select(
            F.col("dst").alias("src"), F.col("chain").alias("path")
        )
    return found


def graph_digest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts and order-independent digests of the nodes and edges of a graph.

    Digests are sums and exclusive-ors of member hashes, so they are partial aggregates; no task
    ever holds the whole graph.
    """
    node_sha = content_sha(F.concat_ws("\x00", *[F.col(c).cast("string") for c in sorted(nodes.columns)]))
    edge_sha = content_sha(F.concat_ws("\x00", "src", "dst"))

    def folded(df: DataFrame, sha: Column, name: str) -> DataFrame:
        value = digest_prefix(sha)
        return df.agg(
            F.count("*").alias(f"{name}s"),
            F.coalesce(F.bit_xor(value), F.lit(0)).alias("x"),
            F.coalesce(F.sum(F.pmod(value, F.lit(1 << 31))), F.lit(0)).alias("s"),
        ).select(
            f"{name}s",
            content_sha(F.concat_ws(":", f"{name}s", "x", "s")).alias(f"{name}_digest"),
        )

    return beside(folded(nodes, node_sha, "node"), folded(edges, edge_sha, "edge"))


def graph_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges added and removed between two graphs (change, src, dst)."""
    old = before.select("src", "dst").distinct().withColumn("_old", F.lit(1))
    new = after.select("src", "dst").distinct().withColumn("_new", F.lit(1))
    joined = old.join(new, ["src", "dst"], "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
    return joined.withColumn("change", change).where("change is not null").select(
        "change", "src", "dst"
    )


def read_only_context(nodes: DataFrame, configured: DataFrame) -> DataFrame:
    """Graph nodes that are not among the configured documents."""
    return nodes.join(configured.select("doc").distinct(), "doc", "left_anti")


def lineage_chain(runs: DataFrame, max_depth: int = lx.MAX_DECISION_DEPTH) -> DataFrame:
    """Depth and status of every run in its chain of parents.

    ``runs`` has run_id, parent_run_id, request_id, fingerprint (those of the request that led to
    the run; null for a first run). A chain is followed for ``max_depth + 1`` parents at most: a
    longer one is refused whatever comes before. Repeated requests or fingerprints are refused.
    """
    parents = runs.select(
        F.col("run_id").alias("_up"),
        F.col("parent_run_id").alias("_next"),
        F.col("request_id").alias("_request"),
        F.col("fingerprint").alias("_mark"),
    )
    empty = F.array().cast("array<string>")
    chain = runs.select(
        "run_id",
        "request_id",
        "fingerprint",
        F.col("parent_run_id").alias("_up"),
        F.when(F.col("parent_run_id").isNull(), 0).otherwise(1).alias("depth"),
        empty.alias("earlier_requests"),
        empty.alias("earlier_marks"),
    )
    for _ in range(max_depth):
        chain = chain.join(parents, "_up", "left").select(
            "run_id",
            "request_id",
            "fingerprint",
            F.col("_next").alias("_up"),
            (F.col("depth") + F.col("_next").isNotNull().cast("int")).alias("depth"),
            F.array_compact(F.concat("earlier_requests", F.array("_request"))).alias(
                "earlier_requests"
            ),
            F.array_compact(F.concat("earlier_marks", F.array("_mark"))).alias("earlier_marks"),
        )
    repeated = F.array_contains("earlier_requests", F.col("request_id")) | F.array_contains(
        "earlier_marks", F.col("fingerprint")
    )
    status = (
        F.when(F.col("depth") > max_depth, "decision_depth_exceeded")
        .when(F.coalesce(repeated, F.lit(False)), "decision_replayed")
        .otherwise("accepted")
    )
    return chain.select("run_id", "depth", status.alias("status"))
