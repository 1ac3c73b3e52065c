"""Duplicate and exception clusters over blocks, their merge, scores and summaries.

A cluster is a set of rows (cluster_id, block_id) plus one summary row. Members are never gathered
into one array: a group of copies may hold a large share of all blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidgrid import lexicon as lx
from evidgrid.functions.exprs import led
from evidgrid.functions.identity import content_sha, digest_prefix
from evidgrid.functions.text import subject_terms, utf8_bytes
from evidgrid.lexicon import DEFAULT_LEXICON, Lexicon
from evidgrid.operators.graph import connected_components, star_edges
from evidgrid.operators.skew import join_back
from evidgrid.session import cut_lineage

NUL = "\x00"


def location_key(doc: str = "doc", heading: str = "heading_path") -> Column:
    return F.concat_ws(NUL, F.col(doc), F.array_join(heading, "\x1f"))


def cluster_identity(location: Column, count: Column, xor: Column, total: Column) -> Column:
    """Id from the place and an order-independent digest of the members."""
    material = F.concat_ws(NUL, location, count.cast("string"), xor.cast("string"), total.cast("string"))
    return F.concat(F.lit("cand_"), F.left(content_sha(material), F.lit(16)))


def _facts(blocks: DataFrame, *more: Column | str) -> DataFrame:
    """What clusters need of a block: no text, only its size."""
    return blocks.select(
        "block_id", "doc", "heading_path", "start", utf8_bytes("raw").alias("bytes"), *more
    )


def _summaries(facts: DataFrame, group: str, reason: str, minimum: int) -> DataFrame:
    """Aggregate the blocks of each group to one summary row."""
    number = digest_prefix(content_sha("block_id"))
    grouped = facts.groupBy(group).agg(
        F.first("doc").alias("doc"),
        F.first("heading_path").alias("heading_path"),
        F.count("*").alias("members"),
        F.sum("bytes").alias("pre_bytes"),
        F.min(F.struct("start", "block_id"))["block_id"].alias("first_block"),
        F.bit_xor(number).alias("_x"),
        F.sum(F.pmod(number, F.lit(1 << 31))).alias("_s"),
    )
    kept = grouped.where(F.col("members") >= minimum)
    identity = cluster_identity(location_key(), F.col("members"), F.col("_x"), F.col("_s"))
    return kept.withColumn("cluster_id", identity).withColumn("reason", F.lit(reason)).drop("_x", "_s")


def _clustered(
    facts: DataFrame, group: str, reason: str, minimum: int
) -> tuple[DataFrame, DataFrame]:
    summaries = _summaries(facts, group, reason, minimum)
    lookup = summaries.select(group, "cluster_id", F.col("members").alias("rows"))
    rows = facts.select("block_id", "start", group)
    members = join_back(rows, lookup, group, "rows", F.col("block_id"))
    members = members.where(F.col("cluster_id").isNotNull())
    return summaries.drop(group), members.select("cluster_id", "block_id", "start")


def exact_duplicates(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summaries, members) of equal normalized blocks at one place, protected blocks aside."""
    usable = blocks.where(~F.col("protected") & (F.col("normalized") != ""))
    key = content_sha(F.concat_ws(NUL, location_key(), "normalized")).alias("_key")
    facts = cut_lineage(_facts(usable, key))
    return _clustered(facts, "_key", "exact_duplicate", 2)


#: Items with more shared terms than this are not expanded to pairs of terms.
LARGE_TERMS = 64


def shared_term_edges(items: DataFrame, minimum: int = 2, large: int = LARGE_TERMS) -> DataFrame:
    """Edges that have the components of all items of one place that share at least two terms.

    ``items``: item, place, terms. Terms that a place uses once cannot be shared and are removed first.
    Items of up to ``large`` terms share two exactly when they have a pair of terms in common: they are
    linked through term pairs in stars, and no list of item pairs is built. The few larger ones count
    the terms that they have in common with any other item over the lists of their own terms, so an
    item with n terms costs the rows of n lists, not n * n pairs.
    """
    if minimum != 2:
        raise ValueError("pairs of terms express an overlap of two")
    exploded = items.select("item", "place", F.explode(F.array_distinct("terms")).alias("term"))
    keyed = cut_lineage(exploded.select("item", F.unhex(F.md5(F.concat_ws(NUL, "place", "term"))).alias("_key")))
    counts = keyed.groupBy("_key").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    counts = cut_lineage(counts)
    shared = join_back(keyed, counts.withColumn("shared", F.lit(True)), "_key", "rows", F.col("item"))
    # One array per item: bounded by the text of the item. Keys already contain the place.
    usable = cut_lineage(
        shared.where(F.col("shared"))
        .groupBy("item")
        .agg(F.sort_array(F.collect_list("_key")).alias("terms"))
        .where(F.size("terms") >= 2)
    )
    small = usable.where(F.size("terms") <= large)
    placed = small.select("item", "terms", F.posexplode("terms").alias("at", "first"))
    later = F.slice("terms", F.col("at") + 2, F.size("terms"))
    keys = placed.select("item", "first", F.explode(later).alias("second")).select(
        "item", F.unhex(F.md5(F.concat("first", "second"))).alias("key")
    )
    stars = star_edges(keys, "key", "item")
    big = usable.where(F.size("terms") > large).select(
        F.col("item").alias("a"), F.explode("terms").alias("_key")
    )
    others = usable.select(F.col("item").alias("b"), F.explode("terms").alias("_key"))
    common = big.join(others, "_key").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return stars.union(common.where(F.col("n") >= minimum).select("a", "b"))


def exception_components(
    blocks: DataFrame, claimed: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON
) -> tuple[DataFrame, DataFrame]:
    """(summaries, members) of exception-bearing blocks linked by shared subject terms."""
    bearing = (
        blocks.where(~F.col("protected") & F.col("raw").rlike(led(lexicon.exception)))
        .join(claimed.select("block_id").distinct(), "block_id", "left_anti")
    )
    # Blocks are linked by number: groups with a smallest number are hashed, with a string sorted.
    facts = cut_lineage(
        _facts(
            bearing,
            subject_terms("raw", "blocks", lexicon).alias("terms"),
            F.monotonically_increasing_id().alias("node"),
        )
    )
    items = facts.select(F.col("node").alias("item"), location_key().alias("place"), "terms")
    components = connected_components(shared_term_edges(items))
    placed = facts.drop("terms").join(components, "node")
    return _clustered(placed, "component", "exception_lineage", 2)


def qualified_evidence(overlaps: DataFrame) -> DataFrame:
    """(block_id, event_id) pairs with at least two distinct shared terms, ignoring case."""
    terms = F.array_distinct(F.transform("shared_terms", F.lower))
    kept = F.filter(terms, lambda t: F.trim(t) != "")
    return overlaps.where(F.size(kept) >= 2).select("block_id", "event_id").distinct()


def attach_evidence(
    summaries: DataFrame, members: DataFrame, evidence: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Summaries with the number of distinct events, and the rows (cluster_id, event_id)."""
    rows = members.join(evidence, "block_id").select("cluster_id", "event_id").distinct()
    counts = rows.groupBy("cluster_id").agg(F.count("*").alias("evidence"))
    joined = summaries.join(counts, "cluster_id", "left")
    return joined.withColumn("evidence", F.coalesce("evidence", F.lit(0))), rows


def importance(lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Structural weight from evidence, reason, heading_path."""
    heading = F.array_join("heading_path", " ")
    score = (
        F.least(F.lit(40), F.col("evidence") * 8)
        + F.when(heading.rlike(lexicon.required_heading), 10).otherwise(0)
        + F.when(F.col("reason") == "exact_duplicate", 80).otherwise(0)
        + F.when(F.col("reason") == "exception_lineage", 60).otherwise(0)
    )
    return F.least(F.lit(100), score).cast("long")


def derive_clusters(
    blocks: DataFrame, overlaps: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summaries, members, evidence rows) of all structural clusters."""
    duplicates, duplicate_members = exact_duplicates(blocks)
    linked, linked_members = exception_components(blocks, duplicate_members, lexicon)
    summaries = duplicates.unionByName(linked)
    members = duplicate_members.unionByName(linked_members)
    summaries, rows = attach_evidence(summaries, members, qualified_evidence(overlaps))
    return summaries.withColumn("importance", importance(lexicon)), members, rows


def cluster_order() -> list[Column]:
    """Most important first; sizes only make the order stable."""
    return [
        F.col("importance").desc(),
        F.col("members").desc(),
        F.col("pre_bytes").desc(),
        F.col("doc"),
        F.array_join("heading_path", "\x1f"),
        F.col("cluster_id"),
    ]


def candidate_summary(summaries: DataFrame) -> DataFrame:
    """One row: status, counts, bytes and the defect classes, confirmed and for review.

    ``reason_codes`` is an array; the number of classes is fixed by the rules.
    """
    classes = F.sort_array(F.array_distinct(F.flatten(F.collect_set("reason_codes"))))
    totals = summaries.agg(
        F.count("*").alias("clusters"),
        F.coalesce(F.sum("members"), F.lit(0)).alias("blocks"),
        F.coalesce(F.sum("pre_bytes"), F.lit(0)).alias("pre_bytes"),
        classes.alias("defect_classes"),
    )
    confirmed = F.filter("defect_classes", lambda c: c == "exact_duplicate")
    review = F.filter("defect_classes", lambda c: c != "exact_duplicate")
    return (
        totals.withColumn("confirmed_classes", confirmed)
        .withColumn("review_classes", review)
        .withColumn(
            "status",
            F.when(F.size("confirmed_classes") > 0, "defects_detected")
            .when(F.size("review_classes") > 0, "review_candidates_detected")
            .otherwise("no_detectable_defects"),
        )
        .withColumn(
            "semantic", F.exists("defect_classes", lambda c: c.startswith("semantic_"))
        )
    )


def nomination_clusters(nominations: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Admitted nominations in cluster form (summaries, members, evidence rows)."""
    weights = F.create_map(*[F.lit(part) for pair in lx.CLASS_WEIGHTS.items() for part in pair])
    mutable = nominations.where(
        (F.col("admission") == "mutable_candidate") & (F.size("source_ids") > 0)
    ).withColumn("cluster_id", F.col("nomination_id"))
    places = blocks.select(
        F.col("block_id").alias("first_block"), "doc", "heading_path"
    )
    summaries = (
        mutable.select(
            "cluster_id",
            F.element_at("source_ids", 1).alias("first_block"),
            F.concat(F.lit("semantic_"), "candidate_class").alias("reason"),
            F.coalesce(weights[F.col("candidate_class")], F.lit(lx.DEFAULT_CLASS_WEIGHT))
            .cast("long")
            .alias("importance"),
        )
        .join(places, "first_block")
    )
    members = mutable.select("cluster_id", F.explode("source_ids").alias("block_id"))
    rows = mutable.select("cluster_id", F.explode("evidence_ids").alias("event_id"))
    return summaries, members, rows


def merge_overlapping(
    summaries: DataFrame, members: DataFrame, evidence: DataFrame, blocks: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Union of clusters at one place that share a block, to the fixed point.

    ``summaries``: cluster_id, doc, heading_path, reason, importance. Clusters are linked through
    shared blocks in stars; the components are the merged clusters.
    """
    summaries, members = cut_lineage(summaries), cut_lineage(members)
    placed = members.join(
        summaries.select("cluster_id", location_key().alias("_place")), "cluster_id"
    ).withColumn("_key", content_sha(F.concat_ws(NUL, "_place", "block_id")))
    components = connected_components(star_edges(placed, "_key", "cluster_id"))
    mapping = summaries.select("cluster_id").distinct().join(
        components.select(F.col("node").alias("cluster_id"), "component"), "cluster_id", "left"
    )
    mapping = mapping.select("cluster_id", F.coalesce("component", "cluster_id").alias("merged"))
    grouped = summaries.join(mapping, "cluster_id").groupBy("merged").agg(
        F.first("doc").alias("doc"),
        F.first("heading_path").alias("heading_path"),
        F.sort_array(F.collect_set("reason")).alias("reason_codes"),
        F.max("importance").alias("importance"),
    )
    merged_members = members.join(mapping, "cluster_id").select("merged", "block_id").distinct()
    sizes = (
        merged_members.join(blocks.select("block_id", utf8_bytes("raw").alias("b")), "block_id")
        .groupBy("merged")
        .agg(F.count("*").alias("members"), F.sum("b").alias("pre_bytes"))
    )
    rows = evidence.join(mapping, "cluster_id").select("merged", "event_id").distinct()
    counts = rows.groupBy("merged").agg(F.count("*").alias("evidence"))
    joined = grouped.join(sizes, "merged").join(counts, "merged", "left")
    extra = F.least(F.lit(20), F.coalesce(F.col("evidence"), F.lit(0)) * 4)
    final = joined.withColumn("evidence", F.coalesce("evidence", F.lit(0))).withColumn(
        "importance", F.least(F.lit(100), F.col("importance") + extra).cast("long")
    )
    renamed = final.withColumnRenamed("merged", "cluster_id")
    return (
        renamed,
        merged_members.withColumnRenamed("merged", "cluster_id"),
        rows.withColumnRenamed("merged", "cluster_id"),
    )


def boundary_violations(clusters: DataFrame, members: DataFrame, blocks: DataFrame) -> DataFrame:
    """(code, block_id): blocks in two clusters, unknown or protected blocks, or at another place."""
    repeated = members.groupBy("block_id").agg(F.count("*").alias("n")).where("n > 1")
    overlapping = repeated.select(F.lit("overlapping_clusters").alias("code"), "block_id")
    placed = members.join(
        clusters.select(
            "cluster_id", F.col("doc").alias("_doc"), F.col("heading_path").alias("_heading")
        ),
        "cluster_id",
    ).join(blocks.select("block_id", "doc", "heading_path", "protected"), "block_id", "left")
    code = (
        F.when(F.col("doc").isNull(), "unknown_block")
        .when(F.col("protected"), "protected_block")
        .when((F.col("doc") != F.col("_doc")) | (F.col("heading_path") != F.col("_heading")), "other_place")
    )
    wrong = placed.withColumn("code", code).where("code is not null").select("code", "block_id")
    return overlapping.unionByName(wrong)


def split_by_candidates(blocks: DataFrame, clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Role of every block: mutable (in a cluster), context (under a cluster's heading root), keep.

    The prefix test becomes an equality: every block lists its heading prefixes, which are at most
    as many as its heading levels.
    """
    path = F.col("heading_path")
    root = F.when(F.size(path) > 1, F.slice(path, 1, F.size(path) - 1)).otherwise(path)
    roots = clusters.select(
        content_sha(F.concat_ws(NUL, "doc", F.array_join(root, "\x1f"))).alias("_root")
    ).distinct()
    inside = members.select("block_id").distinct().withColumn("_mutable", F.lit(True))
    levels = F.sequence(F.lit(0), F.size(path))
    prefixes = F.transform(
        levels,
        lambda n: content_sha(F.concat_ws(NUL, F.col("doc"), F.array_join(F.slice(path, 1, n), "\x1f"))),
    )
    touched = (
        blocks.select("block_id", F.explode(prefixes).alias("_root"))
        .join(roots, "_root", "left_semi")
        .select("block_id")
        .distinct()
        .withColumn("_context", F.lit(True))
    )
    joined = blocks.join(inside, "block_id", "left").join(touched, "block_id", "left")
    role = (
        F.when(F.col("_mutable"), "mutable").when(F.col("_context"), "context").otherwise("keep")
    )
    return joined.withColumn("role", role).drop("_mutable", "_context")
