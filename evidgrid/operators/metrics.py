"""Before/after metrics, budgets, safety gates and outcome classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidgrid import lexicon as lx
from evidgrid.functions.redaction import residual_secrets
from evidgrid.functions.text import line_count, utf8_bytes
from evidgrid.operators.rules import first_code
from evidgrid.operators.skew import running_total


def document_sizes(documents: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(doc, blocks, bytes, lines) per document."""
    sizes = documents.select(
        "doc", utf8_bytes("content").alias("bytes"), line_count("content").alias("lines")
    )
    if blocks is None:
        return sizes.withColumn("blocks", F.lit(0).cast("long"))
    counts = blocks.groupBy("doc").agg(F.count("*").alias("blocks"))
    joined = sizes.join(counts, "doc", "left")
    return joined.withColumn("blocks", F.coalesce("blocks", F.lit(0).cast("long")))


def before_after(
    pre: DataFrame, post: DataFrame, changed: DataFrame | None = None, key: str = "doc"
) -> DataFrame:
    """Pre, post and delta of blocks, bytes and lines per document and in total (key null).

    ``pre`` and ``post`` are ``document_sizes`` (or sums of them); ``changed``: doc, changed,
    escalated counts. One pass with grouping sets gives both levels.
    """
    names = ("blocks", "bytes", "lines")
    old = pre.select(key, *[F.col(n).alias(f"pre_{n}") for n in names])
    new = post.select(key, *[F.col(n).alias(f"post_{n}") for n in names])
    joined = old.join(new, key, "full")
    if changed is None:
        zero = F.lit(0).cast("long")
        joined = joined.withColumn("changed", zero).withColumn("escalated", zero)
    else:
        joined = joined.join(changed, key, "left")
    sums = [
        F.coalesce(F.sum(c), F.lit(0)).alias(c)
        for c in [f"{side}_{n}" for side in ("pre", "post") for n in names] + ["changed", "escalated"]
    ]
    grouped = joined.groupingSets([[key], []], key).agg(F.grouping(key).alias("is_total"), *sums)
    for n in names:
        grouped = grouped.withColumn(f"{n}_delta", F.col(f"post_{n}") - F.col(f"pre_{n}"))
    return grouped


def change_counts(changes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc, changed, escalated): sources per document by kind of action."""
    exploded = changes.select("action", F.explode("source_ids").alias("block_id"))
    return (
        exploded.join(blocks.select("block_id", "doc"), "block_id")
        .groupBy("doc")
        .agg(
            F.count_if(F.col("action") != "escalate").alias("changed"),
            F.count_if(F.col("action") == "escalate").alias("escalated"),
        )
    )


def byte_budget(documents: DataFrame, in_class: Column, limit: int) -> DataFrame:
    """Sum of post bytes over a class of files against a limit; exactly at the limit passes."""
    totals = documents.where(in_class).agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("post_bytes")
    )
    status = F.when(F.col("post_bytes") > limit, "instruction_budget").otherwise("within_budget")
    return totals.withColumn("limit", F.lit(limit).cast("long")).withColumn("status", status)


def disposition_counts(keep: DataFrame, changes: DataFrame) -> DataFrame:
    """One row with the number of blocks per disposition."""
    kept = keep.select(F.lit("keep").alias("action"), F.lit(1).alias("n"))
    moved = changes.select("action", F.size("source_ids").alias("n"))
    return kept.unionByName(moved).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("action") == a, F.col("n"))), F.lit(0)).alias(a)
            for a in ("keep", "replace", "remove", "relocate", "escalate")
        ]
    )


def summary_line() -> Column:
    """Sentence over the columns of ``disposition_counts`` and the totals."""
    return F.format_string(
        "%d blocks became %d (%+d): %d keep, %d replace, %d remove, %d relocate, %d escalate; "
        "%d bytes became %d (%+d).",
        *[
            F.col(c)
            for c in (
                "pre_blocks post_blocks blocks_delta keep replace remove relocate escalate "
                "pre_bytes post_bytes bytes_delta"
            ).split()
        ],
    )


def change_limit(total: Column, ratio: float) -> Column:
    """A ratio that still allows a single repair."""
    if ratio <= 0:
        return F.lit(0).cast("long")
    return F.greatest(F.lit(1), F.floor(total * F.lit(float(ratio)))).cast("long")


def size_gate(
    pre: Column,
    post: Column,
    floor: float = lx.SIZE_FLOOR_RATIO,
    ceiling: float = lx.SIZE_CEILING_RATIO,
    slack: int = lx.SIZE_SLACK_BYTES,
) -> Column:
    """True when the size left its bounds; the bounds themselves pass."""
    return (pre > 0) & ((post < pre * floor) | (post > F.greatest(pre * ceiling, pre + slack)))


def document_gates(
    documents: DataFrame, secret: Column | None = None, **bounds: float
) -> DataFrame:
    """Code of the first violated gate per document (pre, post texts)."""
    pre, post = F.col("pre"), F.col("post")
    blank = r"(?s)\A\s*\z"
    rules = [
        ("empty_target", ~pre.rlike(blank) & post.rlike(blank)),
        ("size_ratio", size_gate(utf8_bytes(pre), utf8_bytes(post), **bounds)),
        (
            "secret_in_proposal",
            secret if secret is not None else F.size(residual_secrets(post)) > 0,
        ),
    ]
    return documents.withColumn("code", first_code(rules))


def run_gates(runs: DataFrame, churn: float = lx.MAX_CHURN_RATIO) -> DataFrame:
    """Code per run from pre_blocks, post_blocks, introductions, changed, confirmed_left."""
    rules = [
        ("directive_count_growth", F.col("post_blocks") > F.col("pre_blocks") + F.col("introductions")),
        ("non_idempotent_proposal", (F.col("changed") > 0) & (F.col("confirmed_left") > 0)),
        ("excessive_churn", F.col("changed") > change_limit(F.col("pre_blocks"), churn)),
    ]
    return runs.withColumn("code", first_code(rules))


def reversibility(runs: DataFrame) -> DataFrame:
    """``mode``: unattended for small, harmless, unblocked edits, else attended.

    Needs changed, writable_changes, changed_sources, suggestions, harmless, confirmations,
    blocked, conflicts, decision, operator_decision, pre_blocks.
    """
    small = (F.col("writable_changes") + F.col("suggestions") <= 2) & (
        F.col("changed_sources") <= change_limit(F.col("pre_blocks"), lx.UNATTENDED_CHURN_RATIO)
    )
    free = ~F.col("blocked") & ~F.col("decision") & ~F.col("operator_decision") & (F.col("conflicts") == 0)
    ok = (F.col("changed") > 0) & small & free & F.col("harmless") & (F.col("confirmations") == 0)
    return runs.withColumn("mode", F.when(ok, "unattended").otherwise("attended"))


def run_outcome(runs: DataFrame) -> DataFrame:
    """Outcome class and whether somebody has to act.

    Needs rejected (boolean), changed, escalated, nominations, nominations_rejected, and the
    arrays defect_classes and confirmed_classes.
    """
    none_found = F.size("defect_classes") == 0
    outcome = (
        F.when(F.col("rejected"), "drafter_rejected")
        .when(F.col("changed") > 0, "reversible_change_ready")
        .when(F.col("escalated") > 0, "enforcement_candidates")
        .when(
            none_found & (F.col("nominations") == 0) & (F.col("nominations_rejected") > 0),
            "semantic_analysis_inconclusive",
        )
        .when(none_found & (F.col("nominations") == 0), "stable_noop")
        .when(~none_found, "reviewed_noop")
        .otherwise("semantic_review_required")
    )
    flagged = runs.withColumn("outcome", outcome)
    acts = F.col("outcome").isin(*lx.ATTENTION_OUTCOMES) | (F.col("escalated") > 0)
    if "blocked" in runs.columns:
        acts = acts | F.col("blocked")
    return flagged.withColumn("action_required", acts)


def usage_totals(
    calls: DataFrame, by: list[str], max_calls: int, max_input: int, max_output: int
) -> DataFrame:
    """Sums of calls and tokens per run, with the first exceeded budget."""
    totals = calls.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("calls", "estimated_input", "input_tokens", "output_tokens")]
    )
    rules = [
        ("call_budget_exceeded", F.col("calls") > max_calls),
        (
            "input_budget_exceeded",
            (F.col("input_tokens") > max_input) | (F.col("estimated_input") > max_input),
        ),
        ("output_budget_exceeded", F.col("output_tokens") > max_output),
    ]
    return totals.withColumn("code", first_code(rules))


def pack_budget(
    rows: DataFrame, group: list[str], rank: list[str], cost: Column, limit: int, required: Column
) -> DataFrame:
    """Keep the best-ranked rows of each group within a byte limit.

    Required rows always stay and reduce the room. Evicting the lowest-ranked removable row until
    the rest fits keeps exactly the longest prefix in rank order, so a running total decides every
    row at once. ``rank`` columns sort best first. Adds kept and over_budget (required rows alone
    exceed the limit).
    """
    priced = rows.withColumn("_cost", cost.cast("long")).withColumn("_required", required)
    base = priced.groupBy(*group).agg(
        F.coalesce(F.sum(F.when(F.col("_required"), F.col("_cost"))), F.lit(0)).alias("_fixed"),
        F.count("*").alias("_rows"),
    )
    charged = F.when(F.col("_required"), F.lit(0)).otherwise(F.col("_cost")).cast("long")
    running = running_total(priced, group, rank, charged, "_run")
    joined = running.join(base, group)
    kept = F.col("_required") | (F.col("_run") + F.col("_fixed") <= limit)
    return joined.select(
        *rows.columns, kept.alias("kept"), (F.col("_fixed") > limit).alias("over_budget")
    )


def keep_consistent(overlaps: DataFrame, kept_events: DataFrame) -> DataFrame:
    """Overlaps whose evidence was kept."""
    return overlaps.join(kept_events.select("event_id").distinct(), "event_id", "left_semi")


def dropped_ids(*parts: DataFrame) -> DataFrame:
    """Union of the ids dropped in any step."""
    united = parts[0].select("event_id")
    for part in parts[1:]:
        united = united.union(part.select("event_id"))
    return united.distinct()
