"""Inspection and verification as compositions of operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidgrid import lexicon as lx
from evidgrid.lexicon import DEFAULT_LEXICON, Lexicon
from evidgrid.operators import clusters as cl
from evidgrid.operators import evidence as ev
from evidgrid.operators import suite as su
from evidgrid.operators.ingest import classify, dedup_latest, emitted_events, quality_flags, source_stats
from evidgrid.session import cut_lineage


@dataclass(frozen=True)
class Inspection:
    """DataFrames of one inspection; nothing beyond the shared narrow tables has run yet."""

    events: DataFrame
    scores: DataFrame
    selected: DataFrame
    overlaps: DataFrame
    clusters: DataFrame
    cluster_members: DataFrame
    cluster_evidence: DataFrame
    stats: DataFrame


def inspect(
    raw: DataFrame,
    blocks: DataFrame,
    as_of: Column,
    max_events: int = lx.MAX_EVENTS,
    lookback_days: int = 0,
    lexicon: Lexicon = DEFAULT_LEXICON,
) -> Inspection:
    """From classified source rows and segmented blocks to samples, overlaps and clusters.

    Redaction, the expensive step, is written once with its outcome; counters and events read the
    written rows.
    """
    classified = cut_lineage(classify(raw, as_of, lookback_days))
    stats = quality_flags(source_stats(classified))
    events = dedup_latest(emitted_events(classified))
    keep = ["event_id", "source_kind", "authority", "ts", "session_id"]
    narrow = ev.text_features(events, [*keep, *ev.polarity_columns("text", lexicon)], "text", lexicon)
    subjects = blocks.select("block_id", F.col("raw").alias("text"), "heading_path")
    scores = ev.score_events(narrow, subjects, lexicon, keep_tokens=True)
    selected = cut_lineage(ev.select_events(scores, as_of, max_events))
    overlaps = ev.opposite_polarity(subjects, selected, lexicon)
    clusters, members, evidence = cl.derive_clusters(blocks, overlaps, lexicon)
    return Inspection(events, scores, selected, overlaps, clusters, members, evidence, stats)


def verify(
    results: DataFrame, cases: DataFrame, detectors: Mapping[str, Sequence[str]], repeats: int
) -> DataFrame:
    """Verdict per case from recorded steps.

    ``results``: condition, case_id, steps; ``cases``: case_id, allowed, required, forbidden,
    ordered, control_must_underperform (a suite has at most 32 cases).
    """
    joined = results.join(cases, "case_id")
    failures = su.conformance(
        F.col("actions"), F.col("required"), F.col("forbidden"), F.col("ordered")
    )
    judged = su.detect(joined, detectors).withColumn("passed", F.size(failures) == 0)
    matrix = su.pass_matrix(judged)
    flags = cases.select("case_id", "control_must_underperform")
    complete = flags.join(matrix, "case_id", "left").fillna(0, ["control", "pre", "post"])
    return su.verdicts(complete, repeats)
