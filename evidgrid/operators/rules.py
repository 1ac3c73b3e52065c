"""Rule tables: every row is accepted or gets the code of the first rule it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidgrid import lexicon as lx
from evidgrid.functions.exprs import led, strip
from evidgrid.functions.identity import canonical_digest, independence_key, safe_line
from evidgrid.functions.redaction import has_high, redact, residual_secrets
from evidgrid.functions.text import (
    catch_alls,
    code_anchors,
    extract_terms,
    has_stage_gate,
    iso_instant,
    label_key,
    polarity_sign,
    repeated_phrase,
    subject_terms,
    substantive_quote,
    universal_prerequisite,
)
from evidgrid.session import cut_lineage

NUL = "\x00"
EMPTY = "array<string>"


def first_code(rules: list[tuple[str, Column]]) -> Column:
    """Code of the first violated rule, null when none is. An unknown condition does not fire."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules])


def split_by_code(df: DataFrame, code: str = "code") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(code).isNull()).drop(code), df.where(F.col(code).isNotNull())


def cited(df: DataFrame, key: str, ids: str, known: DataFrame, known_id: str) -> DataFrame:
    """(key, id, found, n): citations with the number of repeats and whether the id exists."""
    exploded = df.select(key, F.explode(ids).alias("id"))
    counted = exploded.groupBy(key, "id").agg(F.count("*").alias("n"))
    marks = known.select(F.col(known_id).alias("id")).distinct().withColumn("_hit", F.lit(True))
    joined = counted.join(marks, "id", "left")
    return joined.select(key, "id", F.coalesce("_hit", F.lit(False)).alias("found"), "n")


def only_cited(known: DataFrame, known_id: str, rows: DataFrame, ids: str) -> DataFrame:
    """The known rows whose id is cited."""
    named = rows.select(F.explode(ids).alias(known_id)).distinct()
    return known.join(named, known_id, "left_semi")


def citation_problems(df: DataFrame, key: str, ids: str, known: DataFrame, known_id: str) -> DataFrame:
    """(key, id, code) for unknown and repeated citations."""
    checked = cited(df, key, ids, known, known_id)
    code = F.when(~F.col("found"), "unknown").when(F.col("n") > 1, "duplicate")
    return checked.withColumn("code", code).where("code is not null").select(key, "id", "code")


def disposition_problems(blocks: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Every block exactly once: (block_id, code) for missing, unknown and repeated ones."""
    counted = dispositions.groupBy("block_id").agg(F.count("*").alias("n"))
    known = blocks.select("block_id").distinct().withColumn("_known", F.lit(True))
    joined = known.join(counted, "block_id", "full")
    code = (
        F.when(F.col("_known").isNull(), "unknown")
        .when(F.col("n").isNull(), "missing")
        .when(F.col("n") > 1, "duplicate")
    )
    return joined.select("block_id", code.alias("code")).where("code is not null")


def outside_allow_list(rows: DataFrame, column: str, allowed: DataFrame, allowed_column: str) -> DataFrame:
    """Rows whose destination is not an exact member of the allow list."""
    return rows.join(
        allowed.select(F.col(allowed_column).alias(column)).distinct(), column, "left_anti"
    )


# --- set rules ----------------------------------------------------------------------------------


def unsupported_terms(new: Column, *support: Column, synonyms: list[str] | None = None) -> Column:
    """Terms of the new text that no support has; synonyms of a supported one count as supported."""
    have = F.array_distinct(F.concat(*support))
    missing = F.array_except(new, have)
    if synonyms:
        group = F.array(*[F.lit(s) for s in synonyms])
        missing = F.when(
            F.arrays_overlap(have, group), F.array_except(missing, group)
        ).otherwise(missing)
    return missing


def dropped_terms(required: Column, new: Column) -> Column:
    return F.array_except(required, new)


def defect_outcome(confirmed: Column, review: Column, remaining: Column, touched: Column) -> Column:
    """Resolved, unresolved and addressed defect classes."""
    return F.struct(
        F.sort_array(F.array_except(confirmed, remaining)).alias("resolved"),
        F.sort_array(F.array_intersect(confirmed, remaining)).alias("unresolved"),
        F.sort_array(F.array_intersect(review, touched)).alias("addressed"),
        F.sort_array(F.array_except(review, touched)).alias("review_unresolved"),
    )


# --- support of terms by events -------------------------------------------------------------------


def best_support(wanted: DataFrame, events: DataFrame, minimum: int = 3) -> DataFrame:
    """(key, term, event_id): the best event that has the term and ``minimum`` wanted terms.

    ``wanted``: key, terms, all_terms; ``events``: event_id, terms, authority, correction_score,
    corroboration, ts. The rank starts with the size of the overlap, which depends on the event's
    term set only. So the best event of every distinct term set is enough: a term class has few
    words, hence few sets, however many events there are.
    """
    order = F.struct(
        (9 - F.col("authority")).alias("a"),
        F.col("correction_score").alias("c"),
        F.col("corroboration").alias("n"),
        F.col("ts").alias("t"),
        F.col("event_id").alias("i"),
    )
    sets = (
        events.select(F.array_join(F.sort_array("terms"), NUL).alias("_set"), order.alias("_best"))
        .where(F.col("_set") != "")
        .groupBy("_set")
        .agg(F.max("_best").alias("_best"))
        .withColumn("_terms", F.split("_set", NUL))
    )
    needs = wanted.select("key", "all_terms", F.explode("terms").alias("term"))
    shapes = needs.select(
        "term", F.array_join(F.sort_array("all_terms"), NUL).alias("_need")
    ).distinct()
    by_term = sets.select("_best", "_terms", F.explode("_terms").alias("term"))
    overlap = F.size(F.array_intersect("_terms", F.split("_need", NUL)))
    chosen = (
        shapes.join(by_term, "term")
        .withColumn("_overlap", overlap)
        .where(F.col("_overlap") >= minimum)
        .groupBy("term", "_need")
        .agg(F.max(F.struct("_overlap", "_best"))["_best"]["i"].alias("event_id"))
    )
    keyed = needs.withColumn("_need", F.array_join(F.sort_array("all_terms"), NUL))
    return keyed.join(chosen, ["term", "_need"]).select("key", "term", "event_id")


def baseline_support(wanted: DataFrame, kept: DataFrame) -> DataFrame:
    """(term, blocks, first_block) of the kept blocks that still have a wanted term."""
    terms = wanted.select(F.explode("terms").alias("term")).distinct()
    have = kept.select("block_id", F.explode(F.array_distinct("terms")).alias("term"))
    return have.join(terms, "term").groupBy("term").agg(
        F.count("*").alias("blocks"), F.min("block_id").alias("first_block")
    )


# --- nominations ----------------------------------------------------------------------------------


def _secret(text: Column) -> Column:
    return has_high(redact(text, None)["findings"]) | (F.size(residual_secrets(text)) > 0)


def validate_nominations(nominations: DataFrame, blocks: DataFrame, events: DataFrame) -> DataFrame:
    """Nominations with ``code`` (null = accepted), admission, reason and fingerprints.

    Citations are joined once per side and reduced to flags per nomination.
    """
    base = nominations.withColumn("_intent_terms", subject_terms("behavioral_intent", "analyst"))
    # Texts are looked at only where they are cited.
    blocks = only_cited(blocks, "block_id", nominations, "source_ids")
    events = only_cited(events, "event_id", nominations, "evidence_ids")
    place = F.concat_ws(NUL, "doc", F.array_join("heading_path", "\x1f"))
    known_blocks = blocks.select(
        F.col("block_id").alias("id"),
        "protected",
        place.alias("place"),
        subject_terms("raw", "analyst").alias("terms"),
    )
    sources = (
        base.select("index", "_intent_terms", F.explode("source_ids").alias("id"))
        .join(known_blocks, "id", "left")
        .groupBy("index")
        .agg(
            F.max(F.col("place").isNull()).alias("_unknown_source"),
            F.max("protected").alias("_protected"),
            (F.min("place") == F.max("place")).alias("_one_place"),
            F.flatten(F.collect_set(F.array_intersect("_intent_terms", F.col("terms")))).alias("_s"),
        )
    )
    witness = independence_key("session_id", "source_kind", "locator")
    scored = (F.col("directive_score") > 0) | (F.col("correction_score") > 0)
    known_events = events.select(
        F.col("event_id").alias("id"),
        F.lit(True).alias("hit"),
        ((F.length(strip("text")) < 12) | (F.size(subject_terms("text", "analyst")) < 2)).alias("small"),
        (F.col("source_kind") == "node_active").alias("node"),
        F.col("text").rlike(led(lx.EXPLICIT_DURABLE_PATTERN)).alias("durable"),
        ((F.col("correction_score") > 0) | F.col("text").rlike(led(lx.EXPLICIT_REVERSAL_PATTERN))).alias("reversal"),
        witness.alias("witness"),
        F.when(scored, witness).alias("scored_witness"),
        subject_terms("text", "analyst").alias("terms"),
        F.struct("content_sha256", F.col("event_id").alias("id"), iso_instant("ts").alias("timestamp")).alias("mark"),
    )
    evidence = (
        base.select("index", "_intent_terms", F.explode("evidence_ids").alias("id"))
        .join(known_events, "id", "left")
        .groupBy("index")
        .agg(
            F.max(F.col("hit").isNull()).alias("_unknown_evidence"),
            F.max("small").alias("_small"),
            F.max("node").alias("_node"),
            F.max("durable").alias("_durable"),
            F.max("reversal").alias("_reversal"),
            (F.min("witness") != F.max("witness")).alias("_two_witnesses"),
            (F.min("scored_witness") != F.max("scored_witness")).alias("_two_scored"),
            F.flatten(F.collect_set(F.array_intersect("_intent_terms", F.col("terms")))).alias("_e"),
            F.sort_array(F.collect_set("mark")).alias("_marks"),
        )
    )
    joined = base.join(sources, "index", "left").join(evidence, "index", "left")
    n_sources, n_evidence = F.size("source_ids"), F.size("evidence_ids")
    kind = F.col("candidate_class")
    false = F.lit(False)
    grounding = F.size(
        F.array_union(
            F.coalesce("_s", F.array().cast(EMPTY)), F.coalesce("_e", F.array().cast(EMPTY))
        )
    )
    fields = ("behavioral_intent", "reason", "applies_when", "does_not_apply_when")
    signal = F.coalesce("_node", false) | F.coalesce("_durable", false) | F.coalesce("_two_scored", false)
    rules = [
        ("invalid_semantic_nomination", ~kind.isin(*lx.CANDIDATE_CLASSES) | ~F.col("domain").isin(*lx.DOMAINS)),
        (
            "invalid_semantic_nomination",
            F.coalesce("_unknown_source", false) | (F.size(F.array_distinct("source_ids")) != n_sources),
        ),
        ("invalid_missing_rule", (kind == "missing_rule") & (n_sources > 0)),
        ("invalid_semantic_nomination", (kind != "missing_rule") & (n_sources == 0)),
        ("protected_change", F.coalesce("_protected", false)),
        ("missing_evidence", kind.isin(*lx.EVIDENCE_REQUIRED_CLASSES) & (n_evidence == 0)),
        ("unknown_evidence", F.coalesce("_unknown_evidence", false)),
        ("duplicate_evidence", F.size(F.array_distinct("evidence_ids")) != n_evidence),
        ("insufficient_evidence_text", F.coalesce("_small", false)),
        # Field by field: the shape of a field first, then its content.
        *[
            rule
            for name in fields
            for rule in (
                ("invalid_semantic_nomination", ~safe_line(name, 2000)),
                ("secret_in_semantic_nomination", _secret(F.col(name))),
            )
        ],
        ("ungrounded_semantic_intent", grounding < 3),
        ("insufficient_missing_rule_evidence", (kind == "missing_rule") & ~signal),
        ("unproven_temporal_supersession", (kind == "temporal_supersession") & ~F.coalesce("_reversal", false)),
        ("unproven_semantic_contradiction", (kind == "contradiction") & (n_sources + n_evidence < 2)),
        (
            "insufficient_escalation_lineage",
            (kind == "enforcement_candidate") & ~F.coalesce("_two_witnesses", false),
        ),
    ]
    core = F.struct(
        label_key("behavioral_intent").alias("behavioral_intent"),
        kind.alias("candidate_class"),
        "domain",
        F.sort_array("evidence_ids").alias("evidence_ids"),
        F.sort_array("source_ids").alias("source_ids"),
    )
    checked = joined.withColumn("code", first_code(rules)).withColumn(
        "intent_fingerprint", canonical_digest(core)
    )
    # Only an accepted nomination blocks a later equal one.
    firsts = (
        checked.where("code is null")
        .groupBy("intent_fingerprint")
        .agg(F.min("index").alias("_first"))
    )
    marked = checked.join(firsts, "intent_fingerprint", "left")
    repeated = F.col("code").isNull() & (F.col("index") > F.col("_first"))
    one_place = F.coalesce("_one_place", false)
    admission = (
        F.when(kind == "missing_rule", "suggestion_candidate")
        .when(one_place & ((n_evidence > 0) | (n_sources >= 2)), "mutable_candidate")
        .otherwise("reported_only")
    )
    why = (
        F.when(kind == "missing_rule", "evidence_grounded_reversible_introduction")
        .when(one_place & ((n_evidence > 0) | (n_sources >= 2)), "same_target_same_heading_sources")
        .when(one_place, "single_source_without_external_evidence")
        .otherwise("cross_target_or_heading_requires_operator_resolution")
    )
    return marked.select(
        *nominations.columns,
        F.when(repeated, "duplicate_semantic_nomination").otherwise(F.col("code")).alias("code"),
        F.concat(F.lit("nom_"), F.left("intent_fingerprint", F.lit(16))).alias("nomination_id"),
        "intent_fingerprint",
        canonical_digest(F.coalesce("_marks", F.array().cast("array<struct<content_sha256:string,id:string,timestamp:string>>"))).alias(
            "evidence_fingerprint"
        ),
        admission.alias("admission"),
        why.alias("admission_reason"),
    )


def nomination_summary(checked: DataFrame) -> DataFrame:
    """One row: accepted by class and admission as maps, and the number of rejected ones."""
    ok = F.col("code").isNull()
    classes = [F.count_if(ok & (F.col("candidate_class") == c)).alias(c) for c in lx.CANDIDATE_CLASSES]
    kinds = ("mutable_candidate", "reported_only", "suggestion_candidate")
    admissions = [F.count_if(ok & (F.col("admission") == a)).alias(a) for a in kinds]
    return checked.agg(
        F.count_if(ok).alias("nominations"), F.count_if(~ok).alias("rejected_nominations"), *classes, *admissions
    )


# --- changes --------------------------------------------------------------------------------------


def validate_changes(
    changes: DataFrame,
    keep: DataFrame,
    blocks: DataFrame,
    events: DataFrame,
    targets: DataFrame,
    clusters: DataFrame | None = None,
) -> DataFrame:
    """Proposed changes with ``code`` (null = accepted), evidence used and lineage depth.

    ``changes``: index, action, source_ids, replacement, screened (text checked for intensifiers),
    destination, heading_path, evidence_ids, reason, minimum_apply_mode, enforcement_target,
    deterministic_check, relocation_basis. ``keep``: block_id. ``targets``: doc, scoped (boolean).
    ``clusters`` (cluster_id, reasons, block_id rows) switches the candidate boundary on.
    """
    false = F.lit(False)
    empty = F.array().cast(EMPTY)
    place = F.array_join("heading_path", "\x1f")
    exploded = changes.select("index", "action", F.posexplode("source_ids").alias("pos", "block_id"))
    uses = (
        exploded.select("block_id")
        .unionByName(keep.select("block_id"))
        .groupBy("block_id")
        .agg(F.count("*").alias("uses"))
    )
    kept = keep.select("block_id").distinct().withColumn("kept", F.lit(True))
    known = blocks.select(
        "block_id",
        F.col("doc").alias("b_doc"),
        F.col("heading_path").alias("b_path"),
        place.alias("b_place"),
        F.col("protected").alias("b_protected"),
        "raw",
    )
    sources = (
        exploded.join(known, "block_id", "left")
        .join(uses, "block_id", "left")
        .groupBy("index")
        .agg(
            F.max(F.col("b_doc").isNull()).alias("_unknown"),
            F.max(F.col("uses") > 1).alias("_reused"),
            F.max("b_protected").alias("_protected"),
            (F.min("b_doc") != F.max("b_doc")).alias("_many_docs"),
            (F.min("b_place") != F.max("b_place")).alias("_many_places"),
            F.min(F.struct("pos", "b_doc", "b_path"))["b_doc"].alias("_doc"),
            F.min(F.struct("pos", "b_doc", "b_path"))["b_path"].alias("_path"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), "\n").alias(
                "_source_text"
            ),
        )
    )
    witness = independence_key("session_id", "source_kind", "locator")
    cited_events = only_cited(events, "event_id", changes, "evidence_ids").select(
        F.col("event_id").alias("id"),
        "text",
        F.lit(True).alias("hit"),
        substantive_quote("text", "text").alias("solid"),
        witness.alias("witness"),
    )
    evidence = (
        changes.select("index", F.explode("evidence_ids").alias("id"))
        .join(cited_events, "id", "left")
        .groupBy("index")
        .agg(
            F.max(F.col("hit").isNull()).alias("_unknown_evidence"),
            F.max(~F.col("solid")).alias("_thin"),
            F.count_distinct("witness").alias("_witnesses"),
            F.array_join(F.sort_array(F.collect_set("text")), "\n").alias("_evidence_text"),
            F.flatten(
                F.collect_set(
                    F.when(
                        F.col("text").rlike(led(lx.CHANGE_REVERSAL_PATTERN)),
                        extract_terms("text", lx.ACTION_PATTERN),
                    )
                )
            ).alias("_explicit_actions"),
        )
    )
    joined = (
        changes.join(sources, "index", "left")
        .join(evidence, "index", "left")
        .join(targets.select(F.col("doc").alias("destination"), "scoped"), "destination", "left")
    )
    if clusters is None:
        joined = joined.withColumn("_inside", F.lit(True)).withColumn("_spare_copy", F.lit(False))
        bounded = F.lit(False)
    else:
        bounded = F.lit(True)
        sizes = clusters.join(kept, "block_id", "left").groupBy("cluster_id").agg(
            F.first("reasons").alias("reasons"), F.max(F.coalesce("kept", false)).alias("has_kept")
        )
        hits = (
            exploded.join(clusters.select("cluster_id", "block_id"), "block_id")
            .groupBy("index", "cluster_id")
            .agg(F.count_distinct("block_id").alias("n"))
            .join(sizes, "cluster_id")
            .join(changes.select("index", F.size(F.array_distinct("source_ids")).alias("want")), "index")
            .where(F.col("n") == F.col("want"))
            .groupBy("index")
            .agg(
                F.lit(True).alias("_inside"),
                F.max(F.array_contains("reasons", "exact_duplicate") & F.col("has_kept")).alias("_spare_copy"),
            )
        )
        joined = joined.join(hits, "index", "left")
    action = F.col("action")
    n_sources, n_evidence = F.size("source_ids"), F.size("evidence_ids")
    text = F.coalesce("replacement", F.lit(""))
    blank = strip(text) == ""
    source_text = F.coalesce("_source_text", F.lit(""))
    evidence_text = F.when(action == "escalate", F.lit("")).otherwise(F.coalesce("_evidence_text", F.lit("")))
    moved_single = (action == "relocate") & (n_sources == 1) & blank
    effective = F.when(action == "escalate", source_text).when(moved_single, source_text).otherwise(text)
    source_only = bounded & (action == "replace") & (n_sources >= 2) & (n_evidence == 0)
    spare_removal = bounded & (action == "remove") & (n_evidence == 0) & F.coalesce("_spare_copy", false)
    bad_part = F.exists("heading_path", lambda h: (strip(h) == "") | h.rlike(r"[\r\n\x00]"))
    joined = (
        joined.withColumn("_text", effective)
        .withColumn("_source", source_text)
        .withColumn("_evidence", evidence_text)
        .withColumn("_new_actions", extract_terms("_text", lx.ACTION_PATTERN))
        .withColumn("_source_actions", extract_terms("_source", lx.ACTION_PATTERN))
        .withColumn("_evidence_actions", extract_terms("_evidence", lx.ACTION_PATTERN))
    )
    # Uncited actions may be backed by another event or by a block that stays.
    wanted = joined.select(
        F.col("index").alias("key"),
        F.array_except(
            "_new_actions", F.array_union("_source_actions", F.col("_evidence_actions"))
        ).alias("terms"),
        F.col("_new_actions").alias("all_terms"),
    ).where(F.size("terms") > 0)
    event_terms = events.withColumn("terms", extract_terms("text", lx.ACTION_PATTERN))
    backed = (
        best_support(wanted, event_terms)
        .join(event_terms.select("event_id", F.col("terms").alias("_et")), "event_id")
        .groupBy(F.col("key").alias("index"))
        .agg(F.array_distinct(F.flatten(F.collect_set("_et"))).alias("_backed"), F.sort_array(F.collect_set("event_id")).alias("added_evidence"))
    )
    kept_terms = blocks.join(kept, "block_id").withColumn("terms", extract_terms("raw", lx.ACTION_PATTERN))
    base_terms = (
        wanted.select(F.col("key").alias("index"), F.explode("terms").alias("term"))
        .join(baseline_support(wanted, kept_terms).select("term"), "term")
        .groupBy("index")
        .agg(F.collect_set("term").alias("_base"))
    )
    joined = joined.join(backed, "index", "left").join(base_terms, "index", "left")
    ungrounded = unsupported_terms(
        F.col("_new_actions"),
        F.col("_source_actions"),
        F.col("_evidence_actions"),
        F.coalesce("_backed", empty),
        F.coalesce("_base", empty),
    )
    intensifiers = unsupported_terms(
        extract_terms(F.coalesce("screened", "_text"), lx.INTENSIFIER_PATTERN),
        extract_terms(F.concat("_source", "_evidence"), lx.INTENSIFIER_PATTERN),
        synonyms=lx.UNIVERSAL_SCOPE_TERMS,
    )
    high_impact = F.array_except(
        F.array_intersect("_new_actions", F.array(*[F.lit(a) for a in lx.HIGH_IMPACT_ACTIONS])),
        F.col("_source_actions"),
    )
    opt_in = led(lx.OPT_IN_PATTERN)
    relocation, target = F.col("relocation_basis"), F.col("enforcement_target")
    rules = [
        ("invalid_action", ~action.isin("replace", "remove", "relocate", "escalate")),
        ("invalid_source_ids", n_sources < 1),
        ("outside_consolidation_candidate", ~F.coalesce("_inside", false)),
        ("unknown_directive", F.col("_unknown")),
        ("duplicate_disposition", F.col("_reused")),
        ("protected_change", F.col("_protected")),
        ("invalid_escalation", (action == "escalate") & (n_sources != 1)),
        ("cross_target_change", (action != "relocate") & F.col("_many_docs")),
        ("cross_heading_replace", (action == "replace") & F.col("_many_places")),
        ("target_not_allowlisted", F.col("scoped").isNull()),
        ("invalid_destination", (action != "relocate") & (F.col("destination") != F.col("_doc"))),
        ("invalid_heading_path", F.col("heading_path").isNull() | bad_part),
        ("invalid_heading_path", action.isin("replace", "escalate") & (F.col("heading_path") != F.col("_path"))),
        (
            "repeated_replacement_phrase",
            action.isin("replace", "relocate") & ~blank & repeated_phrase(text).isNotNull(),
        ),
        ("empty_replacement", action.isin("replace", "relocate") & blank & ~moved_single),
        ("remove_with_text", (action == "remove") & ~blank),
        ("escalation_with_text", (action == "escalate") & ~blank),
        (
            "undefined_verification_gate",
            (action != "escalate")
            & F.col("_text").rlike(led(lx.SELF_ATTESTED_PATTERN))
            & ~F.col("_text").rlike(led(lx.EXTERNAL_CRITERION_PATTERN)),
        ),
        ("missing_reason", F.col("reason").isNull() | (strip("reason") == "")),
        ("invalid_apply_mode", ~F.col("minimum_apply_mode").isin("attended", "unattended")),
        ("invalid_enforcement_target", ~target.isin("", "hook", "settings")),
        ("invalid_relocation_basis", ~relocation.isin("", "contextual", "organization")),
        ("invalid_enforcement_target", (action == "escalate") & (target == "")),
        ("invalid_deterministic_check", (action == "escalate") & (strip("deterministic_check") == "")),
        (
            "invalid_enforcement_fields",
            (action != "escalate") & ((target != "") | (F.col("deterministic_check") != "")),
        ),
        ("invalid_relocation_basis", (action == "relocate") & (relocation == "")),
        (
            "unscoped_contextual_relocation",
            (action == "relocate") & (relocation == "contextual") & ~F.col("scoped"),
        ),
        ("invalid_relocation_basis", (action != "relocate") & (relocation != "")),
        ("missing_evidence", (n_evidence == 0) & ~source_only & ~spare_removal),
        ("unknown_evidence", F.col("_unknown_evidence")),
        ("duplicate_evidence", F.size(F.array_distinct("evidence_ids")) != n_evidence),
        ("insufficient_evidence_text", F.col("_thin")),
        ("insufficient_escalation_lineage", (action == "escalate") & (F.coalesce("_witnesses", F.lit(0)) < 2)),
        (
            "checkability_regression",
            source_only & (F.size(dropped_terms(code_anchors("_source"), code_anchors("_text"))) > 0),
        ),
        ("unsafe_precommit_ci_gate", action.isin("replace", "relocate") & universal_prerequisite("_text")),
        (
            "retained_reversed_clause",
            F.col("_source").rlike(opt_in)
            & F.col("_evidence").rlike(led(lx.CHANGE_REVERSAL_PATTERN))
            & F.col("_text").rlike(opt_in),
        ),
        ("unsupported_intensifier", F.size(intensifiers) > 0),
        (
            "dropped_explicit_action",
            (action != "escalate")
            & (F.size(dropped_terms(F.coalesce("_explicit_actions", empty), F.col("_new_actions"))) > 0),
        ),
        (
            "unsupported_action_catch_all",
            F.size(unsupported_terms(catch_alls("_text"), catch_alls("_source"), catch_alls("_evidence"))) > 0,
        ),
        ("ungrounded_operational_action", F.size(ungrounded) > 0),
        ("undefined_high_impact_gate", (F.size(high_impact) > 0) & ~has_stage_gate("_text")),
    ]
    return joined.select(
        *changes.columns,
        first_code(rules).alias("code"),
        F.coalesce("added_evidence", empty).alias("added_evidence"),
        F.when(action == "escalate", F.coalesce("_witnesses", F.lit(0))).otherwise(0).alias("lineage_depth"),
        source_only.alias("source_only_consolidation"),
        spare_removal.alias("source_only_duplicate_removal"),
    )


def validate_suggestions(suggestions: DataFrame, nominations: DataFrame, events: DataFrame, targets: DataFrame) -> DataFrame:
    """New-rule suggestions with ``code``; each admitted nomination is used once.

    ``suggestions``: index, nomination_id, keyword, rendered, reason, destination, heading_path.
    """
    admitted = nominations.where(
        F.col("code").isNull()
        & (F.col("candidate_class") == "missing_rule")
        & (F.col("admission") == "suggestion_candidate")
    ).select("nomination_id", "evidence_ids", F.lit(True).alias("_known"))
    support = (
        admitted.select("nomination_id", F.explode("evidence_ids").alias("event_id"))
        .join(events.select("event_id", "text"), "event_id")
        .groupBy("nomination_id")
        .agg(F.array_join(F.sort_array(F.collect_set("text")), "\n").alias("_support"))
    )
    first = suggestions.groupBy("nomination_id").agg(F.min("index").alias("_first"))
    allowed = targets.select(F.col("doc").alias("destination")).distinct().withColumn("_ok", F.lit(True))
    joined = (
        suggestions.join(admitted.drop("evidence_ids"), "nomination_id", "left")
        .join(support, "nomination_id", "left")
        .join(first, "nomination_id", "left")
        .join(allowed, "destination", "left")
        .withColumn("_support", F.coalesce("_support", F.lit("")))
    )
    actions = lx.ACTION_PATTERN
    invariant = F.col("keyword").isin("MUST", "MUST NOT")
    rules = [
        ("unknown_missing_rule_nomination", F.col("_known").isNull()),
        ("duplicate_new_rule_suggestion", F.col("index") > F.col("_first")),
        ("target_not_allowlisted", F.col("_ok").isNull()),
        ("missing_reason", strip("reason") == ""),
        (
            "ungrounded_operational_action",
            F.size(dropped_terms(extract_terms("rendered", actions), extract_terms("_support", actions))) > 0,
        ),
        (
            "unsupported_action_catch_all",
            F.size(dropped_terms(catch_alls("rendered"), catch_alls("_support"))) > 0,
        ),
        ("unsupported_normative_force", invariant & ~F.col("_support").rlike(led(lx.INVARIANT_SUPPORT_PATTERN))),
    ]
    shown = F.concat_ws("\n", F.array_join("heading_path", "\n"), "rendered", "reason")
    return joined.select(
        *suggestions.columns,
        first_code(rules).alias("code"),
        shown.rlike(lx.CONSEQUENTIAL_PATTERN).alias("requires_confirmation"),
    )


# --- conflicts ------------------------------------------------------------------------------------


def conflict_ties(conflicts: DataFrame, events: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Whether authority, scope or time already decides a conflict, and who wins.

    ``conflicts``: conflict_id, block_ids, evidence_ids; ``events``: event_id, authority, scope, ts.
    """
    rank = F.struct(
        (9 - F.col("authority")).alias("a"),
        (F.col("scope") != "global").cast("int").alias("s"),
        F.col("ts").alias("t"),
        F.col("event_id").alias("i"),
    )
    cited_rows = conflicts.select("conflict_id", F.explode(F.array_distinct("evidence_ids")).alias("event_id"))
    decided = (
        cited_rows.join(events.select("event_id", "authority", "scope", "ts"), "event_id")
        .groupBy("conflict_id")
        .agg(
            F.count("*").alias("_n"),
            (F.min("authority") == F.max("authority")).alias("_same_authority"),
            (F.min("scope") == F.max("scope")).alias("_same_scope"),
            (F.min("ts") == F.max("ts")).alias("_same_time"),
            F.max(rank)["i"].alias("_winner"),
        )
    )
    core = F.struct(
        F.sort_array("block_ids").alias("directive_ids"), F.sort_array("evidence_ids").alias("evidence_ids")
    )
    keyed = conflicts.withColumn("conflict_key", canonical_digest(core)).join(decided, "conflict_id", "left")
    repeated = F.lit(False)
    if seen is not None:
        marks = seen.select("conflict_key").distinct().withColumn("_seen", F.lit(True))
        keyed = keyed.join(marks, "conflict_key", "left")
        repeated = F.coalesce("_seen", F.lit(False))
    enough = (F.size(F.array_distinct("block_ids")) >= 2) & (F.coalesce("_n", F.lit(0)) >= 2)
    tie = F.col("_same_authority") & F.col("_same_scope") & F.col("_same_time")
    decided_by = (
        F.when(~F.col("_same_authority"), "authority")
        .when(~F.col("_same_scope"), "scope")
        .when(~F.col("_same_time"), "time")
    )
    status = (
        F.when(~enough, "invalid_decision_request")
        .when(~tie, "decision_precedence_determined")
        .when(repeated, "decision_request_repeated")
        .otherwise("unresolved")
    )
    return keyed.select(
        "conflict_id",
        "conflict_key",
        status.alias("status"),
        F.when(enough, decided_by).alias("decided_by"),
        F.when(enough & ~tie, F.col("_winner")).alias("winner"),
    )


def _incomparable(sets: DataFrame) -> DataFrame:
    """(conflict_id, excluded) where an exclusive set and another one each have a term of their own.

    ``sets``: conflict_id, pair, set, exclusive; sets meet within a pair. A set is comparable with
    all others exactly when every set of at least its size has all its terms, and the sets of at
    most its size have no other terms. Both are counts per term and size; sets are not paired.
    """
    key = ["conflict_id", "pair"]
    sized = sets.withColumn("n", F.size("set"))
    sizes = sized.groupBy(*key, "n").agg(
        F.count("*").alias("sets"), F.max("exclusive").alias("exclusive")
    )
    larger = Window.partitionBy(*key).orderBy(F.col("n").desc())
    sizes = sizes.withColumn("at_least", F.sum("sets").over(larger))
    terms = (
        sized.select(*key, "n", "exclusive", F.explode("set").alias("term"))
        .groupBy(*key, "term", "n")
        .agg(F.count("*").alias("sets"), F.max("exclusive").alias("exclusive"))
    )
    larger_with = Window.partitionBy(*key, "term").orderBy(F.col("n").desc())
    having = terms.withColumn("with_term", F.sum("sets").over(larger_with))
    lacking = (
        having.where("exclusive")
        .select(*key, "n", "with_term")
        .join(sizes.select(*key, "n", "at_least"), [*key, "n"])
        .where("with_term < at_least")
    )
    fresh = (
        terms.groupBy(*key, "term")
        .agg(F.min("n").alias("n"))
        .groupBy(*key, "n")
        .agg(F.count("*").alias("fresh"))
    )
    smaller = Window.partitionBy(*key).orderBy("n")
    others = (
        sizes.join(fresh, [*key, "n"], "left")
        .withColumn("known", F.sum(F.coalesce("fresh", F.lit(0))).over(smaller))
        .where("exclusive AND known > n")
    )
    found = lacking.select("conflict_id").union(others.select("conflict_id"))
    return found.distinct().withColumn("excluded", F.lit(True))


def structural_collisions(conflicts: DataFrame, grounding: DataFrame) -> DataFrame:
    """(conflict_id, collides): local evidence that two subjects exclude each other.

    ``conflicts``: conflict_id, subject_a, subject_b; ``grounding``: conflict_id, text_id, text.
    Opposite texts that share two subject terms are found through shared term pairs: a pair of
    terms that occurs with both signs is enough, so texts are never paired with each other.
    """
    subjects = conflicts.select(
        "conflict_id",
        subject_terms("subject_a", "decision").alias("_a"),
        subject_terms("subject_b", "decision").alias("_b"),
    )
    texts = (
        grounding.select(
            "conflict_id",
            "text_id",
            subject_terms("text", "decision").alias("terms"),
            polarity_sign("text").alias("sign"),
            F.col("text").rlike(led(lx.DECISION_INCOMPATIBLE_PATTERN)).alias("incompatible"),
            F.col("text").rlike(led(lx.DECISION_EXCLUSIVE_PATTERN)).alias("exclusive"),
        )
        .join(subjects, "conflict_id")
        .withColumn("_hit", F.sort_array(F.array_intersect("terms", F.array_union("_a", F.col("_b")))))
    )
    # Read once; a set travels as its digest, and as terms only where it is compared.
    paired_set = F.when(F.size("_hit") >= 2, F.sort_array("terms"))
    marked = cut_lineage(
        texts.select(
            "conflict_id",
            "sign",
            "incompatible",
            "exclusive",
            "_hit",
            F.arrays_overlap("terms", F.col("_a")).alias("in_a"),
            F.arrays_overlap("terms", F.col("_b")).alias("in_b"),
            paired_set.alias("set"),
            F.sha2(F.array_join(paired_set, NUL), 256).alias("mark"),
        )
    )
    touched = marked.groupBy("conflict_id").agg(
        F.max("in_a").alias("touches_a"),
        F.max("in_b").alias("touches_b"),
        F.max(F.col("incompatible") & F.col("in_a") & F.col("in_b")).alias("stated"),
    )
    pairs = F.flatten(
        F.transform(
            "_hit",
            lambda x, i: F.transform(
                F.slice(F.col("_hit"), i + 2, F.size("_hit")), lambda y: F.concat_ws(NUL, x, y)
            ),
        )
    )
    key = ["conflict_id", "pair"]
    sets = cut_lineage(
        marked.where("mark IS NOT NULL")
        .select("conflict_id", "sign", "exclusive", "mark", F.explode(pairs).alias("pair"))
        .groupBy(*key, "mark")
        .agg(
            F.max("exclusive").alias("exclusive"),
            F.max(F.col("sign") == 1).alias("positive"),
            F.max(F.col("sign") == -1).alias("negative"),
        )
    )
    by_pair = sets.groupBy(*key).agg(
        (F.max("positive") & F.max("negative")).alias("opposed"),
        (F.max("exclusive") & (F.count("*") > 1)).alias("compared"),
    )
    opposite = by_pair.groupBy("conflict_id").agg(F.max("opposed").alias("opposed"))
    bodies = marked.where("mark IS NOT NULL").select("mark", "set").dropDuplicates(["mark"])
    compared = sets.join(by_pair.where("compared").select(*key), key, "left_semi").join(bodies, "mark")
    exclusive = _incomparable(compared.select(*key, "set", "exclusive"))
    false = F.lit(False)
    joined = (
        subjects.join(touched, "conflict_id", "left")
        .join(opposite, "conflict_id", "left")
        .join(exclusive, "conflict_id", "left")
    )
    grounded = (
        (F.size("_a") > 0)
        & (F.size("_b") > 0)
        & F.coalesce("touches_a", false)
        & F.coalesce("touches_b", false)
    )
    hit = F.coalesce("stated", false) | F.coalesce("opposed", false) | F.coalesce("excluded", false)
    return joined.select("conflict_id", (grounded & hit).alias("collides"))


def evidence_fingerprint(events: DataFrame, by: list[str]) -> DataFrame:
    """Digest of the ordered (hash, id, time) list of a bounded citation set per key."""
    mark = F.struct("content_sha256", F.col("event_id").alias("id"), iso_instant("ts").alias("timestamp"))
    ordered = F.transform(
        F.sort_array(F.collect_set(F.struct(F.col("event_id").alias("k"), mark.alias("m")))), lambda x: x["m"]
    )
    return events.groupBy(*by).agg(canonical_digest(ordered).alias("evidence_fingerprint"))
