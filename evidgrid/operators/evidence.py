"""Scoring, corroboration, relevance, ranking, sampling and polarity overlaps of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidgrid import lexicon as lx
from evidgrid.functions.exprs import col, led, strings
from evidgrid.functions.identity import content_sha, independence_key
from evidgrid.functions.text import (
    behavior_keys,
    correction_score,
    directive_score,
    fingerprint_tokens,
    is_behavioral,
    recency_weight,
)
from evidgrid.lexicon import DEFAULT_LEXICON, Lexicon
from evidgrid.operators.skew import join_back
from evidgrid.session import cut_lineage, cut_lineage_counted


def with_terms(df: DataFrame, text: str = "text", lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Add ``tokens`` (ordered) and ``terms`` (distinct) of the fingerprint."""
    tokened = df.withColumn("tokens", fingerprint_tokens(text, lexicon))
    return tokened.withColumn("terms", F.array_distinct("tokens"))


def _witnesses(pairs: DataFrame, key: str) -> DataFrame:
    """Distinct sessions per key plus one for all session-less copies together.

    Rows are reduced to distinct (key, session) pairs first, so a heavily repeated key is counted
    from its sessions, not from its rows.
    """
    distinct = (
        pairs.where(F.col(key).isNotNull())
        .groupBy(key, F.coalesce(F.col("session_id"), F.lit("")).alias("s"))
        .agg(F.count("*").alias("n"))
    )
    # '' is one of the distinct sessions when there is any session-less copy: it counts once.
    return distinct.groupBy(key).agg(
        F.count("*").alias("witnesses"), F.sum("n").alias("rows")
    )


def corroboration_keys(
    tokens: Column | str = "tokens", lexicon: Lexicon = DEFAULT_LEXICON
) -> list[Column]:
    """``fingerprint_key`` and ``anchor_set``, null where a text has none."""
    value = col(tokens)
    anchors = F.sort_array(F.array_intersect(value, strings(lexicon.anchors)))
    return [
        F.when(F.size(value) > 0, content_sha(F.array_join(value, " "))).alias("fingerprint_key"),
        F.when(F.size(anchors) >= 3, F.array_join(anchors, " ")).alias("anchor_set"),
    ]


def corroborate(
    keyed: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON
) -> DataFrame:
    """Add ``corroboration``: how many independent sessions support an event.

    Input needs event_id, session_id and the ``corroboration_keys``. Support comes from equal
    fingerprints or from a shared combination of three anchors, whichever is larger, and is at
    least 1.
    """
    by_fingerprint = _witnesses(keyed, "fingerprint_key").withColumnRenamed("witnesses", "_by_fp")
    found = join_back(keyed, by_fingerprint, "fingerprint_key", "rows", F.col("event_id"))

    # Events with the same anchor set have the same keys: expand sets, not events.
    def expanded(df: DataFrame) -> DataFrame:
        keys = behavior_keys(F.split("anchor_set", " "), lexicon)
        return df.withColumn("_key", F.explode(keys))

    sets = (
        keyed.where(F.col("anchor_set").isNotNull())
        .groupBy("anchor_set", "session_id")
        .agg(F.count("*").alias("n"))
    )
    by_key = _witnesses(expanded(sets), "_key").drop("rows")
    by_set = (
        expanded(sets.groupBy("anchor_set").agg(F.sum("n").alias("rows")))
        .join(by_key, "_key")
        .groupBy("anchor_set")
        .agg(F.max("witnesses").alias("_by_anchors"), F.max("rows").alias("rows"))
    )
    found = join_back(found, by_set, "anchor_set", "rows", F.col("event_id"))
    support = F.greatest(
        F.lit(1),
        F.coalesce(F.col("_by_fp"), F.lit(0)),
        F.coalesce(F.col("_by_anchors"), F.lit(0)),
    )
    return found.withColumn("corroboration", support.cast("long")).drop(
        "fingerprint_key", "anchor_set", "_by_fp", "_by_anchors"
    )


def block_terms(blocks: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Behavioural blocks with at least one subject term (block_id, text, heading_path, terms)."""
    if "heading_path" not in blocks.columns:
        blocks = blocks.withColumn("heading_path", F.array().cast("array<string>"))
    kept = blocks.where(is_behavioral("heading_path", "text", lexicon))
    return with_terms(kept, "text", lexicon).drop("tokens").where(F.size("terms") > 0)


#: Rows of subject terms (a digest, a term and a flag each, some 120 bytes) that are broadcast.
BROADCAST_TERMS = 200_000
#: Rows of one event term above which it is cut into parts.
HOT_TERM = 100_000


def _matched_terms(
    events: DataFrame, subjects: DataFrame, broadcast_rows: int, hot_rows: int
) -> DataFrame:
    """Event terms (event_id, term) joined with the terms of the subjects.

    A bounded table of subject terms is broadcast. A larger one is shuffled; then every term that more
    than ``hot_rows`` events have is cut into parts by event, and its subject rows are repeated per part.
    """
    subjects = cut_lineage(subjects)
    terms = events.select("event_id", F.explode("terms").alias("term"))
    if subjects.count() <= broadcast_rows:
        return terms.repartition("event_id").join(F.broadcast(subjects), "term")
    # At most one row per ``hot_rows`` event terms.
    hot = cut_lineage(
        terms.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
        .select("term", F.ceil(F.col("n") / hot_rows).cast("int").alias("parts"))
    )
    parts = F.coalesce("parts", F.lit(1))
    dealt = terms.join(hot, "term", "left").select(
        "event_id", "term", F.pmod(F.xxhash64("event_id"), parts).cast("int").alias("part")
    )
    repeated = subjects.join(hot, "term", "left").select(
        *subjects.columns, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")
    )
    return dealt.join(repeated, ["term", "part"]).drop("part")


def target_relevance(
    events: DataFrame,
    blocks: DataFrame,
    lexicon: Lexicon = DEFAULT_LEXICON,
    broadcast_rows: int = BROADCAST_TERMS,
    hot_rows: int = HOT_TERM,
) -> DataFrame:
    """(event_id, target_relevance) for events that share a term with any block.

    Blocks with the same subject count once. Where the subjects are broadcast, event terms are spread by
    event_id once and the match counts need no further shuffle; else matches are counted before they
    are shuffled to their event.
    """
    subjects = (
        block_terms(blocks, lexicon)
        .select(F.array_join(F.sort_array("terms"), " ").alias("subject"), "terms")
        .dropDuplicates(["subject"])
        .select(
            content_sha("subject").alias("subject_id"),
            F.explode("terms").alias("term"),
        )
        .withColumn("anchor", F.col("term").isin(lexicon.anchors).cast("int"))
    )
    matched = _matched_terms(events, subjects, broadcast_rows, hot_rows)
    per_block = matched.groupBy("event_id", "subject_id").agg(
        F.least(F.lit(24), F.count("*") * 2 + F.sum("anchor") * 6).alias("r")
    )
    return per_block.groupBy("event_id").agg(F.max("r").cast("long").alias("target_relevance"))


FEATURES = ("tokens", "correction_score", "directive_score")


def text_features(
    df: DataFrame, keep: list[str | Column], text: str = "text", lexicon: Lexicon = DEFAULT_LEXICON
) -> DataFrame:
    """Everything the scores need from a text, as a narrow table without the text.

    Meant to run right on the scan: joins, dedup and all later shuffles then move tokens and
    counts (about 28 tokens per row), never texts.
    """
    return df.select(
        *keep,
        fingerprint_tokens(text, lexicon).alias("tokens"),
        correction_score(text, lexicon).cast("long").alias("correction_score"),
        directive_score(text, lexicon).cast("long").alias("directive_score"),
    )


def score_events(
    features: DataFrame,
    blocks: DataFrame | None = None,
    lexicon: Lexicon = DEFAULT_LEXICON,
    keep_tokens: bool = False,
) -> DataFrame:
    """Add corroboration and target_relevance to rows of ``text_features``.

    The narrow rows are written once, because corroboration and relevance read them several times
    and must not go back to the texts.
    """
    keys = corroboration_keys("tokens", lexicon)
    narrow = cut_lineage(features.select("*", *keys))
    scored = corroborate(narrow, lexicon)
    scored = scored if keep_tokens else scored.drop("tokens")
    if blocks is None:
        return scored.withColumn("target_relevance", F.lit(0).cast("long"))
    terms = narrow.select("event_id", F.array_distinct("tokens").alias("terms"))
    relevance = target_relevance(terms, blocks, lexicon)
    joined = scored.join(relevance, "event_id", "left")
    return joined.withColumn("target_relevance", F.coalesce("target_relevance", F.lit(0)))


def rank_score(as_of: Column) -> Column:
    """Evidence rank; rounded so that engines and runs agree on the order."""
    weight = (
        (9 - F.col("authority")) * 4
        + F.col("correction_score") * 3
        + F.col("directive_score")
        + F.least(F.lit(5), F.col("corroboration")) * 2
        + F.col("target_relevance") * 2
        + recency_weight("ts", as_of) * 8
    )
    return F.round(weight, 6)


def oldest_per_group(events: DataFrame, group: list[Column], ts: str = "ts") -> DataFrame:
    """The earliest event of every group as (event_id, ts)."""
    keys = [column.alias(f"_g{i}") for i, column in enumerate(group)]
    first = events.groupBy(*keys).agg(F.min(F.struct(ts, "event_id")).alias("f"))
    return first.select(F.col("f")["event_id"].alias("event_id"), F.col("f")[ts].alias(ts))


def sample_with_breadth(
    ranked: DataFrame,
    max_events: int = lx.MAX_EVENTS,
    group: list[Column] | None = None,
) -> DataFrame:
    """Quota sample (event_id, pick) from rows with event_id, source_kind, ts, rank_score.

    Four fifths of the quota go to the best ranks, then the oldest event of every (year, source)
    while there is room, then further ranks. Only top-k results are combined: every branch ends in
    a limit, so nothing larger than the quota leaves the executors.
    """
    group = group or [F.year("ts"), F.col("source_kind")]
    primary = max(1, int(max_events * 0.80))
    best = [F.col("rank_score").desc(), F.col("ts").desc(), F.col("event_id").desc()]
    top = ranked.select("event_id", "ts", "rank_score").orderBy(*best).limit(max_events)
    order = Window.orderBy(*best)  # over at most max_events rows
    top = top.withColumn("_n", F.row_number().over(order))
    leading = top.where(F.col("_n") <= primary).select("event_id")
    oldest = (
        oldest_per_group(ranked, group)
        .join(F.broadcast(leading), "event_id", "left_anti")
        .orderBy("ts", "event_id")
        .limit(max_events - primary)
        .select("event_id", F.lit(1).alias("pick"), F.lit(0).alias("_n"))
    )
    by_rank = top.select(
        "event_id", F.when(F.col("_n") <= primary, 0).otherwise(2).alias("pick"), "_n"
    )
    merged = (
        by_rank.unionByName(oldest).groupBy("event_id").agg(F.min(F.struct("pick", "_n")).alias("p"))
    )
    chosen = merged.orderBy("p.pick", "p._n", "event_id").limit(max_events)
    return chosen.select("event_id", F.col("p")["pick"].alias("pick"))


def select_events(
    scored: DataFrame,
    as_of: Column,
    max_events: int = lx.MAX_EVENTS,
    group: list[Column] | None = None,
) -> DataFrame:
    """Score rows of the sample with ``rank_score`` and ``pick`` (0 rank, 1 breadth, 2 fill)."""
    ranked = cut_lineage(scored.withColumn("rank_score", rank_score(as_of)))
    chosen = sample_with_breadth(ranked, max_events, group)
    return ranked.join(F.broadcast(chosen), "event_id")


def polarity_columns(text: str = "text", lexicon: Lexicon = DEFAULT_LEXICON) -> list[Column]:
    """Flags ``neg`` and ``pos`` of a text."""
    return [
        F.col(text).rlike(led(lexicon.negative)).alias("neg"),
        F.col(text).rlike(led(lexicon.positive)).alias("pos"),
    ]


#: Events that the first round of ``opposite_polarity`` looks at; every further round takes twice as many.
FIRST_EVENTS = 64


def opposite_polarity(
    blocks: DataFrame,
    events: DataFrame,
    lexicon: Lexicon = DEFAULT_LEXICON,
    per_block: int = 3,
    overall: int = 30,
    first_events: int = FIRST_EVENTS,
) -> DataFrame:
    """Best opposite-polarity pairs on one subject.

    Events need event_id, tokens, neg, pos, ts, target_relevance, correction_score. Pairs rank by the
    relevance and the correction score of their event first. So events are taken in rounds, from the
    highest scores down, whole scores at a time: once the rounds so far have given ``overall`` pairs (at
    most ``per_block`` a block), no event with a lower score can give a better one, and the rest is never
    joined. Within a round the polarity test is part of the join condition and the best of a block are
    limited inside each task before they are exchanged.
    """
    left = cut_lineage(
        block_terms(blocks, lexicon)
        .select("block_id", *polarity_columns("text", lexicon), "terms")
        .where(F.col("neg") | F.col("pos"))
        .select(
            "block_id",
            F.col("neg").alias("b_neg"),
            F.col("pos").alias("b_pos"),
            F.explode("terms").alias("term"),
        )
    )
    score = F.struct("target_relevance", "correction_score")
    polar = cut_lineage(
        events.where(F.col("neg") | F.col("pos")).select(
            "event_id",
            "ts",
            "target_relevance",
            "correction_score",
            F.col("neg").alias("e_neg"),
            F.col("pos").alias("e_pos"),
            F.array_distinct("tokens").alias("terms"),
        )
    )
    # Both scores are small numbers (0 to 24, 0 to 30): a few hundred rows.
    scores = polar.groupBy(score.alias("score")).agg(F.count("*").alias("n"))
    heights = scores.orderBy(F.col("score").desc()).collect()
    opposite = (F.col("b_neg") & F.col("e_pos")) | (F.col("b_pos") & F.col("e_neg"))
    order = [
        F.col("target_relevance").desc(),
        F.col("correction_score").desc(),
        F.col("n_shared").desc(),
        F.col("ts").desc(),
        F.col("block_id"),
        F.col("event_id"),
    ]

    def best_pairs(some: DataFrame) -> DataFrame:
        pairs = (
            some.repartition("event_id")
            .withColumn("term", F.explode("terms"))
            .drop("terms")
            .join(left, "term")
            .where(opposite)
            .groupBy("event_id", "block_id", "ts", "target_relevance", "correction_score")
            .agg(
                F.collect_list("term").alias("shared"),
                F.max(F.col("term").isin(lexicon.strong)).alias("strong"),
            )
            .where((F.size("shared") >= 2) | F.col("strong"))
            .withColumn("n_shared", F.size("shared").cast("long"))
        )
        place = F.row_number().over(Window.partitionBy("block_id").orderBy(*order))
        return pairs.withColumn("_n", place).where(F.col("_n") <= per_block).drop("_n", "strong")

    found, start, size = None, 0, first_events
    while found is None or start < len(heights):
        stop, held = start, 0
        while stop < len(heights) and (held == 0 or held + heights[stop].n <= size):
            held += heights[stop].n
            stop += 1
        if held:
            low, high = heights[stop - 1].score, heights[start].score
            relevance, correction = F.col("target_relevance"), F.col("correction_score")
            above = (relevance > low.target_relevance) | (
                (relevance == low.target_relevance) & (correction >= low.correction_score)
            )
            below = (relevance < high.target_relevance) | (
                (relevance == high.target_relevance) & (correction <= high.correction_score)
            )
            fresh = best_pairs(polar.where(above & below))
        else:
            fresh = best_pairs(polar)
        # At most ``per_block`` rows a block and round.
        both = fresh if found is None else found.union(fresh)
        place = F.row_number().over(Window.partitionBy("block_id").orderBy(*order))
        kept = both.withColumn("_n", place).where(F.col("_n") <= per_block).drop("_n")
        found, count = cut_lineage_counted(kept.orderBy(*order).limit(overall))
        if count >= overall:
            break
        start, size = stop, size * 2
    return found.orderBy(*order).select(
        F.lit("negation_pair").alias("detector"),
        "block_id",
        "event_id",
        "target_relevance",
        "correction_score",
        "n_shared",
        F.slice(F.sort_array("shared"), 1, 8).alias("shared_terms"),
    )


def independent_groups(events: DataFrame, by: list[str]) -> DataFrame:
    """Number of independent witnesses per key (session, else place of origin)."""
    key = independence_key("session_id", "source_kind", "locator")
    distinct = events.select(*by, key.alias("g")).distinct()
    return distinct.groupBy(*by).agg(F.count("*").alias("groups"))


def missing_rule_signal(events: DataFrame, by: list[str], node_kind: str = "node_active") -> DataFrame:
    """Per key: an active node, an explicit durable wording, or two independent scored groups."""
    scored = (F.col("directive_score") > 0) | (F.col("correction_score") > 0)
    group = F.when(scored, independence_key("session_id", "source_kind", "locator"))
    # Two groups exist exactly when the smallest and the largest key differ.
    return events.groupBy(*by).agg(
        (
            F.max(F.col("source_kind") == node_kind)
            | F.max(F.col("text").rlike(led(lx.EXPLICIT_DURABLE_PATTERN)))
            | F.coalesce(F.min(group) != F.max(group), F.lit(False))
        ).alias("signal")
    )
