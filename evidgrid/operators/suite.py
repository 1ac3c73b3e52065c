"""Scoring recorded steps against expected actions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidgrid import lexicon as lx
from evidgrid.functions.exprs import col, extract_all, let, prefix_sums
from evidgrid.functions.text import label_key
from evidgrid.session import cut_lineage

# Limits of a suite.
MAX_ACTIONS = 64
MAX_PHRASES = 16
# End of fixed values.

#: Phrase keys that are broadcast, and what a key takes beside its phrase.
BROADCAST_BYTES = 64 << 20
KEY_BYTES = 64

WORD_CHAR = r"[\p{L}\p{N}_]"


def phrase_pattern(phrase: str) -> str:
    """Literal phrase that is not part of a longer word."""
    pattern = r"\Q" + phrase + r"\E"
    if phrase[:1].isalnum() or phrase[:1] == "_":
        pattern = rf"(?<!{WORD_CHAR})" + pattern
    if phrase[-1:].isalnum() or phrase[-1:] == "_":
        pattern = pattern + rf"(?!{WORD_CHAR})"
    return pattern


def _affirmed_position(text: Column, phrase: str) -> Column:
    """Smallest offset of the phrase without a negation earlier in its clause, or null."""
    pattern = phrase_pattern(phrase)

    def locate(found: Column) -> Column:
        lengths = F.transform(
            found["pieces"],
            lambda p, i: F.length(p) + F.coalesce(F.length(F.get(found["hits"], i)), F.lit(0)),
        )

        def affirmed(starts: Column) -> Column:
            def position(hit: Column, i: Column) -> Column:
                at = F.get(starts, i + 1) - F.length(hit)
                window = F.least(at, F.lit(lx.NEGATION_WINDOW_CHARS))
                before = F.substring(text, (at - window + 1).cast("int"), window.cast("int"))
                clause = F.element_at(F.split(before, lx.CLAUSE_BOUNDARY_PATTERN, -1), -1)
                plain = F.regexp_replace(clause, r"[`*_~()\[\]{}]", " ")
                return F.when(~plain.rlike(lx.NEGATED_CONTEXT_PATTERN), at)

            return F.array_min(F.transform(found["hits"], position))

        return let(prefix_sums(lengths), affirmed)

    parts = F.struct(
        F.split(text, pattern, -1).alias("pieces"), extract_all(text, pattern).alias("hits")
    )
    return F.when(text.rlike(pattern), let(parts, locate))


def joined_steps(steps: Column | str) -> Column:
    return F.array_join(F.transform(col(steps), label_key), "\n")


def detected_actions(text: Column | str, detectors: Mapping[str, Sequence[str]]) -> Column:
    """Actions in the order of their first affirmed phrase: array of (pos, action).

    Detectors are a suite's own vocabulary, at most 64 actions of 16 phrases, hence literals.
    """
    if len(detectors) > MAX_ACTIONS or any(len(p) > MAX_PHRASES for p in detectors.values()):
        raise ValueError("a suite has at most 64 actions with 16 phrases each")
    value = col(text)
    found = []
    for action, phrases in detectors.items():
        positions = [_affirmed_position(value, phrase) for phrase in phrases]
        first = F.array_min(F.array(*positions))
        found.append(
            F.when(
                first.isNotNull(), F.struct(first.alias("pos"), F.lit(action).alias("action"))
            )
        )
    return F.sort_array(F.array_compact(F.array(*found)))


def detect(results: DataFrame, detectors: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add ``actions`` (ordered names) to rows with ``steps`` and optionally ``allowed``."""
    with_text = results.withColumn("_text", joined_steps("steps"))
    found = detected_actions("_text", detectors)
    if "allowed" in results.columns:
        # At equal positions the allowed actions keep their own order.
        kept = F.filter(found, lambda a: F.array_contains("allowed", a["action"]))
        found = F.sort_array(
            F.transform(
                kept,
                lambda a: F.struct(
                    a["pos"].alias("pos"),
                    F.array_position("allowed", a["action"]).alias("rank"),
                    a["action"].alias("action"),
                ),
            )
        )
    names = F.transform(found, lambda a: a["action"])
    return with_text.withColumn("actions", names).drop("_text")


def conformance(actions: Column, required: Column, forbidden: Column, ordered: Column) -> Column:
    """Failures of an action sequence; empty when it conforms."""
    missing = F.array_except(required, actions)
    present = F.array_intersect(forbidden, actions)
    positions = F.transform(ordered, lambda a: F.array_position(actions, a))
    complete = F.forall(positions, lambda p: p > 0)
    return F.array_compact(
        F.array(
            F.when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ","))),
            F.when(F.size(present) > 0, F.concat(F.lit("forbidden:"), F.array_join(present, ","))),
            F.when(complete & (F.sort_array(positions) != positions), F.lit("order")),
        )
    )


def first_positions(
    events: DataFrame, keys: list[str], action: str, position: Column, actions: Sequence[str]
) -> DataFrame:
    """Actions of each key in the order of their first occurrence.

    Only the first occurrence of an action counts, so the sequence is a fixed number of minima
    (partial aggregates); no key's events are ever gathered.
    """
    minima = events.groupBy(*keys).agg(
        *[F.min(F.when(F.col(action) == a, position)).alias(f"_p{i}") for i, a in enumerate(actions)]
    )
    pairs = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"_p{i}").isNotNull(),
                    F.struct(F.col(f"_p{i}").alias("p"), F.lit(a).alias("a")),
                )
                for i, a in enumerate(actions)
            ]
        )
    )
    return minima.select(*keys, F.transform(F.sort_array(pairs), lambda x: x["a"]).alias("actions"))


def validate_responses(results: DataFrame, cases: DataFrame) -> DataFrame:
    """(run_id, code): one well-formed result per case and run.

    ``results``: run_id, case_ref, steps; ``cases``: case_ref.
    """
    sized = F.size("steps").between(1, lx.MAX_STEPS)
    sound = F.forall(
        "steps",
        lambda s: (F.trim(s) != "") & (F.length(s) <= lx.MAX_STEP_CHARS) & ~F.contains(s, F.lit("\x00")),
    )
    total = F.aggregate("steps", F.lit(0), lambda acc, s: acc + F.length(s))
    known = cases.select("case_ref").distinct().withColumn("_known", F.lit(True))
    per_case = (
        results.join(F.broadcast(known), "case_ref", "left")
        .groupBy("run_id", "case_ref")
        .agg(
            F.count("*").alias("n"),
            F.min(F.coalesce("_known", F.lit(False))).alias("known"),
            F.min(F.coalesce(sized & sound & (total <= lx.MAX_RESULT_CHARS), F.lit(False))).alias("ok"),
        )
    )
    expected = cases.select("case_ref").distinct().agg(F.count("*").alias("expected"))
    counts = per_case.groupBy("run_id").agg(
        F.min(F.col("known") & F.col("ok") & (F.col("n") == 1)).alias("good"),
        F.count_if("known").alias("answered"),
    )
    # ``expected`` is a single number.
    number = expected.select("expected").first()["expected"]
    valid = F.col("good") & (F.col("answered") == number)
    return counts.select(
        "run_id", F.when(~valid, "invalid_verification_output").alias("code")
    )


def pass_matrix(outcomes: DataFrame, case: str = "case_id", conditions: Sequence[str] = ("control", "pre", "post")) -> DataFrame:
    """Passed runs per case and condition."""
    return outcomes.groupBy(case).agg(
        *[F.count_if((F.col("condition") == c) & F.col("passed")).alias(c) for c in conditions]
    )


def verdicts(matrix: DataFrame, repeats: Column | int) -> DataFrame:
    """Failure codes, baseline gap and improvement per case."""
    want = F.lit(repeats) if isinstance(repeats, int) else repeats
    reasons = F.array_compact(
        F.array(
            F.when(F.col("post") != want, "candidate_failed"),
            F.when(F.col("post") < F.col("pre"), "behavior_regression"),
            F.when(
                F.col("control_must_underperform") & (F.col("control") >= F.col("post")),
                "control_not_weaker",
            ),
        )
    )
    return (
        matrix.withColumn("reasons", reasons)
        .withColumn("baseline_gap", F.col("pre") != want)
        .withColumn("improvement", F.col("post") > F.col("pre"))
    )


def suite_status(judged: DataFrame) -> DataFrame:
    """One row: passed only if no case has a reason against it."""
    return judged.agg(
        F.when(F.coalesce(F.max(F.size("reasons") > 0), F.lit(False)), "failed").otherwise("passed").alias("status"),
        F.count_if(F.size("reasons") > 0).alias("failed_cases"),
        F.count_if("baseline_gap").alias("baseline_gaps"),
        F.count_if("improvement").alias("improvements"),
    )


def coverage_gaps(changed: DataFrame, selectors: DataFrame) -> DataFrame:
    """Changed blocks (doc, heading_path) that no selector (suffix, contained) covers.

    A selector covers documents that end with its suffix under a heading with its text; ``*`` is any
    heading. Documents meet selectors by equal suffixes, so neither side has a limit.
    """
    blocks = changed.select("doc", "heading_path").distinct()
    listed = selectors.select("suffix", F.lower("contained").alias("contained")).distinct()
    # One number per length that a selector has, however many selectors there are: a block makes only
    # suffixes that can be equal to one.
    sizes = sorted(r["n"] for r in listed.select(F.length("suffix").alias("n")).where("n IS NOT NULL").distinct().collect())
    fitting = F.filter(F.array(*[F.lit(n) for n in sizes]).cast("array<int>"), lambda n: n <= F.length("doc"))
    ends = blocks.select(
        "doc",
        "heading_path",
        F.explode(F.transform(fitting, lambda n: F.substr(F.col("doc"), F.length("doc") - n + 1, n))).alias("suffix"),
    )
    heading = F.lower(F.array_join("heading_path", " > "))
    covered = (
        ends.join(listed, "suffix")
        .where((F.col("contained") == "*") | F.contains(heading, F.col("contained")))
        .select("doc", "heading_path")
    )
    return changed.join(covered, ["doc", "heading_path"], "left_anti")


def phrase_conflicts(detectors: DataFrame) -> DataFrame:
    """Phrases that stand for more than one action (action, phrase)."""
    grouped = detectors.groupBy(label_key("phrase").alias("phrase")).agg(
        F.min("action").alias("first_action"), F.max("action").alias("last_action")
    )
    return grouped.where("first_action <> last_action")


def contained_phrases(
    texts: DataFrame,
    phrases: DataFrame,
    text: str = "text",
    phrase: str = "phrase",
    words: int = 4,
    characters: int = 8,
) -> DataFrame:
    """(text_id, phrase_id) for phrases that occur verbatim in a text, spaces and case aside.

    A phrase may begin and end inside a word, but its inner words are whole, so a text that contains
    it also has its run of inner words. A phrase without inner words is found by its first
    characters instead, which may stand anywhere. Both kinds of keys meet the texts in one join;
    only candidates are compared as text. An empty phrase is in no text.
    """
    pattern = lx.WORD_TOKEN
    listed = phrases.select("phrase_id", label_key(phrase).alias("_p")).where("_p <> ''").withColumn(
        "_w", extract_all(F.col("_p"), pattern)
    )
    inner = F.greatest(F.size("_w") - 2, F.lit(0))
    sized = listed.select(
        "phrase_id",
        "_p",
        F.slice("_w", F.lit(2), F.least(F.lit(words), inner)).alias("_run"),
        F.least(F.lit(characters), F.length("_p")).alias("_c"),
    )
    by_run = F.size("_run") > 0

    # Words are hashed once each; the key of a run is a hash of their numbers.
    def hashed(words: Column) -> Column:
        return F.transform(words, lambda w: F.xxhash64(w))

    def run_key(numbers: Column, start: Column, size: int) -> Column:
        return F.xxhash64(*[F.get(numbers, start + at) for at in range(size)])

    def start_key(value: Column, start: Column, length: Column | int) -> Column:
        return F.xxhash64(F.lit("c"), F.substr(value, start, F.lit(length)))

    keyed = sized.select(
        "phrase_id",
        "_p",
        F.when(by_run, F.size("_run")).otherwise(-F.col("_c")).alias("_n"),
        reduce(
            lambda chosen, n: chosen.when(F.size("_run") == n, run_key(hashed(F.col("_run")), F.lit(0), n)),
            range(2, words + 1),
            F.when(F.size("_run") == 1, run_key(hashed(F.col("_run")), F.lit(0), 1)),
        )
        .otherwise(F.xxhash64(F.lit("c"), F.substr("_p", F.lit(1), F.col("_c"))))
        .alias("_key"),
    )
    # Keys of a measured size meet the texts on the scan; more of them are joined by a shuffle.
    keyed = cut_lineage(keyed)
    needed = keyed.agg(F.sum(F.octet_length("_p") + KEY_BYTES)).first()[0] or 0
    keys = keyed.select("_key", "phrase_id", "_p")
    keys = F.broadcast(keys) if needed <= BROADCAST_BYTES else keys
    # At most ``words`` + ``characters`` different kinds of keys, however many phrases there are.
    kinds = [r["_n"] for r in keyed.select("_n").distinct().collect()]
    normal = texts.select("text_id", label_key(text).alias("_t"))

    def runs_of(found: Column, size: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(found) - size, F.lit(0)))
        return F.transform(starts, lambda i: run_key(found, i, size))

    def starts_of(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length("_t") - size + 1, F.lit(1)))
        return F.transform(starts, lambda i: start_key(F.col("_t"), i, size))

    def keys_of(found: Column) -> Column:
        parts = [runs_of(found, n) if n > 0 else starts_of(-n) for n in sorted(kinds)]
        return F.array_distinct(F.flatten(F.array(F.array().cast("array<bigint>"), *parts)))

    # Outer form: no second evaluation of the array for an inferred size filter.
    shingled = normal.select(
        "text_id", F.explode_outer(let(hashed(extract_all(F.col("_t"), pattern)), keys_of)).alias("_key")
    ).where(F.col("_key").isNotNull())
    candidates = (
        shingled.join(keys, "_key")
        .select("text_id", "phrase_id", "_p")
        .distinct()
    )
    return (
        candidates.join(normal, "text_id")
        .where(F.contains("_t", F.col("_p")))
        .select("text_id", "phrase_id")
    )
