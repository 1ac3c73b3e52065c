"""Scalar text functions: normalization, tokens, scores, sizes."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidgrid import lexicon as lx
from evidgrid.functions.exprs import NOT_SPACE, SPACES, col, extract_all, led, let, strings, strip
from evidgrid.lexicon import DEFAULT_LEXICON, Lexicon

MILLISECOND_BOUNDARY = 10_000_000_000
DAY_MICROS = 86_400_000_000
HALF_LIFE_DAYS = 365.0
# A word of four or more characters without lower case letters and with a capital.
SHOUTED = (
    rf"(?![a-z ])(?<!{NOT_SPACE})(?=[^\s\p{{Ll}}]*\p{{Lu}})(?:(?!\p{{Ll}}){NOT_SPACE}){{4,}}(?!{NOT_SPACE})"
)


def instant_from_number(value: Column | str) -> Column:
    """Epoch number to timestamp: values above 1e10 are milliseconds, others seconds."""
    number = col(value).cast("double")
    seconds = F.when(number > MILLISECOND_BOUNDARY, number / 1000.0).otherwise(number)
    micros = F.round(seconds * 1_000_000.0).cast("long")
    # Years beyond 9999 have no ISO form; such numbers are treated as unusable.
    usable = (seconds >= -62_135_596_800.0) & (seconds < 253_402_300_800.0)
    return F.when(usable, F.timestamp_micros(micros))


def instant_from_text(value: Column | str) -> Column:
    """ISO-8601 text to timestamp; a text without offset is UTC, anything else is null."""
    text = F.regexp_replace(F.trim(col(value)), "[zZ]$", "+00:00")
    zoned = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$")
    has_offset = text.rlike(r"[T ].*[+-]\d{2}(:?\d{2})?(:\d{2})?$")
    local = F.when(F.length(text) == 10, F.concat(text, F.lit(" 00:00:00"))).otherwise(text)
    utc = F.when(has_offset, text).otherwise(F.concat(local, F.lit(" UTC")))
    return F.when(zoned, F.try_to_timestamp(utc))


def normalize_instant(
    number: Column | str | None, text: Column | str | None, fallback: Column | str
) -> Column:
    """First usable of number, text and fallback; never fails."""
    choices = []
    if number is not None:
        choices.append(instant_from_number(number))
    if text is not None:
        choices.append(instant_from_text(text))
    return F.coalesce(*choices, col(fallback), F.timestamp_micros(F.lit(0).cast("long")))


def iso_instant(value: Column | str) -> Column:
    """ISO text in UTC with ``Z``; a fraction is printed only where there is one."""
    ts = col(value)
    return F.when(
        F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def flatten_content(value: Column | str) -> Column:
    """Message content as text: a string as it is, or the text parts of a list of typed blocks."""
    variant = col(value)
    shape = F.schema_of_variant(variant)
    blocks = F.try_variant_get(variant, "$", "array<variant>")

    def text_of(block: Column) -> Column:
        main = F.try_variant_get(block, "$.text", "string")
        other = F.try_variant_get(block, "$.input_text", "string")
        return F.when(F.coalesce(main, F.lit("")) != "", main).otherwise(other)

    def allowed(block: Column) -> Column:
        kind = F.try_variant_get(block, "$.type", "string")
        return (
            F.schema_of_variant(block).startswith("OBJECT")
            & (kind.isNull() | kind.isin("text", "input_text", "output_text"))
            & F.coalesce(text_of(block), F.lit("")).__ne__("")
        )

    parts = F.transform(F.filter(blocks, allowed), text_of)
    return (
        F.when(shape == "STRING", F.try_variant_get(variant, "$", "string"))
        .when(shape.startswith("ARRAY"), F.coalesce(F.array_join(parts, "\n"), F.lit("")))
        .otherwise(F.lit(""))
    )


def clean_controls(text: Column | str) -> Column:
    """NUL becomes U+FFFD; other control characters except newline and tab are dropped."""
    replaced = F.replace(col(text), F.lit("\x00"), F.lit("\ufffd"))
    return F.regexp_replace(replaced, r"[\x01-\x08\x0b-\x1f]", "")


def excerpt(text: Column | str, max_chars: int = lx.MAX_EXCERPT_CHARS) -> Column:
    """Both ends of an over-long text with a note of how much was left out."""
    value = col(text)
    half = max(1, (max_chars - 42) // 2)
    note = F.concat(
        F.lit("\n[TRUNCATED:"), (F.length(value) - 2 * half).cast("string"), F.lit(" chars]\n")
    )
    shortened = F.concat(F.left(value, F.lit(half)), note, F.right(value, F.lit(half)))
    return F.when(F.length(value) > max_chars, shortened).otherwise(value)


def shannon_entropy(text: Column | str) -> Column:
    """Bits per character."""

    def bits(value: Column) -> Column:
        size = F.length(value).cast("double")
        counts = F.transform(
            F.array_distinct(F.split(value, "")),
            lambda ch: size - F.length(F.replace(value, ch, F.lit(""))),
        )
        total = F.aggregate(
            counts,
            F.lit(0.0),
            lambda acc, n: acc - F.when(n > 0, n / size * F.log2(n / size)).otherwise(0.0),
        )
        return F.when(F.length(value) == 0, F.lit(0.0)).otherwise(total)

    return let(col(text), bits)


def collapse_spaces(text: Column | str) -> Column:
    # Most spaces are single blanks, so only runs of them are left to the regular expression.
    return F.trim(F.regexp_replace(F.translate(col(text), SPACES, " " * len(SPACES)), " {2,}", " "))


def label_key(text: Column | str) -> Column:
    """Short normal form for labels: one space between words, lower case."""
    return F.lower(collapse_spaces(text))


def normalize_block(text: Column | str) -> Column:
    """Comparable form of a block: no list marker, single spaces, lower case.

    Text that needs Unicode composition goes through ``operators.ingest.compose_unicode`` first.
    """
    unmarked = F.regexp_replace(col(text), r"^(?:[-+*]|\d+[.)])[ \t]+(?=\S)", "")
    return F.lower(collapse_spaces(unmarked))


def _meaningful(token: Column, min_chars: int, stop: list[str]) -> Column:
    long_enough = F.length(token) >= min_chars
    return long_enough & ~token.isin(stop) if stop else long_enough


#: Characters in which the tokens of a fingerprint are looked for first.
HEAD_CHARS = 1024


def fingerprint_tokens(text: Column | str, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """The first meaningful tokens in order; a long text is read on only if its head has too few."""
    value, wanted = col(text), lexicon.fingerprint_tokens

    def meaningful(part: Column) -> Column:
        tokens = F.transform(extract_all(part, lx.FINGERPRINT_TOKEN), F.lower)
        return F.filter(tokens, lambda t: _meaningful(t, lexicon.min_token_chars, lexicon.stop))

    # The last token of the head may be cut off, so one more than wanted is needed.
    found = let(
        meaningful(F.left(value, F.lit(HEAD_CHARS))),
        lambda head: F.when(F.size(head) > wanted, head).otherwise(meaningful(value)),
    )
    return F.slice(found, 1, wanted)


def fingerprint(text: Column | str, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """The first meaningful tokens in order, joined by a blank."""
    return F.array_join(fingerprint_tokens(text, lexicon), " ")


def correction_score(text: Column | str, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    value = col(text)
    shouted = F.regexp_count(value, F.lit(SHOUTED))
    total = (
        F.regexp_count(value, F.lit(led(lexicon.correction))) * 4
        + F.regexp_count(value, F.lit(led(lexicon.explicit))) * 10
        + F.least(F.lit(3), shouted)
    )
    return F.least(F.lit(30), total)


def directive_score(text: Column | str, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    return F.least(F.lit(30), F.regexp_count(col(text), F.lit(led(lexicon.directive))))


def behavior_keys(tokens: Column | str, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """All combinations of three anchors among the fingerprint tokens, in sorted order."""
    anchors = F.sort_array(F.array_intersect(col(tokens), strings(lexicon.anchors)))

    def triples(a: Column) -> Column:
        return F.flatten(
            F.transform(
                a,
                lambda x, i: F.flatten(
                    F.transform(
                        F.slice(a, i + 2, F.size(a)),
                        lambda y, j: F.transform(
                            F.slice(a, i + j + 3, F.size(a)), lambda z: F.concat_ws(" ", x, y, z)
                        ),
                    )
                ),
            )
        )

    return let(anchors, triples)


def subject_terms(
    text: Column | str, profile: str = "evidence", lexicon: Lexicon = DEFAULT_LEXICON
) -> Column:
    """Distinct subject terms under one of the four tokenizer profiles."""
    if profile == "evidence":
        return F.array_distinct(fingerprint_tokens(text, lexicon))
    if profile == "decision":
        families = F.create_map(
            *[F.lit(part) for pair in lx.DECISION_FAMILIES.items() for part in pair]
        )
        # A word is looked at once, however often a text repeats it.
        words = F.array_distinct(extract_all(col(text), lx.FINGERPRINT_TOKEN))
        tokens = F.transform(words, F.lower)
        kept = F.filter(tokens, lambda t: _meaningful(t, 3, lx.DECISION_STOP))
        return F.array_distinct(F.transform(kept, lambda t: F.coalesce(families[t], t)))
    stop = {"blocks": lexicon.block_stop, "analyst": lx.ANALYST_STOP, "quality": []}[profile]
    words = F.array_distinct(extract_all(normalize_block(text), lx.WORD_TOKEN))
    return F.filter(words, lambda t: _meaningful(t, 3, stop))


def recency_weight(ts: Column | str, as_of: Column | str) -> Column:
    """One-year half-life; the future counts as today and a missing time as zero."""
    micros = F.timestamp_diff("MICROSECOND", col(ts), col(as_of)).cast("double")
    days = F.greatest(F.lit(0.0), micros / float(DAY_MICROS))
    return F.coalesce(F.exp(-math.log(2) * days / HALF_LIFE_DAYS), F.lit(0.0))


def polarity_sign(
    text: Column | str,
    negative: str = lx.DECISION_NEGATIVE_PATTERN,
    positive: str = lx.DECISION_POSITIVE_PATTERN,
) -> Column:
    """-1 whenever a negative is present, else +1 for a positive, else 0."""
    value = col(text)
    return (
        F.when(value.rlike(led(negative)), F.lit(-1))
        .when(value.rlike(led(positive)), F.lit(1))
        .otherwise(0)
    )


def split_frontmatter(text: Column | str) -> Column:
    """Envelope between two ``---`` lines at the top, and the body after it."""
    value = col(text)
    envelope = F.regexp_extract(
        value, r"(?s)\A([ \t]*---[ \t]*\r?\n(?:.*?\r?\n)??[ \t]*---[ \t]*(?:\r?\n|\z))", 1
    )
    return let(
        envelope,
        lambda head: F.struct(
            head.alias("frontmatter"),
            F.substring(value, F.length(head) + 1, F.length(value)).alias("body"),
        ),
    )


def scope_paths(text: Column | str) -> Column:
    """Values of the ``paths:`` list in the front matter, unquoted, without repeats."""
    head = split_frontmatter(text)["frontmatter"]
    pattern = (
        r"(?:\A|\n)(?<indent> *)paths:[ \t]*([^\n]*)"
        r"((?:\n(?:[ \t]*|[ \t]*#[^\n]*|\k<indent>[ \t]+[^\n]*)(?=\n|\z))*)"
    )

    def unquote(raw: Column) -> Column:
        value = F.regexp_replace(F.trim(F.regexp_replace(raw, r"[\t\r]", " ")), r"^-[ ]*", "")
        quoted = value.rlike("^([\"']).*\\1$") & (F.length(value) >= 2)
        bare = F.rtrim(F.regexp_replace(value, r"(?s) #.*$", ""))
        chosen = F.when(quoted, F.substring(value, 2, F.length(value) - 2)).otherwise(bare)
        return F.when(F.contains(chosen, F.lit("\x00")), F.lit("")).otherwise(chosen)

    def listed(value: Column) -> Column:
        inline = F.trim(F.regexp_extract(value, pattern, 2))
        items = F.regexp_extract(value, pattern, 3)
        bracketed = F.when(
            inline.rlike(r"^\[.*\]$"), F.split(F.regexp_extract(inline, r"^\[(.*)\]$", 1), ",")
        ).otherwise(F.array().cast("array<string>"))
        dashed = F.filter(F.split(items, "\n"), lambda line: F.trim(line).startswith("-"))
        cleaned = F.transform(F.concat(bracketed, dashed), unquote)
        return F.array_distinct(F.filter(cleaned, lambda v: v != ""))

    return let(head, listed)


def is_behavioral(
    heading_path: Column | str, text: Column | str, lexicon: Lexicon = DEFAULT_LEXICON
) -> Column:
    """False under an excluded heading or with an excluded beginning."""
    headings = F.transform(col(heading_path), F.lower)
    start = F.lower(F.regexp_replace(col(text), r"(?U)^\s+", ""))
    excluded = F.arrays_overlap(headings, strings(lexicon.excluded_headings))
    for prefix in lexicon.excluded_prefixes:
        excluded = excluded | start.startswith(prefix)
    return ~F.coalesce(excluded, F.lit(False))


def repeated_phrase(text: Column | str, size: int = 8) -> Column:
    """The earliest run of ``size`` words that already occurred, or null."""
    words = extract_all(normalize_block(text), lx.WORD_TOKEN)

    def find(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))
        windows = F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " "))
        ordered = F.sort_array(F.transform(windows, lambda s, i: F.struct(s.alias("s"), i.alias("i"))))

        def earliest(o: Column) -> Column:
            repeats = F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(o) - 1, F.lit(1))),
                lambda j: F.when(F.get(o, j)["s"] == F.get(o, j - 1)["s"], F.get(o, j)["i"]),
            )
            return F.array_min(repeats)

        at = let(ordered, earliest)
        return F.when(
            F.size(w) > size, let(at, lambda k: F.array_join(F.slice(w, k + 1, size), " "))
        )

    return let(words, find)


def catch_alls(text: Column | str) -> Column:
    """Open-ended phrases, each with single spaces."""
    found = let(
        normalize_block(text),
        lambda value: F.flatten(F.array(*[extract_all(value, led(p)) for p in lx.CATCH_ALL_PATTERNS])),
    )
    return F.array_distinct(F.transform(found, collapse_spaces))


def extract_terms(text: Column | str, pattern: str) -> Column:
    """Distinct lower-case matches of a term class (actions, intensifiers, …)."""
    return F.array_distinct(F.transform(F.array_distinct(extract_all(col(text), led(pattern))), F.lower))


def code_anchors(text: Column | str) -> Column:
    """Single-line code spans."""
    return F.array_distinct(extract_all(col(text), r"`([^`\r\n]{1,200})`", 1))


def universal_prerequisite(text: Column | str) -> Column:
    """A clause that makes all of CI a precondition of committing."""
    p = lx.PREREQUISITE_PATTERNS
    clauses = F.filter(
        F.transform(F.split(F.lower(col(text)), r"[.!?;\n]+"), collapse_spaces), lambda c: c != ""
    )

    def demands(all_clauses: Column) -> Column:
        def one(clause: Column, i: Column) -> Column:
            window = F.concat_ws(" ", clause, F.get(all_clauses, i + 1))
            # Both words as plain letters first: few clauses have them.
            return (
                clause.contains("all")
                & clause.contains("ci")
                & clause.rlike(p["all"])
                & clause.rlike(p["ci"])
                & window.rlike(p["commit"])
                & ~clause.rlike(p["negated"])
                & window.rlike(p["ordering"])
            )

        return F.exists(F.transform(all_clauses, one), lambda hit: hit)

    return let(clauses, demands)


def has_stage_gate(text: Column | str) -> Column:
    """Every group of gate terms is represented and no universal prerequisite is stated."""

    def represented(value: Column) -> Column:
        checks = [
            reduce(or_, [value.contains(term) for term in terms]) for terms in lx.GATE_TERM_GROUPS.values()
        ]
        checks += [value.rlike(led(pattern)) for pattern in lx.GATE_WORDS]
        return reduce(and_, checks)

    return let(F.lower(col(text)), represented) & ~universal_prerequisite(text)


def consequential(text: Column | str) -> Column:
    return col(text).rlike(lx.CONSEQUENTIAL_PATTERN)


def substantive_quote(quote: Column | str, text: Column | str) -> Column:
    """Exact excerpt of the text with at least 12 characters and two longer terms."""
    value = col(quote)
    words = F.array_distinct(extract_all(normalize_block(value), lx.WORD_TOKEN))
    terms = F.filter(words, lambda t: F.length(t) >= 3)
    return (
        F.contains(col(text), value)
        & (F.length(strip(value)) >= 12)
        & (F.size(terms) >= 2)
    )


def utf8_bytes(text: Column | str) -> Column:
    """Size in UTF-8 bytes; also the upper bound for a token count."""
    return F.octet_length(col(text)).cast("long")


def line_count(text: Column | str) -> Column:
    """Lines of a text: a final newline does not start another line."""
    value = F.regexp_replace(col(text), r"\r\n?", "\n")
    trimmed = F.regexp_replace(value, r"\n\z", "")
    return F.when(value == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "\n"))).cast("long")
