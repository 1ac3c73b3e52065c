"""Secret detection and redaction as column expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidgrid import lexicon as lx
from evidgrid.functions.exprs import col, extract_all, let
from evidgrid.functions.identity import content_sha
from evidgrid.functions.text import clean_controls, excerpt, shannon_entropy


class Detector(NamedTuple):
    kind: str
    confidence: str
    pattern: str
    prefix_group: int  # 0: the whole match is the secret
    value_group: int
    needs: tuple[str, ...] = ()  # one of these literals is part of every match


# The shapes that count as secrets, in the order in which they are applied.
DETECTORS = (
    Detector(
        "private_key",
        "high",
        r"(?s)-----BEGIN (?:[A-Z0-9 ]+ )?PRIVATE KEY-----.*?-----END (?:[A-Z0-9 ]+ )?PRIVATE KEY-----",
        0,
        0,
        ("PRIVATE KEY-----",),
    ),
    Detector(
        "credential_header",
        "high",
        r"(?im)^(\s*(?:authorization|proxy-authorization|cookie|set-cookie)\s*:\s*)([^\r\n]+)$",
        1,
        2,
        (":",),
    ),
    Detector(
        "credential_assignment",
        "high",
        r"(?i)((?U:\b)(?:api[_-]?key|access[_-]?token|refresh[_-]?token|auth[_-]?token|"
        r"secret|password|passwd|session(?:[_-]?id)?|cookie)(?U:\b)\s*[:=]\s*[\"']?)"
        r"((?!\[REDACTED)[A-Za-z0-9._~+/=-]{8,})",
        1,
        2,
        (":", "="),
    ),
    Detector("url_userinfo", "high", r"(?i)(https?://)([^\s/@:]+:[^\s/@]+)@", 1, 2, ("://",)),
    Detector(
        "api_key",
        "high",
        r"(?U:\b)(?:sk-ant-[A-Za-z0-9_-]{16,}|sk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{20,}|"
        r"xox[baprs]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{16})(?U:\b)",
        0,
        0,
        ("sk-", "gh", "xox", "AKIA"),
    ),
    Detector(
        "jwt",
        "high",
        r"(?U:\b)eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?U:\b)",
        0,
        0,
        ("eyJ",),
    ),
    Detector(
        "uuid",
        "low",
        r"(?U:\b)[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-"
        r"[0-9a-fA-F]{12}(?U:\b)",
        0,
        0,
        ("-",),
    ),
    Detector(
        "high_entropy",
        "low",
        r"(?<![A-Za-z0-9_-])[A-Za-z0-9_+/=-]{40,}(?![A-Za-z0-9_-])",
        0,
        0,
    ),
)
PLACEHOLDER_PATTERN = r"\[REDACTED:[a-z_]+:[0-9a-f]{10}\]"
# End of fixed values.

PLACEHOLDER_MARK = "\ue000"
FINDINGS_TYPE = "array<struct<kind:string,confidence:string,digest:string>>"


def placeholder(kind: str, value: Column) -> Column:
    return F.concat(
        F.lit(f"[REDACTED:{kind}:"), F.left(content_sha(value), F.lit(10)), F.lit("]")
    )


def _may_match(text: Column, detector: Detector) -> Column:
    """Cheap necessary condition: a byte search instead of a regular expression."""
    possible = F.lit(not detector.needs)
    for literal in detector.needs:
        possible = possible | F.contains(text, F.lit(literal))
    return possible


def _apply(state: Column, detector: Detector) -> Column:
    """Replace the matches of one detector; texts without a match are passed through."""
    text = state["text"]
    parts = [
        F.split(text, detector.pattern, -1).alias("pieces"),
        extract_all(text, detector.pattern).alias("matches"),
    ]
    if detector.prefix_group:
        parts.append(extract_all(text, detector.pattern, detector.prefix_group).alias("prefixes"))
        parts.append(extract_all(text, detector.pattern, detector.value_group).alias("values"))

    def rewritten(found: Column) -> Column:
        values = found["values"] if detector.prefix_group else found["matches"]

        def accepted(value: Column) -> Column:
            return shannon_entropy(value) >= lx.ENTROPY_BITS

        def stitched(match: Column, i: Column) -> Column:
            value = F.get(values, i)
            secret = placeholder(detector.kind, value)
            if detector.prefix_group:
                secret = F.concat(F.get(found["prefixes"], i), secret)
            if detector.kind == "high_entropy":
                secret = F.when(accepted(value), secret).otherwise(match)
            return F.concat(secret, F.get(found["pieces"], i + 1))

        kept = F.filter(values, accepted) if detector.kind == "high_entropy" else values
        findings = F.transform(
            kept,
            lambda value: F.struct(
                F.lit(detector.kind).alias("kind"),
                F.lit(detector.confidence).alias("confidence"),
                content_sha(value).alias("digest"),
            ),
        )
        body = F.array_join(F.transform(found["matches"], stitched), "")
        return F.struct(
            F.concat(F.get(found["pieces"], F.lit(0)), body).alias("text"),
            F.concat(state["findings"], findings).alias("findings"),
        )

    hit = _may_match(text, detector) & text.rlike(detector.pattern)
    return F.when(hit, let(F.struct(*parts), rewritten)).otherwise(state)


def redact(text: Column | str, max_chars: int | None = lx.MAX_EXCERPT_CHARS) -> Column:
    """Struct of the redacted text and the findings, in the order of the detectors."""
    start = F.struct(
        F.replace(col(text), F.lit("\x00"), F.lit("\ufffd")).alias("text"),
        F.array().cast(FINDINGS_TYPE).alias("findings"),
    )

    def chain(state: Column, remaining: tuple[Detector, ...]) -> Column:
        if not remaining:
            return state
        return let(_apply(state, remaining[0]), lambda nxt: chain(nxt, remaining[1:]))

    def finish(state: Column) -> Column:
        cleaned = clean_controls(state["text"])
        shown = let(cleaned, lambda t: excerpt(t, max_chars)) if max_chars else cleaned
        return F.struct(shown.alias("text"), state["findings"].alias("findings"))

    return let(let(start, lambda state: chain(state, DETECTORS)), finish)


def residual_secrets(text: Column | str) -> Column:
    """High-confidence shapes that a redacted text still shows, placeholders left aside."""
    marked = F.regexp_replace(col(text), PLACEHOLDER_PATTERN, PLACEHOLDER_MARK)

    def matches(value: Column, detector: Detector) -> Column:
        found = F.when(_may_match(value, detector), extract_all(value, detector.pattern))
        kept = F.filter(
            F.coalesce(found, F.array().cast("array<string>")),
            lambda match: ~F.contains(match, F.lit(PLACEHOLDER_MARK)),
        )
        return F.transform(
            kept,
            lambda match: F.struct(
                F.lit(detector.kind).alias("kind"),
                F.lit("high").alias("confidence"),
                content_sha(match).alias("digest"),
            ),
        )

    def scan(value: Column) -> Column:
        return F.flatten(F.array(*[matches(value, d) for d in DETECTORS if d.confidence == "high"]))

    return let(marked, scan)


def has_high(findings: Column | str) -> Column:
    return F.exists(col(findings), lambda f: f["confidence"] == "high")


def is_sensitive(redacted: Column | str) -> Column:
    """True where a record must be left out as a whole."""
    state = col(redacted)
    return has_high(state["findings"]) | (F.size(residual_secrets(state["text"])) > 0)
