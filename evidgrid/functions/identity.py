"""Content-derived identities and shape tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidgrid import lexicon as lx
from evidgrid.functions.exprs import col
from evidgrid.functions.text import iso_instant

NUL = "\x00"
RUN_ID_PATTERN = r"^\d{8}T\d{6}Z-[0-9a-f]{8}$"
REQUEST_ID_PATTERN = r"^decision-[0-9a-fA-F]{16}$"
SHA_PATTERN = r"^[0-9a-fA-F]{64}$"


def content_sha(text: Column | str) -> Column:
    return F.sha2(col(text).cast("binary"), 256)


def event_id(
    source_kind: Column | str, session: Column | str, ts: Column | str, sha: Column | str
) -> Column:
    """Identity of an event; the hash is that of the original, unredacted text."""
    material = F.concat_ws(
        NUL, col(source_kind), F.coalesce(col(session), F.lit("")), iso_instant(ts), col(sha)
    )
    return F.concat(F.lit("evt_"), F.left(content_sha(material), F.lit(18)))


def canonical_json(value: Column | str) -> Column:
    """JSON of a struct whose fields are already in key order, null fields kept, final newline."""
    return F.concat(F.to_json(col(value), {"ignoreNullFields": "false"}), F.lit("\n"))


def canonical_digest(value: Column | str) -> Column:
    return content_sha(canonical_json(value))


def digest_prefix(sha: Column | str) -> Column:
    """First 60 bits of a hex digest as a number: summable, hence usable for set digests."""
    return F.conv(F.left(col(sha), F.lit(15)), 16, 10).cast("long")


def independence_key(session: Column | str, kind: Column | str, locator: Column | str) -> Column:
    """Records of one session are one witness; without a session the place of origin is."""
    return F.when(
        F.coalesce(col(session), F.lit("")) != "", F.concat(F.lit("session:"), col(session))
    ).otherwise(F.concat(F.lit("provenance:"), col(kind), F.lit(":"), col(locator)))


def authority_label(authority: Column | str) -> Column:
    labels = F.create_map(*[F.lit(part) for pair in lx.AUTHORITY_LEVELS for part in pair])
    return F.coalesce(labels[col(authority)], F.lit("unknown"))


def valid_run_id(value: Column | str) -> Column:
    return F.coalesce(col(value).rlike(RUN_ID_PATTERN), F.lit(False))


def valid_request_id(value: Column | str) -> Column:
    return F.coalesce(col(value).rlike(REQUEST_ID_PATTERN), F.lit(False))


def valid_sha(value: Column | str) -> Column:
    return F.coalesce(col(value).rlike(SHA_PATTERN), F.lit(False))


def safe_line(value: Column | str, max_chars: int = 2000, allow_empty: bool = False) -> Column:
    """Single-line text without NUL that is not blank and not too long."""
    text = col(value)
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    ok = ~text.rlike(r"[\x00\r\n]") & (F.length(trimmed) <= max_chars)
    if not allow_empty:
        ok = ok & (trimmed != "")
    return F.coalesce(ok, F.lit(False))
