"""Small building blocks shared by the column functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


# Unicode white space, spelled out: much faster than switching on Unicode classes.
SPACES = (
    "\t\n\x0b\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
NOT_SPACE = r"[^\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(value: Column | str) -> Column:
    """Without Unicode white space at both ends; ``trim`` takes blanks only."""
    return F.regexp_replace(col(value), r"(?U)^\s+|\s+$", "")


def strings(values: Iterable[str]) -> Column:
    """Literal ``array<string>``, also for an empty collection."""
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(value) for value in values])


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def any_of(terms: Iterable[str]) -> str:
    """Regex alternation that finds any of the literal terms."""
    return "(?:" + "|".join(r"\Q" + term + r"\E" for term in terms) + ")"


def _first_letters(body: str) -> str | None:
    """Letters that the alternatives of a pattern begin with; None unless each begins with one letter."""
    starts, depth, begin = [], 0, 0
    for at, sign in enumerate(body + "|"):
        if sign == "|" and depth == 0:
            starts.append(body[begin:at])
            begin = at + 1
        elif sign in "[\\" and (sign == "[" or body[at + 1 : at + 2] in ("Q", "|", "(", ")")):
            return None
        else:
            depth += (sign == "(") - (sign == ")")
        if depth < 0:
            return None
    if not all(re.match(r"[a-z](?![?*{+])", start) for start in starts):
        return None
    return "".join(sorted({start[0] for start in starts}))


def led(pattern: str) -> str:
    """The same pattern with its first letter tested before all else.

    A Unicode word boundary costs far more than a letter, and it is tried at every position; so do
    the alternatives of a list of words.
    """
    one = re.sub(r"^((?:\(\?[a-zA-Z]+\))?)\\b([a-z])(?![?*{|])(?!.*\|)", r"\1(?=\2)\\b\2", pattern)
    if one != pattern:
        return one
    flags, bounded, plain = re.match(
        r"((?:\(\?[a-zA-Z]+\))?)(?:\\b\(\?:(.*)\)\\b|([a-z |]+))$|", pattern, re.S
    ).groups()
    body = bounded or plain
    letters = _first_letters(body) if body else None
    if not letters:
        return pattern
    edge = r"\b" if bounded else ""
    return f"{flags}(?=[{letters}]){edge}(?:{body}){edge}"


def prefix_sums(lengths: Column, chunk: int = 64) -> Column:
    """Exclusive running sums of an integer array.

    Two levels (sums of chunks, then sums inside a chunk) keep the work near n * sqrt(n); a plain
    fold that appends to its own result copies the array for every element.
    """

    def scan(values: Column, start: Column) -> Column:
        folded = F.aggregate(
            values,
            F.struct(start.cast("long").alias("total"), F.array().cast("array<long>").alias("out")),
            lambda acc, item: F.struct(
                (acc["total"] + item).alias("total"),
                F.concat(acc["out"], F.array(acc["total"])).alias("out"),
            ),
        )
        return folded["out"]

    def add(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda acc, item: acc + item)

    def chunked(values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(chunk))
        pieces = F.transform(starts, lambda s: F.slice(values, s, chunk))
        return let(
            pieces,
            lambda parts: let(
                scan(F.transform(parts, add), F.lit(0)),
                lambda offsets: F.flatten(
                    F.transform(parts, lambda part, i: scan(part, F.get(offsets, i)))
                ),
            ),
        )

    return let(F.transform(lengths, lambda n: n.cast("long")), chunked)
