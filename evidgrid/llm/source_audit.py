"""Source divergence audit: how the words of each (lang, source) group differ from its language.

Term counts. Tasks count words in plain dictionaries and hand over one row per (lang, source, term),
so a hot source or a frequent word is summed up before it is shuffled. A language keeps the terms
that stand in enough of its documents; everything after that works on the kept terms.

Distance between sources. The sum over all kept terms is never built densely. With p0 the share of
a term that a group does not have, it is split into sums over the own terms of either group against
the p0 of the other (from a histogram of shares), one correction per term that both have, and a
multiple of the difference of the two p0.

Leading terms. A term falls behind one that has at least its count in the group, at most its count in
the language, and comes earlier in UTF-8: whatever the totals are, the other one ranks before it. So
a term that falls behind ``top`` others is not among the first ``top``. Every partition keeps the terms
of each group that fall behind fewer than that (the skyband), the skybands are merged by the same
rule, and only what is left is ranked by the exact value.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidgrid.llm.common import Scratch, byte_table, field, lean, text_slices

#: A language keeps the terms of at least so many of its documents.
LEAST_DOCUMENTS = 30
#: Added to every count, and the scale of the shares.
ADDED, SCALE = 5, 1_000_000_000
#: Ranks of terms that are returned.
TOP = 50
#: Counters that a task holds before it hands them over.
HELD = 400_000
#: Rows of a sorted group that are compared with the skyband at once.
CHUNK = 256
LETTERS = byte_table([*range(97, 123), *range(128, 256)])
GROUP = ["lang", "source"]


def group_columns(docs: DataFrame) -> list[Column]:
    return [F.coalesce(field(name).cast("string"), F.lit("")).alias(name) for name in GROUP]


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); summed up within tasks only."""

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (seen, documents) in held.items():
            terms = list(seen)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms), pa.string()),
                    pa.array([source] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array([seen[t] for t in terms], pa.int64()),
                    pa.array([documents[t] for t in terms], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch, texts in text_slices(batches, "text"):
            langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            sources = batch.column(batch.schema.get_field_index("source")).to_pylist()
            for lang, source, text in zip(langs, sources, texts, strict=True):
                words = text.translate(LETTERS).split()
                if not words:
                    continue
                seen, documents = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(seen)
                seen.update(words)
                documents.update(set(words))
                size += len(seen)
                if size > HELD:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    texts = docs.select(*group_columns(docs), "text")
    return texts.mapInArrow(
        lean(run), "lang string, source string, term string, n bigint, docs bigint"
    )


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * kept)), exact; null without kept terms."""
    top = f"CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + {ADDED} AS DECIMAL(20,0))"
    below = f"CAST({total} + {ADDED} * {kept} AS DECIMAL(20,0))"
    return F.expr(f"CASE WHEN {kept} > 0 THEN 1 + ({top}) div ({below}) END")


def leaders(
    totals: np.ndarray, terms: list[str], most: int, band: dict
) -> np.ndarray:
    """Which rows of a sorted chunk of one group stay; ``band`` has the group's rows that stayed.

    Rows come with the largest count first, then the smallest total, then the earliest term.
    """
    known = len(band["totals"])
    names = band["terms"] + [t.encode() for t in terms]
    place = np.empty(len(names), np.int64)
    place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    every = np.concatenate([band["totals"], totals])
    before = (every[None, :] <= totals[:, None]) & (place[None, :] < place[known:, None])
    # A row later in the order does not come before, in whatever it is equal.
    before[:, known:] &= np.tri(len(totals), len(totals), -1, dtype=bool)
    stay = before.sum(axis=1) < most
    band["totals"] = np.concatenate([band["totals"], totals[stay]])
    band["terms"] += [n for n, s in zip(names[known:], stay, strict=True) if s]
    return stay


def skyband(rows: DataFrame, most: int) -> DataFrame:
    """Rows (lang, source, term, n, total) that fall behind fewer than ``most`` of their partition."""
    ordered = rows.sortWithinPartitions(
        "lang", "source", F.col("n").desc(), F.col("total").asc(), F.col("term").asc()
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, band = None, {}
        for batch in batches:
            langs, sources, terms = (batch.column(i).to_pylist() for i in range(3))
            totals = batch.column(4).to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            start = 0
            while start < batch.num_rows:
                group = (langs[start], sources[start])
                if group != at:
                    at, band = group, {"totals": np.empty(0, np.int64), "terms": []}
                stop = start
                while (
                    stop < batch.num_rows
                    and stop < start + CHUNK
                    and (langs[stop], sources[stop]) == at
                ):
                    stop += 1
                part = slice(start, stop)
                keep[part] = leaders(totals[part], terms[part], most, band)
                start = stop
            if keep.any():
                yield batch.filter(pa.array(keep))

    return ordered.mapInArrow(
        lean(run), "lang string, source string, term string, n bigint, total bigint"
    )


def leading_terms(cells: DataFrame, groups: DataFrame, scratch: Scratch, top: int) -> DataFrame:
    """The first ``top`` terms of every group by their share above that of the language."""
    rows = cells.select("lang", "source", "term", "n", "total")
    local = scratch.save(skyband(rows, top), "bands")
    merged = skyband(local.repartition(F.col("lang"), F.col("source")), top)
    valued = (
        merged.join(groups, GROUP)
        .withColumn("p", share("n", "group_total", "kept"))
        .withColumn("q", share("total", "lang_total", "kept"))
        .where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                (F.col("p") - F.col("q")).alias("value"))
    )
    place = Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), F.col("item").asc())
    return valued.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)


def source_distances(cells: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """Every group with every other source of its language and the summed difference of shares."""
    narrow = groups.select(*GROUP, "group_total", "kept").withColumn(
        "p0", share("0", "group_total", "kept")
    )
    shares = scratch.save(
        cells.join(narrow, GROUP)
        .select(*GROUP, "term", share("n", "group_total", "kept").alias("p"), "p0"),
        "shares",
    )
    other = narrow.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    # Own terms against the share of a missing term in the other group.
    histogram = scratch.save(
        shares.groupBy(*GROUP, "p").agg(F.count(F.lit(1)).alias("terms")), "histogram"
    )
    own = (
        histogram.join(other, "lang")
        .where("source != item")
        .groupBy("lang", "source", "item")
        .agg(
            F.sum(F.col("terms") * F.abs(F.col("p") - F.col("q0"))).alias("value"),
            F.sum("terms").alias("terms"),
        )
    )
    # Terms that both have: their own difference in place of the two above.
    beside = shares.select(
        "lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0")
    )
    p, q, p0, q0 = (F.col(name) for name in ("p", "q", "p0", "q0"))
    gain = F.abs(p - q) - F.abs(p - q0) - F.abs(q - p0) + F.abs(p0 - q0)
    both = (
        shares.join(beside, ["lang", "term"])
        .where("source < item")
        .groupBy("lang", "source", "item")
        .agg(F.sum(gain).alias("value"))
    )
    turned = ["lang", F.col("item").alias("source"), F.col("source").alias("item")]
    nothing = F.lit(0).cast("long")
    pieces = (
        own.select("lang", "source", "item", "value", "terms")
        .union(own.select(*turned, "value", "terms"))
        .union(both.select("lang", "source", "item", "value", nothing))
        .union(both.select(*turned, "value", nothing))
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    )
    pairs = narrow.join(other, "lang").where("source != item")
    value = F.col("value") + (F.col("kept") - F.col("terms")) * F.abs(F.col("p0") - F.col("q0"))
    # Without any own term on both sides there are only terms that neither has.
    bare = F.col("kept") * F.abs(F.col("p0") - F.col("q0"))
    distances = pairs.join(pieces, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item",
        F.coalesce(value, bare, nothing).alias("value"),
    )
    place = Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), F.col("item").asc())
    return distances.withColumn("rank", F.row_number().over(place))


def source_audit(
    docs: DataFrame, scratch: Scratch, least: int = LEAST_DOCUMENTS, top: int = TOP
) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) group.

    Part ``pair`` has every other source of the language by the distance of term shares, part ``term``
    the first ``top`` terms whose share is above that of the language. Terms are runs of letters a-z and
    of characters beyond ASCII, with A-Z lower-cased; a language keeps the terms of at least ``least``
    documents. Null text, lang and source count as empty strings; a repeated row is a document of its
    own; a group without words has no terms but its pairs; a language without kept terms has pairs of
    value 0. Equal values rank by the UTF-8 bytes of the item. Texts are read whole. An empty table
    gives an empty table; other columns are not looked at. Two results of one ``scratch`` do not mix:
    give each call its own.
    """
    counts = scratch.save(
        term_counts(docs)
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
        "counts",
    )
    terms = scratch.save(
        counts.groupBy("lang", "term")
        .agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= least)
        .drop("docs"),
        "terms",
    )
    cells = scratch.save(counts.drop("docs").join(terms, ["lang", "term"]), "cells")
    scratch.release("counts")
    languages = terms.groupBy("lang").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_total")
    )
    totals = cells.groupBy(*GROUP).agg(F.sum("n").alias("group_total"))
    groups = scratch.save(
        docs.select(*group_columns(docs))
        .distinct()
        .join(languages, "lang", "left")
        .join(totals, GROUP, "left")
        .na.fill(0, ["kept", "lang_total", "group_total"]),
        "source-groups",
    )
    return source_distances(cells, groups, scratch).union(
        leading_terms(cells, groups, scratch, top)
    )
