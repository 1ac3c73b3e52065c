"""N-gram Jaccard join by grouped prefixes.

The shingles of a document are put into one order for the whole corpus, rare ones first. Two sets
that are similar enough share a shingle in their prefixes. Documents with the same prefix and size
form one group; groups that share a prefix shingle are compared by size and by the place of that
shingle, which bounds what they can have in common; group pairs that are left are expanded to the
different sets of their members and verified.

Order. Counting every shingle exactly would shuffle all of them, so the order comes from a sketch:
counters, one per hash value, added up over the corpus and rounded to a byte. There is one counter
for every ``CELL_BYTES`` of text up to 2 ** ``MOST_BITS``, which bounds what is broadcast. Any order
gives the same links; a finer sketch gives shorter lists.

Large groups of near copies. The wanted result is the component of every document, so the pairs of
a list are not all needed. First every list links its members to the one with the fewest rare
shingles before the shared one. Then only members that are still in different components are paired.
No link between components is lost, and a list whose members are all linked emits no pair.

Verification. A parity bitmap of 1,024 bits per set gives an upper bound on the overlap of a pair;
pairs that it allows are verified with the full shingle sets, fetched for these documents alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidgrid.llm.common import Scratch, drop_rows, join_keys, lean, text_slices
from evidgrid.llm.components import components
from evidgrid.llm.rolling import Hasher, inside, mixed, signed

SHINGLE = 4
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Bytes of text for one counter of the sketch, and its size at least and at most.
CELL_BYTES, LEAST_BITS, MOST_BITS = 64, 14, 26
#: The sketch travels in so many pieces.
PIECES = 64
BITMAP = 1_024
BASE_SHINGLE = 0xC2B2AE3D27D4EB4F
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
NO_ID = -(1 << 63)
NODE = ["id", "mark"]


class Shingles:
    """Distinct shingle hashes of the documents of a slice."""

    def __init__(self, size: int):
        self.size = size
        self.hasher = Hasher()

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes of all documents, sorted within each, and their number per document."""
        split = [text.translate(LOWERED).split() for text in texts]
        lengths = np.array([len(ws) for ws in split], np.int64)
        words = self.hasher.words(split)
        starts, owner = inside(lengths, self.size)
        rolled = self.hasher.rolling(words, self.size, BASE_SHINGLE)
        hashes = [rolled[starts]] if len(starts) else [np.empty(0, np.uint64)]
        owners = [owner]
        first = np.cumsum(lengths) - lengths
        for d in np.flatnonzero((lengths > 0) & (lengths < self.size)):
            n = int(lengths[d])
            whole = self.hasher.rolling(words[first[d] : first[d] + n], n, BASE_SHINGLE)
            hashes.append(mixed(whole + np.uint64(n)))
            owners.append(np.array([d]))
        values, owner = np.concatenate(hashes), np.concatenate(owners)
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[fresh], owner[fresh]
        return values, np.bincount(owner, minlength=len(texts))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the values of each document, modulo 2 ** 64."""
    total = np.concatenate(([np.uint64(0)], np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def profile(texts: DataFrame, size: int, bits: int) -> DataFrame:
    """Rows of documents (id, mark, n, two set sums) and of sketch pieces (piece, cells)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        cells = np.zeros(1 << bits, np.uint16)
        for batch, bodies in text_slices(batches, "text"):
            values, counts = shingles.of(bodies)
            at = (values >> np.uint64(64 - bits)).astype(np.int64)
            np.add.at(cells, at, 1)  # a slice has fewer words than would overflow
            np.minimum(cells, 255, out=cells)
            rows = len(bodies)
            yield pa.RecordBatch.from_arrays(
                [
                    _column(batch, "id"),
                    _column(batch, "mark"),
                    pa.array(counts),
                    pa.array(signed(_sums(values, counts))),
                    pa.array(signed(_sums(mixed(values), counts))),
                    pa.nulls(rows, pa.int32()),
                    pa.nulls(rows, pa.binary()),
                ],
                names=names,
            )
        part = (1 << bits) // PIECES
        for piece in range(PIECES):
            part_cells = np.minimum(cells[piece * part : (piece + 1) * part], 255).astype(np.uint8)
            if part_cells.any():
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.nulls(1, pa.int64())] * 5,
                        pa.array([piece], pa.int32()),
                        pa.array([part_cells.tobytes()]),
                    ],
                    names=names,
                )

    names = ["id", "mark", "n", "sum1", "sum2", "piece", "cells"]
    return texts.mapInArrow(
        lean(run),
        "id bigint, mark bigint, n bigint, sum1 bigint, sum2 bigint, piece int, cells binary",
    )


def sketch_of(rows: DataFrame, bits: int) -> np.ndarray:
    """Counters of all tasks added up, as bytes on a logarithmic scale (0: at most one shingle)."""
    part = (1 << bits) // PIECES

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, cells in zip(batch.column(0), batch.column(1), strict=True):
                total = totals.setdefault(piece.as_py(), np.zeros(part, np.int64))
                total += np.frombuffer(cells.as_buffer(), np.uint8)
        for piece, total in totals.items():
            scaled = np.minimum(255, np.round(8 * np.log2(np.maximum(total, 1)))).astype(np.uint8)
            yield pa.RecordBatch.from_pydict(
                {"piece": pa.array([piece], pa.int32()), "cells": [scaled.tobytes()]}
            )

    pieces = (
        rows.where("piece IS NOT NULL")
        .select("piece", "cells")
        .repartition(PIECES, "piece")
        .mapInArrow(lean(add), "piece int, cells binary")
    )
    whole = np.zeros(1 << bits, np.uint8)
    for row in pieces.collect():  # 2 ** bits bytes in all
        whole[row.piece * part : (row.piece + 1) * part] = np.frombuffer(row.cells, np.uint8)
    return whole


def prefixes(texts: DataFrame, sketch: np.ndarray, size: int, percent: int, bits: int) -> DataFrame:
    """id, mark, n, prefix (hash of it), shingles of the prefix with their places, bitmap."""
    shared = texts.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        shingles = Shingles(size)
        entry = pa.struct([("s", pa.int64()), ("k", pa.int64())])
        for batch, bodies in text_slices(batches, "text"):
            values, counts = shingles.of(bodies)
            owner = np.repeat(np.arange(len(bodies)), counts)
            weight = weights[(values >> np.uint64(64 - bits)).astype(np.int64)]
            order = np.lexsort((values, weight, owner))
            values, weight = values[order], weight[order]
            first = np.cumsum(counts) - counts
            place = np.arange(len(values)) - np.repeat(first, counts)
            needed = np.where(counts > 0, counts + (-percent * counts) // 100 + 1, 0)
            chosen = place < np.repeat(needed, counts)
            head = values[chosen]
            # The places take part in the sums, so that these name the sequence.
            turned = mixed(head + place[chosen].astype(np.uint64) * np.uint64(BASE_SHINGLE))
            lead = np.bincount(owner[chosen], minlength=len(bodies))
            # A shingle that is alone in its cell is in no other set.
            listed = chosen & (weight > 0)
            per_doc = np.bincount(owner[listed], minlength=len(bodies))
            offsets = np.concatenate(([0], np.cumsum(per_doc))).astype(np.int32)
            spots = owner * BITMAP + (values & np.uint64(BITMAP - 1)).astype(np.int64)
            parity = (np.bincount(spots, minlength=len(bodies) * BITMAP) & 1).astype(np.uint8)
            maps = np.packbits(parity).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    _column(batch, "id"),
                    _column(batch, "mark"),
                    pa.array(counts),
                    pa.array(signed(_sums(turned, lead))),
                    pa.array(signed(_sums(mixed(turned), lead))),
                    pa.ListArray.from_arrays(
                        pa.array(offsets),
                        pa.StructArray.from_arrays(
                            [pa.array(signed(values[listed])), pa.array(place[listed])],
                            fields=list(entry),
                        ),
                    ),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(0, len(maps) + 1, BITMAP // 64, dtype=np.int32)),
                        pa.array(maps),
                    ),
                ],
                names=["id", "mark", "n", "prefix1", "prefix2", "entries", "bitmap"],
            )

    return texts.mapInArrow(
        lean(run),
        "id bigint, mark bigint, n bigint, prefix1 bigint, prefix2 bigint, "
        "entries array<struct<s:bigint,k:bigint>>, bitmap array<bigint>",
    )


def full_sets(texts: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for batch, bodies in text_slices(batches, "text"):
            values, counts = shingles.of(bodies)
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    _column(batch, "id"),
                    _column(batch, "mark"),
                    pa.ListArray.from_arrays(offsets, pa.array(signed(values))),
                ],
                names=["id", "mark", "set"],
            )

    return texts.mapInArrow(lean(run), "id bigint, mark bigint, set array<bigint>")


def may_link(n1: str, k1: str, n2: str, k2: str, percent: int) -> Column:
    """Sizes allow a link, and so does the place of the first shared shingle."""
    a, b = F.col(n1), F.col(n2)
    rest = F.least(a - F.col(k1), b - F.col(k2))
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (
        (100 + percent) * rest >= percent * (a + b)
    )


def node(id_name: str = "id", mark_name: str = "mark") -> Column:
    return F.struct(F.col(id_name).alias("id"), F.col(mark_name).alias("mark"))


def verified(
    pairs: DataFrame,
    texts: DataFrame,
    maps: DataFrame,
    scratch: Scratch,
    name: str,
    size: int,
    percent: int,
) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough, written."""
    left = maps.select(node().alias("a"), F.col("n").alias("n1"), F.col("bitmap").alias("m1"))
    right = maps.select(node().alias("b"), F.col("n").alias("n2"), F.col("bitmap").alias("m2"))
    apart = F.aggregate(
        F.zip_with("m1", "m2", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")),
        F.lit(0).cast("long"),
        lambda acc, bits: acc + bits,
    )
    n1, n2 = F.col("n1"), F.col("n2")
    most = n1 + n2 - apart  # twice the largest overlap that the bitmaps allow
    open_pairs = scratch.save(
        pairs.join(left, "a")
        .join(right, "b")
        .where((100 + percent) * most >= 2 * percent * (n1 + n2))
        .select("a", "b", "n1", "n2"),
        f"open-{name}",
    )
    needed = scratch.save(
        open_pairs.select(F.explode(F.array("a", "b")).alias("v")).select("v.*").distinct(),
        f"needed-{name}",
    )
    sets = scratch.save(
        full_sets(join_keys(texts, needed, NODE, "left_semi"), size).dropDuplicates(NODE),
        f"sets-{name}",
    )
    first = sets.select(node().alias("a"), F.col("set").alias("s1"))
    second = sets.select(node().alias("b"), F.col("set").alias("s2"))
    common = F.size(F.array_intersect("s1", "s2")).cast("long")
    links = scratch.save(
        open_pairs.join(first, "a")
        .join(second, "b")
        .where(100 * common >= percent * (n1 + n2 - common))
        .select("a", "b"),
        f"links-{name}",
    )
    scratch.release(f"open-{name}", f"needed-{name}", f"sets-{name}")
    return links


def similar_documents(
    docs: DataFrame,
    scratch: Scratch,
    size: int = SHINGLE,
    percent: int = PERCENT,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, mark, kept.

    Two documents link when 100 * intersection >= ``percent`` * union of their shingle sets;
    component_id is the smallest doc_id that links reach, the own one included. A text with fewer
    words than a shingle has its whole sequence as its one shingle; without words it has none and
    links with nothing. A row without an id takes part and never names a component, unless it has
    only such rows, which gives null. Rows that repeat an id are judged by their own texts and have
    the smallest id of what they reach. ``mark`` is a hash of the text; ``kept`` is true for one
    document of each component, the one with its smallest id. An empty table gives an empty table; other columns are not
    looked at.
    """
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64("text").alias("mark"),
        "text",
    )
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, (total // CELL_BYTES).bit_length()))
    rows = scratch.save(profile(texts, size, bits), "profile")
    sketch = sketch_of(rows, bits)
    # Equal sets are one node, named by its smallest (id, hash of the text).
    documents = rows.where("piece IS NULL").drop("piece", "cells")
    alike = ["sum1", "sum2", "n"]
    named = documents.groupBy(*alike).agg(F.min(node()).alias("node"))
    known = scratch.save(
        documents.join(named, alike).select("id", "mark", "n", "node"), "known"
    )
    scratch.release("profile")

    lead = scratch.save(prefixes(texts, sketch, size, percent, bits), "prefixes")
    nodes = known.where("n > 0").select("node.*").distinct()
    # One row per node with its group: equal prefix and size.
    own = lead.join(nodes, NODE, "left_semi").dropDuplicates(NODE)
    same = ["n", "prefix1", "prefix2"]
    groups = own.groupBy(*same).agg(
        F.min(node()).alias("group"), F.first("entries").alias("entries"), F.count("*").alias("size")
    )
    groups = scratch.save(groups, "groups")
    crowded = groups.where("size > 1").drop("entries", "size")
    mates = scratch.save(
        own.select(*NODE, *same).join(crowded, same).select(node().alias("node"), "n", "group"),
        "mates",
    )
    maps = own.select(*NODE, "n", "bitmap")

    # Members of a group against its head.
    inner = mates.where("node != group").select(F.col("group").alias("a"), F.col("node").alias("b"))
    # Members of a list against the one with the fewest shingles before the shared one.
    lists = groups.select(
        F.explode("entries").alias("e"), "n", F.col("group.id").alias("id"),
        F.col("group.mark").alias("mark"),
    ).select("e.s", "e.k", "n", *NODE)
    heads = scratch.save(
        lists.groupBy("s")
        .agg(F.min(F.struct("k", "n", *NODE)).alias("h"), F.count(F.lit(1)).alias("rows"))
        .where("rows > 1")
        .select("s", F.col("h.k").alias("hk"), F.col("h.n").alias("hn"),
                F.col("h.id").alias("hid"), F.col("h.mark").alias("hmark")),
        "heads",
    )
    entries = scratch.save(
        lists.join(heads, "s").select("s", "k", "n", node().alias("node"), "hk", "hn",
                                      node("hid", "hmark").alias("head")),
        "entries",
    )
    scratch.release("heads", "groups")
    stars = entries.where("node != head").where(may_link("n", "k", "hn", "hk", percent))
    stars = stars.select(F.col("head").alias("a"), F.col("node").alias("b"))
    first = scratch.save(inner.union(stars).distinct(), "stars")
    links = verified(first, texts, maps, scratch, "stars", size, percent)
    labels = scratch.save(components(links, scratch, "round"), "labels")

    # Pairs that are still apart: list members, expanded to all sets of their groups.
    def labelled(df: DataFrame) -> DataFrame:
        return df.join(labels, "node", "left").withColumn(
            "component", F.coalesce("component", "node")
        )

    spread_out = mates.select(F.col("group").alias("node"), F.col("node").alias("member"))
    members = (
        entries.select("s", "k", "n", "node")
        .join(spread_out, "node", "left")
        .select("s", "k", "n", F.coalesce("member", "node").alias("node"))
    )
    placed = scratch.save(labelled(members), "placed")
    mixed_lists = scratch.save(
        placed.groupBy("s")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low != high")
        .select("s"),
        "mixed",
    )
    rest = scratch.save(placed.join(mixed_lists, "s", "left_semi"), "rest")
    scratch.release("entries", "placed", "mixed")
    other = rest.select("s", *[F.col(c).alias(f"{c}2") for c in rest.columns if c != "s"])
    apart = rest.join(other, "s").where(
        (F.col("component") < F.col("component2")) & may_link("n", "k", "n2", "k2", percent)
    )
    within = labelled(mates.select("group", "node"))
    beside = within.select("group", F.col("node").alias("node2"), F.col("component").alias("c2"))
    inside_pairs = within.join(beside, "group").where(F.col("component") < F.col("c2"))
    second = scratch.save(
        apart.select(F.col("node").alias("a"), F.col("node2").alias("b"))
        .union(inside_pairs.select(F.col("node").alias("a"), F.col("node2").alias("b")))
        .distinct(),
        "apart",
    )
    more = verified(second, texts, maps, scratch, "apart", size, percent)
    final = scratch.save(components(links.union(more), scratch, "last"), "final")

    reached = known.join(final, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    real = F.when(F.col("id") != NO_ID, F.col("id"))
    first = F.min(F.struct(F.col("id") == NO_ID, "id", "mark"))
    heads = (
        reached.where("n > 0")
        .groupBy("component")
        .agg(F.min(real).alias("lowest"), first.alias("head"))
        .withColumnRenamed("component", "c")
    )
    joined = reached.join(heads, (F.col("component") == F.col("c")) & (F.col("n") > 0), "left")
    head = (F.col("head.id") == F.col("id")) & (F.col("head.mark") == F.col("mark"))
    return joined.select(
        real.alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("lowest")).otherwise(real).alias("component_id"),
        "mark",
        F.coalesce(head, F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` that ``similar_documents`` keeps, with all their columns."""
    found = similar_documents(docs, scratch)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("id"), "mark").distinct()
    return drop_rows(docs, scratch.save(gone, "gone"))
