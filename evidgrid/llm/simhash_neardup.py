"""Near duplicates by SimHash fingerprints and vantage-point trees.

Equal fingerprints are one point. A vantage-point tree over a bounded sample cuts the points into
shards: a node keeps a point v and a radius; points within the radius of v go to the inner branch, the
others to the outer one. By the triangle inequality two points that are at most ``DISTANCE`` apart and
stand on different sides are both close to the border, so outer points up to ``DISTANCE`` beyond the
radius are sent to the inner branch as well. Every pair therefore meets in a shard.

A shard goes on with a tree of its own, down to leaves whose points are all compared. Of the exact pairs
of a leaf only a spanning forest is handed on: components need no more, and a large group of near copies
gives as many links as it has members. Points that no vantage point can part are first linked in stars;
then only points that are still in different components are compared. A shard with too many points for
one task is cut into parts, and every pair of parts is a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidgrid.llm.common import Scratch, field, lean, text_slices
from evidgrid.llm.components import components

SHINGLE, SEED = 3, 42
#: Fingerprints link when at most so many of their 64 bits differ.
DISTANCE = 3
#: Fingerprints from which the tree of the shards is made, and points of a shard aimed at. Every level
#: of that tree sends border points twice, so it is no deeper than parallel work and memory need.
SAMPLE, SHARD = 1 << 17, 1 << 18
#: A shard has this part of the points at most, so that small inputs are spread as well.
SPREAD = 12
#: Points that one task takes; larger shards are cut into pairs of parts.
MOST = 1 << 21
#: Points of a leaf that are all compared; vantage points that are tried for a node.
LEAF, TRIES = 512, 4
#: A split must save this share of the comparisons.
GAIN = 0.1
#: Points that a task routes at once, and comparisons that are held at once.
ROUTED, HELD = 1 << 18, 1 << 18
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

Node = tuple[int, int, "Node", "Node"] | int


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp: a bit of the fingerprint is 1 where over half of the shingle hashes have it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text"):
            counts, hashes = np.zeros(len(texts), np.int64), []
            for row, text in enumerate(texts):
                words = text.translate(LOWERED).split()
                if not words:
                    continue
                if len(words) < size:
                    runs = [b" ".join(words)]
                else:
                    runs = map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False))
                own = list(map(xxhash.xxh64_intdigest, runs, repeat(SEED)))
                counts[row] = len(own)
                hashes.append(np.array(own, np.uint64))
            found = np.zeros(len(texts), np.int64)
            if hashes:
                bits = np.unpackbits(np.concatenate(hashes).astype(">u8").view(np.uint8))
                some = counts > 0
                starts = (np.cumsum(counts) - counts)[some]
                sums = np.add.reduceat(bits.reshape(-1, 64), starts, axis=0, dtype=np.int32)
                majority = np.packbits(2 * sums > counts[some][:, None], axis=1)
                found[some] = majority.view(">u8").ravel().astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found)], names=["doc_id", "fp"]
            )

    texts = docs.select(field("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(lean(run), "doc_id bigint, fp bigint")


def apart(point: np.uint64, points: np.ndarray) -> np.ndarray:
    return np.bitwise_count(points ^ point)


def split(points: np.ndarray, distance: int, draw: np.random.Generator) -> tuple | None:
    """The vantage point and radius that leave the fewest comparisons, and the distances from it.

    None if no vantage point that is tried saves enough.
    """
    best = None
    for vantage in points[draw.integers(0, len(points), TRIES)]:
        far = apart(vantage, points)
        upto = np.cumsum(np.bincount(far, minlength=65 + distance)).astype(np.float64)
        inner = upto[distance:]
        outer = len(points) - upto[: len(inner)]
        left = inner**2 + outer**2
        radius = int(np.argmin(left))
        if best is None or left[radius] < best[0]:
            best = (left[radius], vantage, radius, far)
    if best[0] > (1 - GAIN) * float(len(points)) ** 2:
        return None
    return best[1:]


def grow(sample: np.ndarray, most: int, distance: int) -> tuple[Node, int]:
    """A tree over ``sample`` with at most ``most`` points in a leaf where they can be parted.

    A node is (vantage point, radius, inner branch, outer branch), a leaf the number of its shard.
    """
    draw, shards = np.random.default_rng(SEED), 0

    def node(points: np.ndarray) -> Node:
        nonlocal shards
        found = split(points, distance, draw) if len(points) > most else None
        if found is None:
            shards += 1
            return shards - 1
        vantage, radius, far = found
        return (
            int(vantage), radius,
            node(points[far <= radius + distance]), node(points[far > radius]),
        )

    return node(sample), shards


def routes(tree: Node, points: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, points) of all shards that a point belongs to or lies at the border of."""
    if not len(points):
        return
    if isinstance(tree, int):
        yield tree, points
        return
    vantage, radius, inner, outer = tree
    far = apart(np.uint64(vantage), points)
    yield from routes(inner, points[far <= radius + distance], distance)
    yield from routes(outer, points[far > radius], distance)


def united(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``count`` places the smallest place that the links (left, right) reach."""
    label = np.arange(count)
    while True:
        a, b = label[left], label[right]
        open_links = a != b
        if not open_links.any():
            return label
        left, right = left[open_links], right[open_links]
        a, b = a[open_links], b[open_links]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label = label[label]


def compared(
    points: np.ndarray, left: np.ndarray, right: np.ndarray, distance: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of the places ``left`` with the places ``right``; many pairs become a spanning forest."""
    step, same = max(1, HELD // max(1, len(right))), left is right
    for start in range(0, len(left), step):
        some = left[start : start + step]
        others = right[start:] if same else right
        a, b = np.nonzero(apart(points[some][:, None], points[others]) <= distance)
        if len(a) > len(some) + len(others):
            places = np.concatenate([some, others])
            label = united(len(places), a, b + len(some))
            yield places, places[label]
        else:
            yield some[a], others[b]


def unparted(
    points: np.ndarray, here: np.ndarray, distance: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of places that no vantage point parts: stars first, then what is still apart."""
    own = points[here]
    open_places = np.ones(len(here), bool)
    label = np.arange(len(here))
    for _ in range(LEAF):
        if not open_places.any():
            break
        centre = int(np.argmax(open_places))
        near = np.flatnonzero(apart(own[centre], own) <= distance)
        open_places[near] = False
        label = united(
            len(here),
            np.concatenate([np.arange(len(here)), near]),
            np.concatenate([label, np.full(len(near), centre)]),
        )
    yield here, here[label]
    values, sizes = np.unique(label, return_counts=True)
    largest = label == values[np.argmax(sizes)]
    # All places outside the largest group against those in it, and among themselves.
    rest = here[~largest]
    yield from compared(points, rest, here[largest], distance)
    yield from compared(points, rest, rest, distance)


def forest(points: np.ndarray, distance: int) -> np.ndarray:
    """For each point the smallest place that near pairs of these points reach."""
    draw = np.random.default_rng(SEED)
    links = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    todo = [np.arange(len(points))]
    while todo:
        here = todo.pop()
        found = split(points[here], distance, draw) if len(here) > LEAF else None
        if found is not None:
            _, radius, far = found
            todo += [here[far <= radius + distance], here[far > radius]]
        elif len(here) <= 8 * LEAF:
            links += compared(points, here, here, distance)
        else:
            links += unparted(points, here, distance)
    return united(len(points), *[np.concatenate(side) for side in zip(*links, strict=True)])


def shard_links(cells: DataFrame, distance: int) -> DataFrame:
    """Links a, b of the points of every cell; rows come sorted by cell."""
    key = ["shard", "part1", "part2"]

    def links(points: list[np.ndarray]) -> pa.RecordBatch:
        whole = np.unique(np.concatenate(points).view(np.uint64))
        head = forest(whole, distance)
        linked = np.flatnonzero(head != np.arange(len(whole)))
        signed = whole.view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(signed[linked]), pa.array(signed[head[linked]])], names=["a", "b"]
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            points = batch.column(3).to_numpy()
            edges = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1
            starts = [0, *edges.tolist(), batch.num_rows]
            for start, stop in zip(starts, starts[1:], strict=False):
                if tuple(cell[start]) != at and held:
                    yield links(held)
                    held = []
                at = tuple(cell[start])
                held.append(points[start:stop])
        if held:
            yield links(held)

    return (
        cells.repartition(*key)
        .sortWithinPartitions(*key)
        .mapInArrow(lean(run), "a bigint, b bigint")
    )


def near_links(
    points: DataFrame, scratch: Scratch, distance: int = DISTANCE,
    sample: int = SAMPLE, shard: int = SHARD, most: int = MOST,
) -> DataFrame:
    """Links (a, b) that join all points (column fp, distinct) with near ones, written.

    The links have the components of all pairs of at most ``distance`` differing bits.
    """
    total = points.count()
    step = max(1, -(-total // sample))
    some = points.where(F.pmod(F.xxhash64("fp"), F.lit(step)) == 0).select("fp")
    drawn = some.toArrow().column("fp").to_numpy().view(np.uint64)  # about ``sample`` numbers
    most_drawn = max(1, min(shard // step, len(drawn) // SPREAD))
    tree, _ = grow(np.sort(drawn), most_drawn, distance)
    shared = points.sparkSession.sparkContext.broadcast(tree)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for number, part in routes(shared.value, np.concatenate(held), distance):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), number, np.int32)), pa.array(part.view(np.int64))],
                    names=["shard", "fp"],
                )

        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            size += batch.num_rows
            if size >= ROUTED:
                yield from rows(held)
                held, size = [], 0
        if held:
            yield from rows(held)

    routed = scratch.save(
        points.select("fp").mapInArrow(lean(route), "shard int, fp bigint"), "routed"
    )
    # One row for every ``most`` points at most.
    large = scratch.save(
        routed.groupBy("shard")
        .agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
        .where("parts > 1"),
        "large",
    )
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    cells = (
        routed.join(large, "shard", "left")
        .select("shard", F.coalesce(part, F.lit(0)).alias("own"), other.alias("other"), "fp")
        .select(
            "shard", F.least("own", "other").alias("part1"),
            F.greatest("own", "other").alias("part2"), "fp",
        )
    )
    links = scratch.save(shard_links(cells, distance), "near")
    scratch.release("routed")
    return links


def near_duplicates(
    docs: DataFrame, scratch: Scratch, distance: int = DISTANCE, size: int = SHINGLE
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents link when at most ``distance`` bits of their fingerprints differ; component_id is the
    smallest doc_id that links reach, the own one included. A text of fewer words than a shingle is one
    shingle; a null text or one without words has fingerprint zero and links like any other. A row
    without an id takes part and never names a component, unless that has only such rows, which gives
    null; rows that repeat an id are rows of their own. Texts are read whole. An empty table gives an
    empty table; other columns are not looked at.
    """
    rows = scratch.save(fingerprints(docs, size), "fingerprints")
    points = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("lowest")), "points")
    links = near_links(points, scratch, distance)
    reached = scratch.save(components(links, scratch, "near-round"), "reached")
    placed = scratch.save(
        points.join(reached.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "lowest", F.coalesce("component", "fp").alias("component")
        ),
        "placed",
    )
    heads = scratch.save(
        placed.groupBy("component").agg(F.min("lowest").alias("component_id")), "heads"
    )
    named = scratch.save(placed.join(heads, "component").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
