"""Hard negatives by a secondary sort of packed scores.

Anchors are a stated share of the rows. They are taken in blocks of bounded size; a block is broadcast
and every task scores its rows against it. The first pass finds the positives of every anchor, the
second one the rows of other labels that lie in a window of one of the positives. A task keeps only
the first few rows of every window, so what is shuffled grows with anchors and tasks, not with pairs.

Positives and negatives are packed into byte keys (anchor, descending score, positives first, id),
dealt out by anchor and sorted inside the partitions. One pass over a partition opens a window at every
positive, hands out the negatives that follow and closes the window when it is full or left behind;
nothing of an anchor is held but its open windows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidgrid.llm.common import Scratch, field, lean

#: Components become floor(STEP * x).
STEP = 256
#: Every so-manieth id is an anchor; every so-manieth has a shifted label.
ANCHOR_EVERY, SHIFT_EVERY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 5
#: A negative has at least PERCENT of the score of its positive, and not more than that score.
PERCENT = 80
#: Bytes of anchor vectors that are broadcast at once.
BLOCK_BYTES = 16 << 20
#: Anchors that are scored against a batch of rows at once, and rows of a batch.
ANCHOR_SLICE, ROW_SLICE = 512, 2_048
FLIP = np.uint64(1 << 63)
KEY = struct.Struct(">QQBQ")
RESULT = (
    "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
    "positive_score bigint, negative_score bigint"
)


def prepared(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v: rows that take part, labels shifted, components as whole numbers."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(
        field("vec_id").cast("long").alias("vec_id"),
        field("label").cast("long").alias("label"),
        field("embedding").cast("array<double>").alias("v"),
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    shifted = F.when(F.col("vec_id") % SHIFT_EVERY == 0, (F.col("label") + 1) % LABELS)
    return rows.where(finite).select(
        "vec_id",
        shifted.otherwise(F.col("label")).alias("label"),
        F.transform("v", lambda x: F.floor(x * STEP)).alias("v"),
    )


def one_row_per_id(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Of rows with one id the one with the smallest label and vector."""
    repeated = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    repeated = scratch.save(repeated.select("vec_id"), "repeated")
    if repeated.isEmpty():
        return rows
    least = (
        rows.join(repeated, "vec_id", "left_semi")
        .groupBy("vec_id")
        .agg(F.min(F.struct("label", "v")).alias("first"))
        .select("vec_id", "first.label", "first.v")
    )
    return scratch.save(rows.join(repeated, "vec_id", "left_anti").union(least), "single")


def matrix(column: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros, longer ones are cut at ``width``."""
    lengths = pa.compute.list_value_length(column).to_numpy()
    flat = column.flatten().to_numpy()
    width = int(lengths.max(initial=0)) if width is None else width
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = place < width
    out[owner[inside], place[inside]] = flat[inside]
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows, in the cheapest type that holds them; at most 2**63 - 1."""
    largest = [max(int(m.max(initial=0)), -int(m.min(initial=0))) for m in (left, right)]
    bound = largest[0] * largest[1] * max(1, left.shape[1])
    for most, kind in ((1 << 24, np.float32), (1 << 53, np.float64), (1 << 63, np.int64)):
        if bound < most:
            return left.astype(kind) @ right.T.astype(kind)
    exact = left.astype(object) @ right.T.astype(object)
    return np.clip(exact, 1 - (1 << 63), (1 << 63) - 1).astype(np.int64)


class Leading:
    """The first ``most`` (score, id) of every slot, by descending score, then by id."""

    def __init__(self, slots: int, most: int):
        self.most = most
        self.slot = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.id = np.empty(0, np.int64)
        #: A row with a smaller score cannot enter the slot any more.
        self.floor = np.full(slots, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot = np.concatenate([self.slot, slot])
        score = np.concatenate([self.score, score.astype(np.int64)])
        ids = np.concatenate([self.id, ids])
        order = np.lexsort((ids, ~score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.searchsorted(slot, slot)
        stay = np.arange(len(slot)) - first < self.most
        self.slot, self.score, self.id = slot[stay], score[stay], ids[stay]
        last = np.flatnonzero((np.arange(len(slot)) - first)[stay] == self.most - 1)
        self.floor[self.slot[last]] = self.score[last]


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROW_SLICE):
            yield batch.slice(start, ROW_SLICE)


def positive_scores(rows: DataFrame, block) -> DataFrame:
    """anchor, score, id: of every task the first rows with the label of the anchor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors = block.value
        best = Leading(len(ids), POSITIVES)
        by_label = {int(k): np.flatnonzero(labels == k) for k in np.unique(labels)}
        for batch in slices(batches):
            own, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            body = matrix(batch.column(2), vectors.shape[1])
            for kind in np.unique(kinds):
                here = np.flatnonzero(kinds == kind)
                every = by_label.get(int(kind), np.empty(0, np.int64))
                for start in range(0, len(every), ANCHOR_SLICE):
                    some = every[start : start + ANCHOR_SLICE]
                    scores = products(vectors[some], body[here])
                    hit = scores >= best.floor[some][:, None]
                    hit &= ids[some][:, None] != own[here][None, :]
                    a, b = np.nonzero(hit)
                    best.add(some[a], scores[a, b], own[here[b]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[best.slot]), pa.array(best.score), pa.array(best.id)],
            names=["anchor", "score", "id"],
        )

    return rows.mapInArrow(lean(run), "anchor bigint, score bigint, id bigint")


def packed(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, kind: int) -> pa.RecordBatch:
    """Keys whose byte order is anchor, descending score, ``kind``, id."""
    out = np.empty((len(anchor), KEY.size), np.uint8)
    for start, values in (
        (0, anchor.astype(np.uint64) ^ FLIP),
        (8, ~(score.astype(np.uint64) ^ FLIP)),
        (17, ids.astype(np.uint64) ^ FLIP),
    ):
        out[:, start : start + 8] = values.astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 16] = kind
    whole = pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(KEY.size), len(out), [None, pa.py_buffer(out.tobytes())]
    )
    return pa.RecordBatch.from_arrays([whole.cast(pa.binary())], names=["key"])


def positive_keys(positives: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield packed(*[batch.column(i).to_numpy() for i in range(3)], kind=0)

    return positives.select("anchor", "score", "id").mapInArrow(lean(run), "key binary")


def negative_keys(rows: DataFrame, block, highest) -> DataFrame:
    """Of every task the first rows of other labels in every window of every anchor, as keys.

    ``highest`` has the score of every positive, one row per anchor; -1 stands for none, as for a
    negative score, whose window is empty.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors = block.value
        high = highest.value
        low = high - high * (100 - PERCENT) // 100  # the smallest whole number of that share
        best = [Leading(len(ids), NEGATIVES) for _ in range(POSITIVES)]
        for batch in slices(batches):
            own, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            body = matrix(batch.column(2), vectors.shape[1])
            for start in range(0, len(ids), ANCHOR_SLICE):
                some = np.arange(start, min(start + ANCHOR_SLICE, len(ids)))
                scores = products(vectors[some], body)
                other = labels[some][:, None] != kinds[None, :]
                for w in range(POSITIVES):
                    open_from = np.maximum(low[some, w], best[w].floor[some])
                    open_from[high[some, w] < 0] = np.iinfo(np.int64).max
                    hit = (scores >= open_from[:, None]) & (scores <= high[some, w][:, None])
                    a, b = np.nonzero(hit & other)
                    if len(a):
                        best[w].add(some[a], scores[a, b], own[b])
        found = np.unique(
            np.concatenate([np.stack([w.slot, w.score, w.id]) for w in best], axis=1), axis=1
        )
        yield packed(ids[found[0]], found[1], found[2], kind=1)

    return rows.mapInArrow(lean(run), "key binary")


def windows(keys: Iterable[tuple[bytes, None]]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """The negatives of every positive, from keys in order; holds the open windows of one anchor."""
    at, opened = None, []
    for key, _ in keys:
        parts = KEY.unpack(key)
        anchor, row = parts[0] - (1 << 63), parts[3] - (1 << 63)
        score = (1 << 63) - 1 - parts[1]
        if anchor != at:
            at, opened = anchor, []
        if parts[2] == 0:
            opened.append([row, score, 0])
            continue
        opened = [w for w in opened if w[2] < NEGATIVES and PERCENT * w[1] <= 100 * score]
        for window in opened:
            window[2] += 1
            yield anchor, window[0], window[2], row, window[1], score


def hard_negatives(
    embeddings: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null id, label or vector, or a null or non-finite component take no part. Where an id
    is divisible by 7 the label is shifted first. Components become floor(256 * x); scores are inner
    products of these, those of an anchor (id divisible by 100) rank by score, then by id. Its positives
    are the first 5 other rows of its label; each is returned with the first 5 rows of other labels whose
    score is 80 % to 100 % of its own. A positive without such rows, or with a negative score, has no
    row. Of rows that repeat an id, the one with the smallest label and vector takes part. Vectors of
    different lengths are compared over the places that both have; scores end at +-(2**63 - 1). An empty
    table gives an empty table; other columns are not looked at.
    """
    spark = scratch.spark
    rows = one_row_per_id(scratch.save(prepared(embeddings), "rows"), scratch)
    anchors = rows.where(F.col("vec_id") % ANCHOR_EVERY == 0)
    size = anchors.agg(F.coalesce(F.sum(8 * F.size("v") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    path = f"{scratch.root}/found"
    spark.createDataFrame([], RESULT).write.parquet(path)
    for number in range(blocks):
        mine = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number
        own = anchors.where(mine).toArrow().combine_chunks()  # about block_bytes
        if not own.num_rows:
            continue
        ids = own.column("vec_id").to_numpy()
        vectors = matrix(pa.chunked_array(own.column("v")).combine_chunks())
        block = spark.sparkContext.broadcast((ids, own.column("label").to_numpy(), vectors))
        place = Window.partitionBy("anchor").orderBy(F.col("score").desc(), F.col("id").asc())
        positives = scratch.save(
            positive_scores(rows, block)
            .withColumn("place", F.row_number().over(place))
            .where(F.col("place") <= POSITIVES),
            f"positives-{number}",
        )
        high = np.full((len(ids), POSITIVES), -1, np.int64)
        told = positives.select("anchor", "place", "score").toArrow()  # 5 rows an anchor of the block
        order = np.argsort(ids)
        at = order[np.searchsorted(ids[order], told.column("anchor").to_numpy())]
        high[at, told.column("place").to_numpy() - 1] = told.column("score").to_numpy()
        keys = negative_keys(rows, block, spark.sparkContext.broadcast(np.maximum(high, -1)))
        pairs = keys.union(positive_keys(positives)).rdd.map(lambda row: (bytes(row[0]), None))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = pairs.repartitionAndSortWithinPartitions(
            parts, partitionFunc=lambda key: zlib.crc32(key[:8])
        )
        mined = spark.createDataFrame(dealt.mapPartitions(windows), RESULT, verifySchema=False)
        mined.write.mode("append").parquet(path)
        block.unpersist()
    return spark.read.schema(RESULT).parquet(path)
