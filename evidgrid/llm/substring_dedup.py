"""Substring deduplication: windows of words that already start in an earlier document are removed.

Every window of ``WINDOW`` words gets a Rabin-Karp hash, for all starts at once from running sums.
Windows are grouped in Spark by (anchor, hash). The anchor of a window is the smallest hash of the
shorter word runs in it, which equal windows share; consecutive windows mostly share it too, so
there are about 13 times fewer anchors than windows. Anchors that occur in one document only are
counted out first: their windows cannot repeat. Windows of the others are then grouped by (anchor,
hash) with the smallest document id of each group, and the removed ones merge into maximal
intervals.

Word sequences that are equal as a whole are found first, by their SHA-256: of them only the
document with the smallest id sends its windows, the others are covered from end to end. Texts
travel only for documents with shared anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidgrid.llm.common import Scratch, join_keys, lean, text_slices
from evidgrid.llm.rolling import BASE_WINDOW, Hasher, inside, signed

WINDOW = 50
KEY = ["doc_id", "mark"]


def profile(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, mark (hash of the text), n_words, SHA-256 of the words, distinct anchors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch, texts in text_slices(batches, "text"):
            split = [text.split() for text in texts]
            lengths = np.array([len(ws) for ws in split], np.int64)
            starts, owner = inside(lengths, size)
            values = hasher.anchors(hasher.words(split), size)
            picked = values[starts] if len(starts) else np.empty(0, np.uint64)
            # Equal neighbours are one occurrence.
            change = np.ones(len(picked), bool)
            change[1:] = (picked[1:] != picked[:-1]) | (owner[1:] != owner[:-1])
            counts = np.bincount(owner[change], minlength=len(texts))
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(lengths),
                    pa.array([hashlib.sha256(b" ".join(ws)).hexdigest() for ws in split]),
                    pa.ListArray.from_arrays(offsets, pa.array(signed(picked[change]))),
                ],
                names=["doc_id", "mark", "n_words", "sha", "anchors"],
            )

    return docs.mapInArrow(
        lean(run), "doc_id bigint, mark bigint, n_words bigint, sha string, anchors array<bigint>"
    )


def shared_windows(texts: DataFrame, size: int) -> DataFrame:
    """Windows with a shared anchor; ``texts`` has doc_id, mark, text and shared (a, lowest)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch, bodies in text_slices(batches, "text"):
            split = [text.split() for text in bodies]
            words = hasher.words(split)
            lengths = np.array([len(ws) for ws in split], np.int64)
            starts, owner = inside(lengths, size)
            if not len(starts):
                continue
            anchors = signed(hasher.anchors(words, size)[starts])
            hashes = signed(hasher.rolling(words, size, BASE_WINDOW)[starts])
            shared = batch.column(batch.schema.get_field_index("shared"))
            flat = shared.flatten()
            listed = flat.field("a").to_numpy(zero_copy_only=False)
            lowest = flat.field("lowest").to_numpy(zero_copy_only=False)
            bounds = np.concatenate(
                ([0], np.cumsum(pa.compute.list_value_length(shared).to_numpy()))
            )
            first = np.cumsum(lengths) - lengths
            edges = np.searchsorted(owner, np.arange(len(bodies) + 1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            marks = batch.column(1).to_numpy(zero_copy_only=False)
            for d in range(len(bodies)):
                here = slice(edges[d], edges[d + 1])
                order = np.argsort(listed[bounds[d] : bounds[d + 1]])
                known = listed[bounds[d] : bounds[d + 1]][order]
                own = anchors[here]
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                hit = known[at] == own
                n = int(hit.sum())
                if n:
                    low = lowest[bounds[d] : bounds[d + 1]][order][at[hit]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, ids[d])),
                            pa.array(np.full(n, marks[d])),
                            pa.array((starts[here][hit] - first[d]).astype(np.int32)),
                            pa.array(own[hit]),
                            pa.array(hashes[here][hit]),
                            pa.array(low < ids[d]),
                        ],
                        names=["doc_id", "mark", "start", "a", "h", "later"],
                    )

    return texts.mapInArrow(
        lean(run), "doc_id bigint, mark bigint, start int, a bigint, h bigint, later boolean"
    )


def cut(texts: DataFrame, size: int) -> DataFrame:
    """Merge removed windows; ``texts`` has doc_id, mark, text and the window starts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch, bodies in text_slices(batches, "text"):
            starts = batch.column(batch.schema.get_field_index("starts"))
            removed, shas, intervals = [], [], []
            for i, body in enumerate(bodies):
                ws = body.split()
                cover = np.zeros(len(ws) + 1, np.int64)
                at = starts[i].values.to_numpy()
                np.add.at(cover, at, 1)
                np.add.at(cover, at + size, -1)
                gone = np.concatenate(([0], np.cumsum(cover)[:-1] > 0, [0])).astype(np.int8)
                edge = np.diff(gone)
                begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                pieces, last = [], 0
                for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
                    pieces += ws[last:b]
                    last = e
                pieces += ws[last:]
                removed.append(len(ws) - len(pieces))
                shas.append(hashlib.sha256(b" ".join(pieces)).hexdigest())
                intervals.append(
                    [
                        {"start": b, "end": e}
                        for b, e in zip(begins.tolist(), ends.tolist(), strict=True)
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(removed, pa.int64()),
                    pa.array(shas, pa.string()),
                    pa.array(intervals, kind),
                ],
                names=["doc_id", "mark", "n_removed", "kept_sha256", "removed"],
            )

    return texts.mapInArrow(
        lean(run),
        "doc_id bigint, mark bigint, n_removed bigint, kept_sha256 string, "
        "removed array<struct<start:bigint,end:bigint>>",
    )


def repeated_spans(docs: DataFrame, scratch: Scratch, size: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, removed.

    A word goes if a window over it also starts in a document with a smaller doc_id; ``removed``
    has the maximal intervals of such words (word numbers, end exclusive), judged on the input.
    Null texts have no words. A document without an id keeps all its words and takes none from
    others. Rows that repeat an id do not take words from each other. Documents with fewer words
    than a window keep all. An empty table gives an empty table; other columns are not looked at.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text"
    )
    rows = scratch.save(profile(texts, size), "profile")
    # Only texts with copies, written first: a join with a written table can be split at a hot text.
    copies = scratch.save(
        rows.groupBy("sha")
        .agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest"))
        .where("lowest < highest")
        .drop("highest"),
        "copies",
    )
    known = scratch.save(
        rows.join(copies, "sha", "left").select(
            *KEY,
            "n_words",
            "sha",
            (
                F.coalesce(F.col("lowest") < F.col("doc_id"), F.lit(False))
                & (F.col("n_words") >= size)
            ).alias("copy"),
            "anchors",
        ),
        "known",
    )
    scratch.release("profile", "copies")
    spots = known.where("NOT copy AND doc_id IS NOT NULL").select(
        F.explode("anchors").alias("a"), *KEY
    )
    shared = (
        spots.groupBy("a")
        .agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest"))
        .where("lowest < highest")
        .drop("highest")
    )
    candidates = scratch.save(
        spots.join(shared, "a")
        .groupBy(*KEY)
        .agg(F.collect_list(F.struct("a", "lowest")).alias("shared")),
        "candidates",
    )
    chosen = join_keys(texts, candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    windows = scratch.save(
        shared_windows(chosen.join(candidates, KEY).select(*KEY, "text", "shared"), size),
        "windows",
    )
    scratch.release("candidates")
    # Counted with map-side sums and written: the join back can then split a window that very many
    # documents share, which it could not in one stage with the sums.
    earliest = scratch.save(
        windows.groupBy("a", "h")
        .agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"))
        .where("earliest < latest")
        .drop("latest"),
        "earliest",
    )
    removed = scratch.save(
        windows.where("later")
        .join(earliest, ["a", "h"])
        .where("earliest < doc_id")
        .select(*KEY, "start"),
        "removed",
    )
    gone = scratch.save(
        removed.groupBy(*KEY)
        .agg(F.collect_set("start").alias("starts")),
        "gone",
    )
    scratch.release("windows", "earliest", "removed")
    touched = join_keys(texts, gone.select("doc_id").distinct(), "doc_id", "left_semi")
    changed = scratch.save(
        cut(touched.join(gone, KEY).select(*KEY, "text", "starts"), size), "changed"
    )
    # Repeated rows have one entry each in ``changed``; a result row needs one only.
    changed = changed.dropDuplicates(KEY)
    result = known.drop("anchors").join(changed, KEY, "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return result.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words"))
        .otherwise(F.coalesce("n_removed", F.lit(0)))
        .alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit("").cast("binary"), 256))
        .otherwise(F.coalesce("kept_sha256", "sha"))
        .alias("kept_sha256"),
        F.when(F.col("copy"), whole).otherwise(F.coalesce("removed", none)).alias("removed"),
    )
