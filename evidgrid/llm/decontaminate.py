"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` cuts the texts into segments of a few MB. A segment holds, for every term, the
sorted list of its positions, and it is stored as one row of a Parquet table in the shared folder;
a longer text is a segment of its own. Row groups of that table hold few segments, as a task reads a
whole one into memory. ``search`` reads the index once per block of test windows.
Inside a segment the position lists of a window are intersected from the rarest term on, each list
shifted by the place of its term: what is left after the last term are the exact phrase matches.
With ``slop`` a term may stand that many words off its place (proximity match).

No step shuffles texts or postings, so frequent terms and groups of copies meet in no single task.
Test windows are sent to the tasks in blocks of at most ``BLOCK_WORDS`` words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidgrid.llm.common import Scratch, byte_table, drop_rows, lean, text_slices

WINDOW = 13
#: Item words that are broadcast together; more items make more blocks.
BLOCK_WORDS = 200_000
#: Row groups of the index: at most 4 segments, and no further one after 8 MB. By default a writer looks
#: at the size only every 100 rows, and a reader takes up to 4,096 rows of a row group at once.
ROW_GROUPS = {
    "parquet.block.row.count.limit": 4,
    "parquet.block.size": 8 << 20,
    "parquet.page.size.row.check.min": 1,
}
#: Letters, digits and every byte of a character beyond ASCII.
WORD_BYTES = byte_table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
INDEX_SCHEMA = (
    "segment string, doc_ids array<bigint>, marks array<bigint>, n_words array<int>, "
    "terms array<binary>, counts array<int>, positions array<int>"
)
MATCH_SCHEMA = (
    "segment string, place int, doc_id bigint, mark bigint, n_words bigint, "
    "runs array<struct<start:int,end:int>>, items array<string>"
)


def words(text: bytes) -> list[bytes]:
    """Words of a text after lower-casing A-Z."""
    return text.translate(WORD_BYTES).split()


def build_index(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Positional index of every document, stored; one row per segment.

    A null text has no words; null and repeated ids are kept as they are. Positions count the words
    of a segment with one empty place between documents, so that no phrase crosses a border.
    """
    arrow = pa.schema(
        [
            ("segment", pa.string()),
            ("doc_ids", pa.list_(pa.int64())),
            ("marks", pa.list_(pa.int64())),
            ("n_words", pa.list_(pa.int32())),
            ("terms", pa.list_(pa.binary())),
            ("counts", pa.list_(pa.int32())),
            ("positions", pa.list_(pa.int32())),
        ]
    )

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, (batch, texts) in enumerate(text_slices(batches, "text")):
            split = [words(text) for text in texts]
            lengths = np.array([len(ws) for ws in split], np.int32)
            codes: dict[bytes, int] = {}
            code = codes.setdefault
            ids = np.fromiter(
                (code(w, len(codes)) for ws in split for w in ws), np.int32, int(lengths.sum())
            )
            at = np.arange(len(ids), dtype=np.int32) + np.repeat(
                np.arange(len(lengths), dtype=np.int32), lengths
            )
            order = np.argsort(ids, kind="stable")
            row = [
                [f"{task}-{number}"],
                [batch.column(0).to_pylist()],
                [batch.column(1).to_pylist()],
                [lengths],
                [list(codes)],
                [np.bincount(ids, minlength=len(codes)).astype(np.int32)],
                [at[order]],
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow
            )

    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text"
    )
    return scratch.save(narrow.mapInArrow(lean(build), INDEX_SCHEMA), "index", **ROW_GROUPS)


class Windows:
    """A block of test windows as arrays: one group per window length."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], size: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, tuple[list[list[int]], list[int]]] = {}
        self.names: list[str | None] = []
        for name, text in items:
            ids = [
                self.vocabulary.setdefault(w, len(self.vocabulary))
                for w in words((text or "").encode())
            ]
            if not ids:
                continue
            self.names.append(name)
            length = min(size, len(ids))
            rows, owners = by_length.setdefault(length, ([], []))
            for i in range(len(ids) - length + 1):
                rows.append(ids[i : i + length])
                owners.append(len(self.names) - 1)
        self.groups = [
            (length, np.array(rows, np.int32), np.array(owners, np.int32))
            for length, (rows, owners) in sorted(by_length.items())
        ]


def matches(
    windows: Windows,
    terms: list[bytes],
    counts: np.ndarray,
    positions: np.ndarray,
    slop: int = 0,
) -> Iterator[tuple[int, int, np.ndarray]]:
    """(item, window length, first positions) of the windows that occur in a segment."""
    if not windows.vocabulary:
        return
    starts = np.concatenate(([0], np.cumsum(counts)))
    found = np.zeros(len(windows.vocabulary), np.int64)
    start = np.zeros(len(windows.vocabulary), np.int64)
    known = windows.vocabulary
    for i, term in enumerate(terms):
        v = known.get(term)
        if v is not None:
            found[v], start[v] = counts[i], starts[i]
    for length, rows, owners in windows.groups:
        sizes = found[rows]
        for w in np.flatnonzero(sizes.min(axis=1) > 0):
            candidates = None
            for place in np.argsort(sizes[w], kind="stable"):
                v = rows[w, place]
                listed = positions[start[v] : start[v] + found[v]]
                if candidates is None:
                    candidates = listed - place
                    if slop:
                        shifts = np.arange(-slop, slop + 1, dtype=candidates.dtype)
                        candidates = np.unique((candidates[:, None] + shifts).ravel())
                else:
                    wanted = candidates + place
                    near = np.searchsorted(listed, wanted - slop)
                    inside = near < len(listed)
                    hit = np.zeros(len(wanted), bool)
                    hit[inside] = listed[near[inside]] <= wanted[inside] + slop
                    candidates = candidates[hit]
                if not len(candidates):
                    break
            else:
                yield int(owners[w]), length, candidates


def search_block(windows: Windows, slop: int) -> Callable:
    """Arrow function: hit runs and items of every document of the segments it reads."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)

                def values(name: str, one: pa.RecordBatch = one) -> pa.Array:
                    return one.column(one.schema.get_field_index(name)).flatten()

                lengths = values("n_words").to_numpy()
                docs = len(lengths)
                first = np.concatenate(([0], np.cumsum(lengths.astype(np.int64) + 1)))
                cover = np.zeros(int(first[-1]) + 1, np.int64)
                items: dict[int, set[str]] = {}
                for item, length, at in matches(
                    windows,
                    values("terms").to_pylist(),
                    values("counts").to_numpy(),
                    values("positions").to_numpy(),
                    slop,
                ):
                    owner = np.searchsorted(first, np.maximum(at, 0), side="right") - 1
                    begin = np.maximum(at, first[owner])  # a proximity match may overhang
                    end = np.minimum(at + length, first[owner] + lengths[owner])
                    np.add.at(cover, begin, 1)
                    np.add.at(cover, np.maximum(end, begin), -1)
                    name = windows.names[item]
                    for doc in np.unique(owner):
                        items.setdefault(int(doc), set()).update(() if name is None else (name,))
                hit = np.concatenate(([0], (np.cumsum(cover) > 0).astype(np.int8), [0]))
                edges = np.diff(hit)
                begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
                owner = np.searchsorted(first, begins, side="right") - 1
                runs: dict[int, list[dict]] = {}
                for doc, b, e in zip(owner, begins, ends, strict=True):
                    base = int(first[doc])
                    runs.setdefault(int(doc), []).append(
                        {"start": int(b) - base, "end": int(e) - base}
                    )
                yield pa.RecordBatch.from_pydict(
                    {
                        "segment": [one.column(0)[0].as_py()] * docs,
                        "place": pa.array(range(docs), pa.int32()),
                        "doc_id": values("doc_ids"),
                        "mark": values("marks"),
                        "n_words": pa.array(lengths.astype(np.int64)),
                        "runs": pa.array(
                            [runs.get(d, []) for d in range(docs)],
                            pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
                        ),
                        "items": pa.array(
                            [sorted(items.get(d, ())) for d in range(docs)], pa.list_(pa.string())
                        ),
                    }
                )

    return search


def search(
    index: DataFrame,
    benchmark: DataFrame,
    scratch: Scratch,
    slop: int = 0,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per indexed document: hit word runs and the items with windows that occur in it.

    ``benchmark`` has item_id and text. It is read in blocks of whole items, each of at most
    ``block_words`` words by an upper bound on the length, or one longer item; an index segment is
    compared with one block at a time. Items without words have no window. An item without an id
    marks words but is not listed; items of one id count once.
    """
    sized = scratch.save(
        benchmark.select(
            F.col("item_id").cast("string").alias("item"),
            "text",
            # A word and the gap after it take two bytes at least.
            (F.octet_length(F.coalesce("text", F.lit(""))) / 2 + 1).cast("long").alias("most"),
        ),
        "items",
    )
    total = sized.agg(F.coalesce(F.sum("most"), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // block_words))
    numbered = sized.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    context = index.sparkSession.sparkContext
    parts = []
    for block in range(blocks):
        rows = numbered.where(F.col("block") == block).select("item", "text").collect()
        shared = context.broadcast(Windows((row.item, row.text) for row in rows))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from search_block(shared.value, slop)(batches)

        parts.append(index.mapInArrow(lean(run), MATCH_SCHEMA))
    if len(parts) == 1:
        return parts[0].drop("segment", "place")
    matched = parts[0]
    for part in parts[1:]:
        matched = matched.unionByName(part)
    # One row per document and block; the runs of different blocks may overlap.
    merged = matched.groupBy("segment", "place").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("mark").alias("mark"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return merged.drop("segment", "place")


def contamination(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per document: doc_id, mark (hash of the text), n_words, n_hit, n_items, items,
    contaminated.

    Contaminated: at least one word is hit and at least every twentieth.
    """
    found = search(build_index(docs, scratch), benchmark, scratch)
    covered = F.aggregate(
        "runs",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total")),
        lambda acc, run: F.struct(
            F.greatest(acc["end"], run["end"]).alias("end"),
            (
                acc["total"]
                + F.greatest(F.lit(0), run["end"] - F.greatest(acc["end"], run["start"]))
            ).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    counted = found.withColumn("n_hit", covered)
    return counted.select(
        "doc_id",
        "mark",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    found = contamination(docs, benchmark, scratch).where("contaminated")
    gone = found.select(F.col("doc_id").alias("id"), "mark").distinct()
    return drop_rows(docs, scratch.save(gone, "gone"))
