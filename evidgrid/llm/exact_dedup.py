"""Exact deduplication by content sort (DataFrame functions only).

Rows are range-partitioned at sampled splitters and sorted, so that equal texts lie next to each
other; each row is compared in full with its neighbour. The sort key starts with 32 characters and
a 64-bit hash of the text, so that splitters, which travel through the driver, stay small whatever
the texts are, and a common beginning is still split. The normalised text itself follows in the
sort key and decides equality.

A hash shared by more than ``chunk_rows`` rows is cut into chunks by document id. Chunks are sorted
and compared like all others; their few run heads are then merged by SHA-256 of the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidgrid.llm.common import LOWER, UPPER, Scratch, field, join_keys

#: Rows of one hash that are sorted in one task.
CHUNK_ROWS = 1_000


def normalised(text: Column) -> Column:
    """Null as empty, A-Z lower-cased, all else unchanged."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def mark_copies(
    docs: DataFrame,
    scratch: Scratch,
    payload: list[str] | None = None,
    keep: str = "largest",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: its group of equal texts and whether it stays.

    ``keep`` names the identifier that stays, ``largest`` or ``smallest``; the SHA-256 of the
    normalised text names the group. Columns: ``row`` (struct of ``payload``, by default doc_id
    alone), ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Nulls: a null text is an empty text. A null doc_id loses against every number; a group of null
    ids alone keeps one row with keep_id null. Of rows that repeat the winning id, one is kept.
    An empty table gives an empty table. Other columns of ``docs`` are not looked at.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be largest or smallest, not {keep}")
    carried = payload or ["doc_id"]
    text = F.coalesce(F.col("text"), F.lit(""))
    # Equal after A-Z lower-casing implies equal here; this key is much cheaper to compute.
    folded = F.lower(text)
    rows = docs.select(
        F.struct(*[field(name).alias(name) for name in carried]).alias("row"),
        F.col("doc_id").alias("id"),
        text.alias("text"),
        F.substring(folded, 1, 32).alias("head"),
        F.xxhash64(folded).alias("mark"),
    )
    crowded = scratch.save(
        docs.select(F.xxhash64(folded).alias("mark"))
        .groupBy("mark")
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > chunk_rows)
        .select("mark", F.ceil(F.col("rows") / chunk_rows).alias("parts")),
        "crowded",
    )
    keyed = join_keys(rows, crowded, "mark", "left")
    split = F.col("parts").isNotNull()
    chunked = keyed.withColumn(
        "chunk", F.when(split, F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(F.lit(0))
    ).repartitionByRange("head", "mark", "chunk")

    norm = F.translate("text", UPPER, LOWER)
    drop_text = [] if "text" in carried else ["text"]
    normed = chunked.withColumn("norm", norm).drop(*drop_text)
    winner_first = (
        F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()
    )
    place = Window.partitionBy("head", "mark", "chunk")
    sorted_rows = place.orderBy("norm", winner_first)
    compared = normed.select(
        "row",
        "id",
        "head",
        "mark",
        "chunk",
        split.alias("split"),
        F.sha2("norm", 256).alias("text_sha256"),
        (~F.col("norm").eqNullSafe(F.lag("norm").over(sorted_rows))).alias("first"),
        F.row_number().over(sorted_rows).alias("at"),
    )
    runs = compared.withColumn(
        "run", F.sum(F.col("first").cast("long")).over(place.orderBy("at"))
    )
    same_run = Window.partitionBy("head", "mark", "chunk", "run")
    best = F.max("id") if keep == "largest" else F.min("id")
    local = runs.select(
        "row",
        "split",
        "text_sha256",
        "first",
        best.over(same_run).alias("run_keep"),
        F.count(F.lit(1)).over(same_run).alias("run_size"),
    )
    if not crowded.take(1):
        return local.select(
            "row",
            F.col("run_keep").alias("keep_id"),
            F.col("run_size").alias("group_size"),
            F.col("first").alias("kept"),
            "text_sha256",
        )
    # At most one head per chunk and text: merge the heads of the texts that were cut into chunks.
    stored = scratch.save(local, "runs")
    heads = stored.where("split AND first")
    pick = F.max if keep == "largest" else F.min
    merged = scratch.save(
        heads.groupBy("text_sha256").agg(
            pick("run_keep").alias("all_keep"), F.sum("run_size").alias("all_size")
        ),
        "merged",
    )
    # Rows of one id share a chunk, so a numbered winner is unique; for null ids one chunk is named.
    joined = join_keys(stored, merged, "text_sha256", "left")
    keep_id = F.when(F.col("split"), F.col("all_keep")).otherwise(F.col("run_keep"))
    return joined.select(
        "row",
        keep_id.alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"),
        (F.col("first") & F.col("run_keep").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see ``mark_copies`` for the rules."""
    marked = mark_copies(docs, Scratch(docs.sparkSession), docs.columns, keep)
    return marked.where("kept").select(
        *[F.col("row")[name].alias(name) for name in docs.columns]
    )
