"""Shared helpers of the corpus operators: tables, intermediate Parquet, bounded broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidgrid.session import checkpoint_dir

#: Rows of a key-only table that may be broadcast; a larger table takes a shuffle join.
BROADCAST_ROWS = 1_000_000
#: Bytes and rows of an Arrow batch: JVM and Python worker hold whole batches of texts.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2_000
#: Bytes of text that a task turns into Python objects at once; a longer single text stands alone.
SLICE_BYTES = 2 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def field(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, so that they need no installation of it; once a session.

    Arrow batches of the session are bounded too: by default they are bounded by rows alone.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    name = f"{package.name}-{context.applicationId}.zip"
    if any(listed.endswith(name) for listed in context.listFiles):
        return
    archive = Path(tempfile.mkdtemp(prefix="package-")) / name
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(package.rglob("*.py")):
            packed.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))


class Scratch:
    """Intermediate Parquet tables of one run, in the folder that all executors share.

    A written table cuts the lineage, survives the loss of executors and is read by columns.
    ``release`` empties a table that no later step reads.
    """

    def __init__(self, spark: SparkSession):
        ship_package(spark)
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/llm/{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, **options: int) -> DataFrame:
        """Write ``df``, with ``options`` of the Parquet writer, and read it again."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self, *names: str) -> None:
        for name in names:
            path = f"{self.root}/{name}"
            schema = self.spark.read.parquet(path).schema
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def join_keys(
    rows: DataFrame, keys: DataFrame, on: str | list[str] | Column, how: str, most: int = BROADCAST_ROWS
) -> DataFrame:
    """Join a written, narrow ``keys`` table: broadcast up to ``most`` rows, else by shuffle."""
    small = keys.count() <= most
    return rows.join(F.broadcast(keys) if small else keys, on, how)


def drop_rows(docs: DataFrame, keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without the rows named by the written table ``keys``: id, mark (hash of the text).

    A null id is equal to a null id. The columns of ``docs`` stay as they are.
    """
    taken = {name.lower() for name in docs.columns}
    own_id, own_mark = "key_id", "key_mark"
    while own_id in taken or own_mark in taken:
        own_id, own_mark = f"_{own_id}", f"_{own_mark}"
    named = keys.select(F.col("id").alias(own_id), F.col("mark").alias(own_mark))
    same = field("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (
        F.xxhash64("text") == F.col(own_mark)
    )
    return join_keys(docs, named, same, "left_anti", most)


def byte_table(keep: Iterable[int]) -> bytes:
    """Translation that lower-cases A-Z and blanks every byte outside ``keep``."""
    kept = set(keep)
    lowered = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return bytes(b if b in kept else 32 for b in lowered)


def text_slices(
    batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut batches into runs of rows with about ``most`` bytes of text, texts as UTF-8 bytes.

    Null texts are empty. A single longer text is a slice of its own; no text is cut.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            part = texts.slice(start, stop - start).to_pylist()
            yield batch.slice(start, stop - start), [t or b"" for t in part]
            start = stop


def lean(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; gives the freed memory of a finished task back to the system.

    Spark keeps Python workers for later tasks, and the allocators keep what they once had.
    """

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, scratch: Scratch
) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` documents of each label 0 and 1, written.

    The documents come first in the order of a hash of their id, so a sample does not depend on how
    the tables are laid out. Null labels and ids are left out; of several labels the largest holds;
    of rows that repeat an id one is taken.
    """
    known = (
        labels.where(f"{label} IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.max(label) > 0).cast("int").alias("label"))
    )
    chosen = None
    for value in (0, 1):
        part = (
            known.where(F.col("label") == value)
            .orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(per_class)
        )
        chosen = part if chosen is None else chosen.union(part)
    picked = scratch.save(chosen, f"{label}-ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(picked), "doc_id"
    )
    return scratch.save(rows.dropDuplicates(["doc_id"]), f"{label}-sample")


class Adam:
    """Adam steps over a list of parameter arrays, changed in place."""

    def __init__(self, parameters: list[np.ndarray], rate: float):
        self.parameters, self.rate, self.turn = parameters, rate, 0
        self.first = [np.zeros_like(p) for p in parameters]
        self.second = [np.zeros_like(p) for p in parameters]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.turn += 1
        for p, g, m, v in zip(self.parameters, gradients, self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            scale = np.sqrt(v / (1 - 0.999**self.turn)) + 1e-8
            p -= self.rate * (m / (1 - 0.9**self.turn)) / scale


def sigmoid(values: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * values))
