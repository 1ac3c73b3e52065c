"""JSON-lines scan that keeps every line and says which ones are unusable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidgrid import lexicon as lx


def parse_lines(lines: DataFrame, max_line_bytes: int = lx.MAX_LINE_BYTES) -> DataFrame:
    """Add ``size``, ``rec`` (VARIANT) and ``malformed`` to rows with a ``value`` line."""
    size = (F.octet_length("value") + 1).cast("long")
    usable = (size <= max_line_bytes) & F.is_valid_utf8("value")
    rec = F.when(usable, F.try_parse_json("value"))
    parsed = lines.withColumn("size", size).withColumn("rec", rec)
    is_object = F.coalesce(F.schema_of_variant("rec").startswith("OBJECT"), F.lit(False))
    return parsed.withColumn("malformed", ~is_object).withColumn(
        "rec", F.when(is_object, F.col("rec"))
    )


def _number_lines(lines: DataFrame) -> DataFrame:
    """Line numbers per file: position inside a split plus the lines of the splits before it."""
    marked = lines.withColumn("_id", F.monotonically_increasing_id())
    by_file = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        marked.groupBy("file", "split")
        .agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(by_file), F.lit(0)))
        .select("file", "split", "_first", "_before")
    )
    joined = marked.join(splits, ["file", "split"])
    number = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return joined.withColumn("line_no", number.cast("long")).drop("_id", "_first", "_before")


def scan_jsonl(
    spark: SparkSession,
    path: str | list[str],
    max_line_bytes: int = lx.MAX_LINE_BYTES,
    numbered: bool = True,
) -> DataFrame:
    """Lines of JSONL files: file, line_no, mtime, size, rec, malformed.

    ``numbered=False`` skips the line numbers (and the extra count over the files they need); the
    locator then is the split with the hash of the line.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_modification_time").alias("mtime"),
    )
    lines = _number_lines(lines) if numbered else lines.withColumn("line_no", F.xxhash64("value"))
    return parse_lines(lines, max_line_bytes).select(
        "file", "line_no", "mtime", "size", "rec", "malformed"
    )


def newest_files(spark: SparkSession, path: str, limit: int, suffix: str = ".jsonl") -> DataFrame:
    """The ``limit`` most recently changed files below ``path``, from listing data only."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{suffix}")
        .load(path)
        .select(F.col("path").alias("file"), "modificationTime", F.col("length").alias("bytes"))
    )
    return listing.orderBy(F.col("modificationTime").desc(), "file").limit(limit)


def field(rec: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(rec, f"$.{name}", kind)


def is_text(rec: Column, name: str) -> Column:
    """True where the field holds a JSON string (not a number that merely prints as text)."""
    return F.coalesce(
        F.schema_of_variant(F.try_variant_get(rec, f"$.{name}", "variant")) == "STRING", F.lit(False)
    )


def is_number(rec: Column, name: str) -> Column:
    shape = F.schema_of_variant(F.try_variant_get(rec, f"$.{name}", "variant"))
    return F.coalesce(shape.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))
