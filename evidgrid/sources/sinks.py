"""Document and archive scans, logs, blob stores and counts-only reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidgrid.functions.identity import content_sha
from evidgrid.functions.text import line_count, scope_paths, split_frontmatter, utf8_bytes
from evidgrid.operators.runs import corrupt_blobs, new_blobs, valid_marker
from evidgrid.operators.skew import beside


def scan_documents(spark: SparkSession, path: str | list[str], glob: str = "*.md") -> DataFrame:
    """Whole files: doc, content, bytes, sha256, utf8 flag, front matter, body, scope paths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    decoded = files.select(
        F.regexp_replace("path", "^file:/+", "/").alias("doc"),
        F.col("content").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("content"),
    )
    parts = split_frontmatter("content")
    return decoded.select(
        "doc",
        "content",
        "bytes",
        "sha256",
        F.col("content").isNotNull().alias("utf8"),
        F.lit(True).alias("existed"),
        parts["frontmatter"].alias("frontmatter"),
        parts["body"].alias("body"),
        scope_paths("content").alias("scope_paths"),
    )


def document_facts(documents: DataFrame) -> DataFrame:
    """Counts and hashes per document, no text."""
    return documents.select(
        "doc",
        content_sha("content").alias("sha256"),
        utf8_bytes("content").alias("bytes"),
        line_count("content").alias("lines"),
        (split_frontmatter("content")["frontmatter"] != "").alias("frontmatter"),
    )


def write_inspection_report(
    path: str, documents: DataFrame, stats: DataFrame, events: DataFrame, selected: DataFrame
) -> None:
    """Counts-only report: document facts and one row of totals, as JSON."""
    document_facts(documents).write.mode("overwrite").json(f"{path}/documents")
    counts = events.agg(
        F.count("*").alias("events_total"),
        F.coalesce(F.sum(F.size("redactions")), F.lit(0)).alias("redactions"),
    )
    chosen = selected.agg(F.count("*").alias("events_selected"))
    beside(stats, counts, chosen).write.mode("overwrite").json(f"{path}/totals")


def append_log(rows: DataFrame, path: str) -> None:
    """Append JSON lines with sorted keys."""
    rows.select(*sorted(rows.columns)).write.mode("append").json(path)


def put_blobs(candidates: DataFrame, path: str) -> DataFrame:
    """Store every distinct new payload once under its hash; returns what was added."""
    spark = candidates.sparkSession
    try:
        store = spark.read.parquet(path).select("sha256")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        store = spark.createDataFrame([], "sha256 string")
    fresh = new_blobs(candidates, store)
    fresh.write.mode("append").parquet(path)
    return fresh.select("sha256")


def verify_blobs(spark: SparkSession, path: str) -> DataFrame:
    """Hashes under which a different payload is stored."""
    return corrupt_blobs(spark.read.parquet(path))


def scan_runs(spark: SparkSession, path: str, name: str = "plan.json") -> DataFrame:
    """Plans of all run folders (run_id, plan VARIANT); folders without a valid plan are left out.

    A folder is named by its run, or by a column and its run (``run_id=...``) as Spark writes it.
    """
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    files = spark.read.text(f"{path}/*/{name}", wholetext=True).select(
        F.regexp_replace(folder, "^[^=]*=", "").alias("run_id"),
        F.try_parse_json("value").alias("plan"),
    )
    is_object = F.coalesce(F.schema_of_variant("plan").startswith("OBJECT"), F.lit(False))
    return files.where(is_object & F.col("run_id").rlike(r"^\d{8}T\d{6}Z-[0-9a-f]{8}$"))


MARKER_FIELDS = {
    "parent_run_id": "parent_run_id",
    "parent_sha256": "parent_plan_sha256",
    "request_id": "request_id",
    "conflict_fingerprint": "conflict_fingerprint",
    "successor_run_id": "successor_run_id",
    "successor_sha256": "successor_plan_sha256",
    "response_sha256": "response_sha256",
}


def scan_tombstones(spark: SparkSession, path: str) -> DataFrame:
    """Resolution markers of purged runs, one file each in any depth; a malformed one fails the job."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    files = reader.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("v")
    )
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    marker = F.try_variant_get("v", "$.decision_resolution", "variant")
    fields = [
        F.try_variant_get(marker, f"$.{source}", "string").alias(name)
        for name, source in MARKER_FIELDS.items()
    ]
    has_marker = marker.isNotNull() & (F.schema_of_variant(marker) != "VOID")
    read = files.select("file", is_object.alias("_object"), F.coalesce(has_marker, F.lit(False)).alias("_marked"), *fields)
    sound = F.col("_object") & (~F.col("_marked") | valid_marker())
    failed = F.raise_error(F.concat(F.lit("malformed run tombstone: "), "file")).cast("boolean")
    return read.where(F.when(sound, F.col("_marked")).otherwise(failed)).drop("_object", "_marked")
