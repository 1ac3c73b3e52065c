"""Work on ordered or keyed data where one key may hold a large share of the rows.

* ``join_back`` attaches an aggregate to the rows it came from. Every heavy key is cut into parts by
  a salt, so it never meets in one shuffle partition; all other keys have one part.
* ``range_chunks`` / ``running_total`` / ``previous_value`` replace windows over a whole key: rows
  are range-partitioned by (key, order), each chunk is scanned on its own, and only one carry row
  per chunk boundary travels further.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidgrid.session import cut_lineage

HOT_ROWS = 100_000
CHUNK = "_chunk"


def beside(*rows: DataFrame) -> DataFrame:
    """One row with the columns of several one-row tables."""
    united = rows[0]
    for row in rows[1:]:
        united = united.unionByName(row, allowMissingColumns=True)
    return united.agg(*[F.max(name).alias(name) for name in united.columns])


def join_back(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    rows: str,
    salt: Column,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join ``lookup`` (unique by ``key``, ``rows`` = its row count) onto ``facts``.

    A key with more than ``hot_rows`` rows is cut into parts: its facts are dealt out by ``salt``
    and its lookup row is repeated for every part. This holds for every such key. The table of hot
    keys has at most one row per ``hot_rows`` facts, so it is broadcast and the facts are shuffled once.
    """
    values = [name for name in lookup.columns if name not in (key, rows)]
    parts = F.ceil(F.col(rows) / hot_rows).cast("int")
    hot = lookup.where(F.col(rows) > hot_rows).select(
        F.col(key).alias("_hot_key"), parts.alias("_parts")
    )
    dealt = F.xxhash64(salt)
    flagged = facts.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_part",
        # Rows without a key match nothing; they are spread as well.
        F.when(F.col(key).isNull(), F.pmod(dealt, F.lit(4096)))
        .when(F.col("_parts").isNotNull(), F.pmod(dealt, F.col("_parts")))
        .otherwise(F.lit(0))
        .cast("int"),
    )
    repeated = lookup.select(
        F.col(key).alias("_lookup_key"),
        F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)).alias("_lookup_part"),
        F.struct(*values).alias("_found"),
    )
    same = (F.col(key) == F.col("_lookup_key")) & (F.col("_part") == F.col("_lookup_part"))
    joined = flagged.join(repeated, same, "left")
    return joined.select(
        *[F.col(name) for name in facts.columns], *[F.col("_found")[v].alias(v) for v in values]
    )


def range_chunks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunks: int | None = None
) -> DataFrame:
    """Number even, order-preserving chunks; written once so that every reader sees the same."""
    count = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *keys, *order)
    return cut_lineage(ranged.withColumn(CHUNK, F.spark_partition_id()))


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    chunks: int | None = None,
) -> DataFrame:
    """Inclusive running sum per key in the given order.

    A chunk continues a key from the chunk before it at most once, so the carried offsets are
    fewer than the chunks and safe to broadcast.
    """
    chunked = range_chunks(df.withColumn("_value", value), keys, order, chunks)
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        chunked.groupBy(*keys, CHUNK)
        .agg(F.sum("_value").alias("_sum"))
        .withColumn("_offset", F.sum("_sum").over(earlier))
        .where(F.col("_offset").isNotNull())
        .drop("_sum")
    )
    inside = (
        Window.partitionBy(*keys, CHUNK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = chunked.withColumn("_local", F.sum("_value").over(inside))
    joined = local.join(F.broadcast(carried), [*keys, CHUNK], "left")
    return joined.select(
        *df.columns, (F.col("_local") + F.coalesce(F.col("_offset"), F.lit(0))).alias(name)
    )


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str,
    chunks: int | None = None,
) -> DataFrame:
    """Value of the preceding row of the same key, null for the first row."""
    chunked = range_chunks(df, keys, order, chunks)
    last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order))
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    carried = (
        chunked.groupBy(*keys, CHUNK)
        .agg(last.alias("_last"))
        .withColumn("_carry", F.lag("_last").over(by_chunk))
        .where(F.col("_carry").isNotNull())
        .drop("_last")
    )
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    local = chunked.withColumn("_lag", F.lag(F.struct(F.col(value).alias("v"))).over(inside))
    joined = local.join(F.broadcast(carried), [*keys, CHUNK], "left")
    return joined.select(*df.columns, F.coalesce(F.col("_lag"), F.col("_carry"))["v"].alias(name))
