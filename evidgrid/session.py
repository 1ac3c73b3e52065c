"""Session helpers: settings every job here relies on, and where lineage may be cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Session setting: partitions that a table with long texts is dealt to when it is read. Unset, the
#: splits of the files stay as they are.
READ_CONF = "evidgrid.read.partitions"


def build_session(app_name: str = "evidgrid", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC time and adaptive execution; everything else is the cluster's choice."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Checkpoint files go when nothing refers to them any more.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster.

    Only a local-mode session may fall back to a temporary folder: on a cluster an executor-local
    path would not survive the loss of its machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF)
    current = context.getCheckpointDir()
    if configured:
        if not current:
            context.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not (context.master or "").startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from the written copy."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_lineage_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut_lineage`` that also returns the number of rows, counted while they are written."""
    seen = Observation()
    written = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return written, int(seen.get["rows"])


class Tables:
    """Tables of the rounds of a loop, as Parquet in the shared folder.

    A checkpoint hands the size that Spark has guessed on to the next plan, and a join multiplies its
    inputs' sizes: over the rounds of a loop the guess gets so many digits that planning never ends. A
    written table has the size of its files.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self, *names: str) -> None:
        """Empty tables that no later step reads."""
        for name in names:
            path = f"{self.root}/{name}"
            schema = self.spark.read.parquet(path).schema
            # Nothing to compute: rows made by the driver would start Python in every task.
            columns = [F.lit(None).cast(field.dataType).alias(field.name) for field in schema]
            self.spark.range(0).select(*columns).write.mode("overwrite").parquet(path)
