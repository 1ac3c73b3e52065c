"""Corpus pipeline: the stages that turn the table ``documents`` into encoded training text.

Each stage is written as Parquet in the shared folder and read again by the next one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidgrid.llm import decontaminate, toxicity
from evidgrid.llm.byte_bpe import round_trip
from evidgrid.llm.common import Scratch, table
from evidgrid.llm.exact_dedup import exact_dedup
from evidgrid.llm.jaccard_join import one_of_each

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Vocabulary of the last stage.
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose most likely severity grade is 0."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), Scratch(spark))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after A-Z lower-casing, the row with the largest doc_id stays."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar shingle sets: the one with the smallest doc_id."""
    return one_of_each(docs, Scratch(spark))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth stand in windows of benchmark items."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), Scratch(spark))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to."""
    coded = round_trip(docs, VOCABULARY, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: The toxicity model has no SQL form; tests compare the rows that stay with planted documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for position, (name, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if position == len(STAGES) - 1:
            return result
        docs = scratch.save(result, name)
        if position:
            scratch.release(STAGES[position - 1][0])
    return docs
