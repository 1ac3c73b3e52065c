"""The pipeline on a small corpus with planted cases, stage by stage."""

import corpus_pipeline as pipeline
import pyarrow.parquet as pq
import pytest
from helpers import corpus, edited, sentence
from pyspark.sql import functions as F
from test_models import rude

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, mark string"
ITEM = sentence(7_777, 40)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    texts = [(i, t) for i, t in corpus() if i is not None and i < 40 or i == 50]
    texts += [(1_000 + i, rude(i, 0 if i % 4 else 6)) for i in range(300)]
    texts += [(2_000, sentence(9_90, 80)), (2_001, sentence(9_90, 80).upper())]
    texts += [(2_002, edited(sentence(9_90, 80), [40])), (2_003, sentence(9_91, 60_000))]
    texts += [(3_000, f"{ITEM} {sentence(9_92, 300)}"), (3_001, f"{ITEM} {sentence(9_93, 900)}")]
    rows = [(i, t, "en", "s", len(t or ""), "?") for i, t in texts]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{root}/documents.parquet")
    labels = [(1_000 + i, 1, int(i % 4 == 0)) for i in range(200)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(
        f"{root}/labels.parquet"
    )
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(
        f"{root}/benchmark.parquet"
    )
    return root


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, ids = {}, {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        ids[name] = set(kept[name])
        if name != "byte_bpe":
            assert docs.columns == before.columns
    toxic = {1_000 + i for i in range(0, 300, 4)}
    everything = {r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(ids["toxicity"] & toxic) <= 2 and everything - toxic <= ids["toxicity"]
    # Of equal texts the largest id stays; a repeated row stays once.
    gone = {10, 30, 31, 2_000, 33, 35} & (everything - ids["exact_dedup"])
    assert {10, 2_000, 30} <= gone and kept["exact_dedup"].count(50) == 1
    assert {11, 2_001, 31} <= ids["exact_dedup"]
    near = ids["exact_dedup"] - ids["ngram_jaccard_join"]
    assert {12, 13, 2_002} <= near and {11, 14, 2_001} <= ids["ngram_jaccard_join"] | near
    assert ids["ngram_jaccard_join"] - ids["decontamination"] == {3_000}
    assert kept["byte_bpe"].__len__() == len(kept["decontamination"])
    coded = {r.doc_id: r for r in docs.collect()}
    assert coded[2_003].n_tokens == len(coded[2_003].ids) > 60_000


def test_run_gives_the_last_stage(spark, folder):
    out = pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert out.count() > 200


def test_stage_reads_few_segments_at_once(spark, folder, monkeypatch):
    scratch = pipeline.Scratch(spark)
    monkeypatch.setattr(pipeline, "Scratch", lambda spark: scratch)
    long = F.concat(F.repeat(F.when(F.col("id") >= 0, "ab cd ef "), 230_000), F.col("id"))
    item = F.when(F.col("id") == 6, ITEM).otherwise(long)
    docs = spark.range(7, numPartitions=1).select(F.col("id").alias("doc_id"), item.alias("text"))
    kept = pipeline.drop_contaminated(spark, docs, folder)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == list(range(6))
    paths = spark.read.parquet(f"{scratch.root}/index").inputFiles()
    files = [pq.ParquetFile(path.removeprefix("file:")) for path in paths]
    groups = [f.metadata.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert sum(groups) >= 6 and max(groups) <= 4
