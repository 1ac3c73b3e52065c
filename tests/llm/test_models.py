"""Toxicity and quality: held-out accuracy, and the rules of their tables."""

import zlib

import numpy as np
from helpers import corpus, frame, sentence

from evidgrid.llm import quality, toxicity
from evidgrid.llm.common import Scratch

RUDE = ["brulk", "brulks", "brulking", "snarf", "snarfed", "vosk"]


def rude(i: int, count: int) -> str:
    parts = sentence(i, 90).split()
    for k in range(count):
        parts[(i * 7 + k * 11) % 90] = RUDE[(i + k) % len(RUDE)]
    return " ".join(parts)


def labelled(spark, rows, name):
    return spark.createDataFrame(
        [(i, label, "?") for i, label in rows], f"doc_id bigint, {name} int, text string"
    )


def test_toxicity_on_unseen_documents(spark):
    texts = [(i, rude(i, 0 if i % 4 else 2 + i % 5)) for i in range(600)]
    docs = frame(spark, texts + [(i, t) for i, t in corpus() if i is None or i < 0])
    labels = labelled(spark, [(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (7, None)], "toxic")
    model = toxicity.train(docs, labels, Scratch(spark))
    out = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    unseen = [out[i] for i in range(400, 600)]
    right = sum(r.toxic == (r.doc_id % 4 == 0) for r in unseen)
    assert right >= 0.98 * len(unseen)
    few, many = ([r.severity for r in unseen if r.doc_id % 20 == k] for k in (0, 4))
    assert np.mean(few) < np.mean(many)  # 2 rude words, 6 rude words
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.toxic}
    assert not out[None].toxic
    assert toxicity.severity(docs.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = frame(spark, corpus())
    model = toxicity.train(docs, labelled(spark, [], "toxic"), Scratch(spark))
    assert toxicity.keep_clean(docs, model).count() == docs.count()


def test_copies_share_one_vote():
    votes = np.array([[1, 5], [1, 6], [2, 7], [3, 5]])
    assert toxicity.shares(votes).tolist() == [0.5, 0.5, 1.0, 0.5]


def junk(i: int) -> str:
    return [f"{sentence(i, 1)} " * 80, " | ".join(sentence(i, 60).split())][i % 2]


def test_quality_on_held_out_documents(spark):
    texts = [(i, junk(i) if i % 3 == 0 else sentence(i, 30 + i % 90)) for i in range(500)]
    docs = frame(spark, texts + [(9_000, None), (9_001, ""), (9_002, sentence(1, 30_000)), (None, "a b")])
    labels = labelled(spark, [(i, int(i % 3 > 0)) for i in range(500)], "quality")
    model = quality.train(docs, labels, Scratch(spark))
    out = {r.doc_id: r for r in quality.score_documents(docs, model).collect()}
    for i, r in out.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
    held = [r for i, r in out.items() if r.held_out and i < 500]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held)
    assert out[9_000].score == out[9_001].score
    assert quality.score_documents(docs.limit(0), model).count() == 0


def test_quality_never_learns_from_held_out_rows(spark):
    docs = frame(spark, [(i, junk(i) if i % 3 == 0 else sentence(i, 40)) for i in range(120)])

    def label(i: int, spoiled: bool) -> int:
        held = zlib.crc32(str(i).encode()) % 5 == 0
        return int(i % 3 > 0) ^ int(spoiled and held)

    models = [
        quality.train(
            docs, labelled(spark, [(i, label(i, bad)) for i in range(120)], "quality"), Scratch(spark)
        )
        for bad in (False, True)
    ]
    for a, b in zip(models[0].parameters, models[1].parameters, strict=True):
        assert np.array_equal(a, b)


def test_quality_without_labels(spark):
    docs = frame(spark, corpus())
    model = quality.train(docs, labelled(spark, [], "quality"), Scratch(spark))
    assert quality.score_documents(docs, model).count() == docs.count()
