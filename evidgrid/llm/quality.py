"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded from what it looks
like (letters, capitals, digits, symbols, repeated words), gated attention weighs the passages of a
document, and the weighted sum of their codes gives the score. Only documents have labels; which
passages matter is learned. Fitted in numpy on at most ``TRAIN_ROWS`` documents of each label.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidgrid.llm.common import Adam, Scratch, labelled_sample, lean, sigmoid, text_slices

#: Training documents of each label.
TRAIN_ROWS = 3_000
PASSAGE = 50
THRESHOLD = 0.3
HIDDEN, GATE = 12, 8
ROUNDS, RATE, RIDGE = 400, 0.02, 1e-4
#: Byte classes that are counted in a passage.
CLASSES = (
    bytes(range(97, 123)),
    bytes(range(65, 91)),
    bytes(range(48, 58)),
    bytes(range(128, 256)),
    b".,;:",
    b"!?",
    b"|",
    b"\"'()[]{}<>",
    b"#$%&*+-/=@\\^_`~",
)
FEATURES = len(CLASSES) + 4


def passages(text: bytes) -> list[list[float]]:
    """Features of every passage of a text; a text without words is one passage of zeros."""
    words = text.split()
    if not words:
        return [[0.0] * FEATURES]
    rows = []
    for start in range(0, len(words), PASSAGE):
        part = words[start : start + PASSAGE]
        joined = b"".join(part)
        size, n = len(joined), len(part)
        rows.append(
            [(size - len(joined.translate(None, kind))) / size for kind in CLASSES]
            + [
                size / n / 10,
                len(set(part)) / n,
                sum(map(eq, part, part[1:])) / n,
                n / PASSAGE,
            ]
        )
    return rows


class Model:
    """Encoder, gated attention and output layer."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)

        def matrix(rows: int, columns: int) -> np.ndarray:
            return draw.normal(0, rows**-0.5, (rows, columns))

        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.parameters = [
            matrix(FEATURES, HIDDEN),
            np.zeros(HIDDEN),
            matrix(HIDDEN, GATE),
            matrix(HIDDEN, GATE),
            matrix(GATE, 1)[:, 0],
            matrix(HIDDEN, 1)[:, 0],
            np.zeros(1),
        ]

    def forward(self, x: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple:
        """Scores of the bags that begin at ``starts``, and what the gradients need."""
        w, b, v, u, a, c, d = self.parameters
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ w + b)
        t, s = np.tanh(h @ v), sigmoid(h @ u)
        e = (t * s) @ a
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        weight = e / np.repeat(np.add.reduceat(e, starts), counts)
        bag = np.add.reduceat(weight[:, None] * h, starts)
        return sigmoid(bag @ c + d[0]), (z, h, t, s, weight, bag)

    def fit(self, x: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> None:
        starts = np.cumsum(counts) - counts
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        w, b, v, u, a, c, d = self.parameters
        adam = Adam(self.parameters, RATE)
        total = np.bincount(labels, minlength=2)
        importance = (0.5 / np.maximum(1, total))[labels]
        for _ in range(ROUNDS):
            score, (z, h, t, s, weight, bag) = self.forward(x, starts, counts)
            out = (score - labels) * importance
            by_bag = np.repeat(out[:, None] * c, counts, axis=0)
            by_weight = (by_bag * h).sum(axis=1)
            mean = np.repeat(np.add.reduceat(weight * by_weight, starts), counts)
            by_e = weight * (by_weight - mean)
            by_t, by_s = by_e[:, None] * a * s, by_e[:, None] * a * t
            by_t, by_s = by_t * (1 - t * t), by_s * s * (1 - s)
            by_h = weight[:, None] * by_bag + by_t @ v.T + by_s @ u.T
            by_h *= 1 - h * h
            gradients = [
                z.T @ by_h,
                by_h.sum(axis=0),
                h.T @ by_t,
                h.T @ by_s,
                (t * s).T @ by_e,
                bag.T @ out,
                np.array([out.sum()]),
            ]
            adam.step([g + RIDGE * p for g, p in zip(gradients, self.parameters, strict=True)])


def held_out(doc_id: Column | str) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text, a fifth of all."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, per_class: int = TRAIN_ROWS
) -> Model:
    """Fit on a sample of labelled rows outside the held-out fifth.

    Without rows of both labels the model is left as it starts: its scores then mean nothing.
    """
    usable = labels.where(~held_out("doc_id"))
    sample = labelled_sample(docs, usable, "quality", per_class, scratch)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(batch.schema.get_field_index("label")),
                    pa.array([passages(text) for text in texts]),
                ],
                names=["doc_id", "label", "bag"],
            )

    schema = "doc_id bigint, label int, bag array<array<double>>"
    rows = sorted(sample.mapInArrow(lean(run), schema).collect(), key=lambda row: row.doc_id)
    model = Model()
    if len({row.label for row in rows}) == 2:
        bags = [np.array(row.bag) for row in rows]
        model.fit(
            np.concatenate(bags),
            np.array([len(bag) for bag in bags]),
            np.array([row.label for row in rows]),
        )
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, from its whole text.

    A null text is an empty one and has a score too; a null id is not held out; repeated ids are
    kept as they are; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "text"):
            bags = [passages(text) for text in texts]
            counts = np.array([len(bag) for bag in bags])
            x = np.array([row for bag in bags for row in bag])
            scores, _ = shared.value.forward(x, np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores)],
                names=["doc_id", "held_out", "score"],
            )

    scored = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), "text"
    ).mapInArrow(lean(run), "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
