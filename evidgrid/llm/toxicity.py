"""Toxicity as severity grades: a cumulative-link model over sparse word features.

The labels say toxic or not. Severity grades come from the training sample: grade 0 for documents
labelled 0; documents labelled 1 are graded 1 to 3 by how often they use words that tell the labels
apart, cut at the thirds. Copies and near copies in the sample count as one document together, else
the words of a text that is often copied would look telling. One weight per word is shared by the ordered thresholds of all grades:
P(grade <= k) = sigmoid(threshold_k - score). The result is the expected grade.

Features are words and beginnings of words whose smoothed log-odds between the labels are at least
``LEAST_ODDS`` and ``LEAST_Z`` standard errors from zero in the sample, by 64-bit hash, with
1 + log(count) as value; beginnings reach inflected forms that the sample does not have. Texts are
read whole, wherever the words stand. The model is fitted on at most ``TRAIN_ROWS`` documents of each label;
scores are a projection over all documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidgrid.llm.common import (
    Adam,
    Scratch,
    byte_table,
    labelled_sample,
    lean,
    sigmoid,
    text_slices,
)
from evidgrid.llm.rolling import BASE_RUN, REMEMBERED, Hasher, inside, mixed, signed, spread

#: Training documents of each label.
TRAIN_ROWS = 2_000
#: Documents of the sample that share one of so many least hashes of word runs share one vote.
VOTES, RUN = 8, 8
#: Evidence that a feature needs: standard errors, and the log-odds themselves.
LEAST_Z, LEAST_ODDS = 3.5, 2.5
#: Bytes of the beginnings of words that are features.
BEGINNINGS = (4, 5, 6, 7)
#: Documents with a word, of the sample, that make it a candidate.
LEAST_DOCUMENTS = 3
#: Features at most, the strongest first.
MOST_FEATURES = 5_000
ROUNDS, RATE, RIDGE = 300, 0.05, 0.002
WORD_BYTES = byte_table([*range(65, 91), *range(97, 123), *range(128, 256)])


@dataclass
class Model:
    features: np.ndarray  # sorted word hashes
    weights: np.ndarray
    thresholds: np.ndarray  # of grades 1, 2, ...

    def grades(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...; one column each."""
        return sigmoid(scores[:, None] - self.thresholds)


class Features:
    """Feature hashes of words: the word and its beginnings; remembered within a task."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.flat = np.empty(0, np.uint64)
        self.start, self.length = np.empty(0, np.int64), np.empty(0, np.int64)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of words of each text and the code of every word of a slice."""
        if len(self.codes) > REMEMBERED:
            self.forget()
        codes, known = self.codes, len(self.codes)
        code = codes.setdefault
        split = [text.translate(WORD_BYTES).split() for text in texts]
        lengths = np.array([len(ws) for ws in split], np.int64)
        ids = np.fromiter(
            (code(w, len(codes)) for ws in split for w in ws), np.int64, int(lengths.sum())
        )
        if len(codes) > known:
            digest = xxhash.xxh3_64_intdigest
            fresh, counts = [], []
            for word in list(codes)[known:]:
                here = [digest(word)] + [
                    digest(b"^" + word[:size]) for size in BEGINNINGS if size <= len(word)
                ]
                fresh += here
                counts.append(len(here))
            length = np.array(counts, np.int64)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.flat = np.concatenate([self.flat, np.array(fresh, np.uint64)])
        return lengths, ids


def least_runs(hasher: Hasher, lengths: np.ndarray, words: np.ndarray) -> np.ndarray:
    """``VOTES`` least hashes of the runs of ``RUN`` words of each text, each in another order."""
    starts, owner = inside(lengths, RUN)
    runs = hasher.rolling(words, RUN, BASE_RUN)[starts] if len(starts) else words[:0]
    # A shorter text is named by its words.
    sums = np.concatenate(([np.uint64(0)], np.cumsum(words)))
    ends = np.cumsum(lengths)
    out = np.repeat((sums[ends] - sums[ends - lengths])[:, None], VOTES, axis=1)
    texts, first = np.unique(owner, return_index=True)
    for vote in range(VOTES if len(texts) else 0):
        out[texts, vote] = np.minimum.reduceat(mixed(runs + np.uint64(vote)), first)
    return out


def grouped(
    owner: np.ndarray, values: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs, sorted, and how often each occurs."""
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(fresh)
    return owner[fresh], values[fresh], np.diff(np.append(starts, len(values)))


def word_counts(sample: DataFrame) -> DataFrame:
    """label, distinct feature hashes with their counts and votes of every sampled document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, hasher = Features(), Hasher()
        for batch, texts in text_slices(batches, "text"):
            lengths, codes = features.words(texts)
            votes = least_runs(hasher, lengths, features.flat[features.start[codes]])
            owner, code, counts = grouped(np.repeat(np.arange(len(texts)), lengths), codes)
            many = features.length[code]
            owner, counts = np.repeat(owner, many), np.repeat(counts, many)
            values = signed(features.flat[spread(features.start[code], many)])
            # Words of one document that share a beginning count together.
            order = np.lexsort((values, owner))
            owner, values, counts = owner[order], values[order], counts[order]
            first = np.flatnonzero(
                np.concatenate(
                    (
                        np.ones(min(1, len(values)), bool),
                        (values[1:] != values[:-1]) | (owner[1:] != owner[:-1]),
                    )
                )
            )
            summed = np.add.reduceat(counts, first) if len(first) else counts
            per_doc = np.bincount(owner[first], minlength=len(texts))
            offsets = pa.array(np.concatenate(([0], np.cumsum(per_doc))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(batch.schema.get_field_index("label")),
                    pa.ListArray.from_arrays(offsets, pa.array(values[first])),
                    pa.ListArray.from_arrays(offsets, pa.array(summed.astype(np.int32))),
                    pa.array(list(signed(votes)), pa.list_(pa.int64())),
                ],
                names=["doc_id", "label", "words", "counts", "votes"],
            )

    return sample.mapInArrow(
        lean(run),
        "doc_id bigint, label int, words array<bigint>, counts array<int>, votes array<bigint>",
    )


def shares(votes: np.ndarray) -> np.ndarray:
    """Weight of each document: one over the largest number that shares one of its votes."""
    most = np.ones(len(votes))
    for column in votes.T:
        _, code, size = np.unique(column, return_inverse=True, return_counts=True)
        most = np.maximum(most, size[code])
    return 1 / most


def fit(
    labels: np.ndarray,
    share: np.ndarray,
    owner: np.ndarray,
    words: np.ndarray,
    counts: np.ndarray,
) -> Model:
    """Model from sparse rows (owner, word hash, count); ``share`` is the weight of a document.

    With only one label all documents get it.
    """
    total = np.bincount(labels, weights=share, minlength=2)
    if not total.all():
        top = np.inf if total[1] == 0 else -np.inf
        return Model(np.empty(0, np.int64), np.empty(0), np.array([top]))
    known, code = np.unique(words, return_inverse=True)
    ones = np.bincount(code, weights=(labels * share)[owner], minlength=len(known))
    zeros = np.bincount(code, weights=share[owner], minlength=len(known)) - ones
    zeros = np.maximum(zeros, 0)
    odds = [np.log((n + 0.5) / (t - n + 0.5)) for n, t in ((ones, total[1]), (zeros, total[0]))]
    error = np.sqrt(
        1 / (ones + 0.5) + 1 / (total[1] - ones + 0.5)
        + 1 / (zeros + 0.5) + 1 / (total[0] - zeros + 0.5)
    )
    z = (odds[0] - odds[1]) / error
    told = (np.abs(z) >= LEAST_Z) & (np.abs(odds[0] - odds[1]) >= LEAST_ODDS)
    strong = np.flatnonzero(told & (ones + zeros >= LEAST_DOCUMENTS))
    strong = np.sort(strong[np.argsort(-np.abs(z[strong]), kind="stable")[:MOST_FEATURES]])
    place = np.full(len(known), -1)
    place[strong] = np.arange(len(strong))
    used = place[code] >= 0
    rows, columns, n = owner[used], place[code[used]], counts[used]
    values = 1 + np.log(n)
    markers = np.bincount(rows, weights=n * (z[strong][columns] > 0), minlength=len(labels))
    cuts = np.quantile(markers[labels == 1], [1 / 3, 2 / 3])
    grade = np.where(labels == 1, 1 + (markers[:, None] > cuts).sum(axis=1), 0)
    grades = int(grade.max())

    weights, base, gaps = np.zeros(len(strong)), np.array([1.0]), np.full(grades - 1, 0.5)
    adam = Adam([weights, base, gaps], RATE)
    importance = (0.5 * len(labels) / total)[labels] * share
    row = np.arange(len(labels))
    for _ in range(ROUNDS):
        score = np.bincount(rows, weights=weights[columns] * values, minlength=len(labels))
        thresholds = base[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        # At most grade k for k = -1 .. grades; the ends are certain.
        below = np.zeros((len(labels), grades + 2))
        below[:, 1:-1] = sigmoid(thresholds - score[:, None])
        below[:, -1] = 1
        slope = below * (1 - below)
        p = np.maximum(below[row, grade + 1] - below[row, grade], 1e-12)
        upper, lower = slope[row, grade + 1], slope[row, grade]
        by_score = importance * (upper - lower) / p / len(labels)
        by_threshold = np.zeros(grades)
        scale = importance / p / len(labels)
        np.add.at(by_threshold, np.minimum(grade, grades - 1), -scale * upper * (grade < grades))
        np.add.at(by_threshold, np.maximum(grade - 1, 0), scale * lower * (grade > 0))
        after = np.cumsum(by_threshold[::-1])[::-1]
        adam.step(
            [
                np.bincount(columns, weights=by_score[rows] * values, minlength=len(strong))
                + RIDGE * weights / max(1, len(strong)) ** 0.5,
                after[:1].copy(),
                after[1:] * np.exp(gaps),
            ]
        )
    thresholds = base[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
    return Model(known[strong], weights, thresholds)


def train(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, per_class: int = TRAIN_ROWS
) -> Model:
    """Fit on a sample of at most ``per_class`` labelled documents of each label."""
    sample = labelled_sample(docs, labels, "toxic", per_class, scratch)
    rows = word_counts(sample).orderBy("doc_id").toArrow().combine_chunks()  # as the sample bounds
    words, counts = rows.column("words"), rows.column("counts")
    sizes = pa.compute.list_value_length(words).to_numpy()
    votes = pa.compute.list_flatten(rows.column("votes")).to_numpy().reshape(-1, VOTES)
    return fit(
        rows.column("label").to_numpy().astype(np.int64),
        shares(votes),
        np.repeat(np.arange(len(sizes)), sizes),
        pa.compute.list_flatten(words).to_numpy(),
        pa.compute.list_flatten(counts).to_numpy().astype(np.int64),
    )


class Scorer:
    """Scores slices of texts in a task."""

    def __init__(self, model: Model):
        self.model, self.features = model, Features()

    def grades(self, texts: list[bytes]) -> np.ndarray:
        model, features = self.model, self.features
        lengths, codes = features.words(texts)
        scores = np.zeros(len(texts))
        if len(model.features):
            place = np.searchsorted(model.features, signed(features.flat))
            place = np.minimum(place, len(model.features) - 1)
            place[model.features[place] != signed(features.flat)] = -1
            # Most words have no feature of the model; only the others are spread out.
            telling = np.zeros(len(features.start), bool)
            owner_of = np.repeat(np.arange(len(features.start)), features.length)
            telling[owner_of[place >= 0]] = True
            used = telling[codes]
            owner, code = np.repeat(np.arange(len(texts)), lengths)[used], codes[used]
            many = features.length[code]
            owner = np.repeat(owner, many)
            column = place[spread(features.start[code], many)]
            rows, columns, counts = grouped(owner[column >= 0], column[column >= 0])
            scores = np.bincount(
                rows, weights=model.weights[columns] * (1 + np.log(counts)), minlength=len(texts)
            )
        return model.grades(scores)


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade), grade (nearest), toxic, p_toxic of every document.

    A document is toxic if a grade over 0 is at least as likely as grade 0. Null and empty texts
    have no features; null and repeated ids are kept as they are; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch, texts in text_slices(batches, "text"):
            at_least = scorer.grades(texts)
            expected = at_least.sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(expected),
                    pa.array(np.round(expected).astype(np.int32)),
                    pa.array(at_least[:, 0]),
                    pa.array(at_least[:, 0] >= 0.5),
                ],
                names=["doc_id", "severity", "grade", "p_toxic", "toxic"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lean(run), "doc_id bigint, severity double, grade int, p_toxic double, toxic boolean"
    )


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are not toxic, with all their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch, texts in text_slices(batches, "text"):
            yield batch.filter(pa.array(scorer.grades(texts)[:, 0] < 0.5))

    return docs.mapInArrow(lean(run), docs.schema)
