"""Byte-level BPE encoding and decoding with padded numpy matrices.

Texts are cut by the tokenizer's pattern. The distinct pieces of a few MB of text are sorted into
buckets by length and each bucket is one padded matrix of token ids. In a round every row that still
has a known pair merges its leftmost pair of minimum rank; the matrix is then compacted, so it gets
one column narrower, and finished rows leave it. Pair ranks come from an open-addressing hash table.

Pieces over ``LONG_PIECE`` bytes merge in the same order from a heap: rounds over a matrix would take
time that grows with the square of their length.

The vocabulary file is an argument; it is read once on the driver and sent to the tasks, at most
``MOST_VOCABULARY`` entries.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidgrid.llm.common import lean, ship_package, text_slices
from evidgrid.llm.rolling import spread

#: Buckets end at these lengths in bytes, then at doubled ones.
BUCKETS = (4, 6, 8, 10, 12, 14, 16, 20, 24, 32)
LONG_PIECE = 2_048
#: Cells of one matrix.
MATRIX_CELLS = 2_000_000
#: Distinct pieces that a task remembers before it starts anew.
REMEMBERED = 200_000
MOST_VOCABULARY = 1_000_000
NONE = np.iinfo(np.int64).max
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Ranks of a tokenizer with the hash table of its pairs."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if len(ranks) > MOST_VOCABULARY:
            raise ValueError(f"{len(ranks)} entries; at most {MOST_VOCABULARY} are sent to tasks")
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a rank: {missing}")
        self.pattern = pattern
        self.base = max(ranks.values()) + 1
        self.bytes_rank = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = rank
        self._fill(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64))
        by_rank = sorted((rank, token) for token, rank in ranks.items())
        lengths = np.zeros(self.base, np.int64)
        for rank, token in by_rank:
            lengths[rank] = len(token)
        self.token_length = lengths
        self.token_start = np.cumsum(lengths) - lengths
        self.token_bytes = np.frombuffer(b"".join(token for _, token in by_rank), np.uint8)

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """From a file with a base64 token and its rank in each line."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        return cls(ranks, pattern)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int64)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == -1
            chosen, first = np.unique(slot[left[free]], return_index=True)
            placed = left[free][first]
            self.keys[chosen], self.values[chosen] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed)
            # A slot that is taken now sends the others on to the next one.
            taken = self.keys[slot[left]] != -1
            slot[left[taken]] = (slot[left[taken]] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MULTIPLIER) >> self.shift).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merged pair, NONE if there is none or a place is padding (negative)."""
        keys = left.astype(np.int64) * self.base + right
        ranks = np.full(keys.shape, NONE, np.int64)
        todo = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        wanted = keys.ravel()[todo]
        slot = self._slot(wanted)
        flat = ranks.reshape(-1)
        while len(todo):
            there = self.keys[slot]
            same = there == wanted
            flat[todo[same]] = self.values[slot[same]]
            on = ~same & (there != -1)
            todo, wanted, slot = todo[on], wanted[on], (slot[on] + 1) & self.mask
        return ranks

    # --- encoding -------------------------------------------------------------------------------

    def encode_bucket(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Token ids of pieces of at most ``width`` bytes."""
        size = np.array([len(p) for p in pieces])
        padded = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)
        ids = self.bytes_rank[padded].reshape(len(pieces), width)
        ids[np.arange(width) >= size[:, None]] = -1
        ranks = self.pair_rank(ids[:, :-1], ids[:, 1:])
        row = np.arange(len(pieces))
        done: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)

        def finish(rows: np.ndarray, of: np.ndarray) -> None:
            for r, line in zip(rows, of.astype(np.int32), strict=True):
                done[r] = line[line >= 0]

        while True:
            if not ranks.shape[1]:
                finish(row, ids)
                return done
            best = ranks.argmin(axis=1)
            least = ranks[np.arange(len(row)), best]
            going = least != NONE
            if not going.all():
                finish(row[~going], ids[~going])
                if not going.any():
                    return done
                row, ids, ranks, best, least = (x[going] for x in (row, ids, ranks, best, least))
            lines = np.arange(len(row))
            ids[lines, best] = least
            kept = np.ones(ids.shape, bool)
            kept[lines, best + 1] = False
            ids = ids[kept].reshape(len(row), -1)
            kept = np.ones(ranks.shape, bool)
            kept[lines, best] = False
            ranks = ranks[kept].reshape(len(row), -1)
            for at in (best - 1, best):
                inside = (at >= 0) & (at < ranks.shape[1])
                r, c = lines[inside], at[inside]
                ranks[r, c] = self.pair_rank(ids[r, c], ids[r, c + 1])

    def encode_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece: minimum rank first, leftmost among equals."""
        ids = self.bytes_rank[np.frombuffer(piece, np.uint8)]
        first = self.pair_rank(ids[:-1], ids[1:])
        tokens, end = ids.tolist(), len(piece)
        following, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(r, i) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)
        current = first.tolist() + [NONE]

        def renew(at: int) -> None:
            right = following[at]
            rank = NONE
            if right < end:
                key = tokens[at] * self.base + tokens[right]
                slot = ((key * int(MULTIPLIER)) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
                while self.keys[slot] != -1:
                    if self.keys[slot] == key:
                        rank = int(self.values[slot])
                        heapq.heappush(heap, (rank, at))
                        break
                    slot = (slot + 1) & self.mask
            current[at] = rank

        while heap:
            rank, at = heapq.heappop(heap)
            if current[at] != rank:
                continue
            gone = following[at]
            tokens[at], following[at] = rank, following[gone]
            if following[at] < end:
                before[following[at]] = at
            current[gone], tokens[gone] = -1, -1
            renew(at)
            if before[at] >= 0:
                renew(before[at])
        return np.array([t for t in tokens if t >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            size = len(piece)
            if size > LONG_PIECE:
                out[i] = self.encode_long(piece)
                continue
            width = next((w for w in BUCKETS if size <= w), 1 << (size - 1).bit_length())
            buckets.setdefault(width, []).append(i)
        for width, places in buckets.items():
            rows = max(1, MATRIX_CELLS // width)
            for start in range(0, len(places), rows):
                chunk = places[start : start + rows]
                for i, ids in zip(
                    chunk, self.encode_bucket([pieces[i] for i in chunk], width), strict=True
                ):
                    out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all tokens, one after the other."""
        return self.token_bytes[spread(self.token_start[ids], self.token_length[ids])]


class Encoder:
    """Encodes texts and remembers the pieces it has met, up to ``REMEMBERED``."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pieces = regex.compile(vocabulary.pattern).findall
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.start = np.empty(0, np.int64)
        self.length = np.empty(0, np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their number for each text."""
        if len(self.codes) > REMEMBERED:
            self.forget()
        known, codes = len(self.codes), self.codes
        code = codes.setdefault
        per_text = []
        for text in texts:
            pieces = self.pieces(text.decode())
            per_text.append(np.fromiter((code(p, len(codes)) for p in pieces), np.int64, len(pieces)))
        fresh = [p.encode() for p in list(codes)[known:]] if len(codes) > known else []
        if fresh:
            ids = self.vocabulary.encode_pieces(fresh)
            length = np.array([len(x) for x in ids], np.int64)
            start = len(self.flat) + np.cumsum(length) - length
            self.flat = np.concatenate([self.flat, *ids])
            self.start = np.concatenate([self.start, start])
            self.length = np.concatenate([self.length, length])
        all_codes = np.concatenate(per_text) if per_text else np.empty(0, np.int64)
        lengths = self.length[all_codes]
        flat = self.flat[spread(self.start[all_codes], lengths)]
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in per_text])
        counts = np.bincount(owner, weights=lengths, minlength=len(texts)).astype(np.int64)
        return flat, counts


def _ragged(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and the token ids of the whole text; a null text has none."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch, texts in text_slices(batches, "text"):
            flat, counts = encoder.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _ragged(pa.array(flat), counts)], names=["doc_id", "ids"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lean(run), "doc_id bigint, ids array<int>"
    )


def _decoded(words: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Bytes of the ids of every text, as a binary column."""
    ends = np.concatenate(([0], np.cumsum(words.token_length[ids])))
    bounds = ends[np.concatenate(([0], np.cumsum(counts)))].astype(np.int32)
    data = np.ascontiguousarray(words.decode(ids))
    return pa.Array.from_buffers(
        pa.binary(), len(counts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]
    )


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` (doc_id, ids) with the bytes that the ids stand for; null ids decode to none."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, int(whole.num_rows * 1_000_000 / max(1, _elements(whole.column(1)))))
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                ids = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                counts = pa.compute.list_value_length(batch.column(1)).fill_null(0).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), _decoded(shared.value, ids, counts)],
                    names=["doc_id", "ids", "decoded"],
                )

    return encoded.select("doc_id", "ids").mapInArrow(
        lean(run), "doc_id bigint, ids array<int>, decoded binary"
    )


def _elements(lists: pa.ListArray) -> int:
    return len(lists.flatten())


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and decoded bytes of every document; an empty table gives an empty table.

    The same as ``decode(encode(docs))``, but the ids are decoded where they are made: they do not
    go through the JVM, and a task has one Python worker instead of two.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(path, pattern))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch, texts in text_slices(batches, "text"):
            flat, counts = encoder.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    _ragged(pa.array(flat), counts),
                    _decoded(shared.value, flat, counts),
                ],
                names=["doc_id", "ids", "decoded"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lean(run), "doc_id bigint, ids array<int>, decoded binary"
    )
