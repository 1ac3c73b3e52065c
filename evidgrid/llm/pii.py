"""Personal data: pattern spans and a character-level bidirectional LSTM with CRF transitions.

Base spans (email, ip, card, phone) come from fixed patterns with checks. A tagger is trained in
numpy from labelled spans: the base spans of a bounded sample, half of them rewritten in forms that
the patterns miss (at signs spelled out, with and without digits in the address; cards and numbers
with other separators; numbers without a country code). Its spans are added where they meet the
checks of their kind and touch no base span.

A text that meets the checks of a kind has a digit, an at sign, or an at spelled out before a domain.
Windows with one of these are decoded, and from them on, in both directions, as many more as a tagged
span goes on; what is found is what decoding all windows would find. Windows overlap by half, and
each character takes its label from the window in which it stands furthest from the border.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidgrid.llm.common import Adam, Scratch, lean, sigmoid, text_slices

KINDS = ("email", "ip", "card", "phone")
#: Sampled documents for training, of those with a digit or an at sign.
TRAIN_ROWS = 1_500
#: Training windows at most, of each kind of span and of those without one.
TRAIN_WINDOWS = 1_000
WINDOW, STEP = 96, 48
EMBED, HIDDEN, BATCH, STEPS, RATE = 12, 16, 64, 700, 0.03
#: Versions of a sampled text with differently written spans.
VERSIONS = 3
LABELS = 1 + 2 * len(KINDS)
CHARACTERS = 128

# The patterns of the kinds. A digit before a number would be part of the match.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
SPELLED = re.compile(
    r"[A-Za-z0-9._%+-]+ ?[(\[]? ?(?:@|[Aa][Tt]) ?[)\]]? ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
)
#: An at that stands as a word before a domain.
AT_DOMAIN = re.compile(r"(?<![A-Za-z])[Aa][Tt](?![A-Za-z]) ?[)\]]? ?[A-Za-z0-9-]++\.[A-Za-z0-9-]")

Span = tuple[int, int, int]  # kind, start, end in code points


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def valid_ip(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts)


def valid_card(text: str) -> bool:
    number = digits(text)
    return 13 <= len(number) <= 19 and luhn(number)


def valid_phone(text: str) -> bool:
    return 9 <= len(digits(text)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, at sign and domain; linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind and then start; a match that fails its check is dropped."""
    if not TRIGGER.search(text):
        return []
    spans = [(0, start, end) for start, end in emails(text)]
    for kind, pattern, valid in (
        (1, IP, valid_ip),
        (2, CARD, valid_card),
        (3, PHONE, valid_phone),
    ):
        spans += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(m.group())]
    return spans


def meets_checks(kind: int, text: str) -> bool:
    """Whether a tagged text could be of its kind."""
    if kind == 0:
        marked = TRIGGER.search(text) or AT_DOMAIN.search(text)
        return SPELLED.fullmatch(text) is not None and marked is not None
    if kind == 1:
        return IP.fullmatch(text) is not None and valid_ip(text)
    return valid_card(text) if kind == 2 else valid_phone(text)


def codes(text: str) -> np.ndarray:
    """Character classes: ASCII as it is, other letters, other characters."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    other = np.where(points >= 192, 1, 2)
    return np.where(points < CHARACTERS, points, other).astype(np.int64)


# --- the tagger -----------------------------------------------------------------------------------


class Layer:
    """An LSTM over (time, batch, features)."""

    def __init__(self, draw: np.random.Generator):
        self.wx = draw.normal(0, EMBED**-0.5, (EMBED, 4 * HIDDEN))
        self.wh = draw.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        self.b = np.zeros(4 * HIDDEN)
        self.b[HIDDEN : 2 * HIDDEN] = 1  # remember by default
        self.parameters = [self.wx, self.wh, self.b]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        steps, batch, _ = x.shape
        drive = x @ self.wx + self.b
        h, c = np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN))
        out, kept = np.empty((steps, batch, HIDDEN)), []
        for t in range(steps):
            z = drive[t] + h @ self.wh
            gates = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = np.split(gates, 3, axis=1)
            g = np.tanh(z[:, 3 * HIDDEN :])
            before_h, before_c = h, c
            c = f * c + i * g
            squashed = np.tanh(c)
            h = o * squashed
            out[t] = h
            kept.append((i, f, o, g, squashed, before_h, before_c))
        return out, kept

    def backward(self, x: np.ndarray, kept: list, by_out: np.ndarray) -> tuple[np.ndarray, list]:
        by_drive = np.empty((*by_out.shape[:2], 4 * HIDDEN))
        by_wh = np.zeros_like(self.wh)
        by_h, by_c = np.zeros(by_out.shape[1:]), np.zeros(by_out.shape[1:])
        for t in range(len(kept) - 1, -1, -1):
            i, f, o, g, squashed, before_h, before_c = kept[t]
            by_h = by_h + by_out[t]
            by_c = by_c + by_h * o * (1 - squashed**2)
            by_z = np.concatenate(
                [
                    by_c * g * i * (1 - i),
                    by_c * before_c * f * (1 - f),
                    by_h * squashed * o * (1 - o),
                    by_c * i * (1 - g**2),
                ],
                axis=1,
            )
            by_drive[t] = by_z
            by_wh += before_h.T @ by_z
            by_h, by_c = by_z @ self.wh.T, by_c * f
        by_wx = np.tensordot(x, by_drive, axes=([0, 1], [0, 1]))
        return by_drive @ self.wx.T, [by_wx, by_wh, by_drive.sum(axis=(0, 1))]


def logsum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(values - top).sum(axis=axis))


class Tagger:
    """Embeddings, one LSTM in each direction and CRF transitions between labels."""

    def __init__(self, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.embedding = draw.normal(0, 0.3, (CHARACTERS, EMBED))
        self.ahead, self.back = Layer(draw), Layer(draw)
        self.out = draw.normal(0, HIDDEN**-0.5, (2 * HIDDEN, LABELS))
        self.bias = np.zeros(LABELS)
        self.moves = np.zeros((LABELS, LABELS))
        self.parameters = [
            self.embedding,
            *self.ahead.parameters,
            *self.back.parameters,
            self.out,
            self.bias,
            self.moves,
        ]
        # Label 2k+1 begins kind k and 2k+2 goes on with it; nothing else may come before the latter.
        self.barred = np.zeros((LABELS, LABELS))
        for kind in range(len(KINDS)):
            self.barred[:, 2 * kind + 2] = -1e4
            self.barred[[2 * kind + 1, 2 * kind + 2], 2 * kind + 2] = 0

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Label scores (time, batch, labels) of windows (batch, time)."""
        embedded = self.embedding[x.T]
        ahead, kept_ahead = self.ahead.forward(embedded)
        back, kept_back = self.back.forward(embedded[::-1])
        joined = np.concatenate([ahead, back[::-1]], axis=2)
        return joined @ self.out + self.bias, (embedded, kept_ahead, kept_back, joined)

    def step(self, x: np.ndarray, y: np.ndarray, adam: Adam) -> float:
        """One gradient step on the negative log-likelihood of the labels ``y`` (batch, time)."""
        scores, (embedded, kept_ahead, kept_back, joined) = self.emissions(x)
        steps, batch, _ = scores.shape
        moves = self.moves + self.barred
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0]
        for t in range(1, steps):
            alpha[t] = logsum(alpha[t - 1][:, :, None] + moves, 1) + scores[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = logsum(moves + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
        total = logsum(alpha[-1], 1)
        by_scores = np.exp(alpha + beta - total[:, None])
        by_moves = np.zeros_like(moves)
        for t in range(1, steps):
            by_moves += np.exp(
                alpha[t - 1][:, :, None]
                + moves
                + (scores[t] + beta[t])[:, None, :]
                - total[:, None, None]
            ).sum(axis=0)
        gold = y.T
        place = np.arange(batch)
        reached = scores[np.arange(steps)[:, None], place, gold].sum(axis=0)
        reached += moves[gold[:-1], gold[1:]].sum(axis=0)
        by_scores[np.arange(steps)[:, None], place, gold] -= 1
        np.add.at(by_moves, (gold[:-1], gold[1:]), -1)
        by_scores /= batch
        by_joined = by_scores @ self.out.T
        by_ahead, ahead = self.ahead.backward(embedded, kept_ahead, by_joined[:, :, :HIDDEN])
        by_back, back = self.back.backward(
            embedded[::-1], kept_back, by_joined[::-1, :, HIDDEN:]
        )
        by_embedding = np.zeros_like(self.embedding)
        np.add.at(by_embedding, x.T, by_ahead + by_back[::-1])
        adam.step(
            [
                by_embedding,
                *ahead,
                *back,
                np.tensordot(joined, by_scores, axes=([0, 1], [0, 1])),
                by_scores.sum(axis=(0, 1)),
                by_moves / batch,
            ]
        )
        return float((total - reached).mean())

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best label sequences (batch, time) of windows."""
        scores, _ = self.emissions(x)
        moves = self.moves + self.barred
        best, trace = scores[0], []
        for t in range(1, len(scores)):
            reach = best[:, :, None] + moves
            trace.append(reach.argmax(axis=1))
            best = reach.max(axis=1) + scores[t]
        labels = [best.argmax(axis=1)]
        for origin in reversed(trace):
            labels.append(origin[np.arange(len(x)), labels[-1]])
        return np.stack(labels[::-1], axis=1)


def window_starts(text: str) -> list[int]:
    """Starts of the overlapping windows that have a digit, an at sign or an at before a domain."""
    starts = set()
    for pattern in (TRIGGER, AT_DOMAIN):
        for found in pattern.finditer(text):
            last = found.start() // STEP
            starts.update(k * STEP for k in (last - 1, last) if k >= 0)
    return sorted(starts)


def tag(tagger: Tagger, texts: list[str]) -> list[list[Span]]:
    """Tagged spans of whole texts: windows are decoded together and joined per text."""
    wanted = [(n, start) for n, text in enumerate(texts) for start in window_starts(text)]
    points = {n: codes(texts[n]) for n in {n for n, _ in wanted}}
    known = set(wanted)
    labels: dict[int, dict[int, int]] = {}
    margin = (WINDOW - STEP) // 2
    while wanted:
        beside = []
        for first in range(0, len(wanted), 256):
            places = wanted[first : first + 256]
            rows = np.zeros((len(places), WINDOW), np.int64)
            for row, (number, start) in zip(rows, places, strict=True):
                part = points[number][start : start + WINDOW]
                row[: len(part)] = part
            for (number, start), line in zip(places, tagger.decode(rows), strict=True):
                seen = labels.setdefault(number, {})
                # The middle of a window decides; its borders only count where no middle reaches.
                low, high = margin if start else 0, margin + STEP
                for offset in np.flatnonzero(line[low:high]) + low:
                    seen[start + int(offset)] = int(line[offset])
                # A span that goes on beyond the middle is followed into the next window.
                if start and line[low] and line[low] % 2 == 0:
                    beside.append((number, start - STEP))
                if line[high - 1] and start + high < len(points[number]):
                    beside.append((number, start + STEP))
        wanted = sorted(set(beside) - known)
        known.update(wanted)
    out: list[list[Span]] = [[] for _ in texts]
    for number, seen in labels.items():
        spans, current = [], None
        for at in sorted(seen):
            kind, begins = (seen[at] - 1) // 2, seen[at] % 2 == 1
            if current and at == current[2] and kind == current[0] and not begins:
                current[2] = at + 1
            else:
                current = [kind, at, at + 1]
                spans.append(current)
        out[number] = [tuple(span) for span in spans]
    return out


def find_spans(tagger: Tagger | None, texts: list[str]) -> Iterator[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of every text."""
    tagged = tag(tagger, texts) if tagger else [[] for _ in texts]
    for text, more in zip(texts, tagged, strict=True):
        base = base_spans(text)
        taken = sorted((start, end) for _, start, end in base)
        edges = [start for start, _ in taken]
        added = []
        for kind, start, end in more:
            while kind == 0 and start > 0 and text[start - 1] in LOCAL:
                start -= 1
            while kind == 0 and end < len(text) and text[end] in LOCAL:
                end += 1
            while start < end and text[start] in " .,;:":
                start += 1
            while end > start and text[end - 1] in " .,;:":
                end -= 1
            at = int(np.searchsorted(edges, end))
            clear = not any(e > start for _, e in taken[:at])
            if clear and start < end and meets_checks(kind, text[start:end]):
                added.append((kind, start, end))
        yield base, sorted(base + added)


# --- training -------------------------------------------------------------------------------------


def made_up(draw: np.random.Generator, least: int) -> str:
    """``least`` to ``least`` + 2 words with dots between them, one in eight with a digit."""
    words = []
    for _ in range(least + int(draw.integers(0, 3))):
        word = "".join(draw.choice(list("aaeeiioubcdfghklmnprstvw"), int(draw.integers(2, 13))))
        words.append(word + (str(draw.integers(0, 10)) if draw.random() < 0.125 else ""))
    return ".".join(words)


def rewritten(kind: int, text: str, draw: np.random.Generator) -> str:
    """A form of a span that its pattern does not match."""
    if kind == 0:
        local, domain = text.split("@")
        if draw.random() < 0.75:  # an address of other words, mostly without digits
            local, domain = made_up(draw, 1), made_up(draw, 2)
        return local + draw.choice([" (at) ", " [at] ", " at ", " AT "]) + domain
    if kind == 2:
        number, apart = digits(text), str(draw.choice([".", "/", "  ", " - "]))
        return apart.join(number[i : i + 4] for i in range(0, len(number), 4))
    if kind == 3:
        tail = text[1:].lstrip("0123456789").lstrip()
        tail = tail if valid_phone(tail) else text[1:]
        if draw.random() < 0.5:
            tail = str(draw.choice([".", "/", " "])).join(re.findall("[0-9]+", tail))
        return tail
    return text


def training_windows(
    text: str, draw: np.random.Generator
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows and labels around base spans, two of three rewritten, and around other digits."""
    spans = sorted(base_spans(text), key=lambda span: span[1])
    pieces, labels, at = [], [], 0
    for kind, start, end in spans:
        if start < at:
            continue
        body = text[start:end]
        if draw.random() < 2 / 3:
            body = rewritten(kind, body, draw)
        pieces += [text[at:start], body]
        labels += [0] * (start - at) + [2 * kind + 1] + [2 * kind + 2] * (len(body) - 1)
        at = end
    changed = "".join(pieces) + text[at:]
    labels += [0] * (len(text) - at)
    points, truth = codes(changed), np.array(labels, np.int64)
    for start in window_starts(changed):
        shift = max(0, start - int(draw.integers(0, STEP)))
        row, mark = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
        part = points[shift : shift + WINDOW]
        row[: len(part)], mark[: len(part)] = part, truth[shift : shift + WINDOW]
        if mark[0] and mark[0] % 2 == 0:  # cut inside a span
            mark[: int(np.argmax(mark != mark[0])) or WINDOW] = 0
        yield row, mark


def drawn_windows(
    sample: DataFrame, scratch: Scratch, each: int = TRAIN_WINDOWS
) -> tuple[np.ndarray, np.ndarray]:
    """At most ``each`` windows of every kind, from all windows of the whole texts (mark, text).

    Windows are made where the texts are and drawn by a hash; only those drawn come to the driver.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                draw = np.random.default_rng(mark & (1 << 63) - 1)
                versions = VERSIONS if base_spans(text) else 1
                pairs = [pair for _ in range(versions) for pair in training_windows(text, draw)]
                if not pairs:
                    continue
                labels = np.array([labels for _, labels in pairs])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(pairs), mark)),
                        pa.array(np.arange(len(pairs))),
                        pa.array(span_kind(labels)),
                        pa.array([row.astype(np.int32).tobytes() for row, _ in pairs]),
                        pa.array([row.astype(np.int32).tobytes() for row in labels]),
                    ],
                    names=["mark", "number", "kind", "x", "y"],
                )

    made = sample.select("mark", "text").mapInArrow(
        lean(run), "mark bigint, number bigint, kind bigint, x binary, y binary"
    )
    written = scratch.save(made, "windows")
    mixed_up = F.xxhash64("mark", "number")
    parts = [
        written.where(F.col("kind") == k).orderBy(mixed_up, "mark", "number").limit(each)
        for k in range(len(KINDS) + 1)
    ]
    chosen = reduce(DataFrame.union, parts).orderBy("kind", mixed_up, "mark", "number")
    rows = chosen.select("x", "y").toArrow()  # 5 * ``each`` windows
    return tuple(
        np.array([np.frombuffer(value, np.int32) for value in rows.column(i).to_pylist()], np.int64)
        .reshape(-1, WINDOW)
        for i in range(2)
    )


def span_kind(labels: np.ndarray) -> np.ndarray:
    """For every row of labels the first kind that begins in it, or the number of kinds."""
    begun = np.stack([(labels == 2 * k + 1).any(axis=1) for k in range(len(KINDS))], axis=1)
    return np.where(begun.any(axis=1), begun.argmax(axis=1), len(KINDS)).astype(np.int64)


def balanced(marks: np.ndarray) -> np.ndarray:
    """Chance of every window to be drawn: all kinds are drawn alike, emails four times as often."""
    kinds = span_kind(marks)
    weights = np.array([4.0, 1, 1, 1, 1])[kinds] / np.bincount(kinds, minlength=5)[kinds]
    return weights / weights.sum()


def train(docs: DataFrame, scratch: Scratch, rows: int = TRAIN_ROWS) -> Tagger | None:
    """Tagger from the base spans of at most ``rows`` documents; None if none has a span.

    The sample takes the documents that come first by a hash of their id, whole; of all their windows
    at most ``TRAIN_WINDOWS`` of every kind are drawn.
    """
    usable = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text"
    ).where(F.col("text").rlike("[0-9@]"))
    # Ids are sorted without their texts; the few texts are fetched afterwards.
    picked = scratch.save(
        usable.select("doc_id", "mark")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "mark")
        .limit(rows),
        "pii-ids",
    )
    sample = usable.join(F.broadcast(picked), ["doc_id", "mark"]).dropDuplicates(["mark"])
    x, y = drawn_windows(sample, scratch)
    if not y.any():
        return None
    draw = np.random.default_rng(5)
    tagger = Tagger()
    adam = Adam(tagger.parameters, RATE)
    share = balanced(y)
    for _ in range(STEPS):
        chosen = draw.choice(len(x), min(BATCH, len(x)), p=share)
        tagger.step(x[chosen], y[chosen], adam)
    return tagger


def personal_data(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """doc_id, base and all spans (kind, start, end) of every document, sorted by kind and start.

    Positions are code points, ends exclusive. Null and empty texts have no spans; null and
    repeated ids are kept as they are; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def named(spans: list[Span]) -> list[dict]:
        return [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bodies in text_slices(batches, "text"):
            found = list(find_spans(shared.value, [body.decode() for body in bodies]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([named(base) for base, _ in found], pa.list_(span)),
                    pa.array([named(spans) for _, spans in found], pa.list_(span)),
                ],
                names=["doc_id", "base", "spans"],
            )

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lean(run), f"doc_id bigint, base {kind}, spans {kind}"
    )
