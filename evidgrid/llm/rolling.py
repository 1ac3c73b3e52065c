"""Rabin-Karp hashes of word runs, for all starts of a slice of texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bases of the rolling hashes and the final mixing; odd 64-bit numbers without structure.
BASE_WINDOW, BASE_RUN = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Distinct words whose hashes a task remembers before it starts anew.
REMEMBERED = 150_000


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * MIX_1
    values = (values ^ (values >> np.uint64(27))) * MIX_2
    return values ^ (values >> np.uint64(31))


class Hasher:
    """Word hashes of a task and the powers of a base, grown as needed."""

    def __init__(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.hashes = np.empty(0, np.uint64)
        self.powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def words(self, split: list[list[bytes]]) -> np.ndarray:
        """64-bit hash of every word of a slice, in order."""
        if len(self.codes) > REMEMBERED:
            self.codes, self.hashes = {}, np.empty(0, np.uint64)
        codes, known = self.codes, len(self.codes)
        code = codes.setdefault
        total = sum(map(len, split))
        ids = np.fromiter((code(w, len(codes)) for ws in split for w in ws), np.int64, total)
        if len(codes) > known:
            digest = xxhash.xxh3_64_intdigest
            fresh = np.fromiter((digest(w) for w in list(codes)[known:]), np.uint64)
            self.hashes = np.concatenate([self.hashes, fresh])
        return self.hashes[ids]

    def rolling(self, words: np.ndarray, size: int, base: int) -> np.ndarray:
        """Hash of the run of ``size`` words at every start: sum of word * inverse ** place.

        Running sums of word * inverse ** index give all of them; base ** start makes a hash
        independent of where the run stands. Arithmetic is modulo 2 ** 64.
        """
        if len(words) < size:
            return np.empty(0, np.uint64)
        if base not in self.powers or len(self.powers[base][0]) < len(words):
            inverse = pow(base, -1, 1 << 64)
            grown = max(len(words), 1 << 16)
            up, down = np.full(grown, base, np.uint64), np.full(grown, inverse, np.uint64)
            up[0] = down[0] = 1
            self.powers[base] = (np.cumprod(up), np.cumprod(down))
        up, down = self.powers[base]
        sums = np.concatenate(([np.uint64(0)], np.cumsum(words * down[: len(words)])))
        starts = len(words) - size + 1
        return mixed((sums[size:] - sums[:-size]) * up[:starts])

    def anchors(self, words: np.ndarray, size: int) -> np.ndarray:
        """Smallest hash of the runs of half a window inside the window at every start."""
        run = max(1, size // 2)
        values = self.rolling(words, run, BASE_RUN)
        span, width = size - run + 1, 1
        while width * 2 <= span:
            values = np.minimum(values[:-width], values[width:])
            width *= 2
        rest = span - width
        return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def inside(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one document, over a slice, and their documents."""
    windows = np.maximum(0, lengths - size + 1)
    first = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(lengths)), windows)
    within = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    return first[owner] + within, owner


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts .. starts + lengths``, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
