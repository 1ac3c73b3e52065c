"""Hard negatives against brute force."""

import math

import numpy as np
import pytest

from evidgrid.llm.common import Scratch
from evidgrid.llm.hard_negatives import KEY, hard_negatives, products, windows

SCHEMA = "vec_id bigint, embedding array<double>, label int, score string, rank string, v string"


def brute(rows):
    single = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        own = (label, [math.floor(256 * x) for x in vector])
        single[vec_id] = min(single.get(vec_id, own), own)
    out = []
    for anchor in (i for i in single if i % 100 == 0):
        label, vector = single[anchor]
        ranked = sorted(
            (-sum(a * b for a, b in zip(vector, v)), i, kind == label)
            for i, (kind, v) in single.items()
            if i != anchor
        )
        for high, positive, _ in [r for r in ranked if r[2]][:5]:
            fits = [r for r in ranked if not r[2] and 80 * -high <= 100 * -r[0] <= 100 * -high][:5]
            out += [
                (anchor, positive, rank, i, -high, -low)
                for rank, (low, i, _) in enumerate(fits, 1)
            ]
    return sorted(out)


def vectors(seed, count, spread):
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(count):
        body = np.round(draw.normal(size=6) * spread + (0.4 if i % 3 else -0.4), 2)
        rows.append((i * 5, body.tolist(), int(draw.integers(0, 4))))
    return rows


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
@pytest.mark.parametrize("spread", [0.05, 0.3])
def test_matches_brute_force(spark, block_bytes, spread):
    rows = vectors(1, 300, spread)
    rows += [(i, [0.5] * 6, i % 3) for i in range(3001, 3120)]  # one very common vector
    rows += [(i, [0.5] * 6, 1) for i in (3200, 3300)]
    rows += rows[20:24] + [(100, [0.1] * 6, 1), (100, [0.2] * 6, 1)]  # repeated rows and ids
    rows += [
        (None, [0.5] * 6, 1), (4000, None, 1), (4100, [0.5] * 6, None), (4200, [0.5, None], 1),
        (4300, [math.nan] * 6, 1), (4400, [math.inf] * 6, 1), (4500, [], 1), (4600, [0.9], 2),
        (4700, [0.4] * 9, 2), (-100, [0.5] * 6, 0),
    ]
    table = spark.createDataFrame([(*r, "?", "?", "?") for r in rows], SCHEMA).repartition(3)
    got = hard_negatives(table, Scratch(spark), block_bytes=block_bytes)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_lone_anchor_and_empty_table(spark):
    table = spark.createDataFrame([(100, [0.5], 1, "", "", "")], SCHEMA)
    assert hard_negatives(table, Scratch(spark)).count() == 0
    out = hard_negatives(table.limit(0), Scratch(spark))
    assert out.count() == 0 and out.columns[0] == "anchor_id"


@pytest.mark.parametrize("size", [10, 1 << 15, 1 << 28, 1 << 31, 1 << 40])
def test_products_are_exact(size):
    draw = np.random.default_rng(size)
    left, right = (draw.integers(-size, size, (5, 8)) for _ in range(2))
    want = left.astype(object) @ right.T.astype(object)
    most = (1 << 63) - 1
    assert (products(left, right) == np.clip(want, -most, most).astype(np.int64)).all()


def test_windows_open_and_close_in_key_order():
    def key(anchor, score, kind, row):
        flip = 1 << 63
        return KEY.pack(anchor + flip, flip - 1 - score, kind, row + flip), None

    rows = [(1, 100, 0, 5), (1, 100, 1, 2), (1, 90, 0, 7), (1, 75, 1, 3), (1, 70, 1, 4), (2, 60, 1, 9)]
    keys = [key(*row) for row in rows]
    assert keys == sorted(keys)
    assert list(windows(iter(keys))) == [(1, 5, 1, 2, 100, 100), (1, 7, 1, 3, 90, 75)]
    assert list(windows(iter(()))) == []
