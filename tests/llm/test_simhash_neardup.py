"""SimHash near duplicates against brute force."""

import re

import numpy as np
import pytest
import xxhash
from helpers import corpus, frame, sentence

from evidgrid.llm.common import Scratch
from evidgrid.llm.simhash_neardup import (
    apart, forest, grow, near_duplicates, near_links, routes, unparted, united,
)

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    runs = [ws[i : i + 3] for i in range(len(ws) - 2)] or ([ws] if ws else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(run).encode(), 42) for run in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(points, distance=3):
    left, right = [], []
    for i, point in enumerate(points):
        near = np.flatnonzero(apart(point, points) <= distance)
        left.append(np.full(len(near), i))
        right.append(near)
    return united(len(points), np.concatenate(left), np.concatenate(right))


def flipped(points, bits, draw):
    points = points.copy()
    for _ in range(bits):
        points ^= np.uint64(1) << draw.integers(0, 64, len(points)).astype(np.uint64)
    return points


def clouds(seed=1, count=700):
    """Lone points, chains of near ones, and a dense ball."""
    draw = np.random.default_rng(seed)
    base = draw.integers(0, 1 << 63, count).astype(np.uint64) << np.uint64(1)
    parts = [base, [np.uint64(0), ~np.uint64(0)]]
    for bits in (1, 2, 3, 4):
        parts.append(flipped(base[: count // 3], bits, draw))
    parts.append(flipped(np.full(2 * count, base[0]), 4, draw))
    parts.append(flipped(flipped(base[:100], 3, draw), 3, draw))
    return np.unique(np.concatenate(parts))


def test_documents_match_brute_force(spark):
    rows = corpus() + [(200 + i, sentence(70 + i, 40)) for i in range(30)]
    rows += [(300 + i, f"{sentence(1, 200)} tail{i}") for i in range(40)]
    got = near_duplicates(frame(spark, rows), Scratch(spark)).collect()
    points = np.array([fingerprint(text) for _, text in rows], np.uint64)
    label = brute(points)
    want = []
    for (doc, _), point, own in zip(rows, points, label):
        ids = [rows[j][0] for j in np.flatnonzero(label == own) if rows[j][0] is not None]
        want.append((doc, f"{int(point):016x}", min(ids, default=None)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert len({r.component_id for r in got}) > 20


def test_empty_table(spark):
    out = near_duplicates(frame(spark, corpus()).limit(0), Scratch(spark))
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0


def test_forest_matches_brute_force():
    points = clouds()
    assert (forest(points, 3) == brute(points)).all()
    assert len(forest(points[:0], 3)) == 0 and forest(points[:1], 3).tolist() == [0]


def test_points_that_cannot_be_parted():
    points = clouds(2, 300)
    links = list(unparted(points, np.arange(len(points)), 3))
    label = united(len(points), *[np.concatenate(side) for side in zip(*links)])
    assert (label == brute(points)).all()


def test_every_near_pair_meets_in_a_shard():
    points = clouds(3, 400)
    tree, shards = grow(points[::3], 16, 3)
    held = [set(part.tolist()) for _, part in routes(tree, points, 3)]
    assert shards > 8 and max(map(len, held)) < len(points)
    for point in points:
        for other in points[apart(point, points) <= 3]:
            assert any(int(point) in part and int(other) in part for part in held)


@pytest.mark.parametrize(("sample", "shard", "most"), [(1 << 17, 1 << 18, 1 << 21), (300, 64, 100)])
def test_shards_and_parts_lose_no_link(spark, sample, shard, most):
    points = clouds(4)
    table = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp bigint")
    links = near_links(table, Scratch(spark), 3, sample, shard, most).collect()
    place = {int(p): i for i, p in enumerate(points.view(np.int64))}
    a, b = (np.array([place[r[c]] for r in links]) for c in ("a", "b"))
    assert (united(len(points), a, b) == brute(points)).all()
    assert (apart(points[a], points[b]) >= 1).all()
