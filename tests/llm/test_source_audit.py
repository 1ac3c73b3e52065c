"""Source divergence audit against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from helpers import corpus

from evidgrid.llm.common import Scratch
from evidgrid.llm.source_audit import leaders, source_audit

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n string, kept string"


def brute(rows, least, top):
    rows = [(text or "", lang or "", source or "") for _, text, lang, source in rows]
    words = [
        re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(ASCII)) for text, _, _ in rows
    ]
    found = {}
    for lang in {r[1] for r in rows}:
        documents, total = Counter(), Counter()
        groups = {}
        for ws, row in zip(words, rows):
            if row[1] == lang:
                documents.update(set(ws))
                total.update(ws)
                groups.setdefault(row[2], Counter()).update(ws)
        kept = [t for t in documents if documents[t] >= least]
        v = len(kept)

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * v) for t in kept}

        by_group = {source: shares(counts) for source, counts in groups.items()}
        whole = shares(total)
        for source, p in by_group.items():
            pairs = [
                (-sum(abs(p[t] - q[t]) for t in kept), other.encode())
                for other, q in by_group.items()
                if other != source
            ]
            terms = [
                (whole[t] - p[t], t.encode())
                for t in kept
                if groups[source][t] > 0 and p[t] > whole[t]
            ]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                for rank, (value, item) in enumerate(ranked, 1):
                    found[lang, source, part, item.decode(), -value, rank] = 1
    return sorted(found)


def awkward_rows():
    draw = np.random.default_rng(5)
    vocabulary = [a + b for a in "abcdefgh" for b in "abcdefghi"] + ["Ärger", "ärger", "日本", "zé"]
    rows = []
    for i in range(240):
        source = ["hot", "hot", "s1", "s2", "s3"][i % 5]
        weights = np.ones(len(vocabulary))
        weights[(len(source) * 7 + i % 3) :: 11] += 6
        picked = draw.choice(vocabulary, size=int(draw.integers(0, 60)), p=weights / weights.sum())
        rows.append((i, " ".join(picked) + " 12-x Ab'cd", "en" if i % 4 else "de", source))
    rows += [(i, text, None, "hot") for i, text in corpus()]
    rows += [(1, "ab ab ac", "fr", "only"), (2, None, "fr", None), (3, "", "fr", "none")]
    return rows + rows[-3:] * 2


@pytest.mark.parametrize(("least", "top"), [(1, 4), (3, 50), (30, 6), (500, 50)])
def test_audit_matches_brute_force(spark, least, top):
    rows = awkward_rows()
    docs = spark.createDataFrame([(*r, "?", "?", "?") for r in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in source_audit(docs, Scratch(spark), least, top).collect()]
    assert sorted(got) == brute(rows, least, top)


def test_empty_table(spark):
    out = source_audit(spark.createDataFrame([], SCHEMA), Scratch(spark))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.count() == 0


def test_skyband_drops_only_rows_behind_enough_others():
    draw = np.random.default_rng(3)
    rows = sorted(
        {
            (-int(draw.integers(0, 12)), int(draw.integers(0, 20)), f"{t:03d}")
            for t in draw.permutation(400)
        }
    )
    band = {"totals": np.empty(0, np.int64), "terms": []}
    kept = []
    for start in range(0, len(rows), 37):
        part = rows[start : start + 37]
        stay = leaders(np.array([r[1] for r in part]), [r[2] for r in part], 5, band)
        kept += [r for r, s in zip(part, stay) if s]
    behind = {
        r: sum(o[0] <= r[0] and o[1] <= r[1] and o[2] < r[2] for o in rows) for r in rows
    }
    assert kept == [r for r in rows if behind[r] < 5]
