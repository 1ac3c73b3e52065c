"""Exact dedup, n-gram join, substring dedup and decontamination against brute force."""

import hashlib
import re

import pyarrow.parquet as pq
import pytest
from helpers import corpus, edited, frame, row_set, sentence
from pyspark.sql import functions as F

from evidgrid.llm import decontaminate
from evidgrid.llm.common import Scratch, join_keys
from evidgrid.llm.decontaminate import build_index, contamination, search
from evidgrid.llm.exact_dedup import exact_dedup, mark_copies
from evidgrid.llm.jaccard_join import one_of_each, similar_documents
from evidgrid.llm.substring_dedup import repeated_spans

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("chunk_rows", [1_000, 2])
def test_exact_dedup_matches_groups(spark, chunk_rows):
    rows = corpus() + [(100 + i, "Copy  of a text") for i in range(9)]
    out = mark_copies(frame(spark, rows), Scratch(spark), chunk_rows=chunk_rows).collect()
    groups: dict[str, list] = {}
    for doc, text in rows:
        groups.setdefault((text or "").translate(ASCII), []).append(doc)
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        want += [(i, keep, len(ids), sha) for i in ids]
    got = [(r.row.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = [(r.row.doc_id, r.text_sha256) for r in out if r.kept]
    assert len(kept) == len(groups) and {k for k, _ in kept} == {
        max((i for i in ids if i is not None), default=None) for ids in groups.values()
    }


def test_exact_dedup_keeps_columns_and_smallest(spark):
    docs = frame(spark, corpus())
    out = exact_dedup(docs, keep="smallest")
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert 10 in ids and 11 not in ids and ids.count(50) == 1
    assert exact_dedup(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mark_copies(docs, Scratch(spark), keep="first")


def shingles(text):
    ws = plain_words((text or "").translate(ASCII))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + 4]) for i in range(max(1, len(ws) - 3)))


def brute_components(rows):
    sets = [shingles(text) for _, text in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                label[find(i)] = find(j)
    lowest: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            lowest[find(i)] = min(doc, lowest.get(find(i), doc))
    return [(doc, len(sets[i]), lowest.get(find(i))) for i, (doc, _) in enumerate(rows)]


def test_jaccard_join_matches_brute_force(spark):
    base = sentence(20, 150)
    near = [(200 + i, edited(base, [3 * i % 150, (7 * i + 40) % 150])) for i in range(40)]
    edge = [(300 + i, edited(sentence(21, 100), list(range(i)))) for i in range(12)]
    rows = corpus() + near + edge
    docs = frame(spark, rows)
    scratch = Scratch(spark)
    out = similar_documents(docs, scratch).collect()
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in out]
    assert sorted(got, key=str) == sorted(brute_components(rows), key=str)
    kept = one_of_each(docs, Scratch(spark))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(i for i in ids if i is not None) == {
        r.doc_id for r in out if r.component_id == r.doc_id and r.doc_id is not None
    }
    # The near copies are one component although many pairs of them are too different.
    assert len({r.component_id for r in out if r.doc_id and 200 <= r.doc_id < 240}) < 40


def test_jaccard_join_of_an_empty_table(spark):
    assert similar_documents(frame(spark, []), Scratch(spark)).count() == 0


def brute_spans(rows, size):
    first: dict[tuple, int] = {}
    for doc, text in rows:
        ws = plain_words(text)
        for i in range(len(ws) - size + 1 if doc is not None else 0):
            key = tuple(ws[i : i + size])
            first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, text in rows:
        ws = plain_words(text)
        gone = set()
        for i in range(len(ws) - size + 1 if doc is not None else 0):
            if first[tuple(ws[i : i + size])] < doc:
                gone.update(range(i, i + size))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((doc, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_dedup_matches_brute_force(spark):
    loop = "la di da " * 40
    rows = corpus() + [(60, loop), (61, f"{sentence(30, 20)} {loop}"), (62, sentence(31, 50))]
    rows += [(63, f"{sentence(31, 50)} tail"), (9, edited(sentence(1, 200), [120]))]
    out = repeated_spans(frame(spark, rows), Scratch(spark)).collect()
    got = row_set(out, "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute_spans(rows, 50), key=str)
    for r in out:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:], strict=False))


def test_substring_dedup_other_window_and_empty(spark):
    rows = [(1, "a b c d"), (2, "x a b c y"), (3, "a b"), (4, "b c d a b c")]
    out = repeated_spans(frame(spark, rows), Scratch(spark), size=3).collect()
    got = row_set(out, "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute_spans(rows, 3), key=str)
    assert repeated_spans(frame(spark, []), Scratch(spark)).count() == 0


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))


def brute_contamination(rows, items):
    out = []
    for doc, text in rows:
        ws, hit, found = item_words(text), set(), set()
        for item, passage in items:
            iw = item_words(passage)
            n = min(13, len(iw))
            windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for i in range(len(ws) - n + 1 if n else 0):
                if tuple(ws[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    if item is not None:
                        found.add(str(item))
        out.append(
            (doc, len(ws), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(ws))
        )
    return out


ITEMS = [
    (1, f"Intro, {sentence(2, 30)}!"),
    (2, "Two WORDS"),
    (3, None),
    (4, "..."),
    (5, sentence(8, 14)),
    (5, sentence(9, 13)),
    (None, sentence(7, 40)),
    (11, sentence(1, 12)),
]


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 40])
def test_contamination_matches_brute_force(spark, block_words, monkeypatch):
    monkeypatch.setattr(
        decontaminate,
        "search",
        lambda index, benchmark, scratch: search(
            index, benchmark, scratch, block_words=block_words
        ),
    )
    docs = frame(spark, corpus())
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    out = contamination(docs, items, Scratch(spark)).collect()
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in out]
    assert sorted(got, key=str) == sorted(brute_contamination(corpus(), ITEMS), key=str)


def test_clean_rows_stay_with_their_columns(spark):
    docs = frame(spark, corpus())
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    out = decontaminate.keep_clean(docs, items, Scratch(spark))
    assert out.columns == docs.columns
    want = [row[0] for row in brute_contamination(corpus(), ITEMS) if not row[4]]
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted(want, key=str)
    assert decontaminate.keep_clean(docs, items.limit(0), Scratch(spark)).count() == docs.count()
    assert decontaminate.keep_clean(docs.limit(0), items, Scratch(spark)).count() == 0


@pytest.mark.parametrize("size, most", [(2_100_000, 4), (9_000_000, 1)])
def test_row_groups_of_the_index_hold_few_segments(spark, size, most):
    text = F.repeat(F.when(F.col("id") >= 0, "ab cd ef "), size // 9)
    docs = spark.range(6, numPartitions=1).select(F.col("id").alias("doc_id"), text.alias("text"))
    scratch = Scratch(spark)
    index = build_index(docs, scratch)
    files = [pq.ParquetFile(path.removeprefix("file:")) for path in index.inputFiles()]
    groups = [f.metadata.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert sum(groups) == 6 and max(groups) <= most
    items = spark.createDataFrame([(1, "ef ab cd")], "item_id bigint, text string")
    out = search(index, items, scratch).collect()
    words = size // 9 * 3
    assert sorted((r.doc_id, r.n_words, [tuple(run) for run in r.runs]) for r in out) == [
        (doc, words, [(2, words - 1)]) for doc in range(6)
    ]


def test_proximity_match(spark):
    docs = frame(spark, [(1, "one two three four five"), (2, "one two xx three four five")])
    items = spark.createDataFrame([(1, "one two three four five")], "item_id bigint, text string")
    index = build_index(docs, Scratch(spark))
    exact = {r.doc_id: len(r["items"]) for r in search(index, items, Scratch(spark)).collect()}
    near = {
        r.doc_id: len(r["items"]) for r in search(index, items, Scratch(spark), slop=1).collect()
    }
    assert exact == {1: 1, 2: 0} and near == {1: 1, 2: 1}


def test_key_joins_agree_with_and_without_broadcast(spark):
    docs = frame(spark, corpus())
    keys = spark.createDataFrame([(10,), (50,)], "doc_id bigint")
    for how in ("left_semi", "left_anti"):
        both = [join_keys(docs, keys, "doc_id", how, most).count() for most in (1_000, 1)]
        assert both[0] == both[1]
