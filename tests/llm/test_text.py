"""License scan, HTML extraction, byte-level BPE and personal data."""

import base64
import random
import re
import tracemalloc

import numpy as np
import pytest
from helpers import corpus, frame, sentence, words

from evidgrid.llm import pii
from evidgrid.llm.byte_bpe import LONG_PIECE, Encoder, Vocabulary, decode, encode, round_trip
from evidgrid.llm.common import Scratch
from evidgrid.llm.html_extract import Page, main_texts
from evidgrid.llm.license_scan import KNOWN, MIT, NEEDED, canonical_text, scan

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# --- licenses -------------------------------------------------------------------------------------


def test_license_units(spark):
    variant = "copyright (c) 2001 Someone\n" + MIT.upper().replace(",", " ;")
    rows = corpus() + [
        (1, "Released under the MIT License."),
        (2, "released  under -- the MIT licence"),
        (3, variant),
        (7, f"Words first.\n\nReleased under\n the MIT License.\n \nWords after."),
        (4, "Licensed under the Apache License, Version 2.0.\nText.\nAll rights reserved."),
        (5, "This text says license and no more"),
        (6, MIT),
    ]
    out = {r.doc_id: r for r in scan(frame(spark, rows)).collect()}
    assert out[1].whole_license == out[2].whole_license == out[6].whole_license == "MIT"
    assert (out[3].whole_license, out[3].n_units, out[3].licenses) == ("MIT", 1, "MIT")
    assert (out[7].whole_license, out[7].licenses) == (None, "MIT")
    assert (out[4].n_units, out[4].licenses) == (2, "Apache-2.0,all-rights-reserved")
    assert (out[5].n_units, out[5].licenses) == (0, "")
    assert sum(r.n_units for i, r in out.items() if i not in (1, 2, 3, 4, 6, 7)) == 0
    assert scan(frame(spark, rows)).count() == len(rows)
    assert scan(frame(spark, [])).count() == 0


def test_every_known_text_has_a_needed_word():
    for texts in KNOWN.values():
        for text in texts:
            assert any(word in canonical_text(text) for word in NEEDED)


def test_whole_texts_of_more_licenses(spark):
    names = [name for name in KNOWN if len(KNOWN[name][-1]) > 1_000]
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0", "MPL-2.0", "Unlicense"} <= set(names)
    rows = [(i, f"Copyright (c) 2020 Someone\n\n{KNOWN[name][-1].upper()}") for i, name in enumerate(names)]
    out = {r.doc_id: r for r in scan(frame(spark, rows)).collect()}
    assert [out[i].whole_license for i in range(len(names))] == names


def test_known_texts_as_an_argument(spark):
    texts = [("Own'1", "You may use this freely."), ("Own-2", "Per cent favour"), ("Own-3", "©é"), ("No", " -")]
    rows = [(1, "you MAY use, this freely"), (2, "percent favor"), (3, "x\n\n É\n\n©É\né"), (4, MIT), (5, "--")]
    for count in (1, 2, 4):
        known = spark.createDataFrame(texts[:count], "license string, text string")
        out = {r.doc_id: r for r in scan(frame(spark, rows), known).collect()}
        assert out[1].whole_license == "Own'1"
        assert out[2].whole_license == ("Own-2" if count > 1 else None)
        assert out[4].licenses == out[5].licenses == ""
    assert scan(frame(spark, rows), known.limit(0)).count() == len(rows)


def test_published_short_notices(spark):
    lines = [
        ("// SPDX-License-Identifier: MIT", "MIT"),
        ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
        ("This project is licensed under the MIT License", "MIT"),
        ("This software is released under the Apache License v2.0", "Apache-2.0"),
        ("Distributed under the GNU Lesser General Public Licence, version 2.1.", "LGPL-2.1"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        ("License: CC0 1.0 Universal", "CC0-1.0"),
        ("Licensed under the Mozilla Public License, v. 2.0", None),
        ("This project is licensed under the MITRE License", None),
        ("The software has a license", None),
    ]
    out = {r.doc_id: r for r in scan(frame(spark, [(i, line) for i, (line, _) in enumerate(lines)])).collect()}
    assert [out[i].whole_license for i in range(len(lines))] == [name for _, name in lines]


def test_known_texts_with_many_words_of_their_own(spark, monkeypatch):
    monkeypatch.setattr("evidgrid.llm.license_scan.MOST_WORDS", 3)
    known = spark.createDataFrame([(f"L{i}", f"only word{i} here") for i in range(9)], "license string, text string")
    out = {r.doc_id: r for r in scan(frame(spark, [(i, f"Only  WORD{i} here.") for i in range(10)]), known).collect()}
    assert [out[i].whole_license for i in range(10)] == [f"L{i}" for i in range(9)] + [None]


# --- pages ----------------------------------------------------------------------------------------


def page(text: str, extra: str = "") -> str:
    return (
        '<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body>'
        "<nav><a href='/'>Home</a></nav><div class='ad-box'>Buy</div>"
        f"<article><h1>Head</h1>{text}<p>Share this page now</p>{extra}</article>"
        "<aside>side</aside><footer>&copy; foot</footer></body></html>"
    )


CASES = {
    "<p>One <b>two</b>three &amp; four</p>": "One twothree & four",
    "<p>a<br>b<p>c\n\n d</p>": "a b c d",
    "<p><b>open<p>next</p>": "open next",
    "<div class='comments'><p>no</p></div><p>yes</p>": "yes",
    "<p>x &lt; y &#233; &am</p><!-- <p>no</p> -->": "x < y é &am",
    "<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>": "a b c d",
    "<form>no<input></form><section><p>in</p></section>": "in",
    "<p title='a>b'>attr</p><style>p{}</style>": "attr",
}


@pytest.mark.parametrize(("source", "want"), CASES.items())
def test_main_text_of_one_page(source, want):
    assert Page(page(source)).main_text(None) == f"Head {want} Share this page now"


def test_pages_without_article_and_broken_pages():
    assert Page("").main_text(None) == ""
    assert Page("plain <b>text").main_text(None) == "plain text"
    assert Page("<body><header>no</header><p>yes</p>").main_text(None) == "yes"
    assert Page("<p>cut <a href=\"x").main_text(None).startswith("cut")
    assert Page("</p></div></nav>a</b>").main_text(None) == "a"


@pytest.mark.parametrize(
    "source",
    [
        '<html class="no-ads"><body class="has-sidebar"><p>text</p></body></html>',
        '<body class="sidebar"><article id="comments" class="post comments-open">text</article></body>',
        '<div id="page" class="header-fixed"><p>text</p></div>',
        '<div class="widget"><div class="search"><article>text</article></div></div>',
        '<div class="social">no<main id="search-results" class="search" role="form">text</main></div>',
        '<main id="search"><div class="related">no<article>text</article></div></main>',
        '<article>text</article><div class="related"><article>no</article></div>',
        '<article>text<div class="comments"><article>no</article></div></article>',
        '<p>text</p><div class="cookie-banner">no</div>',
    ],
)
def test_names_take_no_whole_article(source):
    assert Page(source).main_text(None) == "text"


@pytest.mark.parametrize(
    "name",
    "comment-list commentlist user-comments disqus_thread ad-slot ad_300x250 main-nav left-sidebar "
    "site-footer comments cookie-banner".split(),
)
def test_outside_names_with_places(name):
    assert Page(f'<article>text<div class="{name}">no</div></article>').main_text() == "text"
    assert Page(f'<div class="{name}">no</div><p>text</p>').main_text() == "text"


@pytest.mark.parametrize(
    "source",
    [
        '<article><p class="search">text</p></article>',
        '<section class="form">text</section>',
        '<article><pre><span class="token comment">text</span></pre></article>',
        '<div class="site-header">no</div><div class="post-header">text</div>',
        '<div class="main-content">text</div>',
        '<article>a</article><div id="content">text text text text</div><ul><li><a>no</a></ul>',
    ],
)
def test_names_and_teasers_lose_no_text(source):
    assert "text" in Page(source).main_text()


def test_deep_pages_take_memory_in_proportion():
    def peak(count: int) -> int:
        source = "<div>" + "<font size='2'>w " * count + "</td>" * count
        tracemalloc.start()
        assert len(Page(source).main_text()) == 2 * count - 1
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(20_000) < 2.5 * peak(10_000)


def test_slots_of_links_and_little_text_are_not_main(spark):
    def unnamed(host: str, i: int, beside: str) -> tuple[int, str, str]:
        links = "".join(f"<a href='/{w}'>{w}</a> " for w in words(500 + i, 6))
        body = (
            f"<div id='a'><div class='x'>{links}</div></div><div class='y'><h2>Title {i}</h2></div>"
            f"<div class='z'><p>{sentence(i, 80)}</p><p>{sentence(900 + i, 40)}</p></div>"
            f"<div class='w'>{beside}</div>"
        )
        return i, f"https://{host}/{i}", body

    rows = [unnamed("h.example", i, f"user{i}") for i in range(8)]
    rows += [unnamed("two.example", 20 + i, f"user{i}") for i in range(2)]
    rows.append((30, "https://t.example/1", f"<article>a teaser</article><div><p>{sentence(3, 50)}</p></div>"))
    docs = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    found = {r.page_id: r.text for r in main_texts(docs, Scratch(spark)).collect()}
    # Menus and user names stand in slots of their own, on hosts of two pages too.
    for i in [*range(8), 20, 21]:
        assert found[i] == f"Title {i} {sentence(i, 80)} {sentence(900 + i, 40)}"
    assert found[30] == f"a teaser {sentence(3, 50)}"


def test_shared_text_of_two_pages_stays_in_articles_and_near_copies(spark):
    shared = f"<p>{sentence(60, 60)}</p>"
    rows = [(i, "https://a.example/", f"<article><p>{sentence(i, 30)}</p>{shared}</article>") for i in (1, 2)]
    rows += [(i, "https://n.example/", f"<div>{shared}</div><div><p>{sentence(i, 9)}</p></div>") for i in (3, 4)]
    docs = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for row in main_texts(docs, Scratch(spark)).collect():
        assert sentence(60, 60) in row.text and sentence(row.page_id, 9) in row.text


def test_header_of_an_article_stays():
    for header in ("<header>", "<header class='entry-header'>", "<header class='header'>"):
        source = f"<header>no</header><article>{header}<h1>Head</h1></header><p>text</p></article>"
        assert Page(source).main_text(None) == "Head text"


def test_template_text_goes_and_slots_stay(spark):
    rows = [(i, f"https://h.example/{i}", page(f"<p>{sentence(i, 9)}</p>"), "?") for i in range(8)]
    rows += [(100 + i, "https://other.example/", page(f"<p>{sentence(i, 9)}</p>"), "?") for i in (1, 2)]
    rows += [(200, None, None, "?"), (None, "no url", "", "?"), (0, rows[0][1], rows[0][2], "?")]
    rows.append((300, "https://h.example/long", page(f"<p>{sentence(5, 50_000)}</p>"), "?"))
    docs = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    out = main_texts(docs, Scratch(spark)).collect()
    assert len(out) == len(rows)
    found = {r.page_id: r for r in out}
    # Blocks of an article that most pages of a host share are template text; two pages show no such thing.
    assert found[3].text == sentence(3, 9)
    assert found[101].text == f"Head {sentence(1, 9)} Share this page now"
    assert found[200].text == "" and found[200].n_chars == 0 and found[None].text == ""
    assert found[300].n_chars == len(sentence(5, 50_000)) and found[300].url.endswith("long")
    assert main_texts(docs.limit(0), Scratch(spark)).count() == 0


def test_copies_count_as_one_page(spark):
    own = "<p>first block</p><p>second block</p>"
    rows = [(i, f"https://h.example/{i % 3}", f"<article>{own}</article>") for i in range(7)]
    rows += [(10 + i, f"https://h.example/o{i}", f"<p>{sentence(i, 9)}</p>") for i in range(3)]
    rows += [(20 + i, "https://h.example/x", f"<p>{sentence(20, 9)}</p>") for i in range(2)]
    # Another host: copies of one page do not hide the template of the others.
    rows += [
        (100 + i, f"https://t.example/{i}", f"<p>Top</p><p>{sentence(min(i, 7), 9)}</p><p>End</p>")
        for i in range(20)
    ]
    docs = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    found = {r.page_id: r.text for r in main_texts(docs, Scratch(spark)).collect()}
    assert len(found) == len(rows)
    assert all(found[i] == "first block second block" for i in range(7))
    assert found[11] == sentence(1, 9) and found[20] == found[21] == sentence(20, 9)
    assert all(found[100 + i] == sentence(min(i, 7), 9) for i in range(20))


# --- byte-level BPE -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference_encoder():
    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_encoding_matches_the_library(reference_encoder):
    draw = random.Random(3)
    texts = ["", "a" * (LONG_PIECE * 2), "ab" * LONG_PIECE, " " * 5_000 + "x", "<|endoftext|> it's"]
    texts += ["é漢😀" * 900, "\n\n\t \x1c\x85 　z", "12 345 ½Ⅷ don't"]
    texts += ["".join(draw.choices("aeiost hn,.1\né漢😀'", k=draw.randint(0, 900))) for _ in range(80)]
    encoder = Encoder(Vocabulary.read(VOCABULARY, public_tokenizers.PATTERN))
    for _ in range(2):  # fresh and remembered pieces
        flat, counts = encoder.encode([t.encode() for t in texts])
        ends = counts.cumsum()
        for text, end, count in zip(texts, ends, counts, strict=True):
            assert flat[end - count : end].tolist() == reference_encoder.encode_ordinary(text)


def test_round_trip_of_a_table(spark, reference_encoder):
    rows = corpus()
    out = round_trip(frame(spark, rows), VOCABULARY, public_tokenizers.PATTERN).collect()
    got = sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in out), key=str)
    want = [(i, reference_encoder.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    assert got == sorted(want, key=str)
    vocabulary = Vocabulary.read(VOCABULARY, public_tokenizers.PATTERN)
    apart = decode(encode(frame(spark, rows), vocabulary), vocabulary).collect()
    assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in apart), key=str) == got
    assert encode(frame(spark, []), vocabulary).count() == 0


def test_vocabulary_needs_all_bytes():
    with pytest.raises(ValueError):
        Vocabulary({b"a": 0}, "a")


# --- personal data --------------------------------------------------------------------------------

BASE = (
    (0, re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda t: True),
    (
        1,
        re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        lambda t: all(int(p) <= 255 for p in t.split(".")),
    ),
    (
        2,
        re.compile(r"[0-9]([\x20-]?[0-9])+"),
        lambda t: 13 <= len(pii.digits(t)) <= 19 and pii.luhn(pii.digits(t)),
    ),
    (
        3,
        re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
        lambda t: 9 <= len(pii.digits(t)) <= 15,
    ),
)


def test_base_spans_match_the_patterns():
    draw = random.Random(4)
    texts = ["a@b@c.d.e@f.g", "1.2.3.4.5.6.7.8.9", "x" * 50_000 + "@", "1" * 5_000, "00255.1.1.1"]
    texts += ["4111 1111-1111 1111", "+1 (274) 555-9629 1.2.3.4", "a@b.c@d.e", "é+49 123-456 789é"]
    texts += ["".join(draw.choices("ab@.@1234567890 -+().é", k=draw.randint(0, 60))) for _ in range(4_000)]
    for text in texts:
        want = [
            (kind, m.start(), m.end())
            for kind, pattern, valid in BASE
            for m in (pattern.finditer(text) if len(text) < 1_000 else ())
            if valid(m.group())
        ]
        assert len(text) >= 1_000 and pii.base_spans(text) == [] or pii.base_spans(text) == want


def test_tagger_learns_and_adds_spans(spark):
    draw = random.Random(5)

    def person(i: int) -> str:
        name = f"{sentence(i, 1)}.{draw.randint(10, 99)}"
        phone = f"({draw.randint(200, 999)}) 555-{draw.randint(1000, 9999)}"
        return f"{name}@mail{i % 7}.example.com or +1 {phone} or 10.0.{i % 200}.{draw.randint(1, 99)}"

    rows = corpus() + [
        (1_000 + i, f"{sentence(i, 12)} {person(i)} {sentence(i + 1, 9)}") for i in range(150)
    ]
    tagger = pii.train(frame(spark, rows), Scratch(spark))
    spelled = f"{sentence(1, 9)} abc.42 (at) mail3.example.com {sentence(2, 9)}"
    national = f"{sentence(3, 9)} (274) 555-9629 {sentence(4, 9)}"
    rows += [(1, spelled), (2, national), (3, f"{sentence(5, 30)} 2024 and 7 {sentence(6, 30)}")]
    docs = frame(spark, rows)
    out = {r.doc_id: r for r in pii.personal_data(docs, tagger).collect()}
    for doc, text in rows:
        if doc is not None:
            named = [(pii.KINDS.index(s.kind), s.start, s.end) for s in out[doc].base]
            assert named == pii.base_spans(text or "")
            assert set(out[doc].base) <= set(out[doc].spans)
    added = [s for i in (1, 2) for s in out[i].spans]
    assert added and {s.kind for s in added} <= {"email", "phone"}
    assert out[3].spans == [] and out[40].spans == []
    assert pii.train(frame(spark, [(1, "no data")]), Scratch(spark)) is None
    assert pii.personal_data(frame(spark, []), None).count() == 0


def test_spelled_emails_of_letters_alone(spark):
    draw = random.Random(6)
    rows = [
        (i, f"{sentence(i, 12)} {sentence(2 * i, 1)}.{draw.randint(10, 99)}@mail{i % 7}.example.com "
            f"{sentence(i + 1, 9)} 4111-1111-1111-1111 and +1 (274) 555-{draw.randint(1000, 9999)} end")
        for i in range(300)
    ]
    tagger = pii.train(frame(spark, rows), Scratch(spark))
    found = 0
    for i in range(20):
        for form in ("jane.doe (at) example.com", "firstname.familyname (at) department.example2.org"):
            text = f"{sentence(i, 5 * i)} {form} {sentence(i + 1, 30)}"
            _, spans = next(pii.find_spans(tagger, [text]))
            at = text.index(form)
            found += (0, at, at + len(form)) in spans
    assert found >= 36
    for word in ("at", "AT"):
        assert pii.meets_checks(0, f"jane.doe {word} example.com")
    assert not pii.meets_checks(0, "whatever.com")


class Marker:
    """A tagger that labels everything but blanks as the inside of an email."""

    def decode(self, x):
        return np.array([np.where(row > 0, [2] * len(row), 0) * (row != 32) for row in x])


def test_skipped_windows_hold_no_span():
    long = f"{'a' * 400} (at) {'b' * 300}.org"
    prose = sentence(1, 90).replace("at", "xx")
    text = f"{prose} {long} {prose}"
    assert len(pii.window_starts(text)) == 2 and pii.window_starts(prose) == []
    middle = text.index("(at)")
    first, last = text.index("a" * 400), text.index(".org") + 3
    spans = pii.tag(Marker(), [text])[0]
    assert any(s <= first and e == first + 400 for _, s, e in spans)
    assert any(s == middle + 5 and e > last for _, s, e in spans)


def test_rewritten_numbers_are_not_patterns():
    draw = np.random.default_rng(1)
    for kind, text in ((2, "4111-1111-1111-1111"), (2, "4111111111111111"), (3, "+1 (274) 555-9629")):
        for _ in range(20):
            form = pii.rewritten(kind, text, draw)
            assert pii.base_spans(form) == [] and pii.meets_checks(kind, form)
