"""Main text of web pages by equivalence classes of template tokens.

Tokens of a page are its tags and its text blocks, each told apart by the path of open elements.
Over the pages of one host every token has an occurrence vector: how often it stands in which page.
Tokens with the same vector form an equivalence class; a class is kept if at least two pages and most
pages of the host have it. Classes that keep their order are nested by position into the host's template.

The template cuts every page into slots: a slot is what stands behind one token of a class, up to the
next token of the template. Words, linked words and headings of a slot are added up over the host. Slots
of running text are main, slots of links and of little text are not. The main text of a page is its
article; where a page has none, or only a teaser beside a larger text, it is the text of the main slots.
Text blocks of the template itself are no article text.

Equal pages of a host count once: each of n copies counts as the inverse of n modulo a prime, so that
the copies add up to exactly one and no page has to be chosen or moved.

A vector is never collected: pages, occurrences and a hash per page are added up, so a host with a third
of all pages is aggregated like any other, and so are the slots. Only the frequent tokens of a host, fewer
than some times the tokens of a page, meet in one place.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidgrid.llm.common import Scratch, join_keys, lean, text_slices

#: A class needs this many pages and this share of the host's pages, and so many tokens.
LEAST_PAGES, LEAST_SHARE, LEAST_TOKENS = 2, 0.6, 2
#: Pages that must share a block of an article to show that it is no text of the article: two pages may
#: well quote the same passage.
SURE_PAGES = 5
#: A main slot has at most this share of linked words, and a heading or this share of the words of the
#: host's largest slot.
MOST_LINKED, LEAST_WORDS = 0.5, 0.05
#: So many times the words of the articles must stand in main slots beside them to make them teasers.
TEASER = 3
#: Rows of all templates that may be broadcast; larger ones are joined by host.
BROADCAST_TOKENS = 500_000
#: Aggregates that a task holds before it passes them on.
HELD = 200_000
#: Hosts whose templates a task remembers.
HELD_HOSTS = 1_000

# Elements and names that hold no article text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
OUTSIDE = frozenset(
    "aside button dialog footer form head header iframe menu nav noscript object option select "
    "svg template textarea".split()
)
OUTSIDE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation "
    "search toolbar".split()
)
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising aside banner breadcrumb breadcrumbs "
    "comment commentlist comments consent cookie cookies disqus footer header login masthead menu modal "
    "nav navbar navigation newsletter notice notices notification pagination popup promo promoted "
    "promotion related replies reply respond share sharing sidebar social sponsor sponsored subscribe "
    "subscription toolbar widget widgets".split()
)
#: Parts of names that leave an outside name what it is.
PLACES = frozenset(
    "area bar block bottom box container global group inner item items left link links list main mobile "
    "outer page post primary reader right row secondary section site slot sticky story thread top unit "
    "user users wrap wrapper zone".split()
)
#: Parts that make a header one of a text.
OF_TEXT = frozenset("post story".split())
#: Elements that no class, id or role puts outside.
WHOLE = frozenset("html body main article".split())
#: Where a block stands: in the page, in an article under an outside name, outside by a name (an
#: article in it is free of that name), outside by its element.
INSIDE, UNDER, NAMED, OUT = range(4)
#: An element that ends others left open: the new tag, and what it closes.
ENDS = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|textarea|title|iframe|template)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attributes>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*+>?",
    re.S | re.I,
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIZE = re.compile(r"\d+(x\d+)?$")
ATTRIBUTE = re.compile(r"(class|id|role)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++)", re.I)
#: Sums over the pages of a host are taken modulo this prime.
PRIME = (1 << 61) - 1


@dataclass(slots=True)
class Block:
    """A text block: where it stands and how much of it is linked."""

    at: int  # number of its token
    text: str
    state: int
    article: int  # 1 in main, 2 in article
    heading: bool
    words: int
    linked: int


@dataclass(slots=True)
class Element:
    """An open element; ``path`` is a hash of all open elements down to it."""

    tag: str
    path: int
    state: int
    article: int
    link: bool
    home: int  # number of the nearest block element, itself included


class Page:
    """A parsed page: hashes of tags and text blocks in order.

    Work and memory grow with the page, however deep elements are nested or left open.
    """

    def __init__(self, source: str):
        self.tokens: list[int] = []
        self.blocks: list[Block] = []
        stack = [Element("", 0, INSIDE, 0, False, 0)]
        opened: Counter[str] = Counter()
        paths: dict[tuple[int, str], int] = {}
        pending: list[str] = []
        linked = 0
        place = stack[0]

        def flush() -> None:
            nonlocal linked
            if not pending:
                return
            words = "".join(pending).split()
            pending.clear()
            if words:
                text = " ".join(words)
                block = Block(
                    len(self.tokens), text, place.state, place.article, place.tag in HEADINGS,
                    len(words), min(linked, len(words)),
                )
                self.tokens.append(token_hash(f"{place.path}>{text}"))
                self.blocks.append(block)
            linked = 0

        def write(raw: str) -> None:
            nonlocal place, linked
            inner = stack[-1]
            if not pending:
                place = inner if inner.state >= NAMED else stack[inner.home]
            piece = html.unescape(raw)
            pending.append(piece)
            if inner.link:
                linked += len(piece.split())

        def close(level: int) -> None:
            for element in stack[level:]:
                opened[element.tag] -= 1
            del stack[level:]

        last = 0
        for found in PIECE.finditer(source):
            if found.start() > last:
                write(source[last : found.start()])
            last = found.end()
            tag = found["tag"]
            if not tag:
                continue
            tag = tag.lower()
            if tag in BLOCKS:
                flush()
            if found["end"]:
                if opened[tag] > 0:
                    level = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag)
                    if any(e.tag in BLOCKS or e.state >= NAMED for e in stack[level:]):
                        flush()
                    close(level)
                continue
            for closed in ENDS.get(tag, ()):
                if opened[closed] <= 0:
                    continue
                # Elements left open inside the closed one end with it, but no outer block does.
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == closed:
                        close(i)
                        break
                    if stack[i].tag in BLOCKS and stack[i].tag not in ENDS.get(tag, ()):
                        break
            outer = stack[-1]
            named = self._names(found["attributes"]) if found["attributes"] else ()
            if outer.state == OUT or tag in OUTSIDE and not (tag == "header" and outer.article):
                state = OUT
            elif tag in WHOLE:
                state = min(outer.state, UNDER) if tag == "article" else INSIDE
            elif self._excluded(tag, named, bool(outer.article)):
                state = NAMED
            else:
                state = outer.state
            if state >= NAMED > outer.state:
                flush()
            label = tag + "".join(f".{value}" for key, value in named if key == "class")
            path = paths.get((outer.path, label))
            if path is None:
                path = paths[outer.path, label] = token_hash(f"{outer.path}/{label}")
            self.tokens.append(path)
            if tag not in VOID:
                article = max(outer.article, int(tag == "main" or ("role", "main") in named))
                article = 2 if tag == "article" else article
                home = len(stack) if tag in BLOCKS else outer.home
                stack.append(Element(tag, path, state, article, outer.link or tag == "a", home))
                opened[tag] += 1
        if last < len(source):
            write(source[last:])
        flush()

    @staticmethod
    def _names(attributes: str) -> list[tuple[str, str]]:
        return [
            (key.lower(), value.strip("\"'").lower()) for key, value in ATTRIBUTE.findall(attributes)
        ]

    @staticmethod
    def _excluded(tag: str, named: Iterable[tuple[str, str]], article: bool) -> bool:
        """Whether a role, or a class or id made of outside names and places only, puts it outside."""
        for key, value in named:
            for token in value.split():
                if key == "role" and token in OUTSIDE_ROLES:
                    return True
                parts = [part for part in re.split("[-_]+", token) if part and not SIZE.match(part)]
                names = OUTSIDE_NAMES.intersection(parts)
                if not names or not all(part in names or part in PLACES for part in parts):
                    continue
                if names == {"header"} and (article or tag == "th" or OF_TEXT.intersection(parts)):
                    continue
                if names == {"comment"} and tag == "span":  # of program text
                    continue
                return True
        return False

    def placed(self, frame: Frame) -> Iterator[tuple[Block, int, int]]:
        """Every block with its slot, named by the template token before it, and its own mark."""
        slot, blocks = 0, iter(self.blocks)
        block = next(blocks, None)
        for at, token in enumerate(self.tokens):
            if block is None:
                return
            mark = frame.get(token, 0)
            if at == block.at:
                yield block, slot, mark
                block = next(blocks, None)
            if mark:
                slot = token

    def main_text(self, frame: Frame | None = None) -> str:
        """Blocks of the article that are no template text, joined in page order.

        Articles under an outside name (comments, related) count if the page has no other article.
        A page most of whose words are template text is a near copy and keeps them.
        """
        frame = frame or {}
        free = any(b.state == INSIDE and b.article == 2 for b in self.blocks)
        kept = [e for e in self.placed(frame) if e[0].state <= (INSIDE if free else UNDER)]
        own = [e for e in kept if e[0].article]
        main = [e for e in kept if not frame.get(e[1], 0) & MINOR]
        beside = sum(b.words - b.linked for b, _, mark in main if not b.article and not mark)
        if not own:
            chosen, dropped = main or kept, SHARED
        elif beside > TEASER * sum(b.words for b, *_ in own):
            chosen, dropped = [e for e in kept if e[0].article or not frame.get(e[1], 0) & MINOR], SURE
        else:
            chosen, dropped = own, SURE
        rest = [e for e in chosen if not e[2] & dropped]
        if 2 * sum(b.words for b, *_ in rest) < sum(b.words for b, *_ in chosen):
            rest = chosen
        return " ".join(b.text for b, *_ in rest)


#: Tokens of a host's template with what is known of them.
Frame = dict[int, int]
#: Marks of a template token: any; most pages share it; so many that it is no article text; the slot
#: behind it is not main.
FRAME, SHARED, SURE, MINOR = 1, 2, 4, 8


def token_hash(token: str) -> int:
    code = xxhash.xxh3_64_intdigest(token)
    return code - (1 << 64) if code >> 63 else code


def host() -> Column:
    url = F.coalesce("url", F.lit(""))
    return F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1))


def with_copies(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """host, html and the number of pages of the host with the same html."""
    marked = pages.select(
        host().alias("host"), F.xxhash64(F.coalesce("html", F.lit(""))).alias("mark"), "html"
    )
    several = scratch.save(
        marked.groupBy("host", "mark").agg(F.count("*").alias("copies")).where("copies > 1"), "copies"
    )
    counted = join_keys(marked, several, ["host", "mark"], "left")
    return counted.select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))


def occurrences(pages: DataFrame) -> DataFrame:
    """Partial aggregates of the occurrence vectors: one row per host, token and part of a task.

    ``pages`` has host, html and copies. ``pages``, ``total`` and ``vector`` are to be added up
    modulo ``PRIME``.
    """
    names = ["host", "token", "text", "pages", "total", "vector", "place"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}

        def emit() -> pa.RecordBatch:
            rows = [
                (host, token, text, *(value % PRIME for value in sums), place)
                for (host, token), (text, *sums, place) in held.items()
            ]
            held.clear()
            columns = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

        for batch, sources in text_slices(batches, "html"):
            hosts, copies = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for host, source, many in zip(hosts, sources, copies, strict=True):
                page = Page(source.decode())
                name, part = xxhash.xxh3_64_intdigest(source), pow(many, -1, PRIME)
                texts = {block.at for block in page.blocks}
                first: dict[int, int] = {}
                for i, token in enumerate(page.tokens):
                    first.setdefault(token, i)
                for token, count in Counter(page.tokens).items():
                    mark = xxhash.xxh3_64_intdigest(f"{name}:{count}".encode())
                    entry = held.setdefault(
                        (host, token), [first[token] in texts, 0, 0, 0, 0.0]
                    )
                    entry[1] += part
                    entry[2] += count * part
                    entry[3] += mark * part
                    entry[4] += first[token] / len(page.tokens) / many
                entry = held.setdefault((host, 0), [False, 0, 0, 0, 0.0])
                entry[1] += part
                if len(held) > HELD:
                    yield emit()
        if held:
            yield emit()

    return pages.select("host", "html", "copies").mapInArrow(
        lean(run),
        "host string, token bigint, text boolean, pages bigint, total bigint, vector bigint, "
        "place double",
    )


def added(name: str) -> Column:
    return (F.sum(F.col(name).cast("decimal(20,0)")) % F.lit(PRIME)).cast("long")


def nested(tokens: pd.DataFrame) -> pd.DataFrame:
    """Classes of one host with their parents; ``tokens`` are its frequent tokens.

    Tokens of a class are in the order of their mean place. A class whose places overlap those of
    another without lying in one of its gaps does not nest and is left out.
    """
    classes = []
    for _, rows in tokens.groupby(["vector", "pages", "total"], sort=True):
        if len(rows) >= LEAST_TOKENS:
            rows = rows.sort_values(["place", "token"])
            classes.append(rows)
    classes.sort(key=lambda rows: (-len(rows), rows["place"].iloc[0], rows["token"].iloc[0]))
    kept: list[pd.DataFrame] = []
    parents: list[int] = []
    for rows in classes:
        low, high = rows["place"].iloc[0], rows["place"].iloc[-1]
        parent, fits = -1, True
        for i, other in enumerate(kept):
            places = other["place"].to_numpy()
            if high < places[0] or low > places[-1]:
                continue
            gap = np.searchsorted(places, low, side="right")
            around = gap < len(places) and high <= places[gap]
            within = low <= places[0] and high >= places[-1]
            if around and gap:
                parent = i
            elif not within:
                # Text and tags of one frame stand side by side: they interleave as wholes.
                fits = bool(rows["text"].all()) or bool(other["text"].all())
            if not fits:
                break
        if fits:
            kept.append(rows)
            parents.append(parent)
    parts = [
        rows.assign(klass=i, parent=parent, rank=range(len(rows)))
        for i, (rows, parent) in enumerate(zip(kept, parents, strict=True))
    ]
    if not parts:
        return pd.DataFrame(columns=["host", "klass", "parent", "rank", "token", "text", "pages"])
    return pd.concat(parts)[["host", "klass", "parent", "rank", "token", "text", "pages"]]


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Template of every host: host, class, parent class, rank, token (hash), whether text, pages."""
    vectors = scratch.save(
        occurrences(with_copies(pages, scratch))
        .groupBy("host", "token")
        .agg(
            F.max("text").alias("text"),
            added("pages").alias("pages"),
            added("total").alias("total"),
            added("vector").alias("vector"),
            (F.sum("place") / added("pages")).alias("place"),
        )
        .where(F.col("pages") >= LEAST_PAGES),
        "vectors",
    )
    hosts = vectors.where("token = 0").select("host", F.col("pages").alias("all"))
    frequent = (
        vectors.where("token != 0")
        .join(hosts, "host")
        .where(F.col("pages") >= LEAST_SHARE * F.col("all"))
        .drop("all")
    )
    return scratch.save(
        frequent.groupBy("host").applyInPandas(
            nested,
            "host string, klass int, parent int, rank int, token bigint, text boolean, pages bigint",
        ),
        "templates",
    )


def frames(template: DataFrame, minor: DataFrame | None = None) -> DataFrame:
    """host, tokens and marks of its template; ``minor`` names the slots that are not main."""
    mark = F.lit(FRAME) + F.when(
        F.col("text"), SHARED + F.when(F.col("pages") >= SURE_PAGES, SURE).otherwise(0)
    ).otherwise(0)
    rows = template.select("host", "token", mark.alias("mark"))
    if minor is not None:
        slots = minor.select("host", F.col("slot").alias("token"), F.lit(MINOR).alias("minor"))
        rows = join_keys(rows, slots, ["host", "token"], "left").select(
            "host", "token", (F.col("mark") + F.coalesce("minor", F.lit(0))).alias("mark")
        )
    entry = F.struct("token", F.col("mark").cast("byte").alias("mark"))
    listed = rows.groupBy("host").agg(F.collect_list(entry).alias("frame"))
    return listed.select("host", "frame.token", "frame.mark")


def framed(pages: DataFrame, template: DataFrame, minor: DataFrame | None = None) -> DataFrame:
    """page_id, url, html, host, token, mark: every page with the template of its host."""
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", host().alias("host")
    )
    known = frames(template, minor)
    small = template.count() <= BROADCAST_TOKENS
    joined = keyed.join(F.broadcast(known) if small else known, "host", "left")
    return joined.select("page_id", "url", "html", "host", "token", "mark")


def parsed(
    batches: Iterable[pa.RecordBatch],
) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[str, Page, Frame]]]]:
    """Slices of ``framed`` rows with host, parsed page and template of each row."""
    held: dict[str, Frame] = {}
    size = 0

    def pages(batch: pa.RecordBatch, sources: list[bytes]) -> Iterator[tuple[str, Page, Frame]]:
        nonlocal size
        hosts, tokens, marks = (
            batch.column(batch.schema.get_field_index(n)) for n in ("host", "token", "mark")
        )
        for i, source in enumerate(sources):
            name = hosts[i].as_py()
            frame = held.get(name)
            if frame is None:
                frame = dict(zip(tokens[i].as_py() or (), marks[i].as_py() or (), strict=True))
                if len(held) >= HELD_HOSTS or size > HELD:
                    held.clear()
                    size = 0
                held[name] = frame
                size += len(frame)
            yield name, Page(source.decode()), frame

    for batch, sources in text_slices(batches, "html"):
        yield batch, pages(batch, sources)


def slots(pages: DataFrame, template: DataFrame) -> DataFrame:
    """host, slot, words, linked, heading: parts of sums over the pages of a host.

    A slot is named by the template token before it, 0 at the beginning of a page. Blocks that stand
    outside by element or name, and blocks of the template, are in no slot.
    """
    names = ["host", "slot", "words", "linked", "heading"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}

        def emit() -> pa.RecordBatch:
            columns = list(zip(*((*key, *sums) for key, sums in held.items()), strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

        for _, rows in parsed(batches):
            for name, page, frame in rows:
                for block, slot, mark in page.placed(frame):
                    if block.state <= UNDER and not mark:
                        entry = held.setdefault((name, slot), [0, 0, False])
                        entry[0] += block.words
                        entry[1] += block.linked
                        entry[2] |= block.heading
                if len(held) > HELD:
                    yield emit()
        if held:
            yield emit()

    return framed(pages, template).select("html", "host", "token", "mark").mapInArrow(
        lean(run), "host string, slot bigint, words bigint, linked bigint, heading boolean"
    )


def minor_slots(pages: DataFrame, template: DataFrame, scratch: Scratch) -> DataFrame:
    """host, slot of the slots that hold links or little text."""
    summed = (
        slots(pages, template)
        .groupBy("host", "slot")
        .agg(
            F.sum("words").alias("words"),
            F.sum("linked").alias("linked"),
            F.max("heading").alias("heading"),
        )
    )
    running = F.col("linked") <= MOST_LINKED * F.col("words")
    # A host has at most one slot more than its template has tokens.
    largest = F.max(F.when(running, F.col("words"))).over(Window.partitionBy("host"))
    main = running & (F.col("heading") | (F.col("words") >= LEAST_WORDS * largest))
    return scratch.save(
        summed.select("host", "slot", main.alias("main")).where("NOT main").select("host", "slot"),
        "minor",
    )


def extract(pages: DataFrame, template: DataFrame, minor: DataFrame | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page, given template and minor slots of its host."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in parsed(batches):
            texts = [page.main_text(frame) for _, page, frame in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(text) for text in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return framed(pages, template, minor).mapInArrow(
        lean(run), "page_id bigint, url string, text string, n_chars bigint"
    )


def main_texts(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Main text of every page.

    Blocks are elements of their own line; inline tags do not part words. Text outside the article
    (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments) is left
    out by element, role or name, wherever it stands; without an article the text of the host's main
    slots is the article. Text blocks of the host's template are left out as well. A host of one page
    has no template: the whole page is one slot. Null html is an empty page; pages without a host form
    one host; null and repeated ids are kept as they are; an empty table gives an empty table; other
    columns are not looked at.
    """
    template = templates(pages, scratch)
    return extract(pages, template, minor_slots(pages, template, scratch))
