"""Main text of web pages by two-pass block rules: features decide clear blocks, neighbours decide the rest."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_batches

MAX_LINK_DENSITY = 0.33
SHORT_CHARS = 70
LONG_CHARS = 200
LOW_STOPS = 0.10
HIGH_STOPS = 0.20
BAD, GOOD, NEAR, SHORT = "bad", "good", "near", "short"

# Common words of the languages that are told apart from menus and labels.
_STOP_LISTS = [
    frozenset(x.split())
    for x in """the of and to in is was for on that with by at from this be are as it an or not have has but they you we he she his her their which
    der die das und in zu den von mit ist des sich auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei
    le la les de des du et en un une est que dans qui par pour au sur pas plus il ne se ce avec sont aux elle
    el los las del y que en un una por con para es se no al lo como más su sus o pero le ya este""".splitlines()
]
STOP_WORDS = frozenset().union(*_STOP_LISTS)
#: A page with a smaller share of them is in a language without a list here: its blocks are told by length and links alone.
COVERED_STOPS = 0.05
# Elements by their role in a page. What is in raw ones is not text; those that a page must close hold all that follows.
RAW_TAGS = frozenset("script style noscript template svg math iframe object canvas audio video textarea select button head".split())
UNTIL_END = frozenset(("script", "style"))
MAY_BE_EMPTY = frozenset(("svg", "math"))
OPTIONS = frozenset(("option", "optgroup"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
OUTSIDE = ("", False, False, False)
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul""".split()
)
SPACE_TAGS = frozenset(("br", "td", "th", "wbr", "img", "input"))
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset(("nav", "aside", "footer", "form", "menu", "dialog", "fieldset"))
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
BAD_NAMES = frozenset(
    """nav navbar navigation menu topbar masthead header footer sidebar ad ads advert adverts advertisement advertising banner sponsor sponsored
    promo promotion cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup login share sharing social
    related recommended comment comments commentlist reply replies respond disqus breadcrumb breadcrumbs pagination pager widget search
    copyright legal toolbar skip hidden""".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist reply replies respond disqus".split())
MAIN_TAGS = frozenset(("article", "main"))

_MARKUP = re.compile(r"<(?:(/?)([a-zA-Z][^\s/><]*)|(!--)|[!?])")
_STOP = re.compile(r"""[<>"']""")
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])" + r"|(?=<body[\s>])" * (name == "head"), re.I) for name in RAW_TAGS}
_ATTRIBUTE = re.compile(r"""([^\s"'=/]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """A run of text between block boundaries."""

    section: int = 0
    main: bool = False
    boilerplate: bool = False
    heading: bool = False
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _boilerplate(name: str, attributes: str, in_main: bool) -> bool:
    """Whether an element is page furniture by its name, role, or class and id."""
    if name in BAD_TAGS or name == "header" and not in_main:
        return True
    if not attributes.strip() or name in ("html", "body"):
        return False
    found = {k.lower(): (a or b or c or "").lower() for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in BAD_ROLES:
        return True
    names = set(_NAME.findall(f"{found.get('class', '')} {found.get('id', '')}"))
    return bool(names & (COMMENT_NAMES if name in MAIN_TAGS else BAD_NAMES))


def _tag_end(html: str, at: int) -> int:
    """The place after a tag whose name ends at `at`.

    Quotes hold only after an equals sign. One that is never closed, or closed only beyond the next tag, is a slip: the tag
    then ends at the first angle bracket. A tag also ends where another begins, so no place is read more than a few times.
    """
    while m := _STOP.search(html, at):
        if m[0] == ">":
            return m.end()
        if m[0] == "<":
            return m.start()
        at = m.end()
        if not html[max(0, at - 9) : at - 1].rstrip().endswith("="):
            continue
        close = html.find(m[0], at)
        stop = html.find(">", at, close if close >= 0 else len(html))
        if close < 0:
            return stop + 1 or len(html)
        if stop >= 0 and html.find("<", stop, close) >= 0:
            return stop + 1
        at = close + 1
    return len(html)


def _markup(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """start, end, whether it closes, name and attributes of each piece of markup; comments, declarations and raw elements have no name.

    A raw element that is never closed keeps its name, unless all that follows is in it.
    """
    at, open_ended = 0, set[str]()
    while m := _MARKUP.search(html, at):
        start, name, found, attributes = m.start(), (m[2] or "").lower(), "", ""
        if m[3]:
            close = html.find("-->", start + 2)
            at = close + 3 if close >= 0 else len(html)
        elif not name:
            at = html.find(">", start) + 1 or len(html)
        else:
            at = _tag_end(html, m.end())
            found, attributes = name, html[m.end() : at].rstrip(">")
            if name in RAW_TAGS and not m[1] and not (name in MAY_BE_EMPTY and attributes.endswith("/")):
                close = None if name in open_ended else _RAW_ENDS[name].search(html, at)
                if close:
                    at, found = _tag_end(html, close.end()) if close[0] else close.end(), ""
                elif name in UNTIL_END:
                    at, found = len(html), ""
                else:
                    open_ended.add(name)
        yield start, at, bool(m[1]), found, attributes


def blocks(html: str) -> list[Block]:
    """Blocks of a page in order. Unclosed elements end with the element around them; a tag cut off at the end is dropped.

    What an unclosed raw element holds is furniture up to the next block.
    """
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name; inside furniture, the article, a heading
    opened = Counter[str]()
    links = sections = loose = 0
    block = Block()

    def close() -> None:
        nonlocal block
        text = " ".join(unescape("".join(block.parts)).split())
        if text:
            block.text = text
            out.append(block)
        _, bad, main, heading = stack[-1] if stack else OUTSIDE
        block = Block(sections if main else 0, main, bad, heading)

    def push(name: str, bad: bool, main: bool) -> None:
        stack.append((name, bad, main, name in HEADINGS or bool(stack) and stack[-1][3]))
        opened[name] += 1

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    def add(text: str) -> None:
        block.parts.append(text)
        if links:
            block.linked += len(text)

    at = 0
    for start, end, ends, name, attributes in _markup(html):
        if start > at:
            add(html[at:start])
        at = end
        if not name:
            add(" ")
        elif name in RAW_TAGS:
            if not ends and not attributes.endswith("/"):
                push(name, True, stack[-1][2] if stack else False)
                loose += 1
                close()
        elif name == "a":
            links = 0 if ends else 1
        elif name in SPACE_TAGS:
            add(" ")
        elif ends and opened[name]:
            while pop() != name:
                pass
        elif not ends and name not in VOID_TAGS and (name in BLOCK_TAGS or attributes):
            if loose and name in BLOCK_TAGS and name not in OPTIONS:
                while any(opened[n] for n in RAW_TAGS):
                    pop()
                loose = 0
            if name in ("p", "li", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
                pop()
            _, bad, main, _ = stack[-1] if stack else OUTSIDE
            if name in MAIN_TAGS and not main:
                main, sections = True, sections + 1
            push(name, bad or _boilerplate(name, attributes, main), main)
        if name in BLOCK_TAGS:
            links = 0
            close()
    if at < len(html):
        add(html[at:])
    close()
    return out


def _stops(text: str) -> tuple[int, int]:
    """Stop words and words of a text."""
    words = _WORD.findall(text.lower())
    return sum(map(STOP_WORDS.__contains__, words)), len(words)


def covered(page: list[Block]) -> bool:
    """Whether the stop words of some language are common on a page, in its longer blocks that are neither furniture nor links."""
    words = Counter(w for b in page if not b.boilerplate and len(b.text) >= SHORT_CHARS and b.linked <= MAX_LINK_DENSITY * len(b.text) for w in _WORD.findall(b.text.lower()))
    return not words or max(sum(words[w] for w in stops) for stops in _STOP_LISTS) >= COVERED_STOPS * words.total()


def first_pass(block: Block, known: bool = True) -> str:
    """Label of a block from its own features: length, link density and, in a known language, stop-word density."""
    size = len(block.text)
    if block.boilerplate or block.linked > MAX_LINK_DENSITY * size or not block.main and "\N{COPYRIGHT SIGN}" in block.text:
        return BAD
    if size < SHORT_CHARS or block.heading:
        return SHORT if block.main or not block.linked else BAD
    stops, words = _stops(block.text)
    density = stops / max(1, words) if known else HIGH_STOPS
    if density >= HIGH_STOPS and size >= LONG_CHARS:
        return GOOD
    if density >= LOW_STOPS or block.main:
        return NEAR
    return BAD


def second_pass(page: list[Block]) -> list[str]:
    """Final labels: an undecided block takes the label of the nearest decided ones of its section.

    Furniture decides nothing for its neighbours, nor do link lists inside a marked article. If both sides are as near and
    disagree, near-good blocks and headings count as good. A section without any decided block is good if it is marked as
    the article, else only if the page marks no article.
    """
    known = covered(page)
    labels = [first_pass(b, known) for b in page]
    marked = any(b.main for b in page)
    n = len(page)
    left, right = [-1] * n, [-1] * n
    for side, order in ((left, range(n)), (right, range(n - 1, -1, -1))):
        last: dict[int, int] = {}
        for i in order:
            side[i] = last.get(page[i].section, -1)
            if labels[i] == GOOD or labels[i] == BAD and not page[i].boilerplate and not page[i].main:
                last[page[i].section] = i
    out = []
    for i, (b, label) in enumerate(zip(page, labels, strict=True)):
        if label in (NEAR, SHORT):
            a, z = left[i], right[i]
            if a < 0 and z < 0:
                label = GOOD if b.main or not marked and label == NEAR else BAD
            elif a < 0 or z < 0 or labels[a] == labels[z]:
                label = labels[max(a, z)]
            elif label == NEAR or b.heading or i - a == z - i:
                label = GOOD
            else:
                label = labels[a if i - a < z - i else z]
        out.append(label)
    return out


def extract(html: str | None) -> str:
    """Main text: kept blocks in page order, joined by line feeds; empty if there is none."""
    page = blocks(html or "")
    return "\n".join(b.text for b, label in zip(page, second_pass(page), strict=True) if label == GOOD)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    Null and empty pages give an empty text, null ids and addresses are kept, repeated rows stay and equal pages give equal texts;
    a page is read whole and once, however long; other columns are ignored, whatever their names; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, text="html"):
            texts = [extract(h) for h in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(pages: DataFrame) -> DataFrame:
    return main_text(pages)
