"""Text of XML documents as ordered segments, and segments written back: replace, append to the text, append as blocks."""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, zip_longest
from xml.etree import ElementTree
from xml.etree.ElementTree import Element

from .parsers import numeric_entities

# Elements that do not break a line of text.
INLINE = frozenset(
    """a abbr b bdi bdo br cite code data dfn em i kbd mark q rp rt ruby s samp small span strong sub sup time u var wbr img svg canvas audio video map
    area input button select textarea label output progress meter iframe embed object script font tt big strike acronym""".split()
)
REPLACE, APPEND_TEXT, APPEND_BLOCK = "replace", "append_text", "append_block"
# Names of languages for prompts.
LANGUAGES = {"zh": "Simplified Chinese", "en": "English", "ja": "Japanese", "ko": "Korean", "es": "Spanish", "fr": "French", "de": "German", "pt": "Portuguese", "it": "Italian", "ru": "Russian"}


@dataclass
class Segment:
    """A text or tail with the path of child numbers to its element, how many of its elements are blocks, and its words."""

    path: tuple[int, ...]
    block: int
    tail: bool
    text: str


def plain(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def is_inline(e: Element) -> bool:
    """By name; math is inline unless it is displayed as a block."""
    if plain(e.tag) == "math":
        return e.get("display") != "block"
    return plain(e.tag) in INLINE


_HEADER = re.compile(r"\A\s*(?:<\?.*?\?>\s*)?(?:<!DOCTYPE[^>]*>\s*)?", re.S)
_PREFIX = re.compile(r"""\bxmlns(?::([A-Za-z_][\w.-]*))?\s*=\s*["']([^"']+)["']""")


def header(xml: str) -> str:
    """What stands before the root of a document: its declaration and type."""
    return _HEADER.match(xml)[0]


def parse(xml: str) -> Element:
    """The root of a document; named entities of HTML are understood, a header before the root is skipped.

    Prefixes of namespaces are kept for writing: the first of an address counts.
    """
    for prefix, address in reversed(_PREFIX.findall(xml)) if "xmlns" in xml else ():
        if not re.fullmatch(r"ns\d+|xml", prefix):
            ElementTree.register_namespace(prefix, address)
    return ElementTree.fromstring(numeric_entities(xml[_HEADER.match(xml).end() :]))


def indent(root: Element, step: str = "  ") -> Element:
    """A copy with one element a line, for reading; text that is not blank is left alone."""
    root = copy.deepcopy(root)
    ElementTree.indent(root, step)
    return root


_SPACES = re.compile(r"\s+")


def segments(root: Element) -> list[Segment]:
    """Segments in document order; white space is squeezed, blank texts are left out."""
    out: list[Segment] = []

    def walk(e: Element, path: tuple[int, ...], depth: int, block: int) -> None:
        block = block if is_inline(e) and depth else depth + 1

        def say(text: str | None, tail: bool, at: tuple[int, ...]) -> None:
            squeezed = _SPACES.sub(" ", text or "")
            if squeezed.strip():
                out.append(Segment(at, block, tail, squeezed))

        say(e.text, False, path)
        for k, child in enumerate(e):
            walk(child, (*path, k), depth + 1, block)
            say(child.tail, True, (*path, k))

    walk(root, (), 0, 0)
    return out


def inline_runs(found: list[Segment]) -> list[list[Segment]]:
    """Neighbouring segments with the same block element, which a translator sees as one text."""
    return [list(g) for _, g in groupby(found, key=lambda s: s.path[: s.block - 1] if not s.tail else s.path[: min(s.block - 1, len(s.path) - 1)])]


def at_path(root: Element, path: tuple[int, ...]) -> Element:
    for k in path:
        root = root[k]
    return root


def submit(xml: str, texts: list[str | None], mode: str = REPLACE) -> str:
    """The document with a new text for each segment; null keeps the old one.

    append_text adds the new text after the old in its place; append_block adds, after each block with new texts, a copy of it
    that holds them.
    """
    root = parse(xml)
    put(root, segments(root), texts, mode)
    return ElementTree.tostring(root, encoding="unicode")


def put(root: Element, found: list[Segment], texts: list[str | None], mode: str = REPLACE) -> None:
    """What submit() does, in a document that is parsed and whose segments are known."""
    if len(found) != len(texts):
        raise ValueError("one text for each segment is needed")
    if mode == APPEND_BLOCK:
        twin = copy.deepcopy(root)
        _write(twin, found, texts, REPLACE)
        blocks = sorted({s.path[: s.block - 1] for s, t in zip(found, texts, strict=True) if t is not None and s.block > 1})
        # what a block holds comes right after it
        parents = [p for p, q in zip_longest(blocks, blocks[1:]) if q is None or q[: len(p)] != p]
        for path in reversed(parents):
            made, parent = copy.deepcopy(at_path(twin, path)), at_path(root, path[:-1])
            old = parent[path[-1]]
            made.tail, old.tail = old.tail, None
            parent.insert(path[-1] + 1, made)
    else:
        _write(root, found, texts, mode)


def _write(root: Element, found: list[Segment], texts: list[str | None], mode: str) -> None:
    for s, new in zip(found, texts, strict=True):
        if new is None:
            continue
        e = at_path(root, s.path)
        old = (e.tail if s.tail else e.text) or ""
        text = f"{old} {new}" if mode == APPEND_TEXT else new
        if s.tail:
            e.tail = text
        else:
            e.text = text


def unique_ids(xml: str, suffix: str = "__translated") -> str:
    """Repeated id attributes made unique, in document order; numbers skip names that are taken."""
    root = parse(xml)
    number_ids(root, suffix)
    return ElementTree.tostring(root, encoding="unicode")


def number_ids(root: Element, suffix: str = "__translated") -> None:
    """What unique_ids() does, in a document that is parsed."""
    seen, counts = set(), {}
    for e in root.iter():
        own = e.get("id")
        if own is None:
            continue
        counts[own] = counts.get(own, 1) + 1 if own in seen else 1
        new, k = own, counts[own] - 1
        if own in seen:
            new = own + suffix if k == 1 else f"{own}{suffix}_{k}"
            while new in seen:
                k += 1
                new = f"{own}{suffix}_{k}"
            e.set("id", new)
        seen.add(new)


def chunks(costs: list[int], limit: int, head: float = 0.07, tail: float = 0.035) -> Iterator[tuple[int, int, int, int]]:
    """(context start, start, end, context end) of pieces of at most `limit` tokens with some context on both sides; a
    longer item stands alone. The context shares the limit's rest: head and tail are shares of the limit.
    """
    start = 0
    while start < len(costs):
        room, end = limit * (1 - head - tail), start
        while end < len(costs) and (end == start or room >= costs[end]):
            room -= costs[end]
            end += 1
        before, left = start, limit * head
        while before > 0 and costs[before - 1] <= left:
            before -= 1
            left -= costs[before]
        after, left = end, limit * tail
        while after < len(costs) and costs[after] <= left:
            left -= costs[after]
            after += 1
        yield before, start, end, after
        start = end


def friendly(root: Element, wide: int = 35) -> str:
    """XML for a language model: two spaces of indent, short elements on one line, namespaces left out."""

    def write(e: Element, indent: str) -> Iterator[str]:
        attributes = "".join(f' {plain(k)}="{_escape(v)}"' for k, v in e.attrib.items())
        name, inner = plain(e.tag), _inline(e).strip()
        if not len(e) and not (e.text or "").strip():
            yield f"{indent}<{name}{attributes}/>"
        elif len(inner) <= wide or not len(e) or any((x.tail or "").strip() for x in e):
            yield f"{indent}<{name}{attributes}>{inner}</{name}>"
        else:
            yield f"{indent}<{name}{attributes}>"
            if (e.text or "").strip():
                yield f"{indent}  {_escape(e.text.strip())}"
            for child in e:
                yield from write(child, indent + "  ")
            yield f"{indent}</{name}>"

    return "\n".join(write(root, ""))


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _inline(e: Element) -> str:
    out = [_escape(re.sub(r"\s+", " ", e.text or ""))]
    for c in e:
        attributes = "".join(f' {plain(k)}="{_escape(v)}"' for k, v in c.attrib.items())
        body = _inline(c)
        out.append(f"<{plain(c.tag)}{attributes}>{body}</{plain(c.tag)}>" if body else f"<{plain(c.tag)}{attributes}/>")
        out.append(_escape(re.sub(r"\s+", " ", c.tail or "")))
    return "".join(out)


def from_friendly(text: str) -> list[Element]:
    """Elements of a model's answer, read leniently: text around them is left out, closing tags without a start are
    skipped, elements that are not closed end with the one around them.
    """
    from .parsers import friendly_tokens

    roots: list[Element] = []
    stack: list[Element] = []
    for kind, tag, body in friendly_tokens(text):
        if kind == "text":
            if stack:
                last = stack[-1]
                body = body.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&amp;", "&")
                if len(last):
                    last[-1].tail = (last[-1].tail or "") + body
                else:
                    last.text = (last.text or "") + body
        elif kind == "closing":
            if any(e.tag == tag for e in stack):
                while stack.pop().tag != tag:
                    pass
        else:
            e = Element(tag, dict(re.findall(r"""([\w:.-]+)\s*=\s*["']([^"']*)["']""", body)))
            (stack[-1].append(e) if stack else roots.append(e))
            if kind == "opening":
                stack.append(e)
    return roots


def without_math(root: Element) -> tuple[Element, dict[str, Element]]:
    """A copy whose math elements are empty placeholders with numbers, and the elements by number, for translation around them."""
    root, held = copy.deepcopy(root), {}
    for parent in list(root.iter()):
        for k, e in enumerate(list(parent)):
            if plain(e.tag) == "math" and plain(parent.tag) != "math":
                mark = Element("math", {"id": str(len(held))})
                held[str(len(held))], mark.tail, e.tail = e, e.tail, None
                parent[k] = mark
    return root, held


def with_math(root: Element, held: dict[str, Element]) -> Element:
    """Placeholders back to math; one that was lost stays lost, an unknown one goes."""
    for parent in list(root.iter()):
        for k, e in reversed(list(enumerate(parent))):
            if plain(e.tag) == "math" and not len(e):
                if e.get("id") in held:
                    old = copy.deepcopy(held[e.get("id")])
                    old.tail = e.tail
                    parent[k] = old
                else:
                    parent.remove(e)
    return root


def contents_xml(entries: list[tuple[int, int | None, str]]) -> str:
    """A contents tree (number, parent, title) as XML, for translation like any other text."""
    root = Element("toc")
    made = {None: root}
    for number, parent, title in entries:
        item = ElementTree.SubElement(made.get(parent, root), "item", {"id": str(number)})
        ElementTree.SubElement(item, "title").text = title
        made[number] = item
    return ElementTree.tostring(root, encoding="unicode")


def contents_titles(xml: str) -> dict[int, str]:
    return {int(e.attrib["id"]): (e.findtext("title") or "").strip() for e in parse(xml).iter("item")}
