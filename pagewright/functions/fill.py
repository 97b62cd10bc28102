"""Translations filled back into XML: templates with ids, faults of an answer against its template, the best of each block, prompts."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree.ElementTree import Element, ParseError, tostring

from . import markup

# How much each kind of fault weighs (3 to the level), and how many are shown at once.
LEVELS = {"block lost": 6, "block tag": 5, "block id": 4, "block unexpected": 3, "inline lost": 3, "inline without id": 2, "inline id": 1, "inline count": 0, "inline unexpected": 0}
WEIGHT_BASE, SHOWN, HINT_WORDS, HINT_CHARS = 3, 10, 6, 30
ID, LENGTH = "id", "data-origin-len"
PROMPTS = {
    "translate": "Translate the text into {language}. Keep one paragraph for each paragraph, in order, and write nothing else.{wishes}",
    "fill": "Put the translated text into the XML template: each block of the template gets its own part. Keep tags, ids and the order of blocks; {length} tells how long the original was. Answer with one complete <xml> element and nothing else.",
    "request": "Source:\n{source}\n\nTemplate:\n{template}\n\nTranslation:\n{translation}",
}


def prompt(name: str, **values: str) -> str:
    """One of the prompts with its fields filled in; unknown names and fields that are missing are errors."""
    return PROMPTS[name].format(**values)


@dataclass(frozen=True)
class Fault:
    """One difference between an answer and its template, with the id of the block it is in (0: none) and where it was found."""

    kind: str
    block: int
    detail: str
    place: tuple[int, ...] = ()

    @property
    def level(self) -> int:
        return LEVELS[self.kind]


@dataclass(frozen=True)
class FillFailed:
    """An answer that did not do: what was said about it, the try, and whether it was the last."""

    message: str
    attempt: int
    over: bool


def _print(e: Element) -> tuple:
    return e.tag, tuple(sorted(e.attrib.items()))


def template(root: Element) -> tuple[Element, dict[int, Element]]:
    """A template of the texts of a document, and the block of each id.

    Each block, the last element that breaks the line around some texts, is a child with an id; inside are its texts and inline
    elements. Those get ids only where elements of one tag side by side differ in their attributes.
    """
    out, blocks, number = Element("xml"), dict[int, Element](), 0
    found = list(dict.fromkeys(s.path[: max(0, s.block - 1)] for s in markup.segments(root)))
    inner = set(found)

    def copy_of(e: Element, path: tuple[int, ...]) -> Element:
        nonlocal number
        made = Element(markup.plain(e.tag))
        made.text = e.text
        kept = [(k, c) for k, c in enumerate(e) if (*path, k) not in inner and any(t.strip() for t in c.itertext())]
        kinds: dict[str, set] = {}
        for _, c in kept:
            kinds.setdefault(c.tag, set()).add(_print(c))
        last: Element | None = None
        for k, c in enumerate(e):
            if (k, c) in kept:
                if len(kinds[c.tag]) > 1:
                    number += 1
                    own = str(number)
                else:
                    own = None
                last = copy_of(c, (*path, k))
                if own:
                    last.set(ID, own)
                made.append(last)
            if last is None:
                made.text = (made.text or "") + (c.tail or "")
            else:
                last.tail = (last.tail or "") + (c.tail or "")
        return made

    for path in found:
        number += 1
        own = number
        block = markup.at_path(root, path)
        made = copy_of(block, path)
        made.tail = None
        made.set(ID, str(own))
        out.append(made)
        blocks[own] = block
    return out, blocks


def _id(e: Element) -> int | None:
    own = e.get(ID)
    if own is None:
        return None
    try:
        return int(own)
    except ValueError:
        return None


def pairs(want: Element, got: Element) -> Iterator[tuple[Element, Element]]:
    """Children that belong together: by id where both have it, the rest by place within their tag."""
    by_id = {_id(e): e for e in reversed(got) if _id(e) is not None}
    used: set[int] = set()
    left = []
    for child in want:
        other = by_id.get(_id(child)) if _id(child) is not None else None
        if other is not None and other.tag == child.tag and id(other) not in used:
            used.add(id(other))
            yield child, other
        else:
            left.append(child)
    free: dict[str, list[Element]] = {}
    for e in got:
        if id(e) not in used:
            free.setdefault(e.tag, []).append(e)
    for child in left:
        if free.get(child.tag):
            yield child, free[child.tag].pop(0)


def faults(want: Element, got: Element) -> list[Fault]:
    """All nine kinds of faults of an answer against its template, in the order of the answer."""
    out: list[Fault] = []
    if got.tag != want.tag:
        out.append(Fault("block tag", 0, f"<{want.tag}> became <{got.tag}>"))
    known, seen = {_id(e): e for e in want}, set()
    for k, e in enumerate(got):
        own = _id(e)
        if own is None:
            out.append(Fault("block id", 0, f"<{e.tag}> has the id {e.get(ID)!r}", (k,)))
        elif own not in known:
            out.append(Fault("block unexpected", 0, f"<{e.tag}> #{own}", (k,)))
        else:
            seen.add(own)
            if e.tag != known[own].tag:
                out.append(Fault("block tag", own, f"<{known[own].tag}> became <{e.tag}>", (k,)))
            out += _inline(known[own], e, own, (k,))
    out += [Fault("block lost", i, f"<{e.tag}> #{i} {_hint(e)}") for i, e in known.items() if i not in seen]
    return out


def _inline(want: Element, got: Element, block: int, place: tuple[int, ...]) -> list[Fault]:
    ids = {_id(e): e for e in want.iter() if e is not want and _id(e) is not None}
    left, out = dict(ids), []
    for e in got.iter():
        if e is got or e.get(ID) is None:
            continue
        if _id(e) is None:
            out.append(Fault("inline id", block, f"<{e.tag}> has the id {e.get(ID)!r}", place))
        elif left.pop(_id(e), None) is None:
            out.append(Fault("inline unexpected", block, f"<{e.tag}> #{_id(e)}", place))
    out += [Fault("inline lost", block, f"<{e.tag}> #{i} {_hint(e)}", place) for i, e in left.items()]
    return out + _structure(want, got, block, place)


def _structure(want: Element, got: Element, block: int, place: tuple[int, ...]) -> list[Fault]:
    counts: dict[str, list[int]] = {}
    numbered = {e.tag for e in want if _id(e) is not None}
    out = []
    for e in want:
        counts.setdefault(e.tag, [0, 0])[0] += e.tag not in numbered
    for e in got:
        if e.tag in numbered:
            if e.get(ID) is None:
                out.append(Fault("inline without id", block, f"<{e.tag}> {_hint(e)}", place))
        else:
            counts.setdefault(e.tag, [0, 0])[1] += 1
    out += [Fault("inline count", block, f"{found} <{tag}> where {wanted} are wanted", place) for tag, (wanted, found) in counts.items() if found and found != wanted]
    for child, other in pairs(want, got):
        out += _structure(child, other, block, place)
    return out


def _hint(e: Element) -> str:
    """The first words of an element, for a model to find it by."""
    words = "".join(e.itertext()).split()
    text = " ".join(words[:HINT_WORDS]) + " ..." * (len(words) > HINT_WORDS)
    return f"near '{text if len(text) <= HINT_CHARS else text[: HINT_CHARS - 3] + '...'}'"


def weights(found: list[Fault]) -> dict[int, int]:
    """The weight of the faults of each block."""
    out: dict[int, int] = {}
    for f in found:
        out[f.block] = out.get(f.block, 0) + WEIGHT_BASE**f.level
    return out


def feedback(found: list[Fault], better: frozenset[int] = frozenset(), shown: int = SHOWN) -> str:
    """What a model is told about its answer: the worst faults first, those of blocks that have become better last."""
    order = sorted(found, key=lambda f: (f.block in better, -f.level, f.place, f.block))
    lines = [f"There are {len(found)} faults. Correct them and answer with the whole <xml> element again."]
    lines += [f"- {f.kind}{f' in block #{f.block}' if f.block else ''}: {f.detail}" for f in order[:shown]]
    return "\n".join(lines + [f"{len(found) - shown} more are not shown."] * (len(found) > shown))


def assigned(block: Element, want: Element, got: Element) -> Element:
    """A copy of a block with the texts of an answer: attributes and elements of the original, unmatched elements as plain text."""
    out = Element(block.tag, dict(block.attrib))
    own = [c for c in block if any(t.strip() for t in c.itertext())]  # the template has these, in this order
    source = {id(w): c for w, c in zip(want, own, strict=False)}
    partner = {id(g): w for w, g in pairs(want, got)}
    out.text, last = got.text, None
    for e in got:
        w = partner.get(id(e))
        if w is not None and id(w) in source:
            last = assigned(source[id(w)], w, e)
            last.tail = e.tail
            out.append(last)
            continue
        text = "".join(e.itertext()) + (e.tail or "")
        if last is None:
            out.text = (out.text or "") + text
        else:
            last.tail = (last.tail or "") + text
    return out


class Filling:
    """The best answer for each block so far: an answer replaces the kept one of a block only if its faults weigh less."""

    def __init__(self, root: Element, length: Callable[[str], int] = lambda t: -(-len(t) // 4)) -> None:
        self.root, (self.want, self.blocks) = root, template(root)
        self.kept: dict[int, tuple[int, Element]] = {}
        self.length = length

    def request(self) -> Element:
        """The template, each block with the length of its text in tokens."""
        out = copy.deepcopy(self.want)
        for e in out:
            e.set(LENGTH, str(self.length("".join(e.itertext()))))
        return out

    def submit(self, got: Element) -> str | None:
        """Takes an answer; what is wrong with it, or null."""
        found = faults(self.want, got)
        weight = weights(found)
        better = frozenset(i for i, (old, _) in self.kept.items() if weight.get(i, 0) < old)
        for e in got:
            own = _id(e)
            if own in self.blocks and (own not in self.kept or weight.get(own, 0) < self.kept[own][0]):
                self.kept[own] = (weight.get(own, 0), e)
        return feedback(found, better) if found else None

    def result(self) -> Element:
        """The document with the kept texts; a block without an answer keeps its own."""
        root = copy.deepcopy(self.root)
        places = {id(e): p for p, e in _paths(self.root)}
        inner = {places[id(b)] for b in self.blocks.values()}
        for want in sorted(self.want, key=lambda e: len(places[id(self.blocks[_id(e)])]), reverse=True):
            if _id(want) not in self.kept:
                continue
            path = places[id(self.blocks[_id(want)])]
            old = markup.at_path(root, path)
            held = [c for k, c in enumerate(old) if (*path, k) in inner or not any(t.strip() for t in c.itertext())]
            bare = copy.copy(old)
            for c in held:
                bare.remove(c)
                c.tail = None
            new = assigned(bare, want, self.kept[_id(want)][1])
            old.text = new.text
            for c in list(old):
                old.remove(c)
            old.extend([*new, *held])
        return root


def _paths(e: Element, path: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], Element]]:
    yield path, e
    for k, c in enumerate(e):
        yield from _paths(c, (*path, k))


def fill(xml: str, translate: Callable[[str], str], request: Callable[[list[dict[str, str]]], str], attempts: int = 5, failed: Callable[[FillFailed], None] = lambda e: None) -> str:
    """A document translated in two steps: its text as a whole, then that text filled into a template of its blocks.

    An answer must hold exactly one <xml> element. Faults go back to the model; of all tries the best answer of each block
    counts, so the result is complete even if no try is without faults. failed is told of each answer that did not do.
    """
    try:
        filling = Filling(markup.parse(xml))
    except ParseError:
        return xml
    if not filling.blocks:
        return xml
    source = "\n\n".join(" ".join("".join(e.itertext()).split()) for e in filling.want)
    first = [{"role": "system", "message": prompt("fill", length=LENGTH)}, {"role": "user", "message": prompt("request", source=source, template=markup.friendly(filling.request()), translation=translate(source))}]
    later: list[dict[str, str]] = []
    for k in range(attempts):
        answer = request([*first, *later])
        roots = [e for e in markup.from_friendly(answer or "") if e.tag == "xml"]
        error = filling.submit(roots[0]) if len(roots) == 1 else f"There must be one complete <xml> element; there are {len(roots)}."
        if error is None:
            break
        failed(FillFailed(error, k + 1, k + 1 == attempts))
        later = [{"role": "assistant", "message": answer or ""}, {"role": "user", "message": error}]
    return markup.header(xml) + tostring(filling.result(), encoding="unicode")
