"""Chapters as XML, for exchange and for translation like any other text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.etree.ElementTree import Element, SubElement

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pagewright.functions import fill, markup

PARTS = ("title", "content", "caption")
ELEMENTS = "array<struct<kind:string,ref:string,level:bigint,page_index:bigint,ord:bigint,texts:array<string>,title:string,content:string,caption:string>>"
NOTES = "array<struct<label:bigint,text:string>>"


def encode(chapter: int | None, level: int, elements: list[dict], notes: list[dict]) -> str:
    """XML of a chapter: paragraphs with a block for each text, assets with their parts, and the notes it cites."""
    root = Element("chapter", {k: str(v) for k, v in (("id", chapter), ("level", level)) if v is not None})
    body = SubElement(root, "body")
    for e in elements:
        facts = {k: str(e[k]) for k in ("ref", "level", "page_index", "ord") if e.get(k) is not None}
        if e["kind"] == "text":
            made = SubElement(body, "paragraph", facts)
            for t in e["texts"] or ():
                SubElement(made, "block").text = t
        else:
            made = SubElement(body, "asset", {"kind": e["kind"], **facts})
            for part in PARTS:
                if e.get(part) is not None:
                    SubElement(made, part).text = e[part]
    if notes:
        held = SubElement(root, "references")
        for n in sorted(notes, key=lambda n: n["label"]):
            SubElement(held, "ref", {"id": str(n["label"])}).text = n["text"]
    return ElementTree.tostring(markup.indent(root), encoding="unicode")


def decode(xml: str) -> tuple[int | None, int, list[dict], list[dict]]:
    """What encode() was given; ValueError for what is no chapter: another root, no body, an unknown element, numbers that are none, a label twice."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError as e:
        raise ValueError(f"not well-formed: {e}") from None
    body = root.find("body")
    if root.tag != "chapter" or body is None:
        raise ValueError("a chapter has a body")
    number = lambda e, k: None if e.get(k) is None else int(e.get(k))
    elements = []
    for e in body:
        if e.tag not in ("paragraph", "asset") or e.get("ref") is None:
            raise ValueError(f"<{e.tag}> is no part of a chapter")
        row = {"kind": "text" if e.tag == "paragraph" else e.get("kind", e.get("ref")), "ref": e.get("ref"), **{k: number(e, k) for k in ("level", "page_index", "ord")}}
        row["texts"] = [b.text or "" for b in e.findall("block")] if e.tag == "paragraph" else None
        elements.append(row | {p: None if e.find(p) is None else e.findtext(p) or "" for p in PARTS})
    notes = [{"label": int(r.get("id", "")), "text": r.text or ""} for r in root.iterfind("references/ref")]
    if len({n["label"] for n in notes}) < len(notes):
        raise ValueError("a label stands twice")
    return number(root, "id"), number(root, "level") or 0, elements, notes


def chapter_xml(elements: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """book, chapter_id, xml of the chapters of Conversion.elements(), with the notes (book, label, text) that each cites."""
    row = F.struct("place", "kind", "ref", "level", "page_index", "ord", "texts", "title", "content", "caption")
    made = elements.groupBy("book", "chapter_id").agg(F.max("chapter_level").alias("level"), F.sort_array(F.collect_list(row)).alias("elements"))
    if notes is None:
        made = made.withColumn("notes", F.expr(f"CAST(array() AS {NOTES})"))
    else:
        cited = F.transform(F.regexp_extract_all(F.array_join(F.flatten(F.transform("elements", lambda e: F.coalesce(e["texts"], F.array()))), "\n"), F.lit(r"\[\^(\d+)\]")), lambda x: x.cast("long"))
        every = notes.groupBy("book").agg(F.collect_list(F.struct("label", "text")).alias("every"))  # the notes of one book
        made = made.join(every, "book", "left").withColumn("cited", cited).withColumn("notes", F.coalesce(F.filter("every", lambda n: F.array_contains("cited", n["label"])), F.expr(f"CAST(array() AS {NOTES})")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            xml = [encode(None if pd.isna(c) else int(c), int(v), [dict(e) for e in es], [dict(n) for n in ns]) for c, v, es, ns in zip(b.chapter_id, b.level, b.elements, b.notes, strict=True)]
            yield pd.DataFrame({"book": b.book, "chapter_id": b.chapter_id.astype("Int64"), "xml": xml})

    return made.select("book", "chapter_id", "level", "elements", "notes").mapInPandas(run, "book bigint, chapter_id bigint, xml string")


def from_xml(chapters: DataFrame) -> DataFrame:
    """book, chapter_id, level, elements, notes of chapters (book, xml); those that are none fail with their number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for own, xml in zip(b.book, b.xml, strict=True):
                try:
                    rows.append((own, *decode(xml)))
                except ValueError as e:
                    raise ValueError(f"book {own}: {e}") from None
            out = pd.DataFrame(rows, columns=["book", "chapter_id", "level", "elements", "notes"])
            yield out.assign(chapter_id=out.chapter_id.astype("Int64"))

    return chapters.select("book", "xml").mapInPandas(run, f"book bigint, chapter_id bigint, level bigint, elements {ELEMENTS}, notes {NOTES}")


def translate_chapter(xml: str, translate: Callable[[str], str], request: Callable[[list[dict[str, str]]], str], attempts: int = 5) -> str:
    """A chapter translated as an XML document; what comes out must be a chapter again, with the same elements."""
    new = fill.fill(xml, translate, request, attempts)
    before, after = decode(xml), decode(new)
    if [(e["kind"], e["ref"]) for e in before[2]] != [(e["kind"], e["ref"]) for e in after[2]]:
        raise ValueError("the translation has other elements")
    return new
