"""Translation of XML documents: segments become rows, rows are packed and translated in batches, and written back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pagewright.functions import fill, markup
from pagewright.functions.parsers import arrow
from pagewright.session import stored

from .flow import estimate_tokens, pack

SEGMENTS = "array<struct<path:array<int>,block:int,tail:boolean,text:string>>"


def segment_column(c: Column) -> Column:
    """Segments of an XML text; null for what is not well-formed."""

    def one(xml: str | None) -> list[dict] | None:
        try:
            return None if xml is None else [{"path": list(s.path), "block": s.block, "tail": s.tail, "text": s.text} for s in markup.segments(markup.parse(xml))]
        except markup.ElementTree.ParseError:
            return None

    return arrow(one, SEGMENTS)(c)


def segment_rows(docs: DataFrame, key: str, xml: str) -> DataFrame:
    """key, seg, path, block, tail, text of all segments."""
    return docs.select(key, F.posexplode(segment_column(F.col(xml))).alias("seg", "s")).select(key, F.col("seg").cast("long").alias("seg"), "s.*")


def translated(rows: DataFrame, key: str, make: Callable[[], Callable[[list[str]], list[str]]], limit: int = 2600) -> DataFrame:
    """key, seg, new of segment rows: consecutive segments are packed to `limit` tokens, each pack is one call of the translator."""
    costs = rows.select(key, "seg", estimate_tokens(F.col("text")).alias("cost"))
    packed = rows.join(pack(costs, [key], "seg", "cost", limit), [key, "seg"])
    groups = packed.groupBy(key, "pack").agg(F.sort_array(F.collect_list(F.struct("seg", "text"))).alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        function = make()
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                texts = [x["text"] for x in r.x]
                new = function(texts)
                if len(new) != len(texts):
                    raise ValueError("the translator must give one text for each")
                out += [(getattr(r, key), x["seg"], t) for x, t in zip(r.x, new, strict=True)]
            yield pd.DataFrame(out, columns=[key, "seg", "new"])

    return groups.select(key, "x").mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, seg long, new string")


def translate_documents(docs: DataFrame, key: str, xml: str, make: Callable[[], Callable[[list[str]], list[str]]], mode: str = markup.REPLACE, limit: int = 2600) -> DataFrame:
    """docs with the XML column translated; documents that are not well-formed stay as they are.

    A document is translated where it is parsed: its segments are packed as in translated(), and written into the same tree.
    """

    def start() -> Callable[[str | None], str | None]:
        function = make()

        def one(text: str | None) -> str | None:
            try:
                root = None if text is None else markup.parse(text)
            except markup.ElementTree.ParseError:
                return text
            if root is None or not (found := markup.segments(root)):
                return text
            new: list[str] = []
            for texts in packs([s.text for s in found], limit):
                got = function(texts)
                if len(got) != len(texts):
                    raise ValueError("the translator must give one text for each")
                new += got
            markup.put(root, found, new, mode)
            markup.number_ids(root)
            written = markup.ElementTree.tostring(root, encoding="unicode")
            return markup.header(text) + written.replace("\r\n", "\n").replace("\r", "\n")  # line ends as a parser reads them

        return one

    return docs.withColumn(xml, arrow(None, "string", start)(F.col(xml)))


def packs(texts: list[str], limit: int) -> Iterator[list[str]]:
    """Neighbouring texts whose estimated tokens stay within the limit; a longer one stands alone. The rule of flow.pack()."""
    held, cost = [], 0
    for t in texts:
        own = -(-len(t) // 4)  # as estimate_tokens()
        if held and cost + own > limit:
            yield held
            held, cost = [], 0
        held.append(t)
        cost += own
    if held:
        yield held


def cache_key(model: str, url: str, messages: Column, temperature: float, top_p: float) -> Column:
    """512-bit key of a request: everything that shapes the answer, as JSON with sorted names."""
    return F.sha2(F.to_json(F.struct(messages.alias("messages"), F.lit(model).alias("model"), F.lit(temperature).alias("temperature"), F.lit(top_p).alias("top_p"), F.lit(url).alias("url"))), 512)


def fill_documents(docs: DataFrame, key: str, xml: str, make: Callable[[], tuple[Callable[[str], str], Callable[[list[dict[str, str]]], str]]], attempts: int = 5) -> tuple[DataFrame, DataFrame]:
    """docs with the XML column translated by fill.fill(), and the answers that did not do: key, attempt, message, over.

    make gives the two calls, to translate a text and to answer messages, once in each task.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        say, ask = make()
        for batch in batches:
            out = []
            for own, text in zip(batch[key], batch[xml], strict=True):
                events: list[dict] = []
                note = lambda e, events=events: events.append({"attempt": e.attempt, "message": e.message, "over": e.over})
                out.append((own, text if text is None else fill.fill(text, say, ask, attempts, note), events))
            yield pd.DataFrame(out, columns=[key, "_new", "_events"])

    made = stored(docs.select(key, xml).mapInPandas(run, f"{key} {kind}, _new string, _events array<struct<attempt:int,message:string,over:boolean>>"), "filled")
    events = made.select(key, F.explode("_events").alias("e")).select(key, "e.*")
    return docs.join(made.select(key, "_new"), key, "left").withColumn(xml, F.col("_new")).drop("_new"), events


def fault_column(want: Column, got: Column) -> Column:
    """Faults of answers against templates, both as XML: block, kind, level, in the order they are found; null for what is not well-formed."""

    def one(a: str | None, b: str | None) -> list[dict] | None:
        try:
            found = fill.faults(markup.parse(a), markup.parse(b))
        except (markup.ElementTree.ParseError, TypeError):
            return None
        return [{"block": f.block, "kind": f.kind, "level": f.level} for f in found]

    return arrow(one, "array<struct<block:int,kind:string,level:int>>")(want, got)
