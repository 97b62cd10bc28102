"""What users supply: recognition, language models, tokenizers and PDF writers, with the loops around them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby, pairwise
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from pagewright.functions import answers
from pagewright.operators import flow
from pagewright.operators.paragraphs import ASSETS
from pagewright.session import scratch_folder

LAYOUTS = "doc_id long, page_index int, section string, ord long, ref string, l int, t int, r int, b int, text string"


class OcrFn(Protocol):
    """One page image to layout rows (section, ref, l, t, r, b, text) in reading order."""

    def __call__(self, image: bytes) -> list[dict[str, Any]]: ...


class LlmFn(Protocol):
    def __call__(self, messages: list[dict[str, str]]) -> str: ...


class TokenizerFn(Protocol):
    def __call__(self, text: str) -> int: ...


class PdfWriterFn(Protocol):
    """Draws checked replacements of one document over its pages."""

    def __call__(self, source: str, target: str, rows: list[dict[str, Any]]) -> None: ...


@dataclass(frozen=True)
class OcrConfig:
    """A named recogniser: local ones have a model folder, remote ones an address and a key, never both."""

    name: str
    model_path: str | None = None
    url: str | None = None
    key: str | None = field(default=None, repr=False)
    size: str = "default"

    def __post_init__(self) -> None:
        if bool(self.model_path) == bool(self.url):
            raise ValueError("give either a model path or an address")


@dataclass(frozen=True)
class LlmConfig:
    url: str
    model: str
    key: str = field(repr=False, default="")
    timeout: float = 360.0
    retries: int = 5
    temperature: tuple[float, float] = (0.6, 0.6)
    top_p: tuple[float, float] = (0.8, 0.8)
    cache_path: str | None = None


_RECOGNISERS: dict[str, Callable[[OcrConfig], OcrFn]] = {}


def register_ocr(name: str, make: Callable[[OcrConfig], OcrFn]) -> None:
    """Makes a recogniser known by name, for recogniser()."""
    _RECOGNISERS[name] = make


def recogniser(config: OcrConfig) -> Callable[[], OcrFn]:
    """What makes the recogniser of a configuration: late, once in each task, so that models load where they run."""
    if config.name not in _RECOGNISERS:
        raise ValueError(f"no recogniser {config.name}; known are {sorted(_RECOGNISERS)}")
    make = _RECOGNISERS[config.name]
    return lambda: make(config)


def recognise(pages: DataFrame, make: Callable[[], OcrFn] | OcrConfig) -> DataFrame:
    """Layout rows of pages (doc_id, page_index, image): the recogniser is made once per task; order is dense in each section.

    Rows keep the order the recogniser gives; degenerate boxes go. A recogniser may read a page in two stages, the second without
    what the first has found: rows of stage 2 are footnotes, and assets among them go, as the first stage has them already.
    """
    make = recogniser(make) if isinstance(make, OcrConfig) else make

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ocr = make()
        for batch in batches:
            rows = []
            for p in batch.itertuples():
                for k, x in enumerate(ocr(bytes(p.image))):
                    second = x.get("stage", 1) > 1
                    if not (second and x["ref"] in ASSETS):
                        rows.append((p.doc_id, p.page_index, "footnote" if second else x.get("section", "body"), k, x["ref"], x["l"], x["t"], x["r"], x["b"], x["text"]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LAYOUTS.split(", ")])

    rows = pages.select("doc_id", "page_index", "image").mapInPandas(run, LAYOUTS).where("l < r AND t < b")
    order = Window.partitionBy("doc_id", "page_index", "section").orderBy("ord")
    return rows.withColumn("ord", F.row_number().over(order) - 1)


def image_pages(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """doc_id, page_index, image of page images `<document number>/<page number>.<type>` under a path, for recognise()."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    part = lambda k: F.regexp_extract("path", r"(\d+)/\D*(\d+)\.[^./]+$", k)
    return files.select(part(1).cast("long").alias("doc_id"), part(2).cast("int").alias("page_index"), F.col("content").alias("image")).where("page_index IS NOT NULL")


class Exhausted(RuntimeError):
    """All tries failed; holds the last answer and error."""

    def __init__(self, message: str, attempts: int, response: str | None) -> None:
        super().__init__(message)
        self.attempts, self.response = attempts, response


def repair_loop(messages: list[dict[str, str]], request: LlmFn, check: Callable[[str, int], Any], attempts: int = 3, history: int = 2) -> Any:
    """Asks until check accepts an answer. check raises ValueError with feedback for the model; the first messages stay, of the
    later ones the last `history` are sent again.
    """
    later: list[dict[str, str]] = []
    response, error = None, None
    for k in range(attempts):
        response = request([*messages, *later[-history:]])
        if not response or not response.strip():
            error = ValueError("empty answer")
            later = [{"role": "user", "message": "Return a non-empty complete answer."}]
            continue
        try:
            return check(response, k)
        except ValueError as e:
            error = e
            later = [*later, {"role": "assistant", "message": response}, {"role": "user", "message": str(e)}]
    raise Exhausted(str(error), attempts, response)


def guaranteed_json(messages: list[dict[str, str]], request: LlmFn, accept: Callable[[Any], Any], attempts: int = 13, shape: Any = None) -> Any:
    """A JSON answer of the given shape (see answers.faults) that accept takes; accept raises ValueError for business errors.

    Each kind of fault gets feedback of its own; a second refusal in words ends the loop early.
    """

    def check(response: str, k: int) -> Any:
        try:
            value = answers.json_value(response)
        except ValueError:
            if k > 0 and answers.declines(response):
                raise Exhausted("the model declines", k + 1, response) from None
            raise ValueError("This could not be read as JSON. Answer with one JSON value and nothing around it.") from None
        if shape is not None and (wrong := answers.faults(value, shape)):
            raise ValueError("The JSON has another shape than asked for. " + "; ".join(wrong) + ". Answer with the whole value again.")
        return accept(value)

    return repair_loop(messages, request, check, attempts)


LEVELS_PROMPT = """These are the headings of a book, numbered from 0. Give each its level: 0 for the highest, at most 5, and -1 for what is no heading. A level is at most 2 deeper than the one before it.
Answer with RESULT: and one JSON object that maps every number to its level."""


def levels_of(answer: str, n: int) -> list[int]:
    """Levels of n headings in an answer, shifted so that the least is 0 and cut at the last one kept; -1 marks noise. ValueError with
    feedback if a number is missing or not asked for, a level is no whole number or out of range, or one is too deep.
    """
    value = answers.json_value(answer.rpartition("RESULT:")[2])
    wrong = answers.faults(value, {str(k): int for k in range(n)}, "levels")
    if wrong:
        raise ValueError("; ".join(wrong))
    levels = [value[str(k)] for k in range(n)]
    low, high = flow.LEVEL_RANGE
    real = [v for v in levels if v >= 0]
    if any(not low <= v <= high for v in levels):
        raise ValueError(f"levels are from {low} to {high}")
    if real and real[0] > 1 or any(b - a > flow.LEVEL_JUMP for a, b in pairwise(real)):
        raise ValueError(f"a level is at most {flow.LEVEL_JUMP} deeper than the one before it, and the first is 0 or 1")
    least = min(real, default=0)
    return [min(v - least, flow.LAST_LEVEL) if v >= 0 else -1 for v in levels]


def level_asker(make: Callable[[], LlmFn], attempts: int = 3) -> Callable[[DataFrame], DataFrame]:
    """What Conversion takes as `levels`: asks a model for the levels of the titles of each book, with feedback on answers that do not do.

    Books for which no answer does have no rows, so the sizes of their titles decide.
    """

    def levels(titles: DataFrame) -> DataFrame:
        def one(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["page_index", "ord"])
            listed = "\n".join(f"{k}. {t}" for k, t in enumerate(rows.title))
            messages = [{"role": "system", "message": LEVELS_PROMPT}, {"role": "user", "message": listed}]
            try:
                found = repair_loop(messages, make(), lambda answer, k: levels_of(answer, len(rows)), attempts)
            except Exhausted:
                return rows[["book", "page_index", "ord"]].head(0).assign(level=pd.Series(dtype="int64"))
            return rows[["book", "page_index", "ord"]].assign(level=found)

        kinds = ", ".join(f"{c} {titles.schema[c].dataType.simpleString()}" for c in ("book", "page_index", "ord"))
        return titles.select("book", "page_index", "ord", "title").groupBy("book").applyInPandas(one, f"{kinds}, level long")

    return levels


def translate(rows: DataFrame, column: str, make: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """Replaces a text column by what a supplied function makes of it, batch by batch."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        function = make()
        for s in batches:
            yield pd.Series(function(s.fillna("").tolist()))

    return rows.withColumn(column, run(F.col(column)))


def patch(replacements: DataFrame, fits: Callable[[dict[str, Any]], bool], write: Callable[[Iterable[dict[str, Any]]], None], path: str | None = None) -> int:
    """Two phases: all replacements are checked first, and nothing is drawn if one does not fit; then documents are written in tasks.

    The checked rows are stored once, under `path` or the session's shared folder, so the plan below runs once; the count is that of
    the rows that were written.
    """
    names, spark = replacements.columns, replacements.sparkSession

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array([bool(fits(r)) for r in batch.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, good], [*names, "_fits"])

    target = path or f"{scratch_folder(spark)}/patch-{uuid.uuid4().hex}"
    schema = StructType([*replacements.schema.fields, StructField("_fits", BooleanType())])
    replacements.mapInArrow(check, schema).write.mode("overwrite").parquet(target)
    rows = spark.read.schema(schema).parquet(target)
    bad = rows.where("NOT _fits").drop("_fits").limit(5).collect()
    if bad:
        raise ValueError(f"{len(bad)} or more replacements do not fit, among them {bad[0].asDict()}")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One call of the writer for each document; its rows are next to each other."""
        rows_in = (r for batch in batches for r in batch.to_pylist())
        n = 0
        for _, own in groupby(rows_in, key=lambda r: r["doc_id"]):
            held = list(own)
            write(held)
            n += len(held)
        yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    dealt = rows.drop("_fits").repartition("doc_id").sortWithinPartitions("doc_id", "page_index", "ord")
    return dealt.mapInArrow(draw, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
