"""Checks of results and configurations, validation of answers, and small matching rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import flow


def contents_levels_answer(response: Column, letters: Column) -> tuple[Column, Column]:
    """Levels and error of an answer that maps letter ids to levels; as for titles, but without noise: levels start at 0.

    letters: the expected ids, in order.
    """
    body = F.when(response.contains("RESULT:"), F.btrim(F.element_at(F.split(response, "RESULT:"), -1), F.lit(" \n\t\r"))).when(F.ltrim(response).startswith("{"), F.btrim(response, F.lit(" \n\t\r")))
    found = F.from_json(body, "map<string, string>")
    missing, unexpected = flow.id_diff(letters, F.map_keys(found))
    raw = F.transform(letters, lambda k: F.call_function("regexp_extract", body, F.concat(F.lit('"'), k, F.lit('"\\s*:\\s*([0-9]+)\\s*[,}]')), F.lit(1)))
    levels = F.transform(raw, lambda r: F.nullif(r, F.lit("")).try_cast("int"))
    error = F.when(body.isNull(), "no result").when(found.isNull(), "no JSON object").when(F.size(missing) > 0, "missing ids").when(F.size(unexpected) > 0, "unexpected ids").when(F.exists(levels, lambda x: x.isNull()), "not an integer").when(F.exists(levels, lambda x: x > flow.LEVEL_RANGE[1]), "out of range")
    low = F.coalesce(F.array_min(levels), F.lit(0))
    return F.when(error.isNull(), F.transform(levels, lambda x: F.least(x - low, F.lit(flow.LAST_LEVEL)))), error


def error_text(kind: Column, selector: Column, hint: Column) -> Column:
    """A line of feedback on a structural error, with a hint of at most 30 characters."""
    short = F.when(F.length(hint) > 30, F.concat(F.substring(hint, 1, 27), F.lit("..."))).otherwise(hint)
    return F.concat_ws(" ", F.concat(F.lit("["), kind, F.lit("]")), selector, F.concat(F.lit("near '"), short, F.lit("'")))


def match_children(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """keys, child, found of children (keys, child, tag, id): by id once, the rest by place within the tag."""
    rank = lambda df, by, o: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "tag", *by).orderBy(o)))
    left = expected.withColumnRenamed("id", "_id")
    first = rank(left.where("_id IS NOT NULL"), ["_id"], "child").join(rank(actual.where("id IS NOT NULL").withColumnRenamed("id", "_id"), ["_id"], "found").select(*keys, "tag", "_id", "_n", "found"), [*keys, "tag", "_id", "_n"]).where("_n = 1").select(*keys, "child", "found")
    rest = left.join(first.select(*keys, "child"), [*keys, "child"], "left_anti")
    free = actual.join(first.select(*keys, "found"), [*keys, "found"], "left_anti")
    second = rank(rest, [], "child").join(rank(free, [], "found").select(*keys, "tag", "_n", "found"), [*keys, "tag", "_n"]).select(*keys, "child", "found")
    return first.union(second)


def asset_path(path: Column) -> Column:
    """A link target with forward slashes, relative to the output."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./)+", "")


def links_resolve(markdown: DataFrame, files: DataFrame) -> DataFrame:
    """book, target: link targets of Markdown (book, markdown) that no file (book, name) answers."""
    found = markdown.select("book", F.explode(F.regexp_extract_all("markdown", F.lit(r"!\[[^\]]*\]\(([^)\s]+)"))).alias("target"))
    own = found.where(~F.col("target").rlike(r"^(?:https?:|data:|#)")).select("book", asset_path(F.col("target")).alias("target")).distinct()
    return own.join(files.select("book", F.col("name").alias("target")), ["book", "target"], "left_anti")


def largest_fit(low: Column, high: Column, fits: Callable[[Column], Column]) -> Column:
    """The largest size on quarter points between low and high that fits; null if none does."""
    quarters = F.transform(F.sequence(F.ceil(low * 4).cast("int"), F.floor(high * 4).cast("int")), lambda q: q / 4.0)
    return F.array_max(F.filter(quarters, fits))


def unknown(values: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Values of a configuration that the known set lacks."""
    return values.join(known.select(key).distinct(), key, "left_anti").select(key).distinct()


def ignorable(error_kind: Column, ignore: bool | list[str]) -> Column:
    """Whether an error may pass: all, none, or those of the named kinds."""
    return F.lit(ignore) if isinstance(ignore, bool) else error_kind.isin(*ignore)


RETRY_STATUS = (408, 409, 429, 500, 502, 503, 504)  # fixed values


def retryable(status: int | None, name: str) -> bool:
    """Whether a failed request is worth another try: by status, or by the name of a connection error."""
    return status in RETRY_STATUS if status is not None else name in ("ConnectionError", "Timeout", "ConnectTimeout", "ReadTimeout", "RemoteProtocolError", "APIConnectionError", "APITimeoutError")
