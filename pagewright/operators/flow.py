"""Operators of translation, repair and metering: packing, matching, validation, best attempts, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .walk import Step, walk

# Title levels an answer may give, the largest jump between neighbours, and the last level kept.
LEVEL_RANGE, LEVEL_JUMP, LAST_LEVEL = (-1, 5), 2, 3


def estimate_tokens(c: Column) -> Column:
    """Tokens of a text when no tokenizer is plugged in: a quarter of its characters, rounded up."""
    return F.ceil(F.length(c) / 4).cast("long")


def pack(rows: DataFrame, keys: list[str], order: str, cost: str, limit: int) -> DataFrame:
    """keys, order, pack of rows: consecutive rows share a pack, numbered from 0, as long as their costs stay within the limit.

    Where a pack ends depends on all before it, so a sequence is walked once, with two running numbers.
    """

    def make() -> Step:
        held, number = 0, -1

        def step(row: tuple | None) -> list[tuple]:
            nonlocal held, number
            if row is None:
                return []
            at, own = row
            fits = number >= 0 and own is not None and held + own <= limit
            held, number = (held + own, number) if fits else (own or 0, number + 1)
            return [(at, number)]

        return step

    x = rows.select(*keys, F.col(order).cast("long").alias(order), F.col(cost).cast("long").alias("_cost"))
    return walk(x, keys, [order, "_cost"], make, f"{order} long, pack long")


def context(rows: DataFrame, keys: list[str], order: str, cost: str, remain: int) -> DataFrame:
    """Adds context: how many rows right before each row fit into `remain` tokens, the one that crosses it included.

    Rows cost one token at least. The rows in reach are those whose costs before them lie within `remain` of the row's own, so a
    range over the running sum holds them, however many there are.
    """
    own = F.greatest(F.col(cost).cast("long"), F.lit(1).cast("long"))
    x = rows.withColumn("_before", F.coalesce(F.sum(own).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    reach = F.count("*").over(Window.partitionBy(*keys).orderBy("_before").rangeBetween(1 - remain, 0))
    # the range holds the row itself in place of the one before it, and the first row, which stands for none
    return x.withColumn("context", (reach - F.when(F.col("_before") < remain, 1).otherwise(0)).cast("int")).drop("_before")


def without_margins(parts: Column, head: Column, tail: Column) -> Column:
    """The middle of transformed parts: `head` at the front and `tail` at the end were only context."""
    return F.slice(parts, head + 1, F.greatest(F.size(parts) - head - tail, F.lit(0)))


def last_messages(messages: Column, n: int) -> Column:
    return F.slice(messages, F.greatest(F.size(messages) - n, F.lit(0)) + 1, n)


def best_attempts(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, attempt, weight, response: for each block the response of least error weight, the earliest of equals."""
    best = F.min_by(F.struct("attempt", "weight", "response"), F.struct("weight", "attempt"))
    return attempts.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def id_diff(expected: Column, actual: Column) -> tuple[Column, Column]:
    """Missing and unexpected ids."""
    return F.array_except(expected, actual), F.array_except(actual, expected)


def top_errors(errors: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The first errors (keys, level, index1, index2) by falling level, then place."""
    w = Window.partitionBy(*keys).orderBy(F.desc("level"), "index1", "index2")
    return errors.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def error_weights(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Weight of each block: the sum over errors of 3 to the level, times the number of ids; and its rank, heaviest first."""
    own = errors.groupBy(*keys, "block").agg(F.sum(F.pow(F.lit(3), "level") * F.greatest(F.col("n_ids"), F.lit(1))).cast("long").alias("weight"))
    return own.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("weight"), "block")).cast("long"))


def unique_ids(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Adds unique_id: the second of an id gets a suffix, later ones a suffix and a number."""
    n = F.row_number().over(Window.partitionBy(*keys, name).orderBy(order))
    return rows.withColumn("unique_id", F.when(n == 1, F.col(name)).when(n == 2, F.concat(F.col(name), F.lit("__translated"))).otherwise(F.concat(F.col(name), F.lit("__translated_"), (n - 1).cast("string"))))


def budget(rows: DataFrame, keys: list[str], order: str, spent: Column, limit: int) -> DataFrame:
    """Rows that start while what earlier rows spent is below the limit; the one that crosses it still runs."""
    w = Window.partitionBy(*keys).orderBy(order)
    x = rows.withColumn("_spent", spent)
    x = x.withColumn("spent_before", F.coalesce(F.sum("_spent").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    return x.where(F.col("spent_before") < limit).drop("_spent")


def merge_maps(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of both sides; where both have a key, the new values win."""
    o, n = old.select(*keys, *[F.col(v).alias(f"_o_{v}") for v in values]), new.select(*keys, *[F.col(v).alias(f"_n_{v}") for v in values])
    return o.join(n, keys, "full_outer").select(*keys, *[F.coalesce(f"_n_{v}", f"_o_{v}").alias(v) for v in values])


def match_entries(entries: DataFrame, elements: DataFrame, keys: list[str]) -> DataFrame:
    """keys, entry, element: contents entries (keys, entry, id, href) matched with elements (keys, element, id, href) by id, then by
    address, then in order of what is left on both sides. Entries without a partner have a null element.
    """

    def pairs(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
        rank = lambda df, o: df.where(F.coalesce(F.col(by), F.lit("")) != "").withColumn("_n", F.row_number().over(Window.partitionBy(*keys, by).orderBy(o)))
        return rank(left, "entry").join(rank(right, "element").select(*keys, by, "_n", "element"), [*keys, by, "_n"]).select(*keys, "entry", "element")

    done = pairs(entries, elements, "id")
    left, right = entries.join(done.select(*keys, "entry"), [*keys, "entry"], "left_anti"), elements.join(done.select(*keys, "element"), [*keys, "element"], "left_anti")
    second = pairs(left, right, "href")
    left, right = left.join(second.select(*keys, "entry"), [*keys, "entry"], "left_anti"), right.join(second.select(*keys, "element"), [*keys, "element"], "left_anti")
    place = lambda df, o: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(o)))
    third = place(left, "entry").join(place(right, "element").select(*keys, "_n", "element"), [*keys, "_n"], "left").select(*keys, "entry", "element")
    return done.union(second).union(third)


def keep_with_body(nodes: DataFrame, bodies: DataFrame, keys: list[str]) -> DataFrame:
    """Contents nodes (keys, id, path) that have a body or an ancestor role for one: each body keeps its whole path."""
    kept = nodes.join(bodies.select(*keys, "id"), [*keys, "id"], "left_semi").select(*keys, F.explode("path").alias("id")).distinct()
    return nodes.join(kept, [*keys, "id"], "left_semi")


def title_levels(response: Column, count: Column) -> tuple[Column, Column]:
    """Levels and error of an answer that maps "0" .. to levels: ids complete, whole numbers in range, jumps of two at most.

    Levels are shifted so that the least is 0, and cut at the last level; -1 marks noise and stays. Numbers are checked as
    written, so true, "1" and 1.0 are no levels.
    """
    body = F.when(response.contains("RESULT:"), F.btrim(F.element_at(F.split(response, "RESULT:"), -1), F.lit(" \n\t\r"))).when(F.ltrim(response).startswith("{"), F.btrim(response, F.lit(" \n\t\r")))
    found = F.from_json(body, "map<string, string>")
    want = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i.cast("string"))
    missing, unexpected = id_diff(want, F.map_keys(found))
    raw = F.transform(want, lambda k: F.call_function("regexp_extract", body, F.concat(F.lit('"'), k, F.lit('"\\s*:\\s*(-?[0-9]+)\\s*[,}]')), F.lit(1)))
    levels = F.transform(raw, lambda r: F.nullif(r, F.lit("")).try_cast("int"))
    valid = F.filter(levels, lambda x: x >= 0)
    before = F.zip_with(F.slice(valid, F.lit(1), F.greatest(F.size(valid) - 1, F.lit(0))), F.slice(valid, F.lit(2), F.greatest(F.size(valid) - 1, F.lit(0))), lambda a, b: b - a > LEVEL_JUMP)
    error = (
        F.when(body.isNull(), "no result")
        .when(found.isNull() | (F.map_contains_key(found, "_corrupt_record")), "no JSON object")
        .when(F.size(missing) > 0, "missing ids")
        .when(F.size(unexpected) > 0, "unexpected ids")
        .when(F.exists(levels, lambda x: x.isNull()), "not an integer")
        .when(F.exists(levels, lambda x: (x < LEVEL_RANGE[0]) | (x > LEVEL_RANGE[1])), "out of range")
        .when(F.exists(before, lambda x: x), "jump")
        .when(F.try_element_at(valid, F.lit(1)) > 1, "first level")
    )
    shift = F.coalesce(F.array_min(valid), F.lit(0))
    return F.when(error.isNull(), F.transform(levels, lambda x: F.when(x >= 0, F.least(x - shift, F.lit(LAST_LEVEL))).otherwise(-1))), error


def common_depth(a: Column, b: Column) -> Column:
    """How many leading elements two paths share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    stop = F.array_position(same, False)
    depth = F.when(stop > 0, stop - 1).otherwise(F.least(F.size(a), F.size(b))).cast("long")
    return F.when(a.isNotNull() & b.isNotNull(), depth)


def incision(depth: Column, blocks: Column, common: Column) -> Column:
    """How well a text run may be cut from its neighbour: three per block level, one per inline level."""
    return F.when(common >= blocks, depth - common).otherwise((blocks - common) * 3 + depth - blocks)
