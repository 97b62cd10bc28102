"""Shards of near equal bytes: longest processing time first, through a heap of shard loads."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, functions as F

from .common import materialize

ROW_BYTES = 8
UNITS_PER_SHARD = 128
ROWS_PER_RUN = 2_000
MAX_RUNS = 8_192


def schedule(sizes: list[tuple[object, int]], shards: int) -> dict[object, int]:
    """Longest processing time first: the largest unit goes to the least-loaded shard; ties by name and number."""
    loads = [(0, s) for s in range(shards)]
    placed = {}
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(loads)
        placed[name] = shard
        heapq.heappush(loads, (load + size, shard))
    return placed


def shard_rows(docs: DataFrame, shards: int = 24, units_per_shard: int = UNITS_PER_SHARD) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of docs (doc_id, text); equal texts stay together.

    A group is all rows of one text, found by a 64-bit hash (a collision only keeps two groups together). Groups larger
    than 1/(shards * units_per_shard) of all bytes are scheduled alone; there can be no more of them than that. The
    smaller ones are first bundled by hash into as many bundles. So the driver's heap sees at most twice
    shards * units_per_shard units whatever the input, and loads differ by about one unit. Slots number the rows of a shard
    from 0: rows are dealt into runs by a hash of the whole row, numbered inside runs, and shifted by the counts of
    earlier runs, so neither a hot text nor a shard is ever in one task. Null texts count as empty; null doc_ids are
    kept; repeated rows are rows; an empty table gives an empty result.
    """
    text, units = F.coalesce(F.col("text").cast("string"), F.lit("")), shards * units_per_shard
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    rows = materialize(rows, "rows")
    groups = materialize(rows.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    alone = F.col("bytes") * units > total["bytes"]
    unit = groups.select(F.when(alone, F.col("h")).alias("h"), F.when(~alone, F.pmod("h", F.lit(units))).alias("bundle"), "bytes").groupBy("h", "bundle").agg(F.sum("bytes").alias("bytes"))
    found = [((r["bundle"] is None, r["h"] if r["bundle"] is None else r["bundle"]), r["bytes"]) for r in unit.collect()]  # at most 2 * units
    placed = schedule(found, shards)
    spark = docs.sparkSession
    large = spark.createDataFrame([(k, s) for (own, k), s in placed.items() if own], "h long, large int")
    of_bundle = F.array(*[F.lit(placed.get((False, b), 0)) for b in range(units)]) if placed else F.array(F.lit(0))
    small = F.element_at(of_bundle, (F.pmod("h", F.lit(units)) + 1).cast("int"))
    runs = min(MAX_RUNS, 1 + total["n"] // ROWS_PER_RUN)
    dealt = rows.join(F.broadcast(large), "h", "left").withColumn("shard", F.coalesce("large", small).cast("int"))
    dealt = dealt.withColumn("run", F.pmod(F.xxhash64("doc_id", "h"), F.lit(runs)).cast("int")).select("doc_id", "size", "text_crc32", "shard", "run")
    return _slots(materialize(dealt, "dealt"))


def _slots(dealt: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    counts = dealt.groupBy("shard", "run").agg(F.count("*").alias("n"))  # at most shards * MAX_RUNS rows
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")
    numbered = dealt.withColumn("at", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(counts), ["shard", "run"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at")).cast("long").alias("slot"))


def query(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract, under the law `bytes`."""
    found = shard_rows(docs)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
