"""SimHash near-duplicates: segment popcounts, a grid join in Manhattan distance, an exact check."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import lean, materialize, text_batches
from .components import connected_components

SEED = 42
SEGMENTS = 32
BLOCKS = 6
CELL_CAP = 1024
SLICE = 1 << 15


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of some unsigned 64-bit hashes, as a signed long; 0 if there is no hash."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE].astype("<u8", copy=False)
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, as a signed long; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = None
    counts, total, join, digest = np.zeros(64, np.int64), max(1, len(words) - width + 1), b" ".join, xxhash.xxh64_intdigest
    for at in range(0, total, SLICE):
        part = words[at : at + SLICE + width - 1]
        some = hashes or [digest(s, SEED) for s in map(join, zip(*(part[k:] for k in range(width)), strict=False))]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, th (hash of the text), fp (signed long) of every row; null texts count as empty."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = [fingerprint(t, width) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("th"), pa.array(found, pa.int64())], ["doc_id", "th", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, "doc_id long, th long, fp long")


def popcounts(fps: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """Bits set in each of the equal segments, one row per fingerprint."""
    width = 64 // segments
    shifts = np.arange(segments, dtype=np.uint64) * np.uint64(width)
    return np.bitwise_count((fps.view(np.uint64)[:, None] >> shifts) & np.uint64((1 << width) - 1)).astype(np.uint8)


def grid_cells(fps: np.ndarray, segments: int = SEGMENTS, blocks: int = BLOCKS, radius: int = 2) -> np.ndarray:
    """Cells of each fingerprint, one column per choice of `radius` free blocks of segments.

    A cell is the popcounts of all other blocks; free segments hold the value 3, which no 2-bit segment reaches. Each
    differing bit changes the popcount of one segment only, so fingerprints within the radius agree on every block but
    `radius` of them and share a cell.
    """
    counts, of_block = popcounts(fps, segments).astype(np.uint64), np.arange(segments) * blocks // segments
    shifts = np.arange(segments, dtype=np.uint64) * np.uint64(64 // segments)
    columns = []
    for free in combinations(range(blocks), radius):
        open_ = np.isin(of_block, free)
        fixed = np.bitwise_or.reduce(counts[:, ~open_] << shifts[~open_], axis=1)
        columns.append(fixed | np.bitwise_or.reduce(np.uint64(3) << shifts[open_]))
    return np.stack(columns, 1).view(np.int64)


def linked(fps: np.ndarray, radius: int = 2) -> list[tuple[int, int]]:
    """A spanning forest of the fingerprints within the radius: Manhattan bound first, exact bits after."""
    fps = np.unique(fps)
    counts, root, out = popcounts(fps).astype(np.int16), list(range(len(fps))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    wide = fps.view(np.uint64)
    for i in range(len(fps) - 1):
        near = np.flatnonzero(np.abs(counts[i + 1 :] - counts[i]).sum(1) <= radius) + i + 1
        for j in near[np.bitwise_count(wide[near] ^ wide[i]) <= radius].tolist():
            if (x := find(i)) != (y := find(j)):
                root[y] = x
                out.append((int(fps[i]), int(fps[j])))
    return out


def links(fps: DataFrame, radius: int = 2, cap: int = CELL_CAP) -> DataFrame:
    """Edges a, b that span every group of distinct fingerprints (column fp) linked within the radius.

    Cells of up to `cap` fingerprints are joined in place. Fingerprints of larger cells are dealt out by their
    neighbours at one bit, at most 65 to each: two of them within 2 bits share one, so nothing is lost.
    """
    if radius != 2:
        raise ValueError("the exact way for crowded cells is for a radius of 2")

    @lean
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            keys = grid_cells(values, radius=radius)
            yield pa.record_batch([pa.array(keys.ravel()), pa.array(np.repeat(values, keys.shape[1]))], ["cell", "fp"])

    @lean
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column(0).to_pylist():
                if found := linked(np.array(group, np.int64), radius):
                    a, b = zip(*found, strict=True)
                    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    placed = materialize(fps.mapInArrow(cells, "cell long, fp long"), "cells")
    full = materialize(placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "full")
    met = materialize(placed.join(full, "cell"), "met")
    near = met.where(F.col("n") <= cap).groupBy("cell").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(join, "a long, b long")
    crowded = met.where(F.col("n") > cap).select("fp").distinct()
    flips = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    star = crowded.select("fp", F.explode(flips).alias("at")).groupBy("at").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))
    far = star.where(F.size("all") > 1).select("a", F.explode("all").alias("b"))
    return near.union(far)


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, th, fp, component, component_id of every row of docs (doc_id, text); component is one of its fingerprints.

    Rows link if their fingerprints differ in at most 2 bits; the component is the smallest doc_id reachable. Null
    texts have the fingerprint of empty ones; rows with a null doc_id keep it and count as linked, but never name a
    component; repeated rows stay; an empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, width), "fingerprints")
    own = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    label = materialize(connected_components(links(own.select("fp"))), "labels")
    named = own.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialize(named, "named")
    least = materialize(named.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    whole = materialize(named.join(least, "component").select("fp", "component", "component_id"), "whole")
    return rows.join(whole, "fp").select("doc_id", "th", "fp", "component", "component_id")


def first_of_groups(docs: DataFrame, width: int = 3, found: DataFrame | None = None) -> DataFrame:
    """docs without near-duplicates: of each group the row with the smallest doc_id, all columns kept.

    Groups are those of near_duplicates(), or `found` with columns doc_id, th, component, component_id.

    Of several rows with that id one is chosen by the hash of its text; exact repeats of it leave one row. A group with null
    ids only keeps one row too.
    """
    found = near_duplicates(docs, width) if found is None else found
    named = found.where(F.col("doc_id").isNotNull() | F.col("component_id").isNull())
    chosen = named.groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("c")).select(F.col("c.doc_id").alias("_id"), F.col("c.th").alias("_th"))
    chosen = materialize(chosen, "chosen")
    keyed = docs.withColumn("_key", F.xxhash64("text"))
    kept = keyed.join(chosen, (keyed["_key"] == chosen["_th"]) & keyed["doc_id"].cast("long").eqNullSafe(chosen["_id"]))
    return kept.dropDuplicates(["doc_id", "_key"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
