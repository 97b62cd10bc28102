"""Connected components by randomised contraction: every round is joins and minimum aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import lean, materialize

#: So many edges are joined in one task, at most.
FEW = 1 << 18


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the least node of the component of each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(nodes)))

    def find(k: int) -> int:
        while (up := root[k]) != k:
            root[k] = k = root[up]
        return k

    for x, y in zip(*at.reshape(2, -1).tolist(), strict=True):
        if (x := find(x)) != (y := find(y)):
            root[max(x, y)] = min(x, y)
    return nodes, nodes[[find(k) for k in range(len(nodes))]]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")] for b in batches if b.num_rows]
    if edges:
        nodes, least = joined(*(np.concatenate(c) for c in zip(*edges, strict=True)))
        yield pa.record_batch([pa.array(nodes), pa.array(least)], ["node", "to"])


def connected_components(edges: DataFrame, max_rounds: int = 200, few: int = FEW) -> DataFrame:
    """Components of an undirected graph.

    edges: two long columns a and b; loops, repeats and nulls are dropped. Returns node, component, where the
    component is one of its nodes; nodes without an edge to another node are absent. Each round every node moves to the
    neighbour with the least hash of (node, round), if less than its own, and edges are mapped along; a constant share
    of the nodes goes in a round whatever the shape (chains and stars alike). Rounds are written as tables, so lineage
    stays short, and minima are combined before the shuffle, so hubs do not overload a task. Once up to `few` edges are
    left, one task joins them all: rounds over little would each be dealt to all tasks of a shuffle.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    live = materialize(pairs.where("a IS NOT NULL AND b IS NOT NULL AND a <> b"), "edges")
    moves: list[DataFrame] = []
    for turn in range(max_rounds):
        if (left := live.count()) <= few:
            if left:
                moves.append(materialize(live.coalesce(1).mapInArrow(lean(_joined), "node long, to long"), "move"))
            break
        live = live if turn else materialize(live.distinct(), "edges")
        both = live.union(live.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        move = materialize(least.select(F.col("a").alias("node"), F.least(F.col("m"), rank("a")).getField("n").alias("to")), "move")
        moves.append(move)
        step = live.join(move.withColumnRenamed("node", "a"), "a").select(F.col("to").alias("x"), "b")
        step = step.join(move.withColumnRenamed("node", "b"), "b").select("x", F.col("to").alias("y")).where("x <> y")
        live = materialize(step.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    if not moves:
        return pairs.where("false").select(F.col("a").alias("node"), F.col("b").alias("component"))
    label = moves.pop()
    while moves:
        later = label.select(F.col("node").alias("to"), F.col("to").alias("last"))
        label = moves.pop().join(later, "to", "left").select("node", F.coalesce("last", "to").alias("to"))
        if len(moves) % 4 == 0:
            label = materialize(label, "labels")
    return label.select("node", F.col("to").alias("component"))
