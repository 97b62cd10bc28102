"""Documents whose word shingles have a Jaccard similarity of at least 0.8: SimHash, then a prefix filter for the rest.

The SimHash operator finds the sets whose fingerprints differ in at most two bits; those of them that are similar by an
exact check are one group from then on. Similar sets can differ in more bits than that. These are found by their
prefixes: in one order of all shingles, two sets that similar share a shingle in the first fifth of each; so all pairs
meet in a shingle of their prefixes. Long sets are cut into parts by their hashes, and one part of similar sets is as
similar as the whole; so parts meet, by their own prefixes, and bitmaps need not grow. Shingles common in a sample come
last in the order, which decides how many pairs meet, not which are found. The differing bits of two parity bitmaps never
outnumber the differing shingles, so bitmaps drop unlike pairs without loss. Of what is left, as many pairs as span the
groups are compared shingle by shingle; where one fails, all of that group are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import drop_scratch, lean, materialize, release, sampled, scratch, text_batches
from .components import connected_components
from .simhash import SEED, links, majority

WIDTH = 5
#: Sets are similar if NUMERATOR / DENOMINATOR of the shingles in either are in both.
NUMERATOR, DENOMINATOR = 4, 5
SAMPLE = 20_000
COMMON = 3
COMMON_MOST = 20_000
CROWD = 64
SHARD_ROWS = 200_000
BUCKETS = 1 << 18
BITS_MOST = 1 << 16
#: What travels with each token of a part: the part's bitmap, folded to so many words of 64 bits.
SKETCH_WORDS = 4
#: Sets are cut by the first bits of the hashes, so many bits at a time, until parts have fewer shingles than this on average.
PART_SIZE, SPLIT_BITS = 384, 2
#: Tokens of the first part that are dealt before all others.
LEADING = 3


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the word shingles of a text, ascending; a text of fewer words has one, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = zip(*(words[k:] for k in range(min(width, len(words)))), strict=False)
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, parts)], np.uint64))


def bitmap(found: np.ndarray) -> bytes:
    """Parity of the shingles in each residue modulo a power of two, about as many bits as shingles."""
    bits = min(BITS_MOST, max(64, 1 << len(found).bit_length()))
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch(bits: bytes) -> bytes:
    """A bitmap folded to SKETCH_WORDS; bits of it that differ between two sets still never outnumber their shingles that do."""
    words = np.frombuffer(bits, np.uint64)
    return np.bitwise_xor.reduce(words.reshape(-1, min(len(words), SKETCH_WORDS)), 0).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Shingles that are in one of two sets only, at least; the larger bitmap is folded to the size of the other."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    x, y = (x, y) if len(x) >= len(y) else (y, x)
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), 0) ^ y).sum())


def prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of all shingles, as many as similar sets must share one of."""
    if not len(found):
        return found
    at = np.minimum(np.searchsorted(common, found), max(0, len(common) - 1))
    late = common[at] == found if len(common) else np.zeros(len(found), bool)
    return found[np.argsort(late, kind="stable")][: len(found) + NUMERATOR * len(found) // -DENOMINATOR + 1]


def cut(size: int) -> int:
    """Bits of a hash that tell the part, for sets of which the larger has this size."""
    bits = 0
    while size >> bits >= PART_SIZE:
        bits += SPLIT_BITS
    return bits


def parts(found: np.ndarray, common: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """number, shingles and tokens of each part of a set; two sets that are similar have a similar part, cut alike.

    Shares of a whole cannot all fall short of what the whole reaches. Parts are cut as the size of the larger set asks,
    so a set is cut in each way that sets up to 5/4 of its size are. Tokens are the prefix, told apart by the cut.
    """
    for bits in sorted({cut(len(found)), cut(DENOMINATOR * len(found) // NUMERATOR)}):
        edges = np.searchsorted(found, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
        for at, part in enumerate(np.split(found, edges)):
            if len(part):
                yield at, part, prefix(part, common) ^ np.uint64(bits * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def similar(x: int, y: int, both: int) -> bool:
    return (NUMERATOR + DENOMINATOR) * both >= NUMERATOR * (x + y)


def _common(rows: DataFrame, width: int) -> np.ndarray:
    """Shingles that several texts of a sample hold."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = [shingles(t, width) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64))], ["token"])

    share = min(1.0, SAMPLE / max(1, rows.count()))
    some = rows.where(sampled(F.col("th"), share)).dropDuplicates(["th"]).select("text").mapInArrow(run, "token long")
    most = some.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "token").limit(COMMON_MOST)
    return np.sort(np.array([r.token for r in most.collect()], np.int64).view(np.uint64))


def _scan(rows: DataFrame, width: int, common: np.ndarray) -> DataFrame:
    """doc_id, th, node (digest of the set), size, fp (SimHash of the set), bits, parts of every row."""
    kind = "array<struct<at: int, size: int, sketch: binary, tokens: array<long>>>"

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = [shingles(t, width) for t in batch.column("text").to_pylist()]
            node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in found], np.uint64).view(np.int64)
            cuts = [list(parts(s, common)) for s in found]
            each = [x for c in cuts for x in c]
            at, sizes = pa.array([k for k, _, _ in each], pa.int32()), pa.array([len(p) for _, p, _ in each], pa.int32())
            sketches = pa.array([sketch(bitmap(p)) for _, p, _ in each], pa.binary())
            tokens = pa.array([t.view(np.int64) for _, _, t in each], pa.list_(pa.int64()))
            flat = pa.StructArray.from_arrays([at, sizes, sketches, tokens], ["at", "size", "sketch", "tokens"])
            held = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cuts)]), pa.int32()), flat)
            sizes, prints = pa.array([len(s) for s in found], pa.int32()), pa.array([majority(s) for s in found], pa.int64())
            columns = [pa.array(node), sizes, prints, pa.array([bitmap(s) for s in found], pa.binary()), held]
            yield pa.record_batch([batch.column("doc_id"), batch.column("th"), *columns], ["doc_id", "th", "node", "size", "fp", "bits", "parts"])

    return rows.mapInArrow(run, f"doc_id long, th long, node long, size int, fp long, bits binary, parts {kind}")


class _Sets:
    """The sets of a partition, by token: which pairs of them can be similar by size, place of the token and sketch."""

    def __init__(self, columns: dict[str, np.ndarray]) -> None:
        order = np.lexsort((columns["node"], columns["token"]))
        self.token, self.node, self.size, self.pos, self.label = (columns.pop(c)[order] for c in ("token", "node", "size", "pos", "label"))
        bits = columns.pop("sketch")[order]
        self.level = np.array([len(x).bit_length() - 4 for x in bits], np.int8)
        top = SKETCH_WORDS.bit_length() - 1
        folded = np.frombuffer(b"".join(x.ljust(8 * SKETCH_WORDS, b"\0") for x in bits), np.uint64).reshape(-1, SKETCH_WORDS)
        self.folded = {top: folded}
        for level in range(top - 1, -1, -1):
            half = 1 << level
            folded = np.where((self.level > level)[:, None], folded[:, :half] ^ folded[:, half:], folded[:, :half])
            self.folded[level] = folded

    def _cuts(self) -> np.ndarray:
        return np.append(np.flatnonzero(np.append(True, self.token[1:] != self.token[:-1])), len(self.token))

    def crowds(self, crowd: int) -> list[tuple[int, int]]:
        """First row and end of each group of more than `crowd`."""
        cuts = self._cuts()
        at = np.flatnonzero(np.diff(cuts) > crowd)
        return list(zip(cuts[at].tolist(), cuts[at + 1].tolist(), strict=True))

    def meeting(self, crowd: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of rows, in groups of up to `crowd`, that are not in one component and whose sets can be similar."""
        sizes = np.diff(self._cuts())
        n, found = np.repeat(sizes, sizes), [(np.zeros(0, int), np.zeros(0, int))]
        for d in range(1, min(crowd, int(sizes.max()))):
            i = np.flatnonzero((self.token[d:] == self.token[:-d]) & (n[d:] <= crowd) & (self.label[d:] != self.label[:-d]))
            found.append(self.close(i, i + d))
        i, j = (np.concatenate(c) for c in zip(*found, strict=True))
        return i, j

    def nodes(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of all equal pairs of nodes of the pairs of rows, in the order of the nodes."""
        _, first = np.unique(np.stack([self.node[i], self.node[j]], 1), axis=0, return_index=True)
        return i[first], j[first]

    def gap(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits that differ in the sketches of rows i and j."""
        level, gap = np.minimum(self.level[i], self.level[j]), np.zeros(len(i), np.int64)
        for k, folded in self.folded.items():
            at = np.flatnonzero(level == k)
            gap[at] = np.bitwise_count(folded[i[at]] ^ folded[j[at]]).sum(1, dtype=np.int64)
        return gap

    def close(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of rows i and j whose sets can be similar, if the token is the first that they share."""
        x, y = self.size[i].astype(np.int64), self.size[j].astype(np.int64)
        keep = (NUMERATOR + DENOMINATOR) * np.minimum(x - self.pos[i], y - self.pos[j]) >= NUMERATOR * (x + y)
        i, j = i[keep], j[keep]
        both = self.size[i].astype(np.int64) + self.size[j]
        good = (NUMERATOR + DENOMINATOR) * self.gap(i, j) <= (DENOMINATOR - NUMERATOR) * both
        return i[good], j[good]


def _sets(batches: Iterator[pa.RecordBatch]) -> _Sets | None:
    """The rows of a partition, a node without a label is its own; none if it is empty."""
    parts = [b.set_column(b.schema.get_field_index("label"), "label", pc.coalesce(b.column("label"), b.column("node"))) for b in batches if b.num_rows]
    if not parts:
        return None
    names = parts[0].schema.names
    table = pa.Table.from_batches(parts)
    del parts  # each column goes as soon as it is an array
    columns = {}
    for name in names:
        columns[name] = table.column(name).to_numpy()
        table = table.drop_columns([name])
    return _Sets(columns)


def _mixed(x: np.ndarray, turn: int) -> np.ndarray:
    """Numbers in another order each turn."""
    x = (x.view(np.uint64) ^ np.uint64(turn * 0xD1B54A32D192ED03)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


def _walk(x: _Sets, start: int, end: int, turn: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that can be similar, enough to join all rows of a group that such pairs or labels join."""
    left = np.argsort(_mixed(x.node[start:end], turn), kind="stable") + start
    while len(left):
        near, left = left[:1].tolist(), left[1:]
        while near and len(left):
            one = near.pop()
            own = x.label[left] == x.label[one]
            _, found = x.close(np.full(len(left), one)[~own], left[~own])
            yield np.full(len(found), one), found
            met = own | np.isin(left, found, assume_unique=True)
            near += left[met].tolist()
            left = left[~met]


def _spanning(batches: Iterator[pa.RecordBatch], crowd: int, turn: int = 0) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes that can be similar: as many as span what all such pairs of the partition join, fewer than its nodes.

    The first turn takes those with the closest sketches, the next one any.
    """
    if (x := _sets(batches)) is None:
        return
    found = [x.meeting(crowd)]
    for start, end in x.crowds(crowd):
        found += _walk(x, start, end, turn)
    i, j = x.nodes(*(np.concatenate(c) for c in zip(*found, strict=True)))
    order = _mixed(x.node[i] ^ x.node[j], turn) if turn else x.gap(i, j) / (x.size[i].astype(np.int64) + x.size[j])
    order = np.argsort(order, kind="stable")
    i, j, root = i[order], j[order], dict[int, int]()

    def find(k: int) -> int:
        while (up := root.get(k, k)) != k:
            root[k] = k = root.get(up, up)
        return k

    keep = []
    for at, (p, q) in enumerate(zip(x.label[i].tolist(), x.label[j].tolist(), strict=True)):
        if (p := find(p)) != (q := find(q)):
            root[q] = p
            keep.append(at)
    yield pa.record_batch([pa.array(x.node[i[keep]]), pa.array(x.node[j[keep]])], ["a", "b"])


def _apart(batches: Iterator[pa.RecordBatch], crowd: int) -> Iterator[pa.RecordBatch]:
    """All pairs of nodes that can be similar and are not yet in one component."""
    if (x := _sets(batches)) is None:
        return
    i, j = x.nodes(*x.meeting(crowd))
    yield pa.record_batch([pa.array(x.node[i]), pa.array(x.node[j])], ["a", "b"])
    for start, end in x.crowds(crowd):
        _, of, n = np.unique(x.label[start:end], return_inverse=True, return_counts=True)
        few = np.append(np.flatnonzero(of != n.argmax()), np.flatnonzero(of == n.argmax())) + start
        for k in range(len(few) - int(n.max())):
            others = few[k + 1 :]
            others = others[x.label[others] != x.label[few[k]]]
            i, j = x.close(np.full(len(others), few[k]), others)
            if len(i):
                yield pa.record_batch([pa.array(x.node[i]), pa.array(x.node[j])], ["a", "b"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps allow them to be similar."""
    for batch in batches:
        sizes = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()
        gap = [least_difference(x, y) for x, y in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True)]
        keep = pa.array((NUMERATOR + DENOMINATOR) * np.array(gap, np.int64) <= (DENOMINATOR - NUMERATOR) * sizes.astype(np.int64))
        yield pa.record_batch([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that are similar."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            p, q = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
            keep.append(similar(len(p), len(q), len(np.intersect1d(p, q, True))))
        yield pa.record_batch([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])


def _edges(pairs: DataFrame, own: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """The similar ones of pairs of nodes."""

    @lean
    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = [shingles(t, width).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("node"), pa.array(found, pa.binary())], ["node", "set"])

    def beside(df: DataFrame, facts: DataFrame, side: str) -> DataFrame:
        return df.join(facts.select(*[F.col(c).alias(side if c == "node" else f"{c}_{side}") for c in facts.columns]), side)

    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    facts = own.select("node", "size", "bits")
    alike = materialize(beside(beside(pairs, facts, "a"), facts, "b").mapInArrow(lean(_alike), "a long, b long"), "alike")
    nodes = alike.select(F.col("a").alias("node")).union(alike.select("b")).distinct()
    wanted = materialize(own.join(nodes, "node").select("node", "th"), "wanted")
    # texts that cannot be wanted stay where they are: by remainders of their hashes, of which there are BUCKETS at most
    bucket = F.pmod("th", F.lit(BUCKETS))
    may = F.broadcast(wanted.select(bucket.alias("bucket")).distinct())
    some = rows.withColumn("bucket", bucket).join(may, "bucket", "left_semi")
    texts = some.groupBy("th").agg(F.first("text").alias("text"))  # copies are combined before the shuffle
    found = materialize(texts.join(wanted, "th").select("node", "text").mapInArrow(every, "node long, set binary"), "sets")
    return materialize(beside(beside(alike, found, "a"), found, "b").mapInArrow(lean(_exact), "a long, b long"), "similar")


def _by_fingerprints(own: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """The similar ones of the pairs of sets that the SimHash operator links."""
    some = own.where("size > 0").select("node", "fp")
    first = materialize(some.groupBy("fp").agg(F.min("node").alias("to")), "fingerprints")
    same = some.join(first, "fp").select("node", "to")
    side = lambda c: first.select(F.col("fp").alias(c), F.col("to").alias(f"node_{c}"))
    near = links(first.select("fp")).join(side("a"), "a").join(side("b"), "b").select("node_a", "node_b")
    return _edges(same.union(near).toDF("a", "b"), own, rows, width)


def near_duplicates(docs: DataFrame, width: int = WIDTH, crowd: int = CROWD) -> DataFrame:
    """doc_id, th, component, component_id of every row of docs (doc_id, text), as simhash.near_duplicates().

    Rows link if the Jaccard similarity of their sets of shingles is at least 0.8, and all without a word link. What
    SimHash links and is similar is joined first, then what the first tokens of the sets find, then by all tokens. Tokens of up to `crowd` sets form all pairs in their task, others walk
    from set to set; only pairs that span leave it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    with scratch() as made:
        scanned = materialize(_scan(rows, width, _common(rows, width)), "scanned")
    own = scanned.groupBy("node").agg(F.min("doc_id").alias("first"), F.first(F.struct("th", "size", "fp", "bits", "parts")).alias("x"))
    own = materialize(own.select("node", "first", "x.*"), "distinct")
    scanned = materialize(scanned.select("doc_id", "th", "node"), "nodes")
    drop_scratch(docs.sparkSession, made)
    release(docs.sparkSession)

    def settled(edges: DataFrame) -> DataFrame:
        return materialize(connected_components(edges).select(F.col("node").alias("a"), F.col("component").alias("b")), "settled")

    def met(sets: DataFrame, label: DataFrame, pairs: Callable[..., Iterator[pa.RecordBatch]], leading: bool = False) -> DataFrame:
        some = F.filter("parts", lambda p: p.at == 0) if leading else F.col("parts")
        tokens = lambda p: F.slice(p.tokens, 1, LEADING) if leading else p.tokens
        size = sets.agg(F.coalesce(F.sum(F.aggregate(some, F.lit(0), lambda n, p: n + F.size(tokens(p)))), F.lit(0))).first()[0]
        held = sets.join(label.toDF("node", "label"), "node", "left").select("node", "label", F.explode(some).alias("part"))
        placed = held.select("node", "part.size", "part.sketch", "label", F.posexplode(tokens(held.part)).alias("pos", "token"))
        # few rows go to few tasks, so that a pair meets in few of them
        dealt = placed.select("token", "node", "size", "pos", "sketch", "label").repartition(int(1 + size // SHARD_ROWS), "token")
        found = materialize(dealt.mapInArrow(lean(pairs), "a long, b long"), "pairs")
        release(docs.sparkSession)  # the tokens are most of what the stage shuffles
        return found

    def add(label: DataFrame, pairs: DataFrame) -> DataFrame:
        found = settled(label.union(_edges(pairs, own, rows, width)))
        release(docs.sparkSession)
        return found

    label = settled(_by_fingerprints(own, rows, width))
    label = add(label, met(own, label, partial(_spanning, crowd=crowd), leading=True))
    pairs = met(own, label, partial(_spanning, crowd=crowd))
    label = add(label, pairs)
    side = lambda c: label.toDF(c, f"label_{c}")
    ends = [F.coalesce(f"label_{c}", c) for c in ("a", "b")]
    failed = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where(ends[0] != ends[1])
    failed = materialize(failed.select(F.explode(F.array(*ends)).alias("component")).distinct(), "failed")
    if not failed.isEmpty():
        # similar sets that are still apart are joined by pairs that failed, so both their components have one
        member = own.join(label.toDF("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        sets = materialize(member.join(failed, "component", "left_semi").drop("component"), "open")
        label = add(label, met(sets, label, partial(_spanning, crowd=crowd, turn=1)))
        label = add(label, met(sets, label, partial(_apart, crowd=crowd)))
    named = own.join(label.toDF("node", "component"), "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    named = materialize(named, "named")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    whole = materialize(named.join(least, "component").select("node", "component", "component_id"), "whole")
    return scanned.select("doc_id", "th", "node").join(whole, "node").select("doc_id", "th", "component", "component_id")
