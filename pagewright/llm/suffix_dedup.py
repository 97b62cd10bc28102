"""Exact substring dedup: bytes covered by a string of 400 bytes that also starts elsewhere are removed.

Every window of 400 bytes is assigned to the least hash among its 160-byte grams, leftmost first, which depends on the window alone; so
equal windows share an anchor. Neighbouring windows with the same anchor form a snippet. Only anchors met twice matter.
Snippets met twice are repeats as a whole. Anchors with different snippets go to suffix sorting: each partition
sorts its snippets' suffixes by external induced sorting (induced.py), and windows are repeats if the prefix
shared with a neighbour covers them.

On request windows of a number of words are met as well, whatever their bytes, by the least hash among their grams of
words. Where snippets of such an anchor differ, their windows are counted one by one by a 128-bit hash.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import lean, materialize, text_batches
from .induced import Store, suffixes

LENGTH = 400
GRAM = 160
SHARD_BYTES = 2 << 20
#: A partition sorts its shards one after another, so there need be no more of them than this, whatever the input.
MOST_PARTITIONS = 4096
SPLIT = 256
PARTS = 8
CROWDED = 20_000
#: In place of p and `from`: the range counts words.
WORDS = -1
SPACES = b" \t\n\r\x0b\x0c"
STEP = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)
ANCHORS = "array<struct<h:long,s:long,a:int,b:int,e:int,n:int,p:int>>"


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    up, down = _powers(STEP + 2 * LENGTH)
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def _least(h: np.ndarray, wide: int, windows: int) -> np.ndarray:
    """The place of the least of the hashes of each window, `wide` of them, leftmost first."""
    keys = h & ~_PLACE | np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(keys) // wide)
    grid = np.full(blocks * wide, np.uint64(2**64 - 1))
    grid[: len(keys)] = keys
    grid = grid.reshape(blocks, wide)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(behind[:windows], ahead[wide - 1 : wide - 1 + windows]) & _PLACE).astype(np.int64)


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor hash h, snippet digest s, window range a:b of each snippet of a text, in order; all windows are covered.

    Where a text repeats with a short period, equal snippets follow each other: such a run is one row, with the range of its
    first snippet, the end e of the run, and the number n of snippets; p is the place of the anchor after a. Long texts are taken in steps; a snippet that a
    step cuts only becomes two.
    """
    wide, parts = length - gram + 1, []
    for at in range(0, len(raw) - length + 1, STEP):
        piece = np.frombuffer(raw, np.uint8, min(len(raw) - at, STEP + length - 1), at)
        h = _gram_hashes(piece, gram)
        windows = len(piece) - length + 1
        place = _least(h, wide, windows)
        a = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        b = np.append(a[1:], windows)
        digest = xxhash.xxh3_64_intdigest
        s = np.array([digest(raw[p + at : q + at + length - 1], x) for p, q, x in zip(a.tolist(), b.tolist(), (place[a] - a).tolist(), strict=True)], np.uint64)
        parts.append((h[place[a]].view(np.int64), s.view(np.int64), a + at, b + at, place[a] - a))
    return _runs(parts)


def _runs(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The columns of anchors() from h, s, a, b, p of each step."""
    if not parts:
        return (np.zeros(0, np.int64),) * 7
    h, s, a, b, p = (np.concatenate(x) for x in zip(*parts, strict=True))
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (s[1:] != s[:-1])))
    last = np.append(first[1:], len(h)) - 1
    return h[first], s[first], a[first], b[first], b[last], last - first + 1, p[first]


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after its last, as bytes.split() cuts them."""
    inside = np.concatenate([[0], ~np.isin(np.frombuffer(raw, np.uint8), np.frombuffer(SPACES, np.uint8)), [0]]).astype(np.int8)
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_anchors(raw: bytes, words: int) -> tuple[np.ndarray, ...]:
    """The columns of anchors() for windows of so many words; ranges count words, and p is WORDS."""
    digest, parts = xxhash.xxh3_64_intdigest, []
    every = np.array([digest(w) for w in raw.split()], np.uint64)
    for at in range(0, len(every) - words + 1, STEP):
        piece = every[at : at + STEP + words - 1]
        h, gram = piece, 1
        while gram * 3 <= words:
            h = h[:-gram] * np.uint64(pow(_BASE, gram, 1 << 64)) + h[gram:]
            gram *= 2
        h = h ^ h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        windows = len(piece) - words + 1
        place = _least(h, words - gram + 1, windows)
        a = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        b = np.append(a[1:], windows)
        s = np.array([digest(piece[p : q + words - 1].tobytes(), x) for p, q, x in zip(a.tolist(), b.tolist(), (place[a] - a).tolist(), strict=True)], np.uint64)
        parts.append((h[place[a]].view(np.int64), s.view(np.int64), a + at, b + at, np.full(len(a), WORDS)))
    return _runs(parts)


def text_key() -> list[Column]:
    """128 bits of hash of a text column, as two columns t1 and t2."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("text"), "text").alias("t2")]


def _scan(rows: DataFrame, words: int = 0) -> DataFrame:
    """Narrow facts of each row: size, digest of the text, anchors."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            raws = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            found = [anchors(r) for r in raws]
            if words:
                found = [tuple(map(np.concatenate, zip(f, word_anchors(r, words), strict=True))) for f, r in zip(found, raws, strict=True)]
            columns = [np.concatenate([f[k] for f in found]) for k in range(7)]
            offsets = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32)
            inner = pa.StructArray.from_arrays([pa.array(c if k < 2 else c.astype(np.int32)) for k, c in enumerate(columns)], ["h", "s", "a", "b", "e", "n", "p"])
            columns = [pa.array([len(r) for r in raws], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raws]), pa.ListArray.from_arrays(offsets, inner)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("t1"), batch.column("t2"), *columns], ["doc_id", "t1", "t2", "n_bytes", "sha", "anchors"])

    return rows.mapInArrow(run, f"doc_id long, t1 long, t2 long, n_bytes long, sha string, anchors {ANCHORS}")


def _packed(rows: DataFrame, words: int = 0) -> DataFrame:
    """t1, t2 and the compressed bytes of the texts that have a window."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in text_batches(batches):
            z = [press.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("t1"), batch.column("t2"), pa.array(z, pa.binary())], ["t1", "t2", "z"])

    return rows.where(F.octet_length("text") >= (min(LENGTH, 2 * words - 1) if words else LENGTH)).select("t1", "t2", "text").mapInArrow(run, "t1 long, t2 long, z binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    press = zstandard.ZstdDecompressor()
    for i, z in enumerate(batch.column("z")):
        yield i, press.decompress(z.as_py())


def parts_of(raw: bytes, a: int, b: int, p: int, parts: int = PARTS, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int]]:
    """Cuts the windows a:b around an anchor at a + p by their distance to it: key, first and last window of each part.

    All windows of a part share a core around the anchor, longer than the anchor itself; its hash is the key, so equal
    windows get equal keys, and snippets that share little more than the anchor part ways.
    """
    wide, low = length - gram + 1, a + p - (length - gram)
    step = -(-wide // parts)
    for j in range(parts):
        start, end = low + j * step, low + (j + 1) * step
        if max(a, start) < min(b, end):
            core = raw[end - 1 : start + length]
            yield xxhash.xxh3_64_intdigest(core, j) - (1 << 63), max(a, start), min(b, end)


def _cut(batches: Iterator[pa.RecordBatch], split: int, crowded: int, words: int = 0) -> Iterator[pa.RecordBatch]:
    """Snippet bytes of the wanted window ranges of each text, in parts where many snippets share an anchor."""
    for batch in batches:
        for i, raw in _unpacked(batch):
            rows = []
            parts = raw.split() if words else []
            for w in batch.column("want")[i].as_py():
                if w["p"] == WORDS:
                    rows.append((w["h"], w["s"], w["c"], w["h"], WORDS, b" ".join(parts[w["a"] : w["b"] + words - 1])))
                    continue
                whole = [(w["h"], w["a"], w["b"])]
                for key, start, end in parts_of(raw, w["a"], w["b"], w["p"]) if split < w["c"] <= crowded else whole:
                    rows.append((w["h"], w["s"], w["c"], key, start - w["a"], raw[start : end + LENGTH - 1]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["h", "s", "c", "key", "from", "snippet"])


def repeats(text: np.ndarray, starts: np.ndarray, widths: np.ndarray, length: int = LENGTH, held: int | None = None) -> list[list[tuple[int, int]]]:
    """For each snippet in a text of symbols, the ranges of its windows that occur at another place of the text."""
    store = Store() if held is None else Store(held)
    try:
        hit = store.array(len(text), bool)
        for position, shared in suffixes(text, length, store):
            again = shared >= length
            hit[position[again]] = True
            hit[position[:-1][again[1:]]] = True
        out = []
        for start, width in zip(starts.tolist(), widths.tolist(), strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[start : start + width].astype(np.int8), [0]])))
            out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
        return out
    finally:
        store.close()


def _sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeated ranges of the snippets of a partition, shard by shard; the rows of a shard follow each other.

    The snippets of a shard are laid end to end in a scratch file of the task, sorted and marked; then the file is used anew.
    """
    with tempfile.TemporaryFile() as f:  # of this task alone, gone with it
        keys: list[tuple[int, int, int]] = []
        starts: list[int] = []
        widths: list[int] = []
        at, shard = 0, None

        def marked() -> pa.RecordBatch:
            f.flush()
            found = repeats(np.memmap(f, np.uint16, "r", shape=(at,)), np.array(starts), np.array(widths))
            keep = [(k, r) for k, r in zip(keys, found, strict=True) if r]
            kind = pa.list_(pa.struct([("u", pa.int32()), ("v", pa.int32())]))
            ranges = [[{"u": u + k[2], "v": v + k[2]} for u, v in r] for k, r in keep]
            return pa.record_batch([pa.array([k[0] for k, _ in keep], pa.int64()), pa.array([k[1] for k, _ in keep], pa.int64()), pa.array(ranges, kind)], ["h", "s", "ranges"])

        for batch in batches:
            for own, h, s, skip, raw in zip(*(batch.column(c).to_pylist() for c in ("shard", "h", "s", "from", "snippet")), strict=True):
                if keys and own != shard:
                    yield marked()
                    f.seek(0)
                    f.truncate()
                    keys, starts, widths, at = [], [], [], 0
                shard = own
                (np.append(np.frombuffer(raw, np.uint8).astype(np.uint16) + 1, 0)).astype(np.uint16).tofile(f)
                keys.append((h, s, skip))
                starts.append(at)
                widths.append(len(raw) - LENGTH + 1)
                at += len(raw) + 1
        if keys:
            yield marked()


def _windows(batches: Iterator[pa.RecordBatch], words: int = 0) -> Iterator[pa.RecordBatch]:
    """One row per window of crowded anchors and of words: its place and 128 bits of its hash."""
    for batch in batches:
        for h, s, skip, raw in zip(*(batch.column(c).to_pylist() for c in ("h", "s", "from", "snippet")), strict=True):
            if skip == WORDS:
                parts = raw.split()
                held = [b" ".join(parts[u : u + words]) for u in range(len(parts) - words + 1)]
            else:
                held = (raw[u : u + LENGTH] for u in range(len(raw) - LENGTH + 1))
            w = np.array([divmod(xxhash.xxh3_128_intdigest(x, int(skip == WORDS)), 1 << 64) for x in held], np.uint64).view(np.int64).reshape(-1, 2)
            n = len(w)
            yield pa.record_batch([pa.array(np.full(n, h)), pa.array(np.full(n, s)), pa.array(np.arange(n, dtype=np.int32)), pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy())], ["h", "s", "u", "w1", "w2"])


def _marks(snippets: DataFrame, crowded: int, shard_bytes: int, words: int = 0) -> DataFrame:
    """h, s and the repeated window ranges of snippets that share an anchor with other snippets.

    Snippets of an anchor meet in one shard, or parts of them do, see parts_of(). Anchors of more than `crowded`
    different snippets could still overload a shard; their windows are counted one by one by a 128-bit hash instead, which
    spreads over all tasks.
    """
    single = (F.col("c") > crowded) | (F.col("from") == WORDS)
    usual, rest = snippets.where(~single), snippets.where(single)
    size = usual.agg(F.coalesce(F.sum(F.length("snippet")), F.lit(0))).first()[0]
    # at least a shard for each task that a shuffle makes, so that small inputs spread too
    shards = max(1 + size // shard_bytes, int(snippets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = usual.select("h", "s", "from", "snippet", F.pmod("key", F.lit(shards)).alias("shard"))
    dealt = dealt.repartition(int(min(shards, MOST_PARTITIONS)), "shard").sortWithinPartitions("shard")
    sorted_ = dealt.mapInArrow(lean(_sort_shards), "h long, s long, ranges array<struct<u:int,v:int>>")
    marks = sorted_.select("h", "s", F.explode("ranges").alias("r")).select("h", "s", "r.u", "r.v")
    if rest.isEmpty():
        return marks
    windows = materialize(rest.select("h", "s", "from", "snippet").mapInArrow(lean(partial(_windows, words=words)), "h long, s long, u int, w1 long, w2 long"), "windows")
    again = materialize(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1"), "again")
    return marks.union(windows.join(again, ["w1", "w2"]).select("h", "s", "u", (F.col("u") + 1).alias("v")))


def _keep(batches: Iterator[pa.RecordBatch], words: int = 0) -> Iterator[pa.RecordBatch]:
    """Applies the window ranges of each text: removed bytes, spans, kept bytes."""
    for batch in text_batches(batches, text="z"):
        rows = []
        for i, raw in _unpacked(batch):
            cover = np.zeros(len(raw) + 1, np.int64)
            first, last = word_spans(raw) if words else (None, None)
            for r in batch.column("cut")[i].as_py():
                cover[first[r["a"]] if r["p"] == WORDS else r["a"]] += 1
                cover[last[r["b"] + words - 2] if r["p"] == WORDS else r["b"] + LENGTH - 1] -= 1
            gone = np.cumsum(cover)[:-1] > 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            rows.append((int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
        yield pa.record_batch([batch.column("t1"), batch.column("t2"), *columns], ["t1", "t2", "n_removed", "n_spans", "kept_sha256", "kept"])


def removals(docs: DataFrame, split: int = SPLIT, crowded: int = CROWDED, shard_bytes: int = SHARD_BYTES, words: int = 0) -> tuple[DataFrame, DataFrame]:
    """Facts of all rows of docs (doc_id, text), and what is removed from each text that loses bytes.

    First table: doc_id, t1, t2, n_bytes, sha per row. Second: t1, t2, n_removed, n_spans, kept_sha256 (of the bytes), kept
    (as text) per different text. Null texts count as empty. Matches never cross rows; repeated rows repeat each other, so texts of
    400 bytes or more that occur twice lose everything. With `words`, runs of so many words that occur elsewhere go too,
    however many bytes they have and whatever white space is between the words. An empty table gives empty results.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *text_key())
    facts = materialize(_scan(rows, words), "facts")
    # copies of a text are combined before the shuffle, so a text that a third of all rows hold is one row from here on
    different = materialize(facts.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.first("anchors").alias("anchors")), "different")
    every = different.select("t1", "t2", "copies", F.explode("anchors").alias("x")).select("t1", "t2", "x.*", "copies").withColumn("n", F.col("n") * F.col("copies")).drop("copies")
    again = materialize(every.groupBy("h").agg(F.sum("n").alias("m")).where("m > 1").select("h"), "again")
    met = materialize(every.join(again, "h"), "met")
    alike = materialize(met.groupBy("h", "s").agg(F.sum("n").alias("n"), F.min(F.struct("t1", "t2", "a", "b", "p")).alias("rep")), "snippets")
    mixed = materialize(alike.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "mixed")
    texts = _packed(rows, words).groupBy("t1", "t2").agg(F.first("z").alias("z")).join(met.select("t1", "t2").distinct(), ["t1", "t2"])
    texts = materialize(texts, "texts")
    want = alike.join(mixed, "h").select("rep.*", F.struct("h", "s", "c", "rep.a", "rep.b", "rep.p").alias("w"))
    want = want.groupBy("t1", "t2").agg(F.collect_list("w").alias("want"))  # bounded by the text
    snippets = materialize(texts.join(want, ["t1", "t2"]).mapInArrow(lean(partial(_cut, split=split, crowded=crowded, words=words)), "h long, s long, c long, key long, from int, snippet binary"), "cut")
    marks = materialize(_marks(snippets, crowded, shard_bytes, words), "marks")
    plain = met.join(materialize(alike.where("n > 1").select("h", "s"), "plain"), ["h", "s"]).select("t1", "t2", "a", F.col("e").alias("b"), "p")
    partly = met.join(marks, ["h", "s"]).select("t1", "t2", (F.col("a") + F.col("u")).alias("a"), (F.col("a") + F.col("v")).alias("b"), "p")
    cut = materialize(plain.union(partly), "ranges").groupBy("t1", "t2").agg(F.collect_list(F.struct("a", "b", "p")).alias("cut"))  # bounded by the text
    gone = texts.join(cut, ["t1", "t2"]).mapInArrow(lean(partial(_keep, words=words)), "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return facts.select("doc_id", "t1", "t2", "n_bytes", "sha"), materialize(gone, "gone")


def without_repeats(docs: DataFrame, words: int = 0) -> DataFrame:
    """docs with repeated strings cut out of the texts, all columns and rows kept; a cut character is dropped."""
    _, gone = removals(docs, words=words)
    kept = gone.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("kept").alias("_kept"))
    keyed = docs.withColumns(dict(zip(("_t1", "_t2"), text_key(), strict=True))).join(kept, ["_t1", "_t2"], "left")
    return keyed.select(*[F.coalesce("_kept", "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    facts, gone = removals(docs)
    found = facts.join(gone.drop("kept"), ["t1", "t2"], "left")
    zero = F.lit(0).cast("long")
    return found.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
