"""Byte-level BPE: pre-tokenisation as an associative scan of transition functions, cached pair merging, decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_batches
from .tables import HashTable64

CACHE_PIECES = 120_000
LONG_PIECE = 48

# Symbols: what the scanner sees at a code point, with its look-ahead.
LETTER, NUMBER, OTHER, SHORT_TAIL, LONG_TAIL, GLUE_SPACE, LAST_SPACE, SPACE, TEXT_END = range(9)
# States: what the scanner is in before a code point.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, GLUED, TAIL_1, TAIL_2, IN_SPACE = range(8)

# The letters of the contractions of the public byte-level pattern.
TAILS_1 = "stmd"
TAILS_2 = ("re", "ve", "ll")
# Code points with the property White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts here."""
    if symbol == TEXT_END:
        return FRESH, True
    if symbol == GLUE_SPACE:
        return GLUED, True
    if symbol == LAST_SPACE:
        return FRESH, True
    if symbol == SPACE:
        return IN_SPACE, state != IN_SPACE
    if symbol == LETTER:
        if state in (TAIL_1, TAIL_2):
            return (FRESH if state == TAIL_1 else TAIL_1), False
        return IN_LETTERS, state not in (IN_LETTERS, GLUED)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, GLUED)
    inside = state in (IN_OTHERS, GLUED)
    return (IN_OTHERS if symbol == OTHER or inside else TAIL_1 if symbol == SHORT_TAIL else TAIL_2), not inside


@lru_cache(1)
def _machine() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """function of a symbol, composition of two functions, state after a function from FRESH, starts by state and symbol.

    The functions on states that symbols generate are closed under composition and few, so each is a small number.
    """
    symbols = [tuple(_step(s, x)[0] for s in range(8)) for x in range(9)]
    known = {f: i for i, f in enumerate(dict.fromkeys(symbols))}
    while True:
        new = {g for a in known for b in known if (g := tuple(b[x] for x in a)) not in known}
        if not new:
            break
        known |= {g: len(known) + i for i, g in enumerate(sorted(new))}
    functions = list(known)
    compose = np.array([[known[tuple(b[x] for x in a)] for b in functions] for a in functions], np.uint8)
    starts = np.array([[_step(s, x)[1] for x in range(9)] for s in range(8)])
    return np.array([known[f] for f in symbols], np.uint8), compose, np.array([f[FRESH] for f in functions], np.uint8), starts


@lru_cache(1)
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE by code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    out[kinds == "L"], out[kinds == "N"] = LETTER, NUMBER
    out[list(WHITE_SPACE)] = SPACE
    return out


def _symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of the code points of texts laid end to end; `ends` marks the separator after each text."""
    symbols = _classes()[np.where(ends, 0, points)]
    symbols[ends] = TEXT_END
    space = symbols == SPACE
    follows = np.empty(len(space), bool)
    follows[:-1], follows[-1:] = ~space[1:] & ~ends[1:], False
    symbols[space & follows] = LAST_SPACE
    symbols[space & follows & (points == 32)] = GLUE_SPACE
    quote = np.flatnonzero((points == ord("'")) & ~ends)
    one = points[np.minimum(quote + 1, len(points) - 1)]
    two = points[np.minimum(quote + 2, len(points) - 1)]
    short = np.isin(one, [ord(c) for c in TAILS_1])
    long = np.zeros(len(quote), bool)
    for a, b in TAILS_2:
        long |= (one == ord(a)) & (two == ord(b))
    symbols[quote[short]], symbols[quote[long & ~short]] = SHORT_TAIL, LONG_TAIL
    return symbols


def _states(symbols: np.ndarray) -> np.ndarray:
    """State before each symbol, by a blocked scan: compose inside rows, across row ends, then carry into rows."""
    of, compose, from_fresh, _ = _machine()
    n = len(symbols)
    wide = max(1, int(np.sqrt(n) / 4))
    rows = -(-n // wide)
    grid = np.full(rows * wide, of[TEXT_END], np.uint8)
    grid[:n] = of[symbols]
    grid = np.ascontiguousarray(grid.reshape(rows, wide).T)
    for k in range(1, wide):
        grid[k] = compose[grid[k - 1], grid[k]]
    carry, last, step = np.empty(rows, np.uint8), grid[-1].tolist(), compose.tolist()
    state = of[TEXT_END].item()  # texts begin fresh
    for r in range(rows):
        carry[r] = state
        state = step[state][last[r]]
    after = from_fresh[compose[carry[None, :], grid]].T.ravel()[:n]
    return np.concatenate(([FRESH], after[:-1])).astype(np.uint8)


def piece_starts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all pieces of the texts laid end to end (UTF-8), and how many pieces each text has."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.array([len(t) for t in texts])
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    last = np.cumsum(lengths + 1) - 1
    ends = np.zeros(len(points), bool)
    ends[last] = True
    symbols = _symbols(points, ends)
    begin = _machine()[3][_states(symbols), symbols] & ~ends
    widths = (1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)) * ~ends
    offsets = np.cumsum(widths) - widths
    counts = np.add.reduceat(np.append(begin, False), np.append(0, last[:-1] + 1), dtype=np.int64)
    return offsets[begin], counts


def merge_rows(flat: np.ndarray, size: np.ndarray, pairs: HashTable64) -> tuple[np.ndarray, np.ndarray]:
    """Merges many short symbol rows side by side; flat: their ids end to end, pairs: (left << 32 | right) to the merged id.

    Returns the merged ids end to end and their number in each row.

    Ids of merges grow with their rank, so in each turn every row merges its leftmost pair of least id. Rows stand side by
    side, one column each; a column is a linked list between two places without a symbol, so a merge touches two places, and a
    pair's id and place in one number make the least of a column the pair to merge.
    """
    none, n, wide = np.int64(2**62), len(size), int(size.max(initial=0))
    row, place = np.repeat(np.arange(n), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + 1
    ids = np.full((wide + 2) * n, -1, np.int64)
    ids[place * n + row] = flat
    after = np.arange(len(ids)) + n
    before = after - 2 * n

    def ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Keys of the pairs of symbols at places a and b."""
        found = pairs.get((ids[a] << 32 | ids[b]).view(np.uint64)).astype(np.int64)
        return np.where((found >= 0) & (ids[a] >= 0) & (ids[b] >= 0), found << 32 | a, none)

    best = np.full((wide + 2) * n, none, np.int64)
    inner = np.arange(n, wide * n)
    best[inner] = ranked(inner, inner + n)
    columns = best.reshape(wide + 2, n)
    while n:
        least = columns.min(0)
        at = least[least < none]
        if not len(at):
            break
        merged, at = at >> 32, at & np.int64(2**32 - 1)
        gone, left = after[at], before[at]
        right = after[gone]
        ids[at], ids[gone], best[gone] = merged, -1, none
        after[at], before[right] = right, at
        best[at], best[left] = ranked(at, right), ranked(left, at)
    kept = ids.reshape(wide + 2, n).T
    return kept[kept >= 0], (kept >= 0).sum(1)


class ByteBPE:
    """Encoder and decoder over a file of ranks; merges of pieces are cached, up to a bound."""

    def __init__(self, path: str, cache: int = CACHE_PIECES) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks, self.limit = ranks, cache
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.digits = [str(i) for i in range(len(self.tokens))]
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {(ranks[t[:k]] << 32 | ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pairs = HashTable64(np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.older: dict[bytes, tuple[int, ...]] = {}

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """Merges of one long piece by a heap of pair ranks over a linked list."""
        parts, after, before = [bytes([b]) for b in piece], [*range(1, len(piece)), -1], [*range(-1, len(piece) - 1)]
        heap = [(r, i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := self.ranks.get(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i] if parts[i] else -1
            if j < 0 or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, b"", after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (r := self.ranks.get(parts[left] + parts[right])) is not None:
                    heapq.heappush(heap, (r, left, parts[left] + parts[right]))
        return tuple(self.ranks[p] for p in parts if p)

    def _merge_batch(self, pieces: list[bytes]) -> None:
        pieces.sort(key=len)
        for at in range(0, len(pieces), 4096):
            some = pieces[at : at + 4096]
            flat = self.of_byte[np.frombuffer(b"".join(some), np.uint8)]
            merged, sizes = merge_rows(flat, np.array([len(p) for p in some]), self.pairs)
            ends, ids = np.cumsum(sizes).tolist(), merged.tolist()
            self.cache.update(zip(some, (tuple(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)), strict=True))

    def _learn(self, pieces: list[bytes]) -> None:
        new = {p for p in pieces if p not in self.cache}
        short = []
        for p in new:
            if (known := self.older.get(p)) is not None:
                self.cache[p] = known
            elif (r := self.ranks.get(p)) is not None:
                self.cache[p] = (r,)
            elif len(p) > LONG_PIECE:
                self.cache[p] = self._merge_long(p)
            else:
                short.append(p)
        self._merge_batch(short)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, without special tokens."""
        raw = "".join(texts).encode("utf-8", "surrogatepass")
        starts, counts = piece_starts(texts)
        cuts = starts.tolist()
        pieces = [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=False)]
        if len(self.cache) > self.limit:
            self.older, self.cache = self.cache, {}  # what is still in use moves over
        self._learn(pieces)
        get, out, at = self.cache.__getitem__, [], 0
        for n in counts.tolist():
            out.append(list(chain.from_iterable(map(get, pieces[at : at + n]))))
            at += n
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def offsets(self, ids: list[int]) -> list[int]:
        """Byte offset of each token in its text."""
        sizes = np.array([len(self.tokens[i]) for i in ids], np.int64)
        return (np.cumsum(sizes) - sizes).tolist()


@lru_cache(2)
def coder(path: str) -> ByteBPE:
    """The coder of a rank file, once per worker."""
    return ByteBPE(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) with ids array<int> and their byte offsets; null texts count as empty, rows are kept as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in text_batches(batches):
            ids = bpe.encode_batch([t or "" for t in batch.column("text").to_pylist()])
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.offsets(i) for i in ids], pa.list_(pa.int64()))], ["doc_id", "ids", "offsets"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, offsets array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded bytes of encoded (doc_id, ids); null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            out = [None if i is None else bpe.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs (doc_id, text): encoded, then decoded from the ids, in one pass.

    Null texts count as empty, null ids are kept, repeated rows stay and equal texts give equal digests; a long text is encoded as a
    whole; other columns are ignored, whatever their names; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        digit = bpe.digits.__getitem__
        for batch in text_batches(batches):
            ids = bpe.encode_batch([t or "" for t in batch.column("text").to_pylist()])
            columns = [
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array([hashlib.sha256(",".join(map(digit, i)).encode()).hexdigest() for i in ids]),
                pa.array([hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids]),
            ]
            yield pa.record_batch([batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract, with the public multilingual ranks."""
    import public_tokenizers

    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
