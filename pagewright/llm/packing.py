"""Vector bin packing of examples into sequences under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import merge_rows
from .common import lean, text_batches
from .tables import HashTable64

MAX_TOKENS = 2048
MAX_SEGMENTS = 256
#: The first tokens of a piece have nothing before them to be predicted from, so they bear no loss.
LEAD_TOKENS = 32
#: A sequence of one piece has more than this: some of its tokens must be the lead of another.
MAX_LOSS_TOKENS = MAX_TOKENS - 2 * LEAD_TOKENS
LIMITS = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS_TOKENS)
WINDOW = 512
OPEN_BINS = 48
END_ID = 1
CACHE_WORDS = 200_000
LONG_WORD = 48
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_MARKS = ".,;:!?%&#$*)"  # a run of these is one piece of the split pattern
_SPLIT_ODD = re.compile("[^\\S\x1c-\x1f]+")


class WordCoder:
    """Ids of the public word BPE as the tokenizers library gives them, with cached words.

    The file's normaliser is applied to whole texts, its split pattern to each white-space separated word that is not
    cached, and its merges to all new words side by side; long words go to the library itself.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        vocab, model = found["model"]["vocab"], found["model"]
        self.pieces = regex.compile(found["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        end = model["end_of_word_suffix"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte alphabet of byte-level vocabularies
        others = iter(range(256, 512))
        letters = [chr(b) if b in printable else chr(next(others)) for b in range(256)]
        self.inner, self.last = (np.array([vocab[c + x] for c in letters]) for x in ("", end))
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = np.array([vocab[a + b] for a, b in merges])
        if (np.diff(ids) <= 0).any():
            raise ValueError("ids of merges must grow with their rank")
        self.pairs = HashTable64(np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.uint64), ids)
        self.cache: dict[str, bytes] = {}  # word to its ids as unsigned 32-bit numbers
        self.older: dict[str, bytes] = {}

    def _remember(self, words: set[str]) -> set[str]:
        """Moves what the older cache holds of the words to the cache; the others."""
        known = words & self.older.keys()
        self.cache.update(zip(known, map(self.older.__getitem__, known), strict=True))
        return words - known

    def _merge(self, words: list[str]) -> None:
        """Puts the ids of words of one piece, none of them long, into the cache."""
        words.sort(key=len)
        for at in range(0, len(words), 8192):
            group = words[at : at + 8192]
            raw = np.frombuffer("\n".join([*group, ""]).encode("utf-8", "surrogatepass"), np.uint8)
            ends = np.flatnonzero(raw == 10)
            raw, ends = raw[raw != 10], ends - np.arange(len(ends))
            flat, tail = self.inner[raw], ends - 1
            flat[tail] = self.last[raw[tail]]
            merged, sizes = merge_rows(flat, np.diff(ends, prepend=0), self.pairs)
            cuts, ids = (np.cumsum(sizes) * 4).tolist(), merged.astype(np.uint32).tobytes()
            self.cache.update(zip(group, [ids[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))

    def _learn(self, words: set[str]) -> None:
        """Puts words that the cache lacks into it. What stands before a run of marks is a word of its own, mostly known already."""
        new = self._remember(words)
        whole = {w for w in new if w.isalpha()}
        parts = {w: (core, w[len(core) :]) if (core := w.rstrip(_MARKS)).isalpha() else self.pieces(w) for w in new - whole}
        pieces = self._remember(whole | set().union(*parts.values()) - self.cache.keys())
        self._merge([p for p in pieces if len(p) <= LONG_WORD])
        for p in pieces:
            if len(p) > LONG_WORD:
                self.cache[p] = np.array(self.whole.encode(p, add_special_tokens=False).ids, np.uint32).tobytes()
        get = self.cache.__getitem__
        self.cache.update([(w, b"".join(map(get, ps))) for w, ps in parts.items()])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        split = []
        for t in texts:
            t = t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)
            t = t.replace("Σ", "σ").lower()
            split.append([w for w in _SPLIT_ODD.split(t) if w] if _ODD_SPACE.search(t) else t.split())
        if len(self.cache) > CACHE_WORDS:
            self.older, self.cache = self.cache, {}
        self._learn(set().union(*split) - self.cache.keys())
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, s)), np.uint32) for s in split]


@lru_cache(2)
def word_coder(path: str) -> WordCoder:
    return WordCoder(path)


class Item:
    """A piece of an example that is still to be placed."""

    __slots__ = ("ids", "key", "lead", "loss", "start", "total")

    def __init__(self, key: int | None, start: int, ids: np.ndarray, total: int, loss: int, lead: int) -> None:
        self.key, self.start, self.ids, self.total, self.loss, self.lead = key, start, ids, total, loss, lead

    @property
    def free(self) -> int:
        """Leading tokens that bear no loss: the lead, and what comes before the last `loss` tokens of the example."""
        return max(self.lead, self.total - self.loss - self.start)

    def cost(self, n: int | None = None) -> tuple[int, int, int]:
        """Tokens, segments and loss-bearing tokens of the first n ids."""
        n = len(self.ids) if n is None else n
        return n, 1, max(0, n - self.free)

    def cut(self, n: int) -> tuple[Item, Item]:
        rest = self.total, self.loss, self.lead
        return Item(self.key, self.start, self.ids[:n], *rest), Item(self.key, self.start + n, self.ids[n:], *rest)


class Packer:
    """Packs a stream of examples into sequences; holds at most a window of pieces and a number of open sequences.

    Pieces of a window are taken by size. Each goes to the open sequence with the largest dot product of its needs
    and what is left there, both as shares of the limits, among those that have room in all three; else a new one is
    opened. With too many open, the fullest are filled up with cuts of the emptiest and leave. A sequence that leaves
    without being full of tokens, at the end or because segments or loss-bearing tokens ran out, is cut into sequences whose
    lengths are powers of two, so that nothing needs padding.
    """

    def __init__(self, limits: tuple[int, int, int] = LIMITS, window: int = WINDOW, open_bins: int = OPEN_BINS, lead: int = LEAD_TOKENS) -> None:
        if min(limits) < 1:
            raise ValueError("limits are at least 1")
        self.limits, self.window, self.open_bins = np.array(limits, float), window, open_bins
        self.size, self.lead, self.waiting, self.bins = limits[0], lead, [], []
        self.space = np.zeros((open_bins + window, 3))

    @property
    def room(self) -> np.ndarray:
        """What is left in each open sequence, one row each."""
        return self.space[: len(self.bins)]

    def _most(self, item: Item, room: np.ndarray) -> int:
        """How many leading ids of the item the room takes: tokens, a segment, and loss-bearing tokens."""
        return int(min(len(item.ids), room[0], item.free + room[2])) if room[1] >= 1 else 0

    def add(self, key: int | None, ids: np.ndarray, loss: int) -> Iterator[list[Item]]:
        item = Item(key, 0, ids, len(ids), loss, self.lead)
        while (n := self._most(item, self.limits)) < len(item.ids) or n == self.size:
            part, item = item.cut(n)
            if n == self.size:
                yield [part]
            else:
                self.waiting.append(part)
        if len(item.ids):
            self.waiting.append(item)
        if len(self.waiting) >= self.window:
            yield from self._place()

    def _open(self) -> int:
        if len(self.bins) == len(self.space):
            self.space = np.concatenate([self.space, np.zeros_like(self.space)])
        self.space[len(self.bins)] = self.limits
        self.bins.append([])
        return len(self.bins) - 1

    def _place(self) -> Iterator[list[Item]]:
        self.waiting.sort(key=lambda x: -len(x.ids))
        scale = self.limits**-2
        for item in self.waiting:
            need = np.array(item.cost(), float)
            fits = (self.room >= need).all(1)
            k = int(np.where(fits, self.room @ (need * scale), -1.0).argmax()) if fits.any() else self._open()
            self.bins[k].append(item)
            self.space[k] -= need
        self.waiting = []
        while self.bins:
            done = np.flatnonzero((self.room[:, :2] <= 0).any(1))
            if len(done):
                yield from self._leave(self._take(int(done[-1])))
            elif len(self.bins) > self.open_bins:
                yield from self._leave(self._fill(int(self.room[:, 0].argmin())))
            else:
                return

    def _take(self, k: int) -> list[Item]:
        """Takes sequence k out; the last one moves to its place."""
        last = len(self.bins) - 1
        self.space[k] = self.space[last]
        self.bins[k], self.bins[last] = self.bins[last], self.bins[k]
        return self.bins.pop()

    def _fill(self, k: int) -> list[Item]:
        """Fills sequence k with cuts from the emptiest others on, as far as its limits allow."""
        room = self.space[k].copy()
        taken = self._take(k)
        while room[0] > 0 and room[1] > 0:
            found = next(((j, i, n) for j in np.argsort(-self.room[:, 0], kind="stable").tolist() for i in range(len(self.bins[j]) - 1, -1, -1) if (n := self._most(self.bins[j][i], room)) > 0), None)
            if found is None:
                break
            j, i, n = found
            item = self.bins[j].pop(i)
            part, rest = item.cut(n)
            taken.append(part)
            room -= part.cost()
            self.space[j] += item.cost()
            if len(rest.ids):
                self.bins[j].append(rest)
                self.space[j] -= rest.cost()
            if not self.bins[j]:
                self._take(j)
        return taken

    def _leave(self, items: list[Item]) -> Iterator[list[Item]]:
        """Pieces of one sequence as sequences whose lengths are the largest possible powers of two."""
        left = sum(len(x.ids) for x in items)
        if left == self.size:
            yield items
            return
        while left:
            want, out = 1 << (left.bit_length() - 1), []
            left -= want
            while want:
                part, rest = items[0].cut(min(want, len(items[0].ids)))
                out.append(part)
                want -= len(part.ids)
                items[:1] = [rest] if len(rest.ids) else []
            yield out

    def finish(self) -> Iterator[list[Item]]:
        yield from self._place()
        while self.bins:
            yield from self._leave(self._fill(int(self.room[:, 0].argmin())))


def pack(docs: DataFrame, path: str, limits: tuple[int, int, int] = LIMITS, loss: str | None = None, with_ids: bool = True) -> DataFrame:
    """Packs all rows of docs (doc_id, text) into sequences; one row per piece.

    Ids are those of the text by the word BPE at path, then id 1. loss names a column with how many of the last tokens
    bear loss; without it, or where it is null, all do, but for the first LEAD_TOKENS of each piece. Every task packs its own rows, so nothing is
    shuffled and a lost task is repeated alone; a sequence id is the partition and a number in it. Padding: none, as what is
    not full is cut at powers of two. Null texts count as empty, null ids are kept, repeated rows are packed again, equal
    texts give equal ids, long texts are cut over many sequences, other columns are ignored, an empty table gives no piece.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.col(loss) if loss else F.lit(None)).cast("long").alias("loss"))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if with_ids else []

    def rows(sequences: Iterable[list[Item]], next_id: Callable[[], int]) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in fields]
        for items in sequences:
            number, offset = next_id(), 0
            for x in items:
                row = [x.key, x.start, len(x.ids), zlib.crc32(x.ids.astype("<u4").tobytes()), x.total, number, offset]
                for c, v in zip(columns, row + ([x.ids.astype(np.int32)] if with_ids else []), strict=True):
                    c.append(v)
                offset += len(x.ids)
        return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, packer = word_coder(path), Packer(limits)
        numbers = iter(range(TaskContext.get().partitionId() << 33, 1 << 62))
        for batch in text_batches(batches):
            keys, bears = batch.column("doc_id").to_pylist(), batch.column("loss").to_pylist()
            coded = coder.encode_batch([t or "" for t in batch.column("text").to_pylist()])
            made: list[list[Item]] = []
            for key, ids, n in zip(keys, coded, bears, strict=True):
                ids = np.append(ids, np.uint32(END_ID))
                made += packer.add(key, ids, len(ids) if n is None else n)
            yield rows(made, numbers.__next__)
        yield rows(packer.finish(), numbers.__next__)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return named.mapInArrow(run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    return pack(docs, default_path(), with_ids=False)
