"""External induced sorting of suffixes: bucket queues of (position, common prefix) tuples that spill to disk.

Suffixes are of type S if smaller than the next suffix, else L; an LMS position is an S after an L. LMS suffixes are
sorted by recursion over names of doubling length. From them the L suffixes are induced in ascending order and the S
suffixes in descending order: whoever leaves the queue of its first symbol puts the suffix before it into the queue of
that one's symbol. Queues are ordered by symbol and, in a symbol, by arrival, so they are priority queues whose
operations run on whole stretches. Each tuple carries the length of the prefix shared with the tuple before it in its
queue: one more than the least such length between their sources.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes that arrays and queues of one sort may hold in memory; the rest is on disk.
HELD = 4 << 20


class Store:
    """Scratch of one sort on disk; the files are gone as soon as they are closed, even if the task dies."""

    def __init__(self, held: int = HELD) -> None:
        self.held, self.used, self.files = held, 0, []

    def array(self, n: int, kind: type | np.dtype) -> np.ndarray:
        """An array of zeros, in memory or mapped to a file if what is held would grow too large."""
        size = max(1, n) * np.dtype(kind).itemsize
        if self.used + size <= self.held:
            self.used += size
            return np.zeros(n, kind)
        f = tempfile.TemporaryFile()  # noqa: SIM115
        self.files.append(f)
        f.truncate(size)
        return np.memmap(f, kind, "r+", shape=(max(1, n),))[:n]

    def close(self) -> None:
        for f in self.files:
            f.close()
        self.files = []


class Queues:
    """One first-in-first-out queue of (position, common prefix) for each symbol; the fullest go to disk first."""

    def __init__(self, symbols: int, store: Store) -> None:
        self.chunks: list[list] = [[] for _ in range(symbols)]
        self.in_memory = np.zeros(symbols, np.int64)
        self.store = store

    def push(self, symbol: int, position: np.ndarray, prefix: np.ndarray) -> None:
        if not len(position):
            return
        self.chunks[symbol].append((position, prefix))
        self.in_memory[symbol] += position.nbytes + prefix.nbytes
        if self.in_memory.sum() > self.store.held:
            self._spill(int(self.in_memory.argmax()))

    def _spill(self, symbol: int) -> None:
        kept = [c for c in self.chunks[symbol] if not isinstance(c[0], np.memmap)]
        n = sum(len(c[0]) for c in kept)
        parts = []
        for k, kind in ((0, np.int64), (1, np.int32)):
            f = tempfile.TemporaryFile()  # noqa: SIM115
            self.store.files.append(f)
            f.truncate(n * np.dtype(kind).itemsize)
            out = np.memmap(f, kind, "r+", shape=(n,))
            np.concatenate([c[k] for c in kept], out=out)
            parts.append(out)
        self.chunks[symbol] = [c for c in self.chunks[symbol] if isinstance(c[0], np.memmap)] + [tuple(parts)]
        self.in_memory[symbol] = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of a symbol in order of arrival; the first shares 0 with what was before the queue."""
        chunks, self.chunks[symbol] = self.chunks[symbol], []
        self.in_memory[symbol] = 0
        if not chunks:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        position, prefix = (np.concatenate([c[k] for c in chunks]) for k in (0, 1))
        prefix[0] = 0
        return position, prefix


def _least_between(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """min(values[ends[k - 1] + 1 : ends[k] + 1]) for k > 0, and values before ends[0] for k = 0."""
    if not len(ends):
        return np.zeros(0, values.dtype)
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.minimum.reduceat(values[: ends[-1] + 1], starts)


def _run_ends(text: np.ndarray) -> np.ndarray:
    """The last position of the run of equal symbols that each position is in."""
    n = len(text)
    kind = np.int32 if n < 1 << 31 else np.int64
    ends = np.full(n, n - 1, kind)
    ends[:-1] = np.where(text[:-1] != text[1:], np.arange(n - 1, dtype=kind), n - 1)
    return np.minimum.accumulate(ends[::-1])[::-1]


def _types(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S; the end of the text is smaller than all symbols."""
    rises = np.zeros(len(text), bool)
    rises[:-1] = text[:-1] < text[1:]
    return rises[ends]


def _starts_of_ties(new: np.ndarray) -> np.ndarray:
    """For sorted rows, with `new` where a row differs from the one before: the first place of each row's group."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _name_substrings(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from each LMS position to the next, both included; ties share the first place.

    Symbols are compared with their types, so no substring is a proper prefix of another, and substrings of a tie end together.
    """
    m, n = len(lms), len(text)
    bits = max(2, (2 * int(text.max()) + 2).bit_length())
    per = 64 // bits
    codes = np.concatenate([(text.astype(np.uint64) << np.uint64(1)) + small + np.uint64(1), np.zeros(1, np.uint64)])
    size = np.append(np.diff(lms) + 1, n - lms[-1])
    rank, live, k = np.zeros(m, np.int64), np.arange(m), 0
    while len(live):
        word = np.zeros(len(live), np.uint64)
        for x in range(k, k + per):
            at = np.where(x < size[live], lms[live] + x, n)
            word = word << np.uint64(bits) | codes[at]
        k += per
        order = np.lexsort((word, rank[live]))
        own, word = rank[live][order], word[order]
        group = np.append(True, own[1:] != own[:-1])
        new = group | np.append(True, word[1:] != word[:-1])
        first = _starts_of_ties(new)
        rank[live[order]] = own + first - _starts_of_ties(group)
        tied = ~new | np.append(~new[1:], False)
        live = live[order][tied]
        live = live[size[live] > k]
    return rank


def _sorted_lms(text: np.ndarray, small: np.ndarray, lms: np.ndarray, depth: int, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """LMS positions in suffix order, to `depth` symbols at least, and the prefixes shared by neighbours.

    The names of LMS substrings form a shorter text. Names of one, two, four, ... of them are sorted in turn, only
    where ties are left, until all are told apart or stand for `depth` symbols.
    """
    m = len(lms)
    if not m:
        return lms, np.zeros(0, np.int32)
    rank = _name_substrings(text, small, lms)
    levels, step = [rank], 1
    while True:
        tied = np.flatnonzero(np.bincount(rank, minlength=m)[rank] > 1)
        if not len(tied) or step < m and (lms[step:] - lms[:-step]).min() >= depth:
            break
        second = np.where(tied + step < m, rank[np.minimum(tied + step, m - 1)], -1)
        order = np.argsort(rank[tied] * np.int64(m + 1) + second + 1, kind="stable")
        own, second = rank[tied][order], second[order]
        group = np.append(True, own[1:] != own[:-1])
        new = group | np.append(True, second[1:] != second[:-1])
        kept = store.array(m, np.int64)
        kept[:] = rank
        levels[-1], rank = kept, rank.copy()
        rank[tied[order]] = own + _starts_of_ties(new) - _starts_of_ties(group)
        levels.append(rank)
        step *= 2
    order = np.argsort(rank, kind="stable")
    i, j = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        same = (i < m) & (j < m) & (levels[k][np.minimum(i, m - 1)] == levels[k][np.minimum(j, m - 1)])
        i[same] += 1 << k
        j[same] += 1 << k
    ends = np.append(lms, len(text))
    i, j = np.minimum(i, m), np.minimum(j, m)
    rest = _shared(text, ends[i], ends[j], depth)
    rest[1:] += (ends[i] - lms[order[:-1]]).astype(np.int32)
    return lms[order], rest


def _shared(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of suffixes a[k] and b[k], up to `depth` or a little more; a leading 0 for the first suffix."""
    n, out = len(text), np.zeros(len(a) + 1, np.int32)
    live, at = np.arange(len(a)), 0
    padded = np.concatenate([text.astype(np.int32), np.full(16, -1, np.int32)])
    padded[n:] -= np.arange(16, dtype=np.int32)
    while len(live) and at < depth:
        x, y = a[live] + at, b[live] + at
        same = np.ones(len(live), bool)
        got = np.zeros(len(live), np.int32)
        for k in range(8):
            i, j = x + k, y + k
            same &= (i < n) & (j < n) & (padded[np.minimum(i, n)] == padded[np.minimum(j, n)])
            if not same.any():
                break
            got += same
        out[live + 1] += got
        live = live[same]
        at += 8
    return out


def suffixes(text: np.ndarray, depth: int, store: Store | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stretches of (positions, common prefixes) in descending order of symbols; inside a stretch suffixes ascend.

    Suffixes are in order to `depth` symbols at least, and prefixes are exact up to there. The first tuple of each
    stretch shares nothing with the suffix before it.
    """
    store = store or Store()
    text = text.astype(np.int64) if text.dtype.itemsize > 4 else text
    n, symbols = len(text), int(text.max(initial=0)) + 1
    ends = _run_ends(text)
    small = _types(text, ends)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order, shared = _sorted_lms(text, small, lms, depth, store)
    cap = np.int32(depth)
    first = text[order]
    cuts = np.searchsorted(first, np.arange(symbols + 1))

    ascending, larger = Queues(symbols, store), [None] * symbols
    if n:
        ascending.push(int(text[-1]), np.array([n - 1]), np.zeros(1, np.int32))
    for c in range(symbols):
        position, prefix = ascending.pop(c)
        position, prefix = _own_pushes(text, small, c, False, position, prefix, cap)
        seeds, between = order[cuts[c] : cuts[c + 1]], shared[cuts[c] : cuts[c + 1]].copy()
        larger[c] = (position, prefix)
        if len(position) and len(seeds):
            between[0] = min(ends[p] - p + 1 for p in (position[-1], seeds[0]))
        _deal(text, small, c, False, np.concatenate([position, seeds]), np.concatenate([prefix, np.minimum(between, cap)]), ascending, cap)
    descending = Queues(symbols, store)
    for c in range(symbols - 1, -1, -1):
        back, prefix = descending.pop(c)  # in descending order: prefix[k] is shared with the larger one before it
        back, prefix = _own_pushes(text, small, c, True, back, prefix, cap)
        position, up = larger[c]
        larger[c] = None
        down = np.concatenate([[0], up[:0:-1]]).astype(np.int32) if len(position) else up
        if len(back) and len(position):
            down[0] = min(ends[p] - p + 1 for p in (back[-1], position[-1]))
        every, between = np.concatenate([back, position[::-1]]), np.concatenate([prefix, down])
        _deal(text, small, c, True, every, between, descending, cap)
        if len(every):
            yield every[::-1], np.concatenate([[0], between[:0:-1]]).astype(np.int32)


def _before(text: np.ndarray, small: np.ndarray, kind: bool, position: np.ndarray) -> np.ndarray:
    """Whether the suffix before each position is of the wanted type."""
    return (position > 0) & (small[position - 1] == kind)


def _own_pushes(text: np.ndarray, small: np.ndarray, c: int, kind: bool, position: np.ndarray, prefix: np.ndarray, cap: np.int32) -> tuple[np.ndarray, np.ndarray]:
    """Adds the suffixes that a queue induces into itself, turn by turn."""
    places, prefixes, base, start, source = [position], [prefix], len(position), 0, -1
    every = prefix
    while len(position):
        good = np.flatnonzero(_before(text, small, kind, position))
        good = good[text[position[good] - 1] == c]
        if not len(good):
            break
        ends = good + start
        between = _least_between(every[source + 1 :], ends - source - 1) if source >= 0 else _least_between(every, ends)
        between = np.minimum(between + 1, cap).astype(np.int32)
        if source < 0:
            between[0] = min(1, cap)  # the one before came from a queue of another symbol
        source, start = int(ends[-1]), base
        position = position[good] - 1
        places.append(position)
        prefixes.append(between)
        base += len(position)
        every = np.concatenate([every, between])
    return np.concatenate(places), every


def _deal(text: np.ndarray, small: np.ndarray, c: int, kind: bool, position: np.ndarray, prefix: np.ndarray, queues: Queues, cap: np.int32) -> None:
    """Pushes the suffixes before those of one symbol into the queues of the other symbols."""
    good = np.flatnonzero(_before(text, small, kind, position))
    symbols = text[position[good] - 1]
    keep = symbols != c
    good, symbols = good[keep], symbols[keep]
    order = np.argsort(symbols, kind="stable")
    good, symbols = good[order], symbols[order]
    cuts = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1])) if len(symbols) else np.zeros(0, int)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(symbols)], strict=False):
        ends = good[a:b]
        between = np.minimum(_least_between(prefix, ends) + 1, cap).astype(np.int32)
        between[0] = 1
        queues.push(int(symbols[a]), position[ends] - 1, between)
