"""Language identification by piece unigrams, summed over all segmentations of each word."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held_out, lean, sampled, text_batches
from .tables import HashTable64

DOCS_PER_LANGUAGE = 400
DOCS_IN_ALL = 20_000
LONGEST_PIECE = 10
LONGEST_WORD = 48
ROUNDS = 4
SMOOTHING = 0.02
CACHE_WORDS = 150_000
UNKNOWN = "und"
_BASE, _SCALE = np.uint64(0x100000001B3), 32.0
_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(2)
def vocabulary(path: str) -> tuple[HashTable64, int]:
    """Table of the lower-cased letter pieces of a public piece vocabulary by hash, and their number."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    pieces = sorted(p for p in pieces if 0 < len(p) <= LONGEST_PIECE and p.replace("▁", "", 1).isalpha())
    keys: dict[int, int] = {}
    for p in pieces:
        h = np.zeros(1, np.uint64)
        for c in p:
            h = h * _BASE + np.uint64(ord(c))
        keys.setdefault(int(h[0]), len(keys))
    return HashTable64(np.fromiter(keys, np.uint64, len(keys)), np.arange(len(keys))), len(keys)


def _lattice(words: list[str], table: HashTable64, n: int) -> list[np.ndarray]:
    """Piece ids of all substrings of words of one length, by piece length: [l - 1][word, start]; n: single unknown letter, n + 1: no piece."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1).astype(np.uint64)
    size, out, h = points.shape[1], [], np.zeros(points.shape, np.uint64)
    for k in range(1, min(LONGEST_PIECE, size) + 1):
        h = h[:, : size - k + 1] * _BASE + points[:, k - 1 :]
        ids = table.get(h)
        out.append(np.where(ids >= 0, ids, n if k == 1 else n + 1))
    return out


def _by_length(words: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        size, end = len(words[order[at]]), at
        while end < len(order) and len(words[order[end]]) == size and end - at < 4096:
            end += 1
        yield [words[i] for i in order[at:end]], order[at:end]
        at = end


def _forward(lattice: list[np.ndarray], probs: np.ndarray, size: int) -> list[np.ndarray]:
    """Scaled probabilities of all prefixes: alpha[j] sums over the last piece."""
    alpha = [np.ones((len(lattice[0]), probs.shape[1]))]
    for j in range(1, size + 1):
        total = np.zeros_like(alpha[0])
        for k in range(1, min(len(lattice), j) + 1):
            total += alpha[j - k] * probs[lattice[k - 1][:, j - k]] * _SCALE**k
        alpha.append(total)
    return alpha


class LanguageModel:
    """Per-language piece probabilities; rows beyond the pieces: an unknown letter, and no piece."""

    def __init__(self, langs: list[str], path: str, probs: np.ndarray | None = None) -> None:
        self.langs, self.path = langs, path
        n = vocabulary(path)[1]
        if probs is None:
            probs = np.full((n + 2, len(langs)), 1.0 / (n + 1))
            probs[n + 1] = 0
        self.probs = probs

    def log_likelihood(self, words: list[str]) -> np.ndarray:
        """log P(word | language) with the sum over all segmentations, one row per word of at most LONGEST_WORD letters."""
        table, n = vocabulary(self.path)
        out = np.zeros((len(words), len(self.langs)))
        for group, at in _by_length([f"▁{w}" for w in words]):
            size = len(group[0])
            alpha = _forward(_lattice(group, table, n), self.probs, size)
            out[at] = np.log(np.maximum(alpha[-1], 1e-300)) - size * np.log(_SCALE)
        return out

    def refit(self, words: list[str], counts: np.ndarray) -> None:
        """One round of expectation and maximisation; counts: how often each word occurs in each language."""
        table, n = vocabulary(self.path)
        expected = np.zeros_like(self.probs)
        for group, at in _by_length([f"▁{w}" for w in words]):
            size, lattice = len(group[0]), _lattice(group, table, n)
            alpha = _forward(lattice, self.probs, size)
            beta: list = [None] * size + [np.ones_like(alpha[0])]
            share = counts[at] / np.maximum(alpha[-1], 1e-300)
            for i in range(size - 1, -1, -1):
                beta[i] = np.zeros_like(alpha[0])
                for k in range(1, min(len(lattice), size - i) + 1):
                    ids = lattice[k - 1][:, i]
                    use = self.probs[ids] * _SCALE**k * beta[i + k]
                    beta[i] += use
                    got = alpha[i] * use * share
                    for lang in range(len(self.langs)):
                        expected[:, lang] += np.bincount(ids, got[:, lang], len(expected))
        expected[: n + 1] += SMOOTHING
        expected[n + 1] = 0
        self.probs = expected / expected.sum(0)


def learn(docs: DataFrame, path: str, docs_per_language: int = DOCS_PER_LANGUAGE) -> LanguageModel:
    """Fits the model on about docs_per_language whole documents of each language, drawn by a hash of id and text.

    Only rows with text and lang whose fold is not held out count. The sample is bounded by docs_per_language times the
    number of languages, and by DOCS_IN_ALL, whatever the input; repeats of a text count once, ties between languages go to the
    first by name. Words are counted in tasks: the driver gets a row for each different word of a language, no text. Other columns
    are not read; an empty table gives a model without languages.
    """
    good = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in good.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    langs = sorted(sizes)
    model = LanguageModel(langs, path)
    if not langs:
        return model
    most = min(docs_per_language, DOCS_IN_ALL / len(langs))
    share = F.create_map(*chain.from_iterable((F.lit(x), F.lit(min(1.0, most / sizes[x]))) for x in langs))
    sample = good.where(sampled(F.xxhash64("doc_id", F.length("text"), F.lit("langid")), share[F.col("lang")]))

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = Counter((lang, w) for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True) for w in words_of(t) if w.isalpha())
            yield pa.record_batch([pa.array([x for x, _ in found], pa.string()), pa.array([w for _, w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    rows = sample.select("lang", "text").dropDuplicates().mapInArrow(count, "lang string, word string, n long")
    found = rows.groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().sort_by([("word", "ascending"), ("lang", "ascending")])
    words = found.column("word").unique().to_pylist()
    place, column = {w: i for i, w in enumerate(words)}, {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(words), len(langs)))
    counts[[place[w] for w in found.column("word").to_pylist()], [column[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    for _ in range(ROUNDS if words else 0):
        model.refit(words, counts)
    return model


def words_of(text: str) -> list[str]:
    """Lower-cased letter runs, longer ones in parts of LONGEST_WORD letters; all letters of the text are kept."""
    found = _WORD.findall(text.lower())
    if len(text) > LONGEST_WORD and any(len(w) > LONGEST_WORD for w in found):
        found = [w[i : i + LONGEST_WORD] for w in found for i in range(0, len(w), LONGEST_WORD)]
    return found


class Scorer:
    """Scores texts with a bounded cache of word scores; word 0 stands for all runs that hold no letter."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((CACHE_WORDS, len(self.model.langs)))
        self.used = 1

    def _add(self, words: set[str]) -> None:
        new = []
        for w in words:
            if any(map(str.isalpha, w)):
                new.append(w)
            else:
                self.cache[w] = 0
        if self.used + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((len(new), self.rows.shape[1]))])
        self.rows[self.used : self.used + len(new)] = self.model.log_likelihood(new)
        self.cache.update(zip(new, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The most probable language of each text (ties: the first by name) and its posterior under equal priors."""
        if self.used > CACHE_WORDS:
            self._clear()
        found = [words_of(t) if t else [] for t in texts]
        self._add({w for f in found for w in f if w not in self.cache})
        langs, scores, get = [], [], self.cache.__getitem__
        for f in found:
            ids = np.fromiter(map(get, f), np.int64, len(f))
            if not ids.any() or not self.model.langs:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = self.rows[ids].sum(0)
            best = int(total.argmax())
            langs.append(self.model.langs[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return langs, scores


def identify(docs: DataFrame, model: LanguageModel, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of docs with the predicted language and its score, from the text alone.

    Null texts and texts without a letter give `und` and 0; other columns pass through unread; an empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.path, model.probs))  # pieces times languages, fixed
    keep = [c for c in docs.columns if c not in (lang, score)]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(LanguageModel(*shared.value))
        for batch in text_batches(batches):
            langs, scores = scorer.predict(batch.column("text").to_pylist())
            yield pa.record_batch([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, lang, score])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    fields = [docs.schema[c] for c in keep]
    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, StructType([*fields, StructField(lang, StringType()), StructField(score, DoubleType())]))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    model = learn(docs, default_path())
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
