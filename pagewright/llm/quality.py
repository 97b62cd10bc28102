"""Quality scores: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import held_out, lean, materialize, sampled, text_batches

DOCS_PER_LABEL = 2_000
DIM = 48
NONZERO = 6
REACH = 2
VOCABULARY = 20_000
LEAST_COUNT = 3
HIDDEN = 24
EPOCHS = 60
THRESHOLD = 0.7
LEARN_TASKS = 8
CACHE_WORDS = 150_000
SLICE = 1 << 16
_CORE = re.compile(r"[^\W\d_]+")
_RUNS = re.compile(r"(.)\1+")
KINDS = (0, 1)  # words and shapes
_COLUMNS = [f"v{j}" for j in range(DIM)]
_FORM = str.maketrans({**{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}, **{chr(c): "0" for c in range(48, 58)}})


def form_of(word: str) -> str:
    """Shape of a word: runs of lower case, upper case, digits and other marks, each as one character."""
    shape = word.translate(_FORM)
    if not shape.isascii():
        shape = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in shape)
    return _RUNS.sub(r"\1", shape)[:12]


def core_of(word: str) -> str:
    return "".join(_CORE.findall(word.lower()))


def index_vector(word: str, dim: int = DIM) -> np.ndarray:
    """The sparse ternary vector that a hash of the word fixes."""
    out, h = np.zeros(dim, np.float32), xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7)
    for k in range(NONZERO):
        part = h >> (10 * k) & 1023
        out[(part >> 1) % dim] += 1 if part & 1 else -1
    return out


def streams_of(text: str) -> list[list[str]]:
    """The words of a text, without marks and in lower case, and their shapes."""
    words = text.split()
    known = {w: (sys.intern(core_of(w)), sys.intern(form_of(w))) for w in set(words)}
    return [[known[w][k] for w in words] for k in KINDS]


def add_neighbours(total: np.ndarray, words: list[str], place: dict[str, int], index: np.ndarray) -> None:
    """Adds, for each word of a vocabulary, the index vectors of its neighbours in a text to its sum."""
    ids = np.array([place.get(w, -1) for w in words], np.int64)
    for d in range(1, REACH + 1):
        a, b = ids[:-d], ids[d:]
        ok = (a >= 0) & (b >= 0)
        np.add.at(total, a[ok], index[b[ok]])
        np.add.at(total, b[ok], index[a[ok]])


def context_vectors(rows: DataFrame) -> list[dict[str, np.ndarray]]:
    """Random indexing over the texts of rows: each frequent word, and each frequent shape, gets the normed sum of the index
    vectors of its neighbours. Counts and sums are made in tasks; the driver gets the VOCABULARY of either kind.
    """

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = Counter((k, w) for t in batch.column("text").to_pylist() for k, s in enumerate(streams_of(t)) for w in s if w)
            yield pa.record_batch([pa.array([k for k, _ in found], pa.int32()), pa.array([w for _, w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["kind", "word", "n"])

    counts = rows.select("text").mapInArrow(count, "kind int, word string, n long").groupBy("kind", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    counts = materialize(counts, "counts")
    frequent = [[r.word for r in counts.where(F.col("kind") == k).orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()] for k in KINDS]
    index = [np.stack([index_vector(w) for w in words] or [np.zeros(DIM, np.float32)]).astype(np.int8) for words in frequent]
    shared = rows.sparkSession.sparkContext.broadcast((frequent, index))  # two vocabularies at most

    @lean
    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, vectors = shared.value
        places = [{w: i for i, w in enumerate(ws)} for ws in words]
        total = [np.zeros((len(v), DIM), np.int64) for v in vectors]
        for batch in text_batches(batches):
            for t in batch.column("text").to_pylist():
                for k, s in enumerate(streams_of(t)):
                    add_neighbours(total[k], s, places[k], vectors[k])
        for k in KINDS:
            own = np.flatnonzero(total[k].any(1))
            yield pa.record_batch([pa.array(np.full(len(own), k, np.int32)), pa.array(own), *[pa.array(total[k][own, j]) for j in range(DIM)]], ["kind", "word", *_COLUMNS])

    sums = rows.select("text").mapInArrow(neighbours, "kind int, word long, " + ", ".join(f"{c} long" for c in _COLUMNS))
    sums = sums.groupBy("kind", "word").agg(*[F.sum(c).alias(c) for c in _COLUMNS])
    out = [np.zeros((len(v), DIM), np.float32) for v in index]
    for r in sums.collect():  # a row per word of the vocabularies
        out[r[0]][r[1]] = r[2:]
    for v in out:
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return [{w: v[i] for i, w in enumerate(words)} for words, v in zip(frequent, out, strict=True)]


class Pooler:
    """Document features: means of the vectors of words and of word shapes, how often a word repeats the one before, length."""

    def __init__(self, cores: dict[str, np.ndarray], forms: dict[str, np.ndarray]) -> None:
        self.core = {w: i + 1 for i, w in enumerate(cores)}
        self.form = {w: i + 1 for i, w in enumerate(forms)}
        self.cores = np.stack([np.zeros(DIM, np.float32), *cores.values()])
        self.forms = np.stack([np.zeros(DIM, np.float32), *forms.values()])
        self.cache: dict[str, int] = {}
        self.table = np.zeros((0, 2), np.int64)

    def _add(self, words: set[str]) -> None:
        if len(self.cache) > CACHE_WORDS:
            raise RuntimeError("clear() first")
        new = sorted(words)
        rows = np.array([[self.core.get(core_of(w), 0), self.form.get(form_of(w), 0)] for w in new], np.int64).reshape(-1, 2)
        self.cache.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
        self.table = np.concatenate([self.table, rows])

    def features(self, texts: list[str | None]) -> np.ndarray:
        if len(self.cache) > CACHE_WORDS // 2:
            self.cache, self.table = {}, self.table[:0]
        split = [t.split() if t else [] for t in texts]
        self._add(set().union(*split) - self.cache.keys())
        out, get = np.zeros((len(texts), 2 * DIM + 5), np.float32), self.cache.__getitem__
        for row, words in zip(out, split, strict=True):
            if not (n := len(words)):
                continue
            ids = np.fromiter(map(get, words), np.int64, n)
            for at in range(0, n, SLICE):
                core, form = self.table[ids[at : at + SLICE]].T
                row[:DIM] += self.cores[core].sum(0)
                row[DIM : 2 * DIM] += self.forms[form].sum(0)
                row[-5] += (core == 0).sum()
                row[-4] += (form == 0).sum()
            row[:-3] /= n
            row[-3] = (ids[1:] == ids[:-1]).sum() / n
            row[-2] = len(set(words)) / n
            row[-1] = np.log1p(n) / 10
        return out


class Network:
    """Two layers in numpy with a temperature that calibrates the output."""

    def __init__(self, size: int, seed: int = 11) -> None:
        self.prior = 0.0
        rng = np.random.default_rng(seed)
        self.w1, self.b1 = rng.normal(0, size**-0.5, (size, HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)
        self.mean, self.scale, self.temperature = np.zeros(size), np.ones(size), 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature + self.prior, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 5) -> None:
        """Adam on the cross entropy, both labels weighted to the same total, with a little weight decay."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        rng, params = np.random.default_rng(seed), [self.w1, self.b1, self.w2, self.b2]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 128):
                some = order[at : at + 128]
                a, hidden = x[some], np.tanh(x[some] @ self.w1 + self.b1)
                error = (1 / (1 + np.exp(-np.clip(hidden @ self.w2 + self.b2[0], -40, 40))) - y[some]) * weight[some] / len(some)
                back = error[:, None] * self.w2 * (1 - hidden**2)
                t += 1
                for i, g in enumerate((a.T @ back + 1e-4 * self.w1, back.sum(0), hidden.T @ error + 1e-4 * self.w2, np.array([error.sum()]))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    params[i] -= 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least cross entropy on rows that were not fitted."""
        z = self.logits(x)
        loss = lambda s: np.logaddexp(0, -np.where(y == 1, z, -z) / s).mean()
        self.temperature = float(min(np.geomspace(0.5, 8, 57), key=loss))


def sample(docs: DataFrame, labels: DataFrame, per_label: int = DOCS_PER_LABEL) -> tuple[DataFrame, float]:
    """doc_id, quality, text of about per_label whole labelled texts for each label, drawn by a hash of the id, held-out rows excluded.

    The number of rows is bounded by twice per_label whatever the input; the texts stay in a table. An id counts once for each
    label, with the least of its texts. Also returns the logarithm of the odds of label 1 among all labels that may be learned from.
    """
    good = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "quality").distinct()
    sizes = {r["quality"]: r["n"] for r in good.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("quality") == 1, min(1.0, per_label / sizes.get(1, 1))).otherwise(min(1.0, per_label / sizes.get(0, 1)))
    chosen = good.where(sampled(F.xxhash64("doc_id", F.lit("quality")), share))
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")  # bounded, see above
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    odds = (sizes.get(1, 0) + 1) / (sizes.get(0, 0) + 1)
    return materialize(rows, "sample"), float(np.log(odds))


def learn(rows: DataFrame, prior: float = 0.0) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], Network]:
    """Word vectors, shape vectors and the network from a sample(); every fifth row only calibrates.

    Both labels weigh the same in training; prior, the true log odds, is added to the calibrated ones. No text comes to the
    driver: words are counted and features computed in tasks.
    """
    rows = rows.repartition(LEARN_TASKS, "doc_id")
    cores, forms = context_vectors(rows)
    shared = rows.sparkSession.sparkContext.broadcast((cores, forms))  # two vocabularies at most

    @lean
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooler = Pooler(*shared.value)
        for batch in text_batches(batches):
            x = pooler.features(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), batch.column("quality"), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "quality", "x"])

    found = rows.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality"), "text").mapInArrow(features, "doc_id long, quality int, x array<float>")
    found = sorted(found.collect(), key=lambda r: (r.doc_id, r.quality))  # a row of numbers for each text of the sample
    x = np.array([r.x for r in found], np.float32).reshape(len(found), 2 * DIM + 5)
    y = np.array([r.quality for r in found], float)
    net = Network(2 * DIM + 5)
    if len(set(y)) == 2:
        rest = np.array([xxhash.xxh32_intdigest(str(r.doc_id)) % 5 == 0 for r in found])
        rest = rest if len(set(y[rest])) == 2 and len(set(y[~rest])) == 2 else np.zeros(len(y), bool)
        net.fit(x[~rest], y[~rest])
        net.prior = prior
        net.calibrate(x[rest] if rest.any() else x, y[rest] if rest.any() else y)
    else:
        net.w2[:] = 0
        net.b2[:] = 4.0 if not len(y) or y[0] == 1 else -4.0
    return cores, forms, net


def score(docs: DataFrame, model: tuple, column: str = "score") -> DataFrame:
    """All columns of docs with the calibrated probability of label 1, from the text alone.

    Null and empty texts get the score of a document without words; other columns pass through unread.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most two vocabularies of VOCABULARY vectors
    keep = [c for c in docs.columns if c != column]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cores, forms, net = shared.value
        pooler = Pooler(cores, forms)
        for batch in text_batches(batches):
            found = net.probabilities(pooler.features(batch.column("text").to_pylist()))
            yield pa.record_batch([*batch.columns, pa.array(found, pa.float64())], [*keep, column])

    fields = [docs.schema[c] for c in keep]
    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, StructType([*fields, StructField(column, DoubleType())]))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    model = learn(*sample(docs, labels))
    found = score(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast(IntegerType()).alias("predicted"))
