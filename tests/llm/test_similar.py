import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as C
from pagewright.llm import similar as J, simhash as H
from pagewright.session import table


def plain(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def groups(texts):
    """The first place of the group of each text, by brute force."""
    sets, root = [plain(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or not a.isdisjoint(b) and 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def planted():
    rnd = random.Random(5)
    words = lambda n: [rnd.choice("abcdefgh") + str(rnd.randrange(500)) for _ in range(n)]
    base, line, texts = words(120), words(30), []
    for k in range(40):
        copy = list(base)
        for _ in range(rnd.randint(0, 6)):
            copy[rnd.randrange(120)] = "new" + str(rnd.randrange(10**6))
        texts.append(" ".join(copy))
        texts.append(" ".join(words(rnd.randint(1, 60)) + line + words(rnd.randint(1, 60))))
        own = words(rnd.randint(3, 200))
        texts += [" ".join(own), " ".join([*own[: len(own) * rnd.randint(70, 99) // 100]])]
    return [*texts, "", None, " \n", "One two", "one  TWO"]


@pytest.mark.parametrize("crowd", [64, 3])
def test_groups_match_brute_force(spark, crowd):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in J.near_duplicates(docs, crowd=crowd).collect()}
    assert [found[i] for i in range(len(texts))] == groups(texts)


def test_stage_on_sample_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")
    rows = docs.orderBy("doc_id").collect()
    want = groups([r.text for r in rows])
    kept = {r.doc_id for r in C.near_duplicates(spark, docs, d).select("doc_id").collect()}
    assert kept == {rows[i].doc_id for i in set(want)}


def rows_of(sets, tokens):
    """A batch as the partitions of the prefix join hold it: every set under every token."""
    bits = [J.sketch(J.bitmap(s)) for s in sets]
    names = ["token", "node", "size", "pos", "sketch", "label"]
    columns = [[v for _ in range(tokens) for v in c] for c in (range(len(sets)), [len(s) for s in sets], [0] * len(sets), bits, [None] * len(sets))]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
    token = pa.array([t for t in range(tokens) for _ in sets], pa.int64())
    return pa.record_batch([token, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)


@pytest.mark.parametrize("crowd", [64, 3])
def test_copies_leave_a_task_as_a_tree_not_as_pairs(crowd):
    base = list(range(10**6, 10**6 + 200))
    near = [np.array([*base[:195], *(10**9 + 10 * k + i for i in range(5))], np.uint64) for k in range(50)]
    far = [np.sort(np.random.default_rng(k).integers(0, 1 << 63, 200, np.uint64)) for k in range(7)]
    found = pa.Table.from_batches(J._spanning(iter([rows_of([*near, *far], 3)]), crowd)).to_pylist()
    ends = {x for r in found for x in r.values()}
    assert len(found) == len(near) - 1 and ends == set(range(len(near)))


def test_simhash_joins_what_it_can(spark, monkeypatch):
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    asked = []
    monkeypatch.setattr(J, "links", lambda fps: asked.append({r.fp for r in fps.collect()}) or H.links(fps))
    found = {r.doc_id: r.component_id for r in J.near_duplicates(docs).collect()}
    assert [found[i] for i in range(len(texts))] == groups(texts)
    assert asked == [{H.majority(J.shingles(t)) for t in texts if plain(t)}]


def test_majority_is_the_fingerprint():
    words = [f"w{k}" for k in range(40)]
    assert H.majority(J.shingles(" ".join(words), 3)) == H.fingerprint(" ".join(words)) and H.majority(np.zeros(0, np.uint64)) == 0


def dealt(sets):
    """A batch with every token of every set, as a single partition would hold them."""
    rows = [(t, k, len(p), pos, J.sketch(J.bitmap(p)), None) for k, s in enumerate(sets) for _, p, ts in J.parts(s, np.zeros(0, np.uint64)) for pos, t in enumerate(ts.view(np.int64).tolist())]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["token", "node", "size", "pos", "sketch", "label"])


@pytest.mark.parametrize("small, large", [(4, 5), (452, 511), (452, 565), (500, 625), (512, 512), (1640, 2050), (2000, 2005), (6600, 8250), (8190, 8200)])
def test_sets_cut_into_parts_still_meet_at_the_limit(small, large):
    both = -(-4 * (small + large) // 9)
    for seed in range(5):
        pool = np.unique(np.random.default_rng(seed).integers(0, 1 << 63, 2 * (small + large), np.uint64) * np.uint64(2))
        pool = np.random.default_rng(seed).permutation(pool)[: small + large - both]
        pair = [np.sort(pool[:small]), np.sort(pool[small - both :])]
        assert J.similar(small, large, len(np.intersect1d(*pair)))
        assert pa.Table.from_batches(J._spanning(iter([dealt(pair)]), 64)).num_rows == 1


def counted(monkeypatch, spark, texts):
    """The groups, and how many pairs each dealing of tokens made."""
    made, write = [], J.materialize
    monkeypatch.setattr(J, "materialize", lambda df, label: (out := write(df, label), label == "pairs" and made.append(out.count()))[0])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in J.near_duplicates(docs).collect()}
    return [found[i] for i in range(len(texts))], made


def test_long_texts_with_a_passage_in_common_make_no_pairs(spark, monkeypatch):
    rnd = random.Random(8)
    words = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    texts = [" ".join(words(2000) + line + words(2000)) for line in (words(60) for _ in range(15)) for _ in range(2)]
    found, made = counted(monkeypatch, spark, texts)
    assert found == list(range(30)) and sum(made) == 0


def test_a_pair_leaves_few_tasks_however_many_there_are(spark, monkeypatch):
    rnd, texts = random.Random(9), []
    for _ in range(20):
        own = [f"w{rnd.randrange(10**9)}" for _ in range(300)]
        texts += [" ".join(own), " ".join("new" if k % 60 == 30 else w for k, w in enumerate(own))]
    monkeypatch.setattr(J, "SHARD_ROWS", 100)
    found, made = counted(monkeypatch, spark, texts)
    assert found == groups(texts) == [k // 2 * 2 for k in range(40)] and sum(made) <= 4 * 20
