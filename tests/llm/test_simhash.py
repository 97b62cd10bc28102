import random
import re
import time

import numpy as np
import xxhash
from pyspark.sql import functions as F

from pagewright.llm import simhash as H
from pagewright.llm.common import materialize, release, scratch
from pagewright.llm.components import connected_components
from pagewright.session import table


def plain(text):
    text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(near, ids):
    label = np.arange(len(ids))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            return np.array(ids)[label]
        label = new


def test_sample_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = H.query(docs).toPandas().sort_values("doc_id")
    texts = docs.toPandas().sort_values("doc_id")
    want = np.array([plain(t) for t in texts.text], np.uint64)
    assert found.fingerprint.tolist() == [f"{w:016x}" for w in want.tolist()]
    near = np.bitwise_count(want[:, None] ^ want) <= 2
    assert (found.component_id.values == components(near, texts.doc_id.values)).all()


def near_prints(rnd, n):
    centres = [rnd.getrandbits(64) for _ in range(6)] + [0, 2**64 - 1]
    out = set()
    while len(out) < n:
        x = rnd.choice(centres)
        for _ in range(rnd.randint(0, 4)):
            x ^= 1 << rnd.randrange(64)
        out.add(x)
    return np.array(sorted(out), np.uint64)


def test_links_and_crowded_cells(spark):
    prints = near_prints(random.Random(3), 400)
    signed = prints.view(np.int64).tolist()
    near = np.bitwise_count(prints[:, None] ^ prints) <= 2
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for cap in (1024, 3):
        label = {r.node: r.component for r in connected_components(H.links(df, cap=cap)).collect()}
        got = [label.get(x, x) for x in signed]
        want = components(near, np.arange(len(signed)))
        assert len({(a, b) for a, b in zip(got, want.tolist(), strict=True)}) == len(set(got)) == len(set(want.tolist()))


def test_cells_hold_all_near_pairs():
    prints = near_prints(random.Random(8), 120)
    cells = H.grid_cells(prints.view(np.int64))
    near = np.argwhere(np.triu(np.bitwise_count(prints[:, None] ^ prints) <= 2, 1))
    assert all((cells[i] == cells[j]).any() for i, j in near)
    gap = np.abs(H.popcounts(prints.view(np.int64)).astype(int)[:, None] - H.popcounts(prints.view(np.int64)).astype(int)).sum(2)
    assert (gap <= np.bitwise_count(prints[:, None] ^ prints)).all()


def test_components_of_shapes(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    edges = spark.createDataFrame([*chain, *star, (5, 5), (None, 3), (7, None)], "a long, b long")
    found = connected_components(edges).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.component, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [50, 61]
    assert connected_components(edges.limit(0)).count() == 0


def test_components_of_few_edges_take_one_step(spark):
    chain = [(i, i + 1) for i in range(300)]
    edges = spark.createDataFrame([*chain, *chain, (1000, 1001), (1001, 1002), (5, 5), (None, 3)], "a long, b long")
    with scratch() as made:
        found = connected_components(edges)
    assert len(made) == 2  # the edges and what they join; rounds of contraction store two tables each
    assert {r.node: r.component for r in found.collect()} == dict.fromkeys(range(301), 0) | dict.fromkeys(range(1000, 1003), 1000)
    for few in (0, 40):  # by rounds alone, and by rounds before the last step
        groups = {}
        for r in connected_components(edges, few=few).collect():
            groups.setdefault(r.component, set()).add(r.node)
        assert sorted(map(sorted, groups.values())) == [list(range(301)), [1000, 1001, 1002]]


def test_release_lets_shuffles_go(spark):
    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    release(spark)
    time.sleep(2)
    before = held()
    for _ in range(3):
        materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert held() > before
    for _ in range(20):
        release(spark)
        time.sleep(0.5)
        if held() <= before:
            break
    assert held() <= before


def test_odd_rows(odd_docs, no_docs):
    found = H.query(odd_docs).collect()
    assert len(found) == odd_docs.count() and H.query(no_docs).count() == 0
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for k in (1, 2) for r in by[k]} == {1} and {r.component_id for k in (3, 4, 5) for r in by[k]} == {3}
    kept = H.first_of_groups(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 7, 8]
