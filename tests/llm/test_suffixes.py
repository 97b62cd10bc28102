import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import induced, suffix_dedup as S
from pagewright.session import table


def shared(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("seed", range(6))
def test_order_and_prefixes(seed):
    rnd = random.Random(seed)
    for _ in range(40):
        s = [rnd.randrange(rnd.choice([1, 2, 3, 200])) for _ in range(rnd.randint(1, 100))]
        s = (s[: rnd.randint(1, 20)] * 20)[: len(s)] if rnd.random() < 0.5 else s
        depth, held = rnd.choice([5, 20, 400]), rnd.choice([0, 1 << 20])
        store = induced.Store(held)
        parts = [(p.copy(), q.copy()) for p, q in induced.suffixes(np.array(s, np.uint16), depth, store)][::-1]
        store.close()
        position, prefix = (np.concatenate([p[k] for p in parts]).tolist() for k in (0, 1))
        assert sorted(position) == list(range(len(s)))
        for k in range(1, len(s)):
            a, b = s[position[k - 1] :], s[position[k] :]
            assert a[:depth] <= b[:depth] and min(shared(a, b), depth) == min(prefix[k], depth)


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + S.LENGTH] for r in raws for i in range(len(r) - S.LENGTH + 1))
    out = []
    for r in raws:
        cover = np.zeros(len(r) + 1, int)
        for i in range(len(r) - S.LENGTH + 1):
            if seen[r[i : i + S.LENGTH]] > 1:
                cover[i] += 1
                cover[i + S.LENGTH] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        out.append((len(r), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def planted():
    rnd = random.Random(4)
    words = lambda n: " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 8))) for _ in range(n))
    passage, long = words(90), words(300)
    texts = [words(50) + " " + passage + " " + words(40) for _ in range(6)]
    texts += [long, long, long[:900] + "X" + long[901:], long[3:], "ab" * 500, "ab" * 300, words(20), "", None, "z" * 399, "z" * 401, passage[:399], passage[7:], passage]
    return texts + [passage[10:300] + words(30), words(5) + passage[: 160 + 40] + words(60)]


def test_marks_match_brute_force(spark):
    texts = planted()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, h string").repartition(4)
    found = [tuple(r)[1:] for r in sorted(S.query(docs).collect(), key=lambda r: r.doc_id)]
    assert found == brute(texts)


def test_crowded_anchors_and_small_shards(spark):
    texts = planted()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = [b[1] for b in brute(texts)]
    for split, crowded in ((1, 1000), (1, 3), (1000, 2)):
        facts, gone = S.removals(docs, split, crowded, shard_bytes=2000)
        found = {r.doc_id: r.n_removed or 0 for r in facts.join(gone, ["t1", "t2"], "left").collect()}
        assert [found[i] for i in range(len(texts))] == want


def test_many_shards_in_a_partition(monkeypatch, spark):
    texts = planted()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(S, "MOST_PARTITIONS", 1)
    facts, gone = S.removals(docs, shard_bytes=1000)
    found = {r.doc_id: r.n_removed or 0 for r in facts.join(gone, ["t1", "t2"], "left").collect()}
    assert [found[i] for i in range(len(texts))] == [b[1] for b in brute(texts)]


def test_queues_of_a_production_shard_spill(monkeypatch):
    rnd = random.Random(8)
    raw = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 8))) for _ in range(S.SHARD_BYTES // 6))[: S.SHARD_BYTES - 1000].encode()
    raw += raw[5000:6000]
    spilled, own = [], induced.Queues._spill
    monkeypatch.setattr(induced.Queues, "_spill", lambda self, symbol: (spilled.append(symbol), own(self, symbol)))
    text = np.append(np.frombuffer(raw, np.uint8).astype(np.uint16) + 1, 0).astype(np.uint16)
    found = S.repeats(text, np.array([0]), np.array([len(raw) - S.LENGTH + 1]))
    n = len(raw) - 1000
    assert spilled and found == [[(5000, 5601), (n, n + 601)]]


def test_steps_of_long_texts(monkeypatch, spark):
    monkeypatch.setattr(S, "STEP", 700)
    raw = planted()[6].encode() * 3
    _, _, a, _, b, n, _ = S.anchors(raw)
    assert a[0] == 0 and b[-1] == len(raw) - S.LENGTH + 1 and (a[1:] == b[:-1]).all() and (n > 0).all()


def test_sample_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    found = [tuple(r)[1:] for r in sorted(S.query(docs).collect(), key=lambda r: r.doc_id)]
    assert found == brute([r.text for r in docs.orderBy("doc_id").collect()])


def test_odd_rows(odd_docs, no_docs):
    assert S.query(odd_docs).count() == odd_docs.count() and S.query(no_docs).count() == 0
    kept = S.without_repeats(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
