import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pagewright.llm import packing as P
from pagewright.session import table


@pytest.fixture(scope="module")
def coder():
    return P.word_coder(P.default_path())


def test_ids_as_the_library_gives_them(coder):
    rnd = random.Random(5)
    letters = list("abz's'tremdlABÉ  \n\t\x1c\x1e09!.é中١ ʰⅧ😀'rellve'Σİ́ é<|startoftext|>")
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + ["", "a" * 5000, "don't we'll I'ds"]
    want = [e.ids for e in coder.whole.encode_batch(texts, add_special_tokens=False)]
    assert [g.tolist() for g in coder.encode_batch(texts)] == want


@pytest.mark.parametrize("limits", [(2048, 256, 2048), (64, 3, 40), (16, 1, 16), (128, 8, 5)])
@pytest.mark.parametrize("lead", [0, 4])
def test_limits_hold_and_nothing_is_lost(limits, lead):
    rnd = random.Random(2)
    docs = [np.array([rnd.randrange(9) for _ in range(rnd.choice([1, 5, 30, 700]))], np.uint32) for _ in range(400)]
    loss = [rnd.randint(0, len(d)) for d in docs]
    packer, made = P.Packer(limits, window=50, open_bins=6, lead=lead), []
    for i, d in enumerate(docs):
        made += packer.add(i, d, loss[i])
    made += packer.finish()
    parts = defaultdict(list)
    for items in made:
        assert sum(len(x.ids) for x in items) <= limits[0] and len(items) <= limits[1] and sum(x.cost()[2] for x in items) <= limits[2]
        for x in items:
            parts[x.key].append((x.start, x.ids))
    for i, d in enumerate(docs):
        assert np.array_equal(np.concatenate([p for _, p in sorted(parts[i], key=lambda x: x[0])]), d)


def _sequences(docs, limits=P.LIMITS):
    packer, made = P.Packer(limits), []
    for i, n in enumerate(docs):
        made += packer.add(i, np.full(n, i, np.uint32), n)
    return made + list(packer.finish())


@pytest.mark.parametrize("docs", [[3] * 5000, [1] * 3000 + [9000], [40, 3, 2048, 2049, 700] * 200, [5000] * 30])
def test_no_padding_whatever_the_lengths(docs):
    made = _sequences(docs)
    sizes = [sum(len(x.ids) for x in items) for items in made]
    assert sum(sizes) == sum(docs) and all(s & (s - 1) == 0 and s <= 2048 for s in sizes)
    assert all(len(items) <= P.MAX_SEGMENTS and sum(x.cost()[2] for x in items) <= P.MAX_LOSS_TOKENS for items in made)


def test_the_loss_limit_decides():
    docs = [6000] * 10 + [40] * 300
    bound, free = (max(sum(x.cost()[2] for x in items) for items in _sequences(docs, (2048, 256, most))) for most in (P.MAX_LOSS_TOKENS, 2048))
    assert bound == P.MAX_LOSS_TOKENS < free


def test_limits_of_nothing_are_refused():
    with pytest.raises(ValueError, match="at least 1"):
        P.Packer((2048, 256, 0))


def test_a_small_cache_gives_the_same_ids(coder, monkeypatch):
    texts = [f"word{chr(97 + k % 7) * (k % 13)}, other{k}; don't {'x' * (k % 90)}!!" for k in range(400)]
    want = [e.ids for e in coder.whole.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(P, "CACHE_WORDS", 20)
    small = P.WordCoder(P.default_path())
    assert [small.encode_batch([t])[0].tolist() for t in texts] == want


def test_query_over_documents(spark, coder):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    found = P.query(docs).toPandas()
    texts = docs.toPandas().set_index("doc_id").text
    for doc_id, g in found.groupby("doc_id"):
        ids = np.append(coder.encode_batch([texts[doc_id]])[0], np.uint32(1))
        g = g.sort_values("start")
        assert g.start.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() == len(ids) and (g.doc_tokens == len(ids)).all()
        assert [zlib.crc32(ids[s : s + n].astype("<u4").tobytes()) for s, n in zip(g.start, g.length, strict=True)] == g.ids_crc32.tolist()
    totals = found.groupby("sequence_id").length.sum()
    assert totals.max() <= 2048 and all(t == 2048 or t & (t - 1) == 0 for t in totals)
    assert all((g.sort_values("offset").offset == g.sort_values("offset").length.cumsum() - g.sort_values("offset").length).all() for _, g in found.groupby("sequence_id"))


def test_odd_rows(odd_docs, no_docs):
    found = P.query(odd_docs).toPandas()
    assert P.query(no_docs).count() == 0 and (found[found.doc_id.isin([3, 4, 5])].doc_tokens == 1).all()
    assert P.pack(odd_docs, P.default_path(), loss="size").count() > 0
