import numpy as np

from pagewright.llm import langid
from pagewright.session import table


def test_forward_sums_all_segmentations():
    model = langid.LanguageModel(["a", "b"], langid.default_path())
    model.probs[:-1] = np.random.default_rng(0).random(model.probs[:-1].shape)
    model.probs /= model.probs.sum(0)
    lookup, n = langid.vocabulary(langid.default_path())

    def piece(s):
        h = 0
        for c in s:
            h = (h * 0x100000001B3 + ord(c)) % 2**64
        i = int(lookup.get(np.array([h], np.uint64))[0])
        return i if i >= 0 else n if len(s) == 1 else n + 1

    def total(s, k):
        return sum(model.probs[piece(s[:i]), k] * total(s[i:], k) for i in range(1, min(10, len(s)) + 1)) if s else 1.0

    words = ["hello", "zug", "éa", "q", "中x"]
    got = model.log_likelihood(words)
    want = [[np.log(total(f"▁{w}", k)) for k in (0, 1)] for w in words]
    assert np.allclose(got, want)


def test_rounds_raise_likelihood():
    model = langid.LanguageModel(["a"], langid.default_path())
    words, counts = ["the", "then", "other"], np.array([[5.0], [2.0], [1.0]])
    before = (model.log_likelihood(words) * counts).sum()
    model.refit(words, counts)
    assert (model.log_likelihood(words) * counts).sum() > before


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = langid.query(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.97


def test_odd_rows(odd_docs, no_docs):
    found = langid.query(odd_docs).collect()
    assert len(found) == odd_docs.count() and langid.query(no_docs).count() == 0
    for r in found:
        assert 0 <= r.score <= 1
        if r.doc_id in (3, 4, 5, 6):
            assert r.lang_pred == "und" and r.score == 0
