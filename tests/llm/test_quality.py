import numpy as np

from pagewright.llm import quality as Q
from pagewright.session import table


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.01"
    labels = table(spark, d, "labels")
    found = Q.query(table(spark, d, "documents"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (found.predicted == found.quality).mean() > 0.93
    assert found[found.quality == 1].predicted.mean() > 0.95


def test_scores_do_not_use_held_out_labels(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    from pagewright.llm.common import held_out

    rows, prior = Q.sample(docs, labels)
    turned, prior2 = Q.sample(docs, labels.withColumn("quality", __import__("pyspark").sql.functions.when(held_out(), 1 - labels.quality).otherwise(labels.quality)))
    assert sorted(rows.collect()) == sorted(turned.collect()) and prior == prior2


def test_vectors_and_features_match_brute_force(spark):
    texts = ["The cat sat, the cat ran.", "A cat sat on the mat; the mat was flat!", "the the THE 12 cats", "mat mat mat", "Ça va? the cat"] * 3
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    cores, forms = Q.context_vectors(rows)
    for k, found in enumerate((cores, forms)):
        streams = [[(Q.core_of, Q.form_of)[k](w) for w in t.split()] for t in texts]
        counts = {}
        for s in streams:
            for w in s:
                counts[w] = counts.get(w, 0) + 1
        known = [w for w, n in counts.items() if n >= Q.LEAST_COUNT and w]
        assert set(found) == set(known)
        for w in known:
            total = np.zeros(Q.DIM)
            for s in streams:
                for i, own in enumerate(s):
                    if own == w:
                        total += sum((Q.index_vector(s[j]) for j in range(max(0, i - 2), min(len(s), i + 3)) if j != i and s[j] in known), np.zeros(Q.DIM))
            assert np.allclose(found[w], total / max(np.linalg.norm(total), 1e-9), atol=1e-6)
    pooled = Q.Pooler(cores, forms).features(texts)
    for t, row in zip(texts, pooled, strict=True):
        words = t.split()
        mean = lambda f, v: sum((v.get(f(w), np.zeros(Q.DIM)) for w in words), np.zeros(Q.DIM)) / len(words)
        assert np.allclose(row[: Q.DIM], mean(Q.core_of, cores), atol=1e-5) and np.allclose(row[Q.DIM : 2 * Q.DIM], mean(Q.form_of, forms), atol=1e-5)
        assert np.isclose(row[-2], len(set(words)) / len(words)) and np.isclose(row[-1], np.log1p(len(words)) / 10)


def test_gradient_of_the_network():
    """One step of training goes down the slope that differences of the loss show."""
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(64, 2 * Q.DIM + 5)), rng.integers(0, 2, 64).astype(float)
    net, start = Q.Network(x.shape[1]), Q.Network(x.shape[1])
    net.fit(x, y)
    loss = lambda n: np.logaddexp(0, -np.where(y == 1, n.logits(x), -n.logits(x))).mean()
    assert loss(net) < 0.5 * loss(start)


def test_calibration_lowers_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2 * Q.DIM + 5))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(float)
    net = Q.Network(x.shape[1])
    net.fit(x[:200], y[:200])
    loss = lambda: -np.log(np.where(y[200:] == 1, net.probabilities(x[200:]), 1 - net.probabilities(x[200:])) + 1e-12).mean()
    before = loss()
    net.calibrate(x[200:], y[200:])
    assert loss() <= before and net.temperature > 0


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (6, 0, 0), (None, 1, None), (8, None, None)], "doc_id long, quality int, toxic int")
    found = Q.query(odd_docs, labels).collect()
    assert len(found) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert Q.query(no_docs, labels).count() == 0
    assert Q.query(odd_docs, labels.limit(0)).count() == odd_docs.count()
