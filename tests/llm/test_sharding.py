import random

from pagewright.llm import sharding
from pagewright.session import table


def test_schedule_takes_the_largest_first():
    placed = sharding.schedule([("a", 5), ("b", 4), ("c", 3), ("d", 3)], 2)
    assert placed["a"] != placed["b"] and placed["b"] == placed["c"] and placed["a"] == placed["d"]
    rnd = random.Random(1)
    sizes = [(i, rnd.randint(1, 50)) for i in range(500)]
    loads = [0] * 7
    for name, shard in sharding.schedule(sizes, 7).items():
        loads[shard] += dict(sizes)[name]
    assert max(loads) - min(loads) <= 2


def test_laws_hold(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = sharding.query(docs).toPandas()
    bytes_ = found.groupby("shard")["size"].sum()
    assert len(bytes_) == 24 and bytes_.max() < 1.01 * bytes_.mean() and len(found) == 1000
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in found.groupby("shard"))
    texts = found.merge(docs.select("doc_id", "text").toPandas(), on="doc_id")
    assert (texts.groupby("text").shard.nunique() == 1).all()


def test_odd_rows(odd_docs, no_docs):
    found = sharding.query(odd_docs).toPandas()
    assert len(found) == odd_docs.count() and sharding.query(no_docs).count() == 0
    assert found[found.doc_id.isin([1, 2])].shard.nunique() == 1 and found[found.doc_id == 3]["size"].tolist() == [8]
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in found.groupby("shard"))
