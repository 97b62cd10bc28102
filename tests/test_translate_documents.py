"""Documents translated where they are parsed."""

from pyspark.sql import functions as F

from pagewright.functions import markup
from pagewright.operators import translate
from pagewright.operators.flow import pack


def test_packs_follow_the_rule_of_rows(spark):
    costs = [5, 0, 12, 3, 30, 1, 9, 9, 2, 40, 41]
    rows = spark.createDataFrame([(1, k, "x" * c) for k, c in enumerate(costs)], "d long, seg long, t string")
    want = [r["pack"] for r in pack(rows.select("d", "seg", F.ceil(F.length("t") / 4).alias("c")), ["d"], "seg", "c", 5).orderBy("seg").collect()]
    assert [n for n, p in enumerate(translate.packs(["x" * c for c in costs], 5)) for _ in p] == want


def test_documents_are_translated_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, '<?xml version="1.0"?>\n<d><p id="a">x<b id="a">y</b></p><p>z&#13;w &amp;</p></d>'), (2, "<d>"), (None, "<d>q</d>"), (4, None), (5, "<d/>")], "k long, x string")
    made = translate.translate_documents(docs, "k", "x", lambda: lambda texts: [f"<{t}>" for t in texts], markup.APPEND_BLOCK)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["k"] or 0, r["x"] or "") for r in made.collect()) == [
        (0, "<d>q</d>"),
        (1, '<?xml version="1.0"?>\n<d><p id="a">x<b id="a__translated">y</b></p><p id="a__translated_2">&lt;x&gt;<b id="a__translated_3">&lt;y&gt;</b></p><p>z\nw &amp;</p><p>&lt;z w &amp;&gt;</p></d>'),
        (2, "<d>"),
        (4, ""),
        (5, "<d/>"),
    ]


def test_blocks_within_blocks_are_copied_once():
    deep = "<d>" + "".join(f"<div>a{k}<p>b{k}</p></div>" for k in range(3)) + "<p>c</p></d>"
    texts = [s.text.upper() for s in markup.segments(markup.parse(deep))]
    assert markup.submit(deep, texts, markup.APPEND_BLOCK) == "<d>" + "".join(f"<div>a{k}<p>b{k}</p><p>B{k}</p></div>" for k in range(3)) + "<p>c</p><p>C</p></d>"


def test_only_the_answer_of_a_row_is_filled_in(spark):
    """Texts are put into the template and into one answer, not into each of the eleven."""
    from pagewright.plans import markup_queries
    from pagewright.session import table

    made = markup_queries.faulty(spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("{0}, ") <= 2 < len(markup_queries._ANSWERS) and made.count() == table(spark, "/root/testdata/sf0.001", "documents").where("text IS NOT NULL").select(F.sum(F.size(F.split("text", "\n", -1)))).first()[0]
