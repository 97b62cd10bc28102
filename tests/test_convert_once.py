"""What several parts of the conversion read is made once."""

from pyspark.sql import functions as F

from pagewright.api import Conversion
from pagewright.functions import text as T
from pagewright.operators import book


def test_elements_read_stored_rows(spark):
    """The columns of pages are read off once, and not again for each part of the plan that needs them."""
    rows = spark.createDataFrame([(1, p, k, "text", 0, 10 * k, 50, 10 * k + 8, f"line {p} {k}") for p in (1, 2) for k in range(3)], "book long, page_index long, ord long, ref string, l long, t long, r long, b long, text string")
    found = book.elements(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "LogicalRDD" not in plan and "LocalRelation" not in plan
    assert found.select(F.sum(F.size("blocks"))).first()[0] == 6
    made = Conversion(rows)
    assert made.markdown().count() == 1 and "elements_footnote" not in made._held


def test_marks_are_widened_after_han_text_only(spark):
    rows = spark.createDataFrame([("你好,世界:好. a,b",), ("a, b: c",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(T.widen_marks(rows["t"])).collect()] == ["你好，世界：好. a,b", "a, b: c", None, ""]
