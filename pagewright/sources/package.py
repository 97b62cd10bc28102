"""A document package: Parquet tables in one folder, with checks; page XML as an exchange format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

TABLES = ("pages", "layouts", "toc", "chapters")
PAGE_XML = "_index INT, _width INT, _height INT, layout ARRAY<STRUCT<_ref: STRING, _order: INT, _section: STRING, _det: STRING, text: STRING>>"


def save(package: dict[str, DataFrame], path: str) -> None:
    """Writes the tables of a package; a failed write leaves no half table, as files are committed together."""
    for name, rows in package.items():
        if name not in TABLES:
            raise ValueError(f"unknown table {name}")
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in TABLES}


def faults(pages: DataFrame, layouts: DataFrame) -> DataFrame:
    """doc_id, page_index, fault: pages below 1, sizes that are not positive, rows of unknown pages, gaps in the order of rows."""
    bad = pages.where("page_index < 1").withColumn("fault", F.lit("page number"))
    flat = pages.where("coalesce(width, 0) <= 0 OR coalesce(height, 0) <= 0").withColumn("fault", F.lit("page size"))
    lost = layouts.join(pages, ["doc_id", "page_index"], "left_anti").withColumn("fault", F.lit("unknown page"))
    order = Window.partitionBy("doc_id", "page_index", "section").orderBy("ord")
    gaps = layouts.withColumn("n", F.row_number().over(order) - 1).where("n <> ord").withColumn("fault", F.lit("order"))
    out = None
    for rows in (bad, flat, lost, gaps):
        rows = rows.select("doc_id", "page_index", "fault").distinct()
        out = rows if out is None else out.union(rows)
    return out


def read_page_xml(spark: SparkSession, path: str, pages: list[int] | None = None) -> DataFrame:
    """Layout rows of page XML files: page_index, section, ord, ref, l, t, r, b, text; pages filters by number before rows are made."""
    x = spark.read.format("xml").option("rowTag", "page").schema(PAGE_XML).load(path)
    x = x.where(F.col("_index").isin(pages)) if pages is not None else x
    box = F.transform(F.split("y._det", ","), lambda v: v.cast("int"))
    rows = x.select(F.col("_index").alias("page_index"), F.explode("layout").alias("y"))
    return rows.select("page_index", F.coalesce("y._section", F.lit("body")).alias("section"), F.col("y._order").alias("ord"), F.col("y._ref").alias("ref"), *[box[k].alias(c) for k, c in enumerate("ltrb")], F.col("y.text").alias("text"))


def merge_sizes(old: DataFrame, new: DataFrame) -> DataFrame:
    from pagewright.operators.flow import merge_maps

    return merge_maps(old, new, ["doc_id", "page_index"], ["width", "height"])


def page_xml(layouts: DataFrame) -> DataFrame:
    """doc_id, page_index, xml of layout rows (doc_id, page_index, section, ord, ref, l, t, r, b, text), as read_page_xml() reads it.

    Rows of a page stand in the order of section and ord; an order with gaps fails, as it could not be read back.
    """
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    box = F.concat_ws(",", *[F.col(c).cast("string") for c in "ltrb"])
    line = F.format_string('<layout ref="%s" order="%d" section="%s" det="%s"><text>%s</text></layout>', escape(F.col("ref")), F.col("ord").cast("long"), "section", box, escape(F.coalesce("text", F.lit(""))))
    rows = layouts.groupBy("doc_id", "page_index", "section").agg(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))).alias("x"))
    dense = F.forall(F.zip_with(F.col("x.ord"), F.sequence(F.lit(0), F.size("x") - 1), lambda a, b: a == b), lambda same: same)
    rows = rows.withColumn("x", F.when(dense, F.col("x")).otherwise(F.raise_error(F.lit("the order of a page has gaps"))))
    pages = rows.groupBy("doc_id", "page_index").agg(F.sort_array(F.collect_list(F.struct("section", F.array_join("x.line", "").alias("lines")))).alias("s"))
    return pages.select("doc_id", "page_index", F.concat(F.format_string('<page index="%d">', F.col("page_index").cast("long")), F.array_join("s.lines", ""), F.lit("</page>")).alias("xml"))
