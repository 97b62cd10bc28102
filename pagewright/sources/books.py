"""Page and layout tables: read from Parquet, or derived from the sample documents.

A sample book is 50 documents with neighbouring ids, one page each, so a book stays small whatever the input. The
lines of a document are its layout rows; page 1 of each book is a contents page with all titles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.session import table

PAGES_PER_BOOK = 50

#: DuckDB twin of layouts(), for oracles.
LAYOUTS_SQL = """
lines AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
flat AS (SELECT doc_id, len(lines) AS n_lines, unnest(lines) AS text, unnest(range(len(lines))) AS ord FROM lines),
layouts AS (SELECT doc_id // 50 AS book, doc_id % 50 + 2 AS page_index, ord, CASE WHEN ord = 0 THEN 'sub_title' ELSE 'text' END AS ref,
  100 + 450 * CAST(2 * ord >= n_lines AS BIGINT) AS l, 100 + 60 * ord AS t, 500 + 450 * CAST(2 * ord >= n_lines AS BIGINT) AS r,
  100 + 60 * ord + CASE WHEN ord = 0 THEN 30 + 15 * (doc_id % 4) ELSE 20 + 10 * (length(text) % 4) END AS b, text, doc_id FROM flat),
titles AS (SELECT book, page_index, text AS title, b - t AS height FROM layouts WHERE ord = 0)"""


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout rows: book, page_index, ord, ref, l, t, r, b, text, doc_id."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    flat = docs.select("doc_id", F.size("lines").cast("long").alias("n"), F.posexplode("lines").alias("ord", "text")).withColumn("ord", F.col("ord").cast("long"))
    column = F.when(2 * F.col("ord") >= F.col("n"), 1).otherwise(0).cast("long")
    top = 100 + 60 * F.col("ord")
    height = F.when(F.col("ord") == 0, 30 + 15 * (F.col("doc_id") % 4)).otherwise(20 + 10 * (F.length("text") % 4)).cast("long")
    return flat.select(
        F.expr(f"doc_id div {PAGES_PER_BOOK}").alias("book"),
        (F.col("doc_id") % PAGES_PER_BOOK + 2).alias("page_index"),
        "ord",
        F.when(F.col("ord") == 0, "sub_title").otherwise("text").alias("ref"),
        (100 + 450 * column).alias("l"),
        top.alias("t"),
        (500 + 450 * column).alias("r"),
        (top + height).alias("b"),
        "text",
        "doc_id",
    )


def titles(rows: DataFrame) -> DataFrame:
    """book, page_index, title, height of every page that has a title."""
    return rows.where("ord = 0").select("book", "page_index", F.col("text").alias("title"), (F.col("b") - F.col("t")).alias("height"))


def bodies(rows: DataFrame) -> DataFrame:
    """book, page_index, body: pages with their text, and the contents page of each book."""
    pages = rows.groupBy("book", "page_index").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("x"))
    pages = pages.select("book", "page_index", F.array_join(F.col("x.text"), " ").alias("body"))
    contents = titles(rows).groupBy("book").agg(F.sort_array(F.collect_list(F.struct("page_index", "title"))).alias("x"))
    return pages.union(contents.select("book", F.lit(1).cast("long").alias("page_index"), F.array_join(F.col("x.title"), " ").alias("body")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, page_index, titles, body of all pages, contents pages included; one scan and one shuffle by book."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND doc_id IS NOT NULL")
    page = F.struct((F.col("doc_id") % PAGES_PER_BOOK + 2).alias("page_index"), F.substring_index("text", "\n", 1).alias("title"), F.translate("text", "\n", " ").alias("body"))
    books = docs.groupBy(F.expr(f"doc_id div {PAGES_PER_BOOK}").alias("book")).agg(F.sort_array(F.collect_list(page)).alias("p"))
    contents = F.struct(F.lit(1).cast("long").alias("page_index"), F.lit(None).cast("string").alias("title"), F.array_join("p.title", " ").alias("body"))
    every = books.select("book", F.explode(F.concat(F.array(contents), "p")).alias("p"))
    return every.select("book", "p.page_index", F.array_compact(F.array("p.title")).alias("titles"), "p.body")
