"""Queries of checks, answer validation and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.operators import checks
from pagewright.session import table
from pagewright.sources.books import LAYOUTS_SQL, layouts


def letters(spark, d):
    """contents-level answers with letter ids."""
    cases = ['RESULT: {"A": 1, "B": 2}', '{"A": 0, "B": 5}', '{"A": -1, "B": 0}', '{"A": 0}', '{"A": 0, "B": 1, "C": 1}', '{"A": 7, "B": 1}', "none"]
    text = F.element_at(F.array(*map(F.lit, cases)), (F.col("doc_id") % 7 + 1).cast("int"))
    levels, error = checks.contents_levels_answer(text, F.array(F.lit("A"), F.lit("B")))
    return table(spark, d, "documents").select("doc_id", F.array_join(levels.cast("array<string>"), ",").alias("levels"), error.alias("error"))


def feedback(spark, d):
    """feedback lines."""
    return table(spark, d, "documents").select("doc_id", checks.error_text(F.lit("block"), F.concat(F.lit("p#"), F.col("doc_id").cast("string")), F.col("text")).alias("line"))


def children(spark, d):
    """Children matched by id, then by place within the tag."""
    rows = layouts(spark, d)
    want = rows.select("book", "page_index", F.col("ord").alias("child"), F.when(F.col("ord") % 2 == 0, "a").otherwise("b").alias("tag"), F.when(F.col("ord") % 3 == 0, F.col("ord")).alias("id"))
    got = rows.select("book", "page_index", (-F.col("ord")).alias("found"), F.when(F.col("ord") % 2 == 0, "a").otherwise("b").alias("tag"), F.when(F.col("ord") % 2 == 0, F.col("ord")).alias("id"))
    return checks.match_children(want, got, ["book", "page_index"])


def links(spark, d):
    """Image links of Markdown that no file answers."""
    docs = table(spark, d, "documents").select(F.expr("doc_id div 50").alias("book"), "doc_id")
    text = docs.groupBy("book").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda i: F.concat(F.lit("![x](.\\a\\"), i.cast("string"), F.lit(".png)"))), " ").alias("markdown"))
    files = docs.where("doc_id % 4 <> 0").select("book", F.concat(F.lit("a/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("name"))
    return checks.links_resolve(text, files)


def fits(spark, d):
    """The largest type size at which a text fits a box."""
    area = (F.col("n_chars") % 400 + 100).cast("double")
    size = checks.largest_fit(F.lit(4.0), F.lit(24.0), lambda s: s * s * (F.col("n_chars") % 37 + 1) <= area)
    return table(spark, d, "documents").select("doc_id", size.alias("size"))


def unknown(spark, d):
    """Sources that labels lack among even ones, errors that may pass."""
    docs = table(spark, d, "documents")
    return checks.unknown(docs.select("source"), docs.where("lang = 'en'").select("source"), "source")


QUERIES = {"toc_level_answers": letters, "error_feedback": feedback, "inline_child_match": children, "markdown_link_check": links, "largest_fit": fits, "unknown_assets": unknown}
ORACLE_SQL = {
    "toc_level_answers": """SELECT doc_id, list_value('0,1', '0,3', NULL, NULL, NULL, NULL, NULL)[doc_id % 7 + 1] AS levels, list_value(NULL, NULL, 'not an integer', 'missing ids', 'unexpected ids', 'out of range', 'no result')[doc_id % 7 + 1] AS error FROM documents""",
    "error_feedback": """WITH x AS (SELECT doc_id, text AS h FROM documents) SELECT doc_id, '[block] p#' || doc_id || ' near ''' || CASE WHEN length(h) > 30 THEN substr(h, 1, 27) || '...' ELSE h END || '''' AS line FROM x""",
    "inline_child_match": f"""WITH {LAYOUTS_SQL}, w AS (SELECT book, page_index, ord AS child, ord % 2 AS tag, CASE WHEN ord % 3 = 0 THEN ord END AS id FROM layouts),
        g AS (SELECT book, page_index, -ord AS found, ord % 2 AS tag, CASE WHEN ord % 2 = 0 THEN ord END AS id FROM layouts),
        f AS (SELECT w.book, w.page_index, child, found FROM w JOIN g ON w.book = g.book AND w.page_index = g.page_index AND w.tag = g.tag AND w.id = g.id),
        l AS (SELECT *, row_number() OVER (PARTITION BY book, page_index, tag ORDER BY child) AS n FROM w WHERE (book, page_index, child) NOT IN (SELECT (book, page_index, child) FROM f)),
        r AS (SELECT *, row_number() OVER (PARTITION BY book, page_index, tag ORDER BY found) AS n FROM g WHERE (book, page_index, found) NOT IN (SELECT (book, page_index, found) FROM f))
        SELECT * FROM f UNION ALL SELECT l.book, l.page_index, l.child, r.found FROM l JOIN r ON l.book = r.book AND l.page_index = r.page_index AND l.tag = r.tag AND l.n = r.n""",
    "markdown_link_check": "SELECT doc_id // 50 AS book, 'a/' || doc_id || '.png' AS target FROM documents WHERE doc_id % 4 = 0",
    "largest_fit": """SELECT doc_id, (SELECT max(q / 4.0) FROM range(16, 97) t(q) WHERE q / 4.0 * (q / 4.0) * (n_chars % 37 + 1) <= n_chars % 400 + 100) AS size FROM documents""",
    "unknown_assets": "SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'en')",
}
