"""Queries of contents pages, levels and clustering."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from pagewright.functions import text as T
from pagewright.operators import toc
from pagewright.operators.cluster import cluster, variation
from pagewright.session import table
from pagewright.sources.books import LAYOUTS_SQL, bodies, layouts, pages, titles

from .text_queries import sql_title_key


def detect(spark, d):
    """Q01 with P08, J06, G07, G08, T01, T02, W12: contents pages of each book."""
    found = toc.contents_pages(toc.page_scores(pages(spark, d)))
    return found.select("book", "page_index", F.round("score", 6).alias("score"))


def matched(spark, d):
    """Titles found on other pages, overlapping occurrences counted."""
    rows = layouts(spark, d)
    found = toc.title_matches(titles(rows), bodies(rows))
    return found.select("book", "page_index", F.col("key").alias("title_key"), "hits", F.size("refs").cast("long").alias("n_refs"))


def levels(spark, d):
    """G05 over G04: title levels by height."""
    rows = titles(layouts(spark, d)).withColumn("ord", F.lit(0).cast("long"))
    return toc.title_levels(rows).select("book", "page_index", "height", "level")


def _hooks(spark, d):
    """Lines of two contents pages per book, each mentioning one title."""
    rows = titles(layouts(spark, d))
    return rows.select("book", (F.col("page_index") % 2 + 1).alias("toc_page"), F.col("page_index").alias("toc_ord"), (20 + 15 * (F.col("page_index") % 3)).alias("height"), "page_index", F.lit(0).cast("long").alias("ord"))


def contents_levels(spark, d):
    """Q02 with G09: levels of titles by the contents pages."""
    own = toc.title_levels(titles(layouts(spark, d)).withColumn("ord", F.lit(0).cast("long")))
    return toc.contents_levels(_hooks(spark, d), own)


def _leveled(spark, d):
    rows = titles(layouts(spark, d))
    return rows.select("book", "page_index", F.lit(0).cast("long").alias("ord"), ((F.col("page_index") * 7) % 4).alias("level"))


def toc_tree(spark, d):
    """Parents of titles."""
    return toc.tree(_leveled(spark, d)).select("book", "id", "parent_id", "level")


def toc_preorder(spark, d):
    """Walk through the tree, with paths."""
    return toc.preorder(toc.tree(_leveled(spark, d))).select("book", "id", "place", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def clustered(spark, d):
    """Document lengths in at most four groups."""
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL AND n_chars IS NOT NULL").select(F.expr("doc_id div 50").alias("book"), "doc_id", "n_chars")
    return cluster(docs, ["book"], "n_chars", 0.025, 4).withColumnRenamed("group", "size_group")


def heading_levels(spark, d):
    """Levels of headings inside a chapter by median block height; the first heading is 0, others from 1."""
    rows = layouts(spark, d).select("book", F.expr("page_index div 10").alias("chapter"), "page_index", (F.col("b") - F.col("t")).alias("h"))
    tall = rows.groupBy("book", "chapter", "page_index").agg(F.percentile("h", 0.5).alias("height"))
    first = F.min("page_index").over(Window.partitionBy("book", "chapter"))
    tall = tall.withColumn("first", first)
    rest = cluster(tall.where("page_index <> first"), ["book", "chapter"], "height", 0.025, 5, "up")
    rest = rest.withColumn("level", F.max("up").over(Window.partitionBy("book", "chapter")) - F.col("up") + 1)
    return rest.select("book", "chapter", "page_index", "level").union(tall.where("page_index = first").select("book", "chapter", "page_index", F.lit(0).cast("long")))


def statistics(spark, d):
    """Mean, median, variation, and whether all values are the same."""
    docs = table(spark, d, "documents").select(F.expr("doc_id div 50").alias("book"), "n_chars", "lang")
    n, mean, dev = F.count("n_chars"), F.avg("n_chars"), F.stddev_pop("n_chars")
    return docs.groupBy("book").agg(F.round(mean, 4).alias("mean"), F.percentile("n_chars", 0.5).alias("median"), F.round(variation(n, mean, dev), 6).alias("cv"), (F.count_distinct("lang") <= 1).alias("same_lang"))


QUERIES = {
    "toc_page_detect": detect,
    "toc_title_matches": matched,
    "toc_title_levels": levels,
    "toc_levels": contents_levels,
    "toc_tree": toc_tree,
    "toc_preorder": toc_preorder,
    "cv_cluster_levels": clustered,
    "chapter_heading_levels": heading_levels,
    "size_statistics": statistics,
}


def cluster_sql(source: str, keys: str, size: str, max_cv: float, max_groups: int, name: str) -> str:
    """DuckDB twin of cluster(), as common table expressions that end in `name` with a column grp."""
    parts = [f"{name}_0 AS (SELECT *, CAST(0 AS BIGINT) AS _g FROM {source})"]
    for k in range(max_groups - 1):
        parts.append(f"""{name}_s{k} AS (SELECT *, CASE WHEN count(*) OVER w > 2 THEN CASE WHEN avg({size}) OVER w = 0 THEN CAST('inf' AS DOUBLE) ELSE stddev_pop({size}) OVER w / avg({size}) OVER w END ELSE -1 END AS _cv,
            lead({size}) OVER (PARTITION BY {keys}, _g ORDER BY {size}) - {size} AS _gap FROM {name}_{k} WINDOW w AS (PARTITION BY {keys}, _g))""")
        parts.append(f"""{name}_t{k} AS (SELECT *, first_value(_g) OVER (PARTITION BY {keys} ORDER BY _cv DESC, _g) AS _best, max(_cv) OVER (PARTITION BY {keys}) AS _top,
            first_value({size}) OVER (PARTITION BY {keys}, _g ORDER BY coalesce(_gap, -1) DESC, {size}) AS _cut FROM {name}_s{k})""")
        parts.append(f"{name}_{k + 1} AS (SELECT * EXCLUDE (_cv, _gap, _best, _top, _cut, _g), _g * 2 + CASE WHEN _top > {max_cv} AND _g = _best AND {size} > _cut THEN 1 ELSE 0 END AS _g FROM {name}_t{k})")
    parts.append(f"{name} AS (SELECT * EXCLUDE (_g), dense_rank() OVER (PARTITION BY {keys} ORDER BY _g) - 1 AS grp FROM {name}_{max_groups - 1})")
    return ", ".join(parts)


_MATCHES = f"""{LAYOUTS_SQL},
keys AS (SELECT book, page_index, k AS key FROM (SELECT book, page_index, {sql_title_key("title")} AS k FROM titles) WHERE length(k) >= CASE WHEN regexp_matches(k, '[{T.LATIN}]') THEN 6 ELSE 3 END),
own AS (SELECT book, key, list(page_index) AS pages FROM keys GROUP BY ALL),
bodies AS (SELECT book, page_index, string_agg(text, ' ' ORDER BY ord) AS body FROM layouts GROUP BY ALL UNION ALL SELECT book, 1, string_agg(title, ' ' ORDER BY page_index) FROM titles GROUP BY ALL),
pages AS (SELECT book, page_index, {sql_title_key("body")} AS body FROM bodies),
met AS (SELECT book, page_index, key, list_filter(o.pages, lambda q: q <> p.page_index) AS refs, substr(body, instr(body, key) + 1) AS rest FROM pages p JOIN own o USING (book) WHERE contains(body, key)),
found AS (SELECT book, page_index, key, refs, rest, 1 AS n FROM met UNION ALL SELECT book, page_index, key, refs, substr(rest, instr(rest, key) + 1), n + 1 FROM found WHERE contains(rest, key)),
matches AS (SELECT book, page_index, key, any_value(refs) AS refs, max(n) AS hits FROM found GROUP BY book, page_index, key)"""
_TITLES0 = "t0 AS (SELECT *, CAST(0 AS BIGINT) AS ord FROM titles)"
_LEVELED = f"WITH RECURSIVE {LAYOUTS_SQL}, x AS (SELECT book, page_index, page_index * 7 % 4 AS level, row_number() OVER (PARTITION BY book ORDER BY page_index) AS id FROM titles), nodes AS (SELECT a.book, a.id, a.level, coalesce((SELECT max(b.id) FROM x b WHERE b.book = a.book AND b.id < a.id AND b.level < a.level), 0) AS parent_id FROM x a)"

ORACLE_SQL = {
    "toc_page_detect": f"""WITH RECURSIVE {_MATCHES},
        scores AS (SELECT p.book, p.page_index, coalesce(round(s.score, 6), 0) AS score FROM bodies p LEFT JOIN (SELECT book, page_index, sum(hits / len(refs)) AS score FROM matches WHERE len(refs) > 0 GROUP BY ALL) s USING (book, page_index)),
        a AS (SELECT *, row_number() OVER w AS rank, count(*) OVER (PARTITION BY book) AS total, round(score - lead(score) OVER w, 6) AS drp FROM scores WINDOW w AS (PARTITION BY book ORDER BY score DESC, page_index)),
        c AS (SELECT book, arg_max(rank, (drp, -rank)) AS cut FROM a WHERE drp > 0 GROUP BY book),
        r AS (SELECT a.book, score AS rest FROM a JOIN c ON a.book = c.book AND a.rank = c.cut + 1),
        k AS (SELECT a.*, coalesce(rest, 0) AS rest, row_number() OVER (PARTITION BY a.book ORDER BY page_index) AS place FROM a JOIN c USING (book) LEFT JOIN r USING (book) WHERE rank <= cut AND page_index <= round_even(total * 0.18, 0)),
        m AS (SELECT *, page_index - place AS run, first_value(page_index - place) OVER w AS first_run, first_value(score) OVER w AS first_score FROM k WHERE place <= greatest(3, floor(total * 0.1)) WINDOW w AS (PARTITION BY book ORDER BY page_index)),
        n AS (SELECT *, greatest(rest, coalesce(max(CASE WHEN run <> first_run THEN score END) OVER (PARTITION BY book), 0)) AS content FROM m)
        SELECT book, page_index, round(score, 6) AS score FROM n WHERE run = first_run AND first_score >= 3 * content""",
    "toc_title_matches": f"WITH RECURSIVE {_MATCHES} SELECT book, page_index, key AS title_key, CAST(hits AS BIGINT) AS hits, CAST(len(refs) AS BIGINT) AS n_refs FROM matches WHERE len(refs) > 0",
    "toc_title_levels": f"WITH {LAYOUTS_SQL}, {cluster_sql('titles', 'book', 'height', 0.025, 4, 'c')} SELECT book, page_index, height, max(grp) OVER (PARTITION BY book) - grp AS level FROM c",
    "toc_levels": f"""WITH {LAYOUTS_SQL}, {cluster_sql('titles', 'book', 'height', 0.025, 4, 'c')}, own AS (SELECT book, page_index, max(grp) OVER (PARTITION BY book) - grp AS level FROM c),
        hooks AS (SELECT book, page_index % 2 + 1 AS toc_page, page_index AS toc_ord, 20 + 15 * (page_index % 3) AS hh, page_index FROM titles), {cluster_sql('hooks', 'book, toc_page', 'hh', 0.75, 4, 'h')},
        rel AS (SELECT book, toc_page, page_index, max(grp) OVER (PARTITION BY book, toc_page) - grp AS relative FROM h),
        j AS (SELECT rel.*, level, row_number() OVER (PARTITION BY book, toc_page ORDER BY relative, page_index) AS n FROM rel LEFT JOIN own USING (book, page_index)),
        means AS (SELECT book, toc_page, CAST(level AS DOUBLE) AS mean FROM j WHERE n = 1 AND level IS NOT NULL), {cluster_sql('means', 'book', 'mean', 0.75, 4, 'o')}
        SELECT book, page_index, CAST(0 AS BIGINT) AS ord, relative + o.grp AS level FROM j JOIN o USING (book, toc_page)""",
    "toc_tree": f"{_LEVELED} SELECT book, id, parent_id, level FROM nodes",
    "toc_preorder": f"""{_LEVELED}, walk AS (SELECT book, id, [id] AS path FROM nodes WHERE parent_id = 0 UNION ALL SELECT n.book, n.id, list_append(w.path, n.id) FROM nodes n JOIN walk w ON n.book = w.book AND n.parent_id = w.id)
        SELECT book, id, row_number() OVER (PARTITION BY book ORDER BY path) AS place, array_to_string(path, '/') AS path FROM walk""",
    "cv_cluster_levels": f"WITH docs AS (SELECT doc_id // 50 AS book, doc_id, n_chars FROM documents WHERE doc_id IS NOT NULL AND n_chars IS NOT NULL), {cluster_sql('docs', 'book', 'n_chars', 0.025, 4, 'c')} SELECT book, doc_id, n_chars, grp AS size_group FROM c",
    "chapter_heading_levels": f"""WITH {LAYOUTS_SQL}, tall AS (SELECT book, page_index // 10 AS chapter, page_index, median(b - t) AS height FROM layouts GROUP BY ALL),
        f AS (SELECT *, min(page_index) OVER (PARTITION BY book, chapter) AS fst FROM tall), rest AS (SELECT * FROM f WHERE page_index <> fst), {cluster_sql('rest', 'book, chapter', 'height', 0.025, 5, 'c')}
        SELECT book, chapter, page_index, max(grp) OVER (PARTITION BY book, chapter) - grp + 1 AS level FROM c UNION ALL SELECT book, chapter, page_index, 0 FROM f WHERE page_index = fst""",
    "size_statistics": """SELECT doc_id // 50 AS book, round(avg(n_chars), 4) AS mean, median(n_chars) AS median, round(CASE WHEN count(n_chars) < 2 THEN 0 WHEN avg(n_chars) = 0 THEN CAST('inf' AS DOUBLE) ELSE stddev_pop(n_chars) / avg(n_chars) END, 6) AS cv,
        count(DISTINCT lang) <= 1 AS same_lang FROM documents GROUP BY 1""",
}
