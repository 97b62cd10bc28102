"""Queries of the Arrow-batched parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import parsers as X, text as T
from pagewright.session import table


def degenerate(spark, d):
    """Documents whose text runs into a loop."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.where(X.degenerate_column(F.col("text"))).select("doc_id")


def latex(spark, d):
    """LaTeX tokens of documents with dollar signs: how many, the first leaf, the first expression."""
    docs = table(spark, d, "documents").where("contains(text, '$')").select("doc_id", X.latex_column(F.col("text")).alias("t"))
    first = F.try_element_at(F.filter("t", lambda x: x["kind"] != "text"), F.lit(1))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.element_at("t", 1)["content"]).alias("first_leaf"), first["content"].alias("expression"))


def round_trip(spark, d):
    """escaped texts read as tokens give the text again, and as Markdown the escaped text, by digest."""
    escaped = T.escape_markdown(F.col("text"))
    back = X.arrow(lambda t: None if t is None else "".join(c for _, c in X.latex_tokens(t)), "string")
    again = X.arrow(lambda t: None if t is None else X.latex_markdown(X.latex_tokens(t)), "string")
    return table(spark, d, "documents").select("doc_id", F.md5(back(escaped)).alias("plain"), F.md5(again(escaped)).alias("markdown"))


def sanitized(spark, d):
    """tokens of sanitised pages."""
    pages = table(spark, d, "pages").select("page_id", F.posexplode(X.html_column(F.col("html"))).alias("place", "t"))
    return pages.select("page_id", "place", "t.depth", "t.kind", "t.tag", F.length("t.text").alias("n_chars"))


def policy(spark, d):
    """how many tags of each name the pages hold, and what the policy does with them."""
    found = table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(r"<([a-zA-Z][a-zA-Z0-9-]*)"))).alias("tag")).select(F.lower("tag").alias("tag"))
    act = F.when(F.col("tag").isin(*sorted(X.FILTERED_TAGS)), "filter").when(F.col("tag").isin(*sorted(X.DISSOLVED_TAGS)), "dissolve").when(F.col("tag").isin(*sorted(X.ALLOWED_TAGS)), "allow").otherwise("escape")
    return found.groupBy("tag").agg(F.count("*").alias("n")).withColumn("action", act)


def tables(spark, d):
    """plain tables to pipe tables, merged ones left alone; a cell holds the whole text."""
    body = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cell = F.element_at(F.array(F.lit("<td>"), F.lit("<td colspan='2'>"), F.lit('<td rowspan="1">'), F.lit("<td colspan=x>")), (F.col("doc_id") % 4 + 1).cast("int"))
    html = F.concat(F.lit("<table><tr><th>a</th><th>b</th></tr><tr>"), cell, F.col("source"), F.lit("</td><td>"), body, F.lit("</td></tr></table>"))
    return table(spark, d, "documents").select("doc_id", F.md5(X.arrow(X.table_markdown, "string")(html)).alias("digest"))


def entities(spark, d):
    """Named entities as numbers, by digest."""
    return table(spark, d, "pages").select("page_id", F.md5(X.arrow(X.numeric_entities, "string")(F.col("html"))).alias("digest"))


QUERIES = {"degenerate_ngram_filter": degenerate, "latex_tokens": latex, "latex_roundtrip": round_trip, "html_sanitize_tokens": sanitized, "html_tag_policy": policy, "html_table_gfm": tables, "entity_numbers": entities}


def _quoted(names: frozenset[str]) -> str:
    return ", ".join(f"'{n}'" for n in sorted(names))


ORACLE_SQL = {
    "degenerate_ngram_filter": """WITH c AS (SELECT doc_id, string_split(text, '') AS c, length(text) AS n FROM documents WHERE text IS NOT NULL),
        r AS (SELECT doc_id, c, n, unnest(range(2, 21)) AS k FROM c), e AS (SELECT doc_id, k, CASE WHEN k <= 5 THEN 16 ELSE 8 END AS times, array_to_string(list_transform(range(1, n - k + 1), lambda i: CASE WHEN c[i] = c[i + k] THEN '1' ELSE '0' END), '') AS s FROM r WHERE n > k)
        SELECT DISTINCT doc_id FROM e WHERE contains(s, repeat('1', CAST(k * (times - 1) AS INT)))""",
    "latex_roundtrip": r"SELECT doc_id, md5(text) AS plain, md5(replace(replace(text, '\', '\\'), '$', '\$')) AS markdown FROM documents",
    "latex_tokens": r"""WITH x AS (SELECT doc_id, regexp_extract_all(text, '\$\$(?s:.*?)\$\$|\$[^\n$]*\$') AS m, list_filter(regexp_split_to_array(text, '\$\$(?s:.*?)\$\$|\$[^\n$]*\$'), lambda p: p <> '') AS p, regexp_matches(text, '^(\$\$(?s:.*?)\$\$|\$[^\n$]*\$)') AS first FROM documents WHERE contains(text, '$')),
        y AS (SELECT *, CASE WHEN len(m) > 0 THEN CASE WHEN starts_with(m[1], '$$') AND length(m[1]) >= 4 THEN substr(m[1], 3, length(m[1]) - 4) ELSE substr(m[1], 2, length(m[1]) - 2) END END AS e FROM x)
        SELECT doc_id, CAST(len(m) + len(p) AS BIGINT) AS n_tokens, md5(CASE WHEN first THEN e ELSE p[1] END) AS first_leaf, e AS expression FROM y""",
    "html_tag_policy": f"""WITH t AS (SELECT lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9-]*)', 1))) AS tag FROM pages)
        SELECT tag, count(*) AS n, CASE WHEN tag IN ({_quoted(X.FILTERED_TAGS)}) THEN 'filter' WHEN tag IN ({_quoted(X.DISSOLVED_TAGS)}) THEN 'dissolve' WHEN tag IN ({_quoted(X.ALLOWED_TAGS)}) THEN 'allow' ELSE 'escape' END AS action FROM t GROUP BY tag""",
    "html_table_gfm": f"""WITH x AS (SELECT doc_id, source, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS body, replace(trim(regexp_replace(text, '[{T.SPACE}]+', ' ', 'g'), ' '), '|', '\\|') AS cell FROM documents)
        SELECT doc_id, md5(CASE WHEN doc_id % 4 IN (1, 3) THEN '<table><tr><th>a</th><th>b</th></tr><tr>' || CASE WHEN doc_id % 4 = 1 THEN '<td colspan=''2''>' ELSE '<td colspan=x>' END || source || '</td><td>' || body || '</td></tr></table>'
        ELSE '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || source || ' | ' || cell || ' |' END) AS digest FROM x""",
    "entity_numbers": """SELECT page_id, md5(replace(replace(html, '&copy;', '&#169;'), '&middot;', '&#183;')) AS digest FROM pages""",
}
