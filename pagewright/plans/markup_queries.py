"""Queries of XML segments and translation, over documents wrapped in a little XHTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import markup, text as T
from pagewright.operators import translate
from pagewright.session import table
from pagewright.sources.books import LAYOUTS_SQL, layouts


def _xhtml(spark, d):
    text = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    xml = F.concat(F.lit('<div id="d"><h1 id="d">'), F.col("source"), F.lit("</h1><p>"), text, F.lit("<b>bold</b>"), text, F.lit(" &nbsp;</p></div>"))
    return table(spark, d, "documents").select("doc_id", xml.alias("xml"))


def segmented(spark, d):
    """Text segments with their paths."""
    rows = translate.segment_rows(_xhtml(spark, d), "doc_id", "xml")
    return rows.select("doc_id", "seg", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), F.col("block").cast("long").alias("block"), "tail", F.md5(F.btrim("text", F.lit(" "))).alias("digest"))


def _shout():
    return lambda texts: [f"<{t.strip()}>" for t in texts]


def replaced(spark, d):
    """Documents translated in place."""
    return translate.translate_documents(_xhtml(spark, d), "doc_id", "xml", _shout).select("doc_id", F.md5("xml").alias("digest"))


def appended(spark, d):
    """Q11: translated blocks after the originals."""
    return translate.translate_documents(_xhtml(spark, d), "doc_id", "xml", _shout, markup.APPEND_BLOCK).select("doc_id", F.md5("xml").alias("digest"))


def cached(spark, d):
    """requests with the same key, and whether their messages are the same: one row for each key."""
    rows = table(spark, d, "conversations").where("role IS NOT NULL AND text IS NOT NULL")
    key = translate.cache_key("m", "u", F.array(F.col("role"), F.col("text")), 0.5, 0.9)
    found = rows.withColumn("k", key).groupBy("k").agg(F.count("*").alias("n"), F.min(F.struct("conv_id", "turn")).alias("first"), F.max(F.md5(F.concat_ws("|", "role", "text"))).alias("digest"), F.max(F.length("k")).alias("key_chars"))
    return found.select("first.*", "n", "digest", F.col("key_chars").cast("long").alias("key_chars"))


_WANT = '<xml><p id="1">{0}<b id="2">{1}</b><b id="3">x</b><i>y</i></p><h2 id="4">{1}</h2></xml>'
#: Answers to the template, and the faults that each has, worst first: kind and block.
_ANSWERS = (
    (_WANT, ""),
    ('<xml><p id="1">{0}<b id="2">{1}</b><b id="3">x</b><i>y</i></p></xml>', "block lost 4"),
    (_WANT.replace("h2", "h3"), "block tag 4"),
    (_WANT.replace('<h2 id="4">', '<h2 id="four">'), "block lost 4;block id 0"),
    (_WANT.replace("</xml>", '<p id="9">{0}</p></xml>'), "block unexpected 0"),
    (_WANT.replace('<b id="3">x</b>', ""), "inline lost 1"),
    (_WANT.replace('<b id="3">', "<b>"), "inline lost 1;inline without id 1"),
    (_WANT.replace("<i>", '<i id="k">'), "inline id 1"),
    (_WANT.replace("<i>y</i>", "<i>y</i><i>{0}</i>"), "inline count 1"),
    (_WANT.replace("<i>", '<i id="7">'), "inline unexpected 1"),
    (_WANT.replace("xml>", "doc>"), "block tag 0"),
)


def faulty(spark, d):
    """Every kind of fault of an answer against its template, over the lines of all documents."""
    text = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    put = lambda form: F.replace(F.replace(form, F.lit("{0}"), text), F.lit("{1}"), F.col("page_index").cast("string"))
    rows = layouts(spark, d)
    answer = F.element_at(F.array(*[F.lit(a) for a, _ in _ANSWERS]), (F.col("ord") % len(_ANSWERS) + 1).cast("int"))  # only the one of the row is filled in
    found = F.sort_array(F.transform(translate.fault_column(put(F.lit(_WANT)), put(answer)), lambda f: F.struct((-f["level"]).alias("w"), f["kind"].alias("kind"), f["block"].alias("block"))))
    return rows.select("book", "page_index", "ord", F.array_join(F.transform(found, lambda f: F.concat_ws(" ", f["kind"], f["block"].cast("string"))), ";").alias("faults"))


QUERIES = {"structure_faults": faulty, "html_text_segments": segmented, "xml_translate_replace": replaced, "xml_translate_append": appended, "llm_cache_keys": cached}
# a segment as the translator gives it back: blank segments are none, white space is squeezed
_SQUEEZED = f"SELECT doc_id, source, text, regexp_replace(text, '[{T.SPACE}]+', ' ', 'g') AS x FROM documents WHERE text IS NOT NULL AND source IS NOT NULL"
_ESCAPE = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_SAID = f"'&lt;' || {_ESCAPE.format("trim(x, ' ')")} || '&gt;'"
ORACLE_SQL = {
    "structure_faults": f"WITH {LAYOUTS_SQL} SELECT book, page_index, ord, list_value({', '.join(repr(w) for _, w in _ANSWERS)})[ord % {len(_ANSWERS)} + 1] AS faults FROM layouts",
    "html_text_segments": f"""WITH x AS ({_SQUEEZED}), s AS (SELECT doc_id, 0 AS k, '0' AS path, false AS tail, source AS t FROM x UNION ALL SELECT doc_id, 1, '1', false, x FROM x UNION ALL SELECT doc_id, 2, '1/0', false, 'bold' FROM x UNION ALL SELECT doc_id, 3, '1/0', true, x || ' ' FROM x)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS seg, path, CAST(2 AS BIGINT) AS block, tail, md5(trim(t, ' ')) AS digest FROM s WHERE trim(t, ' ') <> ''""",
    "xml_translate_replace": f"""WITH x AS ({_SQUEEZED}), y AS (SELECT *, trim(x, ' ') = '' AS blank, {_SAID} AS said, {_ESCAPE.format("text")} AS own FROM x)
        SELECT doc_id, md5('<div id="d"><h1 id="d__translated">&lt;' || source || '&gt;</h1><p>' || CASE WHEN blank THEN own ELSE said END || '<b>&lt;bold&gt;</b>' || CASE WHEN blank THEN own || ' ' || chr(160) ELSE said END || '</p></div>') AS digest FROM y""",
    "xml_translate_append": f"""WITH x AS ({_SQUEEZED}), y AS (SELECT *, trim(x, ' ') = '' AS blank, {_SAID} AS said, {_ESCAPE.format("text")} AS own FROM x)
        SELECT doc_id, md5('<div id="d"><h1 id="d__translated">' || source || '</h1><h1 id="d__translated_2">&lt;' || source || '&gt;</h1><p>' || own || '<b>bold</b>' || own || ' ' || chr(160) || '</p><p>' || CASE WHEN blank THEN own ELSE said END || '<b>&lt;bold&gt;</b>' || CASE WHEN blank THEN own || ' ' || chr(160) ELSE said END || '</p></div>') AS digest FROM y""",
    "llm_cache_keys": """SELECT min((conv_id, turn))[1] AS conv_id, min((conv_id, turn))[2] AS turn, count(*) AS n, md5(role || '|' || text) AS digest, CAST(128 AS BIGINT) AS key_chars FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL GROUP BY role, text""",
}
