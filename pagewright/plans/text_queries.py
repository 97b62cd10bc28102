"""Queries of row-level text and geometry rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.functions import answers as A, text as T
from pagewright.session import table
from pagewright.sources.books import LAYOUTS_SQL, layouts

_RE2_SPACE = T.SPACE
_FOLD = T.latin_fold()


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{_RE2_SPACE}]+', ' ', 'g'), ' ')"


def sql_title_key(x: str) -> str:
    kept = f"'([{T.LATIN}]) ([{T.LATIN}])', '\\1' || chr(1) || '\\2', 'g'"
    inner = f"regexp_replace(regexp_replace({_sql_collapse(x)}, {kept}), {kept})"
    return f"translate(regexp_replace(replace(replace({inner}, ' ', ''), chr(1), ' '), '[\\p{{P}}\\^`|~]', '', 'g'), '{_FOLD[0]}', '{_FOLD[1]}')"


def title_keys(spark, d):
    """Canonical text of every line, as of a title."""
    return layouts(spark, d).select("doc_id", "ord", T.title_key(F.col("text")).alias("title_key"))


def collapsed(spark, d):
    """Collapsed text, by digest, and whether anything is left."""
    return _docs(spark, d).select("doc_id", F.md5(T.collapse(F.col("text"))).alias("digest"), T.blank_to_null(F.col("text")).isNull().alias("is_blank"))


def headings(spark, d):
    """Both heading rules on marked lines."""
    marked = F.concat(F.element_at(F.array(F.lit("## "), F.lit("#"), F.lit("  ### "), F.lit("")), ((F.col("doc_id") + F.col("ord")) % 4 + 1).cast("int")), F.col("text"))
    return layouts(spark, d).select("doc_id", "ord", T.strip_heading(marked).alias("chapter_title"), T.strip_contents_heading(marked).alias("contents_title"))


_HAN_ROWS = ["这是中文, 这是中文: 也是中文; 对吗? 当然!", "abc, 中文", "中文: abc", "中 , 文", "𠀀, a", "ok? 好 : 好", "！中;", ""]


def han_marks(spark, d):
    """P10: punctuation in Han context, on literal cases."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(_HAN_ROWS)], "id long, text string")
    return rows.select("id", T.widen_marks(F.col("text")).alias("text"))


def han_lines(spark, d):
    """P10: punctuation in Han context, where every mark of every line stands between Han letters."""
    text = F.regexp_replace("text", "[,;?!:]", "文$0 文")
    return layouts(spark, d).select("doc_id", "ord", T.widen_marks(text).alias("text"))


_HAN_WANT = ["这是中文， 这是中文： 也是中文； 对吗？ 当然！", "abc, 中文", "中文: abc", "中 ， 文", "𠀀， a", "ok? 好 ： 好", "！中；", ""]


def quotes(spark, d):
    """Quote unwrapping over quoted texts, by digest."""
    return _docs(spark, d).select("doc_id", F.md5(T.unwrap_quotes(F.concat(F.lit("«‹"), F.col("text"), F.lit("›» 《〈"), F.col("text"), F.lit("〉》")))).alias("digest"))


def letters(spark, d):
    """letter ids of document numbers."""
    return _docs(spark, d).select("doc_id", T.letter_id(F.col("doc_id") % 18_000).alias("letters"))


def urls(spark, d):
    """Which link targets are allowed, for page addresses in several spellings."""
    path = F.regexp_replace("url", r"^https?://[^/]*", "")
    spelled = F.element_at(F.array(F.col("url"), path, F.regexp_replace("url", "^https?://", ""), F.concat(F.lit("ftp:"), path)), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", spelled.alias("target"), T.allowed_url(spelled).alias("allowed"))


def boxes(spark, d):
    """Boxes clamped to a page of 700 by 900 pixels, and mapped to points with the y axis turned."""
    x = lambda c, top: F.greatest(F.lit(0), F.least(F.col(c), F.lit(top)))
    rows = layouts(spark, d).select("book", "page_index", "ord", x("l", 700).alias("l"), x("t", 900).alias("t"), x("r", 700).alias("r"), x("b", 900).alias("b"))
    rows = rows.where("l < r AND t < b")
    return rows.select("*", F.round(F.col("l") * 595.0 / 700, 4).alias("x_pt"), F.round(842.0 - F.col("b") * 842.0 / 900, 4).alias("y_pt"))


def dpi(spark, d):
    """The resolution that keeps a picture under a size in bytes."""
    w, h = 6 + F.col("doc_id") % 5, 8 + F.col("doc_id") % 7
    cap = F.bround(F.sqrt(F.lit(4_000_000.0) / (w * h * 3 * 0.5)), 0).cast("long")
    return _docs(spark, d).select("doc_id", F.least(F.lit(300).cast("long"), cap).alias("dpi"))


def mergeable_pairs(spark, d):
    """Whether neighbouring lines of a page belong together."""
    from pyspark.sql import Window

    w = Window.partitionBy("book", "page_index").orderBy("ord")
    rows = layouts(spark, d).withColumn("before", F.lag("text").over(w)).where("ord > 0")
    return rows.select("book", "page_index", "ord", T.mergeable(F.col("before"), F.col("text")).alias("mergeable"), F.coalesce(T.split_word(F.col("before"), F.col("text")), F.lit(False)).alias("split_word"))


def table_texts(spark, d):
    """F16: lines that read like table titles or table notes."""
    text = F.concat(F.element_at(F.array(F.lit("Table 1: "), F.lit("Note: "), F.lit(""), F.lit("Source. ")), (F.col("ord") % 4 + 1).cast("int")), F.col("text"))
    return layouts(spark, d).select("doc_id", "ord", T.table_title(text).alias("is_title"), T.table_caption(text).alias("is_caption"))


def metadata(spark, d):
    """Authors split at the first separator present, modification date, title or else the file's stem."""
    raw = F.concat(F.lit("A B"), F.element_at(F.array(F.lit(";"), F.lit(","), F.lit("&"), F.lit("; C, D")), (F.col("doc_id") % 4 + 1).cast("int")), F.lit(" E F"))
    sep = F.when(raw.contains(";"), ";").when(raw.contains(","), ",").when(raw.contains("&"), "&")
    authors = F.filter(F.transform(F.split(raw, sep), lambda a: F.trim(a)), lambda a: a != "")
    stamp = F.when(F.col("doc_id") % 3 == 0, "D:bad").otherwise(F.concat(F.lit("D:2024"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit("05101112+00'00'")))
    when = F.try_to_timestamp(F.substring(F.regexp_replace(stamp, "^D:", ""), 1, 14), F.lit("yyyyMMddHHmmss"))
    path = F.concat(F.lit("/books/"), F.col("source"), F.lit(".pdf"))
    title = F.coalesce(F.when(F.col("doc_id") % 2 == 0, F.col("text")), F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1))
    return _docs(spark, d).select("doc_id", F.array_join(authors, "|").alias("authors"), F.date_format(F.coalesce(when, F.lit("2000-01-01 00:00:00").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("modified"), title.alias("title"))


def kinds(spark, d):
    """Recognised kinds mapped to references, and a parent's text joined with its children's."""
    names = ["text", "title", "image", "image_caption", "table", "table_caption", "equation", "equation_caption", "footnote", "aside", "seal"]
    refs = ["text", "sub_title", "image", "image_caption", "table", "table_caption", "equation", "equation_caption", "text", "text", None]
    kind = F.element_at(F.array(*map(F.lit, names)), (F.col("ord") % 11 + 1).cast("int"))
    ref = F.create_map(*[F.lit(x) for k, r in zip(names, refs, strict=True) if r for x in (k, r)])[kind]
    third = F.expr("length(text) div 3")
    one, two, three = F.substr("text", F.lit(1), third), F.substr("text", third + 1, third), F.substr("text", third * 2 + 1)
    html = F.when(F.col("ord") % 5 == 0, F.concat(F.lit("<b>"), one, F.lit("</b>")))
    parts = F.array(F.coalesce(html, one), two, three)
    joined = F.array_join(F.filter(parts, lambda p: p != ""), "\n")
    return layouts(spark, d).select("book", "page_index", "ord", ref.alias("ref"), joined.alias("text")).where("ref IS NOT NULL")


def void_tags(spark, d):
    """Void elements closed, by digest of the page."""
    return table(spark, d, "pages").select("page_id", F.md5(T.close_void(F.col("html"))).alias("digest"))


def ramps(spark, d):
    """sampling parameters by try."""
    n = (F.col("doc_id") % 7).cast("long")
    return _docs(spark, d).select("doc_id", F.round(T.ramp(0.2, 0.8, n, 4), 6).alias("ramp"), F.round(T.halving(0.2, 1.0, n), 6).alias("halving"))


def answers(spark, d):
    """JSON bodies in answers, and refusals."""
    text = F.replace(F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    cases = [F.concat(F.lit('Here:\n```json\n{"a": "'), text, F.lit('"}\n``` [done]')), F.concat(F.lit("Sorry, "), F.col("text")), F.concat(F.lit('see [1, {"b": "]"}], {} '), F.col("text")), F.col("text")]
    turn = F.element_at(F.array(*cases), (F.col("turn") % 4 + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", A.json_body(turn).alias("body"), A.refusal(turn).alias("refused"))


def fonts(spark, d):
    """texts a basic font can show; names without namespace; ids that are whole numbers."""
    return _docs(spark, d).select("doc_id", T.latin1_only(F.col("text")).alias("latin1"), T.plain_tag(F.concat(F.lit("{http://x}"), F.col("lang"))).alias("tag"), F.expr("try_cast(substring_index(text, ' ', 1) AS INT)").isNotNull().alias("is_id"))


def escaped(spark, d):
    """text escaped for Markdown, and the wire codes of expression kinds, by digest."""
    code = F.element_at(F.array(F.lit("$"), F.lit("$$"), F.lit("\\("), F.lit("\\["), F.lit("text")), (F.col("doc_id") % 5 + 1).cast("int"))
    return _docs(spark, d).select("doc_id", F.md5(T.escape_markdown(F.col("text"))).alias("digest"), code.alias("code"))


QUERIES = {
    "text_normalize_title": title_keys,
    "text_collapse_ws": collapsed,
    "md_heading_strip": headings,
    "han_punctuation": han_marks,
    "han_punctuation_lines": han_lines,
    "quote_unwrap": quotes,
    "letter_ids": letters,
    "url_protocol": urls,
    "bbox_clamp": boxes,
    "dpi_cap": dpi,
    "mergeable_flag": mergeable_pairs,
    "table_text_tests": table_texts,
    "pdf_metadata": metadata,
    "layout_kind_map": kinds,
    "void_tag_fix": void_tags,
    "param_ramps": ramps,
    "json_answer": answers,
    "font_and_tag_tests": fonts,
    "markdown_escape": escaped,
}

_STOP = "".join(f"\\{c}" if c in "[]^-{}" else c for c in T.STOP_MARKS)
_CONT = "".join(f"\\{c}" if c in "[]^-{}" else c for c in T.CONTINUE_MARKS)
_VALUES = ", ".join(f"({i}, '{t}')" for i, t in enumerate(_HAN_WANT))
_VOID = "area|base|br|col|embed|hr|img|input|link|param|source|track|wbr"

ORACLE_SQL = {
    "text_normalize_title": f"WITH {LAYOUTS_SQL} SELECT doc_id, ord, {sql_title_key('text')} AS title_key FROM layouts",
    "text_collapse_ws": f"SELECT doc_id, md5({_sql_collapse('text')}) AS digest, {_sql_collapse('text')} = '' AS is_blank FROM documents",
    "md_heading_strip": f"""WITH {LAYOUTS_SQL}, x AS (SELECT doc_id, ord, list_value('## ', '#', '  ### ', '')[(doc_id + ord) % 4 + 1] || text AS m FROM layouts)
        SELECT doc_id, ord, regexp_replace(m, '^#+[{_RE2_SPACE}]+', '') AS chapter_title, regexp_replace(m, '^[{_RE2_SPACE}]*#{{1,6}}[{_RE2_SPACE}]*', '') AS contents_title FROM x""",
    "han_punctuation": f"SELECT CAST(id AS BIGINT) AS id, text FROM (VALUES {_VALUES}) AS v(id, text)",
    "han_punctuation_lines": f"""WITH {LAYOUTS_SQL} SELECT doc_id, ord, replace(replace(replace(replace(replace(text, ',', '文， 文'), ';', '文； 文'), '?', '文？ 文'), '!', '文！ 文'), ':', '文： 文') AS text FROM layouts""",
    "quote_unwrap": "SELECT doc_id, md5('«' || translate(text, '‹›〈〉«»《》', '«»《》') || '» 《' || translate(text, '‹›〈〉«»《》', '«»《》') || '》') AS digest FROM documents",
    "letter_ids": """WITH x AS (SELECT doc_id, doc_id % 18000 AS n FROM documents)
        SELECT doc_id, CASE WHEN n < 26 THEN chr(CAST(65 + n AS INT)) WHEN n < 702 THEN chr(CAST(65 + (n - 26) // 26 AS INT)) || chr(CAST(65 + (n - 26) % 26 AS INT))
        ELSE chr(CAST(65 + (n - 702) // 676 AS INT)) || chr(CAST(65 + (n - 702) // 26 % 26 AS INT)) || chr(CAST(65 + (n - 702) % 26 AS INT)) END AS letters FROM x""",
    "url_protocol": """WITH x AS (SELECT page_id, list_value(url, regexp_replace(url, '^https?://[^/]*', ''), regexp_replace(url, '^https?://', ''), 'ftp:' || regexp_replace(url, '^https?://[^/]*', ''))[page_id % 4 + 1] AS target FROM pages)
        SELECT page_id, target, target = '' OR starts_with(target, '/') OR starts_with(target, './') OR starts_with(target, '../') OR regexp_matches(lower(target), '^(https?:|mailto:)') AS allowed FROM x""",
    "bbox_clamp": f"""WITH {LAYOUTS_SQL}, x AS (SELECT book, page_index, ord, greatest(0, least(l, 700)) AS l, greatest(0, least(t, 900)) AS t, greatest(0, least(r, 700)) AS r, greatest(0, least(b, 900)) AS b FROM layouts)
        SELECT *, round(l * CAST(595.0 AS DOUBLE) / 700, 4) AS x_pt, round(CAST(842.0 AS DOUBLE) - b * CAST(842.0 AS DOUBLE) / 900, 4) AS y_pt FROM x WHERE l < r AND t < b""",
    "dpi_cap": "SELECT doc_id, least(300, CAST(round_even(sqrt(4000000.0 / ((6 + doc_id % 5) * (8 + doc_id % 7) * 3 * 0.5)), 0) AS BIGINT)) AS dpi FROM documents",
    "mergeable_flag": f"""WITH {LAYOUTS_SQL}, x AS (SELECT book, page_index, ord, text AS z, lag(text) OVER (PARTITION BY book, page_index ORDER BY ord) AS y FROM layouts),
        s AS (SELECT *, regexp_replace(y, '[{_RE2_SPACE}]+$', '') AS a, regexp_replace(z, '^[{_RE2_SPACE}]+', '') AS c FROM x WHERE ord > 0)
        SELECT book, page_index, ord, CASE WHEN a = '' OR c = '' THEN false WHEN regexp_matches(a, '[{_STOP}]$') THEN false WHEN regexp_matches(a, '[{_CONT}]$') THEN true
        WHEN regexp_matches(y, '[{T.LATIN}][{T.LINK_MARKS}]$') AND regexp_matches(z, '^[{T.LATIN}]') THEN true
        WHEN regexp_matches(c, '{T.NUMBERING}[{_RE2_SPACE}]*[^{_RE2_SPACE}]') THEN false ELSE true END AS mergeable,
        regexp_matches(a, '[{T.LATIN}][{T.LINK_MARKS}]$') AND regexp_matches(c, '^[{T.LATIN}]') AS split_word FROM s""",
    "table_text_tests": f"""WITH {LAYOUTS_SQL}, x AS (SELECT doc_id, ord, {_sql_collapse("list_value('Table 1: ', 'Note: ', '', 'Source. ')[ord % 4 + 1] || text")} AS x FROM layouts)
        SELECT doc_id, ord, length(x) > 0 AND length(x) <= 180 AND (regexp_matches(x, '{T.TABLE_TITLE}') OR regexp_matches(x, '[:：]$')) AS is_title,
        length(x) > 0 AND length(x) <= 260 AND (regexp_matches(x, '{T.TABLE_NOTE}') OR regexp_matches(x, '{T.TABLE_FOOTNOTE}') OR lower(x) = 'category not applicable.') AS is_caption FROM x""",
    "pdf_metadata": """SELECT doc_id, list_value('A B|E F', 'A B|E F', 'A B|E F', 'A B|C, D E F')[doc_id % 4 + 1] AS authors,
        CASE WHEN doc_id % 3 = 0 THEN '2000-01-01 00:00:00' ELSE '2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-05 10:11:12' END AS modified,
        CASE WHEN doc_id % 2 = 0 THEN coalesce(text, source) ELSE source END AS title FROM documents""",
    "layout_kind_map": f"""WITH {LAYOUTS_SQL}, x AS (SELECT *, list_value('text', 'sub_title', 'image', 'image_caption', 'table', 'table_caption', 'equation', 'equation_caption', 'text', 'text', NULL)[ord % 11 + 1] AS k,
        length(text) // 3 AS n, list_value(CASE WHEN ord % 5 = 0 THEN '<b>' || substr(text, 1, n) || '</b>' ELSE substr(text, 1, n) END, substr(text, n + 1, n), substr(text, n * 2 + 1)) AS p FROM layouts)
        SELECT book, page_index, ord, k AS ref, array_to_string(list_filter(p, lambda q: q <> ''), chr(10)) AS text FROM x WHERE k IS NOT NULL""",
    "void_tag_fix": f"SELECT page_id, md5(regexp_replace(html, '(?i)<({_VOID})\\b([^<>]*?)\\s*/?>', '<\\1\\2 />', 'g')) AS digest FROM pages",
    "param_ramps": """SELECT doc_id, round(CAST(0.2 AS DOUBLE) + CAST(0.6 AS DOUBLE) * least(doc_id % 7, 4) / 4, 6) AS ramp,
        round(CAST(1.0 AS DOUBLE) - CAST(0.8 AS DOUBLE) * pow(CAST(0.5 AS DOUBLE), doc_id % 7), 6) AS halving FROM documents""",
    "json_answer": r"""WITH x AS (SELECT conv_id, turn, text, '{"a": "' || replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n') || '"}' AS inside FROM conversations),
        y AS (SELECT *, list_value('Here:' || inside, 'Sorry, ' || text, '[1]', text)[turn % 4 + 1] AS t FROM x)
        SELECT conv_id, turn, trim(list_value(inside, 'Sorry, ' || text, '[1, {"b": "]"}]', text)[turn % 4 + 1], ' ' || chr(10) || chr(9) || chr(13)) AS body,
        coalesce(regexp_matches(t, '(?i)\b(sorry|cannot|can''t|unable to|do not understand)\b|抱歉|无法') AND NOT regexp_matches(t, '[\[{]'), false) AS refused FROM y""",
    "font_and_tag_tests": """SELECT doc_id, NOT regexp_matches(text, '[^\\x{0}-\\x{ff}]') AS latin1, lang AS tag, TRY_CAST(split_part(text, ' ', 1) AS INT) IS NOT NULL AS is_id FROM documents""",
    "markdown_escape": """SELECT doc_id, md5(replace(replace(text, '\\', '\\\\'), '$', '\\$')) AS digest, list_value('$', '$$', '\\(', '\\[', 'text')[doc_id % 5 + 1] AS code FROM documents""",
}
