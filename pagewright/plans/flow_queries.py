"""Queries of packing, matching, validation, metering and package checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pagewright.operators import flow
from pagewright.session import table
from pagewright.sources.books import LAYOUTS_SQL, layouts, titles


def _talk(spark, d) -> DataFrame:
    return table(spark, d, "conversations").where("text IS NOT NULL")


def packs(spark, d):
    """Messages packed by estimated tokens."""
    rows = _talk(spark, d).select("conv_id", "turn", flow.estimate_tokens(F.col("text")).alias("cost"))
    return flow.pack(rows, ["conv_id"], "turn", "cost", 200)


def contexts(spark, d):
    """How many earlier lines of a book fit into the context of each line."""
    line = F.row_number().over(Window.partitionBy("book").orderBy("page_index", "ord"))
    rows = layouts(spark, d).select("book", line.cast("long").alias("line"), F.greatest(flow.estimate_tokens(F.col("text")), F.lit(1)).alias("cost"))
    return flow.context(rows, ["book"], "line", "cost", 2600).select("book", "line", F.col("context").cast("long").alias("context"))


def unpadded(spark, d):
    """Context cut off again, by digest."""
    words = F.split("text", " ")
    head, tail = (F.col("doc_id") % 3).cast("int"), (F.col("doc_id") % 2).cast("int")
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(flow.without_margins(words, head, tail), " ")).alias("middle"))


def history(spark, d):
    """The last two messages of each conversation."""
    rows = _talk(spark, d).groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), x["role"])).alias("m"))
    return rows.select("conv_id", F.array_join(flow.last_messages(F.col("m"), 2), " ").alias("tail"))


def climb(spark, d):
    """Q08: best attempt of each conversation, where the weight is made of text length."""
    rows = _talk(spark, d).select("conv_id", F.col("turn").alias("attempt"), (F.length("text") % 5).cast("long").alias("weight"), F.col("text").alias("response"))
    return flow.best_attempts(rows, ["conv_id"])


def ids(spark, d):
    """Expected and actual ids of a page's rows."""
    want = F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 7)
    got = F.sequence(F.col("doc_id") % 3, F.col("doc_id") % 3 + F.col("doc_id") % 5)
    missing, unexpected = flow.id_diff(want, got)
    text = lambda a: F.array_join(a.cast("array<string>"), ",")
    return table(spark, d, "documents").select("doc_id", text(missing).alias("missing"), text(unexpected).alias("unexpected"))


def _errors(spark, d) -> DataFrame:
    return layouts(spark, d).select("book", F.col("page_index").alias("block"), (F.col("ord") % 4).alias("level"), F.col("ord").alias("index1"), F.col("page_index").alias("index2"), (F.col("ord") % 3).alias("n_ids"))


def errors(spark, d):
    """First errors of each book."""
    return flow.top_errors(_errors(spark, d), ["book"], 10).select("book", "level", "index1", "index2", F.col("place").cast("long").alias("place"))


def weights(spark, d):
    """Weights of blocks."""
    return flow.error_weights(_errors(spark, d), ["book"])


def unique(spark, d):
    """Repeated ids made unique in each page's list of sources."""
    rows = table(spark, d, "documents").select(F.expr("doc_id div 50").alias("book"), "doc_id", F.col("source").alias("id"))
    return flow.unique_ids(rows, ["book"], "doc_id", "id").select("book", "doc_id", "unique_id")


def stored(spark, d):
    """Assets by content, stored once."""
    return table(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("name")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_refs"))


def metered(spark, d):
    """Token totals by kind of event."""
    rows = table(spark, d, "events").select("event_type", F.floor("value").alias("i"), (F.col("event_id") % 50).alias("o"))
    return rows.groupBy("event_type").agg(F.sum("i").cast("long").alias("input_tokens"), F.sum("o").cast("long").alias("output_tokens"), F.count("*").alias("n_events"))


def budgeted(spark, d):
    """Events of each user until the budget is spent."""
    rows = table(spark, d, "events").select("user_id", "event_id", F.floor("value").alias("i"), (F.col("event_id") % 50).alias("o"))
    return flow.budget(rows, ["user_id"], "event_id", F.col("i") + F.col("o"), 300).select("user_id", "event_id", "spent_before")


def resumed(spark, d):
    """Pages still to do, where finished ones are those of quality rows."""
    rows = layouts(spark, d).where("ord = 0")
    done = table(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    return rows.join(done, "doc_id", "left_anti").select("book", "page_index")


def fallback(spark, d):
    """Pages with an image of the whole page in place of a result that failed."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality").distinct(), "doc_id", "left")
    failed = F.coalesce(F.col("quality") == 0, F.lit(False))
    return rows.select("doc_id", F.when(failed, "image").otherwise("text").alias("ref"), F.when(failed, F.lit("[page failed]")).otherwise(F.col("text")).alias("text"))


def sizes(spark, d):
    """Page sizes, known ones overridden by new ones."""
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 100).alias("w"), (F.col("n_chars") % 90).alias("h"))
    old = docs.where("doc_id % 3 <> 0")
    new = docs.where("doc_id % 2 = 0").select("doc_id", (F.col("w") + 1).alias("w"), F.col("h"))
    return flow.merge_maps(old, new, ["doc_id"], ["w", "h"])


def coverage(spark, d):
    """Pages that need geometry and have none, or none that is valid."""
    rows = layouts(spark, d)
    known = rows.where("ord = 0 AND doc_id % 7 <> 0").select("book", "page_index", (F.col("r") - F.col("l")).alias("w"), (F.col("b") - F.col("t") - 30).alias("h")).where("w > 0 AND h > 0 AND page_index >= 1")
    return rows.select("book", "page_index").distinct().join(known, ["book", "page_index"], "left_anti")


def progress(spark, d):
    """Share of work done after each page: contents and metadata 5 % each, pages by length."""
    w = Window.partitionBy("book").orderBy("page_index")
    rows = layouts(spark, d).groupBy("book", "page_index").agg(F.sum(F.length("text")).alias("n"))
    return rows.select("book", "page_index", F.round(0.1 + 0.9 * F.sum("n").over(w) / F.sum("n").over(Window.partitionBy("book")), 6).alias("done"))


def spine(spark, d):
    """Chapters in reading order: manifest joined with spine, page types only, addresses split at the fragment."""
    pages = table(spark, d, "pages")
    manifest = pages.select(F.concat(F.lit("i"), (F.col("page_id") % 100).cast("string")).alias("idref"), F.expr("page_id div 100").alias("book"), "url", F.element_at(F.array(F.lit("application/xhtml+xml"), F.lit("text/css"), F.lit("text/html")), (F.col("page_id") % 3 + 1).cast("int")).alias("kind"))
    order = pages.where("page_id % 4 <> 1").select(F.concat(F.lit("i"), (F.col("page_id") % 100).cast("string")).alias("idref"), F.expr("page_id div 100").alias("book"), (99 - F.col("page_id") % 100).alias("place"))
    found = manifest.where(F.col("kind").isin("application/xhtml+xml", "text/html")).join(order, ["book", "idref"])
    return found.select("book", "place", F.split_part("url", F.lit("#"), F.lit(1)).alias("href"), F.split_part("url", F.lit("#"), F.lit(2)).alias("fragment"))


def _entries(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(F.expr("doc_id div 50").alias("book"), (F.col("doc_id") % 50).alias("k"))
    entries = docs.select("book", F.col("k").alias("entry"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("id"), F.col("k"))).alias("id"), F.concat(F.lit("c"), (F.col("k") % 10).cast("string")).alias("href"))
    elements = docs.select("book", F.col("k").alias("element"), F.when(F.col("k") % 6 == 0, F.concat(F.lit("id"), F.col("k"))).alias("id"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("c"), (F.col("k") % 10).cast("string"))).alias("href"))
    return entries, elements


def matched(spark, d):
    """Contents entries matched with elements in three passes."""
    return flow.match_entries(*_entries(spark, d), ["book"])


def pruned(spark, d):
    """Contents nodes that lead to a body."""
    from pagewright.operators import toc

    rows = titles(layouts(spark, d)).select("book", "page_index", F.lit(0).cast("long").alias("ord"), ((F.col("page_index") * 7) % 4).alias("level"))
    nodes = toc.tree(rows)
    return flow.keep_with_body(nodes, nodes.where("id % 5 = 2"), ["book"]).select("book", "id")


def page_order(spark, d):
    """Chapter files in order, the head matter first, numbers as numbers."""
    rows = table(spark, d, "documents").select(F.expr("doc_id div 50").alias("book"), F.when(F.col("doc_id") % 50 == 7, "chapter_head.xml").otherwise(F.concat(F.lit("chapter_"), (F.col("doc_id") % 50).cast("string"), F.lit(".xml"))).alias("file"))
    number = F.coalesce(F.nullif(F.regexp_extract("file", r"^chapter_(\d+)\.xml$", 1), F.lit("")).cast("long"), F.lit(-1))
    return rows.select("book", "file", F.row_number().over(Window.partitionBy("book").orderBy(number)).cast("long").alias("place"))


def eligible(spark, d):
    """Texts to patch back into pages, valid boxes only, by reading order."""
    rows = layouts(spark, d).withColumn("new", F.when(F.col("ord") % 3 == 0, F.col("text")).otherwise(F.upper("text")))
    rows = rows.where("ref IN ('text', 'sub_title') AND trim(text) <> '' AND new <> text AND l < r AND t < b AND r <= 950 AND page_index >= 1")
    return rows.groupBy("book", "page_index").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("ord")), lambda x: x.cast("string")), ",").alias("ords"))


def answers(spark, d):
    """Level answers checked, normalised and cut."""
    cases = ['RESULT: {"0": 1, "1": 2, "2": -1}', '{"0": true, "1": 1, "2": 1}', '{"0": 0, "1": 3, "2": 1}', '{"0": 0, "2": 1}', "no answer", '{"0": 0, "1": 1, "2": 2, "3": 1}', '{"0": 0, "1": 9, "2": 1}']
    odd = F.element_at(F.array(*map(F.lit, cases)), (F.col("doc_id") % len(cases) + 1).cast("int"))
    own = F.format_string('RESULT: {"2": %d, "0": %d,\n"1": %d}', F.length("text") % 8 - 1, F.col("doc_id") % 5 - 1, F.length("source") % 7 - 1 + F.col("doc_id") % 2)
    levels, error = flow.title_levels(F.when(F.col("doc_id") % 3 == 0, odd).otherwise(own), F.lit(3))
    return table(spark, d, "documents").select("doc_id", F.array_join(levels.cast("array<string>"), ",").alias("levels"), error.alias("error"))


def depths(spark, d):
    """Depth shared by neighbouring element paths, and how well they may be cut."""
    path = F.array((F.col("page_index")).cast("string"), F.expr("ord div 4").cast("string"), F.expr("ord div 2").cast("string"))
    w = Window.partitionBy("book").orderBy("page_index", "ord")
    rows = layouts(spark, d).select("book", "page_index", "ord", path.alias("path")).withColumn("common", flow.common_depth(F.col("path"), F.lag("path").over(w)))
    return rows.where("common IS NOT NULL").select("book", "page_index", "ord", "common", flow.incision(F.lit(3).cast("long"), F.lit(2).cast("long"), F.col("common")).cast("long").alias("incision"))


def inline_ids(spark, d):
    """ids for children of the same tag that differ in their attributes."""
    rows = layouts(spark, d).select("book", "page_index", "ord", F.when(F.col("ord") % 2 == 0, "b").otherwise("i").alias("tag"), F.concat_ws(";", F.array_sort(F.array(F.concat(F.lit("x="), F.expr("ord % 3").cast("string")), F.lit("class=a")))).alias("print"))
    w = Window.partitionBy("book", "page_index", "tag")
    rows = rows.withColumn("differ", F.min("print").over(w) != F.max("print").over(w))
    return rows.select("book", "page_index", "ord", F.when(F.col("differ"), F.sum(F.col("differ").cast("int")).over(Window.partitionBy("book", "page_index").orderBy("ord"))).cast("long").alias("id"))


def blocks(spark, d):
    """Blocks expected and returned: lost, unexpected, or with another tag."""
    rows = layouts(spark, d).select("book", "page_index", F.col("ord").alias("id"), F.when(F.col("ord") % 2 == 0, "p").otherwise("h1").alias("tag"))
    got = rows.where("(page_index + id) % 4 <> 0").select("book", "page_index", (F.col("id") + F.when(F.col("page_index") % 5 == 0, 1).otherwise(0)).alias("id"), F.col("tag").alias("got"))
    x = rows.join(got, ["book", "page_index", "id"], "full_outer")
    error = F.when(F.col("got").isNull(), "expected").when(F.col("tag").isNull(), "unexpected").when(F.col("tag") != F.col("got"), "tag")
    return x.select("book", "page_index", "id", error.alias("error")).where("error IS NOT NULL")


def segments(spark, d):
    """Runs of rows with the same block, and where the root changes."""
    w = Window.partitionBy("book").orderBy("page_index", "ord")
    block = F.expr("ord div 3")
    rows = layouts(spark, d).select("book", "page_index", "ord", block.alias("block"), F.length("text").cast("long").alias("cost"))
    rows = rows.withColumn("run", F.sum(F.when((F.lag("block").over(w) == F.col("block")) & (F.lag("page_index").over(w) == F.col("page_index")), 0).otherwise(1)).over(w)).withColumn("ends", F.coalesce(F.lead("page_index").over(w) != F.col("page_index"), F.lit(True)))
    return rows.groupBy("book", "run").agg(F.sum("cost").alias("cost"), F.count("*").alias("n"), F.max("ends").alias("ends_root"))


def redacted(spark, d):
    """secrets in event properties, by key."""
    secret = F.regexp_replace("props", r'(?i)("(?:[a-z_]*(?:key|token|secret|password|k)[a-z_]*)"\s*:\s*)("[^"]*"|[0-9.]+)', '$1"***"')
    return table(spark, d, "events").select("event_id", secret.alias("props"))


def metadata(spark, d):
    """Metadata fields updated by position within their tag, technical ones left out."""
    tags = ["title", "creator", "language", "identifier", "subject"]
    rows = table(spark, d, "documents").select(F.expr("doc_id div 50").alias("book"), (F.col("doc_id") % 50).alias("k"), F.element_at(F.array(*map(F.lit, tags)), (F.col("doc_id") % 5 + 1).cast("int")).alias("tag"), F.col("text").alias("value"))
    rows = rows.where(~F.col("tag").isin("language", "identifier")).withColumn("n", F.row_number().over(Window.partitionBy("book", "tag").orderBy("k")))
    new = rows.where("k % 2 = 0").select("book", "tag", F.row_number().over(Window.partitionBy("book", "tag").orderBy("k")).alias("n"), F.concat(F.lit("*"), "value").alias("new"))
    return rows.join(new, ["book", "tag", "n"], "left").select("book", "tag", F.col("n").cast("long").alias("n"), F.coalesce("new", "value").alias("value"))


def prompts(spark, d):
    """headings of a book listed for a prompt, by digest."""
    rows = titles(layouts(spark, d)).groupBy("book").agg(F.sort_array(F.collect_list(F.struct("page_index", "title"))).alias("x"))
    line = F.transform("x", lambda t: F.concat(F.lit("- page "), t["page_index"].cast("string"), F.lit(": "), t["title"]))
    return rows.select("book", F.md5(F.array_join(line, "\n")).alias("digest"))


QUERIES = {
    "message_pack": packs, "context_trim": contexts, "chunk_unpad": unpadded, "retry_tail": history, "hill_climb_best": climb, "id_diff": ids, "error_topk": errors, "error_weights": weights,
    "id_dedup": unique, "asset_dedup": stored, "metering_totals": metered, "token_budget_cut": budgeted, "resume_antijoin": resumed, "fallback_rows": fallback, "size_map_merge": sizes,
    "geometry_coverage": coverage, "progress_weights": progress, "epub_spine": spine, "toc_three_pass_match": matched, "toc_prune": pruned, "chapter_order": page_order, "patch_eligible": eligible,
    "title_level_answers": answers, "segment_incision": depths, "inline_ids": inline_ids, "block_validation": blocks, "inline_groups": segments, "secret_redaction": redacted, "metadata_update": metadata, "heading_prompt": prompts,
}

_TALK = "SELECT conv_id, turn, role, text, CAST(ceil(length(text) / 4.0) AS BIGINT) AS cost FROM conversations WHERE text IS NOT NULL"
_ERRORS = f"{LAYOUTS_SQL}, e AS (SELECT book, page_index AS block, ord % 4 AS level, ord AS index1, page_index AS index2, ord % 3 AS n_ids FROM layouts)"
_TREE = f"{LAYOUTS_SQL}, x AS (SELECT book, page_index * 7 % 4 AS level, row_number() OVER (PARTITION BY book ORDER BY page_index) AS id FROM titles), nodes AS (SELECT a.book, a.id, (SELECT max(b.id) FROM x b WHERE b.book = a.book AND b.id < a.id AND b.level < a.level) AS parent_id FROM x a)"

ORACLE_SQL = {
    "message_pack": f"""WITH RECURSIVE t AS ({_TALK}), n AS (SELECT conv_id, turn, cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM t),
        p AS (SELECT conv_id, turn, k, cost AS held, CAST(0 AS BIGINT) AS pack FROM n WHERE k = 1 UNION ALL
        SELECT n.conv_id, n.turn, n.k, CASE WHEN p.held + n.cost <= 200 THEN p.held + n.cost ELSE n.cost END, p.pack + CASE WHEN p.held + n.cost <= 200 THEN 0 ELSE 1 END FROM p JOIN n ON n.conv_id = p.conv_id AND n.k = p.k + 1)
        SELECT conv_id, turn, pack FROM p""",
    "context_trim": f"""WITH {LAYOUTS_SQL}, u AS (SELECT book, row_number() OVER (PARTITION BY book ORDER BY page_index, ord) AS line, greatest(CAST(ceil(length(text) / 4.0) AS BIGINT), 1) AS cost FROM layouts),
        s AS (SELECT *, sum(cost) OVER (PARTITION BY book ORDER BY line) AS c FROM u)
        SELECT a.book, a.line, count(b.line) AS context FROM s a LEFT JOIN s b ON b.book = a.book AND b.line < a.line AND a.c - a.cost - b.c < 2600 GROUP BY a.book, a.line""",
    "chunk_unpad": """WITH x AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
        SELECT doc_id, CASE WHEN w IS NOT NULL THEN md5(coalesce(array_to_string(w[doc_id % 3 + 1 : len(w) - doc_id % 2], ' '), '')) END AS middle FROM x""",
    "retry_tail": f"""WITH t AS ({_TALK}), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS n FROM t) SELECT conv_id, string_agg(turn || ':' || role, ' ' ORDER BY turn, role) AS tail FROM r WHERE n <= 2 GROUP BY conv_id""",
    "hill_climb_best": f"""WITH t AS ({_TALK}), r AS (SELECT conv_id, turn AS attempt, CAST(length(text) % 5 AS BIGINT) AS weight, text AS response FROM t), q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY weight, attempt) AS n FROM r)
        SELECT conv_id, attempt, weight, response FROM q WHERE n = 1""",
    "id_diff": """WITH x AS (SELECT doc_id, range(0, doc_id % 7 + 1) AS want, range(doc_id % 3, doc_id % 3 + doc_id % 5 + 1) AS got FROM documents)
        SELECT doc_id, array_to_string(list_filter(want, lambda v: NOT list_contains(got, v)), ',') AS missing, array_to_string(list_filter(got, lambda v: NOT list_contains(want, v)), ',') AS unexpected FROM x""",
    "error_topk": f"WITH {_ERRORS}, r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY level DESC, index1, index2) AS place FROM e) SELECT book, level, index1, index2, place FROM r WHERE place <= 10",
    "error_weights": f"WITH {_ERRORS}, w AS (SELECT book, block, CAST(sum(pow(3, level) * greatest(n_ids, 1)) AS BIGINT) AS weight FROM e GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY book ORDER BY weight DESC, block) AS place FROM w",
    "id_dedup": """WITH x AS (SELECT doc_id // 50 AS book, doc_id, source AS id, row_number() OVER (PARTITION BY doc_id // 50, source ORDER BY doc_id) AS n FROM documents)
        SELECT book, doc_id, CASE WHEN n = 1 THEN id WHEN n = 2 THEN id || '__translated' ELSE id || '__translated_' || (n - 1) END AS unique_id FROM x""",
    "asset_dedup": "SELECT sha256(text) AS name, min(doc_id) AS first_doc, count(*) AS n_refs FROM documents GROUP BY 1",
    "metering_totals": "SELECT event_type, CAST(sum(floor(value)) AS BIGINT) AS input_tokens, CAST(sum(event_id % 50) AS BIGINT) AS output_tokens, count(*) AS n_events FROM events GROUP BY 1",
    "token_budget_cut": """WITH x AS (SELECT user_id, event_id, CAST(coalesce(sum(floor(value) + event_id % 50) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent_before FROM events)
        SELECT * FROM x WHERE spent_before < 300""",
    "resume_antijoin": "SELECT doc_id // 50 AS book, doc_id % 50 + 2 AS page_index FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "fallback_rows": """SELECT doc_id, CASE WHEN coalesce(quality = 0, false) THEN 'image' ELSE 'text' END AS ref, CASE WHEN coalesce(quality = 0, false) THEN '[page failed]' ELSE text END AS text
        FROM documents LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) USING (doc_id)""",
    "size_map_merge": "SELECT doc_id, n_chars % 100 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS w, n_chars % 90 AS h FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0",
    "geometry_coverage": f"WITH {LAYOUTS_SQL} SELECT DISTINCT book, page_index FROM layouts WHERE ord = 0 AND (doc_id % 7 = 0 OR b - t - 30 <= 0)",
    "progress_weights": f"""WITH {LAYOUTS_SQL}, n AS (SELECT book, page_index, sum(length(text)) AS n FROM layouts GROUP BY ALL)
        SELECT book, page_index, round(CAST(0.1 AS DOUBLE) + CAST(0.9 AS DOUBLE) * sum(n) OVER (PARTITION BY book ORDER BY page_index) / sum(n) OVER (PARTITION BY book), 6) AS done FROM n""",
    "epub_spine": "SELECT page_id // 100 AS book, 99 - page_id % 100 AS place, split_part(url, '#', 1) AS href, split_part(url, '#', 2) AS fragment FROM pages WHERE page_id % 4 <> 1 AND page_id % 3 <> 1",
    "toc_three_pass_match": """WITH docs AS (SELECT doc_id // 50 AS book, doc_id % 50 AS k FROM documents), en AS (SELECT book, k AS entry, CASE WHEN k % 3 = 0 THEN 'id' || k END AS id, 'c' || k % 10 AS href FROM docs),
        el AS (SELECT book, k AS element, CASE WHEN k % 6 = 0 THEN 'id' || k END AS id, CASE WHEN k % 2 = 0 THEN 'c' || k % 10 END AS href FROM docs),
        p1 AS (SELECT book, entry, element FROM en JOIN el USING (book, id)),
        e2 AS (SELECT *, row_number() OVER (PARTITION BY book, href ORDER BY entry) AS n FROM en WHERE (book, entry) NOT IN (SELECT (book, entry) FROM p1)),
        l2 AS (SELECT *, row_number() OVER (PARTITION BY book, href ORDER BY element) AS n FROM el WHERE href IS NOT NULL AND (book, element) NOT IN (SELECT (book, element) FROM p1)),
        p2 AS (SELECT e2.book, entry, element FROM e2 JOIN l2 ON e2.book = l2.book AND e2.href = l2.href AND e2.n = l2.n),
        d AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2),
        e3 AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY entry) AS n FROM en WHERE (book, entry) NOT IN (SELECT (book, entry) FROM d)),
        l3 AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY element) AS n FROM el WHERE (book, element) NOT IN (SELECT (book, element) FROM d))
        SELECT * FROM d UNION ALL SELECT e3.book, entry, element FROM e3 LEFT JOIN l3 ON e3.book = l3.book AND e3.n = l3.n""",
    "toc_prune": f"WITH RECURSIVE {_TREE}, keep AS (SELECT book, id, parent_id FROM nodes WHERE id % 5 = 2 UNION SELECT n.book, n.id, n.parent_id FROM nodes n JOIN keep k ON n.book = k.book AND n.id = k.parent_id) SELECT DISTINCT book, id FROM keep",
    "chapter_order": """WITH x AS (SELECT doc_id // 50 AS book, doc_id % 50 AS k FROM documents) SELECT book, CASE WHEN k = 7 THEN 'chapter_head.xml' ELSE 'chapter_' || k || '.xml' END AS file,
        row_number() OVER (PARTITION BY book ORDER BY CASE WHEN k = 7 THEN -1 ELSE k END) AS place FROM x""",
    "patch_eligible": f"""WITH {LAYOUTS_SQL} SELECT book, page_index, count(*) AS n, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY ord) AS ords FROM layouts WHERE trim(text) <> '' AND ord % 3 <> 0 AND upper(text) <> text AND l < r AND t < b AND r <= 950 GROUP BY ALL""",
    "title_level_answers": """WITH x AS (SELECT doc_id, [CAST(doc_id % 5 - 1 AS INT), CAST(length(source) % 7 - 1 + doc_id % 2 AS INT), CAST(length(text) % 8 - 1 AS INT)] AS v FROM documents),
        y AS (SELECT *, list_filter(v, lambda q: q >= 0) AS p FROM x),
        z AS (SELECT *, CASE WHEN len(list_filter(v, lambda q: q < -1 OR q > 5)) > 0 THEN 'out of range' WHEN coalesce(p[2] - p[1] > 2, false) OR coalesce(p[3] - p[2] > 2, false) THEN 'jump' WHEN p[1] > 1 THEN 'first level' END AS wrong FROM y)
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN list_value('0,1,-1', NULL, NULL, NULL, NULL, NULL, NULL)[doc_id % 7 + 1] WHEN wrong IS NULL THEN array_to_string(list_transform(v, lambda q: CASE WHEN q >= 0 THEN least(q - list_min(p), 3) ELSE -1 END), ',') END AS levels,
        CASE WHEN doc_id % 3 = 0 THEN list_value(NULL, 'not an integer', 'jump', 'missing ids', 'no result', 'unexpected ids', 'out of range')[doc_id % 7 + 1] ELSE wrong END AS error FROM z""",
    "segment_incision": f"""WITH {LAYOUTS_SQL}, x AS (SELECT book, page_index, ord, lag(page_index) OVER w AS pp, lag(ord) OVER w AS po FROM layouts WINDOW w AS (PARTITION BY book ORDER BY page_index, ord)),
        y AS (SELECT *, CASE WHEN pp <> page_index THEN 0 WHEN po // 4 <> ord // 4 THEN 1 WHEN po // 2 <> ord // 2 THEN 2 ELSE 3 END AS common FROM x WHERE pp IS NOT NULL)
        SELECT book, page_index, ord, common, CASE WHEN common >= 2 THEN 3 - common ELSE (2 - common) * 3 + 1 END AS incision FROM y""",
    "inline_ids": f"""WITH {LAYOUTS_SQL}, x AS (SELECT book, page_index, ord, ord % 2 AS tag, ord % 3 AS p FROM layouts), y AS (SELECT *, min(p) OVER w <> max(p) OVER w AS differ FROM x WINDOW w AS (PARTITION BY book, page_index, tag))
        SELECT book, page_index, ord, CASE WHEN differ THEN CAST(sum(CAST(differ AS INT)) OVER (PARTITION BY book, page_index ORDER BY ord) AS BIGINT) END AS id FROM y""",
    "block_validation": f"""WITH {LAYOUTS_SQL}, w AS (SELECT book, page_index, ord AS id, CASE WHEN ord % 2 = 0 THEN 'p' ELSE 'h1' END AS tag FROM layouts),
        g AS (SELECT book, page_index, id + CASE WHEN page_index % 5 = 0 THEN 1 ELSE 0 END AS id, tag AS got FROM w WHERE (page_index + id) % 4 <> 0),
        x AS (SELECT coalesce(w.book, g.book) AS book, coalesce(w.page_index, g.page_index) AS page_index, coalesce(w.id, g.id) AS id, CASE WHEN got IS NULL THEN 'expected' WHEN tag IS NULL THEN 'unexpected' WHEN tag <> got THEN 'tag' END AS error
        FROM w FULL JOIN g ON w.book = g.book AND w.page_index = g.page_index AND w.id = g.id) SELECT * FROM x WHERE error IS NOT NULL""",
    "inline_groups": f"""WITH {LAYOUTS_SQL}, x AS (SELECT book, page_index, ord, length(text) AS cost, CASE WHEN lag(page_index) OVER w = page_index AND lag(ord // 3) OVER w = ord // 3 THEN 0 ELSE 1 END AS n, coalesce(lead(page_index) OVER w <> page_index, true) AS ends FROM layouts WINDOW w AS (PARTITION BY book ORDER BY page_index, ord)),
        y AS (SELECT *, CAST(sum(n) OVER (PARTITION BY book ORDER BY page_index, ord) AS BIGINT) AS run FROM x) SELECT book, run, CAST(sum(cost) AS BIGINT) AS cost, count(*) AS n, max(ends) AS ends_root FROM y GROUP BY book, run""",
    "secret_redaction": """SELECT event_id, regexp_replace(props, '(?i)("(?:[a-z_]*(?:key|token|secret|password|k)[a-z_]*)"\\s*:\\s*)("[^"]*"|[0-9.]+)', '\\1"***"', 'g') AS props FROM events""",
    "metadata_update": """WITH r AS (SELECT doc_id // 50 AS book, doc_id % 50 AS k, list_value('title', 'creator', 'language', 'identifier', 'subject')[doc_id % 5 + 1] AS tag, text AS value FROM documents),
        s AS (SELECT *, row_number() OVER (PARTITION BY book, tag ORDER BY k) AS n FROM r WHERE tag NOT IN ('language', 'identifier')), u AS (SELECT book, tag, '*' || value AS new, row_number() OVER (PARTITION BY book, tag ORDER BY k) AS n FROM s WHERE k % 2 = 0)
        SELECT s.book, s.tag, s.n, coalesce(new, value) AS value FROM s LEFT JOIN u ON s.book = u.book AND s.tag = u.tag AND s.n = u.n""",
    "heading_prompt": f"WITH {LAYOUTS_SQL} SELECT book, md5(string_agg('- page ' || page_index || ': ' || title, chr(10) ORDER BY page_index)) AS digest FROM titles GROUP BY book",
}
