import zipfile
import io

import pytest

from pagewright import plugins
from pagewright.api import Conversion
from pagewright.functions import answers
from pagewright.sources import epub, package
from pagewright.sources.books import layouts
from pagewright.streaming import metering


def test_conversion(spark):
    rows = layouts(spark, "/root/testdata/sf0.001").where("book = 0").drop("doc_id")
    made = Conversion(rows).then(lambda found: found.where("size(texts) > 0"))
    out = made.markdown().collect()
    assert len(out) == 1 and out[0].markdown.count("\n\n") > 50 and out[0].markdown.lstrip().startswith("#")
    # every word of the books is there, but for contents pages
    words = sorted(w for r in rows.collect() for w in r.text.replace("\\", "").split())
    assert sorted(w for w in out[0].markdown.replace("\\", "").split() if set(w) != {"#"}) == words
    book = made.epub().collect()[0]
    assert zipfile.ZipFile(io.BytesIO(bytes(book.content))).namelist()[0] == "mimetype"


def test_epub_round_trip(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(epub.write_book("T & co", [("One", "<p>1</p>"), ("Two", "<p>2</p>")]))
    (tmp_path / "b.epub").write_bytes(b"broken")
    rows = epub.read_epubs(spark, str(tmp_path)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.kind, []).append(r)
    assert [r.value for r in sorted(by["spine"], key=lambda r: r.place)] == ["OEBPS/chapter_0.xhtml", "OEBPS/chapter_1.xhtml"]
    assert [r.name for r in sorted(by["toc"], key=lambda r: r.place)] == ["One", "Two"] and by["meta"][0].value == "T & co" and len(by["error"]) == 1


def test_page_xml_and_faults(spark, tmp_path):
    (tmp_path / "page_1.xml").write_text('<page index="1" width="10" height="20"><layout ref="text" order="0" det="1,2,3,4"><text>hello</text></layout><layout ref="table" order="1" section="footnote" det="1,2,3,9"><text>x</text></layout></page>')
    rows = package.read_page_xml(spark, str(tmp_path / "page_1.xml"), [1]).orderBy("ord").collect()
    assert [(r.section, r.ref, r.b, r.text) for r in rows] == [("body", "text", 4, "hello"), ("footnote", "table", 9, "x")]
    assert package.read_page_xml(spark, str(tmp_path / "page_1.xml"), [2]).count() == 0
    pages = spark.createDataFrame([(1, 1, 5, 5), (1, 0, 5, 0)], "doc_id long, page_index int, width int, height int")
    lay = spark.createDataFrame([(1, 1, "body", 0), (1, 1, "body", 2), (1, 7, "body", 0)], "doc_id long, page_index int, section string, ord long")
    assert {r.fault for r in package.faults(pages, lay).collect()} == {"page number", "page size", "unknown page", "order"}


def test_page_xml_round_trip(spark, tmp_path):
    rows = [(1, 1, "body", 0, "text", 1, 2, 3, 4, 'a <b> & "c"'), (1, 1, "body", 1, "table", 1, 2, 3, 5, ""), (1, 1, "footnote", 0, "text", 0, 0, 9, 9, "n")]
    lay = spark.createDataFrame(rows, "doc_id long, page_index int, section string, ord int, ref string, l int, t int, r int, b int, text string")
    (tmp_path / "p.xml").write_text(package.page_xml(lay).collect()[0].xml)
    back = package.read_page_xml(spark, str(tmp_path / "p.xml")).collect()
    assert sorted((1, r.page_index, r.section, r.ord, r.ref, r.l, r.t, r.r, r.b, r.text or "") for r in back) == sorted(rows)
    with pytest.raises(Exception, match="gaps"):
        package.page_xml(lay.where("ord = 1")).collect()


def test_recognise(spark):
    pages = spark.createDataFrame([(1, 1, bytearray(b"ab"))], "doc_id long, page_index int, image binary")
    make = lambda: lambda image: [{"ref": "text", "l": 0, "t": 0, "r": 5, "b": 5, "text": "x"}, {"ref": "text", "l": 5, "t": 0, "r": 5, "b": 5, "text": "flat"}, {"ref": "text", "l": 0, "t": 0, "r": 9, "b": 9, "text": "y", "section": "body"}]
    assert [(r.ord, r.text) for r in plugins.recognise(pages, make).orderBy("ord").collect()] == [(0, "x"), (1, "y")]


def test_loops():
    answers = iter(["bad", "", '```json\n{"a": 1}\n```'])
    seen = []

    def ask(messages):
        seen.append(len(messages))
        return next(answers)

    assert plugins.guaranteed_json([{"role": "user", "message": "q"}], ask, lambda v: v["a"]) == 1 and seen == [1, 3, 2]
    with pytest.raises(plugins.Exhausted):
        plugins.guaranteed_json([], lambda m: "Sorry, I cannot", lambda v: v)
    with pytest.raises(ValueError):
        plugins.OcrConfig("x", model_path="a", url="b")
    assert "secret" not in repr(plugins.LlmConfig("u", "m", "secret"))


def test_json_in_answers():
    for answer, want in (
        ('```json\n{"a": [1, "}"]}\n``` and {"b": 2}', {"a": [1, "}"]}),
        ("x ] {'a': True, b: [1, 2,], } tail", {"a": True, "b": [1, 2]}),
        ('so: [{"k": "v\\"]"}, 3', [{"k": 'v"]'}, 3]),
        (" 7 ", 7),
    ):
        assert answers.json_value(answer) == want
    for answer in ("", "nothing here", "{'a' 1}"):
        with pytest.raises(ValueError):
            answers.json_value(answer)
    assert answers.json_text(None) is None and answers.declines("Sorry, no.") and not answers.declines("sorry [1]")
    shape = {"levels": [int], "note?": str, "more": {"*": bool}}
    assert answers.faults({"levels": [1, 2], "more": {"x": True}}, shape) == []
    assert len(answers.faults({"levels": [True, "a"], "more": [], "z": 1}, shape)) == 4


def test_shapes_get_feedback():
    said = []

    def ask(messages):
        said.append(messages[-1]["message"])
        return ['{"n": "1"}', '{"n": 1}'][len(said) - 1]

    assert plugins.guaranteed_json([{"role": "user", "message": "q"}], ask, lambda v: v["n"], shape={"n": int}) == 1 and "value.n" in said[1]


def test_levels_by_a_model(spark):
    assert plugins.levels_of('RESULT: {"0": 1, "1": -1, "2": 3}', 3) == [0, -1, 2] and plugins.levels_of('{"0": 0, "1": 2, "2": 4, "3": 5}', 4) == [0, 2, 3, 3]
    for bad in ("none", '{"0": 0}', '{"0": 0, "1": 3}', '{"0": true, "1": 0}', '{"0": 2, "1": 2}', '{"0": 0, "1": 9}', '{"0": 0, "1": 1, "2": 1}'):
        with pytest.raises(ValueError):
            plugins.levels_of(bad, 2)
    titles = spark.createDataFrame([(1, 1, 0, "a"), (1, 2, 0, "b"), (2, 1, 0, "lost")], "book long, page_index long, ord long, title string")

    def make():
        return lambda messages: "Sorry, no." if "lost" in messages[1]["message"] else '{"0": 0}' if len(messages) == 2 else '{"0": 0, "1": 1}'

    assert sorted(tuple(r) for r in plugins.level_asker(make)(titles).collect()) == [(1, 1, 0, 0), (1, 2, 0, 1)]


def test_recognisers_by_name(spark, tmp_path):
    for doc, page in ((1, 1), (1, 2), (7, 1)):
        (tmp_path / str(doc)).mkdir(exist_ok=True)
        (tmp_path / str(doc) / f"page_{page}.png").write_bytes(b"x" * page)
    plugins.register_ocr("count", lambda config: lambda image: [{"ref": "text", "l": 0, "t": 0, "r": 1, "b": 1, "text": config.size * len(image)}, {"ref": "image", "l": 0, "t": 0, "r": 1, "b": 1, "text": "", "stage": 2}, {"ref": "text", "l": 0, "t": 0, "r": 1, "b": 1, "text": "note", "stage": 2}])
    found = plugins.recognise(plugins.image_pages(spark, str(tmp_path)), plugins.OcrConfig("count", model_path="m", size="z")).collect()
    assert sorted((r.doc_id, r.page_index, r.section, r.ord, r.text) for r in found) == [(1, 1, "body", 0, "z"), (1, 1, "footnote", 0, "note"), (1, 2, "body", 0, "zz"), (1, 2, "footnote", 0, "note"), (7, 1, "body", 0, "z"), (7, 1, "footnote", 0, "note")]
    with pytest.raises(ValueError, match="no recogniser"):
        plugins.recogniser(plugins.OcrConfig("other", url="u"))


def test_patch_checks_all_first(spark):
    rows = spark.createDataFrame([(1, 1, 0, "a"), (1, 1, 1, "bb")], "doc_id int, page_index int, ord int, text string")
    with pytest.raises(ValueError):
        plugins.patch(rows, lambda r: len(r["text"]) < 2, lambda r: None)
    assert plugins.patch(rows, lambda r: True, lambda r: list(r) and None) == 2


def test_translate(spark):
    rows = spark.createDataFrame([("a",), (None,)], "t string")
    assert sorted(r.t for r in plugins.translate(rows, "t", lambda: lambda xs: [x.upper() for x in xs]).collect()) == ["", "A"]


def test_streams(spark, tmp_path):
    parts = spark.createDataFrame([(1, 0, 1, "a"), (1, 1, 1, "b"), (1, 2, 2, "c"), (2, 0, 1, "z"), (3, 0, 5, None), (3, 1, 5, "y")], "document long, ord long, element long, text string")
    metering.with_ends(parts).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(parts.schema).parquet(str(tmp_path / "in"))
    done = metering.finish(metering.regroup_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    assert sorted((r.document, r.element, r.text) for r in done) == [(1, 1, "ab"), (1, 2, "c"), (2, 1, "z"), (3, 5, "y")]


def test_elements_go_on_over_batches(spark, tmp_path):
    schema = "document long, ord long, element long, text string"
    source = str(tmp_path / "in")
    for rows in ([(1, 0, 1, "a"), (1, 1, 2, "b")], [(1, 2, 2, "c")], [(1, 3, None, "")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        done = metering.finish(metering.regroup_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    assert sorted((r.document, r.element, r.text) for r in done) == [(1, 1, "a"), (1, 2, "bc")]


def test_cache_adds_once(spark, tmp_path):
    parts = spark.createDataFrame([(1, 0, 1, "a"), (1, 1, 1, "b"), (1, 2, 2, "c"), (2, 0, 1, "z")], "document long, ord long, element long, text string")
    write = metering.append_new(str(tmp_path / "cache"), "document")
    write(parts, 0)
    write(parts, 0)
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2
