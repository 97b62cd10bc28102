import pytest

from pagewright.functions import fill, markup
from pagewright.operators import translate

DOC = '<div><h1>Title</h1><p class="a">One <b k="1">two</b> <b k="2">three</b> <i>four</i>.</p><ul><li>five<p>six</p></li></ul></div>'


def shout(e):
    for x in e.iter():
        x.text, x.tail = x.text and x.text.upper(), x.tail and x.tail.upper()
    return e


def test_templates_number_what_differs():
    want, blocks = fill.template(markup.parse(DOC))
    ids = [(e.tag, e.get("id")) for e in want.iter()]
    assert ids == [("xml", None), ("h1", "1"), ("p", "2"), ("b", "3"), ("b", "4"), ("i", None), ("li", "5"), ("p", "6")]
    assert [b.tag for b in blocks.values()] == ["h1", "p", "li", "p"] and want[2].text == "five" and not len(want[2])


def test_a_good_answer_fills_the_document():
    filling = fill.Filling(markup.parse(DOC))
    assert filling.request()[0].get(fill.LENGTH) == "2"
    assert filling.submit(shout(filling.request())) is None
    assert fill.tostring(filling.result(), encoding="unicode") == '<div><h1>TITLE</h1><p class="a">ONE <b k="1">TWO</b> <b k="2">THREE</b> <i>FOUR</i>.</p><ul><li>FIVE<p>SIX</p></li></ul></div>'


def test_the_best_of_each_block_is_kept():
    answers = [
        "no xml at all",
        '<xml><h1 id="1">EINS</h1><p id="2">bad</p></xml>',
        '<xml><h1 id="1">worse<b>x</b></h1><p id="2">ONE <b id="3">a</b> <b id="4">b</b> <i>c</i>.</p></xml>',
    ]
    told, sent = [], iter(answers)
    out = fill.fill("<?xml version='1.0'?>" + DOC, str.upper, lambda m: next(sent), 3, told.append)
    assert out.startswith("<?xml") and "<h1>EINS</h1>" in out and 'ONE <b k="1">a</b> <b k="2">b</b> <i>c</i>.' in out and "<li>five<p>six</p></li>" in out
    assert [e.attempt for e in told] == [1, 2, 3] and told[-1].over and "block lost" in told[1].message


def test_unmatched_elements_become_text():
    filling = fill.Filling(markup.parse("<div><p>a <b>b</b> c</p></div>"))
    assert filling.submit(markup.parse('<xml><p id="1">x <u>y</u> z <b>w</b> v</p></xml>'))
    assert fill.tostring(filling.result(), encoding="unicode") == "<div><p>x y z <b>w</b> v</p></div>"


def test_odd_documents():
    assert fill.fill("<a", str.upper, lambda m: "") == "<a" and fill.fill("<a/>", str.upper, lambda m: "") == "<a/>"
    with pytest.raises(KeyError):
        fill.prompt("fill")
    assert "French" in fill.prompt("translate", language="French", wishes="")


def test_documents_in_tasks(spark):
    docs = spark.createDataFrame([(1, DOC), (2, None), (3, "<p>x</p>")], "k long, xml string")

    def make():
        def ask(messages):
            text = messages[1]["message"]
            return text[text.index("<xml>") : text.index("</xml>") + 6].replace("One", "Un")

        return str.upper, ask

    out, events = translate.fill_documents(docs, "k", "xml", make)
    found = {r.k: r.xml for r in out.collect()}
    assert ">Un <b" in found[1] and found[2] is None and found[3] == "<p>x</p>" and events.count() == 0
