import pytest

from pagewright.functions import markup as M

DOC = '<html xmlns="http://www.w3.org/1999/xhtml"><body><p>one <i>two</i> three</p><div>four<p>five</p>six</div></body></html>'


def test_segments():
    found = M.segments(M.parse(DOC))
    assert [(s.text.strip(), s.path, s.tail) for s in found] == [("one", (0, 0), False), ("two", (0, 0, 0), False), ("three", (0, 0, 0), True), ("four", (0, 1), False), ("five", (0, 1, 0), False), ("six", (0, 1, 0), True)]
    assert [len(r) for r in M.inline_runs(found)][:1] == [3]


def test_submit():
    again = M.submit(DOC, [None] * 6)
    assert [s.text for s in M.segments(M.parse(again))] == [s.text for s in M.segments(M.parse(DOC))]
    texts = [s.text.strip() for s in M.segments(M.parse(M.submit(DOC, list("abcdef"))))]
    assert texts == list("abcdef")
    both = [s.text.strip() for s in M.segments(M.parse(M.submit(DOC, list("abcdef"), M.APPEND_TEXT)))]
    assert both[0] == "one a" and both[-1] == "six f"
    blocks = [s.text.strip() for s in M.segments(M.parse(M.submit(DOC, list("abcdef"), M.APPEND_BLOCK)))]
    assert blocks[:6] == ["one", "two", "three", "a", "b", "c"]
    with pytest.raises(ValueError):
        M.submit(DOC, ["x"])


def test_ids():
    assert M.unique_ids('<a id="x"><b id="x"/><c id="x"/><d id="x__translated"/></a>') == '<a id="x"><b id="x__translated" /><c id="x__translated_2" /><d id="x__translated__translated" /></a>'


@pytest.mark.parametrize("costs", [[1] * 50, [200], [30, 30, 30, 90, 5, 5], []])
def test_chunks_cover_once(costs):
    found = list(M.chunks(costs, 60))
    assert [k for _, a, z, _ in found for k in range(a, z)] == list(range(len(costs)))
    assert all(b <= a and e >= z and (z - a == 1 or sum(costs[b:e]) <= 60) for b, a, z, e in found)


def test_friendly_round_trip():
    root = M.parse("<d><p>a &lt; b <b>c</b> d</p><q/><long><x>some longer text that does not fit</x><y>more</y></long></d>")
    text = M.friendly(root)
    assert "  <p>a &lt; b" in text and "\n  <q/>" in text
    back = M.from_friendly("Here: " + text + " done")[0]
    squeeze = lambda e: "".join("".join(e.itertext()).split())
    assert squeeze(back) == squeeze(root) and [c.tag for c in back.iter()] == [c.tag for c in root.iter()]
    assert [c.tag for c in M.from_friendly("<a><b>x</a></c><d/>")] == ["a", "d"]


def test_math_is_held_back():
    root = M.parse("<p>a <math><mi>x</mi></math> b <math><mi>y</mi></math></p>")
    held_root, held = M.without_math(root)
    assert len(held) == 2 and not list(held_root.iter("mi"))
    again = M.with_math(M.parse(M.ElementTree.tostring(held_root, encoding="unicode")), held)
    assert M.ElementTree.tostring(again) == M.ElementTree.tostring(root)


def test_contents():
    xml = M.contents_xml([(1, None, "One"), (2, 1, "Two & half"), (3, None, "Three")])
    assert M.contents_titles(xml) == {1: "One", 2: "Two & half", 3: "Three"}
