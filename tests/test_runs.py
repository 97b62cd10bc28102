import json
import time
from datetime import datetime

import pytest

from pagewright import cli, runs
from pagewright.sources import chapters, epub


def test_folders_and_settings(tmp_path):
    day = datetime(2024, 5, 6)
    assert [runs.run_folder(tmp_path, n, day).name for n in ("a", "b", "a")] == ["a-20240506-001", "b-20240506-002", "a-20240506-003"]
    with runs.work_folder() as held:
        assert held.is_dir()
    assert not held.exists()
    with runs.work_folder(tmp_path / "x" / "y") as kept:
        pass
    assert kept.is_dir()
    found = runs.settings_of("# no\nexport A_KEY='x # y'\nB=2 # two\n\nA_URL = \"http://u\"\nbad line")
    assert found == {"A_KEY": "x # y", "B": "2", "A_URL": "http://u"} and runs.profile(found, "a", ("key", "url", "model")) == {"key": "x # y", "url": "http://u"}
    assert runs.redacted({"a": {"api_key": "s"}, "l": [{"token": "t"}], "n": 1}) == {"a": {"api_key": "***"}, "l": [{"token": "***"}], "n": 1}


def test_patch_options():
    assert runs.PatchOptions().align == "left"
    for bad in ({"smallest": 0}, {"largest": 1}, {"line_height": 0}, {"padding": (0, -1)}, {"align": "up"}, {"overflow": "cut"}):
        with pytest.raises(ValueError):
            runs.PatchOptions(**bad)


def test_progress_and_order():
    seen, shares = [], []
    p = runs.Progress(seen.append, shares.append)
    assert p.stages({"a": lambda: 1, "b": lambda: 2}, {"a": 3.0}) == {"a": 1, "b": 2} and shares == [0.75, 1.0] and [e["kind"] for e in seen] == ["start", "done"] * 2
    with pytest.raises(InterruptedError):
        runs.Progress(stopped=lambda: True).stages({"a": lambda: 1})
    with pytest.raises(ZeroDivisionError):
        runs.Progress(seen.append).stages({"a": lambda: 1 / 0})
    assert seen[-1]["kind"] == "failed"
    taken = []

    def slow(k):
        time.sleep(0.02 if k % 3 == 0 else 0)
        return k * k

    source = (taken.append(k) or k for k in range(20))
    found = runs.in_order(source, slow, 4)
    assert next(found) == 0 and len(taken) <= 5 and list(found) == [k * k for k in range(1, 20)]
    assert list(runs.in_order([1], slow, 1)) == [1]
    with pytest.raises(ValueError):
        next(runs.in_order([], slow, 0))
    assert list(runs.intercepted([1, 2], lambda s: (x + 1 for x in s), lambda s: (x * 10 for x in s), lambda s: (f"<{x}>" for x in s))) == ["<20>", "<30>"]


def test_checks_of_outputs():
    assert runs.markdown_faults(" ", []) == ["empty"]
    assert runs.markdown_faults("![a](./x/1.png) ![b](http://u) ![c](<x/2.png>)", ["x\\1.png"]) == ["image x/2.png is missing"]
    good = epub.write_book("T", [("One", "<p>1</p>")])
    assert runs.epub_faults(good) == [] and runs.epub_faults(b"x") == ["not an archive"]
    bad = epub.replaced(good, {"OEBPS/chapter_0.xhtml": b"<p>", "OEBPS/nav.xhtml": b'<html><a href="gone.xhtml">x</a></html>'})
    assert len(runs.epub_faults(bad)) == 2
    assert runs.pdf_faults(b"%PDF-1.4 /Type /Page %%EOF") == [] and len(runs.pdf_faults(b"x")) == 3


def test_smoke_matrix(tmp_path):
    matrix = {"defaults": {"route": ["markdown", "epub"], "api_key": "s"}, "runs": [{"asset": "a.pdf"}, {"asset": "b.pdf", "route": "odd"}]}
    cells = runs.expand(matrix)
    assert [(c.asset, c.route) for c in cells] == [("a.pdf", "markdown"), ("a.pdf", "epub"), ("b.pdf", "odd")]
    found = runs.smoke(cells, {"markdown": lambda run, folder: [], "epub": lambda run, folder: ["bad"]}, tmp_path)
    assert [r["status"] for r in found] == ["passed", "failed", "error"]
    told = json.loads((tmp_path / found[0]["folder"].rsplit("/", 1)[1] / "manifest.json").read_text())
    assert told["run"]["api_key"] == "***" and told["status"] == "passed"
    with pytest.raises(ValueError):
        runs.expand({"runs": [{}]})


def test_chapters_as_xml(spark):
    elements = [{"kind": "text", "ref": "title", "level": 0, "page_index": 1, "ord": 0, "texts": ["A & B"], "title": None, "content": None, "caption": None}, {"kind": "image", "ref": "image", "level": -1, "page_index": 1, "ord": 1, "texts": None, "title": "t", "content": "", "caption": None}]
    xml = chapters.encode(3, 1, elements, [{"label": 2, "text": "n"}])
    assert chapters.decode(xml) == (3, 1, elements, [{"label": 2, "text": "n"}])
    for bad in ("<a/>", "<chapter/>", "<chapter><body><x ref='a'/></body></chapter>", "<chapter", "<chapter id='x'><body/></chapter>"):
        with pytest.raises(ValueError):
            chapters.decode(bad)
    ask = lambda m: (t := m[1]["message"])[t.index("<xml>") : t.index("</xml>") + 6].replace("A &amp; B", "C")
    assert chapters.decode(chapters.translate_chapter(xml, str.upper, ask))[2][0]["texts"] == ["C"]
    rows = spark.createDataFrame([(1, 1, "text", 1, 0, "title", None, None, None, ["One [^1]"], 5, 0, 0), (1, 2, "table", 1, 1, "table", "t", "c", None, None, 5, 0, -1), (1, 3, "text", 2, 0, "text", None, None, None, ["two"], None, 1, -1)], "book long, place long, kind string, page_index long, ord long, ref string, title string, content string, caption string, texts array<string>, chapter_id long, chapter_level long, level long")
    notes = spark.createDataFrame([(1, 1, "note"), (1, 2, "other")], "book long, label long, text string")
    made = chapters.chapter_xml(rows, notes)
    back = {r.chapter_id: r for r in chapters.from_xml(made).collect()}
    assert [e.kind for e in back[5].elements] == ["text", "table"] and [n.text for n in back[5].notes] == ["note"] and back[None].level == 1 and not back[None].notes


def test_command_line(tmp_path, capsys):
    (tmp_path / "a.md").write_text("![x](b.png)")
    assert cli.main(["check", str(tmp_path / "a.md")]) == 1 and "b.png" in capsys.readouterr().out
    (tmp_path / "b.png").write_bytes(b"x")
    assert cli.main(["check", str(tmp_path / "a.md")]) == 0
    (tmp_path / "m.json").write_text(json.dumps({"runs": [{"asset": "a", "route": ["x", "y"]}]}))
    assert cli.main(["smoke", str(tmp_path / "m.json"), "--folder", str(tmp_path / "out")]) == 0 and "a y" in capsys.readouterr().out
    assert len(list((tmp_path / "out").glob("*/checks.json"))) == 2
