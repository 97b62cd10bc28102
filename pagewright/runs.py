"""Runs of conversions: folders, settings from files, smoke matrices with checks and reports, progress, and ordered tasks."""

from __future__ import annotations

import io
import json
import os
import platform
import posixpath
import re
import tempfile
import zipfile
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timezone
from itertools import islice
from pathlib import Path
from typing import Any, TypeVar
from xml.etree import ElementTree

P, R = TypeVar("P"), TypeVar("R")
SECRET = re.compile(r"key|token|secret|password", re.I)


def run_folder(root: Path, label: str, day: datetime | None = None) -> Path:
    """A new folder `<label>-<date>-<number>` below root; numbers count up over all labels of a day, also between processes."""
    stamp = (day or datetime.now().astimezone()).strftime("%Y%m%d")
    root.mkdir(parents=True, exist_ok=True)
    taken = [int(p.name.rsplit("-", 1)[1]) for p in root.iterdir() if re.search(rf"-{stamp}-\d+\Z", p.name)]
    number = max(taken, default=0)
    while True:
        number += 1
        try:
            (made := root / f"{label}-{stamp}-{number:03d}").mkdir()
        except FileExistsError:  # another process was faster
            continue
        return made


@contextmanager
def work_folder(path: str | Path | None = None) -> Iterator[Path]:
    """The given folder, made if it is not there and kept; or a temporary one of this machine, gone afterwards."""
    if path is not None:
        Path(path).mkdir(parents=True, exist_ok=True)
        yield Path(path)
    else:
        with tempfile.TemporaryDirectory(prefix="pagewright-") as made:
            yield Path(made)


def settings_of(text: str) -> dict[str, str]:
    """Names and values of an environment file: comments and blank lines left out, `export` and quotes taken off."""
    out = {}
    for line in text.splitlines():
        m = re.match(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*\Z", line)
        if m:
            value = m[2]
            quoted = re.match(r"""(["'])(.*?)\1""", value)
            out[m[1]] = quoted[2] if quoted else re.sub(r"\s+#.*\Z", "", value)
    return out


def profile(settings: dict[str, str], prefix: str, fields: Iterable[str]) -> dict[str, str]:
    """The fields of one profile: settings named `<PREFIX>_<FIELD>`. Settings come from the caller; nothing here reads the environment."""
    return {f: settings[f"{prefix}_{f}".upper()] for f in fields if settings.get(f"{prefix}_{f}".upper())}


def redacted(value: Any, name: str = "") -> Any:
    """A settings tree without its secrets, by name."""
    if isinstance(value, dict):
        return {k: redacted(v, str(k)) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [redacted(v, name) for v in value]
    return "***" if isinstance(value, str) and value and SECRET.search(name) else value


@dataclass(frozen=True)
class PatchOptions:
    """How new text is set into the boxes of a page."""

    smallest: float = 4.0
    largest: float = 24.0
    line_height: float = 1.2
    padding: tuple[float, float] = (0.0, 0.0)
    align: str = "left"
    overflow: str = "error"

    def __post_init__(self) -> None:
        wrong = [
            ("type sizes must be positive, the largest not below the smallest", not 0 < self.smallest <= self.largest),
            ("the line height must be positive", self.line_height <= 0),
            ("padding must not be negative", min(self.padding) < 0),
            (f"unknown alignment {self.align}", self.align not in ("left", "center", "right", "justify")),
            (f"unknown overflow {self.overflow}", self.overflow not in ("error", "skip")),
        ]
        if found := [text for text, bad in wrong if bad]:
            raise ValueError("; ".join(found))


@dataclass
class Progress:
    """Callbacks of a run: on_event gets every event as a dict, on_progress the share done; stopped ends the run before its next stage."""

    on_event: Callable[[dict[str, Any]], None] = lambda event: None
    on_progress: Callable[[float], None] = lambda share: None
    stopped: Callable[[], bool] = lambda: False
    events: list[dict[str, Any]] = field(default_factory=list)

    def stages(self, todo: dict[str, Callable[[], Any]], weights: dict[str, float] | None = None) -> dict[str, Any]:
        """Runs the stages in order, with an event before and after each; their shares of the work are their weights."""
        total, done, out = sum((weights or {}).get(n, 1.0) for n in todo), 0.0, {}
        for name, stage in todo.items():
            if self.stopped():
                self._say(stage=name, kind="stopped")
                raise InterruptedError(f"stopped before {name}")
            start = datetime.now(timezone.utc)
            self._say(stage=name, kind="start")
            try:
                out[name] = stage()
            except Exception as e:
                self._say(stage=name, kind="failed", error=f"{type(e).__name__}: {e}")
                raise
            self._say(stage=name, kind="done", seconds=(datetime.now(timezone.utc) - start).total_seconds())
            done += (weights or {}).get(name, 1.0)
            self.on_progress(done / total)
        return out

    def _say(self, **event: Any) -> None:
        self.events.append(event)
        self.on_event(event)


def in_order(items: Iterable[P], call: Callable[[P], R], at_once: int) -> Iterator[R]:
    """Results in the order of the items, at most `at_once` calls under way; items are taken as calls end, so a stream stays a stream."""
    if at_once < 1:
        raise ValueError("at least one at once")
    rest = iter(items)
    if at_once == 1:
        yield from map(call, rest)
        return
    with ThreadPoolExecutor(at_once) as pool:
        waiting = deque(pool.submit(call, p) for p in islice(rest, at_once))
        try:
            while waiting:
                yield waiting.popleft().result()
                waiting.extend(pool.submit(call, p) for p in islice(rest, 1))
        finally:
            for f in waiting:
                f.cancel()


def intercepted(source: Iterable[P], before: Callable[[Iterable[P]], Iterable[P]], call: Callable[[Iterable[P]], Iterable[R]], after: Callable[[Iterable[R]], Iterable[R]]) -> Iterator[R]:
    """A stream of segments through a hook on its source, a translation, and a hook on what comes out; all are lazy."""
    yield from after(call(before(source)))


def markdown_faults(text: str, names: Iterable[str]) -> list[str]:
    """What is wrong with a Markdown book: it is empty, or an image it shows is not among the names beside it."""
    if not text.strip():
        return ["empty"]
    known = {posixpath.normpath(n.replace("\\", "/")) for n in names}
    shown = [m.strip("<>") for m in re.findall(r"!\[[^\]]*\]\(\s*(<[^>]*>|[^)\s]+)", text)]
    local = [t for t in shown if not re.match(r"#|[A-Za-z][\w+.-]*:|//", t)]
    return [f"image {t} is missing" for t in local if posixpath.normpath(t.replace("\\", "/")) not in known]


def epub_faults(blob: bytes) -> list[str]:
    """What is wrong with an EPUB: its type, container, package, manifest, reading order, contents or a page of it."""
    try:
        z = zipfile.ZipFile(io.BytesIO(blob))
    except zipfile.BadZipFile:
        return ["not an archive"]
    out: list[str] = []
    names = z.namelist()
    tag = lambda e: e.tag.rpartition("}")[2]

    def xml(name: str) -> ElementTree.Element | None:
        try:
            return ElementTree.fromstring(z.read(name))
        except KeyError:
            out.append(f"{name} is missing")
        except ElementTree.ParseError as e:
            out.append(f"{name} is not well-formed: {e}")
        return None

    with z:
        if names[:1] != ["mimetype"] or z.read("mimetype") != b"application/epub+zip" or z.getinfo("mimetype").compress_type != zipfile.ZIP_STORED:
            out.append("the media type must come first, uncompressed")
        container = xml("META-INF/container.xml")
        roots = [e.get("full-path", "") for e in container.iter() if tag(e) == "rootfile"] if container is not None else []
        if container is not None and len(roots) != 1:
            out.append("one package document is wanted")
        opf = xml(roots[0]) if len(roots) == 1 else None
        if opf is None:
            return out
        base, items = posixpath.dirname(roots[0]), {}
        for e in (e for e in opf.iter() if tag(e) == "item"):
            if e.get("id") in items:
                out.append(f"id {e.get('id')} twice")
            items[e.get("id")] = e
            if (name := posixpath.normpath(posixpath.join(base, e.get("href", "")))) not in names:
                out.append(f"{name} is missing")
        order = [e.get("idref") for e in opf.iter() if tag(e) == "itemref"]
        out += ["nothing to read"] * (not order) + [f"{i} is not in the manifest" for i in order if i not in items]
        for i in order:
            if i in items:
                xml(posixpath.normpath(posixpath.join(base, items[i].get("href", ""))))
        if opf.get("version", "2").startswith("3"):
            navs = [e for e in items.values() if "nav" in e.get("properties", "").split()]
            if len(navs) != 1:
                out.append("one page of contents is wanted")
            elif (nav := xml(posixpath.normpath(posixpath.join(base, navs[0].get("href", ""))))) is not None:
                links = [a.get("href", "").partition("#")[0] for a in nav.iter() if tag(a) == "a"]
                at = posixpath.dirname(posixpath.join(base, navs[0].get("href", "")))
                out += [f"contents lead to {h}, which is missing" for h in links if h and posixpath.normpath(posixpath.join(at, h)) not in names]
    return list(dict.fromkeys(out))


def pdf_faults(blob: bytes) -> list[str]:
    """What is wrong with a PDF as a file: its head, its end, or no page in it."""
    checks = (("no PDF", not blob.startswith(b"%PDF-")), ("cut off", b"%%EOF" not in blob[-2048:]), ("no pages", not re.search(rb"/Type\s*/Page", blob)))
    return [text for text, bad in checks if bad]


@dataclass(frozen=True)
class SmokeRun:
    """One cell of a smoke matrix."""

    asset: str
    route: str
    backend: str = ""
    options: tuple[tuple[str, Any], ...] = ()


def expand(matrix: dict[str, Any]) -> list[SmokeRun]:
    """All runs of a matrix: `defaults` under each of `runs`; a list as route or backend stands for a run with each."""
    out = []
    for run in matrix.get("runs", []):
        whole = {**matrix.get("defaults", {}), **run}
        each = lambda name, whole=whole: whole[name] if isinstance(whole.get(name), list) else [whole.get(name, "")]
        if not whole.get("asset"):
            raise ValueError("a run needs an asset")
        rest = tuple(sorted((k, v if not isinstance(v, list | dict) else json.dumps(v, sort_keys=True)) for k, v in whole.items() if k not in ("asset", "route", "backend")))
        out += [SmokeRun(whole["asset"], r, b, rest) for r in each("route") for b in each("backend")]
    return list(dict.fromkeys(out))


def smoke(runs: Iterable[SmokeRun], routes: dict[str, Callable[[SmokeRun, Path], list[str]]], root: Path, dry: bool = False) -> list[dict[str, Any]]:
    """Runs a matrix, each cell in a folder of its own with manifest.json and checks.json; a route gives the faults of its output.

    A cell that fails or has no route is reported, and the others still run.
    """
    out = []
    for run in runs:
        folder = run_folder(root, re.sub(r"\W+", "-", f"{run.asset}-{run.route}"))
        report = {"run": redacted({"asset": run.asset, "route": run.route, "backend": run.backend, **dict(run.options)}), "started": datetime.now(timezone.utc).isoformat(), "dry": dry, "python": platform.python_version()}
        try:
            faults = [] if dry and run.route in routes else routes[run.route](run, folder)
            status = "dry" if dry else "failed" if faults else "passed"
        except Exception as e:  # reported, not hidden: a matrix goes on
            faults, status = [f"{type(e).__name__}: {e}"], "error"
        report |= {"status": status, "ended": datetime.now(timezone.utc).isoformat()}
        for name, value in (("manifest.json", report), ("checks.json", {"status": status, "faults": faults})):
            write_whole(folder / name, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True))
        out.append({**report, "folder": str(folder), "faults": faults})
    return out


def write_whole(path: Path, text: str) -> None:
    """Writes a file so that others see the old one or the new one, never a part."""
    part = path.with_name(f".{path.name}.{os.getpid()}")
    part.write_text(text, encoding="utf-8")
    part.replace(path)
