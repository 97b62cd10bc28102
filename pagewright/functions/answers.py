"""Answers of language models: the JSON value in them, slips in it mended, its shape checked, and refusals."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, functions as F

from .parsers import arrow

# Words by which an answer declines a task.
DECLINES = ("sorry", "cannot", "can't", "unable to", "do not understand")
DECLINES_HAN = ("抱歉", "无法")
_BRACKETS = {"{": "}", "[": "]"}
_DECLINES = r"(?i)\b(?:" + "|".join(DECLINES) + r")\b|" + "|".join(DECLINES_HAN)


def json_spans(answer: str) -> list[tuple[int, int]]:
    """Start and end of the outermost bracketed values of a text, in order; brackets in strings do not count.

    A value that is never closed reaches to the end of the text; a bracket that closes nothing is skipped.
    """
    found: list[tuple[int, int]] = []
    open_: list[str] = []
    start = at = 0
    while at < len(answer):
        c = answer[at]
        if c in _BRACKETS:
            start = start if open_ else at
            open_.append(_BRACKETS[c])
        elif open_ and c == '"':
            at = _string_end(answer, at)
        elif open_ and c == open_[-1]:
            open_.pop()
            if not open_:
                found.append((start, at + 1))
        at += 1
    return found + [(start, len(answer))] * bool(open_)


def _string_end(text: str, at: int) -> int:
    """The place of the quote that ends the string which begins at `at`, or the last place of the text."""
    at += 1
    while at < len(text) and text[at] != '"':
        at += 2 if text[at] == "\\" else 1
    return min(at, len(text) - 1)


def json_text(answer: str | None) -> str | None:
    """The first closed bracketed value of an answer; else the unclosed one; else all of it."""
    if answer is None:
        return None
    spans = json_spans(answer)
    return answer[slice(*spans[0])].strip(" \n\t\r") if spans else answer.strip(" \n\t\r")


def mended(text: str) -> str:
    """A JSON text with common slips put right: single quotes, bare names, Python's constants, commas too many, and ends that are missing."""
    out: list[str] = []
    open_: list[str] = []
    at = 0
    while at < len(text):
        c = text[at]
        if c in "\"'":
            end = at + 1
            while end < len(text) and text[end] != c:
                end += 2 if text[end] == "\\" else 1
            body = text[at + 1 : end]
            out.append('"' + (body if c == '"' else body.replace("\\'", "'").replace('"', '\\"')) + '"')
            at = end + 1
            continue
        if c in _BRACKETS:
            open_.append(_BRACKETS[c])
        elif c in "}]":
            if c not in open_:
                at += 1
                continue
            while open_ and open_[-1] != c:
                _drop_comma(out)
                out.append(open_.pop())
            _drop_comma(out)
            open_.pop()
        if m := re.compile(r"[A-Za-z_]\w*").match(text, at):
            out.append({"True": "true", "False": "false", "None": "null"}.get(m[0], m[0] if m[0] in ("true", "false", "null") else f'"{m[0]}"'))
            at = m.end()
            continue
        out.append(c)
        at += 1
    while open_:
        _drop_comma(out)
        out.append(open_.pop())
    return "".join(out)


def _drop_comma(out: list[str]) -> None:
    while out and out[-1].isspace():
        out.pop()
    if out and out[-1] == ",":
        out.pop()


def json_value(answer: str) -> Any:
    """The JSON value of an answer, mended where it must be; ValueError if there is none."""
    text = json_text(answer) or ""
    try:
        return json.loads(text)
    except ValueError:
        if text[:1] not in _BRACKETS:
            raise
        return json.loads(mended(text))


def faults(value: Any, shape: Any, path: str = "value") -> list[str]:
    """How a value differs from a shape: a type, a list with the shape of its items, or a dict with the shapes of its fields.

    A key that ends in `?` may be absent; the key `*` is the shape of all other fields. true is no number.
    """
    if isinstance(shape, dict):
        if not isinstance(value, dict):
            return [f"{path}: an object is wanted"]
        known = {k.removesuffix("?"): k for k in shape if k != "*"}
        out = [f"{path}.{k}: missing" for k, own in known.items() if k not in value and not own.endswith("?")]
        for k, v in value.items():
            if k in known or "*" in shape:
                out += faults(v, shape[known.get(k, "*")], f"{path}.{k}")
            else:
                out.append(f"{path}.{k}: not wanted")
        return out
    if isinstance(shape, list):
        if not isinstance(value, list):
            return [f"{path}: a list is wanted"]
        return [x for i, v in enumerate(value) for x in faults(v, shape[0], f"{path}[{i}]")]
    if isinstance(value, bool) and shape is not bool or not isinstance(value, shape):
        return [f"{path}: {shape.__name__} is wanted"]
    return []


def declines(answer: str) -> bool:
    """Whether an answer declines the task in words, without any JSON."""
    return bool(re.search(_DECLINES, answer)) and not any(b in answer for b in _BRACKETS)


def json_body(c: Column) -> Column:
    return arrow(json_text, "string")(c)


def refusal(c: Column) -> Column:
    return F.coalesce(c.rlike(_DECLINES) & ~c.contains("[") & ~c.contains("{"), F.lit(False))
