"""Text rules as column expressions: everything here stays inside the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, functions as F

# White space as Python strings see it, Latin letters below U+0370, Han ranges; as character classes.
SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LATIN = r"A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{2c1}\x{2c6}-\x{2d1}\x{2e0}-\x{2e4}\x{2ec}\x{2ee}"
HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2a6df}\x{2a700}-\x{2b73f}\x{2b740}-\x{2b81f}\x{2b820}-\x{2ceaf}\x{2ceb0}-\x{2ebef}"
# Marks that end a line, that continue it, and that link the halves of a word.
STOP_MARKS = ".!?。！？)）;；]】}>》"
CONTINUE_MARKS = "[【{<《、,，"
LINK_MARKS = "‐‑‒–—―"
# Numeral forms and the brackets or points around them.
NUMERALS = (r"\d+", "[IVXLC]+", "[ivxlc]+", "[一二三四五六七八九十百]+")
WRAPPERS = ((r"\(", r"\)"), ("（", "）"), (r"\[", r"\]"), ("<", ">"), ("", r"\."), ("", r"\)"), ("", "、"))
NUMBERING = "^(?:" + "|".join(f"{a}{n}{z}" for n in NUMERALS for a, z in WRAPPERS) + ")"
# What the marks become next to Han text.
WIDE_AFTER_HAN = {",": "，", ";": "；", "?": "？", "!": "！"}
QUOTES = ("‹›〈〉«»《》", "«»《》")


def python_class(members: str) -> str:
    """A character class of this module as Python's re writes it."""
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), members)


def latin_fold() -> tuple[str, str]:
    """Latin letters that change when lower-cased and stripped of accents, and what they become, for translate()."""
    source, target = [], []
    for code in range(0x370):
        c = chr(code)
        if c.isalpha():
            plain = "".join(d for d in unicodedata.normalize("NFD", c.lower()) if unicodedata.category(d) != "Mn")
            if plain != c:
                source.append(c)
                target.append(plain)
    return "".join(source), "".join(target)


#: Punctuation: category P and four ASCII symbols, without the curly quotes, which titles keep.
PUNCTUATION = r"[\p{P}\^`|~&&[^\x{2018}\x{2019}\x{201c}\x{201d}]]"


#: The characters of SPACE but the plain space, for translate().
ODD_SPACES = "".join(map(chr, (*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def squeeze(c: Column) -> Column:
    """White space to single spaces; a translation and a short pattern cost half of one pattern over the whole class."""
    return F.regexp_replace(F.translate(c, ODD_SPACES, " " * len(ODD_SPACES)), " {2,}", " ")


def collapse(c: Column) -> Column:
    """White space to single spaces, ends trimmed."""
    return F.btrim(squeeze(c), F.lit(" "))


def blank_to_null(c: Column) -> Column:
    """White space to single spaces, untrimmed; null if nothing else is there."""
    squeezed = squeeze(c)
    return F.when(F.btrim(squeezed, F.lit(" ")) != "", squeezed)


def strip_heading(c: Column) -> Column:
    """Leading Markdown heading marks of a chapter title."""
    return F.regexp_replace(c, f"^#+[{SPACE}]+", "")


def strip_contents_heading(c: Column) -> Column:
    """Leading heading marks of a line of a contents page, one to six, with or without space."""
    return F.regexp_replace(c, f"^[{SPACE}]*#{{1,6}}[{SPACE}]*", "")


def title_key(c: Column) -> Column:
    """Canonical text of a title: spaces only between Latin letters, no punctuation, Latin letters folded."""
    x = F.regexp_replace(collapse(c), f" (?:(?<![{LATIN}] )|(?![{LATIN}]))", "")
    return F.translate(F.regexp_replace(x, PUNCTUATION, ""), *latin_fold())


def valid_title(key: Column) -> Column:
    """Long enough to search for: 6 characters with a Latin letter, else 3."""
    return F.length(key) >= F.when(key.rlike(f"[{LATIN}]"), 6).otherwise(3)


def widen_marks(c: Column) -> Column:
    """ASCII marks after Han text to full-width ones; a colon needs Han text on both sides."""
    own = c
    for mark, wide in WIDE_AFTER_HAN.items():
        c = F.regexp_replace(c, f"([{HAN}][{SPACE}]*)[{mark}]", f"$1{wide}")
    c = F.regexp_replace(c, f"([{HAN}][{SPACE}]*):(?=[{SPACE}]*[{HAN}])", "$1：")
    return F.when(own.rlike(f"[{HAN}]"), c).otherwise(own)  # one search where there is no Han text


def unwrap_quotes(c: Column) -> Column:
    """Outer quotes go, inner ones take their place."""
    return F.translate(c, *QUOTES)


def mergeable(left: Column, right: Column, right_nodes: Column | None = None) -> Column:
    """Whether a paragraph that ends with left goes on in right: stop marks, then continue marks, word halves, numbering."""
    a, b = F.regexp_replace(left, f"[{SPACE}]+$", ""), F.regexp_replace(right, f"^[{SPACE}]+", "")
    quote = lambda marks: "".join(f"\\{m}" if m in "[]^\\-{}" else m for m in marks)
    more = F.coalesce(right_nodes, F.lit(1)) > 1 if right_nodes is not None else F.lit(False)
    numbered = b.rlike(NUMBERING) & (more | b.rlike(NUMBERING + f"[{SPACE}]*[^{SPACE}]"))
    return F.coalesce(
        F.when((a == "") | (b == ""), False)
        .when(a.rlike(f"[{quote(STOP_MARKS)}]$"), False)
        .when(a.rlike(f"[{quote(CONTINUE_MARKS)}]$"), True)
        .when(left.rlike(f"[{LATIN}][{LINK_MARKS}]$") & right.rlike(f"^[{LATIN}]"), True)
        .when(numbered, False)
        .when(left.isNotNull() & right.isNotNull(), True),
        F.lit(False),
    )


def split_word(left: Column, right: Column) -> Column:
    """Whether a word is cut between two blocks by a link mark."""
    return F.regexp_replace(left, f"[{SPACE}]+$", "").rlike(f"[{LATIN}][{LINK_MARKS}]$") & F.regexp_replace(right, f"^[{SPACE}]+", "").rlike(f"^[{LATIN}]")


# Beginnings of table titles, of source lines and notes, and of footnotes.
TABLE_TITLE = r"(?i)^(?:table|tab\.?|表|表格)\s*[\d一二三四五六七八九十ivxlcdm]+[\s.:：、-]"
TABLE_NOTE = r"(?i)^(?:source|sources|note|notes|资料来源|来源|注|备注)\s*[:：]"
TABLE_FOOTNOTE = r"(?i)^(?:\d{1,2}[\).、]|[a-z][\).、]|[①-⑳]|[¹²³⁴⁵⁶⁷⁸⁹⁰]+)\s+"


def table_title(c: Column) -> Column:
    """Whether a text can be the title of a table below it."""
    x = collapse(c)
    return F.coalesce((F.length(x) > 0) & (F.length(x) <= 180) & (x.rlike(TABLE_TITLE) | x.rlike("[:：]$")), F.lit(False))


def table_caption(c: Column) -> Column:
    """Whether a text can be a source line or note of a table above it."""
    x = collapse(c)
    return F.coalesce((F.length(x) > 0) & (F.length(x) <= 260) & (x.rlike(TABLE_NOTE) | x.rlike(TABLE_FOOTNOTE) | (F.lower(x) == "category not applicable.")), F.lit(False))


def allowed_url(c: Column) -> Column:
    """Relative paths that start with a slash or dots, web and mail addresses, and the empty address."""
    return (c == "") | c.rlike(r"^(/|\./|\.\./|(?i:https?:|mailto:))")


def letter_id(n: Column) -> Column:
    """0 to A, 25 to Z, 26 to AA, up to three letters."""
    letter = lambda k: F.chr(F.lit(65) + k)
    two, three = n - 26, n - 26 - 676
    return F.when(n < 26, letter(n)).when(two < 676, F.concat(letter(F.floor(two / 26)), letter(two % 26))).otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))


def ramp(start: float, end: float, step: Column, last: int) -> Column:
    """Linear from start to end, reached at step `last`."""
    return F.lit(start) + F.lit(end - start) * F.least(F.greatest(step, F.lit(0)), F.lit(last)) / F.lit(last)


def halving(start: float, end: float, step: Column) -> Column:
    """Half the way to the end with every try."""
    return F.lit(end) - F.lit(end - start) * F.pow(F.lit(0.5), step)


def plain_tag(c: Column) -> Column:
    """Element name without its namespace."""
    return F.regexp_replace(c, r"^\{[^}]*\}", "")


def latin1_only(c: Column) -> Column:
    """Whether a basic font can show the text."""
    return ~c.rlike(r"[^\x{0}-\x{ff}]")


def close_void(c: Column) -> Column:
    """Void HTML elements as XML writes them."""
    return F.regexp_replace(c, r"(?i)<(area|base|br|col|embed|hr|img|input|link|param|source|track|wbr)\b([^<>]*?)\s*/?>", "<$1$2 />")


def fold_lines(c: Column) -> Column:
    """Line breaks of a paragraph to spaces, to nothing between Han characters."""
    wide = r"\x{3000}-\x{303f}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ff00}-\x{ffef}"
    return F.regexp_replace(F.regexp_replace(c, f"([{wide}][^\\S\\n]*)\\n\\s*(?=[{wide}])", "$1"), r"\n\s*", " ")


def escape_markdown(c: Column) -> Column:
    """Backslashes and dollar signs of plain text."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
