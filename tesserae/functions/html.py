"""Text of HTML pages, as pandas functions: one pass over a page yields its text and that of its review widgets."""

import re
from collections import defaultdict
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tesserae.session import ship

EXTRACTOR_VERSION = "text@v2"

# Elements whose content is never read.
HIDDEN = frozenset(("script", "style", "template", "noscript"))

# Review widgets by prefix of a class, class, prefix of an id, prefix of an attribute.
WIDGET_CLASS_PREFIXES = ("jdgm-rev", "loox-review", "oke", "yotpo", "stamped-review", "reviewsio", "ruk_")
WIDGET_CLASSES = ("content-review",)
WIDGET_ID_PREFIXES = ("judgeme",)
WIDGET_ATTRIBUTE_PREFIXES = ("data-oke-",)


def is_widget(attributes: list[tuple[str, str | None]]) -> bool:
    """Whether a start tag opens a known review widget."""
    given = {name.lower(): value or "" for name, value in attributes if name}
    if any(name.startswith(WIDGET_ATTRIBUTE_PREFIXES) for name in given):
        return True
    classes = given.get("class", "").lower().split()
    return given.get("id", "").lower().startswith(WIDGET_ID_PREFIXES) or any(c.startswith(WIDGET_CLASS_PREFIXES) or c in WIDGET_CLASSES for c in classes)


# Names, gaps and attributes of tags as the standard library's parser reads them.
_TAG = re.compile(r"<[a-zA-Z]")
_NAME_ENDS = re.compile(r"[\t\n\r\f />\x00]")
_GAP = re.compile(r"(?:\s|/(?!>))*")
_ATTRIBUTE = re.compile(r"""(?<=['"\s/])([^\s/>][^\s/=>]*)(\s*=+\s*('[^']*'|"[^"]*"|(?!['"])[^>\s]*))?(?:\s|/(?!>))*""")
_END_TAG = re.compile(r"</\s*([a-zA-Z][-.a-zA-Z0-9:_]*)\s*>")
_END_NAME = re.compile(r"[a-zA-Z][^\t\n\r\f />\x00]*")
_SECTION = re.compile(r"[a-zA-Z][-_.a-zA-Z0-9]*\s*")
_CLOSES = {"comment": re.compile(r"--\s*>"), "section": re.compile(r"]\s*]\s*>"), "office": re.compile(r"]\s*>")}
_SECTIONS = dict.fromkeys(("temp", "cdata", "ignore", "include", "rcdata"), "section") | dict.fromkeys(("if", "else", "endif"), "office")
_RAW_ENDS = {name: re.compile(rf"</\s*{name}\s*>", re.IGNORECASE) for name in ("script", "style")}
_UNFINISHED = frozenset("=/abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


class _Collected:
    """The two texts of a page so far. Every tag and comment is a word boundary.

    For the whole page a counter of open hidden elements is enough. For widgets, open elements are kept as (name, in a
    widget, hidden) with both facts inherited, so the innermost one decides; `places` has the depths of each name, so that
    an end tag finds its element, or that there is none, at once.
    """

    def __init__(self):
        self.page, self.reviews = [], []
        self.hidden, self.open, self.places = 0, [("", False, False)], defaultdict(list)

    def boundary(self):
        self.page.append(" ")
        self.reviews.append(" ")

    def data(self, text: str):
        if not self.hidden:
            self.page.append(text)
        _, inside, dark = self.open[-1]
        if inside and not dark:
            self.reviews.append(text)

    def starts(self, tag: str, attributes: list[tuple[str, str | None]]):
        self.boundary()
        hides = tag in HIDDEN
        self.hidden += hides
        _, inside, dark = self.open[-1]
        self.places[tag].append(len(self.open))
        self.open.append((tag, inside or is_widget(attributes), dark or hides))

    def ends(self, tag: str):
        self.boundary()
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if self.places.get(tag):
            depth = self.places[tag][-1]
            for name, _, _ in self.open[depth:]:
                self.places[name].pop()
            del self.open[depth:]


class _Pass:
    """One pass over a page, in time linear in its length whatever is in it.

    It reads what the standard library's parser reads. Where that one looks for an end that is not there, and looks again at
    every later opening, this one remembers: of a comment or section without an end, that there is none from there on; of a
    tag without an end, at which places its attributes began, as a later tag that comes to one of these fails as it did.
    """

    def __init__(self, page: str):
        self.raw, self.found = page, _Collected()
        self.last = page.rfind(">")  # nothing that begins behind it ends
        self.open_ended: set[str] = set()
        self.dead: set[int] = set()
        self.name_end = -1

    def run(self) -> _Collected:
        raw, found, i, n = self.raw, self.found, 0, len(self.raw)
        last = max(self.last, raw.rfind("\x00"))
        while i < n:
            j = raw.find("<", i)
            if j < 0:
                found.data(unescape(raw[i:]))
                break
            if i < j:
                found.data(unescape(raw[i:j]))
            i = j
            if i > last:  # without a > only a name that a NUL cuts off is an end
                found.data(unescape(raw[i:]))
                break
            if _TAG.match(raw, i):
                k = self.start_tag(i)
            elif raw.startswith("</", i):
                k = self.end_tag(i)
            elif raw.startswith("<!--", i):
                k = self.closed("comment", i + 4)
            elif raw.startswith("<?", i):
                k = self.to_gt(i + 2)
            elif raw.startswith("<!", i):
                k = self.declaration(i)
            else:
                found.data("<")
                k = i + 1
            if k is None:  # text inside an element of raw text that never ends is dropped
                break
            if k < 0:  # no end: text up to the next bracket
                k = raw.find(">", i + 1) + 1 if self.last > i else raw.find("<", i + 1)
                k = i + 1 if k < 0 else k
                found.data(unescape(raw[i:k]))
            i = k
        return found

    def to_gt(self, i: int) -> int:
        return self.raw.find(">", i) + 1 if self.last >= i else -1

    def closed(self, kind: str, i: int) -> int:
        """Where a comment or section ends, which is a boundary if it is a comment."""
        end = None if kind in self.open_ended else _CLOSES[kind].search(self.raw, i)
        if end is None:
            self.open_ended.add(kind)
            return -1
        if kind == "comment":
            self.found.boundary()
        return end.end()

    def bogus(self, i: int) -> int:
        end = self.to_gt(i + 2)
        if end >= 0:
            self.found.boundary()
        return end

    def declaration(self, i: int) -> int:
        raw = self.raw
        if raw.startswith("<![", i):
            name = _SECTION.match(raw, i + 3)
            if i + 3 == len(raw) or name and name.end() == len(raw):
                return -1
            kind = _SECTIONS.get(name.group().strip().lower()) if name else None
            return self.closed(kind, i + 3) if kind else self.bogus(i)
        return self.to_gt(i + 9) if raw[i : i + 9].lower() == "<!doctype" else self.bogus(i)

    def end_tag(self, i: int) -> int:
        raw = self.raw
        if self.last <= i:
            return -1
        whole = _END_TAG.match(raw, i)
        if whole:
            self.found.ends(whole.group(1).lower())
            return whole.end()
        name = _END_NAME.match(raw, i + 2)
        if name:
            self.found.ends(name.group().lower())
            return self.to_gt(name.end())
        return i + 3 if raw.startswith("</>", i) else self.bogus(i)

    def start_tag(self, i: int) -> int | None:
        raw = self.raw
        if self.name_end < i + 2:
            end = _NAME_ENDS.search(raw, i + 2)
            self.name_end = end.start() if end else len(raw)
        k, attributes, begun = _GAP.match(raw, self.name_end).end(), [], []
        while True:
            if k in self.dead:
                self.dead.update(begun)
                return -1
            a = _ATTRIBUTE.match(raw, k)
            if a is None:
                break
            begun.append(k)
            attributes.append(a.group(1, 2, 3))
            k = a.end()
        empty = raw.startswith("/>", k)
        if not empty and not raw.startswith(">", k):
            if k == len(raw) or raw[k] in _UNFINISHED:
                self.dead.update(begun)
                return -1
            self.found.data(raw[i:k])
            return k
        if empty:
            self.found.boundary()
            return k + 2
        tag = raw[i + 1 : self.name_end].lower()
        self.found.starts(tag, [(name, value_of(rest, value)) for name, rest, value in attributes])
        if tag not in _RAW_ENDS:
            return k + 1
        end = _RAW_ENDS[tag].search(raw, k + 1)
        return end.start() if end else None


def value_of(given: str | None, value: str | None) -> str | None:
    """An attribute's value without its quotes and character references."""
    if not given:
        return None
    if len(value) > 0 and value[0] == value[-1] and value[0] in "'\"":
        value = value[1:-1]
    return unescape(value)


def read_page(html: str | None) -> tuple[str, str]:
    """White-space-collapsed text of the whole page, and of its review widgets."""
    if not html:
        return "", ""
    found = _Pass(html).run()
    return tuple(" ".join("".join(parts).split()) for parts in (found.page, found.reviews))


def page_text(html: str | None, widgets_only: bool = False) -> str:
    """One of the two texts."""
    return read_page(html)[widgets_only]


def canonical_text(html: Column) -> Column:
    """The readable text of a page; '' for null."""
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(page_text)

    return run(html)


def review_text(html: Column) -> Column:
    """The readable text inside review widgets; '' where there is none."""
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: page_text(p, True))

    return run(html)


def page_texts(html: Column) -> Column:
    """struct<page, reviews>: both texts in one pass to Python and back."""
    ship(SparkSession.active())

    @F.pandas_udf("page string, reviews string")
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_page(p) for p in pages], columns=["page", "reviews"], dtype=object)

    return run(html)


_AT_ONCE = 1 << 20  # bytes that are decoded at once


def decoded(data: Column, charset: Column) -> Column:
    """Bytes as text in the declared charset, else UTF-8; malformed bytes become U+FFFD.

    A batch is decoded in pieces of about `_AT_ONCE` bytes, and what is text of the piece goes back to Arrow before the next.
    """
    ship(SparkSession.active())

    def one(b: bytes | None, name: str | None) -> str | None:
        if b is None:
            return None
        try:
            return b.decode(name or "utf-8", "replace")
        except LookupError:
            return b.decode("utf-8", "replace")

    @F.arrow_udf("string")
    def run(raw: pa.Array, names: pa.Array) -> pa.Array:
        rows = max(1, len(raw) * _AT_ONCE // max(raw.nbytes, 1))
        parts = []
        for at in range(0, len(raw), rows):
            piece = zip(raw.slice(at, rows), names.slice(at, rows), strict=True)
            parts.append(pa.array([one(b.as_py(), n.as_py()) for b, n in piece], pa.string()))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return run(data, charset)
