"""Main text of web pages: paragraphs give points to the elements around them, and the best element is read.

A page becomes a tree of elements in one pass over its tags. Menus, headers, footers, sidebars, notices, adverts, forms, scripts and reader
comments are recognised by tag, role or the words of class and id, and take no part; what holds an `article` or `main` always stays, and so
do the parts of it that are no such element. Each block of text is worth a point, one for each comma and one for each 100 characters; its element
gets them all, the next one up half, and so on, and an element's score is discounted by the share of its text that is in links. The text
is that of the best element, or of the `article` or `main` around it, and of its siblings that are headings, blocks of text with few
links, or score a fifth of it.

A block is the text between two edges of block elements. Character references are decoded, white space inside a block becomes one space,
empty blocks are left out, and blocks are joined by an empty line.

Cases: a null or empty page and one of markup alone give an empty text; without tags, the page is one block; tags that are not closed end with
the element around them, those that were not opened are ignored; after a tag whose quotes never end, tags end at the next `>`. Repeated rows
and null ids each give a row; only page_id, url and html are read, so that clashing names do no harm.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption "
    "address details summary hgroup center fieldset header footer nav aside form hr search dialog menu".split()
)
#: Blocks that hold text, not other blocks.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote address caption figcaption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Start tags that end an open element of these kinds, but none outside the second kinds.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}
OUT_TAGS = frozenset("head nav footer aside form button select dialog menu object audio video canvas label search".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words of class and id.
OUT_WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar footer sidebar aside ad ads adv advert adverts advertisement advertising adsense banner "
    "promo promoted promotion sponsor sponsored cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "comment comments disqus respond replies reply share sharing social related recommended recommendations widget toolbar pagination pager search".split()
)
KEEP = frozenset(("article", "main"))
#: Of these words, those that count for an `article` or `main`; and words that say what is elsewhere or absent.
OWN_WORDS = frozenset("ad ads advert advertisement promo promoted sponsored comment comments reply replies related recommended".split())
_ELSEWHERE = re.compile(r"\b(?:has|with|no|without|hide|show)[-_][^\s]+", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ODD = re.compile(r"<[!?]|</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"\s(class|id|role|style|hidden|aria-hidden)(?=[\s=/>]|$)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
#: Blocks of fewer characters give no points; points reach so many elements up.
LEAST, LEVELS = 25, 5
#: Characters of text that a task sends on at once.
HELD = 4_000_000


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", what, ""), ("start", tag, its attributes as text) and ("end", tag, "")."""
    at, quotes, open_ended = 0, True, set()
    while at < len(page):
        begin = page.find("<", at)
        if begin != at:
            yield "text", page[at:begin] if begin >= 0 else page[at:], ""
            if begin < 0:
                return
        tag = (_TAG if quotes else _PLAIN_TAG).match(page, begin)
        if tag is None:
            at = begin + 1
            if page.startswith("<!--", begin):
                at = page.find("-->", begin + 2) + 3
                if at == 2:
                    return
            elif _ODD.match(page, begin):
                at = page.find(">", begin) + 1
                if not at:
                    return
                if page[begin + 1] not in "!?":  # a tag whose quotes do not end
                    quotes, at = False, begin
            else:
                yield "text", "<", ""
            continue
        at = tag.end()
        slash, name, attributes = tag.groups()
        name = name.lower()
        if slash:
            yield "end", name, ""
            continue
        yield "start", name, attributes
        if name in RAW and name not in open_ended and not attributes.endswith("/"):
            close = _END[name].search(page, at)
            if close:
                at = close.start()
            elif name in ("script", "style"):
                return
            else:
                open_ended.add(name)


class Element:
    """What an element hands down to those inside it, and what they give it."""

    __slots__ = ("tag", "parent", "place", "block", "own", "out", "narrow", "in_heading", "in_keep", "length", "linked", "items", "score", "kept")

    def __init__(self, tag: str, parent: Element | None, place: int, reasons: set[str]) -> None:
        self.tag, self.parent, self.place = tag, parent, place
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.in_keep = tag in KEEP or (parent is not None and parent.in_keep)
        self.in_heading = tag in HEADINGS or (parent is not None and parent.in_heading)
        self.own = "out" in reasons or ("header" in reasons and not self.in_keep)
        self.out = self.own or (parent is not None and parent.out)
        self.narrow = "header" in reasons or (parent is not None and parent.narrow)
        self.length, self.linked, self.items, self.score, self.kept = 0, 0, 0, 0.0, False

    def worth(self) -> float:
        return self.score * (1 - self.linked / self.length) if self.length else 0.0

    def around(self) -> Iterator[Element]:
        """The element, and those around it, the innermost first."""
        at: Element | None = self
        while at is not None:
            yield at
            at = at.parent


def _reasons(tag: str, attributes: str, words: bool) -> set[str]:
    """Why an element is no part of an article: "out", or "header", which inside an article holds its headings."""
    found = {"header"} if tag == "header" else {"out"} if tag in OUT_TAGS else set()
    if tag in ("html", "body") or not attributes:
        return found
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "role":
            found |= {"out"} if OUT_ROLES.intersection(value.lower().split()) else set()
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _NOT_SHOWN.search(value)):
            found.add("out")
        elif words and name in ("class", "id"):
            said = {w.lower() for w in _WORD.findall(_ELSEWHERE.sub("", value))} & (OWN_WORDS if tag in KEEP else OUT_WORDS)
            found |= ({"header"} if said == {"header"} else {"out"}) if said else set()
    return found


class Page:
    """A page's elements in their order, and its blocks that take part, as (element, text, characters in links).

    words: class and id are looked at. exempt: places of elements that take part whatever they are.
    """

    def __init__(self, page: str, words: bool = True, exempt: frozenset[int] = frozenset()) -> None:
        root = Element("html", None, 0, set())
        self.elements, self.blocks, self.keeps = [root], [], []
        self._stack, self._open, self._parts = [root], Counter(), []
        for kind, what, attributes in tokens(page):
            if kind == "text" or what == "br":
                if not self._stack[-1].out:
                    self._parts.append((what if kind == "text" else " ", self._open["a"] > 0))
            elif kind == "end":
                self._end(what)
            else:
                if self._open["head"] and (what == "body" or what in BLOCK):
                    self._end("head")
                if what not in ("html", "body"):
                    self._start(what, attributes, words, exempt)
        self._flush()

    def _flush(self) -> None:
        if not self._parts:
            return
        top = self._stack[-1]
        said = lambda parts: _SPACE.sub(" ", references.unescape("".join(parts))).strip()
        text = said(x for x, _ in self._parts)
        if text and not top.block.out and (top.in_heading or not top.narrow):
            linked = [x for x, link in self._parts if link]
            self.blocks.append((top.block, text, min(len(said(linked)), len(text)) if linked else 0))
        self._parts.clear()

    def _pop(self, at: int) -> None:
        self._flush()
        for e in self._stack[at:]:
            self._open[e.tag] -= 1
        del self._stack[at:]

    def _close(self, tags: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        """Ends the outermost open element of these tags inside the innermost of the bounds."""
        if any(self._open[t] > 0 for t in tags):
            found = 0
            for at in range(len(self._stack) - 1, 0, -1):
                if self._stack[at].tag in bounds:
                    break
                if self._stack[at].tag in tags:
                    found = at
            if found:
                self._pop(found)

    def _end(self, tag: str) -> None:
        if self._open[tag] > 0:
            at = next(i for i in range(len(self._stack) - 1, 0, -1) if self._stack[i].tag == tag)
            if tag in BLOCK:
                self._pop(at)
            else:  # what is open inside stays open
                self._open[tag] -= 1
                del self._stack[at]

    def _start(self, tag: str, attributes: str, words: bool, exempt: frozenset[int]) -> None:
        if tag in BLOCK:
            self._close(("p",), ("td", "th", "caption", "button"))
            if tag in CLOSES:
                self._close(*CLOSES[tag])
            self._flush()
        elif tag == "a":
            self._end("a")
        at = len(self.elements)
        element = Element(tag, self._stack[-1], at, set() if at in exempt else _reasons(tag, attributes, words))
        if tag in KEEP:
            self.keeps.append(element)
        self.elements.append(element)
        if tag not in VOID and not (tag in RAW and attributes.endswith("/")):
            self._stack.append(element)
            self._open[tag] += tag != "a" or " href" in attributes.lower().replace("\n", " ")

    def score(self) -> None:
        """Points of blocks for the elements around them, and how much text, and text in links, every element holds."""
        for owner, text, linked in self.blocks:
            owner.length, owner.linked = owner.length + len(text), owner.linked + linked
            if len(text) >= LEAST:
                points = 1 + text.count(",") + len(text) / 100
                at = owner.parent.block if owner.tag in TEXTS and owner.parent else owner
                for level in range(LEVELS):
                    at.score += points / 2**level
                    if at.parent is None:
                        break
                    at = at.parent.block
        for e in reversed(self.elements):
            if e.parent is not None:
                e.parent.length, e.parent.linked = e.parent.length + e.length, e.parent.linked + e.linked
                e.parent.items += e.tag == "li"

    def text(self) -> str:
        self.score()
        found = [e for e in self.elements if e.block is e and e.length and e.tag not in TEXTS]
        if not found:
            return ""
        best = max(found, key=Element.worth)
        inside = [e for e in best.around() if e.tag in KEEP]
        if not best.score:  # nothing but short blocks
            inside = [e for e in self.keeps if e.length]
        top = next((e for e in inside if e.tag == "article"), inside[0] if inside else best)
        for e in self.elements:
            if e.parent is not None and e.parent is top.parent and e is not top:
                beside = e.length and (e.tag in HEADINGS and e.place < top.place or best.score and e.worth() >= best.worth() / 5)
                beside = beside or (top.tag not in KEEP and e.tag in TEXTS and e.length >= LEAST and e.linked < e.length / 4)
            else:
                beside = e is top
            menu = e.tag in ("ul", "ol") and e.items >= 3 and e.linked > 0.9 * e.length
            e.kept = not menu and (bool(beside) or (e.parent is not None and e.parent.kept))
        return "\n\n".join(text for owner, text, _ in self.blocks if owner.kept)


def main_text(page: str) -> str:
    parsed = Page(page)
    if parsed.keeps and all(e.out for e in parsed.keeps):  # the only articles lie in what takes no part, such as a menu that is not closed
        around = frozenset(x.place for e in parsed.keeps if not e.own for x in e.around())
        parsed = Page(page, exempt=around) if around else parsed
    return parsed.text() or Page(page, words=False).text()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (long; code points) of every row of pages: page_id, url, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, texts, held = 0, [], 0
            for i, page in enumerate(batch["html"]):
                texts.append(main_text(page.as_py() or ""))
                held += len(texts[-1])
                if held >= HELD or i + 1 == batch.num_rows:
                    some = batch.slice(begin, len(texts))
                    columns = [some["page_id"], some["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])
                    begin, texts, held = i + 1, [], 0

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
