"""The blocks of an HTML page that can be its text, read as browsers read it: with the end tags that authors leave out.

A stack of open elements says where a block lies. Elements that are never text (menus, forms, adverts and so on) are known by
their tag, role, or the exact words of their class and id; what they hold is left out until they end. One whose end tag never comes
ends where the next part of the page begins.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_GAP = re.compile(r"[\s/]*+")

# Elements by how HTML treats them.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template svg math iframe textarea select object title canvas video audio".split())
# Raw elements that reach to the end of the page if they are not closed.
_RAW_TO_END = frozenset("script style textarea title".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ENDS_P = (_BLOCKS - frozenset("body head html caption dd dt li option optgroup tbody td tfoot th thead tr summary".split())) | {"li", "dd", "dt"}
_CELLS = frozenset("table td th caption".split())
# Element: the open elements that its start ends, and those that this does not reach over.
_ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tbody": (frozenset("tbody thead tfoot tr td th".split()), frozenset(["table"])),
    "thead": (frozenset("tbody thead tfoot tr td th".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot tr td th".split()), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
}
_OPTIONAL_END = frozenset("p li dt dd tr td th tbody thead tfoot option html body head".split())
_NEXT_PART = frozenset("article main section header footer p".split()) | _HEADINGS

# Parts that are not the page's text.
_OFF = frozenset("nav header footer aside form button menu dialog head search".split())
_OFF_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_OFF_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner nav navbar navigation menu "
    "breadcrumb breadcrumbs footer masthead topbar site-header site-footer sidebar cookie cookies consent notice notices newsletter "
    "subscribe popup modal share sharing related comment comments replies disqus disqus_thread".split()
)
_OFF_FIRST = frozenset("ad ads advert cookie cookies comment comments nav menu sidebar newsletter share sharing related promo sponsor sponsored popup modal breadcrumb breadcrumbs".split())
_OFF_LAST = frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar banner ad ads advert advertisement comments popup modal newsletter consent footer".split())
_PARTS = re.compile(r"[-_]+")


@lru_cache(maxsize=4096)
def _off_word(word: str) -> bool:
    word = word.lower()
    if word in _OFF_WORDS:
        return True
    parts = _PARTS.split(word)
    return len(parts) > 1 and (parts[0] in _OFF_FIRST or parts[-1] in _OFF_LAST)


def is_off(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element starts a part that is not text. Headings and paragraphs are only judged by whole words of their class."""
    if tag in ("html", "body", "main"):
        return False
    if tag in _OFF and not (tag == "header" and in_article):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true":
        return True
    if re.search(r"(?:^|;)\s*display\s*:\s*none", attributes.get("style", ""), re.I):
        return True
    if attributes.get("role", "").strip().lower() in _OFF_ROLES:
        return True
    classes = attributes.get("class", "").split()
    if tag == "article":
        return any(c.lower() in ("comment", "reply", "ad", "advert", "promo", "sponsored") for c in classes)
    if tag in _HEADINGS or tag == "p":
        return any(c.lower() in _OFF_WORDS for c in classes)
    return any(map(_off_word, classes)) or any(map(_off_word, attributes.get("id", "").split()))


class _Element:
    __slots__ = ("tag", "off", "article", "block", "loose")

    def __init__(self, tag: str, off: bool, article: bool, loose: bool):
        self.tag, self.off, self.article, self.loose = tag, off, article, loose
        self.block = tag in _BLOCKS


class _Reader:
    def __init__(self, page: str):
        self.page = page
        self.out: list[tuple[str, bool]] = []
        self.held: list[str] = []
        self.stack: list[_Element] = []
        self.off = self.article = 0
        self.last_end: dict[str, int] = {}

    def flush(self) -> None:
        if self.held:
            text = " ".join(entities.unescape("".join(self.held)).split())
            self.held.clear()
            if text:
                self.out.append((text, self.article > 0))

    def pop(self, depth: int) -> None:
        """Closes all elements from this depth on."""
        while len(self.stack) > depth:
            e = self.stack[-1]
            if e.block or e.off:
                self.flush()
            self.stack.pop()
            self.off -= e.off
            self.article -= e.article

    def depth_of(self, tags: frozenset[str], over: frozenset[str]) -> int | None:
        for depth in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[depth].tag
            if tag in tags:
                return depth
            if tag in over:
                return None
        return None

    def closes_later(self, tag: str, at: int) -> bool:
        if tag not in self.last_end:
            found = [m.start() for m in re.finditer(f"</{re.escape(tag)}[\\s/>]", self.page, re.I)]
            self.last_end[tag] = found[-1] if found else -1
        return self.last_end[tag] > at

    def start(self, tag: str, attributes: dict[str, str], at: int, closed: bool) -> None:
        if tag == "br":
            self.keep(" ")
            return
        if tag in _ENDS_P and (depth := self.depth_of(frozenset(["p"]), _CELLS | {"button"})) is not None:
            self.pop(depth)
        if tag in _ENDS:
            ended, over = _ENDS[tag]
            while (depth := self.depth_of(ended, over)) is not None:
                self.pop(depth)
        if tag in _HEADINGS and self.stack and self.stack[-1].tag in _HEADINGS:
            self.pop(len(self.stack) - 1)
        if tag in _NEXT_PART:
            # Parts left out whose end tag never comes end here.
            for depth, e in enumerate(self.stack):
                if e.loose:
                    self.pop(depth)
                    break
        if tag in _BLOCKS:
            self.flush()
        if tag in _VOID or closed:
            return
        off = is_off(tag, attributes, self.article > 0)
        article = not off and (tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article"))
        if off:
            self.flush()
        self.stack.append(_Element(tag, off, article, off and tag not in _OPTIONAL_END and not self.closes_later(tag, at)))
        self.off += off
        self.article += article

    def end(self, tag: str) -> None:
        if tag in _BLOCKS:
            depth = self.depth_of(frozenset([tag]), frozenset() if tag in _CELLS or tag in ("tr", "tbody", "thead", "tfoot") else _CELLS)
            if depth is not None:
                self.pop(depth)
            self.flush()
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth].tag == tag:
                self.pop(depth)
                return
            if self.stack[depth].block:
                return

    def keep(self, text: str) -> None:
        if not self.off:
            self.held.append(text)

    def read(self) -> list[tuple[str, bool]]:
        page, at, size = self.page, 0, len(self.page)
        while at < size:
            next_ = page.find("<", at)
            if next_ < 0:
                self.keep(page[at:])
                break
            if next_ > at:
                self.keep(page[at:next_])
            at = self._markup(next_)
        self.pop(0)
        self.flush()
        return self.out

    def _markup(self, at: int) -> int:
        page, size = self.page, len(self.page)
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return size if end < 0 else end + 3
        m = _TAG.match(page, at)
        if m is None:
            if page.startswith(("<!", "<?", "</"), at):
                end = page.find(">", at)
                return size if end < 0 else end + 1
            self.keep("<")
            return at + 1
        closes, tag = m[1], m[2].lower()
        pos, attributes, closed = m.end(), {}, False
        while True:
            gap = _GAP.match(page, pos)
            closed = gap[0].endswith("/")
            pos = gap.end()
            if pos >= size or page[pos] == ">":
                break
            a = _ATTRIBUTE.match(page, pos)
            if a is None:
                pos += 1
                continue
            attributes.setdefault(a[1].lower(), next((v for v in (a[2], a[3], a[4]) if v is not None), ""))
            pos = a.end()
        pos += 1
        if closes:
            self.end(tag)
        elif tag in _RAW and not closed:
            end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, pos)
            if end is not None:
                stop = page.find(">", end.start())
                return size if stop < 0 else stop + 1
            if tag in _RAW_TO_END:
                return size
        else:
            self.start(tag, attributes, at, closed)
        return pos


def lines(page: str | None) -> list[tuple[str, bool]]:
    """The page's blocks that markup does not rule out, each with whether it lies in a marked article.

    If the page marks an article or main part, only its blocks are left.
    """
    out = _Reader(page or "").read()
    return [x for x in out if x[1]] if any(marked for _, marked in out) else out
