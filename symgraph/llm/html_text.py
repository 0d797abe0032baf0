"""Main text of web pages by tag-path ratios.

A page's text is cut into blocks, each with its path of tags from the root.  Per
path the text length and the punctuation are aggregated as ratios to the number
of blocks, smoothed over the paths in page order, fused by multiplying them, and
compared with a threshold from their spread.  The content is the smallest element
around all text of the chosen paths, without what its tags or class names mark as
menus, adverts, forms, comments and the like.

Defined results: a null or empty page, or one without text, gives an empty string.
Broken markup never fails: unknown or unclosed tags are closed with their parents.
Paths of equal ratio are chosen or rejected together.
Rows are read one by one; repeated rows repeat their result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Set

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|[^<]+|<""", re.S)
NAMES = re.compile(r"""(?i)\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Fixed lists of tags and name parts.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noframes", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "br", "img",
}
BOILER_TAGS = {
    "head", "nav", "header", "footer", "aside", "form", "script", "style", "noscript", "template", "textarea", "title", "iframe", "svg",
    "button", "select", "option", "dialog", "menu", "canvas", "video", "map", "input", "fieldset", "xmp", "noframes",
}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar"}
BOILER_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsbygoogle", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "commentlist", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "hidden", "login", "masthead", "menu",
    "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promoted",
    "recommended", "respond", "share", "sharing", "shoutbox", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe",
    "subscription", "toolbar", "alert",
}
#: An opening tag of a key closes an open element of the value, up to a container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "aside", "nav", "header", "footer", "form", "blockquote"}
P_STOPS = CONTAINERS | {"td", "th", "li", "button"}
PUNCTUATION = re.compile(r"[.,;:!?…]")


def is_boiler(tag: str, attrs: str) -> bool:
    if tag in BOILER_TAGS:
        return True
    if tag in ("html", "body", "article", "main") or not attrs:
        return False
    for m in NAMES.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value in BOILER_ROLES or name == "hidden" and (not value or value == "hidden"):
            return True
        if name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id") and not BOILER_WORDS.isdisjoint(re.split(r"[^a-z]+", re.sub(r"\d", "", value))):
            return True
    return False


class Page:
    """The text blocks of a page outside marked boilerplate, and the elements they stand in.

    Elements are numbered in page order, 0 being the page itself; each knows its
    parent, its tag, the number of its tag path and the last element within it.  All
    steps take time in proportion to the page, however deep its elements are nested.
    """

    def __init__(self, page: str):
        self.parent, self.tag, self.path, self.last = [0], ["#"], [0], [0]
        self.blocks: list[tuple[int, str]] = []  # element, text
        paths: dict[tuple[int, str], int] = {}
        stack, dead = [0], [False]  # open elements; boilerplate or within it
        block = [0]  # by open element the nearest one that is no inline element
        n_open = Counter(["#"])
        text: list[str] = []

        def flush() -> None:
            if text:
                words = html.unescape("".join(text)).split()
                text.clear()
                if words:
                    self.blocks.append((block[-1], " ".join(words)))

        def close(at: int) -> None:
            if any(self.tag[x] not in INLINE for x in stack[at:]):
                flush()
            for x in stack[at:]:
                self.last[x] = len(self.tag) - 1
                n_open[self.tag[x]] -= 1
            del stack[at:], dead[at:], block[at:]

        def nearest(tag: str, stops: Set[str] = frozenset()) -> int | None:
            """Place of the innermost open element of the tag, if it is not beyond one of stops."""
            if not n_open[tag]:
                return None
            for at in range(len(stack) - 1, 0, -1):
                if self.tag[stack[at]] == tag:
                    return at
                if self.tag[stack[at]] in stops:
                    return None
            return None

        pos, end = 0, len(page)
        while pos < end:
            m = TOKEN.match(page, pos)
            pos = m.end()
            tag = m[2]
            if tag is None:
                if not m[0].startswith(("<!", "<?")) and not dead[-1]:
                    text.append(m[0])
                continue
            tag = tag.lower()
            if m[1]:
                # A stray end of an inline or list element does not close its containers.
                at = nearest(tag, frozenset() if tag in CONTAINERS else CONTAINERS)
                if at is not None:
                    close(at)
                elif tag == "p" and not n_open["p"]:
                    flush()
                continue
            if tag == "br":
                if not dead[-1]:
                    text.append(" ")
                continue
            if tag not in INLINE:
                flush()
                if tag not in VOID and tag not in RAW and (at := nearest("p", P_STOPS)) is not None:
                    close(at)
                for other in CLOSES.get(tag, ()):
                    if (at := nearest(other, CONTAINERS)) is not None:
                        close(at)
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, pos)
                pos = stop.end() if stop else end
            elif tag not in VOID and not m[3].endswith("/"):
                x = len(self.tag)
                self.parent.append(stack[-1])
                self.tag.append(tag)
                inline = tag in INLINE
                self.path.append(self.path[stack[-1]] if inline else paths.setdefault((self.path[stack[-1]], tag), len(paths) + 1))
                self.last.append(x)
                stack.append(x)
                block.append(block[-1] if inline else x)
                dead.append(dead[-1] or is_boiler(tag, m[3]))
                n_open[tag] += 1
        flush()
        close(0)

    def around(self, weight: list[int]) -> int:
        """The innermost container that holds all the weight of the elements."""
        total, sums = sum(weight), list(weight)
        inside = 0
        for x in range(len(sums) - 1, 0, -1):  # children come after their parents
            sums[self.parent[x]] += sums[x]
        for x in range(1, len(sums)):
            if sums[x] == total and self.tag[x] in CONTAINERS:
                inside = x  # those that hold all lie one in the other
        return inside


def smoothed(x: list[float]) -> list[float]:
    """Each value as the weighted mean (1, 2, 1) of itself and its neighbours."""
    out = []
    for i, v in enumerate(x):
        near = [v, v, *x[max(0, i - 1) : i], *x[i + 1 : i + 2]]
        out.append(sum(near) / len(near))
    return out


def chosen_paths(page: Page) -> set[int]:
    """The tag paths whose fused ratio of text and punctuation reaches the threshold."""
    size: dict[int, list[int]] = {}
    for x, text in page.blocks:
        s = size.setdefault(page.path[x], [0, 0, 0])
        s[0] += len(text)
        s[1] += len(PUNCTUATION.findall(text))
        s[2] += 1
    length = smoothed([s[0] / s[2] for s in size.values()])
    marks = smoothed([s[1] / s[2] for s in size.values()])
    fused = [a * (b + 0.1) for a, b in zip(length, marks, strict=True)]
    mean = sum(fused) / len(fused)
    spread = (sum((x - mean) ** 2 for x in fused) / len(fused)) ** 0.5
    threshold = min(max(mean - spread, 0.25 * mean), max(fused))
    return {p for p, x in zip(size, fused, strict=True) if x >= threshold}


def main_text(html_text: str | None) -> str:
    page = Page(html_text or "")
    if not page.blocks:
        return ""
    chosen = chosen_paths(page)
    weight = [0] * len(page.tag)
    for x, text in page.blocks:
        if page.path[x] in chosen:
            weight[x] += len(text)
    # What lies outside the element around all chosen text is on rejected paths.
    inside = page.around(weight)
    return "\n".join(text for x, text in page.blocks if inside <= x <= page.last[inside])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            n = pa.array([len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), n], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
