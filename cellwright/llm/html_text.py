"""Main text of web pages by line-block distribution.

A page is read once, tag by tag, into lines, one for each block of text. A line
weighs its characters, those inside links ``LINKED`` of that. Landmarks and names
only change weights: lines of an article or main element weigh ``RAISE`` times as
much, lines of a part with the page's first heading ``HEADED`` times, lines of a
part whose class or id names boilerplate a tenth or a hundredth. Menus, headers,
footers, asides, forms and the like, by element or role, are no text at all.

A window slides over the lines and sums their weights; it ends where the kind of
text changes. The page sets its own bound, ``SHARE`` of its heaviest window: where
the sum surges over it text begins, where it dives below text ends, and what lies
between is kept. So a page of few words keeps them, and named parts are kept where
nothing weighs more. If the heaviest window lies in a landmark, text outside must
outweigh it. Lines that stand in the same container as kept ones, and are no more
doubtful, belong to it.

Defined cases: null and empty pages give empty text, others only if all they hold
is no text; unclosed and unmatched tags are closed by what encloses them; a hidden
section that never ends gives way to the article, one with an end tag behind the
article keeps it; repeated rows are read each; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

#: Lines of a window, and the share of the heaviest window that makes text.
LINES, SHARE = 5, 0.2
#: Factors of a line's weight: in a landmark, in a part with an h1, inside a link.
RAISE, HEADED, LINKED = 3.0, 4.0, 0.05
#: How doubtful a part is, and the factor of its lines: plain, doubtful by name, marked by name, no text.
PLAIN, DOUBTFUL, MARKED, NO_TEXT = range(4)
FACTOR = np.array([1.0, 0.1, 0.01, 0.0])

NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
UNQUOTED = re.compile(r"[^>\"']*")
NAMED = re.compile(r"""\b(class|id|role|aria-hidden|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements whose content is no text, read over to their end tag.
OPAQUE = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "object", "canvas", "head", "title")}
BOILER = {"nav", "footer", "aside", "form", "header", "menu", "dialog", "button"}
LANDMARK = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
# Words in class and id that mark what is no main text.
NAMES = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer header login "
    "masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted recommended related reply replies respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Those that mark a part even when other words stand beside them.
STRONG = set(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer menu nav navbar navigation newsletter "
    "pagination popup promo recommended related sidebar sponsor sponsored".split()
)
#: Those that mark an article as none of the page's own, unless a word of state stands beside them.
FOREIGN = set("ad ads advert adverts advertisement advertising comment comments disqus popup promo promoted recommended related reply replies respond sponsor sponsored widget".split())
STATE = {"no", "has", "with", "without", "allow", "open", "closed", "enabled", "disabled"}
#: Elements that hold the text of one part of a page.
CONTAINER = {"div", "section", "blockquote", "table"}
#: With one of these beside it, header or footer belongs to the text itself.
OWN = {"article", "entry", "post", "content", "story"}
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _doubt(tag: str, attrs: str, in_landmark: bool) -> int:
    """How doubtful a part is by its element, role and names."""
    if tag in BOILER and not (tag == "header" and in_landmark):
        return NO_TEXT
    if tag in ("body", "html") or not attrs:
        return PLAIN
    out = PLAIN
    for name, *values in NAMED.findall(attrs):
        value, name = next((v for v in values if v), ""), name.lower()
        if name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES:
            return NO_TEXT
        if name in ("class", "id"):
            for one in value.split():
                words = set(SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", one).lower())) - {""}
                if tag in LANDMARK:
                    if words & FOREIGN and not words & STATE:
                        out = MARKED
                elif words & NAMES and not (words & OWN and words & NAMES <= {"header", "footer"}):
                    sure = words & STRONG and not words & STATE or words <= NAMES
                    out = max(out, MARKED if sure else DOUBTFUL)
    return out


class _Tags:
    """Tags of a page, by one pass: what is known to be missing further on is not looked for again."""

    def __init__(self, page: str):
        self.page, self.last, self.quotes, self.absent = page, page.rfind(">"), True, set()

    def _end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag; once quotes fail to close, the next one ends every tag."""
        first = self.page.find(">", at)
        while self.quotes:
            at = UNQUOTED.match(self.page, at).end()
            if at < len(self.page) and self.page[at] == ">":
                return at
            at = self.page.find(self.page[at], at + 1) + 1 if at < len(self.page) else 0
            self.quotes = at > 0
        return first

    def content_end(self, tag: str, at: int) -> int | None:
        """Place behind the end tag of an element whose content is no text."""
        m = None if tag in self.absent else OPAQUE[tag].search(self.page, at)
        if m is None:
            self.absent.add(tag)
        return m.end() if m else None

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next tag; comments and declarations have no name."""
        page = self.page
        while 0 <= (at := page.find("<", at)) <= self.last:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(page), "", "", ""
            if page.startswith(("<!", "<?"), at):
                return at, page.find(">", at) + 1, "", "", ""
            if m := NAME.match(page, at):
                end = self._end(m.end())
                return at, end + 1, m[1], m[2].lower(), page[m.end() : end]
            at += 1
        return None


class _Part:
    """An open element: what encloses it, its own doubt, outermost landmark, container, nearest part that may hold a heading."""

    __slots__ = ("tag", "ended", "outer", "own", "box", "container", "home", "landmark", "headed", "within", "told", "around")

    def __init__(self, tag: str, outer: _Part | None):
        self.tag, self.ended, self.outer, self.own, self.headed = tag, False, outer, PLAIN, False
        self.box, self.container, self.landmark = (outer.box, outer.container, outer.landmark) if outer else (0, 0, None)
        if tag in LANDMARK and self.landmark is None:
            self.landmark = self
        self.home = self if tag in CONTAINER or tag in LANDMARK else outer.home if outer else None

    def settle(self) -> None:
        """Doubt inside the nearest landmark, and around it; called for the outer element first.

        Around an article, a part never closed is one that ended before.
        """
        above, mark = self.outer, self.tag in LANDMARK
        inherits = above is not None and not mark
        self.within = max(self.own, above.within if inherits else PLAIN)
        sure = self.ended or self.tag in ("aside", "footer", "form")
        self.told = max(self.own if sure else PLAIN, above.told if inherits else PLAIN)
        self.around = max(above.around, above.told if mark else PLAIN) if above else PLAIN

    def has_heading(self) -> bool:
        return any(p is not None and p.headed for p in (self.home, self.landmark))


def page_lines(page: str) -> list[tuple[str, float, int, int, int, bool]]:
    """(text, weight, doubt, outermost landmark, container, mostly links) of each block."""
    out: list[tuple[str, int, _Part | None]] = []
    stack: list[_Part] = []
    every: list[_Part] = []
    opened: Counter = Counter()
    text: list[str] = []
    linked = links = 0
    tags = _Tags(page)

    def close_line() -> None:
        nonlocal linked
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if line:
            out.append((line, max(0, len(line) - linked), stack[-1] if stack else None))
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if links:
            linked += len(piece)

    def leave() -> _Part:
        last = stack.pop()
        opened[last.tag] -= 1
        return last

    at = 0
    while found := tags.next(at):
        start, end, slash, tag, attrs = found
        if start > at:
            add(page[at:start])
        at = end
        if not tag:
            continue
        if tag in OPAQUE:
            if not slash and not attrs.endswith("/"):
                end = tags.content_end(tag, at)
                at = end or (at if tag in ("head", "title") else len(page))
            continue
        if tag in ("br", "td", "th"):
            text.append(" ")
        if tag == "a":
            links = 0 if slash else 1
        if tag in BLOCK or tag in BOILER:
            if slash:
                if opened[tag]:
                    close_line()
                    while (last := leave()).tag != tag:
                        pass
                    last.ended = True
                    links = 0
                elif tag == "p":
                    close_line()
                continue
            close_line()
            links = 0
            if tag in VOID:
                continue
            if stack and (stack[-1].tag == "p" or tag in ("li", "dt", "dd") and stack[-1].tag == tag):
                leave()
            if attrs.endswith("/"):
                continue
            part = _Part(tag, stack[-1] if stack else None)
            every.append(part)
            opened[tag] += 1
            if tag in LANDMARK:
                part.box = part.box or len(every)
            part.own = _doubt(tag, attrs, part.box > 0)
            if tag == "h1" and (part.outer is None or part.outer.own < MARKED):
                for p in (part.home, part.landmark):
                    if p is not None:
                        p.headed = True
            if tag in CONTAINER:
                part.container = len(every)
            stack.append(part)
    rest = page[at:]
    broken = re.search(r"<[a-zA-Z/!]", rest)  # a tag that never ends
    add(rest[: broken.start()] if broken else rest)
    close_line()
    for part in every:
        part.settle()
    lines = []
    for line, free, part in out:
        doubt = max(part.within, part.around) if part else PLAIN
        weight = (free + LINKED * (len(line) - free)) * FACTOR[doubt]
        if part:
            weight *= (RAISE if part.box else 1.0) * (HEADED if part.has_heading() else 1.0)
        lines.append((line, weight, doubt, part.box if part else 0, (part.box or part.container) if part else 0, 2 * free < len(line)))
    return lines


def window_sums(weight: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the window that begins at each line, and the line behind it; ``follows``: the next line may share a window."""
    stop = np.arange(len(weight)) + 1
    for _ in range(LINES - 1):
        stop = np.where(follows[stop - 1], stop + 1, stop)
    total = np.concatenate(([0.0], np.cumsum(weight)))
    return total[stop] - total[:-1], stop


def main_text(page: str | None) -> str:
    """Blocks of the main text, joined by an empty line."""
    lines = page_lines(page or "")
    if not lines:
        return ""
    weight, doubt, box, container, linked = (np.array(x) for x in list(zip(*lines))[1:])
    usable = doubt < NO_TEXT
    follows = np.append(usable[1:] & (box[1:] == box[:-1]) & (doubt[1:] == doubt[:-1]) & (linked[1:] == linked[:-1]), False)
    sums, stop = window_sums(weight, follows)
    sums = np.where(usable, sums, 0.0)
    top = int(sums.argmax())
    if not sums[top] > 0:
        return ""
    surge = sums >= SHARE * sums[top]
    if box[top]:
        surge &= (box > 0) | (sums >= sums[top])
    edge = np.zeros(len(lines) + 1, dtype=np.int64)
    np.add.at(edge, np.flatnonzero(surge), 1)
    np.add.at(edge, stop[surge], -1)
    kept = np.cumsum(edge[:-1]) > 0
    # a container that holds a heavy part of the text holds the lines beside it too, in front of an advert or behind it
    homes = np.unique(container[surge])
    kept |= usable & (doubt <= doubt[kept].max()) & np.isin(container, homes[homes > 0])
    if not homes.any():  # text that stands in no container: what is no mere link belongs together
        kept |= usable & (doubt <= doubt[kept].max()) & (container == 0) & ~linked
    return "\n\n".join(lines[i][0] for i in np.flatnonzero(kept))


def extract(df: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of each page."""

    @F.pandas_udf("string")
    def texts(col: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in col], dtype=object)

    return df.withColumn(out, texts(F.col(page)))


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    got = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text")
    return got.withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op9_html_text": op9_html_text}
ORACLES: dict[str, str] = {}
