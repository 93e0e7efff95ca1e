"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page; elements that hold no article (nav, form,
footer, ...) and what is not shown leave no line. The text lengths are summed over sliding windows of
lines; the main text lies between the points where that sum surges and where it dives. Short link text
counts for nothing, and a line inside <article> or <main> counts as long unless most text is elsewhere. Class
and id names are hints: a container that they call a sidebar, advert or the like goes, but not if it holds
the page's heading, an article or most of the text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a sliding window, and the length at which a window surges.
WINDOW = 3
SURGE = 80

_ATTRIBUTES = r"(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+"
#: No part of it looks past the next < outside quotes, so a page takes time in proportion to its length.
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|math|object|select)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_ATTRIBUTES}|[^<>]*+)>|<[!?][^<>]*+>",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z:-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: Elements that hold no article text.
DROPPED = frozenset("head nav footer aside button dialog menu".split())
#: Elements that hold none unless they are wrapped around the article.
FORMS = frozenset("form fieldset".split())
MAIN = frozenset("article main".split())
#: Blocks that are lines of the container around them.
PARAGRAPHS = frozenset("blockquote h1 h2 h3 h4 h5 h6 p pre".split())
#: Words in class and id of containers that hold no article text.
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs bottombar comment comments commentlist consent cookie cookies "
    "disqus dropdown feedback footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notification notifications "
    "pager paging pagination popup promo promotion recommended related replies reply respond reviews search share sharing sidebar signin signup skip "
    "social sponsor sponsored subscribe subscription tags teaser toc toolbar topbar widget widgets".split()
)
#: Roles of such containers.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words that only say where or what kind of box the word beside them names.
BESIDE = frozenset(
    "area bar block body bottom box btn button buttons container content footer form global group header holder icons inner item items left link links list main outer "
    "page panel post posts primary region right row secondary section site thread top wrap wrapper".split()
)
#: Words of reader comments, which may well be longer than the article.
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Elements whose class and id are looked at.
NAMED = BLOCKS | {"span", "a", "td", "th"}
KEPT_NAMES = frozenset("html body main".split())
#: Elements whose short text counts for nothing.
LINKS = frozenset("a label legend".split())
SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: A named container with more than this share of the page's text is a wrapper of the article.
WRAPPER = 0.5
#: Characters from which on the text of a link counts like any other.
LONG_LINK = 60
#: The article of a page is what stands in <article> or <main>, unless other text is this many times longer.
OUTSIDE = 3


@dataclass
class Box:
    """A container that is a form, or whose class or id names something other than the article; `holds` an h1 or an article."""

    parent: int
    comments: bool
    plain: int = 0
    holds: bool = False


@dataclass
class Line:
    text: str
    plain: int
    main: bool
    box: int
    tag: str
    container: int
    header: bool


def _dropped(name: str, attributes: str) -> bool:
    """Whether the element itself says that it is no article text, or is not shown."""
    if name in DROPPED:
        return True
    if not attributes.strip() or name not in NAMED or name in KEPT_NAMES:
        return False
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "role" and value.lower() in ROLES):
            return True
        if key == "style" and HIDDEN.search(value):
            return True
    return False


def _named(name: str, attributes: str) -> frozenset[str] | None:
    """The words of a class or id that is wholly made of NOT_ARTICLE words and words BESIDE them, if there is one."""
    if not attributes.strip() or name not in NAMED or name in KEPT_NAMES:
        return None
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        if key.lower() in ("class", "id"):
            for token in (a or b or c).split():
                words = frozenset(w.lower() for w in SPLIT.split(token) if len(w) > 1 and not w.isdigit())
                if words & NOT_ARTICLE and words <= NOT_ARTICLE | BESIDE:
                    return words
    return None


def lines(page: str) -> tuple[list[Line], list[Box]]:
    """The page's blocks in order, and the named containers they stand in (Line.box, -1: none)."""
    out: list[Line] = []
    boxes: list[Box] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int, bool, bool, int]] = []
    opened: Counter[str] = Counter()
    linked = drops = mains = links = headers = link_size = serial = 0
    inside = -1

    def block() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            plain = max(0, len(text) - linked)
            around = islice((e for e in reversed(stack) if e[0] in BLOCKS), 2)
            tag, own = next(((e[0], e[5]) for e in around), ("", 0))
            container = next((e[5] for e in around), 0) if tag in PARAGRAPHS else own
            out.append(Line(text, plain, mains > 0, inside, tag, container, headers > 0))
            if inside >= 0:
                boxes[inside].plain += plain
        parts.clear()
        linked = 0

    def leave() -> None:
        nonlocal drops, mains, links, headers, inside
        name, drop, inside, main, header, _ = stack.pop()
        opened[name] -= 1
        drops -= drop
        mains -= main
        headers -= header
        links -= name in LINKS

    def add(text: str) -> None:
        nonlocal linked, link_size
        if text and not drops:
            parts.append(text)
            if links:
                size = len(" ".join(text.split()))
                if link_size + size < LONG_LINK:
                    linked += size
                elif link_size < LONG_LINK:
                    linked = max(0, linked - link_size)
                link_size += size

    at = 0
    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            block()
        if m[2]:
            if opened[name]:
                while stack[-1][0] != name:
                    leave()
                leave()
        elif name in VOID:
            if name == "br":
                add(" ")
        elif not m[4].endswith("/") or name in BLOCKS:
            if name == "body" and opened["head"]:
                while opened["head"]:
                    leave()
            if name in BLOCKS:
                inner = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCKS), None)
                if inner is not None and (stack[inner][0] == "p" or (name == stack[inner][0] and name in ("li", "dd", "dt", "tr"))):
                    while len(stack) > inner:
                        leave()
            drop, words = _dropped(name, m[4]), _named(name, m[4])
            main, header = name in MAIN and not words, name == "header" and not mains
            serial += 1
            stack.append((name, drop, inside, main, header, serial))
            if (words and name != "header") or name in FORMS:
                boxes.append(Box(inside, bool(words and words & COMMENTS)))
                inside = len(boxes) - 1
            elif inside >= 0 and not drop and not headers and (name in MAIN or name == "h1"):
                boxes[inside].holds = True
            opened[name] += 1
            drops += drop
            mains += main
            headers += header
            links += name in LINKS
            if name in LINKS:
                link_size = 0
            if name in ("td", "th"):
                add(" ")
    add(page[at:])
    block()
    return out, boxes


def _without_boxes(found: list[Line], boxes: list[Box]) -> tuple[list[Line], list[Line]]:
    """The lines outside boxes and inside those that wrap the article: they hold it, or most of the text; and all but comments.

    Reader comments go whatever they hold, and their text is nobody's.
    """
    for box in reversed(boxes):  # a container comes after the one around it
        if box.parent >= 0 and not box.comments:
            boxes[box.parent].plain += box.plain
            boxes[box.parent].holds |= box.holds
    comments, gone = [], []
    for box in boxes:
        comments.append(box.comments or (box.parent >= 0 and comments[box.parent]))
    total = sum(line.plain for line in found if not line.header and (line.box < 0 or not comments[line.box]))
    for box, talk in zip(boxes, comments, strict=True):
        gone.append(talk or (box.parent >= 0 and gone[box.parent]) or not (box.holds or box.plain > WRAPPER * total))
    return [line for line in found if line.box < 0 or not gone[line.box]], [line for line in found if line.box < 0 or not comments[line.box]]


def _between(size: list[int], window: int, surge: int) -> list[bool]:
    """Whether each line lies between surge and dive: lines whose window holds enough text, and the text up to them.

    From there the span reaches over neighbours with text of their own; lines without are never at its ends.
    """
    side = window // 2
    total = [sum(size[max(0, i - side) : i + side + 1]) for i in range(len(size))]
    need = min(surge, max(total, default=0) // 4)
    kept = [t > 0 and t >= need for t in total]
    for step in (1, -1):
        order = range(len(size))[::step]
        on = False
        for i in order:  # what follows a span, up to a line without text
            on = size[i] > 0 and (kept[i] or on)
            kept[i] = kept[i] or on
        edge = True
        for i in order:
            edge = (edge or not kept[i]) and not (kept[i] and size[i])
            kept[i] = kept[i] and not edge
    return kept


def _whole_container(found: list[Line], size: list[int], kept: list[bool]) -> list[bool]:
    """kept with the other paragraphs of the container that directly holds most of the kept text, short links between them too."""
    direct: Counter[int] = Counter()
    for line, n, k in zip(found, size, kept, strict=True):
        if k and line.tag in PARAGRAPHS:
            direct[line.container] += n
    if not direct or 2 * max(direct.values()) < sum(n for n, k in zip(size, kept, strict=True) if k):
        return kept
    home = max(direct, key=direct.__getitem__)
    own = [i for i, (line, n) in enumerate(zip(found, size, strict=True)) if line.container == home and line.tag in PARAGRAPHS and (n or kept[i])]
    inside = lambda i, line: own[0] <= i <= own[-1] and line.container == home and line.tag in PARAGRAPHS
    return [k or inside(i, line) for i, (k, line) in enumerate(zip(kept, found, strict=True))]


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The lines between surge and dive points, joined by a line feed; empty if there are none.

    A header of the page is no article text, but its h1 is the title where the page has no other and no <article> or <main>.
    """
    every, boxes = lines(page or "")
    title = [line for line in every if line.header and line.tag == "h1"]
    if any(line.main or (line.tag == "h1" and not line.header) for line in every):
        title = []
    found, spoken = _without_boxes(every, boxes)
    found = [line for line in found if not line.header]
    if not any(line.plain for line in found):
        found = [line for line in spoken if not line.header]  # names are hints: they never leave a page without its text
    within = sum(line.plain for line in found if line.main)
    if within and OUTSIDE * within >= sum(line.plain for line in found if not line.main):
        size = [max(line.plain, surge) if line.main else 0 for line in found]
        kept = _between(size, window, surge)
    else:
        size = [line.plain for line in found]
        kept = _whole_container(found, size, _between(size, window, surge))
    text = [line.text for line, k in zip(found, kept, strict=True) if k]
    return "\n".join([line.text for line in title] * bool(text) + text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page.

    A null or empty html, and a page without main text, give an empty text; repeated rows get a row each;
    null ids and urls are kept; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(h) for h in batch.pop("html")]
            yield batch.assign(page_id=batch["page_id"].astype("Int64"), text=text, n_chars=[len(t) for t in text])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInPandas(
        run, "page_id long, url string, text string, n_chars long"
    )
