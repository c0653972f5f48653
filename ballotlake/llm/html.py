"""Main text of HTML pages by tag-path ratios.

Blocks of text are grouped by the path of tags from root to block. Of each path its blocks' mean unlinked
text and mean punctuation are smoothed along the page and fused into one ratio; what tags and names say of
a path only weights it. The container that holds most of the page's ratio is the article: its paths are
content but those whose ratio falls below a share of the article's, and paths beside it are content at a higher share.
Links count against a path, but not within a container that says that it is the article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# a quote that is never closed ends with its tag
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+(?=>|\Z)|[^>]*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?…。，]")
#: Fixed names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title template iframe textarea select button svg canvas".split())
#: Of RAW, those whose text runs to the first end tag, or to the end of the page.
TEXT = frozenset("script style title textarea".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot mstyle semantics".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ITEMS = frozenset("li dt dd td th tr option".split())
LISTS = ("ul", "ol", "dl", "table")
#: Elements that are never the article, by what the contract leaves out.
APART = frozenset("nav header footer aside form head dialog menu".split())
CONTENT = frozenset("article main".split())
#: Words in a class, id or role that speak against or for a path.
NOTICE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|popup|modal|nav\w*|menu|breadcrumbs?|sidebar|side|widget|footer|header|masthead|comments?|replies|disqus|respond|share|social|related|recommend\w*|newsletter|subscribe|login|search|pagination|pager|toolbar|copyright|complementary|contentinfo|navigation)(?:$|[\s_-])", re.I)
REPLIES = re.compile(r"(?:^|[\s_-])(?:comments?|replies|disqus|respond)(?:$|[\s_-])", re.I)
CONTENT_NAME = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|post|entry|story|body|text)(?:$|[\s_-])", re.I)
AGAINST, FOR = 0.01, 4.0  # what those words make of a path's ratio
MOST = 0.8  # share of the page's ratio that the article's container holds
WITHIN, BESIDE = 0.02, 0.5  # shares of the article's ratio that paths within and beside the container need
FLOOR = 0.5  # the least ratio of a content path

_EMPTY = re.compile(r"(?<![^\s\"'/])/\s*\Z|(?:\A|\s)[^\s=\"']+/\s*\Z")  # a slash that ends a tag and no unquoted value


def _ends(page: str, tag: str) -> dict[int, int]:
    """Where each start tag of a name, by its end, has the end of its own end tag: the innermost open one takes an end tag."""
    found: dict[int, int] = {}
    begun: list[int] = []
    for m in re.finditer(rf"<!--.*?-->|<(/?){re.escape(tag)}(?=[\s/>])((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>", page, re.I | re.S):
        if m[1] is None or (not m[1] and _EMPTY.search(m[2])):
            continue
        if not m[1]:
            begun.append(m.end())
        elif begun:
            found[begun.pop()] = m.end()
    return found


class Tree:
    """The paths of a page as numbered prefixes: each has a parent, a tag and a weight."""

    def __init__(self) -> None:
        self.parent, self.tag, self.weight = [-1], [""], [1.0]
        self._of: dict[tuple, int] = {}

    def below(self, parent: int, tag: str, names: str) -> int:
        key = (parent, tag, names)
        at = self._of.get(key)
        if at is None:
            at = self._of[key] = len(self.tag)
            self.parent.append(parent)
            self.tag.append(tag)
            self.weight.append(self.weight[parent] * self._own(tag, names, self.weight[parent]))
        return at

    @staticmethod
    def _own(tag: str, names: str, above: float) -> float:
        if tag in APART:
            return 0.0
        if tag in CONTENT or tag in ("html", "body"):  # such a tag tells more than words that describe its layout
            against, good = names and REPLIES.search(names), tag in CONTENT
        else:
            against, good = names and NOTICE.search(names), names and CONTENT_NAME.search(names)
        return (AGAINST if against and above > AGAINST else 1.0) * (FOR if good and above < FOR else 1.0)


def blocks(page: str) -> tuple[Tree, list[tuple[int, str, int]]]:
    """The page's paths, and its runs of text between block tags: path, text, linked characters. Linear in the page."""
    tree, out = Tree(), []
    stack: list[tuple[str, int, int]] = []  # tag, path, how many tags up to here are no inline tags
    last: dict[str, list[int]] = {}  # where in the stack each tag is open
    text: list[str] = []
    linked = at = 0
    ends: dict[str, dict[int, int]] = {}

    def place(tag: str) -> int:
        return last[tag][-1] if last.get(tag) else -1

    def flush() -> None:
        nonlocal linked
        if text:
            said = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if said:
                out.append((stack[-1][1] if stack else 0, said, linked))
            text.clear()
        linked = 0

    def close(upto: int) -> None:
        while len(stack) > upto:
            last[stack.pop()[0]].pop()

    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at:
            text.append(page[at : m.start()])
            linked += (m.start() - at) * bool(last.get("a"))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or at == m.start():
            at = max(at, m.start() + 1)
            continue
        if m[1]:
            if tag not in INLINE:
                flush()
            k = place(tag)
            if k >= 0 and (tag not in INLINE or stack[-1][2] == stack[k][2]):
                close(k)
            continue
        if tag in RAW:
            if m[3] and _EMPTY.search(m[3]):
                continue
            if tag in TEXT:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            else:  # without an end tag of its own only the tag is skipped
                if tag not in ends:
                    ends[tag] = _ends(page, tag)
                at = ends[tag].get(at, at)
            continue
        if tag not in INLINE:
            if tag in ("br", "wbr"):
                text.append(" ")
                continue
            flush()
            if tag in CLOSES_P:
                k = place("p")
            else:
                k = place(tag) if tag in ITEMS else -1
                k = k if k > max(map(place, LISTS)) else -1
            if k >= 0:
                close(k)
        if tag in VOID:
            continue
        names = " ".join(a or b or c for a, b, c in _NAME.findall(m[3])) if m[3] else ""
        _, path, solid = stack[-1] if stack else ("", 0, 0)
        last.setdefault(tag, []).append(len(stack))
        stack.append((tag, path, solid) if tag in INLINE and not names else (tag, tree.below(path, tag, names), solid + (tag not in INLINE)))
    if at < len(page):
        text.append(page[at:])
    flush()
    return tree, out


def _smooth(x: np.ndarray) -> np.ndarray:
    """A Gaussian window over neighbouring blocks, the block itself at least as strong as all of them."""
    kernel = np.array([0.05, 0.2, 0.5, 0.2, 0.05])
    return np.convolve(np.pad(x, 2, mode="edge"), kernel, "valid")


def ratios(tree: Tree, of: np.ndarray, size: np.ndarray, marks: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of blocks with a path, characters, punctuation and linked characters: each path's fused ratio, its share of the page's, and the ratio with links as text like any other.

    All are over all paths of the tree; paths without blocks have zero. If all text is linked, shares are of the ratio with links.
    """
    n = len(tree.tag)
    times = np.maximum(1, np.bincount(of, minlength=n))
    per_path = lambda x: np.bincount(of, x, minlength=n) / times
    free = np.maximum(0, size - linked)
    weight = np.array(tree.weight)
    points = 1 + per_path(_smooth((np.log1p(per_path(marks)) * np.minimum(weight, 1))[of]))
    # weighted first, so that menus lend nothing to what is beside them
    length, whole = (per_path(_smooth((np.log1p(per_path(x)) * weight)[of])) * points * np.minimum(1, weight) ** 0.5 * (weight > 0) for x in (free, size))
    fused = length * (per_path(free) / np.maximum(1, per_path(size)))
    mass = fused * per_path(free) * times
    if not mass.any():
        mass = whole * per_path(size) * times
    return fused, mass / max(1e-12, mass.sum()), whole


def main_text(page: str) -> str:
    """The article's blocks in page order, joined by newlines; empty if there are none."""
    tree, found = blocks(page)
    if not found:
        return ""
    of = np.array([p for p, *_ in found])
    size = np.array([len(t) for _, t, _ in found], float)
    marks = np.array([len(_PUNCT.findall(t)) for _, t, _ in found], float)
    linked = np.minimum(size, np.array([k for *_, k in found], float))
    fused, mass, whole = ratios(tree, of, size, marks, linked)
    under = mass.copy()  # of a path and all below it: parents come before children
    for p in range(len(under) - 1, 0, -1):
        under[tree.parent[p]] += under[p]
    children: dict[int, int] = {}
    for p in range(1, len(under)):
        if under[p] - mass[p] >= MOST:  # what lies strictly below p, so that a container is chosen and no paragraph
            children[tree.parent[p]] = p
    box = 0
    while box in children:
        box = children[box]
    within = np.zeros(len(mass), bool)
    within[box] = True
    for p in range(box + 1, len(mass)):
        within[p] = within[tree.parent[p]]
    article = float((np.where(fused.any(), fused, whole) * mass).sum())
    # within a container that says that it is the article, lists and paragraphs of links are its text, unless their names say
    # otherwise; elsewhere links speak against a path
    ratio = np.where(within & (tree.weight[box] >= FOR) & (np.array(tree.weight) >= 1), whole, fused)
    chosen = (ratio > np.where(within, WITHIN, BESIDE) * article) & (ratio > FLOOR)
    keep = chosen[of]
    weight = np.array(tree.weight)[of]
    heads = np.array([tree.tag[p] in ("h1", "h2", "h3", "h4") for p in of]) & (weight >= 1) & (linked < 0.7 * size)
    keep |= heads & np.r_[keep[1:], False]  # a heading belongs to the content after it
    return "\n".join(t for (_, t, _), k in zip(found, keep) if k)


_ROW = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html, any others).

    Null and empty html give an empty text, as do pages without content; repeated rows keep a row each, an empty
    table none. Pages of any length and depth are read in time in proportion to their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, _ROW)
