"""Main text of web pages by tag-path ratios.

Text nodes of a page are put together by their root-to-leaf tag path. For each path the text length
and the punctuation per node give two ratios; both are smoothed over neighbouring paths, fused, and
the paths above a threshold vote, with their text, for the part of the page that holds the content.
Text under that part is kept but for elements whose name, role or class says that they are not part
of an article (menus, notices, adverts, forms, reader comments and the like). Such a word does not
count for an element that holds the page's first article or, but for names and words of comments, most
of its text. Words that often mean nothing only lower their paths' ratio: dense paths stay.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Neighbouring paths count with exp(-steps^2 / (2 * this^2)), steps between them in the tree.
SMOOTHING = 1.0
#: Paths with at least this share of the page's best fused ratio vote.
THRESHOLD = 0.25
#: The content part is the deepest one with at least this share of the votes.
VOTES = 0.8
#: Share of the page's text outside links above which an element is the page, whatever its class says.
MOST_TEXT = 0.6
#: Factor of the fused ratio of paths with a word of `_LOWERING`.
LOWERED = 0.5
#: Steps beyond which paths are no neighbours (their weight would be below 1/2000).
REACH = 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?¡¿。，、！？؛؟…]")
_SPACES = re.compile(r"\s+")

# Fixed values of the HTML standard: elements without content, with raw content, inside a line, and
# those that end an open element of some other kind.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes template noscript".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
    "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"},
}
_HOLDERS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol td tr pre blockquote".split())
_LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}

# Names, roles and class words of what is not part of an article.
_OUTSIDE = frozenset(
    "nav aside footer form button select fieldset dialog menu object svg canvas audio video head "
    "applet map datalist".split()
)
_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar "
    "form".split()
)
_CLASSES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer foot masthead "
    "topbar toolbar cookie cookies consent gdpr notice notices notification popup modal overlay "
    "newsletter subscribe subscription signup login comment comments commentlist "
    "reply replies respond discussion disqus related recommended recommendations pagination pager".split()
)
_COMMENTS = frozenset(
    "comment comments commentlist reply replies respond discussion disqus related recommended "
    "recommendations".split()
)
_LOWERING = frozenset("share sharing social widget widgets skip hidden".split())
# In a class like has-sidebar or no-comments the other parts say nothing of the element itself.
_ABOUT_OTHERS = frozenset("has have no not with without".split())
_HEADERS = frozenset(["header"])
#: What a mark says: never article text, unless it holds the article, unless it is most of the page.
_FIRM, _LOOSE = 1, 2


def _class_words(value: str) -> set[str]:
    words: set[str] = set()
    for token in value.lower().split():
        parts = set(_WORDS.findall(token))
        if not parts & _ABOUT_OTHERS:
            words |= parts
    return words


def _mark(name: str, rest: str, in_article: bool) -> tuple[int, bool]:
    """Whether an element is marked as outside the article (and how), and whether its ratio is lowered."""
    if name in _OUTSIDE or (name in _HEADERS and not in_article):
        return (_LOOSE if name == "form" else _FIRM), False
    if not rest or name in ("html", "body", "article", "main"):
        return 0, False
    mark, lowered = 0, False
    for key, *values in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id"):
            words = _class_words(value)
            if words & _COMMENTS:
                return _FIRM, False
            if words & _CLASSES or (words & _HEADERS and not in_article):
                mark = _LOOSE
            lowered = lowered or bool(words & _LOWERING)
        elif key == "role" and value in _ROLES:
            mark = _LOOSE
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            return _FIRM, False
        elif key == "style" and "display:none" in value.replace(" ", ""):
            return _FIRM, False
    return mark, lowered


def _label(name: str, rest: str) -> str:
    """Name and classes of a path's step, numbers left out."""
    for key, *values in _ATTRIBUTE.findall(rest) if "class" in rest else ():
        if key.lower() == "class":
            return ".".join([name, *_WORDS.findall("".join(values).lower())])
    return name


class Paths:
    """Tree of tag paths: number of each path, its parent, last step and whether its ratio is lowered."""

    def __init__(self) -> None:
        self.parent, self.step, self.lowered = [-1], [""], [False]
        self._number: dict[tuple[int, str, bool], int] = {}

    def under(self, parent: int, step: str, lowered: bool) -> int:
        key = (parent, step, lowered)
        number = self._number.get(key)
        if number is None:
            number = self._number[key] = len(self.step)
            self.parent.append(parent)
            self.step.append(step)
            self.lowered.append(lowered or self.lowered[parent])
        return number

    def name(self, path: int) -> str:
        return self.step[path].split(".")[0]


def nodes(page: str) -> tuple[Paths, list[tuple[int, int, str, bool]]]:
    """Tag paths and text nodes in page order: (path, block, text, in a link). Blocks number lines of text.

    Text in elements that are outside the article is left out. Linear in the page but for the search
    for the elements that a list item, cell or row ends.
    """
    paths = Paths()
    out: list[tuple[int, int, str, bool]] = []
    within: list[int] = []  # for each text node its innermost marked element
    marked: list[list] = [[0, -1, 0, False]]  # kind, marked element around, text in it, holds the first article
    # name, path, innermost marked element, inline
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
    open_names: Counter[str] = Counter()
    block = at = articles = links = 0
    first_article = True

    def pop() -> None:
        nonlocal block, articles, links
        name, _, inner, inline = stack.pop()
        open_names[name] -= 1
        articles -= name in ("article", "main")
        links -= name == "a"
        block += not inline
        above = stack[-1][2]
        if inner != above:
            marked[above][2] += marked[inner][2]

    def text(piece: str) -> None:
        if piece:
            _, path, inner, _ = stack[-1]
            out.append((path, block, piece, links > 0))
            within.append(inner)
            if not links:
                marked[inner][2] += len(_SPACES.sub(" ", piece).strip())

    end = len(page)
    while at < end:
        token = _TOKEN.search(page, at)
        if not token:
            text(html.unescape(page[at:]))
            break
        text(html.unescape(page[at : token.start()]))
        at = token.end()
        if token["name"] is None:
            if token["data"]:
                text(token["data"])
            continue
        name = token["name"].lower()
        if token["close"]:
            if open_names[name] > 0:
                while stack[-1][0] != name:
                    pop()
                pop()
            elif name == "p":
                block += 1
            continue
        if name in _RAW:
            closing = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            if closing and not token["rest"].endswith("/"):
                at = page.find(">", closing.start()) + 1 or end
            elif not closing:
                at = end
            continue
        if name in _VOID:
            if name in ("br", "wbr"):
                text("\n" if name == "br" else "")
            else:
                block += name == "hr"
            continue
        if name in _ENDS_P:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    while len(stack) > depth:
                        pop()
                    break
                if not stack[depth][3]:
                    break
        elif name in _ENDS:
            stop = _LIMITS.get(name, {"table"})
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in stop:
                    break
                if stack[depth][0] in _ENDS[name]:
                    while len(stack) > depth:
                        pop()
                    if name not in ("tr", "tbody", "tfoot"):
                        break
                    if not any(s[0] in _ENDS[name] for s in stack):
                        break
        mark, lowered = _mark(name, token["rest"], articles > 0)
        inline = name in _INLINE
        _, path, inner, _ = stack[-1]
        if mark:
            marked.append([mark, inner, 0, False])
            inner = len(marked) - 1
        if not inline or lowered:
            path = paths.under(path, _label(name, token["rest"]), lowered)
        stack.append((name, path, inner, inline))
        open_names[name] += 1
        if name in ("article", "main") and first_article:
            first_article = False
            around = inner
            while around > 0:
                marked[around][3] = True
                around = marked[around][1]
        articles += name in ("article", "main")
        links += name == "a"
        block += not inline
    while len(stack) > 1:
        pop()
    # marked elements come after those around them
    whole, outside = marked[0][2], [False]
    for kind, around, size, holds in marked[1:]:
        void = holds or (kind == _LOOSE and size >= MOST_TEXT * whole > 0)
        outside.append(outside[around] or not void)
    return paths, [node for node, inner in zip(out, within) if not outside[inner]]


def _smoothed(paths: Paths, used: list[int], values: list[dict[int, float]]) -> list[dict[int, float]]:
    """Each of `values` at the used paths as a weighted mean over the paths up to `REACH` steps away.

    From path to path one goes k steps up and j down; what lies j below a path is summed once, and the
    branch that one comes from is taken off.
    """
    rows = {p: (1.0, *(v[p] for v in values)) for p in used}
    below: list[dict[int, list[float]]] = [{} for _ in range(REACH + 1)]
    for p, row in rows.items():
        q = p
        for j in range(REACH + 1):
            sums = below[j].setdefault(q, [0.0] * len(row))
            for i, x in enumerate(row):
                sums[i] += x
            q = paths.parent[q]
            if q < 0:
                break
    weights = [math.exp(-(d**2) / (2 * SMOOTHING**2)) for d in range(REACH + 1)]
    out: list[dict[int, float]] = [{} for _ in values]
    for p in used:
        total = [0.0] * (len(values) + 1)
        q, last = p, -1
        for k in range(REACH + 1):
            for j in range(REACH + 1 - k):
                for i, x in enumerate(below[j].get(q, ())):
                    total[i] += weights[k + j] * x
                if j and last >= 0:
                    for i, x in enumerate(below[j - 1].get(last, ())):
                        total[i] -= weights[k + j] * x
            q, last = paths.parent[q], q
            if q < 0:
                break
        for i, mean in enumerate(out, 1):
            mean[p] = total[i] / total[0]
    return out


def content(paths: Paths, found: list[tuple[int, int, str, bool]]) -> set[int]:
    """The paths whose text is the content."""
    length: dict[int, int] = {}
    marks: dict[int, int] = {}
    count: dict[int, int] = {}
    for path, _, text, linked in found:
        if not text.isspace():
            size = len(_SPACES.sub(" ", text).strip())
            length[path] = length.get(path, 0) + (0 if linked else size)
            marks[path] = marks.get(path, 0) + len(_PUNCTUATION.findall(text)) * (not linked)
            count[path] = count.get(path, 0) + 1
    if not length:
        return set()
    used = list(length)
    by_text = {p: length[p] / count[p] for p in used}
    by_marks = {p: marks[p] / count[p] for p in used}
    smooth_text, smooth_marks = _smoothed(paths, used, [by_text, by_marks])
    fused = {}
    for p in used:
        ratio = math.sqrt(max(0.0, smooth_text[p]) * (1 + max(0.0, smooth_marks[p])) * (1 + by_text[p]))
        fused[p] = ratio * (LOWERED if paths.lowered[p] else 1.0)
    best = max(fused.values())

    # parents have smaller numbers than what is under them
    every = range(len(paths.step))
    in_article = [False] * len(every)
    depth = [0] * len(every)
    for p in every[1:]:
        in_article[p] = in_article[paths.parent[p]] or paths.name(p) in ("article", "main")
        depth[p] = depth[paths.parent[p]] + 1
    votes = [0.0] * len(every)
    for p in used:
        if fused[p] >= THRESHOLD * best:
            votes[p] += length[p] * (4 if in_article[p] else 1) + 1e-9
    for p in reversed(every[1:]):
        votes[paths.parent[p]] += votes[p]
    needed = VOTES * votes[0]
    part = max((p for p in every if votes[p] >= needed), key=depth.__getitem__)
    # a paragraph is no part of a page: go up to what holds it
    while part and paths.name(part) in _HOLDERS:
        part = paths.parent[part]
    # an article is kept whole
    p = part
    while p:
        if paths.name(p) in ("article", "main"):
            part = p
        p = paths.parent[p]
    inside = [p == part for p in every]
    for p in every[1:]:
        inside[p] = inside[p] or inside[paths.parent[p]]
    return {
        p for p in every
        if inside[p] and (not paths.lowered[p] or fused.get(p, 0.0) >= THRESHOLD * best)
    }


def extract(page: str | None) -> str:
    """Main text: blocks with their white space as one space, joined by one space."""
    paths, found = nodes(page or "")
    kept = content(paths, found)
    blocks: dict[int, list[str]] = {}
    for path, block, text, _ in found:
        if path in kept:
            blocks.setdefault(block, []).append(text)
    lines = (_SPACES.sub(" ", "".join(pieces)).strip() for pieces in blocks.values())
    return " ".join(line for line in lines if line)


def extract_pages(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """page_id, url, text, n_chars of each page; no shuffle, each row by itself.

    Null and empty html gives an empty text; very long pages are read whole, one at a time. Ids and urls may be null or repeated; other columns are
    not read. No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [extract(page) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return pages.select(
        F.col(id_column).cast("long").alias("page_id"),
        F.col(url_column).cast("string").alias("url"),
        F.col(html_column).cast("string").alias("html"),
    ).mapInArrow(run, "page_id long, url string, text string, n_chars long")
