"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block of the page. Scripts, styles, forms and other parts
without prose vanish; so do menus, headers, footers, sidebars, notices, adverts and comments that
their element or its class, id or role names. They leave empty lines behind, as do lines of links.
Over a sliding window of ``WINDOW`` lines the text lengths are summed: where the sum surges over
the threshold a body of text begins, where it falls to nothing it ends. All text inside the page's
``article`` or ``main`` is kept, if it has one with text, also what is a link. Otherwise bodies that hold
a fair share of the longest one are kept with all lines between the first and the last of them, and
all lines in the element that holds most of the longest one; lines of links aren't.

Null and empty pages have empty text. Nothing is cut from long pages. Broken markup never fails:
an element whose end tag may be left out (a paragraph, item or cell) ends where HTML ends it, another
one that is never closed where a landmark or the page does. Repeated rows give
repeated results.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweft.llm.text import by_piece

WINDOW, SURGE, SHARE = 3, 60, 0.2
#: A comment, character data, a declaration or a tag; each ends where the page does at the latest, so nothing is read twice. A quote opens a value only after "=".
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)", re.S)
#: Elements whose content is text for nobody; their content may hold anything that looks like markup.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "title", "xmp", "noembed", "noframes"}
DROPPED = {"nav", "footer", "aside", "form", "select", "button", "svg", "canvas", "object", "audio", "video", "map", "menu", "dialog", "fieldset", "datalist", "math", "head"}
#: Dropped elements that are things in a text rather than parts of a page.
THINGS = {"select", "button", "svg", "canvas", "object", "audio", "video", "map", "math", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
LANDMARK = {"article", "main", "body", "html"}
#: Parts of tables by depth: a tag ends what is open of its own depth and deeper.
CELLS = {"colgroup": 1, "caption": 1, "thead": 1, "tbody": 1, "tfoot": 1, "tr": 2, "td": 3, "th": 3}
#: Elements whose end tag may be left out.
OMITTED = {"p", "li", "dt", "dd", "option", "optgroup", *CELLS}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that are a part of what their parent holds.
PARTS = {"section", "ul", "ol", "dl", "blockquote", "figure"}
#: Elements whose start ends an open paragraph.
BLOCK = HEADINGS | {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "dt", "dd", "fieldset", "figcaption", "figure", "footer", "form", "header", "hgroup", "hr", "li", "listing", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"}
#: Elements that a tag inside them doesn't end.
SCOPE = {"table", "td", "th", "caption", "object", "button", "marquee", "html"}
#: Words of classes, ids and roles that name what isn't the article.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|widget\w*|footer|foot|header|masthead|topbar|toolbar|"
    r"comments?|commentlist|disqus|replies|reply|respond|discussion|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|"
    r"related|recommend\w*|pagination|pager|copyright|disclaimer|legal|skip|search|searchform|tags|tagcloud|complementary|contentinfo|alert)(?:$|[\s_-]|\d)", re.I
)
#: Names of what readers wrote; such parts may hold articles of their own.
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|reply|respond|discussion)(?:$|[\s_-]|\d)", re.I)
#: Parts of a class that say what else a page has.
ABOUT_PAGE = re.compile(r"(?<![\w-])(?:has|with|no|without|is)-[\w-]+", re.I)
#: Dropped parts that stand in the middle of an article as well; they leave one empty line, others end a body.
PASSING = re.compile(r"(?:^|[\s\"'=_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|share|sharing|social|newsletter|related|widget\w*|popup|notice)", re.I)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)


#: Words that make a name of such a part longer without naming anything else.
FORMS = set("area bar block box bottom button buttons container disclosure global group icons inline inner label left line link links list main mobile module outer page panel placement post posts primary region right row secondary section site slot space sticky top unit us wrap wrapper".split())


def named(value: str, names: re.Pattern, whole: bool) -> bool:
    """Whether a class, id or role names a part that isn't the article. whole: only if a name has no other word, as "share-buttons", not "side-effects"."""
    value = ABOUT_PAGE.sub("", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value))
    if not whole:
        return bool(names.search(value))
    for name in value.lower().split():
        words = [w for w in re.split(r"[-_\d]+", name) if w]
        if words and any(map(names.search, words)) and all(w in FORMS or names.search(w) for w in words):
            return True
    return False


def boilerplate(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element isn't part of the article. inside: it stands in an article, where a header is the article's own."""
    if name in DROPPED:
        return True
    if name == "header":
        return not inside
    if not attributes or name in ("main", "body", "html") or name in VOID:
        return False
    names = READERS if name == "article" else NAMES
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name in HEADINGS or inside and key == "id" and name in PARTS:
            continue  # what a heading or section is about
        if key in ("class", "id", "role") and named(value, names, inside or key == "id"):
            return True
    return False


class Open:
    """The elements that are open, without inline ones; ``last`` and ``first_after`` don't walk through them."""

    def __init__(self):
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.firm: list[int] = []  # places of elements that an open item doesn't reach through

    def __len__(self) -> int:
        return len(self.names)

    def push(self, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        if name not in ("div", "p", "address") and "-" not in name:
            self.firm.append(len(self.names))
        self.names.append(name)

    def cut(self, n: int) -> None:
        while len(self.names) > n:
            self.places[self.names.pop()].pop()
        while self.firm and self.firm[-1] >= n:
            self.firm.pop()

    def last(self, names, below: int) -> int:
        """The innermost place below ``below`` of any of the names, or -1."""
        out = -1
        for x in names:
            places = self.places.get(x)
            if places:
                k = bisect_left(places, below)
                if k:
                    out = max(out, places[k - 1])
        return out

    def first_after(self, names, place: int) -> int:
        """The outermost place after ``place`` of any of the names, or the number of open elements."""
        out = len(self.names)
        for x in names:
            places = self.places.get(x)
            if places:
                k = bisect_right(places, place)
                if k < len(places):
                    out = min(out, places[k])
        return out


def staying(stack: Open, name: str, closing: bool) -> int:
    """How many of the open elements are still open after a tag, by HTML's rules for end tags that are left out."""
    n = len(stack)
    if closing:
        same = HEADINGS if name in HEADINGS else {name}
        bounds = {"table"} if name == "table" or name in CELLS else SCOPE | {"ul", "ol"} if name == "li" else SCOPE
        k = stack.last(same, n)
        return k if k >= 0 and k >= stack.last(bounds, n) else n
    if name in CELLS:
        ended = ["caption", "colgroup", *(c for c, depth in CELLS.items() if depth >= CELLS[name])]
        return stack.first_after(ended, stack.last(("table",), n))
    if name in ("option", "optgroup"):
        while n and (stack.names[n - 1] == "option" or stack.names[n - 1] == name):
            n -= 1
        return n
    if name in ("li", "dt", "dd") and stack.firm and stack.names[stack.firm[-1]] in ({"li"} if name == "li" else {"dt", "dd"}):
        n = stack.firm[-1]
    if name in BLOCK:
        k = stack.last(("p",), n)
        if k >= 0 and k > stack.last(SCOPE, n):
            return k
    return n


def lines(page: str) -> tuple[list[tuple[str, int, bool]], list[int], list[tuple[int, str]]]:
    """(text, characters in links, inside an article) of each block, "" where something was taken away; the element of each block; (parent, name) of the elements."""
    out: list[tuple[str, int, bool]] = []
    owner: list[int] = []
    tree = [(0, "")]  # the page itself; parents come before their children
    where: list[int] = []  # numbers of the open elements
    text: list[str] = []
    links = held = 0
    open_ = Open()
    endless: set[str] = set()  # elements that no further tag ends
    skipped, depth, gap = "", 0, 1  # the element that is being dropped, how often it is open inside itself, and the empty lines it leaves
    base = 0  # its place among the open elements
    readers = False  # it holds what readers wrote
    articles = anchors = 0
    at, end = 0, len(page)

    def close() -> None:
        nonlocal links
        line = " ".join("".join(text).split())
        if line:
            out.append((line, links, articles > 0))
            owner.append(where[len(open_) - 1] if open_ else 0)
        text.clear()
        links = 0

    def ended(name: str, at: int) -> re.Match | None:
        stop = None if name in endless else re.compile(rf"</{name}\b[^>]*+>", re.I).search(page, at)
        if not stop:
            endless.add(name)
        return stop

    while at < end:
        m = TOKEN.search(page, at)
        if m and m[3] and not m[4] and m.end() == end and page[-1] != ">":
            m = None  # a page that ends in a tag's name: it may be text
        piece = page[at : m.start() if m else end]
        if piece and not skipped:
            piece = unescape(piece)
            text.append(piece)
            if anchors:
                links += len(piece.strip())
        if not m:
            break
        at = m.end()
        if m[1] is not None and not skipped:
            text.append(m[1])
        name = (m[3] or "").lower()
        if not name:
            continue
        closing, alone = bool(m[2]), m[4].endswith("/")
        if name in RAW:
            if not closing and not alone:
                stop = ended(name, at)
                at = stop.end() if stop else (at if name in ("noscript", "title") else end)
            continue
        left = len(open_) if name in INLINE else staying(open_, name, closing)
        if skipped:
            if skipped in OMITTED:
                own = closing and left == base and name == skipped
                depth = int(left > base)
            elif name == skipped:
                depth += -1 if closing else 1
                own = not depth
            else:
                own = False
            if name != skipped and not readers and name in LANDMARK and (not closing and name in ("article", "main") or closing):
                depth = 0  # it was never closed
            if depth:
                if skipped in OMITTED and name not in INLINE:
                    open_.cut(left)
                    if not closing and not alone and name not in VOID:
                        open_.push(name)
                continue
            skipped = ""
            open_.cut(base)
            left = min(left, base)
            out.extend([("", 0, False)] * gap)
            owner.extend([0] * gap)
            if own:
                continue
        if name in INLINE and name not in VOID:
            if not closing and boilerplate(name, m[4], articles > 0) and not alone:
                if ended(name, at):
                    skipped, depth, gap, readers, base = name, 1, 1, False, len(open_)
            elif name == "a":
                anchors = 0 if closing else 1
            continue
        if name == "br":
            text.append("\n")
            continue
        if name == "img" or name == "wbr":
            continue
        close()
        open_.cut(left)
        if closing:
            if name in ("article", "main"):
                articles = max(0, articles - 1)
            continue
        if name in VOID or alone:
            continue
        del where[len(open_) :]
        tree.append((where[-1] if where else 0, name))
        open_.push(name)
        where.append(len(tree) - 1)
        if boilerplate(name, m[4], articles > 0):
            readers = bool(READERS.search(re.sub(r"[\"'=]", " ", m[4] or "")))
            skipped, depth, base, gap = name, 1, len(open_) - 1, 1 if name in THINGS or name not in ("nav", "header", "footer") and PASSING.search(m[4] or "") else WINDOW
        elif name in ("article", "main"):
            articles += 1
    close()
    return out, owner, tree


def bodies(blocks: list[tuple[str, int, bool]], surge: int) -> list[tuple[int, int]]:
    """Runs of lines between a surge of the windowed length and its dive."""
    size = [0 if 2 * links > len(t) else len(t) for t, links, _ in blocks]
    sums = [sum(size[i : i + WINDOW]) for i in range(len(size))]
    out, i = [], 0
    while i < len(size):
        if size[i] and sums[i] >= surge:
            j = i
            while j < len(size) and sums[j]:
                j += 1
            out.append((i, j))
            i = j
        else:
            i += 1
    return out


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by one space."""
    blocks, owner, tree = lines(page or "")
    inside = [t for t, _, article in blocks if t and article]
    if inside:
        return " ".join(inside)
    found = bodies(blocks, SURGE) or bodies(blocks, 1)
    if not found:
        return ""
    size = [sum(len(t) for t, _, _ in blocks[a:b]) for a, b in found]
    strong = [x for x, n in zip(found, size) if n >= SHARE * max(size)]
    # the element that holds most of the longest body
    a, b = found[size.index(max(size))]
    held: dict[int, int] = {}
    for k in range(a, b):
        if blocks[k][0]:
            parent = tree[owner[k]][0]
            held[parent] = held.get(parent, 0) + len(blocks[k][0])
    top = max(held, key=held.__getitem__)
    while tree[top][1] in PARTS:
        top = tree[top][0]
    under = [top == 0]
    for k in range(1, len(tree)):
        under.append(k == top or under[tree[k][0]])
    return " ".join(t for k, (t, links, _) in enumerate(blocks) if t and 2 * links <= len(t) and (strong[0][0] <= k < strong[-1][1] or under[owner[k]]))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) of every row; the text is empty if there is none."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([main_text(x) for x in batch.column("html").to_pylist()], pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    return rows.mapInArrow(by_piece(run, "html"), "page_id long, url string, text string")
