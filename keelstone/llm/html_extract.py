"""Main-text extraction with site template removal.

Each page is parsed into elements, and containers get a hash of their subtree: names,
texts and children.  Spark counts, per host, in how many different pages a subtree
occurs; those that recur are the site's template and are deleted before the main
region is looked for and its text is read.  Pages that hold the same article count once,
so an article that a site publishes many times is not taken for its template.  What
is on too few pages to be counted is ruled out by the page's own mark-up: menus, page
headers and footers, sidebars, forms, scripts and the like, by element, role or class.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelstone.llm._common import free_name, materialise
from keelstone.llm.url_filter import url_host

#: A subtree in this many different pages of a host is template.
MIN_PAGES = 5
#: Template subtrees that are broadcast (8 bytes each, and 8 for each of their hosts); beyond, they are joined to their pages.
BROADCAST_SUBTREES = 1_000_000

# Names of elements, roles and class words.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_DROP = frozenset("head nav footer aside form script style noscript template iframe svg button select option textarea input dialog menu object canvas title math audio video map xmp noembed noframes".split())
_BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
_CLOSES_P = _BLOCK - frozenset("html body tbody tfoot thead tr caption".split())
_CONTAINERS = frozenset("address aside center dir div dl details fieldset figure footer form header menu nav ol section table ul".split())
_LOOSE = _CONTAINERS | frozenset("p li h2 h3 h4 h5 h6 blockquote dt dd tr".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_CLASS_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar pagination pager "
    "share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus widget widgets skyscraper".split()
)
_CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
# What may stand in a head; any other element, and text, ends a head that is open.
_IN_HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
_STOPS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}

_START = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_DECLARATION = re.compile(r"<[!?]")
_QUOTED = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*)({_QUOTED})>")
_NAME, _VALUES = re.compile(r"</?[a-zA-Z][^\s/>]*"), re.compile(_QUOTED)
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_SEP = re.compile(r"[\s_-]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """An element: boilerplate by its own mark-up, or gone as part of its site's template; ``holds`` an article or main element."""

    __slots__ = ("name", "kids", "boiler", "gone", "hash", "holds")

    def __init__(self, name: str, boiler: bool = False):
        self.name, self.kids, self.boiler, self.gone, self.hash, self.holds = name, [], boiler, False, 0, False


def _boiler(name: str, attrs: str) -> bool:
    """Whether an element is no part of a main text by its name, role or class."""
    if name in _DROP:
        return True
    if not attrs or name in ("html", "body", "main"):
        return False
    for key, *values in _ATTR.findall(attrs):
        value = next((v for v in values if v), "")
        key = key.lower()
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "role" and value.lower() in _ROLES:
            return True
        if key in ("class", "id") and not _CLASS_WORDS.isdisjoint(_SEP.split(_CAMEL.sub("-", value).lower())):
            return True
    return False


def _marks(source: str):
    """Tags and declarations in order, as (start, end, match of a tag or None); the caller may send where to go on.

    Takes linear time.  A tag ends at the first ``>`` outside quotes, or at the first one if
    a quote is not closed; once that has happened, quotes are not heeded up to the place
    where the search for their end gave up.  What has no end is text, but a
    declaration or comment goes on to the end of the page.
    """
    at, n, last, blind = 0, len(source), source.rfind(">"), 0
    while m := _START.search(source, at):
        start, tag = m.start(), None
        if start > last and not (m := _DECLARATION.search(source, start)):
            return
        if source[m.start() + 1] in "!?":
            start = m.start()
            shut = "-->" if source.startswith("<!--", start) else ">"
            end = source.find(shut, start + len(shut) + 1)
            end = end + len(shut) if end >= 0 else n
        else:
            if start >= blind:
                tag = _TAG.match(source, start)
                if tag is None:
                    blind = _VALUES.match(source, _NAME.match(source, start).end()).end()
            if tag is None:
                tag = _PLAIN_TAG.match(source, start)
            end = tag.end()
        at = (yield start, end, tag) or end


class _Open:
    """The elements that are open; closing and looking one up take constant time for each element."""

    def __init__(self, root: Node):
        self.stack, self.places, self.blocks = [root], {}, [0]

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.places.setdefault(node.name, []).append(at)
        self.blocks.append(at if node.name in _BLOCK else self.blocks[-1])

    def last(self, names) -> int:
        """Where the innermost open element of these names stands, or 0."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=0)

    def close(self, at: int) -> None:
        """Closes the element there and all in it."""
        while len(self.stack) > at:
            self.places[self.stack.pop().name].pop()
            self.blocks.pop()

    def end_head(self) -> None:
        while self.stack[-1].name == "head":
            self.close(len(self.stack) - 1)


def parse_html(source: str) -> Node:
    """The element tree of a page; texts are strings among the children, references decoded."""
    root = Node("#root")
    tree, at, n = _Open(root), 0, len(source)
    stack = tree.stack

    def add(text: str) -> None:
        text = html.unescape(text)
        if stack[-1].name == "head" and not text.isspace():
            tree.end_head()
        stack[-1].kids.append(text)

    marks, go_on = _marks(source), None
    while True:
        try:
            start, end, tag = marks.send(go_on)
        except StopIteration:
            break
        if start > at:
            add(source[at:start])
        at, go_on = end, None
        if tag is None:
            continue
        name, attrs = tag[2].lower(), tag[3]
        if tag[1]:
            if where := tree.places.get(name):
                tree.close(where[-1])
            continue
        if stack[-1].name == "head" and name not in _IN_HEAD:
            tree.end_head()
        if name in _CLOSES_P and stack[tree.blocks[-1]].name == "p":
            tree.close(tree.blocks[-1])
        if name in _CLOSED_BY and (i := tree.last(_CLOSED_BY[name])) > tree.last(_STOPS[name]):
            tree.close(i)
        node = Node(name, _boiler(name, attrs))
        stack[-1].kids.append(node)
        if name == "article" or name == "main":
            node.holds = True
            for x in reversed(stack):  # an element that holds one is in others that do
                if x.holds:
                    break
                x.holds = True
        if name in _VOID or attrs.endswith("/") and name not in _RAW:
            continue
        if name in _RAW:
            stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, at)
            node.kids.append(source[at : stop.start() if stop else n])
            close = source.find(">", stop.start()) if stop else n
            at = go_on = close + 1 if 0 <= close < n else n
            continue
        tree.push(node)
    if at < n:
        add(source[at:])
    return root


def _walk(node: Node):
    """All elements, parents first, without recursion."""
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(k for k in reversed(x.kids) if isinstance(k, Node))


def _headings(header: Node) -> list[Node]:
    """The outermost headings of a header that are not in a part ruled out."""
    found, todo = [], [header]
    while todo:
        x = todo.pop()
        if x is not header and (x.boiler or x.gone):
            continue
        if x.name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            found.append(x)
        else:
            todo.extend(k for k in reversed(x.kids) if isinstance(k, Node))
    return found


def main_regions(root: Node) -> tuple[list[Node], bool]:
    """The outermost articles, else the outermost main elements, else the whole page; and whether it is marked."""
    for wanted in ("article", "main"):
        found, todo = [], [root]
        while todo:
            x = todo.pop()
            # a class word on an element around the article rules nothing out
            wraps = x.holds and x.boiler and x.name not in _DROP and x.name != "article"
            if x.gone or x.boiler and not wraps:
                continue
            if x.name == wanted:
                found.append(x)
            else:
                todo.extend(k for k in reversed(x.kids) if isinstance(k, Node))
        if found:
            return found, True
    return [root], False


def _hash_all(root: Node) -> dict[int, int]:
    """Subtree hashes, children first, and the length of text below each element (by id)."""
    sizes = {}
    for x in reversed(list(_walk(root))):
        parts, size = [x.name], 0
        for k in x.kids:
            if isinstance(k, Node):
                parts.append(f"\0{k.hash}")
                size += sizes[id(k)]
            elif text := " ".join(k.split()):
                parts.append(text)
                size += len(text)
        x.hash = xxhash.xxh64_intdigest("\1".join(parts), seed=11) - (1 << 63)
        sizes[id(x)] = size
    return sizes


def _candidates(root: Node) -> tuple[list[Node], int]:
    """Elements whose subtrees are counted, and a hash of the page's main part.

    Outside the marked region these are all containers that do not hold it, and one of
    several articles; inside only containers, as paragraphs there are the article's.
    On a page without a region, paragraphs, items and headings count as well.  Nothing
    that has half of the region's text is a candidate.
    """
    sizes = _hash_all(root)
    regions, marked = main_regions(root)
    whole = sum(sizes[id(r)] for r in regions)
    main = {id(r) for r in regions}
    around = set()
    for x in reversed(list(_walk(root))):  # elements that hold a region
        if any(isinstance(k, Node) and (id(k) in main or id(k) in around) for k in x.kids):
            around.add(id(x))
    found = []
    todo: list[tuple[Node, bool]] = [(root, not marked)]
    while todo:
        x, inside = todo.pop()
        inside = inside or id(x) in main
        size = sizes[id(x)]
        small = not inside or 2 * size < whole
        if x is not root and size and small and id(x) not in around and x.name in (_CONTAINERS | {"article"} if marked else _LOOSE):
            found.append(x)
        todo.extend((k, inside) for k in reversed(x.kids) if isinstance(k, Node))
    return found, xxhash.xxh64_intdigest("".join(str(r.hash) for r in regions)) - (1 << 63)


def main_text(root: Node, template: frozenset | set = frozenset(), candidates: list[Node] | None = None) -> str:
    """The blocks of the main regions, without boilerplate and template subtrees, joined by two newlines."""
    for x in (_candidates(root)[0] if candidates is None else candidates) if template else ():
        x.gone = x.hash in template
    regions, _ = main_regions(root)
    blocks, line = [], []

    def flush():
        if text := " ".join("".join(line).split()):
            blocks.append(text)
        line.clear()

    for region in regions:
        todo: list = [region]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            elif x.name == "br":
                line.append(" ")
            elif x is region or not (x.boiler or x.gone):
                if x.name == "header" and x is not region:  # of an article: only its headings are text
                    todo.extend(reversed(_headings(x)))
                    continue
                block = x.name in _BLOCK
                if block:
                    flush()
                    todo.append(None)
                elif x.name in ("td", "th"):
                    todo.append(" ")
                todo.extend(reversed(x.kids))
        flush()
    return "\n\n".join(blocks)


def _subtrees(batches):
    for batch in batches:
        hosts, k1, k2, hashes, mains = [], [], [], [], []
        for host, a, b, source in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            found, main = _candidates(parse_html(source))
            for h in {x.hash for x in found}:
                hosts.append(host)
                k1.append(a)
                k2.append(b)
                hashes.append(h)
                mains.append(main)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *[pa.array(x, pa.int64()) for x in (k1, k2, hashes, mains)]], names=["host", "k1", "k2", "subtree", "main"])


def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the wanted numbers are among sorted ones."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool)
    return keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted


def _extract(shared: tuple[np.ndarray, np.ndarray] | None):
    """Texts of pages; ``shared`` has hashes of hosts, and of hosts and template subtrees together, else each page brings its own."""

    def run(batches):
        for batch in batches:
            texts = []
            known = _among(shared[0], batch.column(2).to_numpy()) if shared is not None else None
            for i, (source, key, own) in enumerate(zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True)):
                root = parse_html(source or "")
                if known is None:
                    texts.append(main_text(root, set(own or ())))
                elif not known[i]:
                    texts.append(main_text(root))
                else:
                    found = _candidates(root)[0]
                    hashes = np.array([x.hash for x in found], dtype=np.int64)
                    texts.append(main_text(root, set(hashes[_among(shared[1], hashes ^ key)].tolist()), found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["page", "text"])

    return run


def site_templates(pages: DataFrame, url_col: str, html_col: str, min_pages: int) -> tuple[DataFrame, DataFrame]:
    """Subtrees of each page (``host, k1, k2, subtree, main``) and those that recur on a host (``host, subtree``)."""
    source = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(url_host(F.col(url_col)).alias("host"), F.xxhash64(source).alias("k1"), F.xxhash64(F.lit("second"), source).alias("k2"), source.alias("html"))
    found = rows.mapInArrow(_subtrees, "host string, k1 long, k2 long, subtree long, main long")
    # Distinct pairs of subtree and main text first, so that a hot subtree is added up from many keys.
    pairs = found.select("host", "subtree", "main").distinct()
    return found, pairs.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages).select("host", "subtree")


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, broadcast_subtrees: int = BROADCAST_SUBTREES) -> DataFrame:
    """``pages`` without its html, with ``text``, the main text of each page's whole html.

    Blocks are in page order, joined by two newlines; references are decoded and white
    space inside a block is one space.  Null or empty html gives an empty text.  Pages
    with a null URL count as one host.  Repeated rows stay, but count once as a page of
    their host.  A column ``text`` of ``pages`` is replaced; an empty table is fine.
    """
    found, recurring = site_templates(pages, url_col, html_col, min_pages)
    recurring = materialise(recurring, "templates")
    own = [c for c in pages.columns if c.lower() != "text"]
    source = F.coalesce(F.col(html_col), F.lit(""))
    page = F.struct(*[F.col(f"`{c}`") for c in own if c != html_col], F.lit(1).alias(free_name(own, "any"))).alias("page")
    schema = T.StructType([T.StructField("page", pages.select(page).schema[0].dataType), T.StructField("text", T.StringType())])
    n = recurring.count()
    if n <= broadcast_subtrees:
        host = F.xxhash64("host")
        listed = recurring.select(host.alias("host"), host.bitwiseXOR(F.col("subtree")).alias("both")).toArrow()  # 16 bytes for each of broadcast_subtrees
        shared = np.unique(listed["host"].to_numpy()), np.unique(listed["both"].to_numpy())
        rows = pages.select(page, source.alias("html"), F.xxhash64(url_host(F.col(url_col))).alias("key"), F.lit(None).cast("array<long>").alias("own"))
        texts = rows.mapInArrow(_extract(shared), schema)
    else:
        each = found.join(recurring, ["host", "subtree"]).groupBy("host", "k1", "k2").agg(F.collect_set("subtree").alias("own"))
        rows = pages.select(page, source.alias("html"), url_host(F.col(url_col)).alias("host"), F.xxhash64(source).alias("k1"), F.xxhash64(F.lit("second"), source).alias("k2"))
        rows = rows.join(each, ["host", "k1", "k2"], "left").select("page", "html", F.lit(0).cast("long").alias("key"), "own")
        texts = rows.mapInArrow(_extract(None), schema)
    return texts.select(*[F.col(f"page.`{c}`") for c in own if c != html_col], "text")
