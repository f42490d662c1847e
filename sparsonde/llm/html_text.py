"""Main text of web pages by composite text density.

The page becomes a DOM tree of all that is rendered. Each node gets its link-adjusted characters per tag, and the node whose
children's densities have the largest sum is the core; while one child holds nearly all of its text, that child is. Within the
core's subtree, and within the ``article`` element it lies in, every block is kept, lists of links too. What stands beside the way
from there to the body is judged as a whole: the lowest density on the way is the threshold, lists and other plain
blocks of a text stay without one (beside an ``article`` they don't), and so does, at half of it, a part with a tenth of the core's text. What is made of links goes.

Elements that say what they are (``nav``, ``footer``, ``aside`` ..., or a class, id or role of nothing but such words) are no part
of the article wherever they stand; they count in the densities, but the core isn't looked for in them. Names that authors also
give to what holds their article (``form``, ``promo``, ``alert`` ...) count only where the element has less text than all that is in no such element.
"""

from __future__ import annotations

import heapq
import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("svg canvas audio video object map datalist".split())
APART = frozenset("nav footer aside button select option dialog menu".split())
DOUBTFUL = frozenset("form fieldset".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul figure details".split())
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote table figure dl ul ol".split())
QUOTES = frozenset("blockquote q figure".split())
#: Elements that end an open one of their kind: the kind's names, and the elements up to which it is looked for.
ENDS_OWN = ((("li",), ("ul", "ol", "menu")), (("dt", "dd"), ("dl",)), (("tr",), ("table",)), (("td", "th"), ("tr", "table")), (("option",), ("select",)))
KIND = {name: k + 1 for k, (names, _) in enumerate(ENDS_OWN) for name in names}
#: Words in class, id or role that mark what isn't the article, and words that may stand beside them.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar sidebars aside nav navbar navigation menu menus breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended "
    "comment comments commentlist disqus reply replies respond widget widgets toolbar pagination pager skip contentinfo complementary search alert dialog outbrain taboola".split()
)
#: Those of them that also stand on elements around an article.
LOOSE = frozenset("banner sponsor sponsored promo promotion notice notices popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended widget widgets toolbar search alert dialog".split())
HEADER = frozenset("header masthead".split())
FILLER = frozenset(
    "box boxes list lists area wrap wrapper container section block blocks inner outer top bottom left right item items form bar panel unit slot group row col column thread reader readers user users "
    "post posts page site main blog article global primary secondary mobile button buttons link links text message messages header head title".split()
)

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile("[>\"']")
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: While a child of the core holds so large a share of its text, the core is that child.
NEARLY_ALL = 0.8
#: A part beside the core with this share of its text needs half of the threshold.
LARGE = 0.1


class Node:
    """An element: its parts in page order, and its nearest open p, li, dt or dd, tr, td or th and option."""

    __slots__ = ("apart", "chars", "children", "density", "doubtful", "in_article", "kids", "link_chars", "links", "name", "near", "parent", "quotes", "sum", "tags", "unseen")

    def __init__(self, name: str, parent: Node | None) -> None:
        self.name, self.parent, self.apart, self.doubtful, self.quotes, self.unseen = name, parent, False, False, False, False
        self.children: list[Node | str] = []
        self.kids: list[Node] = []
        self.in_article = name == "article" or (parent is not None and parent.in_article)
        above = parent.near if parent is not None else (None,) * (len(ENDS_OWN) + 1)
        p = self if name == "p" else above[0] if name in INLINE else None
        self.near = (p, *[self if name in names else None if name in ends else a for a, (names, ends) in zip(above[1:], ENDS_OWN, strict=True)])


def _mark(n: Node, attrs: str) -> None:
    """Notes whether ``n`` isn't rendered, and whether it says of itself that it is apart from the article, or may be."""
    beside = not (n.parent is not None and n.parent.in_article)
    n.unseen = n.name in UNSEEN
    n.apart = n.name in APART or (n.name == "header" and beside)
    n.doubtful = n.name in DOUBTFUL
    if n.name in QUOTES and n.parent is not None:
        n.parent.quotes = True
    if not attrs:
        return
    by_name = n.name not in ("html", "body", "main", "article")
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and HIDDEN.search(value)):
            n.unseen = True
        elif by_name and key in ("class", "id", "role"):
            for one in value.split():
                words = {w.lower() for w in PARTS.findall(one)}
                if words <= NOISE | FILLER and (words & NOISE or (beside and words & HEADER)):
                    if words & NOISE <= LOOSE and not (beside and words & HEADER):
                        n.doubtful = True
                    else:
                        n.apart = True


class _Ends:
    """Where tags end. A search that has failed once isn't made again, so that all searches of a page together are linear."""

    def __init__(self, page: str) -> None:
        self.page, self.quoted, self.unmatched = page, True, set()

    def __call__(self, at: int) -> int:
        """The place of the > that ends the tag at ``at``, outside of quotes if there is one; -1 if there is none."""
        page, i = self.page, at
        while self.quoted:
            m = STOP.search(page, i)
            if m is None:
                self.quoted = False
            elif m[0] == ">":
                return m.start()
            else:
                end = -1 if m[0] in self.unmatched else page.find(m[0], m.end())
                if end < 0:
                    self.unmatched.add(m[0])
                i = max(end, m.start()) + 1
        return page.find(">", at)


def parse(page: str) -> Node:
    """The DOM tree of ``page``; unclosed and misnested tags are mended as browsers do."""
    root = here = Node("#root", None)
    is_open: Counter[str] = Counter()
    ends, raw_ends, at = _Ends(page), {}, 0

    def leave(upto: Node) -> None:
        """Closes elements until ``upto`` has been closed."""
        nonlocal here
        while here is not upto:
            is_open[here.name] -= 1
            here = here.parent
        is_open[upto.name] -= 1
        here = upto.parent

    while at < len(page):
        tag = page.find("<", at)
        if tag < 0:
            here.children.append(page[at:])
            break
        if tag > at:
            here.children.append(page[at:tag])
        closing = page.startswith("/", tag + 1)
        name_at = NAME.match(page, tag + 1 + closing)
        if name_at is None:
            at = tag + 1
            if page.startswith("<!--", tag):
                end = page.find("-->", tag + 4)
                at = end + 3 if end >= 0 else len(page)
            elif page.startswith("<![CDATA[", tag):
                end = page.find("]]>", tag)
                here.children.append(_html.escape(page[tag + 9 : end if end >= 0 else len(page)], quote=False))
                at = end + 3 if end >= 0 else len(page)
            elif page.startswith(("<!", "<?", "</"), tag):
                end = page.find(">", tag)
                at = end + 1 if end >= 0 else len(page)
            else:
                here.children.append("<")
            continue
        end = ends(name_at.end())
        if end < 0:  # no tag ends any more
            here.children.append(page[tag:])
            break
        name, attrs, at = name_at[0].lower(), page[name_at.end() : end], end + 1
        if closing:
            if is_open[name]:
                node = here
                while node.name != name:
                    node = node.parent
                leave(node)
            continue
        if name in RAW:
            if name not in raw_ends:
                raw_ends[name] = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I)
            end = raw_ends[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID:
            if name == "hr" and here.near[0] is not None:
                leave(here.near[0])
            if name != "wbr":
                here.children.append(" " if name in ("br", "img") else "\0")
            continue
        if name in CLOSES_P and here.near[0] is not None:
            leave(here.near[0])
        elif name in KIND and here.near[KIND[name]] is not None:
            leave(here.near[KIND[name]])
        if name == "head" or (name in ("body", "html") and is_open[name]):
            continue
        node = Node(name, here)
        _mark(node, attrs)
        here.children.append(node)
        here.kids.append(node)
        if attrs.endswith("/") and name not in ("p", "div", "li", "article", "section", "span", "b", "a"):
            continue
        here = node
        is_open[name] += 1
    return root


def measure(root: Node) -> list[Node]:
    """Post-order nodes with characters, tags, link characters, links, density and density sum."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        n.kids = [k for k in n.kids if not k.unseen]
        stack.extend(reversed(n.kids))
    order.reverse()
    for n in order:
        own = sum(len(" ".join(c.replace("\0", " ").split())) for c in n.children if isinstance(c, str))
        n.chars = own + sum(k.chars for k in n.kids)
        n.tags = len(n.kids) + sum(k.tags for k in n.kids)
        link = n.name == "a"
        n.link_chars = n.chars if link else sum(k.link_chars for k in n.kids)
        n.links = sum(k.links for k in n.kids) + link
    body_c, body_l = max(root.chars, 1), root.link_chars
    for n in order:
        n.density = density(n.chars, n.tags, n.link_chars, n.links, body_c, body_l)
        n.sum = sum(k.density for k in n.kids)
    return order


def density(chars: int, tags: int, link_chars: int, links: int, body_chars: int, body_links: int) -> float:
    """Characters per tag, more where few of the characters and tags are links', by a logarithm whose base grows with the links; times the share that isn't links."""
    if not chars:
        return 0.0
    plain, t = max(chars - link_chars, 1), max(tags, 1)
    base = math.log(chars / plain * link_chars + body_links / body_chars * chars + math.e)
    return chars / t * math.log(chars / max(link_chars, 1) * t / max(links, 1) + 1) / max(math.log(base), 1.0) * (plain / chars)


def _outside(root: Node, order: list[Node]) -> set[int]:
    """The ids of the nodes that neither are apart nor stand in an element that is."""
    found = {id(root)}
    for n in reversed(order):
        if n is not root and not n.apart and id(n.parent) in found:
            found.add(id(n))
    return found


def _settle(root: Node, order: list[Node]) -> None:
    """Decides of each element that may be apart whether it is: if it has less text than there is outside of such elements.

    A quotation set beside an article's text (``aside`` with a ``blockquote``) is a part of it.
    """
    for n in order:
        if n.apart and n.name == "aside" and n.quotes and n.in_article and not n.doubtful:
            n.apart = False
    own: dict[int, int] = {}  # text that is no link's and not in what is apart
    for n in order:
        own[id(n)] = 0 if n.name == "a" else n.chars - sum(k.chars for k in n.kids) + sum(own[id(k)] for k in n.kids if not k.apart)
    left = own[id(root)]
    heap: list[tuple[int, int, Node]] = []

    def look(n: Node) -> None:
        """Notes the outermost doubtful elements below ``n``."""
        nonlocal left
        stack = list(n.kids)
        while stack:
            k = stack.pop()
            if k.doubtful and not k.apart:
                heapq.heappush(heap, (-own[id(k)], id(k), k))
                left -= own[id(k)]
            elif not k.apart:
                stack += k.kids

    look(root)
    while heap:
        size, _, n = heapq.heappop(heap)
        if -size < left or not size:
            for k in (n, *(x[2] for x in heap)):
                k.apart = True
            break
        left -= size
        look(n)


def core_of(root: Node, order: list[Node]) -> Node:
    """The node with the largest density sum outside of elements apart (of equal ones the first in page order), then down while one child holds nearly all of the text."""
    outside = _outside(root, order)
    core = max((n for n in reversed(order) if id(n) in outside), key=lambda n: n.sum)
    if not core.sum:
        core = root
    while True:
        kids = [k for k in core.kids if not k.apart]
        large = max(kids, key=lambda k: k.chars, default=None)
        if large is None or large.name in INLINE or not large.sum or large.chars < NEARLY_ALL * (core.chars - sum(k.chars for k in core.kids if k.apart)):
            return core
        core = large


def _linky(n: Node) -> bool:
    return n.chars > 0 and n.links >= 3 and n.link_chars * 5 >= n.chars * 4 and n.name not in PLAIN - {"ul", "ol"}


def _blocks(node: Node, kept) -> list[str]:
    """The text of ``node``'s blocks in page order; ``kept`` says which child nodes count."""
    out: list[str] = []
    now: list[str] = []

    def end() -> None:
        if text := " ".join(_html.unescape("".join(now)).split()):
            out.append(text)
        now.clear()

    stack: list = [iter((node,))]
    names: list[str] = []
    while stack:
        c = next(stack[-1], None)
        if c is None:
            stack.pop()
            if names and names.pop() not in INLINE:
                end()
        elif isinstance(c, str):
            for i, part in enumerate(c.split("\0")):
                if i:
                    end()
                now.append(part)
        else:
            if c.name not in INLINE:
                end()
            if kept(c):
                stack.append(iter(c.children))
                names.append(c.name)
    end()
    return out


def main_text(page: str | None) -> str:
    """The article of ``page``: blocks joined by a newline, white space in a block as one space, references decoded. Empty for null, blank or textless pages."""
    if not page or not page.strip():
        return ""
    root = parse(page)
    order = measure(root)
    if not root.chars:
        return ""
    _settle(root, order)
    outside = _outside(root, order)
    if sum(n.chars for n in order if n.apart and id(n.parent) in outside) >= root.chars:  # names can mislead: all of the page may stand in an element called after a part of it
        for n in order:
            n.apart = False
    core = core_of(root, order)
    way = [core]
    while way[-1].parent is not None:
        way.append(way[-1].parent)
    whole = next((n for n in way if n.name == "article"), core)
    on_way = {id(n) for n in way[way.index(whole) :]}
    least = min((n.density for n in way if n.name not in ("#root", "html") and n.density > 0), default=0.0)
    large = LARGE * (core.chars - core.link_chars)

    def kept(n: Node) -> bool:
        if n.unseen or n.apart:
            return False
        if id(n) in on_way or n.parent is None or id(n.parent) not in on_way or n.parent is whole:
            return True
        if _linky(n) or (n.link_chars * 2 > n.chars and n.name not in INLINE):
            return False
        if n.density >= least or (n.chars - n.link_chars >= large and n.density * 2 >= least):
            return True
        return whole.name != "article" and (n.name in PLAIN or n.name in INLINE)

    return "\n".join(_blocks(root, kept))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every row of ``pages``; a null html gives an empty text. Time and memory are linear in the length of a page."""
    kinds = {f.name: f.dataType for f in pages.schema.fields}
    schema = T.StructType([T.StructField("page_id", kinds["page_id"]), T.StructField("url", kinds["url"]), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
