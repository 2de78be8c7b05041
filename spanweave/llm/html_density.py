"""Main text of HTML pages by composite text density.

A page becomes a tree of elements.  For every node, characters per tag are
adjusted by the share of characters and tags inside links, relative to the
body's own share; a node's density sum adds up the densities of the blocks next below it.  The
node of the largest sum is the content, together with what lies beside the
path from body to it, elements and loose text alike, and is at least as dense
as the sparsest node on that path.  Elements that never hold article text (navigation, forms, scripts,
boxes whose class, id or role names an advert, a sidebar, comments ...) are
cut from the tree before anything is counted.

Pages are parsed one at a time inside tasks, in time linear in their length;
nothing is gathered between pages, so no key can be hot.

Edge cases: null, empty or tagless html gives its plain text (empty if none);
unclosed, misnested and stray tags are closed as browsers close them, and a
page that breaks off inside a tag ends before it; ties go to the outermost node;
repeated rows give repeated results; an empty table an empty result; columns
besides page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements with no article text, dropped whole.
DROPPED = frozenset("head script style noscript template iframe object svg math canvas audio video nav footer aside form button select textarea dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of the key closes an open element of these kinds, up to the nearest element of the second set.
_SCOPE = frozenset("table td th article section div main body html aside ul ol dl blockquote".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Words of a class, id or role that name something beside the article.
BESIDE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead banner cookie cookies consent notice notices alert comment comments disqus reply replies share sharing social related recommended newsletter subscribe signup login popup modal overlay widget toolbar pagination pager search complementary contentinfo dialog".split())
#: Of these, the words of what readers wrote: such a box is no wrapper of the article, whatever stands in it.
READERS = frozenset("comment comments disqus reply replies".split())
#: Elements that mark the article, so that a box around one that is named for its layout (has-sidebar, nav-open) is kept.
MARKS = frozenset("article main h1".split())
_BOXES = frozenset("div section ul ol dl table header span p details figure center".split())

#: No part can be tried in two ways, so a broken tag costs one pass over what it spans.  A drawing that is closed in its
#: own tag ends there; other elements of raw text don't, whatever slash they have.
_TOKEN = re.compile(
    r"<!--(?:.*?-->|(?P<open_comment>.*+)\Z)"
    r"|<(?P<raw>script|style|textarea|noscript|title|template|iframe|xmp|svg(?!(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+(?<=/)>))\b(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+>(?:.*?</(?P=raw)\s*+>|(?P<open_raw>.*+)\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/><]*+)(?P<attributes>(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
_BROKEN = re.compile(r"<[a-zA-Z/!?]")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")
#: Also run together with other words (commentlist, usercomments); a commentary is an article.
_READERS = re.compile(r"comment(?!a)|disqus")


def _beside(attributes: str) -> int:
    """0 for an element that names nothing beside the article, 1 if it does, 2 if that is what readers wrote."""
    found = 0
    for name in _NAMES.finditer(attributes):
        value = name[1] or name[2] or name[3] or ""
        parts = _PARTS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
        found = max(found, 2 if not READERS.isdisjoint(parts) or any(map(_READERS.search, parts)) else 1 if not BESIDE.isdisjoint(parts) else 0)
    return found


class Node:
    __slots__ = ("tag", "children", "beside", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, beside: int = 0):
        self.tag, self.children, self.beside = tag, [], beside  # children: Node and str
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


class _Open:
    """The open elements, outermost first, and where each kind of them stands."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], {root.tag: [0]}

    def last(self, kinds: Iterable[str]) -> int:
        """Where the innermost open element of these kinds stands, -1 without one."""
        return max((self.at[k][-1] for k in kinds if self.at.get(k)), default=-1)

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            self.at[self.stack.pop().tag].pop()


def parse(page: str) -> Node:
    """The tree below body, without dropped elements; text is decoded, white space still as written."""
    root = Node("body")
    opened, skipping, at = _Open(root), [], 0
    # Behind the last > nothing but a comment can be a whole token.
    ends = page.rfind(">") + 1

    def text(piece: str) -> None:
        if piece and not skipping:
            opened.stack[-1].children.append(entities.unescape(piece) if "&" in piece else piece)

    def close(kinds: Iterable[str], barrier: Iterable[str]) -> None:
        k = opened.last(kinds)
        if k > max(0, opened.last(barrier)):
            opened.cut(k)

    for token in _TOKEN.finditer(page, 0, ends):
        text(page[at : token.start()])
        at = token.end()
        if token["open_comment"] is not None or token["open_raw"] is not None:
            at = len(page)
        name = token["name"]
        if name is None:
            continue
        name, is_end, attributes = name.lower(), token["end"], token["attributes"]
        if skipping and skipping[0] == "p":
            # A dropped paragraph ends where a kept one would.
            opens = not is_end and name in CLOSES_P
            if opens or (is_end and name != "p" and name in BLOCKS and opened.at.get(name)):
                skipping.clear()
        if skipping:
            # Inside a dropped element only its own kind counts.
            if name == skipping[-1]:
                if is_end:
                    skipping.pop()
                elif not attributes.rstrip().endswith("/"):
                    skipping.append(name)
            elif name in {"body", "article", "main"} and not is_end and skipping[0] == "head":
                skipping.clear()
            if skipping or is_end or name in DROPPED:
                continue
        if is_end:
            if name in {"body", "html"}:
                continue
            if name == "p" and not opened.at.get("p"):
                opened.stack[-1].children.append(Node("p"))
                continue
            # A block's end closes what stands open in it; other ends don't reach beyond their scope.
            close({name}, () if name in BLOCKS else _SCOPE - {name})
            continue
        if name in {"html", "body"}:
            continue
        if name in CLOSES_P:
            close({"p"}, _SCOPE)
        if name in CLOSES:
            close(*CLOSES[name])
        own_article = opened.at.get("article") or opened.at.get("main")
        beside = _beside(attributes) if attributes and (name in _BOXES or name in MARKS) else 0
        if name in DROPPED or (name == "header" and not own_article) or (beside and name == "p"):
            if name not in VOID and not attributes.rstrip().endswith("/"):
                skipping.append(name)
            continue
        node = Node(name, beside)
        opened.stack[-1].children.append(node)
        if name not in VOID:
            opened.push(node)
    rest = page[at:]
    cut = _BROKEN.search(rest, max(0, ends - at))
    text(rest[: cut.start()] if cut else rest)
    return _without_boxes(root)


def _without_boxes(root: Node) -> Node:
    """The tree without the boxes that are named for something beside the article and don't hold it."""
    order = _in_order(root)
    holds = set()
    for node in reversed(order):
        if (node.tag in MARKS and not node.beside) or any(isinstance(x, Node) and id(x) in holds and x.beside < 2 for x in node.children):
            holds.add(id(node))
    for node in order:
        node.children = [x for x in node.children if isinstance(x, str) or not x.beside or x.tag in MARKS or (x.beside < 2 and id(x) in holds)]
    return root


def _in_order(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in reversed(node.children) if isinstance(x, Node))
    return order


def measure(root: Node) -> list[Node]:
    """Fills in counts, densities and sums; the nodes in page order."""
    order = _in_order(root)
    for node in reversed(order):
        for x in node.children:
            if isinstance(x, str):
                node.chars += len("".join(x.split()))
            else:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    share = root.link_chars / max(root.chars, 1)
    for node in order:
        c, lc, t, lt = node.chars, node.link_chars, max(node.tags, 1), max(node.link_tags, 1)
        if c:
            base = math.log(c * lc / max(c - lc, 1) + share * c + math.e)
            node.density = c / t * math.log(c / max(lc, 1) * t / lt + 1) / math.log(base + 1)
    for node in reversed(order):
        # Inline elements belong to the text around them: what they hold counts for the block above.
        for x in node.children:
            if isinstance(x, Node):
                node.total += x.density if x.tag in BLOCKS else x.total
    return order


def content_nodes(root: Node) -> list[Node | str | None]:
    """The subtree of the largest density sum, and its equals beside the path to it, in page order; None ends a block."""
    order = measure(root)
    best = max((x for x in order if x.tag in BLOCKS), key=lambda x: x.total)
    if best.total <= 0:
        return [root]
    above = {}
    for node in order:
        for x in node.children:
            if isinstance(x, Node):
                above[id(x)] = node
    path = [best]
    while path[-1] is not root:
        path.append(above[id(path[-1])])
    threshold = min(x.density for x in path)
    if best is root:
        return [root]
    on_path = {id(x) for x in path}
    # Loose text of a path's node has no tags of its own: all of it together against the fewest characters per tag.
    least = min(x.chars / max(x.tags, 1) for x in path)
    chosen: list = []
    within: set[int] = set()
    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is None or x is best or isinstance(x, str):
            chosen.append(x)
        elif id(x) in on_path:
            loose = sum(len("".join(s.split())) for s in x.children if isinstance(s, str)) >= least
            if loose:  # with the inline elements in it
                within |= {id(s) for s in x.children if isinstance(s, Node) and s.tag not in BLOCKS}
            ends = [None] if x.tag in BLOCKS else []
            chosen.extend(ends)
            # White space stays in any case: it keeps words apart.
            stack.extend(ends + [s for s in reversed(x.children) if loose or not isinstance(s, str) or s.isspace()])
        elif (x.density >= threshold and x.tag != "a") or id(x) in within:
            chosen.append(x)
        elif x.tag in BLOCKS:
            chosen.append(None)
    return chosen


def blocks(nodes: list[Node | str | None]) -> list[str]:
    """The text of the nodes, a string for each block with any."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        words = "".join(run).split()
        if words:
            out.append(" ".join(words))
        run.clear()

    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            run.append(x)
        elif x is None:
            flush()
        else:
            if x.tag in BLOCKS:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(blocks(content_nodes(parse(page))))


def extract_text(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one per row of `pages`."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    columns = (F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.select(*columns).mapInArrow(extract, "page_id long, url string, text string, n_chars long")
