"""Main text of HTML pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, fully to the parent and
half to the one above; a container loses the share of its text that stands in links. The best
container is kept with the whole article or main element around it, or else with all that
stands beside it. Inside, what names itself as a menu, header, footer, sidebar, notice, advert,
form or comment is left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|"
                    r"<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_NAMES = r"(?<![\w-])(?:%s)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"
#: What an element is; an id may be no more than the anchor of a heading, so it says something only on plain containers outside the article.
_KIND, _ID = (re.compile(_NAMES % x, re.I) for x in ("class|role", "class|role|id"))
#: Elements without an end tag; elements that never hold main text; elements that start a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("nav header footer aside form button select option dialog menu head object canvas video audio map".split())
BLOCK = frozenset("p div article section main body html h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th caption pre blockquote figure figcaption br hr "
                  "address details summary nav header footer aside form fieldset center".split())
PARAGRAPH = frozenset("p td pre blockquote li dd h2 h3 figcaption div article section main body".split())
#: Elements that an opening tag of the same group closes, as browsers do.
CLOSES = {"p": frozenset("p"), **{x: frozenset(["p"]) for x in "div article section main ul ol dl table pre blockquote h1 h2 h3 h4 h5 h6 hr nav header footer aside form figure address".split()},
          "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]),
          "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"])}
STOPS = frozenset("table ul ol dl article section main body html div td th blockquote".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6".split())
_UNLIKELY = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|popup|modal|overlay|comment\w*|disqus|respond|reply|replies|discussion|"
                       r"sidebar|side-bar|nav|navbar|navigation|menu|breadcrumb\w*|footer|foot|header|masthead|toolbar|related|recommend\w*|share|sharing|social|subscribe|newsletter|"
                       r"signup|login|pagination|pager|widget|search|skip|contentinfo|complementary|alert|tags|byline-ad)(?:$|[\s_-])", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "points", "length", "linked", "holds", "whole")

    def __init__(self, tag: str, parent: Node | None, drop: bool):
        self.tag, self.parent, self.drop = tag, parent, drop
        self.children: list[Node | str] = []
        # The outermost article around or, without one, the outermost main element.
        self.whole: Node | None = parent.whole if parent is not None else None
        if tag == "article" and (self.whole is None or self.whole.tag == "main") or tag == "main" and self.whole is None:
            self.whole = self
        self.points, self.length, self.linked, self.holds = 0.0, 0, 0, False


def parse(page: str) -> Node:
    """A tree of elements and texts. Unknown ends are skipped, missing ends are implied."""
    root = here = Node("html", None, False)
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            here.children.append(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["close"]:
            up = here
            while up is not None and up.tag != tag:
                up = None if up.tag in STOPS and tag not in BLOCK else up.parent
            if up is not None and up.parent is not None:
                here = up.parent
            continue
        if closes := CLOSES.get(tag):
            up = here
            while up is not root and (up.tag in closes or up.tag not in BLOCK):
                if up.tag in closes:
                    here = up.parent
                up = up.parent
        attrs = m["attrs"]
        named = _ID if here.whole is None and tag != "section" else _KIND
        drop = here.drop or tag in DROP or bool(attrs and tag not in ("body", "html", "article", "main") and tag not in PROSE
                                                and any(_UNLIKELY.search("".join(n)) for n in named.findall(attrs)))
        node = Node(tag, here, drop)
        here.children.append(node)
        if tag not in VOID and attrs[-1:] != "/":
            here = node
    if at < len(page):
        here.children.append(page[at:])
    return root


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """Every element on the way in (True) and on the way out (False); no recursion, as pages may nest deeply."""
    stack: list[tuple[Node, bool]] = [(root, True)]
    while stack:
        node, entering = stack.pop()
        yield node, entering
        if entering:
            stack.append((node, False))
            stack += [(c, True) for c in reversed(node.children) if isinstance(c, Node)]


def score(root: Node) -> list[Node]:
    """Points of all containers; those that got any."""
    found = []
    for node, entering in _walk(root):
        if entering or node.drop:
            continue
        own = [c for c in node.children if isinstance(c, str)]
        said = "".join(own)
        inline = [c for c in node.children if isinstance(c, Node) and c.tag not in BLOCK and not c.drop]
        size = len(said.strip()) + sum(c.length for c in inline)
        node.length = len(said.strip()) + sum(c.length for c in node.children if isinstance(c, Node) and not c.drop)
        node.linked = node.length if node.tag == "a" else sum(c.linked for c in node.children if isinstance(c, Node) and not c.drop)
        if node.tag in PARAGRAPH and size >= 25 and node.parent is not None:
            points = 1 + said.count(",") + min(size / 100, 3)
            parent = node if node.tag in ("div", "article", "section", "main", "body", "td") else node.parent
            for holder, part in ((parent, 1.0), (parent.parent, 0.5), (parent.parent.parent if parent.parent else None, 1 / 6)):
                if holder is not None:
                    if not holder.holds:
                        holder.holds, holder.points = True, {"article": 10.0, "main": 5.0, "div": 5.0, "section": 3.0}.get(holder.tag, 0.0)
                        found.append(holder)
                    holder.points += points * part
    for node in found:
        node.points *= 1 - node.linked / max(1, node.length)
    return found


def _blocks(node: Node, out: list[list[str]]) -> None:
    """Texts of the blocks below a node, in page order."""
    if out:
        out.append([])
    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            if not out:
                out.append([])
            out[-1].append(x)
        elif x.drop and x is not node:
            continue
        elif x.tag == "br":
            out.append([])
        else:
            block = x.tag in BLOCK
            if block:
                out.append([])
                todo.append(None)
            todo += reversed(x.children)


def extract(page: str) -> str:
    """The main text: blocks in page order, white space inside a block and between blocks as one space. Empty if there is none."""
    root = parse(page)
    found = score(root)
    if found:
        best = max(found, key=lambda n: n.points)
        keep = best.whole or best.parent or best
    else:
        keep = root
    out: list[list[str]] = []
    _blocks(keep, out)
    blocks = (" ".join(html.unescape("".join(b)).split()) for b in out)
    return " ".join(b for b in blocks if b)


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (code points). A null page has an empty text; other columns are ignored."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])
    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
