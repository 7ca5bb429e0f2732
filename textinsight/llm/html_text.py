"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# Their content is not markup.
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "noembed", "xmp"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that never hold main text.
DROPPED = RAW | frozenset("head nav header footer aside form button select option dialog menu object video audio canvas map".split())
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address details summary center hr fieldset hgroup".split()) | DROPPED
# Class, id or role words of what is not the article.
UNLIKELY = re.compile(
    r"(?:^|(?<!\bno)(?<!\bhas)(?<!\bwith)(?<!\bwithout)[\s_-])(?:ads?|adslots?|adsbygoogle|advert\w*|banner|breadcrumbs?|combx|comments?|cookies?|consent|disqus|footer|header|login|masthead|menu|"
    r"modal|nav\w*|newsletter|notices?|pager|pagination|popup|promo\w*|related|replies|reply|share|sharing|shoutbox|sidebars?|"
    r"signup|social|sponsor\w*|subscribe|subscription|tags?|toolbar|topbar|widgets?|alert|navigation|complementary|contentinfo|search)(?:$|[\s_-])")
# Of these words, those that always tell; those that tell where there are links or no paragraphs; the others tell
# unless the element holds the bulk of the page's paragraphs and is named as a layout besides.
FIRM = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|replies|reply|shoutbox|popup|modal|cookies?|consent)(?:$|[\s_-])")
LINKY = frozenset("breadcrumb breadcrumbs menu nav navigation pager pagination related share sharing social tag tags search".split())
BULK, SOME_LINKS, ITEM = 0.5, 0.3, 20
LAYOUT = re.compile(
    r"(?:^|[\s_-])(?:article|body|content|entry|hentry|main|page|post|story|text|blog|container|wrap|wrapper|site|layout|inner|outer|row|col|column)(?:$|[\s_-])")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of what is; they weigh points up but do not outdo the above.
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text|blog)(?:$|[\s_-])")
# Start tags that end an open paragraph, and list items and cells that end their like.
ENDS_P = BLOCKS - {"li", "td", "th", "tr", "tbody", "thead", "tfoot", "dt", "dd", "caption"}
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"),
        "option": ("option",)}
SCORED = frozenset(("p", "pre", "td", "blockquote", "li", "dd"))
# Containers that are a menu where nearly all their text is links.
LISTS = frozenset("ul ol dl div section table tr td".split())
LEAST = 25  # characters of a paragraph that passes points
_COMMAS = re.compile("[,،、，;；]")


class Node:
    """An element: its children are elements and pieces of text, in page order."""

    __slots__ = ("name", "parent", "children", "hint", "points", "linked", "size", "dropped", "doubtful", "prose", "anchors", "block", "within")

    def __init__(self, name: str, parent: Node | None, hint: str) -> None:
        self.name, self.parent, self.hint, self.children = name, parent, hint, []
        self.points, self.size, self.linked, self.prose, self.anchors = 0.0, 0, 0, 0, 0
        self.block = self if name in BLOCKS or parent is None else parent.block
        self.within = parent is not None and (parent.within or parent.name in ("article", "main"))
        plain = name in ("html", "body", "article", "main")
        own_header = name == "header" and self.within  # its headings are the article's
        self.dropped = name in DROPPED and not own_header or not plain and bool(FIRM.search(hint))
        self.doubtful = not plain and not self.dropped and bool(UNLIKELY.search(hint))


def _hint(attributes: str) -> str:
    pairs = [(k.lower(), v.strip("\"'")) for k, v in _ATTRIBUTE.findall(attributes)]
    words = [v for k, v in pairs if k in ("class", "id", "role")]
    if any(
        k == "hidden" and v.lower() != "false" or k == "aria-hidden" and v.lower() == "true"
        or k == "style" and re.search(r"(?:^|[;\s])display\s*:\s*none", v, re.I) for k, v in pairs
    ):
        words.append("popup")
    return re.sub(r"([a-z])([A-Z])", r"\1-\2", " ".join(words)).lower()


def parse(page: str, hints: bool = True) -> Node:
    """Tree of a page. A tag without its end ends with its parent; an end without its tag is skipped.

    Without ``hints`` classes, ids and roles are not looked at.
    """
    root = at = Node("html", None, "")
    opened: dict[str, int] = {}  # open elements by name, so that an end without its tag costs nothing
    position = 0

    def closed(at: Node, to: Node) -> Node:
        while at is not to:
            opened[at.name] -= 1
            at = at.parent
        return to

    while match := _PIECE.match(page, position):
        position = match.end()
        piece = match.group()
        name = (match.group(2) or match.group(5) or "").lower()
        if not name:
            if not piece.startswith("<!") and not piece.startswith("<?"):
                at.children.append(html.unescape(piece))
            continue
        if match.group(1) or match.group(4):
            if opened.get(name):
                node = at
                while node.name != name:
                    node = node.parent
                at = closed(at, node.parent)
            continue
        if name == "html":
            continue
        if name in ENDS_P:
            if at.block.name == "p":
                at = closed(at, at.block.parent)
        elif name in ENDS and any(opened.get(x) for x in ENDS[name]):
            node = at
            while node.parent is not None and node.name not in ENDS[name] and node.name not in ("ul", "ol", "dl", "table", "select"):
                node = node.parent
            if node.name in ENDS[name]:
                at = closed(at, node.parent)
        node = Node(name, at, _hint(match.group(3) or match.group(6) or "") if hints else "")
        at.children.append(node)
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I).search(page, position)
            position = end.end() if end else len(page)
        elif name not in VOID and not piece.endswith("/>"):
            at = node
            opened[name] = opened.get(name, 0) + 1
    return root


def _elements(root: Node) -> list[Node]:
    """The elements that are not dropped, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.dropped:
            order.append(node)
            stack += [x for x in node.children if isinstance(x, Node)]
    return order


def _direct(node: Node) -> bool:
    return node.name in SCORED or (
        node.name in ("div", "section", "article") and any(isinstance(x, str) and len(x.strip()) >= LEAST for x in node.children))


def _measure(order: list[Node]) -> None:
    """Text, linked text, links and unlinked paragraph text of every element."""
    for node in reversed(order):
        node.size = node.linked = node.prose = node.anchors = 0
        for x in node.children:
            if isinstance(x, Node):
                if not x.dropped:
                    node.size += x.size
                    node.linked += x.size if x.name == "a" else x.linked
                    node.prose += x.prose
                    node.anchors += x.anchors + (x.name == "a")
            else:
                node.size += len(x.strip())
        if _direct(node) and node.size >= LEAST:
            node.prose = max(node.prose, node.size - node.linked)


def _doubt(root: Node) -> list[Node]:
    """Drop the elements whose class, id or role speaks against them; the elements that are left."""
    order = _elements(root)
    _measure(order)
    # where an article says so itself, no other name stands for one
    marked = any(node.name in ("article", "main") and node.size for node in order)
    for node in order:
        if node.doubtful:
            words = set(re.split(r"[\s_-]+", node.hint))
            other = UNLIKELY.search(re.sub(rf"(?<![^\s_-])(?:{'|'.join(LINKY)})(?![^\s_-])", "x", node.hint))
            linky = bool(words & LINKY) and not other
            if linky and node.prose and node.linked < SOME_LINKS * node.size:
                continue
            bulk = node.prose and node.prose >= BULK * root.prose
            holds = marked and any(x.name in ("article", "main") and x.size for x in _in_order(node)) if bulk else False
            node.dropped = not (bulk and LAYOUT.search(node.hint) and (holds or not marked))
    order = _elements(root)
    _measure(order)
    return order


def _score(root: Node) -> list[Node]:
    """Points of every element; the elements that got some. Paragraphs pass their points up: all to
    the parent, half to its parent, a third of that beyond, to four ancestors at most."""
    order = _doubt(root)
    got = {}
    for node in order:
        if not _direct(node) or node.size < LEAST:
            continue
        text = "".join(x for x in _pieces(node))
        points = (1 + min(node.size / 100, 3) + len(_COMMAS.findall(text))) * (1 - node.linked / max(node.size, 1))
        above, share = (node if node.name not in SCORED else node.parent), 1.0
        for depth in range(4):
            if above is None:
                break
            above.points += points * share
            got[id(above)] = above
            above, share = above.parent, share / (2 if depth == 0 else 3)
    for node in got.values():
        if LIKELY.search(node.hint) or node.name in ("article", "main"):
            node.points *= 1.25
        node.points *= 1 - node.linked / max(node.size, 1)
    return list(got.values())


def _pieces(node: Node, kept: bool = False) -> Iterator[str]:
    """Text below a node in page order, what is dropped left out; a line feed stands at each edge of a block.

    ``kept`` says that the node belongs to the article. Of a header only the headings are its text.
    """
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        elif x is None:
            yield "\0"
        elif x.name == "br":
            yield " "
        elif not x.dropped and not _menu(x, kept):
            block = x.name in BLOCKS
            children = [y for y in _in_order(x) if y.name in HEADINGS] if x.name == "header" else x.children
            stack += [None] * block + children[::-1] + [None] * block


def _in_order(node: Node) -> list[Node]:
    """The elements below a node in page order, dropped ones left out."""
    out, stack = [], [x for x in node.children[::-1] if isinstance(x, Node)]
    while stack:
        x = stack.pop()
        if not x.dropped:
            out.append(x)
            stack += [y for y in x.children[::-1] if isinstance(y, Node)]
    return out


def _menu(node: Node, kept: bool) -> bool:
    """A container of links. In the article a list of long entries, such as its references, is none."""
    if node.name not in LISTS or node.linked <= 0.8 * node.size:
        return False
    return not (kept and node.linked >= ITEM * node.anchors)


def main_text(page: str) -> str:
    """The article of a page: blocks joined by line feeds, white space in a block one space.

    Where classes and ids leave no text at all, they are not looked at.
    """
    page = page.replace("\0", "")
    return _article(parse(page)) or _article(parse(page, hints=False))


def _above(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _like(marked: Node) -> list[Node]:
    """An article and the articles beside it that are no teasers."""
    if marked.name != "article" or marked.parent is None:
        return [marked]
    return [
        x for x in marked.parent.children
        if x is marked or isinstance(x, Node) and not x.dropped and x.name == "article" and x.prose >= 80 and x.linked < 0.5 * x.size
    ]


def _parts(best: Node, scored: list[Node]) -> list[Node]:
    """The best container, and others with a fair share of its points that stand beside it, not above or below.

    One alone must have half of its points, several a third.
    """
    above = {id(x) for x in _above(best)}
    beside = [n for n in scored if n.points >= 0.3 * best.points and id(n) not in above and all(x is not best for x in _above(n))]
    if len(beside) == 1 and beside[0].points < 0.5 * best.points:
        beside = []
    return [best, *beside]


def _with_siblings(best: Node, parts: list[Node]) -> list[Node]:
    """What belongs to the article below the common ancestor of its parts.

    Children with a part of it or a fair share of the points belong to it, and so do headings and
    paragraphs of some length beside them.
    """
    if len(parts) > 1:
        shared = [{id(x) for x in _above(n)} for n in parts]
        top = next(x for x in _above(best) if all(id(x) in ids for ids in shared))
        holding = set().union(*shared)
    elif best.parent is not None and best.name != "body":
        top, holding = best.parent, {id(best)}
    else:
        return [best]
    limit = 0.2 * best.points
    return [
        x for x in top.children if isinstance(x, Node) and not x.dropped and (
            id(x) in holding or x.points >= limit or (x.name == "p" and x.size >= 80 and x.linked < 0.25 * x.size) or x.name in HEADINGS)
    ]


def _article(root: Node) -> str:
    scored = _score(root)
    if scored:
        best = max(scored, key=lambda n: n.points)
        # The container may be a part of an element that says it is the article.
        marked = best
        while marked is not None and marked.name not in ("article", "main"):
            marked = marked.parent
        if marked is not None:
            chosen = _like(marked)
        else:
            chosen = _with_siblings(best, _parts(best, scored))
    else:
        chosen = [root]
    text = "\0".join("".join(_pieces(x, True)) for x in chosen)
    lines = (" ".join(block.split()) for block in text.split("\0"))
    return "\n".join(line for line in lines if line)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py() or "") for x in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep``, ``text`` and ``n_chars``: one row per page, from its whole html.

    Paragraphs pass points for their length and commas to their ancestors, discounted by the share
    of linked text; the best container is kept, with siblings that score well, and so is what stands beside
    it below a common ancestor with a fair share of its points. Menus, headers, footers, asides, forms,
    scripts and elements whose class, id or role names an advert, a comment, a notice or the like are
    left out, unless such an element holds the bulk of the page's paragraphs (comments never do).
    An article keeps the headings of its own header and its lists of long links. Null and empty pages, and pages without text, give the empty
    text. Repeated rows come out repeated.
    """
    rows = pages.select(*keep, F.col(html_col).alias("html"))
    kinds = ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in keep)
    out = rows.mapInArrow(_extract, f"{kinds}, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))
