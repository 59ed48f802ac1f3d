"""Main text of web pages by tree scoring.

A lenient reader builds the page's tree and marks the elements that are set aside: menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments.  Each paragraph passes points for its length and its
commas to its parent and, halved at each level, to two further ancestors; an ancestor's points are discounted by the share of its
text that lies in links.  The best container wins; unless it is an article or main element, it grows to its parent as long as it holds most of the
parent's text and that is not links, and its good siblings are kept.  Blocks are given in page order.
"""

from __future__ import annotations

import functools
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names and the words in class, id and role that mark what is no main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form button select fieldset dialog menu head header script style noscript template textarea title iframe object canvas".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: an open p ends where one of these starts
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BLOCKS = ENDS_P | frozenset("body caption dd dialog dt figcaption hgroup legend li optgroup option search summary tbody td tfoot th thead tr".split()) | DROPPED
#: end tags go no further than the cell they are in, but for those of tables
CELLS = frozenset("td th caption".split())
TABLES = frozenset("table tbody thead tfoot tr td th caption".split())
NEGATIVE = frozenset(
    "ad ads adbox adsense banner sidebar nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe signup login comment comments commentlist respond disqus replies reply share sharing social related recommended recommendations widget toolbar skip searchform header "
    "contentinfo complementary search advert adverts advertisement advertisements advertising advertorial sponsor sponsors sponsored promo promos promotion promotions".split()
)
#: words that add nothing to what a name says: where a part stands, and what it is made of
STRUCTURAL = frozenset(
    "site page main global top bottom left right upper lower primary secondary inner outer box block area zone slot unit section region wrap wrapper container holder panel pane list item items bar row col column grid group "
    "links link buttons button icons icon form field input title heading label text body content post posts article articles story stories entry author meta thread user reader readers mobile desktop sticky fixed wp js".split()
)
#: words that are topics as well: as the id of a section they say little
TOPICAL = frozenset("ad ads notice notices alert comment reply replies share sharing social related recommended recommendations search menu navigation header login skip overlay consent subscribe popup modal widget".split())
#: a doubtful part with this share of its text in links is set aside
LINKED = 0.3
#: "has-sidebar" has a sidebar and is none
NOT_ITSELF = frozenset("has with no without".split())
POSITIVE = frozenset("article post story entry content main body text".split())
#: what shows that an element that was never closed does not reach this far
RESCUED = frozenset("article main h1".split())
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/$|^[^=]*/$""")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|object|canvas)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?][^>]*>"
    r"|</[^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)


def _words(name: str) -> list[str]:
    return [w for w in re.split(r"[_-]+|(?<=[a-z])(?=\d)|(?<=\d)(?=[a-z])", name) if w]


def _known(words: list[str]) -> bool:
    """A name that holds a word for what is set aside, and else only words that add nothing; "skip-to", "adbox" and "adBox" are such names."""
    rest = [w for w in words if w not in STRUCTURAL and not w.isdigit()]
    return bool(rest) and all(w in NEGATIVE for w in rest)


@functools.lru_cache(4096)
def judged(value: str) -> tuple[bool, bool, bool, bool]:
    """(known, head, modifier, good) for the value of a class, id or role.

    known: one of its names says nothing but what is set aside; head: a name ends so ("acme-sidebar"), as the last word of a compound says what a thing is; modifier: a name
    begins so ("related-work", "search-results"), which says little; good: a name marks main text.
    """
    known = head = modifier = good = False
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
        words = _words(name)
        if not words:
            continue
        last = [w for w in words if not w.isdigit() and w not in STRUCTURAL][-1:]
        if name == "hidden":
            known = True
        elif words[0] not in NOT_ITSELF:
            known = known or _known(words) or "".join(words) in NEGATIVE
            head = head or bool(last) and last[0] in NEGATIVE
            modifier = modifier or words[0] in NEGATIVE
        good = good or bool(POSITIVE & set(words))
    return known, head, modifier, good


class Node:
    __slots__ = ("tag", "parent", "children", "points", "weight", "length", "linked", "away", "doubtful", "closed", "inline")

    def __init__(self, tag: str, parent: Node | None, weight: int = 0, away: bool = False, doubtful: bool = False):
        self.tag, self.parent, self.children, self.weight, self.away, self.doubtful = tag, parent, [], weight, away, doubtful
        self.points = 0.0
        self.length = self.linked = 0
        self.closed = False
        #: elements that HTML does not know flow with the text, but custom ones stand for blocks
        self.inline = tag not in BLOCKS and "-" not in tag


def _attributes(tag: str, rest: str) -> tuple[int, bool, bool]:
    """(weight, set aside, doubtful) of an element; what is doubtful is set aside if links make up much of it.

    Ids are often slugs of headings: they count if all of a name is known, on containers only, and for a section not if its words are topics too.  Paragraphs and headings
    are set aside by a class that is known as a whole.
    """
    weight, away, doubtful = 0, tag in DROPPED, False
    if rest and not rest.isspace():
        for name, value in ATTRIBUTE.findall(rest):
            name = name.lower()
            if name == "hidden":
                away = True
            elif name == "aria-hidden":
                away = away or value.strip("\"'").lower() == "true"
            elif name in ("class", "id", "role"):
                value = html.unescape(value.strip("\"'"))
                known, head, modifier, good = judged(value)
                weight = 25 if good else weight
                if tag in ("article", "main"):
                    continue
                text = tag in HEADINGS or tag == "p"
                if name == "id":
                    certain = known and not text and not (tag == "section" and set(_words(value.lower())) & TOPICAL)
                else:
                    certain = known or (head and not text)
                away = away or certain
                doubtful = doubtful or ((known or head or modifier) and not text)
    return weight, away, doubtful


def parse(page: str) -> Node:
    """The tree; children are nodes and decoded strings.  Unclosed elements are closed by what follows, at the latest with their parent."""
    root = node = Node("body", None)
    loose: list[Node] = []  # set aside, and perhaps never closed
    for m in TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            node.children.append(html.unescape(text) if "&" in text else text)
            continue
        if m["raw"]:
            node.children.append(" ")
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            at = node
            if tag in BLOCKS or "-" in tag:
                while at is not None and at.tag != tag and (at.tag not in CELLS or tag in TABLES):
                    at = at.parent
            else:  # an inline element ends only within its block
                while at.inline and at.tag != tag:
                    at = at.parent
            if at is not None and at.tag == tag and at.parent is not None:
                at.closed = True
                node = at.parent
            continue
        if tag in ("html", "body"):
            continue
        if tag == "br" or tag == "hr":
            node.children.append("\n")
            if tag == "br":
                continue
        at = node
        while at.inline:
            at = at.parent
        if tag in ENDS_P:
            if at.tag == "p" or (tag in HEADINGS and at.tag in HEADINGS):
                at.closed = True
                node = at.parent
            else:
                node = at  # a block inside an inline element: that element is taken as closed
        elif tag in ("li", "td", "th", "tr", "dt", "dd", "option"):
            while at.inline or at.tag == "p":
                at = at.parent
            if at.tag == tag or (tag in ("td", "th") and at.tag in ("td", "th")) or (tag in ("dt", "dd") and at.tag in ("dt", "dd")):
                at.closed = True
                node = at.parent
        if tag in VOID or SELF_CLOSED.search(m["rest"]):
            continue
        child = Node(tag, node, *_attributes(tag, m["rest"]))
        node.children.append(child)
        node = child
        if child.away:
            loose.append(child)
    for at in loose:
        if not at.closed:
            _rescue(at)
    return root


def _rescue(node: Node) -> None:
    """A set-aside element without an end tag ends before the first article, main or h1 in it that is not set aside by itself."""
    stack, found = [node], None
    while stack and found is None:
        at = stack.pop()
        for c in at.children:
            if isinstance(c, Node) and not c.away:
                if c.tag in RESCUED:
                    found = c
                    break
                stack.append(c)
    while found is not None and found is not node:
        siblings = found.parent.children
        for i in range(siblings.index(found)):
            if isinstance(siblings[i], Node):
                siblings[i].away = True
            else:
                siblings[i] = " "
        found = found.parent
        found.away = False


def _below(root: Node) -> list[Node]:
    """Nodes in page order, without what is set aside."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.away)
    return order


def _measure(root: Node) -> list[Node]:
    """Text and link lengths of every node, bottom up without recursion; sets aside what is doubtful and full of links.  Nodes in page order, without what is set aside."""
    order, dropped = _below(root), False
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.length += len(c.strip())
            elif not c.away:
                node.length += c.length
                node.linked += c.length if c.tag == "a" else c.linked
        if node.doubtful and density(node) >= LINKED:
            node.away = dropped = True
    return _below(root) if dropped else order


def _own_text(node: Node) -> str:
    """Text of a node and its inline descendants."""
    parts, stack = [], [node]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            parts.append(at)
        else:
            stack.extend(c for c in reversed(at.children) if isinstance(c, str) or (c.inline and not c.away))
    return "".join(parts)


def density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def main_nodes(root: Node) -> list[Node]:
    """The best container with its good siblings."""
    order = _measure(root)
    scored: list[Node] = []
    for node in order:
        if node.inline:
            continue
        paragraph = node.tag in PARAGRAPHS
        text = " ".join(_own_text(node).split()) if paragraph or node.tag in ("div", "section", "article", "main") else ""
        if not text:
            continue
        points = 1.0 + text.count(",") + min(len(text) / 100, 3.0)
        at, share = (node.parent if paragraph and node.parent is not None else node), 1.0
        for _ in range(3):
            if at is None:
                break
            if not at.points:
                at.points = 1.0 + at.weight
                scored.append(at)
            at.points += points * share
            at, share = at.parent, share / 2
    if not scored:
        return [root]
    final = {id(n): n.points * (1 - density(n)) for n in scored}
    best = max(scored, key=lambda n: final[id(n)])
    while best.tag not in ("article", "main") and best.parent is not None and best.parent.parent is not None and 2 * best.length >= best.parent.length and density(best.parent) < 0.25:
        best = best.parent
    if best.parent is None:
        return [best]
    least = max(10.0, 0.2 * final.get(id(best), best.points))
    kept = []
    for n in best.parent.children:
        if not isinstance(n, Node) or n.away:
            continue
        good = n is best or final.get(id(n), 0.0) >= least
        if not good and (n.tag == "p" or n.tag in HEADINGS) and best.tag not in ("article", "main"):
            good = density(n) < 0.25 and n.length > 0
        if good:
            kept.append(n)
    return kept


def main_text(page: str | None) -> str:
    """Main text of one page: references decoded, white space inside a block one space, blocks joined by one space."""
    if not page:
        return ""
    words: list[str] = []
    for top in main_nodes(parse(page)):
        stack: list = [top]
        run: list[str] = []
        while stack:
            at = stack.pop()
            if at is None:  # end of a block
                words.extend("".join(run).split())
                run = []
            elif isinstance(at, str):
                run.append(at)
            elif at.away:
                run.append(" ")
            else:
                if not at.inline:
                    words.extend("".join(run).split())
                    run = []
                    stack.append(None)
                stack.extend(reversed(at.children))
        words.extend("".join(run).split())
    return " ".join(words)


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages plus text string; a clash with such a column of pages replaces it.

    Null and empty html give an empty text.  Repeated rows are read each time.  One narrow stage; memory is one batch.
    """
    from pyspark.sql import types as T

    pages = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() != "text"])
    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType())])

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("html")
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([main_text(x) for x in part.column(at).to_pylist()], pa.string())], names=[*part.schema.names, "text"])

    return pages.mapInArrow(run, schema)
