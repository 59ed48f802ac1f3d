"""A small lenient DOM over the standard HTML reader, and a Markdown renderer (HTML-01 to HTML-09)."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin

#: Fixed values of the page processor: content selectors in order of priority, and what counts as boilerplate
CONTENT_SELECTORS = ("main", "article", ".content", "#content", ".post", ".entry", ".article-content")
BOILERPLATE_TAGS = ("script", "style", "nav", "footer", "aside", "header")
BOILERPLATE_MARKS = (".advertisement", ".ads", ".ad", ".sidebar", ".navigation", ".nav", ".menu", ".footer", ".header", "#sidebar")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
OPEN_MODE = frozenset("b i em strong a span code small u s sub sup font tt big".split())


class Element:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        """All elements below, in page order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def find(self, *tags: str) -> list[Element]:
        return [e for e in self.walk() if e.tag in tags]

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                stack.extend(reversed(c.children))
        return "".join(out)

    def matches(self, selector: str) -> bool:
        if selector[0] == ".":
            return selector[1:] in self.attrs.get("class", "").split()
        return self.attrs.get("id") == selector[1:] if selector[0] == "#" else self.tag == selector

    def inner(self) -> str:
        out: list[str] = []
        stack: list = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, tuple):
                out.append(c[0])
            elif isinstance(c, str):
                out.append(escape(c, quote=False))
            else:
                out.append(f"<{c.tag}" + "".join(f' {k}="{escape(v)}"' for k, v in c.attrs.items()) + ">")
                if c.tag not in VOID:
                    stack.append((f"</{c.tag}>",))
                    if c.tag in ("script", "style"):
                        out.append(c.text())
                    else:
                        stack.extend(reversed(c.children))
        return "".join(out)


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            up = self.at
            while up.tag in OPEN_MODE:
                up = up.parent
            if up.tag == "p":
                self.at = up.parent
        elif tag in SAME:
            up = self.at
            while up.tag in OPEN_MODE or up.tag == "p":
                up = up.parent
            if up.tag in SAME[tag]:
                self.at = up.parent
                if tag == "tr" and up.tag != "tr" and up.parent.tag == "tr":
                    self.at = up.parent.parent
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        up = self.at
        while up.tag != tag and up.parent is not None:
            up = up.parent
        if up.parent is not None:
            self.at = up.parent

    def handle_data(self, data):
        self.at.children.append(data)


#: an ampersand that begins no character reference with its semicolon
LOOSE = re.compile(r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);)")


def parse(html: str, closed_only: bool = False) -> Element:
    """HTML-01.  As browsers do, a reference without its semicolon (`&amp`, where a text was cut) is decoded too; with closed_only it stays as text."""
    reader = _Reader()
    reader.feed(LOOSE.sub("&amp;", html) if closed_only else html)
    reader.close()
    return reader.root


def body(root: Element) -> Element:
    return next((e for e in root.walk() if e.tag == "body"), root)


def _tiny(e: Element) -> bool:
    return e.tag == "img" and e.attrs.get("width") == "1" and e.attrs.get("height") == "1"


def strip_boilerplate(root: Element) -> Element:
    """HTML-03 on a tree, in place: six tags, marked boxes and tracking pixels go (the reader has left comments out)."""
    stack = [root]
    while stack:
        at = stack.pop()
        at.children = [c for c in at.children if isinstance(c, str) or not (c.tag in BOILERPLATE_TAGS or _tiny(c) or any(c.matches(m) for m in BOILERPLATE_MARKS))]
        stack.extend(c for c in at.children if isinstance(c, Element))
    return root


def find_main(root: Element, selectors=CONTENT_SELECTORS) -> Element | None:
    """HTML-02: the first match of the first selector that matches."""
    first: dict[str, Element] = {}
    for e in root.walk():
        for s in selectors:
            if s not in first and e.matches(s):
                first[s] = e
    return next((first[s] for s in selectors if s in first), None)


def resolve_links(root: Element, base: str) -> Element:
    """HTML-04 on a tree, in place."""
    for e in root.walk():
        for tag, name, skip in (("a", "href", ("http", "#", "mailto:")), ("img", "src", ("http", "data:"))):
            value = e.attrs.get(name, "")
            if e.tag == tag and value and not value.startswith(skip):
                try:
                    e.attrs[name] = urljoin(base, value)
                except ValueError:
                    pass
    return root


def without_boilerplate(html: str) -> str:
    """HTML-03: inner HTML of the body without comments, six tags, marked boxes and tracking pixels."""
    return body(strip_boilerplate(parse(html))).inner()


def main_content(html: str, selectors=CONTENT_SELECTORS) -> str:
    """HTML-02: inner HTML of the main content, else of the body without boilerplate."""
    found = find_main(parse(html), selectors)
    return found.inner().strip() if found is not None else without_boilerplate(html).strip()


def absolute_links(html: str, base: str) -> str:
    """HTML-04."""
    return body(resolve_links(parse(html), base)).inner()


def metadata(html: str | Element) -> dict:
    """HTML-05, HTML-06."""
    root = parse(html) if isinstance(html, str) else html
    meta: dict[str, str] = {}
    titles, heading = [], None
    for e in root.walk():
        if e.tag == "meta":
            key = e.attrs.get("name") or e.attrs.get("property")
            if key and key not in meta:
                meta[key] = e.attrs.get("content", "")
        elif e.tag == "title":
            titles.append(e.text())
        elif e.tag == "h1" and heading is None:
            heading = e.text().strip()
    keywords = meta.get("keywords", "")
    return {
        "title": "".join(titles).strip() or heading or meta.get("og:title") or "",
        "description": meta.get("description") or meta.get("og:description") or "",
        "keywords": [k.strip() for k in keywords.split(",")] if keywords else [],
        "author": meta.get("author", ""),
        "open_graph": {n: meta.get(f"og:{n}", "") for n in ("title", "description", "image", "url", "type")},
    }


def images(html: str | Element) -> list[str]:
    """HTML-07: sources that are neither empty, inline data nor tracking pixels; repeats stay."""
    root = parse(html) if isinstance(html, str) else html
    return [e.attrs["src"] for e in root.find("img") if e.attrs.get("src") and not e.attrs["src"].startswith("data:") and not _tiny(e)]


def page(html: str, base: str, selectors=CONTENT_SELECTORS, closed_only: bool = False) -> dict:
    """HTML-11: metadata, content, Markdown and images of a page, all from one tree."""
    root = parse(html, closed_only)
    out = metadata(root)
    main = resolve_links(body(strip_boilerplate(root)), base)
    found = find_main(main, selectors)
    main = found if found is not None else main
    return out | {"content": main.inner().strip(), "markdown": to_markdown(main), "images": images(main)}


WHITE = re.compile(r"[ \t\n\r\f]+")
LISTS = ("ul", "ol")
#: lists below this level are not indented further
DEEPEST = 64


def to_markdown(html: str | Element) -> str:
    """HTML-09.  Elements are rendered from the innermost outwards, without recursion, so depth costs no stack."""
    top = body(parse(html)) if isinstance(html, str) else html
    order, stack = [], [(top, False)]
    celled: set[int] = set()  # tables in cells of tables: Markdown has none, so they are text
    while stack:
        e, in_cell = stack.pop()
        order.append(e)
        if in_cell and e.tag == "table":
            celled.add(id(e))
        in_cell = in_cell or e.tag in ("td", "th")
        stack.extend((c, in_cell) for c in e.children if isinstance(c, Element))
    done: dict[int, str] = {}

    def shown(c: Element | str) -> str:
        return WHITE.sub(" ", c) if isinstance(c, str) else done.get(id(c), "")

    def inline(children) -> str:
        return WHITE.sub(" ", "".join(map(shown, children))).strip(" ")

    def is_list(c) -> bool:
        return isinstance(c, Element) and c.tag in LISTS

    def items(e: Element) -> str:
        """Lines of a list and of the lists directly in its items."""
        out, open_ = [], [(e, 0, iter(e.children), 0)]
        while open_:
            at, depth, rest, n = open_.pop()
            for c in rest:
                if isinstance(c, Element) and c.tag == "li":
                    n += 1
                    out.append("  " * min(depth, DEEPEST) + (f"{n}. " if at.tag == "ol" else "- ") + inline(x for x in c.children if not is_list(x)) + "\n")
                    open_.append((at, depth, rest, n))
                    open_.extend((x, depth + 1, iter(x.children), 0) for x in reversed(c.children) if is_list(x))
                    break
        return "".join(out)

    def table(e: Element) -> str:
        rows, below = [], [iter(e.children)]
        while below:  # the rows of this table, not of tables in its cells
            c = next(below[-1], None)
            if c is None:
                below.pop()
            elif isinstance(c, Element) and c.tag == "tr":
                rows.append([inline(x.children) for x in c.children if isinstance(x, Element) and x.tag in ("td", "th")])
            elif isinstance(c, Element) and c.tag != "table":
                below.append(iter(c.children))
        rows = [r for r in rows if r]
        if not rows:
            return ""
        if id(e) in celled:
            return " ".join(x for r in rows for x in r if x)
        width = max(map(len, rows))
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        return "\n\n" + "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) + "\n\n"

    def one(c: Element) -> str:
        t = c.tag
        if t in ("script", "style", "title", "head"):
            return ""
        if t[0] == "h" and t[1:].isdigit():
            return f"\n\n{'#' * int(t[1:])} {inline(c.children)}\n\n"
        if t == "br":
            return "  \n"
        if t == "hr":
            return "\n\n---\n\n"
        if t in ("b", "strong", "i", "em"):
            inner, mark = inline(c.children), "**" if t in ("b", "strong") else "*"
            return f"{mark}{inner}{mark}" if inner else ""
        if t == "a":
            return f"[{inline(c.children)}]({c.attrs.get('href', '')})" if c.attrs.get("href") else inline(c.children)
        if t == "img":
            return f"![{c.attrs.get('alt', '')}]({c.attrs.get('src', '')})"
        if t == "pre":
            return f"\n\n```\n{c.text().strip(chr(10))}\n```\n\n"
        if t == "code":
            return f"`{c.text()}`"
        if t in LISTS:
            inside = c.parent is not None and c.parent.tag == "li" and c.parent.parent is not None and c.parent.parent.tag in LISTS
            return "" if inside else "\n\n" + items(c) + "\n"  # a list in an item is a part of the outer list's lines
        if t == "table":
            return table(c)
        inner = "".join(map(shown, c.children))
        if t == "blockquote":
            return "\n\n" + "\n".join("> " + x for x in inner.strip().split("\n")) + "\n\n"
        return f"\n\n{inner.strip()}\n\n" if t in ENDS_P or t == "#root" else inner

    for e in reversed(order):
        # the element that was asked for is a frame, whatever its tag
        done[id(e)] = "".join(map(shown, e.children)) if e is top else one(e)
        for c in e.children:
            if isinstance(c, Element) and e.tag not in ("li", *LISTS, "td", "th", "tr", "tbody", "thead", "tfoot", "table"):
                done.pop(id(c), None)  # what is in here has been used
    return re.sub(r"\n(?:[ \t]*\n){2,}", "\n\n", done[id(top)]).strip()


def assets(html: str, base: str, all_candidates: bool = False) -> list[tuple[str, str, str, str]]:
    """AS-01, AS-02: (type, url, attribute, original) by family, then page order; without all_candidates the first of each (type, url) only."""
    root = parse(html)
    elements = list(root.walk())
    out: list[tuple[str, str, str, str]] = []

    def add(kind: str, raw: str, attr: str) -> None:
        try:
            url = urljoin(base, raw) if raw else ""
        except ValueError:
            url = ""
        if url:
            out.append((kind, url, attr, raw))

    def candidates(value: str) -> list[str]:
        found = [c.split()[0] for c in value.split(",") if c.split()]
        return found if all_candidates else found[:1]

    def inside(e: Element, tags) -> bool:
        while (e := e.parent) is not None:
            if e.tag in tags:
                return True
        return False

    families = [
        lambda e: e.tag == "img" and add("img", e.attrs.get("src", ""), "src"),
        lambda e: e.tag == "img" and [add("img", c, "srcset") for c in candidates(e.attrs.get("srcset", ""))],
        lambda e: e.tag == "source" and [add("img", c, "srcset") for c in candidates(e.attrs.get("srcset", ""))],
        lambda e: (e.tag == "source" and inside(e, ("video", "audio")) or all_candidates and e.tag in ("video", "audio")) and add("media", e.attrs.get("src", ""), "src"),
        lambda e: e.tag == "link" and e.attrs.get("rel") == "stylesheet" and add("stylesheet", e.attrs.get("href", ""), "href"),
        lambda e: e.tag == "link" and e.attrs.get("rel") == "preload" and e.attrs.get("as", "").lower() in PRELOADS and add(PRELOADS[e.attrs["as"].lower()], e.attrs.get("href", ""), "href"),
        lambda e: e.tag == "script" and add("script", e.attrs.get("src", ""), "src"),
        lambda e: e.tag == "a" and re.search(r"\.(pdf|docx?|pptx?|xlsx?)$", e.attrs.get("href", "").lower()) and add("doc", e.attrs.get("href", ""), "href"),
    ]
    for family in families:
        for e in elements:
            family(e)
    return out if all_candidates else list({(k, u): (k, u, a, o) for k, u, a, o in reversed(out)}.values())[::-1]


#: Kinds of preloaded assets
PRELOADS = {"image": "img", "script": "script", "style": "stylesheet", "stylesheet": "stylesheet"}


def rewrite(html: str, base: str, local: dict[str, str]) -> str:
    """AS-09: attributes whose resolved URL has a local path get it, every candidate of a srcset on its own."""
    root = parse(html)

    def place(raw: str) -> str:
        try:
            return local.get(urljoin(base, raw), raw)
        except ValueError:
            return raw

    for e in root.walk():
        for name in ("src", "href"):
            if e.attrs.get(name):
                e.attrs[name] = place(e.attrs[name])
        if e.attrs.get("srcset"):
            parts = [c.split() for c in e.attrs["srcset"].split(",") if c.split()]
            e.attrs["srcset"] = ", ".join(" ".join([place(p[0]), *p[1:]]) for p in parts)
    return body(root).inner()
