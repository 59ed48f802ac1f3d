"""Text files of a rendered site (TRE-03, SCH-06, SCH-07, SNK-04): small templates over bounded results on the driver."""

from __future__ import annotations

import json
from collections.abc import Iterable
from html import escape

SEARCH_CODE = """
export function search(query, entries = searchIndex, least = 2) {
  const terms = query.toLowerCase().split(/\\s+/).filter(Boolean);
  if (query.length < least) return [];
  const rate = (e, t) => (e.title.toLowerCase().includes(t) ? 3 : 0) + (`${e.title} ${e.content} ${e.keywords}`.toLowerCase().includes(t) ? 1 : 0);
  return entries
    .map(e => ({...e, score: terms.reduce((s, t) => s + rate(e, t), 0)}))
    .filter(e => e.score > 0)
    .sort((a, b) => b.score - a.score || (a.url < b.url ? -1 : 1));
}
"""


def search_script(entries: Iterable[dict], most: int = 200) -> str:
    """SCH-06: entries with title, url, content (cut to `most` characters), keywords."""
    rows = [{"title": e["title"], "url": e["url"], "content": e["content"][:most], "keywords": " ".join(e["keywords"])} for e in entries]
    return f"export const searchIndex = {json.dumps(rows, ensure_ascii=False)};\n{SEARCH_CODE}"


def style_sheet(dark: bool = False, code: bool = True, responsive: bool = True, printing: bool = True, accent: str = "#2563eb") -> str:
    """SCH-07."""
    rules = [f":root {{ --accent: {accent}; --page: #fff; --ink: #1f2937 }}", "body { background: var(--page); color: var(--ink); font: 16px/1.6 system-ui; margin: 0 auto; max-width: 72ch; padding: 1rem }", "a { color: var(--accent) }"]
    if dark:
        rules.append("@media (prefers-color-scheme: dark) { :root { --page: #111827; --ink: #e5e7eb } }")
    if code:
        rules.append("pre, code { background: #8882; border-radius: 4px; font-family: ui-monospace, monospace } pre { overflow: auto; padding: .8rem }")
    if responsive:
        rules.append("@media (max-width: 40rem) { body { padding: .5rem } nav ul { padding-left: .8rem } }")
    if printing:
        rules.append("@media print { nav { display: none } a { color: inherit } }")
    return "\n".join(rules) + "\n"


def navigation_list(nodes: Iterable[dict]) -> str:
    """TRE-03: nested lists from nodes (path, parent, title, url), ordered by path, without recursion."""
    below: dict[str, list[dict]] = {}
    for n in sorted(nodes, key=lambda n: n["path"]):
        below.setdefault(n["parent"], []).append(n)
    out = ["<ul>"]
    stack: list = [iter(below.get("", []))]
    while stack:
        node = next(stack[-1], None)
        if node is None:
            stack.pop()
            out.append("</ul>" + ("</li>" if stack else ""))
            continue
        label = escape(node["title"])
        children = below.get(node["path"], []) if node["path"] else []
        shown = f'<a href="{escape(node["url"])}">{label}</a>' if node["url"] else f"<span>{label}</span>"
        if children:
            out.append(f"<li>{shown}<ul>")
            stack.append(iter(children))
        else:
            out.append(f"<li>{shown}</li>")
    return "".join(out)
