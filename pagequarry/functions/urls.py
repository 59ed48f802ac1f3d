"""URL expressions (URL-01 to URL-16): Column in, Column out, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File endings that page paths lose, and those of documents
PAGE_ENDINGS = (".html", ".php", ".aspx")
DOCUMENT_SUFFIX = r"\.(pdf|docx?|pptx?|xlsx?)$"
DOCUMENT_ANYWHERE = r"\.(pdf|docx?|pptx?|xlsx?|zip|rar)"


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def host(url: Column) -> Column:
    """URL-01: host with port, lower case, without user names; null if the URL cannot be read."""
    return F.lower(F.regexp_replace(part(url, "AUTHORITY"), r"^.*@", ""))


def path(url: Column) -> Column:
    return F.coalesce(part(url, "PATH"), F.lit(""))


def canonical(url: Column) -> Column:
    """URL-03: without query and fragment."""
    return F.regexp_replace(url, r"[?#].*$", "")


def domain_allowed(host_: Column, domains: list[str], empty_allows: bool) -> Column:
    """URL-04: the host is one of the domains or below one; an empty list allows all (fetcher) or none (crawler)."""
    if not domains:
        return F.lit(empty_allows)
    wanted = F.array(*[F.lit(d.lower()) for d in domains])
    return F.coalesce(F.exists(wanted, lambda d: (host_ == d) | host_.endswith(F.concat(F.lit("."), d))), F.lit(False))


def _segments(path_: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(path_, "^/+|/+$", ""), "/"), lambda x: x != "")


def path_parts(path_: Column) -> Column:
    """URL-05: segments without page endings; `home` for the root."""
    strip = lambda x: F.when(x.contains("."), F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\.html$", ""), r"\.php$", ""), r"\.aspx$", "")).otherwise(x)
    parts = F.filter(F.transform(_segments(path_), strip), lambda x: x != "")
    return F.when(F.regexp_replace(path_, "^/+|/+$", "") == "", F.array(F.lit("home"))).otherwise(parts)


def nav_parts(path_: Column) -> Column:
    """URL-06: plain split, the root as one empty part."""
    return F.split(F.regexp_replace(path_, "^/+|/+$", ""), "/")


def path_depth(path_: Column) -> Column:
    """URL-07: parts of the trimmed path; the root has one."""
    return F.size(nav_parts(path_)).cast("long")


def topics(url: Column) -> Column:
    """URL-08: capitalised parts behind the host, those with a dot left out; `general` without a path, `General` if none is left."""
    rest = F.regexp_extract(url, r"https?://[^/]+/(.+)", 1)
    parts = F.filter(F.split(rest, "/"), lambda x: (x != "") & ~x.contains("."))
    named = F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30))))
    return F.when(rest == "", F.array(F.lit("general"))).when(F.size(named) == 0, F.array(F.lit("General"))).otherwise(named)


def category(path_: Column) -> Column:
    """URL-09: first match wins."""
    p = F.lower(path_)
    return (
        F.when(p.contains("blog") | p.contains("post"), "blog")
        .when(p.contains("doc") | p.contains("guide"), "documentation")
        .when(p.contains("api"), "api")
        .when(p.contains("tutorial") | p.contains("example"), "tutorial")
        .when((p == "/") | (p == ""), "home")
        .otherwise("general")
    )


#: Endings of generated asset names by kind
ASSET_ENDINGS = {"css": ".css", "javascript": ".js", "image": ".jpg", "document": ".pdf", "media": ".mp4"}


def file_name(url: Column, kind: Column) -> Column:
    """URL-10: last path segment if it has a dot, else a name from the host and the kind's ending (which collides within a host)."""
    last = F.element_at(F.split(path(url), "/"), -1)
    ending = F.coalesce(F.create_map(*[F.lit(x) for kv in ASSET_ENDINGS.items() for x in kv])[kind], F.lit(".bin"))
    return F.when(last.contains("."), last).otherwise(F.concat(F.coalesce(host(url), F.lit("")), F.lit("-asset"), ending))


def extension(path_: Column) -> Column:
    """URL-11: from the last dot, letters, digits and at most ten characters; else empty."""
    found = F.regexp_extract(path_, r"(\.[a-zA-Z0-9]+)$", 1)
    return F.when(F.length(found) <= 10, found).otherwise("")


def is_document(url: Column) -> Column:
    """URL-12: by suffix, so a query string defeats it."""
    return F.lower(url).rlike(DOCUMENT_SUFFIX)


def mentions_document(url: Column) -> Column:
    """URL-13: anywhere."""
    return F.lower(url).rlike(DOCUMENT_ANYWHERE)


def is_valid(url: Column) -> Column:
    """URL-14."""
    return F.coalesce((url != "") & (url != "invalid-url"), F.lit(False))


def slug(text: Column) -> Column:
    """URL-15."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def anchor(text: Column) -> Column:
    """URL-16: marks go, white space becomes hyphens."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-zA-Z0-9_\s-]", ""), r"\s+", "-"), "^-+|-+$", "")


def without_dots(path_: Column) -> Column:
    """A path from the root without `.` and `..` segments (RFC 3986, 5.2.4)."""
    parts = F.split(path_, "/")
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    folder = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(path_.contains("/."), F.array_join(F.concat(kept, folder), "/")).otherwise(path_)


def resolve(base: Column, href: Column) -> Column:
    """URL-02: relative to absolute by RFC 3986, in expressions; null without an absolute base, and an absolute reference is itself."""
    origin = F.nullif(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), F.lit(""))
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    base_path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    own, tail = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    folder = F.when(base_path.contains("/"), F.regexp_replace(base_path, "[^/]*$", "")).otherwise(F.lit("/"))
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(origin.isNull(), F.lit(None))
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when((href == "") | href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(origin, base_path, href))
        .when(href.startswith("/"), F.concat(origin, without_dots(own), tail))
        .otherwise(F.concat(origin, without_dots(F.concat(folder, own)), tail))
    )
