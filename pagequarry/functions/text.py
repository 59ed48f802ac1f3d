"""Text expressions (TXT-01 to TXT-18, QLT-01 to QLT-14): Column in, Column out.

Lengths are bytes where the semantics count bytes (octet_length).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markup characters that search text loses, and technical terms that become keywords
MARKUP = r"[<>#*\-_\[\](){}]"
TECHNICAL_TERMS = ("api", "guide", "setup", "install", "config", "auth", "security", "docs", "documentation", "reference", "tutorial", "example")


def fields(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def word_count(html: Column) -> Column:
    """TXT-01: words once tags are spaces."""
    return F.regexp_count(F.regexp_replace(html, "<[^>]*>", " "), F.lit(r"(?U)\S+")).cast("long")


def word_count_by_field(text: Column) -> Column:
    """TXT-02: white-space fields that do not start with a tag."""
    return F.regexp_count(text, F.lit(r"(?U)(?<!\S)[^\s<]\S*")).cast("long")


def word_count_split(text: Column) -> Column:
    """TXT-03: as TXT-02 with a space before every tag."""
    return word_count_by_field(F.replace(text, F.lit("<"), F.lit(" <")))


def tag_count(text: Column) -> Column:
    """TXT-04."""
    return (F.length(text) - F.length(F.replace(text, F.lit("<"), F.lit("")))).cast("long")


def markdown_headings(markdown: Column) -> Column:
    """TXT-05: array<struct<level, title>> of the lines that are headings once trimmed; fences are not special."""
    lines = F.transform(F.split(markdown, "\n"), trimmed)
    hits = F.filter(lines, lambda x: x.rlike(r"^#{1,6}\s+.+$"))
    return F.transform(hits, lambda x: F.struct(F.length(F.regexp_extract(x, r"^(#{1,6})\s", 1)).cast("long").alias("level"), trimmed(F.regexp_extract(x, r"^#{1,6}\s+(.+)$", 1)).alias("title")))


def sections(content: Column, start_level: int, max_depth: int) -> Column:
    """TXT-06: array<struct<level, title>> of headings at a line's start, within the depth."""
    marks = F.regexp_extract_all(content, F.lit(r"(?md)^(#{1,6})\s+(.+)$"), F.lit(1))
    titles = F.regexp_extract_all(content, F.lit(r"(?md)^(#{1,6})\s+(.+)$"), F.lit(2))
    both = F.zip_with(marks, titles, lambda m, t: F.struct((F.length(m) + F.lit(start_level - 1)).cast("long").alias("level"), trimmed(t).alias("title")))
    return F.filter(both, lambda x: x["level"] <= max_depth)


def without_markup(text: Column) -> Column:
    return F.regexp_replace(text, MARKUP, " ")


def search_text(content: Column, most: int = 1000) -> Column:
    """TXT-07: markup as spaces, cut to `most` characters (a cut by bytes could split a character)."""
    return F.substring(without_markup(content), 1, most)


def tokens(content: Column) -> Column:
    """TXT-08: lower-case words of more than three bytes; the reference's stop words are all shorter."""
    return F.filter(fields(F.lower(without_markup(content))), lambda x: F.octet_length(x) > 3)


def common_lines(a: Column, b: Column) -> Column:
    """TXT-09: trimmed lines of a beyond ten bytes that b has as well, in a's order, repeats kept.

    What both have is found once, by hashes, and bound to a name: an expression within a lambda is evaluated for each line.
    """
    lines = lambda t: F.transform(F.split(trimmed(t), "\n"), trimmed)
    both = F.filter(F.array_intersect(lines(a), lines(b)), lambda x: F.octet_length(x) > 10)
    kept = F.transform(F.array(both), lambda common: F.when(F.size(common) > 0, F.filter(lines(a), lambda x: F.array_contains(common, x))).when(common.isNotNull(), common))
    return F.array_join(F.element_at(kept, 1), "\n")


def title_keywords(title: Column) -> Column:
    """TXT-10."""
    return F.filter(fields(F.lower(title)), lambda x: F.octet_length(x) > 3)


def distinct_strings(values: Column) -> Column:
    """TXT-13: first occurrences, without empty ones."""
    return F.filter(F.array_distinct(values), lambda x: x != "")


def page_keywords(parts: Column, metadata: Column, content: Column) -> Column:
    """TXT-11: path parts, metadata keywords and technical terms that the content has."""
    terms = F.filter(F.array(*[F.lit(t) for t in TECHNICAL_TERMS]), lambda t: F.contains(F.lower(content), t))
    return distinct_strings(F.concat(parts, metadata, terms))


def search_keywords(metadata: Column, path: Column, title: Column) -> Column:
    """TXT-12: metadata keywords, raw path parts beyond two bytes, lower-case title words beyond three."""
    parts = F.filter(F.split(path, "/"), lambda x: F.octet_length(x) > 2)
    words = F.transform(F.filter(fields(title), lambda x: F.octet_length(x) > 3), lambda x: F.lower(x))
    return distinct_strings(F.concat(metadata, parts, words))


def snippet(content: Column, terms: list[str], most: int = 150, before: int = 50) -> Column:
    """TXT-14: a window round the first query term (in query order) that occurs; else the beginning."""
    lowered = F.lower(content)
    at = F.coalesce(*[F.when(F.locate(t, lowered) > 0, F.locate(t, lowered) - 1) for t in terms], F.lit(-1)) if terms else F.lit(-1)
    start = F.when(at > before, at - before).otherwise(0)
    size = F.length(content)
    cut = F.substring(content, start + 1, F.lit(most))
    window = F.concat(F.when(start > 0, "...").otherwise(""), cut, F.when(start + most < size, "...").otherwise(""))
    return F.when(at >= 0, window).when(size <= most, content).otherwise(F.concat(F.substring(content, 1, most), F.lit("...")))


def snippet_for(content: Column, terms: Column, most: int = 150, before: int = 50) -> Column:
    """TXT-14 for a column of terms."""
    lowered = F.lower(content)
    first = F.get(F.filter(terms, lambda t: F.contains(lowered, t)), F.lit(0))
    at = F.coalesce(F.position(first, lowered) - 1, F.lit(-1))
    start = F.when(at > before, at - before).otherwise(0)
    size = F.length(content)
    window = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(content, start + 1, F.lit(most)), F.when(start + most < size, "...").otherwise(""))
    return F.when(at >= 0, window).when(size <= most, content).otherwise(F.concat(F.substring(content, 1, most), F.lit("...")))


def truncated_for_js(content: Column, most: int = 200) -> Column:
    """TXT-15: at most `most` characters (a cut by bytes could split a character)."""
    return F.substring(content, 1, most)


def content_type(title: Column, content: Column) -> Column:
    """TXT-16: first match wins."""
    t, c = F.lower(title), F.lower(content)
    out = None
    for name in ("reference", "guide", "tutorial", "example"):
        hit = t.contains(name) | c.contains(name)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(c.contains("api") & c.contains("method"), "api").otherwise("article")


def minified(text: Column) -> Column:
    """TXT-17: white space collapsed, if that is shorter."""
    short = F.regexp_replace(text, r"(?U)\s+", " ")
    return F.when(F.octet_length(short) < F.octet_length(text), short).otherwise(text)


def comma_list(text: Column) -> Column:
    """TXT-18: trimmed items, empty ones kept."""
    return F.transform(F.split(text, ","), trimmed)


def markdown_clean(markdown: Column) -> Column:
    """HTML-10: at most one empty line in a row, escapes undone, table cells trimmed, other lines without trailing spaces."""
    m = F.replace(F.replace(F.regexp_replace(markdown, r"\n{3,}", "\n\n"), F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
    cells = lambda x: F.array_join(F.transform(F.split(x, r"\|"), lambda c: F.trim(c)), " | ")
    line = lambda x: F.when(x.contains("|"), F.trim(cells(x))).otherwise(F.regexp_replace(x, " +$", ""))
    return F.array_join(F.transform(F.split(m, "\n"), line), "\n")


def escape_html(text: Column) -> Column:
    """HTML-13."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


# quality -------------------------------------------------------------------------------------------------------------------------


def has_heading(content: Column, levels: str = "12") -> Column:
    """QLT-07 (levels 1-6) and QLT-10 (1-2)."""
    return content.rlike(f"<h[{levels}]")


#: columns that `counted` adds
COUNTS = ("word_count", "field_count", "tag_count", "title_bytes")


def counted(pages: DataFrame) -> DataFrame:
    """pages plus the counts of content and title that quality and validation share (TXT-01, TXT-02, TXT-04).

    They come from a generator of one row: expressions and filters on its columns are not pushed below it, so the text of a page is read once, not once for each use of a count.
    """
    content, title = F.col("content"), F.col("title")
    counts = F.struct(word_count(content).alias("word_count"), word_count_by_field(content).alias("field_count"), tag_count(content).alias("tag_count"), F.octet_length(trimmed(title)).alias("title_bytes"))
    return pages.select(*[F.col(c) for c in pages.columns if c not in COUNTS], F.inline(F.array(counts)))


def density(content: Column, words: Column, tags: Column) -> Column:
    """QLT-03: fields that are no tags against those and tags; no tags 1, no words 0."""
    return F.when(content == "", 0.0).when(tags == 0, 1.0).when(words == 0, 0.0).otherwise(words.cast("double") / (words + tags).cast("double"))


def quality_score(content: Column, words: Column, fields_: Column, tags: Column, size: Column) -> Column:
    """QLT-02: deductions in a fixed order; size: bytes of the trimmed title."""
    score = F.lit(1.0) - F.when(size == 0, 0.2).when(size < 10, 0.1).otherwise(0.0)
    score = score - F.when(words < 10, 0.3).when(words < 50, 0.15).otherwise(0.0)
    score = score - F.when(~has_heading(content) & (words > 100), 0.15).otherwise(0.0)
    d = density(content, fields_, tags)
    score = score - F.when(d < 0.3, 0.25).when(d < 0.5, 0.1).otherwise(0.0)
    return F.when(trimmed(content) == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def reading_time(words: Column) -> Column:
    """QLT-04: minutes at 200 words, at least one if there are words."""
    return F.when(words <= 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(words / 200))).cast("long")


def within(value: Column, low: int, high: int) -> Column:
    """QLT-05, QLT-06."""
    return (value >= low) & (value <= high)


def description_ok(description: Column, required: bool) -> Column:
    """QLT-12."""
    return F.lit(True) if not required else F.coalesce(trimmed(description) != "", F.lit(False))


def tag_ratio_ok(content: Column, words: Column, tags: Column, most: float) -> Column:
    """QLT-08, QLT-11: tags against fields that are none; a limit of one or more allows all."""
    return F.when(F.lit(most >= 1.0), True).when(content == "", False).when(tags == 0, True).when(words == 0, False).otherwise(tags.cast("double") / words.cast("double") <= most)


def validation(content: Column, words: Column, tags: Column, t: Column) -> Column:
    """QLT-01: struct<score, issues, has_headings, is_valid>; t: bytes of the trimmed title."""
    empty = trimmed(content) == ""
    thin = (words >= 5) & (words <= 15) & (tags > 0) & (words.cast("double") / tags.cast("double") < 1.0)
    first = F.when(t == 0, "missing_title").when(t < 10, "title_too_short")
    second = F.when(words < 5, "content_too_short").when(thin, "low_content_density")
    third = F.when((words >= 15) & ~has_heading(content) & first.isNull() & second.isNull(), "no_headings")
    score = F.lit(1.0) - F.when(t == 0, 0.4).when(t < 10, 0.3).otherwise(0.0) - F.when(words < 5, 0.4).when(thin, 0.3).otherwise(0.0) - F.when(third.isNotNull(), 0.2).otherwise(0.0)
    issues = F.when(empty, F.array(F.lit("no_content"))).otherwise(F.filter(F.array(first, second, third), lambda x: x.isNotNull()))
    score = F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), score))
    return F.struct(score.alias("score"), issues.alias("issues"), (has_heading(content) & ~empty).alias("has_headings"), ((score >= 0.6) & (F.size(issues) == 0)).alias("is_valid"))


# hashes --------------------------------------------------------------------------------------------------------------------------


def fnv32a(text: Column) -> Column:
    """STR-08: 32-bit FNV-1a of the UTF-8 bytes, native: a fold over the hexadecimal digits."""
    digits = F.hex(F.encode(text, "UTF-8"))
    steps = F.when(F.length(digits) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)))
    return F.aggregate(steps, F.lit(2166136261).cast("long"), lambda h, i: (h.bitwiseXOR(F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long")) * F.lit(16777619).cast("long")) % F.lit(4294967296).cast("long"))
