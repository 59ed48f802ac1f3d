"""Page tables: loading, native parsing and links.

Titles, articles, meta tags and links are read with expressions alone, so nothing leaves the JVM; tags and attributes are known by their place, whatever
their order, case and quotes.  operators/process.py has the full DOM parser for pages that need one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.functions import urls

#: the main record; nothing is ever inferred
PAGE = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("cleaned_text", T.StringType()),
        T.StructField("markdown", T.StringType()),
        T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("images", T.ArrayType(T.StringType())),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("author", T.StringType()),
                    T.StructField("description", T.StringType()),
                    T.StructField("keywords", T.ArrayType(T.StringType())),
                    T.StructField("publish_date", T.TimestampType()),
                    T.StructField("word_count", T.LongType()),
                    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
                    T.StructField("open_graph", T.StructType([T.StructField(n, T.StringType()) for n in ("title", "description", "image", "url", "type")])),
                ]
            ),
        ),
        T.StructField("crawled_at", T.TimestampType()),
        T.StructField("processed_at", T.TimestampType()),
    ]
)
ERROR = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "stage", "message")])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: one attribute of a tag: its name, and its value with its quotes
ATTRIBUTE = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""
#: what stands between `<name` and `>`; quoted values may hold `>`
INSIDE = r"""((?:[^>"']|"[^"]*"|'[^']*')*+)"""


def tags(html: Column, name: str) -> Column:
    """The attributes, as text, of every start tag of a name, in page order; comments, scripts, styles and templates are no places for tags."""
    seen = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|$)|<(script|style|textarea|template)\b.*?</\1\s*>", " ")
    return F.regexp_extract_all(seen, F.lit(rf"(?is)<{name}(?=[\s/>]){INSIDE}>"), F.lit(1))


def attribute(inside: Column, name: str) -> Column:
    """The value of an attribute of a tag: by its name, whatever the order, the case and the quotes; null if it is not there."""
    names = F.transform(F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(1)), lambda x: F.lower(x))
    at = F.array_position(names, name).cast("int")
    value = F.get(F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(2)), at - 1)
    value = F.when(value.rlike("""^["']"""), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    for shown, meant in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#38;", "&"), ("&amp;", "&")):
        value = F.replace(value, F.lit(shown), F.lit(meant))
    return F.when(at > 0, F.coalesce(value, F.lit("")))


def meta(html: Column, name: str, key: str = "name") -> Column:
    """The content of the first meta tag of that name (or property); null if there is none."""
    found = F.filter(tags(html, "meta"), lambda x: F.coalesce(F.lower(attribute(x, key)) == name, F.lit(False)))
    return attribute(F.get(found, F.lit(0)), "content")


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, path, title, content (inner HTML of the first article element), keywords (of the meta tag)."""
    html = F.col("html")
    words = F.transform(F.split(meta(html, "keywords"), ","), lambda x: F.trim(x))
    return pages.select(
        "page_id",
        "url",
        urls.path(F.col("url")).alias("path"),
        F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1).alias("title"),
        F.regexp_extract(html, r"(?is)<article(?:\s[^>]*)?>(.*?)</article\s*>", 1).alias("content"),
        F.coalesce(F.filter(words, lambda x: x != ""), F.array().cast("array<string>")).alias("keywords"),
    )


def links(pages: DataFrame) -> DataFrame:
    """HTML-08: page_id, url, pos, href, target; mail, script and telephone links go, the rest is resolved, repeats stay."""
    hrefs = F.filter(F.transform(tags(F.col("html"), "a"), lambda x: F.trim(attribute(x, "href"))), lambda x: x.isNotNull())
    found = pages.select("page_id", "url", F.posexplode(hrefs).alias("pos", "href"))
    kept = found.filter(~F.col("href").rlike(r"(?i)^(mailto:|javascript:|tel:)") & (F.col("href") != ""))
    return kept.select("page_id", "url", F.col("pos").cast("long").alias("pos"), "href", urls.resolve(F.col("url"), F.col("href")).alias("target"))
