"""Page processing (HTML-11, HTML-12): parse once in Arrow batches, everything else native."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import text

PROCESSED = "page_id long, url string, title string, content string, markdown string, description string, author string, keywords array<string>, images array<string>, error string"


def processed(pages: DataFrame, keep: tuple[str, ...] = (), closed_only: bool = False) -> DataFrame:
    """page_id, url, title, content, markdown, description, author, keywords, images, error, word_count, validation of every page (page_id, url, html), and its `keep` columns.

    Boilerplate goes, links become absolute, the main content is taken and rendered; metadata is read from the raw page, images from the content: all
    from one tree.  A page that is empty, starts with `<<` or cannot be processed is an error row; nothing is dropped.
    closed_only: character references without a semicolon stay as text (see dom.parse).
    """
    from pyspark.sql import types as T

    rows = pages.select("page_id", "url", "html", *keep)
    schema = T.StructType([*T.StructType.fromDDL(PROCESSED).fields, *[rows.schema[c] for c in keep]])

    def run(batches):
        import pyarrow as pa

        from pagequarry.functions import dom

        for b in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in PROCESSED.split(", ")}
            for i, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                row = dict.fromkeys(out)
                row |= {"page_id": i, "url": url}
                if not html or html.startswith("<<"):
                    row["error"] = "empty content" if not html else "malformed content"
                else:
                    try:
                        page = dom.page(html, url or "", closed_only=closed_only)
                        row |= {k: page[k] for k in ("title", "description", "author", "keywords", "content", "markdown", "images")}
                    except Exception as e:  # noqa: BLE001 - a page that breaks the reader is its own row's error
                        row["error"] = f"processing failed: {type(e).__name__}: {e}"
                for k, v in row.items():
                    out[k].append(v)
            kinds = {"page_id": pa.int64(), "keywords": pa.list_(pa.string()), "images": pa.list_(pa.string())}
            yield pa.RecordBatch.from_arrays([*[pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()], *[b.column(b.schema.get_field_index(c)) for c in keep]], names=[*out, *keep])

    done = rows.mapInArrow(run, schema)
    done = done.withColumn("markdown", text.markdown_clean(F.col("markdown"))).withColumn("word_count", text.word_count(F.col("content")))
    content, title = F.coalesce("content", F.lit("")), F.coalesce("title", F.lit(""))
    return done.withColumn("validation", text.validation(content, F.coalesce("word_count", F.lit(0)), text.tag_count(content), F.octet_length(text.trimmed(title))))
