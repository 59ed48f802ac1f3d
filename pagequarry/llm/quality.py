"""Quality rules: base counts and a log-likelihood ratio of hashed n-grams, in DataFrame expressions only.

Tokens are runs of letters and digits, and runs of other marks; tokens and pairs of neighbours are hashed into a fixed number of bins.  Two multinomials over the bins are counted:
one of all documents, one of the trusted documents that are not set aside to find the threshold.  A document's score is the mean, over its n-grams, of the logarithm of
their ratio.  Weights are whole numbers (65,536 to a nat), so sums, and with them every verdict, do not depend on the order of rows or machines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import materialise

BINS = 1 << 14
#: parts of a weight to a nat, and of those to a step of the score
PARTS, STEP = 65536.0, 64.0
#: ids of trusted documents are broadcast up to this number; more are joined by a shuffle
MOST_BROADCAST = 1 << 20

WORD = r"[^\x20\x09-\x0D]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\x20\x09-\x0D\p{L}\p{N}_]+"
SYMBOL = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def with_repeated_words(rows: DataFrame) -> DataFrame:
    """rows (with words and their number n) plus n_repeat_words: the words that lie in a window of three that the text has more than once.

    Windows are sorted with their places, so equal ones are neighbours; the places found are sorted again and each covers three words, less what the next one covers.
    """
    last = F.greatest(F.col("n") - 2, F.lit(0))
    window = F.arrays_zip(*(F.slice("words", F.lit(i), last) for i in (1, 2, 3)))
    place = F.when(F.col("n") >= 3, F.sequence(F.lit(0), F.col("n") - 3)).otherwise(F.array().cast("array<int>"))
    rest = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c), F.lit(1)))
    # a step each: an expression within another would be computed for each element
    rows = rows.withColumn("_ranked", F.sort_array(F.arrays_zip(window.alias("w"), place.alias("p"))))
    same = F.zip_with("_ranked", rest("_ranked"), lambda a, b: F.when(a["w"] == b["w"], F.array(a["p"], b["p"])))
    rows = rows.withColumn("_places", F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))
    steps = F.zip_with("_places", rest("_places"), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return rows.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)).drop("_ranked", "_places")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of each row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("words", words_of(F.col("text"))).withColumn("n", F.size("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD))
    rows = with_repeated_words(rows.withColumn("lines", lines))
    count = lambda c: F.char_length(c).cast("long")
    counts = {
        "n_words": F.col("n").cast("long"),
        "word_chars": count(F.array_join("words", "")),
        "n_symbols": F.regexp_count("text", F.lit(SYMBOL)).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": F.col("n_repeat_words"),
    }
    rows = rows.select("doc_id", "text", *(c.alias(name) for name, c in counts.items()))
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _bin(gram: Column) -> Column:
    return (F.crc32(gram.cast("binary")) % BINS).cast("int")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id, trusted: of each labelled document; one with several rows is trusted if all of them say so."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return known.groupBy("doc_id").agg((F.min("quality") == 1).alias("trusted"))


def set_aside() -> Column:
    """A fifth of the labelled documents finds the threshold and is in no target count."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def bin_weights(docs: DataFrame, target: DataFrame) -> list[int]:
    """The weight of each bin: PARTS times the logarithm of target's share over the corpus's share, each with one added to every bin.

    Every n-gram of every document is counted, in partial sums of at most BINS rows a task; target: doc_id.
    """
    marked = target.withColumn("in_target", F.lit(1))
    few = marked.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    rows = docs.select("doc_id", "text").join(F.broadcast(marked) if few else marked, "doc_id", "left")
    rows = rows.select("in_target", tokens_of(F.coalesce("text", F.lit(""))).alias("t"))
    pairs = rows.select("in_target", F.explode(F.arrays_zip(F.col("t").alias("a"), F.slice("t", F.lit(2), F.greatest(F.size("t"), F.lit(1))).alias("b"))).alias("g")).select("in_target", "g.a", "g.b")
    bins = pairs.select("in_target", F.explode(F.array(_bin(F.col("a")), _bin(F.concat("a", F.lit(" "), "b")))).alias("bin")).filter("bin IS NOT NULL")
    counted = materialise(bins.groupBy("bin").agg(F.count("*").alias("raw"), F.count("in_target").alias("own")))
    raw, own = counted.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("own"), F.lit(0))).first()
    share = lambda c, total: F.log((F.col(c) + 1) / F.lit(float(total + BINS)))
    weight = F.floor(PARTS * (share("own", own) - share("raw", raw)) + 0.5).cast("long")
    have = {r["bin"]: r["w"] for r in counted.select("bin", weight.alias("w")).collect()}  # BINS rows at most: the model
    return [have.get(b, 0) for b in range(BINS)]


def scores(rows: DataFrame, weights: list[int]) -> DataFrame:
    """rows (with text) plus step: the mean weight of a document's n-grams, in whole steps of STEP; 0 without n-grams."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")
    at = lambda gram: F.get(F.col("_weights"), _bin(gram))
    rows = rows.withColumn("_weights", table).withColumn("_t", tokens_of(F.col("text")))
    zipped = F.arrays_zip(F.col("_t").alias("a"), F.slice("_t", F.lit(2), F.greatest(F.size("_t"), F.lit(1))).alias("b"))
    total = F.aggregate(zipped, F.lit(0).cast("long"), lambda s, g: s + at(g["a"]) + F.coalesce(at(F.concat(g["a"], F.lit(" "), g["b"])), F.lit(0).cast("long")))
    n = 2 * F.size("_t") - 1
    return rows.withColumn("step", F.when(n > 0, F.floor(total / (n * STEP))).otherwise(0).cast("int")).drop("_t", "_weights")


def threshold(scored: DataFrame, known: DataFrame) -> int | None:
    """The step from which a document passes: with the fewest mistakes on the labelled documents set aside, half way from the lowest such step to the one below.  None: no such document.

    Counts come by step, of which there are some ten thousands at most, whatever the number of documents.
    """
    rows = scored.filter(~F.col("base_failed")).filter(set_aside()).join(known, "doc_id")
    steps = rows.groupBy("step").agg(F.count_if("trusted").alias("good"), F.count_if(~F.col("trusted")).alias("bad"))
    lost = F.coalesce(F.sum("good").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    let_in = F.sum("bad").over(Window.orderBy("step").rowsBetween(0, Window.unboundedFollowing))
    tried = steps.select("step", (lost + let_in).alias("mistakes"), F.lag("step").over(Window.orderBy("step")).alias("below"))
    best = tried.agg(F.min(F.struct("mistakes", "step", "below")).alias("b")).first()["b"]
    if best is None:
        return None
    return best["step"] if best["below"] is None else (best["step"] + best["below"]) // 2


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, step of each row of docs.

    docs: doc_id, text; labels: doc_id, quality (1: trusted).  kept: the base rules do not fail and the score reaches the threshold.  A null text is empty; empty texts and texts of
    fewer than 50 words fail.  Labels count by doc_id; null ids and null labels are no labels.  Each of repeated rows is judged, and counted, by itself.  Without trusted
    documents all weights are equal to the corpus's own, and without labelled documents set aside every score passes.  Other columns are not looked at.
    """
    known = materialise(trusted_ids(labels))
    target = known.filter("trusted").filter(~set_aside()).select("doc_id")
    weights = bin_weights(docs, target) if target.limit(1).count() else [0] * BINS
    scored = materialise(scores(base_counts(docs), weights).drop("text"))
    least = threshold(scored, known)
    passed = F.lit(True) if least is None else F.col("step") >= least
    return scored.withColumn("kept", ~F.col("base_failed") & passed)
