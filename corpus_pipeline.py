"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

All stages but the last return the columns of documents (doc_id, text, lang, source, n_chars).  None of them can be said in SQL, so
ORACLE_SQL is None and the tests hold each against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import jaccard_join, langid, packing, substring_dedup, toxicity
from pagequarry.llm.common import read_table, scratch_dir
from pagequarry.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents that the classifier, trained on the labelled ones among them, calls toxic go."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).filter("predicted = 0").select(*COLUMNS)


def reject_undetermined(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: documents of no language (null, or without a letter) go; a null lang takes the recognised one, and stays if no document has a lang to learn from."""
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs)
    kept = langid.predict(docs, model, letters=True).filter("has_letter")
    return (kept.withColumn("lang", F.coalesce("lang", "lang_pred")) if model.labels else kept).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: of the documents that links of Jaccard similarity 0.8 or more (five-word shingles) join, the one of smallest doc_id stays, once; different texts under one doc_id are different documents."""
    docs = docs.select(*COLUMNS)
    # a doc_id may have several texts: each is a node of its own, named by a hash
    nodes = docs.filter("doc_id IS NOT NULL").withColumn("node", F.xxhash64("doc_id", "text"))
    components = jaccard_join.jaccard_components(nodes.select(F.col("node").alias("doc_id"), "text"), words=5, percent=80).select(F.col("doc_id").alias("node"), "component_id").distinct()
    least = nodes.select("node", "doc_id").distinct().join(components, "node").groupBy("component_id").agg(F.min(F.struct("doc_id", "node")).alias("v"))
    known = nodes.join(least.select("v.node"), "node", "left_semi").dropDuplicates(["doc_id", "node"]).drop("node")
    return known.unionByName(docs.filter("doc_id IS NULL"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: passages of 50 words or more that a document of smaller doc_id has are cut; a document that loses all its words goes."""
    cut = substring_dedup.remove_repeated_words(docs.select(*COLUMNS), window=50, layout=True)
    left = cut.filter("n_removed = 0 OR n_removed < n_words").withColumn("text", F.col("kept"))
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: power-of-two packing of every text that is left."""
    pieces = packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=2, max_length=4096)
    return pieces.withColumn("ids_crc32", F.crc32("token_bytes"))


STAGES = [
    ("toxicity", reject_toxic),
    ("language ID", reject_undetermined),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", cut_repeats),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of `documents` after all stages."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
