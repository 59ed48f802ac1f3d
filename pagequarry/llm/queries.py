"""Registered queries of the corpus operators: thin digests of each operator's full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import embedding_dedup, hard_negatives, html_text, jaccard_join, langid, packing, quality, sentencepiece_op, substring_dedup, suffix_dedup, topk, toxicity, whitening
from pagequarry.llm.common import read_table


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; only its path is used, never a copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(modulus: int, remainder: int):
    """crc32 of doc_id as text leaves `remainder`."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_op.PieceModel.load(tokenizer_path("piece_bpe_32k.model"))
    encoded = sentencepiece_op.encode_documents(read_table(spark, sf_dir, "documents"), model)
    decoded = sentencepiece_op.decode_documents(encoded, model)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(read_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2, max_length=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"), words=4, percent=85)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~held_out(4, 2)))
    return langid.predict(docs.select("doc_id", held_out(4, 2).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeated_words(read_table(spark, sf_dir, "documents").select("doc_id", "text"), window=50)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeated_bytes(read_table(spark, sf_dir, "documents").select("doc_id", "text"), window=50)
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(docs.filter(~held_out(5, 0)), labels.filter(~held_out(5, 0)))
    return toxicity.score_documents(docs.select("doc_id", held_out(5, 0).alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", label, "embedding")
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80, high=100, scale=256)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), components=4, scale=256)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_embedding_dedup, op3_packing, op4_jaccard_join, op5_language_id, op6_substring_dedup, op7_html, op8_suffix_dedup, op9_toxicity, op10_topk, op11_hard_negatives, op12_whitening, op13_quality)}


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), r(vec_id, c) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.j, r.c FROM r JOIN l ON l.i = r.vec_id
), n AS (SELECT i, count(*) AS n FROM l GROUP BY i), m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id)
SELECT m.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c AS component_id, m.vec_id = c AS kept FROM m LEFT JOIN n ON n.i = m.vec_id
"""

OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), t AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, unnest(range(len(words))) AS pos FROM w
), g AS (SELECT doc_id, n, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS gram FROM t
), s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN n < 4 THEN 'short ' || gram ELSE gram END AS gram FROM g WHERE pos <= n - 4 OR (n < 4 AND pos = 0)
), z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS MATERIALIZED (SELECT i.a, i.b FROM i JOIN z x ON x.doc_id = i.a JOIN z y ON y.doc_id = i.b WHERE 100 * i.n >= 85 * (x.n + y.n - i.n)
), r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id
), m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, component_id FROM m LEFT JOIN z USING (doc_id)
"""

OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), t AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM w
), g AS (SELECT doc_id, pos, word, string_agg(word, ' ') OVER f AS gram, count(*) OVER f AS n FROM t WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
), h AS (SELECT doc_id, pos, word, n = 50 AND doc_id > min(doc_id) OVER (PARTITION BY n = 50, gram) AS hit FROM g
), c AS (SELECT doc_id, pos, word, coalesce(bool_or(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM h
), a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN a USING (doc_id)
"""

#: says the same for pages with one article element and no references but these five
OP7_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages
), d AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM a)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""

OP8_SQL = """
WITH w AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), t AS (SELECT doc_id, h, unnest(range(n - 49)) AS pos FROM w WHERE n >= 50
), g AS MATERIALIZED (SELECT doc_id, pos, substring(h, 2 * pos + 1, 100) AS gram FROM t
), f AS (SELECT gram, min(doc_id) AS first FROM g GROUP BY gram HAVING min(doc_id) < max(doc_id)
), h AS (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 50 THEN 0 ELSE 1 END AS new FROM g JOIN f USING (gram) WHERE doc_id > first
), i AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM h
), r AS MATERIALIZED (SELECT doc_id, min(pos) AS s, max(pos) + 50 AS e FROM i GROUP BY doc_id, run
), a AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id
), k AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS s, s AS e FROM r
  UNION ALL SELECT w.doc_id, coalesce(max(r.e), 0), any_value(w.n) FROM w LEFT JOIN r USING (doc_id) GROUP BY w.doc_id
), p AS (SELECT k.doc_id, string_agg(substring(h, 2 * k.s + 1, 2 * (k.e - k.s)), '' ORDER BY k.s) AS kept FROM k JOIN w USING (doc_id) GROUP BY k.doc_id)
SELECT w.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM w LEFT JOIN a USING (doc_id) LEFT JOIN p USING (doc_id)
"""

OP10_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP11_SQL = """
WITH q AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same WHERE 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT * FROM n WHERE rank <= 5
"""

#: crc32 by its bitwise rule: a table of 256 values, then a fold over the bytes of each distinct n-gram
OP13_SQL = r"""
WITH crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), k AS (SELECT doc_id, min(quality) = 1 AS trusted FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), w AS MATERIALIZED (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)
), n AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY rid
), g3 AS (SELECT rid, pos, lead(word, 2) OVER o IS NOT NULL AS whole, (word, lead(word) OVER o, lead(word, 2) OVER o) AS g FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)
), rw AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, g) AS c FROM g3 WHERE whole) WHERE c > 1
), rp AS (SELECT rid, count(*) AS n_repeat_words FROM (SELECT DISTINCT rid, pos + unnest([0, 1, 2]) AS pos FROM rw) GROUP BY rid
), ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d
), dl AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), b AS MATERIALIZED (
  SELECT d.rid, doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN n USING (rid) LEFT JOIN dl USING (rid) LEFT JOIN rp USING (rid)
), t AS (SELECT rid, doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\x20\x09-\x0D\p{L}\p{N}_]+') AS ts FROM d
), g AS MATERIALIZED (SELECT rid, doc_id, unnest(list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1]))) AS gram FROM t
), h AS (SELECT gram, hex(encode(gram)) AS x FROM (SELECT DISTINCT gram FROM g)
), i AS (SELECT gram, list_transform(range(1, len(x), 2), lambda j: 16 * (instr('0123456789ABCDEF', x[j]) - 1) + instr('0123456789ABCDEF', x[j + 1]) - 1) AS bytes FROM h
), j AS MATERIALIZED (SELECT gram, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes::BIGINT[]), lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1])), 4294967295::BIGINT) % 16384 AS bin FROM i, crc
), ids AS (SELECT doc_id, hex(encode(doc_id::VARCHAR)) AS x FROM k
), aside AS MATERIALIZED (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda j: 16 * (instr('0123456789ABCDEF', x[j]) - 1) + instr('0123456789ABCDEF', x[j + 1]) - 1)::BIGINT[]), lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1])), 4294967295::BIGINT) % 5 = 0 AS out FROM ids, crc
), c AS (SELECT bin, count(*) AS raw, count(*) FILTER (trusted AND NOT out) AS own FROM g JOIN j USING (gram) LEFT JOIN k USING (doc_id) LEFT JOIN aside USING (doc_id) GROUP BY bin
), s AS (SELECT sum(raw) + 16384 AS r, sum(own) + 16384 AS o FROM c
), v AS (SELECT bin, CAST(floor(65536.0::DOUBLE * (ln((own + 1) / o::DOUBLE) - ln((raw + 1) / r::DOUBLE)) + 0.5) AS BIGINT) AS w FROM c, s
), z AS MATERIALIZED (SELECT b.*, b.n_words < 50 OR 100 * b.n_repeat_words > 50 * b.n_words AS base_failed, coalesce(step, 0) AS step
  FROM b LEFT JOIN (SELECT rid, CAST(floor(sum(w)::DOUBLE / (count(*) * 64.0::DOUBLE)) AS INTEGER) AS step FROM g JOIN j USING (gram) JOIN v USING (bin) GROUP BY rid) USING (rid)
), e AS (SELECT step, count(*) FILTER (trusted) AS good, count(*) FILTER (NOT trusted) AS bad FROM z JOIN k USING (doc_id) JOIN aside USING (doc_id) WHERE out AND NOT base_failed GROUP BY step
), m AS (SELECT step, coalesce(sum(good) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(bad) OVER (ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mistakes, lag(step) OVER (ORDER BY step) AS below FROM e
), least AS (SELECT CAST(floor((step + coalesce(below, step)) / 2.0) AS INTEGER) AS step FROM m ORDER BY mistakes, step LIMIT 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(step >= (SELECT step FROM least), true) AS kept FROM z
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_dedup": OP2_SQL, "op4_jaccard_join": OP4_SQL, "op6_substring_dedup": OP6_SQL, "op7_html": OP7_SQL, "op8_suffix_dedup": OP8_SQL, "op10_topk": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op13_quality": OP13_SQL}
