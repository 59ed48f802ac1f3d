"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, block by block; scores are integers.  Each round sends,
for a query, the counts of the score bins that can still hold the k-th value; the global sums narrow the
interval of that value until it is one score.  A last pass keeps scores at or above it and breaks ties by
the smaller id.  Nothing but counts of a few bins and the final few scores is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import materialise

BLOCK_ROWS = 8192
BINS = 512
EXACT = 1 << 53


def quantised(vectors: DataFrame, scale: int = 256, more: tuple = (), known: bool = True) -> DataFrame:
    """vec_id, q array<long> = floor(scale * x) and `more` columns; rows that are null or hold null or non-finite components go, and with `known` null ids."""
    x = F.col("embedding")
    fine = x.isNotNull() & (F.col("vec_id").isNotNull() | F.lit(not known)) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * float(scale)).cast("long")).alias("q"), *more)


def _blocks(q: DataFrame, n: int, name: str) -> DataFrame:
    """Packed blocks of about BLOCK_ROWS vectors of one dimension: block, ids, dims, bytes of a value (2 or 8), values."""
    fields = ((f"{name}_block", pa.int32()), (f"{name}_ids", pa.binary()), (f"{name}_dims", pa.int32()), (f"{name}_width", pa.int32()), (f"{name}_values", pa.binary()))

    def fold(key, table):
        ids = table.column("vec_id").to_numpy()
        rows = table.column("q").combine_chunks().to_pylist()
        groups: dict[int, list[int]] = {}
        for i in np.argsort(ids, kind="stable").tolist():
            groups.setdefault(len(rows[i]), []).append(i)
        out = []
        for d, g in groups.items():
            values = np.array([rows[i] for i in g], np.int64)
            small = not values.size or np.abs(values).max() < (1 << 15)
            out.append((key[0].as_py(), ids[g].tobytes(), d, 2 if small else 8, values.astype(np.int16 if small else np.int64).tobytes()))
        return pa.table([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(fields)], names=[c for c, _ in fields])

    blocks = max(1, -(-n // BLOCK_ROWS))
    packed = q.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("b")
    return materialise(packed.applyInArrow(fold, f"{name}_block int, {name}_ids binary, {name}_dims int, {name}_width int, {name}_values binary"))


def _matrix(r: dict, name: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(r[f"{name}_ids"], np.int64)
    return ids, np.frombuffer(r[f"{name}_values"], np.int16 if r[f"{name}_width"] == 2 else np.int64).reshape(len(ids), r[f"{name}_dims"])


def _largest(x: np.ndarray) -> float:
    return max(-float(x.min()), float(x.max()))


def integer_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; through BLAS where doubles are exact, refused where 64 bits could not hold them."""
    if q.size and c.size:
        most = _largest(q) * _largest(c) * q.shape[1]
        if most < EXACT:
            return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
        if most >= 1 << 62:
            raise ValueError("vectors are too large: a score might not fit 64 bits")
    return q.astype(np.int64) @ c.astype(np.int64).T


def _pairs_of_blocks(batches):
    """For each row of block pairs: query ids, candidate ids, scores, mask of a query's own rows; by slices of 512 queries."""
    for b in batches:
        for r in b.to_pylist():
            (qi, q), (ci, c) = _matrix(r, "q"), _matrix(r, "c")
            for at in range(0, len(qi), 512):
                s = integer_products(q[at : at + 512], c)
                yield r, qi[at : at + 512], ci, s, qi[at : at + 512, None] == ci[None, :]


def _range(batches):
    for _, qi, _, s, own in _pairs_of_blocks(batches):
        lo, hi = np.where(own, np.iinfo(np.int64).max, s).min(axis=1), np.where(own, np.iinfo(np.int64).min, s).max(axis=1)
        fine = lo <= hi
        yield pa.RecordBatch.from_arrays([pa.array(qi[fine]), pa.array(lo[fine]), pa.array(hi[fine]), pa.array((~own).sum(axis=1)[fine].astype(np.int64))], names=["query_id", "lo", "hi", "n"])


def _state(r: dict, qi: np.ndarray) -> np.ndarray:
    """Rows lo, span and need for the queries at hand, from the packed state of their block; need 0: no candidate."""
    ids, values = np.frombuffer(r["s_ids"], np.int64), np.frombuffer(r["s_values"], np.int64).reshape(3, -1)
    at = np.minimum(np.searchsorted(ids, qi), len(ids) - 1)
    return np.where(ids[at] == qi, values[:, at], np.array([[0], [1], [0]]))


def _histogram(batches):
    """Counts of bins from the top, down to the bin where this block alone has the scores still needed."""
    for r, qi, _, s, own in _pairs_of_blocks(batches):
        lo, span, need = _state(r, qi)
        width = bin_width(span)
        out: list[tuple] = []
        for i in range(len(qi)):
            x = s[i][~own[i]]
            x = (x[(x >= lo[i]) & (x < lo[i] + span[i])] - lo[i]) // width[i]
            if len(x) and need[i] > 0:
                if len(x) > need[i]:
                    x = x[x >= np.partition(x, len(x) - need[i])[len(x) - need[i]]]
                out.append((qi[i], *np.unique(x, return_counts=True)))
        if out:
            ids = np.repeat([o[0] for o in out], [len(o[1]) for o in out])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([o[2] for o in out]).astype(np.int64))], names=["query_id", "bin", "n"])


def bin_width(span):
    """BINS bins of this width cover an interval of `span` scores."""
    return np.maximum(1, -(-span // BINS))


def _final(k: int):
    def keep(batches):
        for r, qi, ci, s, own in _pairs_of_blocks(batches):
            lo, _, need = _state(r, qi)
            for i in range(len(qi)):
                at = np.flatnonzero((s[i] >= lo[i]) & ~own[i] & (need[i] > 0))
                at = at[np.lexsort((ci[at], -s[i][at]))][:k]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), qi[i])), pa.array(ci[at]), pa.array(s[i][at])], names=["query_id", "vec_id", "score"])

    return keep


def exact_top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query.

    vectors: vec_id, embedding array of numbers; is_query: a condition on vec_id.  Candidates are all rows of
    another vec_id and of the query's dimension; if there are fewer than k, all are returned.  Ties go to the smaller
    id.  Vectors that are null or hold null or non-finite components, and null ids, take no part.  Of rows that repeat a vec_id one
    (the smallest vector) counts.  Components so large that a score might not fit 64 bits are refused (ValueError in the job).  Empty input gives an empty result.
    """
    q = quantised(vectors, scale).groupBy("vec_id").agg(F.min("q").alias("q"))
    q = materialise(q)
    n, n_q = q.count(), q.filter(is_query).count()
    left = _blocks(q.filter(is_query), n_q, "q")
    right = _blocks(q, n, "c")
    nq, nc = max(1, -(-n_q // BLOCK_ROWS)), max(1, -(-n // BLOCK_ROWS))
    # the grid of query blocks and candidate blocks: each side is dealt to the cells of its row or column
    left = left.withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    right = right.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    # it is dealt anew in each round and never stored: what is kept is the blocks, once
    grid = left.join(right, ["q_block", "c_block"]).filter("q_dims = c_dims")
    score_range = grid.mapInArrow(_range, "query_id long, lo long, hi long, n long").groupBy("query_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    state = materialise(
        score_range.select(
            "query_id",
            "lo",
            (F.col("hi") - F.col("lo") + 1).alias("span"),
            F.least(F.lit(k).cast("long"), F.col("n")).alias("need"),
            F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("q_block"),
        )
    )

    def packed(state: DataFrame) -> DataFrame:
        def fold(key, t):
            ids = t.column("query_id").to_numpy()
            o = np.argsort(ids)
            values = np.stack([t.column(c).to_numpy()[o] for c in ("lo", "span", "need")])
            return pa.table({"q_block": pa.array([key[0].as_py()], pa.int32()), "s_ids": pa.array([ids[o].tobytes()], pa.binary()), "s_values": pa.array([values.tobytes()], pa.binary())})

        return state.groupBy("q_block").applyInArrow(fold, "q_block int, s_ids binary, s_values binary")

    while (state.agg(F.max("span")).first()[0] or 1) > 1:
        counts = grid.join(packed(state), "q_block").mapInArrow(_histogram, "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        # the first bin from the top whose running count reaches what is needed holds the k-th value
        reach = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("bin")))
        width = F.greatest(F.lit(1), F.ceil(F.col("span") / BINS)).cast("long")
        low = F.col("lo") + F.col("bin") * width
        state = materialise(
            counts.join(state, "query_id")
            .withColumn("reach", reach)
            .filter((F.col("reach") >= F.col("need")) & (F.col("reach") - F.col("n") < F.col("need")))
            .select("query_id", low.alias("lo"), F.least(width, F.col("lo") + F.col("span") - low).alias("span"), (F.col("need") - F.col("reach") + F.col("n")).alias("need"), "q_block")
        )
    found = grid.join(packed(state), "q_block").mapInArrow(_final(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
