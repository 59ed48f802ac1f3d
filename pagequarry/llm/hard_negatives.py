"""Hard negatives by a two-dimensional block matrix multiply.

The anchors' rows, the candidates' rows and the dimensions are sharded: a block of anchors, a block of candidates and a chunk of dimensions make one partial
tile of 64-bit integer scores.  The partial tiles of a cell (anchors x candidates) are shuffled to one place and added there; what leaves the cell is only the
best few rows of each anchor, or of each window of an anchor and a positive.  Blocks hold rows of one label where a label has enough of them, so positives come
from the cells of equal labels, negatives from the others, and each score is computed once.  A label with very many rows has many blocks, none larger than others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import materialise
from pagequarry.llm.topk import integer_products, quantised

#: rows of a block of anchors and of candidates; a full partial tile takes 16 MB
ANCHOR_ROWS, CANDIDATE_ROWS = 512, 4096
#: a label with this share of a block's rows has blocks of its own
OWN_SHARE = 16
#: a table of labels with blocks of their own is broadcast up to this size
MOST_BROADCAST = 1 << 20


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, values) of a column of lists without nulls."""
    column = column.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets[:-1], np.diff(offsets), column.values.to_numpy()


def _blocks(rows: DataFrame, size: int, name: str, chunks: int) -> DataFrame:
    """Packed blocks of about `size` rows of one dimension, a row for each chunk of dimensions; ids and labels travel with chunk 0."""
    counts = materialise(rows.groupBy("label").agg(F.count("*").alias("n")))
    own = F.col("n") >= size // OWN_SHARE
    large = counts.filter(own).select("label", F.ceil(F.col("n") / size).cast("long").alias("parts"))
    n_large, rest = counts.agg(F.count_if(own), F.coalesce(F.sum(F.when(~own, F.col("n"))), F.lit(0))).first()
    large = F.broadcast(large) if n_large <= MOST_BROADCAST else large
    # two keys of one hash only make a block of both: labels and ids are looked at row by row
    mixed = F.xxhash64(F.lit(0), F.pmod(F.xxhash64("label"), F.lit(max(1, -(-rest // size)))))
    pure = F.xxhash64(F.lit(1), "label", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    keyed = rows.join(large, "label", "left").select("vec_id", "label", "q", F.when(F.col("parts").isNotNull(), pure).otherwise(mixed).alias("block"))
    fields = (("block", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("width", pa.int32()), ("values", pa.binary()))
    fields = (("dims", pa.int32()), ("chunk", pa.int32()), *((f"{name}_{c}", t) for c, t in fields))

    def fold(key, table):
        ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        starts, lengths, flat = _lists(table.column("q"))
        out = []
        for d in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == d)
            at = at[np.argsort(ids[at], kind="stable")]
            x = flat[starts[at][:, None] + np.arange(d)]
            small = not x.size or (int(x.max()) < 1 << 15 and int(x.min()) >= -(1 << 15))
            x = x.astype(np.int16 if small else np.int64)
            step = max(1, -(-d // chunks))
            for k, s in enumerate(range(0, max(d, 1), step)):
                names = (ids[at].tobytes(), labels[at].tobytes()) if k == 0 else (None, None)
                out.append((d, k, key[0].as_py(), int(labels[at].min()), int(labels[at].max()), *names, x.dtype.itemsize, np.ascontiguousarray(x[:, s : s + step]).tobytes()))
        return pa.table([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(fields)], names=[c for c, _ in fields])

    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return materialise(keyed.groupBy("block").applyInArrow(fold, ", ".join(f"{c} {kinds[t]}" for c, t in fields)))


TILES = "a_block long, c_block long, dims int, chunk int, a_ids binary, a_labels binary, c_ids binary, c_labels binary, windows binary, tile binary"


def _tiles(batches):
    """A partial tile for each row of a block of anchors, a block of candidates and a chunk of dimensions."""
    for b in batches:
        for r in b.to_pylist():
            a, c = (np.frombuffer(r[f"{n}_values"], np.int16 if r[f"{n}_width"] == 2 else np.int64) for n in "ac")
            dims = r["columns"]
            n, m = r["a_rows"], r["c_rows"]
            tile = integer_products(a.reshape(n, dims), c.reshape(m, dims)) if dims else np.zeros((n, m), np.int64)
            row = [r["a_block"], r["c_block"], r["dims"], r["chunk"], r["a_ids"], r["a_labels"], r["c_ids"], r["c_labels"], r["windows"], tile.tobytes()]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 6
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[f.split()[0] for f in TILES.split(", ")])


def _cell(table: pa.Table):
    """ids and labels of anchors and candidates, the windows, and the sum of a cell's partial tiles."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    names = [np.frombuffer(rows[0][c], np.int64) for c in ("a_ids", "a_labels", "c_ids", "c_labels")]
    tile = np.zeros((len(names[0]), len(names[2])), np.int64)
    for r in rows:
        tile += np.frombuffer(r["tile"], np.int64).reshape(tile.shape)
    return *names, rows[0]["windows"], tile


def best(at: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k places of `at` with the highest scores, ties by smaller id, in that order."""
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _positives(k: int):
    def reduce(key, table):
        a, la, c, lc, _, tile = _cell(table)
        out = []
        for i in range(len(a)):
            at = best(np.flatnonzero((lc == la[i]) & (c != a[i])), tile[i], c, k)
            out.append((np.full(len(at), a[i]), c[at], tile[i][at]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        block = np.full(len(columns[0]), key[0].as_py(), np.int64), np.full(len(columns[0]), key[2].as_py(), np.int32)
        return pa.table(dict(zip(("a_block", "dims", "anchor_id", "positive_id", "positive_score"), (*block, *columns), strict=True)))

    return reduce


def _negatives(k: int, low: int, high: int):
    def reduce(key, table):
        a, la, c, lc, windows, tile = _cell(table)
        anchor, positive, score = np.frombuffer(windows, np.int64).reshape(3, -1)
        out = [[np.zeros(0, np.int64)] * 5]
        rows = np.searchsorted(a, anchor)  # a block's ids ascend
        for w, i in enumerate(rows.tolist()):
            p = int(score[w])
            s = tile[i]
            at = best(np.flatnonzero((lc != la[i]) & (s >= -(-low * p // 100)) & (s <= high * p // 100)), s, c, k)
            out.append([np.full(len(at), v) for v in (anchor[w], positive[w])] + [c[at], np.full(len(at), p), s[at]])
        names = ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")
        return pa.table(dict(zip(names, (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    return reduce


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, chunks: int = 2) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: rows of other labels that score nearly as high as an anchor's positives.

    vectors: vec_id, label (an integer), embedding; is_anchor: a condition on vec_id.  Components become floor(scale * x), a score is the integer inner product with the anchor.
    An anchor's positives are its first `positives` other rows of its label; for each, the first `negatives` rows of other labels with
    low * positive <= 100 * negative <= high * positive are returned.  Higher scores come first, ties by smaller vec_id; where there are fewer, all are returned.

    Rows with a null vec_id, label or vector, or with null or non-finite components, take no part.  Only vectors of equal length are compared.  Of rows that repeat a
    vec_id one (the smallest label and vector) counts.  An anchor without positives, and a positive without negatives, has no rows; an empty table gives none.  A positive score
    below zero has no negatives if low < high.  Components so large that a score might not fit 64 bits are refused (ValueError in the job).
    """
    fine = quantised(vectors.filter(F.col("label").isNotNull()), scale, (F.col("label").cast("long").alias("label"),))
    rows = materialise(fine.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("v")).select("vec_id", "v.label", "v.q"))
    anchors = _blocks(rows.filter(is_anchor), ANCHOR_ROWS, "a", chunks)
    candidates = _blocks(rows, CANDIDATE_ROWS, "c", chunks)
    down, across = (max(1, b.filter("chunk = 0").count()) for b in (anchors, candidates))
    slots = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("a_slot", F.pmod(F.xxhash64("a_block", "dims"), F.lit(down)).cast("int")).withColumn("c_slot", slots(across))
    right = candidates.withColumn("c_slot", F.pmod(F.xxhash64("c_block", "dims"), F.lit(across)).cast("int")).withColumn("a_slot", slots(down))
    # the columns of this chunk: the last one may be narrower
    step = F.greatest(F.lit(1), F.ceil(F.col("dims") / chunks)).cast("int")
    columns = F.least(step, F.col("dims") - F.col("chunk") * step).alias("columns")
    size = lambda n: F.when(columns > 0, F.octet_length(f"{n}_values") / (F.col(f"{n}_width") * columns)).otherwise(F.octet_length(f"{n}_ids") / 8).cast("int").alias(f"{n}_rows")
    wanted = ["a_block", "c_block", "dims", "chunk", "a_ids", "a_labels", "c_ids", "c_labels", "a_values", "a_width", "c_values", "c_width", "windows", columns, size("a"), size("c")]

    def cells(left: DataFrame, met: Column):
        """The summed tiles' groups of the cells that `met` asks for."""
        grid = left.join(right, ["a_slot", "c_slot", "dims", "chunk"]).filter(met).select(*wanted)
        return grid.mapInArrow(_tiles, TILES).groupBy("a_block", "c_block", "dims")

    overlap = (F.col("a_low") <= F.col("c_high")) & (F.col("c_low") <= F.col("a_high"))
    found = cells(left.withColumn("windows", F.lit(None).cast("binary")), overlap).applyInArrow(_positives(positives), "a_block long, dims int, anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = materialise(found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= positives).drop("n"))

    def fold(key, t):
        windows = np.stack([t.column(c).to_numpy() for c in ("anchor_id", "positive_id", "positive_score")])
        return pa.table({"a_block": pa.array([key[0].as_py()], pa.int64()), "dims": pa.array([key[1].as_py()], pa.int32()), "windows": pa.array([windows.tobytes()], pa.binary())})

    windows = found.groupBy("a_block", "dims").applyInArrow(fold, "a_block long, dims int, windows binary")
    one_label = (F.col("a_low") == F.col("a_high")) & (F.col("c_low") == F.col("c_high")) & (F.col("a_low") == F.col("c_low"))
    out = cells(left.join(windows, ["a_block", "dims"]), ~one_label).applyInArrow(_negatives(negatives, low, high), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
