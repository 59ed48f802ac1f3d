"""Whitening of embeddings by a one-sided Jacobi SVD of a blockwise QR factor.

Centred rows are compressed block by block to triangles R (a tall-skinny QR), triangles are stacked and factored again in a tree until one is left; no task holds more than
a block of rows or FAN_IN triangles.  Plane rotations then make the columns of that one small triangle orthogonal.  Their norms are the singular values, small ones as
accurate as large ones, and the accumulated rotations are the components.  The covariance matrix itself is never formed.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import materialise
from pagequarry.llm.topk import quantised

#: triangles that one task stacks and factors
FAN_IN = 32
#: rows that are centred and factored at a time, before the triangle so far is put on top
BLOCK_ROWS = 8192
#: integers below this are exact as doubles, and sums of their products fit 64 bits
EXACT, WIDE = 1 << 53, 1 << 62


def _matrix(column, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(d: int):
    """Sums of each dimension over a task's rows, as decimals, with the number of rows."""

    def run(batches):
        total, n = [0] * d, 0
        for b in batches:
            x = _matrix(b.column(0), d)
            if len(x):
                most = max(abs(int(x.max())), abs(int(x.min())))
                part = x.sum(axis=0) if most * len(x) < WIDE else x.astype(object).sum(axis=0)
                total, n = [t + int(p) for t, p in zip(total, part, strict=True)], n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[Decimal(t) for t in total]], pa.list_(pa.decimal128(38, 0)))], names=["n", "s"])

    return run


def scaled_deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit integers where they hold it, else Python's."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), 1) * n + max(map(abs, sums), default=0)
    if most < WIDE:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, rounded once from the exact quotient's parts."""
    return scaled_deviations(x, n, sums).astype(np.float64) / n


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _leaf(d: int, n: int, sums: list[int]):
    """One triangle for each task: blocks of centred rows are factored below the triangle so far."""

    def run(batches):
        r = np.zeros((0, d))
        for b in batches:
            x = _matrix(b.column(0), d)
            for at in range(0, len(x), BLOCK_ROWS):
                r = _triangle(np.vstack([r, centred(x[at : at + BLOCK_ROWS], n, sums)]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])

    return run


def _stack(d: int):
    def run(key, table):
        r = np.zeros((0, d))
        for part in table.column("r").to_pylist():
            r = _triangle(np.vstack([r, np.frombuffer(part).reshape(-1, d)]))
        return pa.table({"r": pa.array([r.tobytes()], pa.binary())})

    return run


def tall_skinny_r(fit: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """The triangle of the centred fit list; only this d x d matrix comes to the driver."""
    level = materialise(fit.select("q").mapInArrow(_leaf(d, n, sums), "r binary"))
    left = level.count()
    while left > 1:
        groups = -(-left // FAN_IN)
        # which triangles meet is free; their bytes deal them evenly
        dealt = level.groupBy(F.pmod(F.xxhash64("r"), F.lit(groups)).alias("g"))
        level = materialise(dealt.applyInArrow(_stack(d), "r binary"))
        left = level.count() if groups > 1 else 1
    return np.frombuffer(level.first()["r"]).reshape(-1, d)


def jacobi_svd(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, falling; V): plane rotations make the columns of r orthogonal.

    A sweep pairs the columns in rounds (each with each, once), and the rotations of a round touch disjoint columns, so a round is one array operation.  Done when no
    two columns are further from orthogonal than rounding.
    """
    d = r.shape[1]
    # rotations go to the columns, as rows of the transposed, in the order of their norms, which speeds convergence
    u = np.array(r.T, np.float64)
    scale = np.abs(u).max(initial=0.0) or 1.0
    u /= scale
    v = np.eye(d)
    order = np.argsort(-np.einsum("ij,ij->i", u, u), kind="stable")
    u, v = u[order], v[order]
    seats = list(range(d)) + ([-1] if d % 2 else [])
    limit = np.finfo(float).eps * np.sqrt(max(d, 1))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = np.array([(a, b) for a, b in zip(seats[:half], seats[: half - 1 : -1], strict=True) if a >= 0 and b >= 0], np.int64).reshape(-1, 2)
            seats[1:] = [seats[-1], *seats[1:-1]]
            i, j = pairs[:, 0], pairs[:, 1]
            a, b, c = (np.einsum("ij,ij->i", u[x], u[y]) for x, y in ((i, i), (j, j), (i, j)))
            size = np.sqrt(a) * np.sqrt(b)
            with np.errstate(divide="ignore", invalid="ignore"):
                cosine = np.where(size > 0, np.abs(c) / size, 0.0)
            turn = cosine > limit
            worst = max(worst, float(cosine.max(initial=0.0)))
            if not turn.any():
                continue
            i, j, a, b, c = i[turn], j[turn], a[turn], b[turn], c[turn]
            with np.errstate(over="ignore"):
                zeta = (b - a) / (2.0 * c)
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = 1.0 / np.hypot(1.0, t)
            sin = cos * t
            for m in (u, v):
                m[i], m[j] = cos[:, None] * m[i] - sin[:, None] * m[j], sin[:, None] * m[i] + cos[:, None] * m[j]
        if worst <= limit:
            break
    norms = np.sqrt(np.einsum("ij,ij->i", u, u)) * scale
    order = np.argsort(-norms, kind="stable")
    v = v[order]
    # either sign would do: the largest entry is positive
    if d:
        v *= np.where(v[np.arange(d), np.abs(v).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return norms[order], v.T


def _whitened(d: int, n: int, sums: list[int], axes: np.ndarray, deviations: np.ndarray, names: list[str]):
    """names, deviation and the list of whitened values for each row; a component without variance is null."""

    def run(batches):
        for b in batches:
            x = _matrix(b.column(b.schema.get_field_index("q")), d)
            exact = scaled_deviations(x, n, sums)
            with np.errstate(divide="ignore", invalid="ignore"):
                w = (exact.astype(np.float64) / n) @ axes / deviations
            small = exact.dtype != object and d * int(max(exact.max(initial=0), -exact.min(initial=0))) ** 2 < WIDE
            squares = (exact * exact).sum(axis=1).tolist() if small else [sum(v * v for v in row) for row in exact.tolist()]
            flat = pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel()) | np.isinf(w.ravel()))
            lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], flat)
            own = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array([v if v < 1 << 63 else None for v in squares], pa.int64()), lists], names=[*names, "deviation", "w"])

    return run


def _of_length(rows: DataFrame, d: int, components: int) -> DataFrame:
    """The whitened rows of one length: vec_id, component, n, deviation, whitened, explained, error."""
    # each distinct vector once, whatever the number of its copies; partial aggregation drops copies before the shuffle
    fit = materialise(rows.select("q").distinct())
    folded = fit.mapInArrow(_sums(d), "n long, s array<decimal(38,0)>").select("n", F.posexplode("s"))
    folded = folded.groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").cast("decimal(38,0)").alias("s")).orderBy("pos").collect()  # d rows
    n, sums = folded[0]["n"], [int(r["s"]) for r in folded]
    singular, axes = jacobi_svd(tall_skinny_r(fit, d, n, sums))
    k = min(components, d)
    deviations = singular / np.sqrt(n)
    floor = (singular[0] if d else 0.0) * np.finfo(float).eps * max(d, 1)
    deviations[singular <= floor] = 0.0
    total = float(np.sum(deviations**2))
    explained = [float(e * e / total) if total else 0.0 for e in deviations[:k]]
    run = lambda names: _whitened(d, n, sums, axes[:, :k], deviations[:k], names)
    # the covariance of what came out, over the fit list: measured, not derived
    w = [F.get("w", F.lit(i)) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k) if deviations[i] > 0 and deviations[j] > 0]
    measured = fit.mapInArrow(run([]), "deviation long, w array<double>").agg(F.lit(1), *(F.covar_pop(w[i], w[j]) for i, j in pairs)).first()[1:]
    error = max((abs(c - (i == j)) for c, (i, j) in zip(measured, pairs, strict=True)), default=0.0)
    out = rows.mapInArrow(run(["vec_id"]), "vec_id long, deviation long, w array<double>")
    at = F.element_at(F.array(*map(F.lit, explained)), F.col("component"))
    out = out.select("vec_id", "deviation", F.posexplode("w").alias("pos", "whitened")).withColumn("component", F.col("pos") + 1)
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", at.alias("explained"), F.lit(error).alias("error"))


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: every row on the first `components` principal axes, with unit variance on each.

    vectors: vec_id, embedding; components become x = floor(scale * x).  The fit list is each distinct vector once: n vectors with sums S.  deviation is the exact sum of
    (n * x - S)^2, null beyond 64 bits; whitened is x - S / n on the component over its standard deviation; explained is the share of the variance; identity_error is
    the largest entry of |covariance of whitened over the fit list - identity|.  Every covariance has divisor n.

    Vectors that are null or hold null or non-finite components are left out; a null vec_id stays null, and each of repeated rows is returned.  Vectors of
    different lengths are fitted apart, and identity_error is the largest of theirs; vectors without components have no rows.  A component without variance (one distinct vector,
    fewer distinct vectors than components) has whitened null, explained 0 and no part in identity_error.  An empty table gives no rows.
    """
    rows = materialise(quantised(vectors, scale, known=False))
    lengths = [r[0] for r in rows.select(F.size("q").alias("d")).filter("d > 0").distinct().orderBy("d").collect()]
    parts = [_of_length(rows.filter(F.size("q") == d), d, components) for d in lengths]
    if not parts:
        return rows.limit(0).select("vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), *(F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if len(parts) > 1:
        worst = max(p.select("error").first()[0] for p in parts)
        out = out.withColumn("error", F.lit(worst))
    return out.withColumnRenamed("error", "identity_error")
