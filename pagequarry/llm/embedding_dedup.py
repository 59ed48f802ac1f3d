"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact reranking.

A rotation learnt by iterative quantisation (ITQ) turns each vector into a balanced code of `bits` bits, as many as the number of vectors asks for.  The code is cut into `tables` substrings; vectors are
indexed under each, and every vector probes each table with its substring and all substrings one bit away, so two codes
that differ in at most 2 * tables - 1 bits meet.  A pair is looked at in the first table where it meets.  An entry carries a sketch of its vector: a few
coordinates on orthonormal directions, rounded.  Projecting never lengthens a difference, so a pair whose sketches are further apart than the threshold allows (the rounding
added) cannot link, and no other pair is left out.  Members of a bucket with a candidate bring their vectors, and cosines in double precision decide.  Links are counted, and only a spanning forest of them leaves a bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import BYTE_BASE, MASK, TOKEN_BASE, U64, by_partition, materialise, mix, pack, unpack
from pagequarry.llm.graph import components, local_components, salted_lookup


SKETCH = 16
#: steps of a sketch to a length of 1: coordinates of a unit vector less the mean lie within -2 and 2
STEPS = 63


def sketch_radius(threshold: float) -> float:
    """Largest distance, in steps, of the sketches of two vectors whose cosine is at least `threshold`: that of the unit vectors, and half a step a coordinate for each."""
    return STEPS * float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold + 1e-9))) + float(np.sqrt(SKETCH)) + 1e-6


def rotation(sample: np.ndarray, bits: int, rounds: int = 40, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix dims x bits): signs of (x - mean) @ matrix are the code.  Fewer dims than bits: further rotations from other seeds."""
    dims = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(dims)
    x = sample - mean
    columns, left = [], bits
    rng = np.random.default_rng(seed)
    while left > 0:
        take = min(dims, left)
        r = np.linalg.qr(rng.normal(size=(take, take)))[0]
        if len(x) >= dims:
            basis = np.linalg.svd(x, full_matrices=False)[2][:take].T
            v = x @ basis
            for _ in range(rounds):
                u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (u @ wt).T
        else:
            basis = np.linalg.qr(rng.normal(size=(dims, dims)))[0][:, :take]
        columns.append(basis @ r)
        left -= take
    return mean, np.concatenate(columns, axis=1)


def layout(n: int) -> tuple[int, int]:
    """(bits, tables) for n vectors: 64 and 6 up to about two million; beyond, substrings wide enough for about two thousand vectors a bucket, and more tables for wider ones, so that
    the share of links that meet stays about the same however many vectors there are.
    """
    width = math.ceil(math.log2(max(1, n) / 2048)) if n > 2048 else 0
    if width <= 10:
        return 64, 6
    tables = math.ceil(0.7 * width)
    return tables * width, tables


def substrings(bits: int, tables: int) -> list[tuple[int, int]]:
    """(first bit, width) of each substring; 60 bits at most."""
    widths = [bits // tables + (i < bits % tables) for i in range(tables)]
    if not 0 < min(widths) <= max(widths) <= 60:
        raise ValueError("a substring of a code has 1 to 60 bits")
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _meets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """First table in which two codes differ in at most one bit (as many as there are tables: none); a, b: substrings, the last axis is the table."""
    tables = a.shape[-1]
    out = np.full(np.broadcast_shapes(a.shape, b.shape)[:-1], tables, np.int16)
    for t in range(tables - 1, -1, -1):
        x = a[..., t] ^ b[..., t]
        out[(x & (x - U64(1))) == 0] = t  # no bit or one
    return out


def embedding_components(vectors: DataFrame, threshold: float = 0.98, max_sample: int = 20_000, bits: int | None = None, tables: int | None = None, part_entries: int = 1 << 19, block_rows: int = 4096, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector of `vectors` (vec_id, embedding, label; other columns are ignored).

    Two vectors link when their labels are equal and not null and their cosine in double precision is at least `threshold`.  Vectors that are null, empty, zero or
    hold null or non-finite components, and vectors with a null label or id, link with nothing.  Equal vectors of one label are one representative with a weight.  Rows that
    repeat a vec_id are one vector (the smallest); each row without an id stays, alone and kept, with a null component_id.  The rotation is fitted on at most about max_sample vectors, all are indexed.  Every pair that meets in a
    bucket is decided exactly; pairs that meet in none are not found, and recall against brute force is measured in the tests.  bits and tables follow from the
    number of vectors (`layout`) unless they are given.  Empty input: empty result.
    """
    x = F.col("embedding")
    fine = x.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    nameless = vectors.filter("vec_id IS NULL").select(F.lit(None).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    all_rows = vectors.filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.transform(x, lambda v: v.cast("double")).alias("embedding"))
    all_rows = all_rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding")
    rows = materialise(all_rows)
    usable = rows.filter(F.coalesce(fine, F.lit(False)))
    groups = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    reps = materialise(groups.select("rep", "weight", F.xxhash64(F.col("label").cast("string"), F.size("embedding")).alias("space"), "embedding", "label"))
    n = reps.count()
    bits, tables = (x or y for x, y in zip((bits, tables), layout(n), strict=True))
    parts = max(1, n * tables * (bits // tables + 2) // part_entries + 1)
    cuts = substrings(bits, tables)
    radius = sketch_radius(threshold)
    sample = reps.filter(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1 << 20)) < min(1.0, max_sample / max(1, n)) * (1 << 20)).select("embedding").collect()
    by_dims: dict[int, list] = {}
    for r in sample:
        by_dims.setdefault(len(r[0]), []).append(r[0])

    def unit(a: np.ndarray) -> np.ndarray:
        a = a / np.abs(a).max(axis=1, keepdims=True)  # first, so that no square over- or underflows
        return a / np.linalg.norm(a, axis=1, keepdims=True)

    learnt = {d: rotation(unit(np.array(v)), bits, seed=seed) for d, v in by_dims.items()}

    def codes(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(substrings of the codes: rows x tables, sketches) of the rows of a matrix; a dimension that the sample lacks gets a random rotation."""
        d = matrix.shape[1]
        if d not in learnt:
            learnt[d] = rotation(np.zeros((0, d)), bits, seed=seed)
        mean, r = learnt[d]
        x = (unit(matrix) - mean) @ r
        # the first columns of a rotation are orthonormal, as many as there are dims
        sketch = np.zeros((len(x), SKETCH), np.int8)
        m = min(SKETCH, d, bits)
        sketch[:, :m] = np.clip(np.rint(x[:, :m] * STEPS), -127, 127)
        ones = (x >= 0).astype(U64)
        return np.stack([(ones[:, first : first + width] << np.arange(width, dtype=U64)).sum(axis=1, dtype=U64) for first, width in cuts], axis=1), sketch

    def bucket_of(space: np.ndarray, piece: np.ndarray, table: int) -> np.ndarray:
        return mix(mix(space.astype(U64) * U64(BYTE_BASE) + U64(table)) * U64(TOKEN_BASE) + piece)

    def index(batches):
        for b in batches:
            ids, space = b.column("rep").to_numpy(), b.column("space").to_numpy()
            vectors = b.column("embedding").to_pylist()
            pieces, sketch = np.zeros((len(ids), tables), U64), np.zeros((len(ids), SKETCH), np.int8)
            size = np.array([len(v) for v in vectors], np.int64)
            for d in np.unique(size):
                pieces[size == d], sketch[size == d] = codes(np.array([v for v in vectors if len(v) == d], np.float64))
            bucket, own, role = [], [], []
            for t, (_, width) in enumerate(cuts):
                for flip in (None, *[U64(0), *[U64(1) << U64(i) for i in range(width)]]):
                    bucket.append(bucket_of(space, pieces[:, t] if flip is None else pieces[:, t] ^ flip, t))
                    own.append(np.arange(len(ids)))
                    role.append(np.full(len(ids), flip is None))
            bucket, own, role = np.concatenate(bucket), np.concatenate(own), np.concatenate(role)
            out = [(p, *pack(bucket[i], ids[own[i]], role[i], sketch[own[i]])) for p, i in by_partition((bucket >> U64(30)).astype(np.int64) % parts)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), *[pa.binary()] * 4))], names=["part", "bucket", "id", "indexed", "sketch"])

    def candidates(table: pa.Table) -> pa.Table:
        """Members of each bucket that have a candidate there: (bucket, block of the index, block of the probes, id, role)."""
        bucket, ids, indexed = (np.concatenate(unpack(table.column(c), t)) for c, t in (("bucket", U64), ("id", np.int64), ("indexed", bool)))
        order = np.lexsort((ids, ~indexed, bucket))
        bucket, ids, indexed = bucket[order], ids[order], indexed[order]
        sketch = np.concatenate(unpack(table.column("sketch"), np.int8)).reshape(-1, SKETCH)[order]
        heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        ends = np.concatenate([heads[1:], [len(bucket)]])
        middles = heads + np.add.reduceat(indexed.astype(np.int64), heads) if len(heads) else heads
        out: list[tuple] = []
        for s, m, e in zip(heads.tolist(), middles.tolist(), ends.tolist(), strict=True):
            if m == s or m == e:
                continue
            v = sketch[s:e].astype(np.float32)
            square = (v * v).sum(axis=1)
            # the entry that put a vector here tells the table: probes and index agree on it by the bucket's hash
            for bi, i in enumerate(range(s, m, block_rows)):
                for bj, j in enumerate(range(m, e, block_rows)):
                    a, b = slice(i, min(i + block_rows, m)), slice(j, min(j + block_rows, e))
                    near = square[a.start - s : a.stop - s, None] + square[None, b.start - s : b.stop - s] - 2 * (v[a.start - s : a.stop - s] @ v[b.start - s : b.stop - s].T)
                    hit = (near <= radius * radius) & (ids[b][None] < ids[a][:, None])
                    if hit.any():
                        x, y = np.flatnonzero(hit.any(axis=1)) + a.start, np.flatnonzero(hit.any(axis=0)) + b.start
                        keep = np.concatenate([x, y])
                        out.append((np.full(len(keep), bucket[s]), np.full(len(keep), bi), np.full(len(keep), bj), ids[keep], np.arange(len(keep)) < len(x)))
        if not out:
            out.append((np.zeros(0, U64), *[np.zeros(0, np.int64)] * 3, np.zeros(0, bool)))
        bucket, bi, bj, ids, role = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"bucket": bucket.astype(np.int64), "bi": bi.astype(np.int32), "bj": bj.astype(np.int32), "id": ids, "indexed": role})

    found = reps.select("rep", "space", "embedding").mapInArrow(index, "part int, bucket binary, id binary, indexed binary, sketch binary").groupBy("part").applyInArrow(candidates, "bucket long, bi int, bj int, id long, indexed boolean")
    members = materialise(found)
    joined = members.join(reps.select(F.col("rep").alias("id"), "weight", "space", "embedding"), "id")

    def rerank(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bucket", "ascending"), ("bi", "ascending"), ("bj", "ascending"), ("indexed", "descending")])
        bucket, bi, bj, ids, weight, space, indexed = (table.column(c).to_numpy() for c in ("bucket", "bi", "bj", "id", "weight", "space", "indexed"))
        vectors = table.column("embedding").combine_chunks()
        new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
        heads = np.concatenate([np.flatnonzero(new), [len(bucket)]])
        counts: dict[int, int] = {}
        a_out, b_out = [], []
        for s, e in zip(heads.tolist(), heads[1:].tolist(), strict=False):
            m = s + int(indexed[s:e].sum())
            if m == s or m == e:
                continue
            matrix = np.array(vectors.slice(s, e - s).to_pylist(), np.float64)
            v, pieces = unit(matrix), codes(matrix)[0]
            meets = _meets(pieces[: m - s][:, None], pieces[m - s :][None])
            # the bucket's own table: the one whose hash it is
            t = next(t for t in range(tables) if bucket_of(space[s : s + 1], pieces[:1, t], t)[0] == U64(int(bucket[s]) & MASK))
            hit = (meets == t) & (v[: m - s] @ v[m - s :].T >= threshold) & (ids[m:e][None] < ids[s:m][:, None])
            x, y = np.nonzero(hit)
            if not len(x):
                continue
            for own, other, k in ((x + s, y + m, 0), (y + m, x + s, 1)):
                for i, w in zip(*_sums(ids[own], weight[other]), strict=True):
                    counts[i] = counts.get(i, 0) + w
            label = local_components(e - s, x, y + m - s)
            moved = np.flatnonzero(label != np.arange(e - s))
            a_out.append(ids[s + moved])
            b_out.append(ids[s + label[moved]])
        edges = (np.concatenate(a_out), np.concatenate(b_out)) if a_out else (np.zeros(0, np.int64),) * 2
        k = len(counts)
        return pa.table({"a": np.concatenate([edges[0], np.fromiter(counts, np.int64, k)]), "b": pa.array([*edges[1].tolist(), *[None] * k], pa.int64()), "links": pa.array([*[None] * len(edges[0]), *counts.values()], pa.int64())})

    out = materialise(joined.groupBy(F.pmod(F.xxhash64("bucket", "bi", "bj"), F.lit(max(64, 8 * parts))).alias("g")).applyInArrow(rerank, "a long, b long, links long"))
    classes = components(out.filter("b IS NOT NULL").select("a", "b"))
    counts = out.filter("links IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    told = reps.select("rep", "weight").join(counts, "rep", "left").join(classes, F.col("rep") == F.col("node"), "left")
    told = told.select("rep", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    copies = groups.filter("weight > 1").select("label", "embedding", "rep")
    named = salted_lookup(usable.select("vec_id", "label", "embedding"), copies, ["label", "embedding"], "vec_id").select("vec_id", F.coalesce("rep", "vec_id").alias("rep"))
    result = rows.select("vec_id").join(named.join(told, "rep").drop("rep"), "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept")).unionByName(nameless)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[int]]:
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return ranked[heads].tolist(), np.add.reduceat(values[order], heads).tolist()
