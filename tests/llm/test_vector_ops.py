"""op10 to op12 against brute force, on vectors of every awkward kind."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import hard_negatives, topk, whitening

SCHEMA = "vec_id long, label int, embedding array<float>, q int, block string, windows int, w int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 2, 3, 4) for r in rows], SCHEMA)


def awkward(seed=3, n=120, d=6):
    """Ties, copies, nulls, other lengths, empty vectors; vectors of one label in three."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        label = 0 if i % 3 == 0 else int(rng.integers(0, 6))
        rows.append((i, label, [float(v) for v in rng.integers(-3, 4, d) / 256 + label / 64]))
    rows += [(n + i, 2, rows[5][2]) for i in range(8)]
    rows += [(n + 20, None, rows[1][2]), (None, 1, rows[1][2]), (n + 21, 1, None), (n + 22, 1, [1.0, None, *[0.0] * (d - 2)]), (n + 23, 1, [math.nan] * d), (n + 24, 1, [math.inf] * d)]
    rows += [(n + 25 + i, i % 2, [0.5 + i / 64, 0.25]) for i in range(7)] + [(n + 40, 1, []), (n + 45, 3, [0.25] * 3), rows[4], rows[4]]
    return rows


def fine(rows):
    return [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]


def x_of(vector):
    return tuple(math.floor(256 * float(np.float32(c))) for c in vector)


def mined(rows, every, k, m, low, high):
    have = {i: (label, x_of(v)) for i, label, v in fine(rows) if i is not None and label is not None}
    out = set()
    for a, (label, x) in have.items():
        if a % every:
            continue
        scores = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i) for i, (_, y) in have.items() if i != a and len(y) == len(x))
        for s, p in [t for t in scores if have[t[1]][0] == label][:k]:
            hits = [(t, i) for t, i in scores if have[i][0] != label and low * -s <= -100 * t <= high * -s][:m]
            out |= {(a, p, rank + 1, i, -s, -t) for rank, (t, i) in enumerate(hits)}
    return out


@pytest.mark.parametrize(("sizes", "chunks"), [((4, 16), 2), ((512, 4096), 3), ((1, 1), 9)])
def test_hard_negatives(spark, monkeypatch, sizes, chunks):
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", sizes[0])
    monkeypatch.setattr(hard_negatives, "CANDIDATE_ROWS", sizes[1])
    rows = awkward() if sizes != (1, 1) else awkward(n=30)
    got = hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0, 3, 4, 60, 100, chunks=chunks)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got))
    assert set(got) == mined(rows, 5, 3, 4, 60, 100)


def test_hard_negatives_of_labels_with_blocks_of_their_own(spark, monkeypatch):
    """One label has nine rows of ten, and few labels share the mixed blocks; without a table that is small enough, labels are not broadcast."""
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 8)
    monkeypatch.setattr(hard_negatives, "CANDIDATE_ROWS", 32)
    monkeypatch.setattr(hard_negatives, "MOST_BROADCAST", 0)
    rng = np.random.default_rng(5)
    rows = [(i, 7 if i % 10 else i // 10, [float(v) for v in rng.integers(0, 9, 5) / 32]) for i in range(300)]
    got = {tuple(r) for r in hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 4 == 0).collect()}
    assert got == mined(rows, 4, 5, 5, 80, 100) and got


@pytest.mark.parametrize("rows", [[], [(100, 1, [1.0])], [(100, 1, [1.0]), (101, 1, [1.0])], [(100, 1, [-1.0]), (101, 1, [1.0]), (102, 2, [1.0])], [(100, 1, [0.0]), (101, 1, [1.0]), (102, 2, [1.0])]])
def test_hard_negatives_of_few_rows(spark, rows):
    got = {tuple(r) for r in hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 100 == 0).collect()}
    assert got == mined(rows, 100, 5, 5, 80, 100)


def test_top_k_of_a_query_without_candidates(spark):
    rows = [(50, 1, [1.0, 2.0]), (1, 1, [1.0, 1.0]), (100, 1, [3.0])]
    got = topk.exact_top_k(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in got] == [(50, 1, 1, 256 * 256 * 3)]
    lone = [(50, 1, [1.0]), (51, 1, [1.0, 2.0]), (52, 1, [])]
    assert topk.exact_top_k(frame(spark, lone), F.col("vec_id") % 50 == 0).count() == 0


def whitened(rows, components):
    """By the covariance's eigenvectors; one length."""
    xs = [x_of(v) for _, _, v in rows]
    fit = np.array(sorted(set(xs)), np.float64)
    n = len(fit)
    sums = [sum(int(v) for v in c) for c in fit.T]
    centred = np.array([[n * v - s for v, s in zip(x, sums, strict=True)] for x in xs], object)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(fit.shape[1], -1))
    order = np.argsort(-values)[:components]
    w = (centred.astype(float) / n) @ vectors[:, order] / np.sqrt(np.maximum(values[order], 0))
    return n, [sum(v * v for v in row) for row in centred.tolist()], w, values[order] / values.sum()


@pytest.mark.parametrize("shape", [(400, 12), (300, 3), (40, 64)])
def test_whitening(spark, monkeypatch, shape):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 37)
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(1)
    base = rng.normal(size=shape) * np.linspace(0.02, 0.5, shape[1]) + 3
    rows = [(i, 1, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, 1, rows[7][2]) for i in range(60)]  # copies count once
    got = whitening.whiten(frame(spark, rows).repartition(7)).orderBy("vec_id", "component").collect()
    n, squares, w, share = whitened(rows, 4)
    k = min(4, shape[1])
    assert len(got) == len(rows) * k
    values = np.array([r["whitened"] for r in got]).reshape(-1, k)
    assert {r["n"] for r in got} == {n}
    assert [r["deviation"] for r in got[::k]] == squares
    np.testing.assert_allclose([r["explained"] for r in got[:k]], share[:k], rtol=1e-9)
    np.testing.assert_allclose(np.abs(values), np.abs(w[:, :k]), atol=1e-7)
    signs = np.sign((values * w[:, :k]).sum(axis=0))
    np.testing.assert_allclose(values * signs, w[:, :k], atol=1e-7)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening_on_edges(spark):
    rows = awkward()
    got = whitening.whiten(frame(spark, rows)).collect()
    kept = [r for r in fine(rows) if r[2]]
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in got if r["component"] == 1) == sorted((r[0] is None, r[0] or 0) for r in kept)
    one = [r for r in got if r["vec_id"] == 165]  # the only vector of its length
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(i, 1, 0, None, 0.0) for i in (1, 2, 3)]
    pair = [r for r in got if r["vec_id"] == 150]  # vectors on a line
    assert [r["whitened"] is None for r in sorted(pair, key=lambda r: r["component"])] == [False, True]
    assert got[0]["identity_error"] < 1e-9
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, 1, None), (2, 1, [])])).collect() == []
    large = [(i, 1, [float(i) * 1e14, 1.0]) for i in range(40)]
    out = whitening.whiten(frame(spark, large)).filter("component = 1").orderBy("vec_id").collect()
    assert out[0]["deviation"] is None and abs(out[0]["whitened"] + out[-1]["whitened"]) < 1e-6


def test_jacobi_is_accurate_for_small_singular_values():
    """Columns of very unlike sizes: each value keeps its relative accuracy, which a covariance matrix would lose."""
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    sizes = 10.0 ** -np.arange(0, 18, 2)
    norms, axes = whitening.jacobi_svd(q * sizes)
    np.testing.assert_allclose(norms, sizes, rtol=1e-12)
    np.testing.assert_allclose(np.abs(axes), np.eye(9), atol=1e-12)
    a = rng.normal(size=(8, 8))
    norms, axes = whitening.jacobi_svd(a)
    np.testing.assert_allclose(norms, np.linalg.svd(a, compute_uv=False), rtol=1e-12)
    np.testing.assert_allclose(axes.T @ axes, np.eye(8), atol=1e-13)
    products = (a @ axes).T @ (a @ axes)
    np.testing.assert_allclose(products, np.diag(norms**2), atol=1e-12)
    assert whitening.jacobi_svd(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]
