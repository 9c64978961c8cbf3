"""Whitening against numpy's eigenvectors of the covariance."""

import numpy as np
import pytest

from sluicegate.llm import whitening


def exact(vectors):
    """n, S and eigenpairs of the distinct whole-number vectors."""
    x = np.unique(np.floor(64 * np.array(vectors, float)) + 1000000, axis=0).astype(np.int64)
    n, sums = len(x), x.sum(axis=0)
    c = (n * x - sums) / n
    values, turned = np.linalg.eigh(c.T @ c / n)
    return n, sums, values[::-1], turned[:, ::-1]


def check(spark, rows, got, components=16):
    valid = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    n, sums, values, turned = exact([v for _, v in valid])
    many = min(components, int((values > 1e-11 * values[0]).sum()))
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert len(got) == many * len(valid)
    signs = np.zeros(many)
    for i, v in valid:
        x = (np.floor(64 * np.array(v, float)) + 1000000).astype(np.int64)
        d = n * x - sums
        want = (d / n) @ turned[:, :many] / np.sqrt(values[:many])
        for k in range(many):
            r = by[(i, k + 1)][0]
            assert (r["n"], r["deviation"]) == (n, int((d * d).sum()))
            assert abs(r["explained"] / (values[k] / values.sum()) - 1) < 1e-9
            assert r["identity_error"] < 1e-9
            if not signs[k]:
                signs[k] = np.sign(r["whitened"] * want[k])
            assert abs(signs[k] * r["whitened"] - want[k]) < 1e-6


def test_given_vectors(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    check(spark, rows, whitening.op11_chebyshev_whitening(spark, path).collect())


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def test_difficult_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(7) * [9, 5, 5, 2, 1, 1, 0.2]).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [(5, rows[5][1])]
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 5), (2002, [float("nan")] * 7), (2003, [float("inf")] * 7)]
    docs = frame(spark, rows).withColumnsRenamed({}).selectExpr("*", "1 AS n", "'x' AS id", "2 AS component")
    odd = frame(spark, [(3000, [1.0, 2.0]), (3001, [])]).selectExpr("*", "1 AS n", "'x' AS id", "2 AS component")
    check(spark, rows, whitening.whitened(docs.union(odd)).collect())


def test_vectors_in_a_plane(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(a), float(b), float(a), 3.0]) for i, (a, b) in enumerate(rng.integers(0, 40, (90, 2)))]
    check(spark, rows, whitening.whitened(frame(spark, rows)).collect())


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [0.5]), (2, [0.5])], [(1, None), (2, [])]])
def test_nothing_to_whiten(spark, rows):
    got = whitening.whitened(frame(spark, rows))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.collect() == []


@pytest.mark.parametrize("size,wanted", [(200, 16), (60, 4), (5, 16)])
def test_leading_pairs(size, wanted):
    """A slowly falling spectrum, whose pairs the filter has to tell apart."""
    rng = np.random.default_rng(size)
    basis = np.linalg.qr(rng.standard_normal((size, size)))[0]
    spectrum = 10 + 3 * np.linspace(1, 0, size) ** 2
    matrix = basis * spectrum @ basis.T
    passes = []

    def times(q):
        passes.append(1)
        return matrix @ q

    wanted = min(size, wanted)
    values, vectors, _, residual = whitening.leading_pairs(times, size, wanted)
    assert np.allclose(values, spectrum[:wanted], rtol=1e-12)
    assert np.abs(np.abs(np.sum(vectors * basis[:, :wanted], axis=0)) - 1).max() < 1e-9
    assert residual <= 100 * whitening.RESIDUAL
    assert len(passes) < 400


def test_filter_damps_the_unwanted_spectrum():
    spectrum = np.array([9.0, 8.0, 5.0, 3.0, 1.0, 0.1])
    y = whitening.chebyshev(lambda q: spectrum[:, None] * q, np.eye(6), np.diag(spectrum), 0.0, 5.0, 9.0, 8)
    gain = np.abs(np.diag(y))
    assert gain[0] > 0.9 and gain[1] > 1e-2 and gain[2:].max() < 1e-4
