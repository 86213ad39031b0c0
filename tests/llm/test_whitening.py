import math
import random
from fractions import Fraction

import numpy as np

from codestrata.llm import queries, whitening

KIND = "vec_id long, embedding array<float>, n long, v string, component string"


def plain(vectors, most=8):
    """Exact covariance and deviations with fractions, eigenvalues by the public library."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    z = [[n * r[k] - s[k] for k in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in z), n**3)) for j in range(d)] for i in range(d)])
    values, vectors_ = np.linalg.eigh(cov)
    order = np.argsort(-values)[:most]
    return n, [sum(a * a for a in r) for r in z], np.array([[a / n for a in r] for r in z]), values[order], vectors_[:, order], np.trace(cov)


def test_against_plain_arithmetic(spark, tmp_path):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(12, 12)) * np.linspace(2, 0.05, 12)
    good = [np.float32(v).tolist() for v in rng.normal(size=(300, 12)) @ mix + 5]
    rows = [(k, v, k, "x", "y") for k, v in enumerate(good)]
    odd = [(1000, None, 1, "x", "y"), (1001, [], 1, "x", "y"), (1002, good[0][:-1] + [float("nan")], 1, "x", "y"), (1003, good[0][:-1] + [float("inf")], 1, "x", "y"), (1004, good[0][:-1] + [None], 1, "x", "y"), (1005, [1.0, 2.0], 1, "x", "y")]
    again = [rows[7], rows[7], (None, good[9], None, None, None)]
    spark.createDataFrame(rows + odd + again, KIND).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op11_embedding_whitening"](spark, str(tmp_path)).collect()
    fitted = good + [good[7], good[7], good[9]]
    n, deviations, centred, values, vectors, trace = plain(fitted)
    assert len(got) == 8 * n and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 9))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    want = centred @ vectors / np.sqrt(values)
    for c in range(1, 9):
        mine = {r.vec_id: r for r in got if r.component == c}
        sign = np.sign(mine[0].whitened * want[0, c - 1])
        for k in range(300):
            assert mine[k].deviation == deviations[k]
            assert abs(mine[k].whitened * sign - want[k, c - 1]) < 1e-9
        assert abs(mine[0].explained - values[c - 1] / trace) < 1e-12
        assert abs(mine[None].whitened - mine[9].whitened) == 0
        assert sum(r.vec_id == 7 for r in got if r.component == c) == 3


def test_factor_and_rotations():
    rng = np.random.default_rng(5)
    for d, rank in ((1, 1), (7, 7), (30, 5), (64, 64)):
        root = rng.normal(size=(d, rank)) * 10.0 ** -np.linspace(0, 4, rank)
        matrix = root @ root.T
        g = whitening.pivoted_cholesky(matrix)
        assert g.shape == (d, rank) and np.allclose(g @ g.T, matrix, atol=1e-12 * matrix.max())
        values, vectors = whitening.eigen(matrix)
        assert np.allclose(vectors @ vectors.T, np.eye(rank), atol=1e-10)
        assert np.allclose(matrix @ vectors.T, vectors.T * values, atol=1e-13 * values[0])
        assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:rank], rtol=1e-6, atol=1e-13 * values[0])
    assert whitening.eigen(np.zeros((3, 3)))[0].size == 0


def test_few_equal_and_huge_vectors(spark):
    make = lambda vs: spark.createDataFrame([(k, v) for k, v in enumerate(vs)], "vec_id long, embedding array<double>")
    assert whitening.fit(make([]), "embedding") is None and whitening.fit(make([None, [float("nan")]]), "embedding") is None
    for vs in ([[1.0, 2.0]], [[1.0, 2.0]] * 5):
        model = whitening.fit(make(vs), "embedding")
        assert model.n == len(vs) and len(model.eigenvalues) == 0
        assert [r.whitened for r in whitening.whiten(make(vs), model, "vec_id", "embedding").collect()] == [[]] * len(vs)
        assert whitening.identity_error(make(vs), model, "embedding") == 0.0
    line = [[float(k), 2.0 * k, 1e6 * k] for k in range(40)]
    model = whitening.fit(make(line), "embedding")
    assert len(model.eigenvalues) == 1 and whitening.identity_error(make(line), model, "embedding") < 1e-12
    n, deviations, *_ = plain(line)
    assert [r.deviation for r in whitening.whiten(make(line), model, "vec_id", "embedding").orderBy("vec_id").collect()] == [s if s < 1 << 63 else None for s in deviations]
    rng = random.Random(1)
    wide = [[rng.choice([-1, 1]) * 1e9 * rng.random(), rng.random()] for _ in range(50)]
    model = whitening.fit(make(wide), "embedding")
    values = plain(wide)[3]
    assert np.allclose(model.eigenvalues, values[: len(model.eigenvalues)], rtol=1e-9)
