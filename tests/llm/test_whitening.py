"""Embedding whitening against a plain eigendecomposition in numpy."""

import math

import numpy as np
import pytest

from supportkb.llm import queries, whitening
from tests.llm.samples import SF, table


def plain(rows, components=32):
    """vec_id -> (deviation, whitened), the eigenvalue shares; covariance by eigh."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in good])
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > values[0] * 1e-12).sum()))
    white = centred @ vectors[:, :k] / np.sqrt(values[:k])
    deviation = [sum(int(d) ** 2 for d in row) for row in n * x - s]
    return [i for i, _ in good], n, deviation, white, values[:k] / values.sum()


def check(df, rows, tolerance=1e-7):
    ids, n, deviation, white, share = plain(rows)
    got = {}
    for r in df.collect():
        got.setdefault(r.component, {})[r.vec_id] = r
    assert sorted(got) == list(range(1, len(share) + 1))
    for k, by_id in got.items():
        mine = np.array([by_id[i].whitened for i in ids])
        theirs = white[:, k - 1]
        theirs = theirs * np.sign(mine[np.argmax(np.abs(theirs))] * theirs[np.argmax(np.abs(theirs))])
        assert np.abs(mine - theirs).max() < tolerance
        for i, d in zip(ids, deviation):
            r = by_id[i]
            assert (r.n, int(r.deviation)) == (n, d)
            assert abs(r.explained - share[k - 1]) < 1e-10 and r.identity_error < 1e-9


def test_query_against_eigenvectors(spark):
    check(queries.QUERIES["op11_whitening"](spark, SF), [(r[0], r[1]) for r in table("embeddings")], 1e-6)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0.5) for i, v in rows], "vec_id long, embedding array<float>, component string, n double")


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.standard_normal(5) * [1, 2, 3, 0.5, 0.1]]) for i in range(60)]
    odd = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan")] * 5), (104, [1.0, float("inf"), 0.0, 0.0, 0.0]),
           (105, [1.0, 2.0]), (106, [3.0e38, 0.0, 0.0, 0.0, 0.0])]
    again = rows + [rows[0], (7, rows[8][1])]
    got = whitening.whitened(frame(spark, again + odd))
    assert got.select("vec_id").distinct().count() == 60
    unique = [(1000 + k, v) for k, (_, v) in enumerate(again)]
    check(whitening.whitened(frame(spark, unique + odd)), unique)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]])
def test_without_variance(spark, rows):
    assert whitening.whitened(frame(spark, rows)).count() == 0


def test_dependent_dimensions(spark):
    """Rank 3 in 6 dimensions, and far apart in size: only the components with variance come back."""
    rng = np.random.default_rng(5)
    base = np.round(rng.standard_normal((80, 3)) * [4000, 30, 2])
    mixed = np.concatenate([base, base[:, :1] * 2, base[:, 1:2] - base[:, 2:3], np.ones((80, 1))], axis=1)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(mixed)]
    got = whitening.whitened(frame(spark, rows))
    assert {r.component for r in got.collect()} == {1, 2, 3}
    check(got, rows, 1e-5)


def test_triangular_solve_and_factor():
    rng = np.random.default_rng(1)
    r = np.triu(rng.standard_normal((150, 150))) + 20 * np.eye(150)
    rows = rng.standard_normal((40, 150))
    assert np.allclose(whitening.solve_upper(rows, r) @ r, rows)
    low = rng.standard_normal((10, 4))
    g = low @ low.T
    factor = whitening.cholesky(g, 0.0)
    assert np.allclose(factor.T @ factor, g, atol=1e-8) and np.allclose(factor, np.triu(factor))


def test_large_deviations_stay_exact():
    numbers = whitening.Integers(2, offset=0)
    middle = whitening.Centre(numbers, 1 << 33, [12345678901, -5])
    x = np.array([[1 << 40, -7], [3, 4]], np.int64)
    want = [sum((((1 << 33) * int(v)) - s) ** 2 for v, s in zip(row, middle.sums)) for row in x.tolist()]
    assert middle.squared(x) == want


def test_sums_over_many_tasks(spark):
    import pyarrow as pa

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([np.array([1.0, 2.0]).tobytes()], pa.binary())], ["name", "values"])
    parts = spark.range(0, 100, 1, 70).mapInArrow(run, "name string, values binary")
    assert whitening.added_up(parts)["a"].tolist() == [70.0, 140.0]
