import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmeter.llm import whitening
from inkmeter.llm.whitening import component_rows, fit, whitened

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def vectors(spark, values, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in enumerate(values)], SCHEMA)


def brute(values, k=32):
    x = np.array([[math.floor(64 * float(np.float32(c))) for c in v] for v in values], dtype=object) + 1_000_000
    n, s = len(x), x.sum(0)
    centred = np.array((n * x - s) / n, dtype=float)
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return ((n * x - s) ** 2).sum(1), e, q, centred @ q / np.sqrt(e), (centred**2).sum() / n


def spread(rows, dim, seed=1):
    r = np.random.default_rng(seed)
    return r.standard_normal((rows, dim)) @ np.diag(np.linspace(3, 0.5, dim)) + 5 * r.standard_normal(dim)


def test_dimension_beyond_the_block_is_iterated(spark):
    """80 dimensions, 48 columns: filters, locking and certificates all run."""
    values = spread(700, 80)
    model = fit(vectors(spark, values).repartition(5))
    deviation, e, q, w, trace = brute(values)
    assert model.passes > 20 and model.components.shape == (80, 32)
    assert np.allclose(model.eigenvalues, e, rtol=1e-12) and abs(model.trace / trace - 1) < 1e-12
    assert np.abs(np.abs((model.components * q).sum(0)) - 1).max() < 1e-12
    assert model.identity_error < 1e-10
    rows = component_rows(vectors(spark, values), model).collect()
    assert len(rows) == 700 * 32 and {r.n for r in rows} == {700}
    sign = np.sign((model.components * q).sum(0))
    for r in rows:
        assert abs(r.whitened * sign[r.component - 1] - w[r.vec_id, r.component - 1]) < 1e-9
        assert r.deviation == deviation[r.vec_id] and abs(r.explained / (e[r.component - 1] / trace) - 1) < 1e-10


def test_steep_spectrum(spark):
    """Eigenvalues over ten powers of ten: the first columns are locked before the last are found."""
    r = np.random.default_rng(3)
    values = r.standard_normal((500, 60)) @ np.diag(10 ** np.linspace(5, 0.3, 60))
    model = fit(vectors(spark, values))
    _, e, q, _, _ = brute(values)
    assert np.allclose(model.eigenvalues, e, rtol=1e-7) and model.identity_error < 1e-4


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = spread(40, 5)
    odd = [None, [], [1, 2, None, 4, 5], [nan] * 5, [1, 2, 3, 4, inf], [1.0, 2.0], [-inf, 0, 0, 0, 0]]
    df = vectors(spark, good).unionByName(vectors(spark, odd, 100)).unionByName(vectors(spark, good[:3])).withColumn("vec_id", F.when(F.col("vec_id") != 7, F.col("vec_id")))
    clash = df.withColumns({c: F.lit(1) for c in ("n", "part", "width", "data", "sums", "deviation", "whitened", "component")})
    model = fit(clash)
    rows = whitened(clash, model).collect()
    assert model.n == len(rows) == 43 and sorted((r.vec_id for r in rows), key=repr) == sorted([None if i == 7 else i for i in [*range(40), 0, 1, 2]], key=repr)
    deviation, e, _, w, _ = brute([*good, *good[:3]], 5)
    assert np.allclose(model.eigenvalues, e) and sorted(r.deviation for r in rows) == sorted(deviation)
    assert np.allclose(np.sort(np.abs([r.whitened for r in rows]).ravel()), np.sort(np.abs(w).ravel()))


def test_flat_directions_are_no_components(spark):
    base = spread(30, 3)
    flat = np.concatenate([base, base[:, :1], np.ones((30, 2))], axis=1)
    model = fit(vectors(spark, np.round(flat * 64) / 64))
    assert model.components.shape[1] == 3 and model.identity_error < 1e-9
    same = vectors(spark, [[1, 2]] * 4)
    assert fit(same).components.shape[1] == 0 and component_rows(same, fit(same)).collect() == []


@pytest.mark.parametrize("values", [[], [None, []], [[float("nan"), 1.0]]])
def test_nothing_to_fit(spark, values):
    df = vectors(spark, values)
    assert fit(df) is None
    rows = component_rows(df, None)
    assert rows.collect() == [] and rows.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries(spark):
    """Beyond a long the deviation is null; entries beyond 2^46 count as 2^46."""
    df = vectors(spark, [[3e38, 1], [1e12, 2], [0, 3], [1, 4]])
    model = fit(df)
    rows = {r.vec_id: r.deviation for r in whitened(df, model).collect()}
    assert rows[0] is None and model.n == 4


def test_reruns_agree(spark):
    values = spread(200, 20)
    a, b = (fit(vectors(spark, values).repartition(n)) for n in (2, 7))
    assert np.allclose(a.components, b.components, atol=1e-10) and whitening.dimension(vectors(spark, values)) == 20
