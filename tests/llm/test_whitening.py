"""Whitening against numpy's eigendecomposition and exact integers."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tonemill.llm import whitening


def brute(rows, components=16, scale=64):
    """(id, deviation) of every taking-part row, n, eigenvalues and vectors."""
    good = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    sizes = [len(v) for _, v in good]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s), default=0)
    whole = [(i, tuple(math.floor(scale * float(np.float32(x))) + 1_000_000 for x in v)) for i, v in good if len(v) == size]
    fit = sorted({x for _, x in whole})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviation = [(i, x, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in whole]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit]).reshape(n, size)
    values, vectors = np.linalg.eigh(centred.T @ centred / max(n, 1)) if n else (np.zeros(0), np.zeros((0, 0)))
    return deviation, n, sums, values[::-1], vectors[:, ::-1], centred


def check(spark, rows, components=16, scale=64, distinct=True):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, x string, component int")
    got = whitening.whiten(df, components=components, scale=scale).collect()
    deviation, n, sums, values, vectors, centred = brute(rows, components, scale)
    real = [e for e in values[:components] if e > 1e-16 * max(values[0], 1e-300)]
    assert len(got) == len(deviation) * len(real)
    assert sorted(((r.vec_id, r.deviation) for r in got if r.component == 1), key=repr) == sorted(((i, d if d < 2**63 else None) for i, _, d in deviation), key=repr) or not real
    for r in got:
        assert r.n == n and r.identity_error <= 1e-4
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-4)
    if real and distinct and len({i for i, *_ in deviation}) == len(deviation):
        table = np.zeros((len(deviation), len(real)))
        place = {i: k for k, (i, *_) in enumerate(deviation)}
        for r in got:
            table[place[r.vec_id], r.component - 1] = r.whitened
        want = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for _, x, _ in deviation]) @ vectors[:, :len(real)] / np.sqrt(real)
        for k in range(len(real)):
            assert min(np.abs(table[:, k] - want[:, k]).max(), np.abs(table[:, k] + want[:, k]).max()) < 1e-6
    return got


def vectors(n, dims, seed, spread=1.0):
    rng = random.Random(seed)
    return [[rng.gauss(0, spread * (1 + 1 / (d + 1))) for d in range(dims)] for _ in range(n)]


def test_random_with_copies_and_bad_rows(spark):
    made = vectors(300, 24, 1)
    rows = list(enumerate(made)) + [(1000 + i, made[0]) for i in range(200)]
    rows += [(2000, None), (2001, []), (2002, [float("nan")] * 24), (2003, [float("inf")] + [0.0] * 23), (2004, [None] + [0.0] * 23), (2005, [1.0] * 5)]
    check(spark, rows)


def test_repeated_and_null_ids(spark):
    made = vectors(40, 5, 2)
    got = check(spark, [(None if i % 7 == 0 else i // 2, v) for i, v in enumerate(made)])
    assert sum(r.vec_id is None and r.component == 1 for r in got) == 6


def test_equal_eigenvalues(spark):
    rows = [(2 * d + s, [float(8 * (1 - 2 * s)) if d == j else 0.0 for j in range(20)]) for d in range(20) for s in range(2)]
    got = check(spark, rows, distinct=False)
    assert {r.component for r in got} == set(range(1, 17))


def test_few_rows_and_flat_directions(spark):
    check(spark, list(enumerate([[*v, 0.0, 1.0] for v in vectors(4, 6, 3)])))
    check(spark, list(enumerate([[x, 2 * x, 0.0] for x in (0.5, 1.0, 3.0, 7.0)])))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    assert check(spark, rows) == []


def test_large_numbers(spark):
    rows = list(enumerate(vectors(30, 3, 4, spread=1e9))) + [(99, [3e38, -3e38, 0.0])]
    df = spark.createDataFrame(rows[:-1], "vec_id long, embedding array<float>")
    check(spark, rows[:-1])
    out = whitening.whiten(spark.createDataFrame(rows, df.schema)).where("vec_id = 99").collect()
    assert out and all(r.deviation is None and math.isfinite(r.whitened) for r in out)


def test_query_over_embeddings(spark):
    import pyarrow.parquet as pq
    from conftest import SF001
    from tonemill.llm.queries import LLM_QUERIES

    table = pq.read_table(f"{SF001}/embeddings.parquet").to_pylist()
    rows = [(r["vec_id"], r["embedding"]) for r in table]
    deviation, n, *_ , values, _, _ = brute(rows)
    got = LLM_QUERIES["op12_whitening"](spark, SF001).collect()
    assert {r.n for r in got} == {n} and len(got) == 16 * len(deviation)
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 3) == sorted((i, d) for i, _, d in deviation)
    assert max(r.identity_error for r in got) < 1e-9
    assert [pytest.approx(e, rel=1e-9) for e in values[:16] / values.sum()] == [x for _, x in sorted({(r.component, r.explained) for r in got})]
