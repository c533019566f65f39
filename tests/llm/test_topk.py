"""Exact top-k against brute force and against SQL."""

import math
import random

import duckdb
import numpy as np
import pytest

from tonemill.llm import topk


def brute(rows, k=10, scale=1024):
    good = []
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [math.floor(scale * float(np.float32(x))) for x in v]))
    out = []
    for q in {i for i, _ in good if i % 100 == 0}:
        own = min((len(v), v) for i, v in good if i == q)[1]
        scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in good if i != q and len(v) == len(own))
        out += [(q, r, i, min(-s, 2**63 - 1)) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, k=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, extra string")
    return sorted(map(tuple, topk.top_k(df, topk.F.col("vec_id") % 100 == 0, k=k).collect()))


@pytest.mark.parametrize("case", ["spread lengths", "unit", "ties", "tiny shards"])
def test_random(spark, case, monkeypatch):
    rng = random.Random(case)
    rows = []
    for i in range(1500):
        size = math.exp(rng.gauss(0, 2)) if case != "unit" else 1
        v = [rng.gauss(0, 1) for _ in range(6)]
        if case == "ties":
            v = [rng.choice([0.0, 0.5, 1.0]) for _ in range(3)]
            size = 1
        n = math.sqrt(sum(x * x for x in v)) or 1
        rows.append((i, [size * x / n if case != "ties" else x for x in v], "x"))
    if case == "tiny shards":
        monkeypatch.setattr(topk, "LEAST_ROWS", 20)
        monkeypatch.setattr(topk, "BLOCK_QUERIES", 4)
    assert run(spark, rows) == brute([(i, v) for i, v, _ in rows])


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "a"), (0, [1.0, 2.0], "a"), (1, [1.0, 1.0], "a"), (1, [1.0, 1.0], "a"), (2, None, "a"), (3, [nan, 1.0], "a"), (4, [inf, 1.0], "a"), (5, [None, 1.0], "a"),
            (None, [1.0, 1.0], "a"), (6, [1.0, 2.0, 3.0], "a"), (100, [0.0, 0.0], "b"), (200, [-1.0, -0.0004], None), (300, [1.0, 2.0, 3.0], "b"), (7, [], "c"), (400, None, "c"), (8, [3.0e9, 3.0e9], "d"), (500, [3e9, 3e9], "d")]
    assert run(spark, rows) == brute([(i, v) for i, v, _ in rows])
    assert run(spark, [(1, [1.0], "x"), (100, [2.0], "y")], k=3) == [(100, 1, 1, 2048 * 1024)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, extra string")
    assert topk.top_k(df.limit(0), topk.F.col("vec_id") % 100 == 0).count() == 0


def test_pruning_prunes_and_stays_exact(monkeypatch):
    rng = np.random.default_rng(3)
    vectors = np.floor(1024 * rng.normal(0, 1, (8000, 8)) * np.exp(rng.normal(0, 1.5, (8000, 1)))).astype(np.int64)
    ids, done = np.arange(8000), []
    real = topk.products
    monkeypatch.setattr(topk, "products", lambda q, v: (done.append(len(q) * len(v)), real(q, v))[1])
    got = topk.search(ids[:40], vectors[:40], np.full(40, -np.inf), ids, vectors, 10)
    want = []
    for q in range(40):
        s = vectors @ vectors[q]
        want += [(q, int(i), int(s[i])) for i in sorted(set(range(8000)) - {q}, key=lambda i: (-s[i], i))[:10]]
    assert got == want and sum(done) < 0.25 * 40 * 8000


def test_query_matches_sql(spark):
    from tonemill.llm.queries import LLM_ORACLE, LLM_QUERIES

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    want = con.execute(LLM_ORACLE["op9_topk"])
    names = [c[0] for c in want.description]
    out = LLM_QUERIES["op9_topk"](spark, sf)
    assert names == out.columns and sorted(map(tuple, out.collect())) == sorted(want.fetchall())
