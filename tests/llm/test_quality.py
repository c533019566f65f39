"""Quality classifier: statistics, moments and scores against plain versions."""

import re
import zlib

import numpy as np

from tonemill.llm import quality


def stats(texts):
    raw = [(t or "").encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return quality.statistics(np.frombuffer(b"".join(raw), np.uint8), offsets)


def auc(score, y):
    rank = np.empty(len(y))
    rank[np.argsort(score, kind="stable")] = np.arange(1, len(y) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_statistics_by_hand():
    texts = ["Aa bb! 12 a|b\nbb bb", "", None, "x" * 50_000, " \n ", "été été"]
    got = stats(texts)
    assert np.isfinite(got).all() and got.shape == (6, len(quality.STATISTICS))
    named = dict(zip(quality.STATISTICS, got[0]))
    words = texts[0].lower().split()
    lengths = np.array([len(w) for w in words])
    assert np.isclose(named["log_words"], np.log1p(len(words))) and np.isclose(named["mean_word"], np.log1p(lengths.mean()))
    assert np.isclose(named["sd_word"], np.log1p(lengths.std()))
    assert np.isclose(named["distinct_words"], len(set(words)) / len(words))
    assert np.isclose(named["distinct_pairs"], len(set(zip(words, words[1:]))) / (len(words) - 1))
    assert np.isclose(named["twins"] ** 2, sum(a == b for a, b in zip(words, words[1:])) / len(words))
    assert np.isclose(named["simpson"] ** 2, sum(words.count(w) ** 2 for w in set(words)) / len(words) ** 2)
    assert np.isclose(named["marked_words"] ** 2, sum(bool(re.search(r"[!|#$%&*]$", w)) for w in words) / len(words))
    assert np.allclose(got[1], got[2]) and np.allclose(got, np.concatenate([stats([t]) for t in texts]))


def test_fit_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(1, 2, (50, 3))])
    y = np.repeat([0, 1], [60, 50])
    df = spark.createDataFrame([(int(c), r.tolist()) for c, r in zip(y, x)], "label int, statistics array<double>")
    model = quality.fit(df, d=3, pooling=0.1, ridge=0.05)
    covs = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = (60 * covs[0] + 50 * covs[1]) / 110
    want = []
    for c in (0, 1):
        s = 0.9 * covs[c] + 0.1 * pooled
        s = 0.95 * s + 0.05 * np.trace(s) / 3 * np.eye(3)
        d = x - x[y == c].mean(0)
        want.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.allclose(model.difference(x), want[1] - want[0])
    one = quality.fit(df.where("label = 1"), d=3)
    assert np.allclose(one.score(x), 51 / 52)
    assert np.allclose(quality.fit(df.limit(0), d=3).score(x), 0.5)


def test_query_held_out_accuracy(spark):
    from tonemill.llm.queries import LLM_QUERIES
    from tonemill.llm.ragged import table

    sf = "/root/testdata/sf0.01"
    rows = LLM_QUERIES["op2_quality"](spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    marks = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in marks]
    y = np.array([marks[r.doc_id] for r in held])
    assert auc(np.array([r.score for r in held]), y) > 0.97
    assert np.mean([r.predicted for r in held] == y) > 0.95


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a b", "x"), (4, "w " * 60_000, "x")], "doc_id long, text string, Statistics string")
    out = quality.with_statistics(df)
    assert out.columns == ["doc_id", "text", "statistics"] and out.count() == 5
    model = quality.Model(0.5, [np.zeros(18), np.ones(18)], [np.eye(18)] * 2, [0.0, 0.0])
    scores = {(r.doc_id, r.text): r.score for r in quality.score_texts(df, model).collect()}
    assert scores[(1, None)] == scores[(2, "")] and len(scores) == 4
    labels = spark.createDataFrame([(1, 1), (2, None), (9, 0), (None, 1)], "doc_id long, quality int")
    assert [r.label for r in quality.labelled(out, labels, "quality").collect()] == [1]
    assert quality.score_texts(df.limit(0), model).count() == 0
