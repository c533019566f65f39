"""Large lexicons against plain substring tests and the built-in features."""

import random

import pytest
from pyspark.sql import functions as F

from tonemill.lexicon import COVERAGE_LEXICON
from tonemill.operators import lexicon_scan
from tonemill.operators.labeling import rule_features


def run(spark, texts, entries, kinds, whole=None):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    lexicon = spark.createDataFrame(entries, "entry string, kind string")
    out = lexicon_scan.lexicon_counts(df, lexicon, kinds, whole)
    return {r.id: [r[f"{k}_hits"] for k in kinds] for r in out.collect()}


@pytest.mark.parametrize("whole", [None, ["a"], []])
def test_against_substrings(spark, whole):
    rng = random.Random(len(whole or "xyz"))
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 3)))
    entries = [(" ".join(word() for _ in range(rng.randint(1, 3))), rng.choice("abc")) for _ in range(300)] + [("AB", "a"), ("ab", "a"), ("", "b"), (None, "a"), ("b", None), ("b", "other")]
    texts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", " ", "AB a\nb", "a  b", "x" * 100_000 + " ab"]
    want = {}
    for i, t in enumerate(texts):
        padded = f" {'nan' if t is None else t.lower()} "
        known = {(e.lower(), k) for e, k in entries if e and k}
        want[i] = [sum((f" {e} " if k in (["a", "b", "c"] if whole is None else whole) else e) in padded for e, k in known if k == kind) for kind in "abc"]
    assert run(spark, texts, entries, ["a", "b", "c"], whole) == want


def test_agrees_with_the_rule_features(spark):
    lex = COVERAGE_LEXICON
    entries = [(w, k) for k, words in (("pos", lex.positive), ("neg", lex.negative), ("not", lex.negations), ("amp", lex.amplifiers)) for w in words]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    both = rule_features(lexicon_scan.lexicon_counts(docs, spark.createDataFrame(entries, "entry string, kind string"), ["pos", "neg", "not", "amp"], ["pos", "neg"]).withColumnsRenamed(
        {f"{k}_hits": f"{k}_own" for k in ("pos", "neg", "not", "amp")}), "text", lex)
    wrong = (F.col("pos_own") != F.col("pos_hits")) | (F.col("neg_own") != F.col("neg_hits")) | ((F.col("not_own") > 0) != F.col("negated")) | (F.col("amp_own") != F.col("amplifiers"))
    assert both.where(wrong).count() == 0 and both.where("pos_own > 0").count() > 0


def test_bounds_empty_lexicon_and_plan(spark, monkeypatch):
    assert run(spark, ["a", None], [], ["a"]) == {0: [0], 1: [0]}
    assert run(spark, [], [("a", "a")], ["a"]) == {}
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    many = spark.range(5000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("entry"), F.lit("a").alias("kind"))
    one = lexicon_scan.lexicon_counts(df, many.limit(1), ["a"])._jdf.queryExecution().executedPlan().toString()
    all_ = lexicon_scan.lexicon_counts(df, many, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert abs(len(one) - len(all_)) < 50 and "Exchange" not in all_
    monkeypatch.setattr(lexicon_scan, "MAX_ENTRIES", 4000)
    with pytest.raises(ValueError, match="5000 entries"):
        lexicon_scan.lexicon_counts(df, many, ["a"])
