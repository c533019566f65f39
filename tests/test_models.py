"""Model paths: normalisers, answer parsing, vote, scorer and fallback."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonemill.functions import models as M
from tonemill.functions.valence import label_from_compound
from tonemill.functions.vote import ensemble_vote
from tonemill.operators import ensemble, scoring
from tonemill.operators.registry import MODELS, export_name, label_dataset, model_catalog
from tonemill.plans.fixtures import demo_classifier
from tonemill.sources.reviews import sample_reviews


def _res(spark, rows, schema, expr):
    df = spark.createDataFrame(rows, schema)
    return [(r.s.label, round(r.s.confidence, 6)) if r.s is not None else None
            for r in df.select(expr.alias("s")).collect()]


def test_normalise_binary(spark):
    got = _res(spark, [("POSITIVE", 0.90), ("NEGATIVE", 0.97), ("LABEL_1", 0.99), (None, 0.5)],
               "l string, s double", M.normalise_binary("l", "s"))
    assert got == [("Positive", 0.95), ("Negative", 0.98), ("Neutral", 0.99), None]


def test_normalise_ternary(spark):
    got = _res(spark, [("positive", 0.90), ("neutral", 0.97)], "l string, s double", M.normalise_ternary("l", "s"))
    assert got == [("Positive", 0.92), ("Neutral", 0.90)]


def test_parse_scored_answer(spark):
    rows = [("Positive 85",), ("Positive, 95.5",), ("Positive",), ("Neutral 60",), ("negative 80",), (None,)]
    got = _res(spark, rows, "r string", M.parse_scored_answer("r"))
    assert got == [("Positive", 0.85), ("Positive", 0.98), ("Positive", 0.95), ("Neutral", 0.7), ("Neutral", 0.8), None]


def test_parse_plain_answer(spark):
    got = _res(spark, [("Negative",), ("not positive, negative",), ("mixed",)], "r string", M.parse_plain_answer("r"))
    assert got == [("Negative", 0.96), ("Positive", 0.96), ("Neutral", 0.85)]


def test_label_from_compound(spark):
    got = _res(spark, [(0.05,), (-0.05,), (0.0,), (0.9,)], "c double", label_from_compound("c"))
    assert got == [("Positive", 0.725), ("Negative", 0.725), ("Neutral", 0.65), ("Positive", 0.95)]


VOTES = [
    ([("Positive", 0.76), ("Positive", 0.84)], ("Positive", 0.9)),
    ([("Positive", 0.76), ("Negative", 0.90)], ("Positive", 0.76)),
    ([("Positive", 0.70), ("Negative", 0.80), ("Negative", 0.90)], ("Negative", 0.85)),
    ([("Positive", 0.70), ("Negative", 0.80), ("Neutral", 0.65)], ("Positive", 0.70)),
    ([("Positive", 0.92), ("Positive", 0.95), ("Positive", 0.98)], ("Positive", 0.98)),
]


def test_vote_wide_and_long_agree(spark):
    for k, (votes, expected) in enumerate(VOTES):
        cols = [F.struct(F.lit(l).alias("label"), F.lit(c).alias("confidence")) for l, c in votes]
        r = spark.range(1).select(ensemble_vote(*cols).alias("s")).first().s
        assert (r.label, round(r.confidence, 6)) == expected
        long = spark.createDataFrame([(k, f"m{i}", i, l, c) for i, (l, c) in enumerate(votes)],
                                     "doc_id long, model string, ord int, label string, confidence double")
        r2 = ensemble.ensemble_vote_long(long, "doc_id").first()
        assert (r2.label, round(r2.confidence, 6)) == expected


def test_a_batch_scores_each_distinct_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counting(texts: pd.Series) -> pd.DataFrame:
        seen.add(len(texts))
        return demo_classifier(texts)

    df = sample_reviews(spark).coalesce(1).select(F.explode(F.array_repeat("text", 3)).alias("text"))
    assert scoring.label_with_scorer(df, counting, "ternary").count() == 30
    scoring.label_with_scorer(df, counting, "ternary").collect()
    assert seen.value in (10, 20)  # count() alone may need no label


def test_model_labels_move_no_text(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for out in (scoring.label_with_scorer(df, demo_classifier), scoring.label_with_llm(df, lambda p: ["Positive 90"] * len(p)),
                ensemble.label_ensemble(df, valence_lexicon={"the": 1.0}, classifier=demo_classifier)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_rows_the_model_fails_for_fall_back(spark):
    def scorer(texts):
        if texts.str.contains("bad").any():
            raise RuntimeError("no")
        return [("POSITIVE", None if "none" in t else float("nan") if "nan" in t else 0.9) for t in texts]

    rows = ["good", "bad day", "great", "none great", "nan great", "bad bad awful", "fine"]
    df = spark.createDataFrame([(t,) for t in rows], "text string").coalesce(1)
    got = {r.text: (r.label, r.confidence) for r in scoring.label_with_scorer(df, scorer, "binary").collect()}
    from tonemill.operators.labeling import label_rules
    rules = {r.text: (r.label, r.confidence) for r in label_rules(df).collect()}
    assert got == {t: ("Positive", 95.0) if t in ("good", "great", "fine") else rules[t] for t in rows}

    def responder(prompts):
        if prompts.str.contains("bad").any():
            raise RuntimeError("no")
        return ["Negative 91"] * len(prompts)

    got = {r.text: (r.label, r.confidence) for r in scoring.label_with_llm(df, responder).collect()}
    assert got == {t: rules[t] if "bad" in t else ("Negative", 91.0) for t in rows}
    with pytest.raises(Exception, match="2 results for"):
        scoring.label_with_scorer(df, lambda texts: [None, None]).collect()


def test_load_once_in_spark_with_two_models_of_one_factory(spark):
    built = {k: spark.sparkContext.accumulator(0) for k in ("Positive", "Negative")}

    def factory(label):
        def build():
            built[label].add(1)
            return lambda texts: [(label.upper(), 0.9)] * len(texts)

        return build

    df = spark.range(0, 4000, numPartitions=4).select(F.concat(F.lit("text "), "id").alias("text"))
    for label in built:
        out = scoring.label_with_scorer(df, scoring.load_once(factory(label)), "ternary")
        assert {r.label for r in out.select("label").distinct().collect()} == {label}
        assert 1 <= built[label].value <= spark.sparkContext.defaultParallelism


def test_votes_of_four_models(spark):
    votes = [("Positive", 0.9), ("Negative", 0.8), ("Negative", 0.7), ("Positive", 0.6)]
    cols = [F.struct(F.lit(l).alias("label"), F.lit(c).alias("confidence")) for l, c in votes]
    wide = spark.range(1).select(ensemble_vote(*cols).alias("s")).first().s
    assert (wide.label, round(wide.confidence, 9)) == ("Positive", 0.75)
    agreed = spark.range(1).select(ensemble_vote(*cols[:1] * 4).alias("s")).first().s
    assert (agreed.label, round(agreed.confidence, 9)) == ("Positive", 0.98)
    tables = [(f"m{i}", spark.createDataFrame([(7, l, c), (8, "Neutral", 0.5)], "k long, label string, confidence double")) for i, (l, c) in enumerate(votes)]
    long = ensemble.ensemble_vote_long(ensemble.votes_long("k", tables), "k")
    got = {r.k: (r.label, round(r.confidence, 9)) for r in long.collect()}
    assert got == {7: ("Positive", 0.75), 8: ("Neutral", 0.6)}


def test_failing_scorer_falls_back_to_rules(spark):
    def nothing(texts):
        return [None] * len(texts)

    df = sample_reviews(spark)
    got = sorted((r.text, r.label, r.confidence) for r in scoring.label_with_scorer(df, nothing, "binary").collect())
    from tonemill.operators.labeling import label_rules
    want = sorted((r.text, r.label, r.confidence) for r in label_rules(df).collect())
    assert got == want


def test_llm_prompts_and_answers(spark):
    df = sample_reviews(spark)
    seen = []

    def responder(prompts):
        seen.extend(prompts)
        return ["Negative 91"] * len(prompts)

    out = scoring.label_with_llm(df, responder, "chat", distinct=False).collect()
    assert {(r.label, r.confidence) for r in out} == {("Negative", 91.0)}
    msgs = spark.range(1).select(M.chat_messages(F.lit("x" * 600)).alias("m")).first().m
    assert msgs[0].role == "system" and msgs[1].content == M.CHAT_USER_PREFIX + "x" * 500


def test_registry(spark):
    assert list(MODELS)[3] == "RoBERTa (Best Free)" and len(MODELS) == 7
    assert model_catalog(spark).count() == 7
    assert export_name("Ensemble (Hybrid)") == "labeled_ensemble_(hybrid).csv"
    df = sample_reviews(spark)
    rules = sorted(tuple(r) for r in label_dataset(df, "Enhanced Rules (Fast)").collect())
    # No key or no responder: the language models fall back to the rules.
    assert sorted(tuple(r) for r in label_dataset(df, "OpenAI GPT-3.5").collect()) == rules
    assert sorted(tuple(r) for r in label_dataset(df, "RoBERTa (Best Free)").collect()) == rules
    with pytest.raises(KeyError):
        label_dataset(df, "nope")


def test_kept_scores_are_not_recomputed(spark):
    from tonemill.session import keep_table

    seen = spark.sparkContext.accumulator(0)

    def counting(texts):
        seen.add(len(texts))
        return demo_classifier(texts)

    out = keep_table(scoring.label_with_scorer(sample_reviews(spark), counting, "ternary"))
    out.count()
    out.collect()
    assert seen.value == 10
