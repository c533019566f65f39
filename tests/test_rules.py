"""Rule labeler goldens (hand-derived, see FIXTURES.md) and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonemill.functions.rules import rules_sentiment
from tonemill.lexicon import DEFAULT_LEXICON, LABELS, Lexicon, NEGATIVE_WORDS, POSITIVE_WORDS
from tonemill.operators.labeling import label_rules, rule_features
from tonemill.operators.report import confidence_stats, label_counts
from tonemill.sources.reviews import sample_reviews

SAMPLE_GOLDEN = [
    ("Positive", 78.33), ("Negative", 82.5), ("Neutral", 50.0), ("Positive", 81.36), ("Positive", 84.29),
    ("Neutral", 50.0), ("Positive", 85.0), ("Negative", 79.21), ("Neutral", 50.0), ("Neutral", 50.0),
]

EDGE_GOLDEN = [
    ("great but bad", "Neutral", 60.0),
    ("not great but bad", "Neutral", 60.0),
    ("never again", "Positive", 79.21),
    ("the piano was great", "Negative", 79.21),
    ("cannot fail", "Positive", 79.21),
    ("good not", "Positive", 76.25),
    ("good every day", "Positive", 78.33),
    ("worst worst worst", "Negative", 76.25),
    ("good\nbad day", "Neutral", 50.0),
    (None, "Neutral", 50.0),
    ("", "Neutral", 50.0),
    ("excellent amazing wonderful fantastic", "Positive", 86.18),
    ("excellent amazing wonderful fantastic great good best love awesome", "Positive", 90.31),
    (" ".join(POSITIVE_WORDS), "Positive", 92.0),
]


def python_rules(text, lex=DEFAULT_LEXICON):
    """Independent brute-force statement of the rule semantics."""
    t = str(text if text is not None else "nan").lower()
    pos = sum(lex.weight for w in lex.positive if f" {w} " in f" {t} ")
    neg = sum(lex.weight for w in lex.negative if f" {w} " in f" {t} ")
    if any(n in t for n in lex.negations):
        pos, neg = neg * lex.swap, pos * lex.swap
    amps = sum(1 for a in lex.amplifiers if a in t)
    if pos > neg:
        pos += amps * lex.amplifier_weight
    if neg > pos:
        neg += amps * lex.amplifier_weight
    total = pos + neg
    if total == 0:
        return "Neutral", round(lex.empty * 100, 2)
    if pos > neg:
        return "Positive", round(min(lex.base + (pos / (total + lex.smoothing)) * lex.span, lex.cap) * 100, 2)
    if neg > pos:
        return "Negative", round(min(lex.base + (neg / (total + lex.smoothing)) * lex.span, lex.cap) * 100, 2)
    return "Neutral", round(lex.tie * 100, 2)


def test_sample_reviews_golden(spark):
    df = label_rules(sample_reviews(spark))
    got = [(r.label, r.confidence) for r in df.collect()]
    assert sorted(got) == sorted(SAMPLE_GOLDEN)
    stats = confidence_stats(df).first()
    assert stats.total == 10 and stats.high_count == 1 and stats.very_high_count == 0 and stats.low_count == 4
    assert stats.avg_confidence == pytest.approx(69.069, abs=1e-9) and stats.avg_confidence_display == 69.1
    counts = {r.label: r.n for r in label_counts(df).collect()}
    assert counts == {"Positive": 4, "Negative": 2, "Neutral": 4}


def test_edge_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(EDGE_GOLDEN)], "i int, text string")
    got = {r.i: (r.label, r.confidence) for r in label_rules(df).collect()}
    for i, (text, label, conf) in enumerate(EDGE_GOLDEN):
        assert got[i] == (label, conf), text
        assert python_rules(text) == (label, conf), text


def test_features(spark):
    df = spark.createDataFrame([("Very good, not bad never again every day",)], "text string")
    r = rule_features(df).first()
    # 'good,' does not hit (punctuation); 'bad' and the phrase do
    assert (r.pos_hits, r.neg_hits, r.negated, r.amplifiers) == (0, 2, True, 1)


def test_overwrites_existing_label_columns(spark):
    df = spark.createDataFrame([("x", "old", 1.0, "great")], "id string, label string, confidence double, text string")
    out = label_rules(df)
    assert out.columns == ["id", "label", "confidence", "text"]
    assert out.first().label == "Positive"


def test_custom_lexicon(spark):
    lex = Lexicon(positive=("yay",), negative=("boo", "so bad"), negations=("nope ",), amplifiers=("!!",))
    df = spark.createDataFrame([("yay yay",), ("boo so bad",), ("nope yay",)], "text string")
    got = [(r.label, r.confidence) for r in label_rules(df, lexicon=lex).collect()]
    assert got == [python_rules(t, lex) for t in ("yay yay", "boo so bad", "nope yay")]


def test_lexicon_validation():
    with pytest.raises(ValueError):
        Lexicon(positive=("a", "a"))


WORDS = list(POSITIVE_WORDS[:8]) + list(NEGATIVE_WORDS[:8]) + ["not", "no", "very", "really", "x", "the"]
texts = st.lists(st.sampled_from(WORDS + ["never again", ".", "!", "\n"]), max_size=12).map(" ".join)


@settings(max_examples=12, deadline=None)
@given(st.lists(texts, min_size=1, max_size=20))
def test_matches_bruteforce(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, text string")
    got = {r.i: (r.label, r.confidence) for r in label_rules(df).collect()}
    for i, t in enumerate(batch):
        assert got[i] == python_rules(t)
        assert got[i][0] in LABELS and 50.0 <= got[i][1] <= 92.0


def test_repeated_word_changes_nothing(spark):
    df = spark.createDataFrame([("good day",), ("good good day",)], "text string")
    a, b = [(r.label, r.confidence) for r in label_rules(df).collect()]
    assert a == b


def test_column_function_equals_operator(spark):
    df = sample_reviews(spark)
    a = [tuple(r) for r in df.select(rules_sentiment("text").alias("s")).select("s.label", "s.confidence").collect()]
    b = [(r.label, r.confidence) for r in label_rules(df, percent=False).collect()]
    assert a == b


def test_plan_has_no_exchange(spark):
    df = label_rules(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PythonUDF" not in plan
    assert F.col("text") is not None
