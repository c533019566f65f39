"""Valence labeler: both physical strategies agree with a brute force."""

import math
import re

import pytest

from tonemill.operators.valence import label_valence, valence_compound

LEX = {"good": 1.9, "bad": -2.5, "don't": -0.4, "great": 3.1}


def brute(text):
    toks = re.findall(r"[^\W_]+(?:'[^\W_]+)*", str(text if text is not None else "nan").lower())
    s = sum(LEX.get(t, 0.0) for t in toks)
    return round(max(-1.0, min(1.0, s / math.sqrt(s * s + 15))), 4)


def test_strategies_agree_with_bruteforce(spark):
    texts = ["good good bad", "Great! don't", "nothing here", None, "bad, bad. BAD", "goodness"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    joined = {r.id: r.compound for r in valence_compound(df, LEX, strategy="join").collect()}
    arrow = {r.id: r.compound for r in valence_compound(df, LEX, strategy="arrow").collect()}
    for i, t in enumerate(texts):
        assert joined[i] == arrow[i] == brute(t), t


def test_arrow_strategy_keeps_columns_and_large_lexicons(spark):
    # A large lexicon: the arrow strategy,
    # which keeps every input column and its order.
    big = dict(LEX)
    big.update({f"w{i}": (i % 9 - 4) * 0.25 for i in range(5000)})
    texts = ["w1 w1 w8 good", "W4000, w4000! bad", "", None, "w12'x w12 great"]
    df = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "id long, text string, src string")
    out = valence_compound(df, big)
    assert out.columns == ["id", "text", "src", "compound"]
    got = {r.id: (r.src, r.compound) for r in out.collect()}

    def ref(text):
        toks = re.findall(r"[^\W_]+(?:'[^\W_]+)*", str(text if text is not None else "nan").lower())
        s = sum(big.get(t, 0.0) for t in toks)
        return round(max(-1.0, min(1.0, s / math.sqrt(s * s + 15))), 4)

    for i, t in enumerate(texts):
        assert got[i] == (f"s{i}", ref(t)), t


def test_label_valence(spark):
    df = spark.createDataFrame([(1, "great"), (2, "meh")], "id long, text string")
    got = {r.id: (r.label, r.confidence) for r in label_valence(df, LEX).collect()}
    c = brute("great")
    assert got[1] == ("Positive", round(min((c + 1) / 2 + 0.2, 0.95) * 100, 2))
    assert got[2] == ("Neutral", 65.0)


def test_lexicon_as_dataframe(spark):
    lex = spark.createDataFrame(list(LEX.items()), "token string, valence double")
    df = spark.createDataFrame([(1, "good bad great")], "id long, text string")
    assert valence_compound(df, lex).first().compound == brute("good bad great")


def brute_rules(text, lex, rules):
    toks = re.findall(r"[^\W_]+(?:'[^\W_]+)*", str(text if text is not None else "nan").lower())
    s = 0.0
    for i, t in enumerate(toks):
        if t not in lex:
            continue
        v = lex[t]
        for j in range(1, rules.window + 1):
            if i - j < 0:
                continue
            p = toks[i - j]
            if p in rules.boosters:
                inc = rules.boosters[p] * rules.damping[j - 1]
                v = v - inc if v < 0 else v + inc
            if p in rules.negators:
                v = v * rules.negation_scalar
        s = s + v
    if rules.exclamation_step:
        e = min(str(text if text is not None else "nan").count("!"), rules.exclamation_max) * rules.exclamation_step
        s = s + e if s > 0 else (s - e if s < 0 else s)
    return round(max(-1.0, min(1.0, s / math.sqrt(s * s + 15))), 4)


def test_context_rules_match_bruteforce(spark):
    from tonemill.functions.valence import BOOSTER_INCREMENT, EXCLAMATION_STEP, ValenceRules

    rules = ValenceRules(negators=("not", "never", "isn't"), boosters={"very": BOOSTER_INCREMENT,
                         "barely": -BOOSTER_INCREMENT}, exclamation_step=EXCLAMATION_STEP)
    texts = ["not very good", "very not good", "good", "isn't bad!!", "never, ever, so bad", "barely good!!!!!!",
             "", None, "very very very", "not good not bad very great"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r.id: r.compound for r in valence_compound(df, LEX, rules=rules).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_rules(t, LEX, rules), t


def test_join_strategy_without_broadcast(spark, monkeypatch):
    import tonemill.operators.valence as ov

    monkeypatch.setattr(ov, "BROADCAST_MAX", 1)
    texts = ["good good bad", "great great great don't", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r.id: r.compound for r in valence_compound(df, LEX, strategy="join").collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_context_rules_join_strategy(spark):
    from tonemill.functions.valence import BOOSTER_INCREMENT, EXCLAMATION_STEP, ValenceRules

    rules = ValenceRules(negators=("not", "never", "isn't"), boosters={"very": BOOSTER_INCREMENT,
                         "barely": -BOOSTER_INCREMENT}, exclamation_step=EXCLAMATION_STEP)
    texts = ["not very good", "very not good", "good x y z not bad", "isn't bad!!", "never, ever, so bad",
             "barely good!!!!!!", "", None, "very very very", "not good not bad very great", "good a very b great"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r.id: r.compound for r in valence_compound(df, LEX, strategy="join", rules=rules).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_rules(t, LEX, rules), t


def test_context_rules_arrow_strategy(spark):
    from tonemill.functions.valence import BOOSTER_INCREMENT, EXCLAMATION_STEP, ValenceRules

    rules = ValenceRules(negators=("not", "never", "isn't"), boosters={"very": BOOSTER_INCREMENT,
                         "barely": -BOOSTER_INCREMENT}, exclamation_step=EXCLAMATION_STEP)
    # Rows end and start with rule words so a look-back must not cross rows.
    texts = ["good very", "not very good", "very not good", "good x y z not bad", "isn't bad!!", "not",
             "bad never, ever, so bad", "barely good!!!!!!", "", None, "very very very",
             "not good not bad very great", "good a very b great", "very", "great"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(1, "id")
    arrow = {r.id: r.compound for r in valence_compound(df, LEX, rules=rules, strategy="arrow").collect()}
    for i, t in enumerate(texts):
        assert arrow[i] == brute_rules(t, LEX, rules), t


def test_strategies_mean_the_same(spark):
    df = spark.createDataFrame([(1, "tiny " * 2000), (1, "one one"), (None, "one"), (4, None)], "id long, text string")
    lex = {"tiny": 0.00005, "one": 1.00001}
    tables = (lex, spark.createDataFrame([*lex.items(), (None, 3.0), ("x", None)], "w string, v double"))
    want = sorted(round(s / math.sqrt(s * s + 15), 4) for s in (0.1, 2.00002, 1.00001, 0.0))
    for lexicon in tables:
        for strategy in ("arrow", "join"):
            out = valence_compound(df, lexicon, strategy=strategy)
            assert out.columns == ["id", "text", "compound"] and sorted(r.compound for r in out.collect()) == want
    twice = spark.createDataFrame([("one", 1.0), ("One", 1.0)], "w string, v double")
    for strategy in ("arrow", "join"):
        with pytest.raises(ValueError, match="repeats the token"):
            valence_compound(df, twice, strategy=strategy)
    with pytest.raises(ValueError, match="unknown strategy"):
        valence_compound(df, lex, strategy="inline")


def test_lexicon_over_the_broadcast_bound(spark, monkeypatch):
    from tonemill.operators import ensemble
    from tonemill.operators import valence as mod

    monkeypatch.setattr(mod, "BROADCAST_MAX", 1)
    df = spark.createDataFrame([(1, "good bad great")], "id long, text string")
    with pytest.raises(ValueError, match="strategy='join'"):
        valence_compound(df, LEX)
    assert valence_compound(df, LEX, strategy="join").first().compound == brute("good bad great")
    assert ensemble.label_ensemble(df, valence_lexicon=LEX, valence_strategy="join").count() == 1


def test_join_strategy_moves_no_text(spark, monkeypatch):
    from tonemill.functions.valence import BOOSTER_INCREMENT, EXCLAMATION_STEP, ValenceRules
    from tonemill.operators import valence as op

    df = spark.createDataFrame([(1, "good bad great"), (2, None), (3, ""), (4, "not very good! " * 50), (5, "other words")], "id long, text string")
    rules = ValenceRules(negators=("not",), boosters={"very": BOOSTER_INCREMENT}, exclamation_step=EXCLAMATION_STEP)
    for active in (None, rules):
        small = valence_compound(df, LEX, strategy="join", rules=active)
        plan = small._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "checkpoint" not in plan.lower()
        want = {r.id: r.compound for r in valence_compound(df, LEX, rules=active).collect()}
        assert {r.id: r.compound for r in small.collect()} == want
        with monkeypatch.context() as m:
            m.setattr(op, "BROADCAST_MAX", 0)
            assert {r.id: r.compound for r in valence_compound(df, LEX, strategy="join", rules=active).collect()} == want
    lex = spark.createDataFrame(list(LEX.items()), "token string, valence double")
    assert {r.token for r in op.heard(df, lex).collect()} == {t for t in LEX if t in ("good", "bad", "great")}
