"""Ensemble labeler: several labelers vote per row.

Two forms with the same result:

* wide: every labeler is a column of the same row and the vote is a
  projection, so there is no shuffle;
* long: votes are rows ``(key, model, ord, label, confidence)``, voted by two
  aggregations.

Both take any number of labelers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.functions.vote import UNANIMOUS_BONUS, UNANIMOUS_CAP, ensemble_vote
from tonemill.lexicon import DEFAULT_LEXICON, Lexicon
from tonemill.operators.labeling import unpack_label, with_rules_struct
from tonemill.operators.scoring import with_scorer_struct
from tonemill.operators.valence import with_valence_struct


def votes_long(key: str, labeled: Sequence[tuple[str, DataFrame]], label_col: str = "label",
               confidence_col: str = "confidence") -> DataFrame:
    """Stack labeler outputs ``[(model, df(key, label, confidence)), ...]``
    into vote rows; ``ord`` is the model's position (ties go to the lowest)."""
    parts = [
        df.select(
            F.col(key),
            F.lit(name).alias("model"),
            F.lit(i).alias("ord"),
            F.col(label_col).alias("label"),
            F.col(confidence_col).cast("double").alias("confidence"),
        )
        for i, (name, df) in enumerate(labeled)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def votes_from_results(df: DataFrame, key: str, results: Sequence[tuple[str, str]]) -> DataFrame:
    """Vote rows from result columns of one table: ``[(model, struct_col),
    ...]`` in model order. One pass with a Generate, no union of scans."""
    votes = F.array(*[
        F.struct(F.lit(name).alias("model"), F.lit(i).alias("ord"), F.col(f"{c}.label").alias("label"),
                 F.col(f"{c}.confidence").cast("double").alias("confidence"))
        for i, (name, c) in enumerate(results)
    ])
    return df.select(F.col(key), F.inline(votes))


def ensemble_vote_long(votes: DataFrame, key: str) -> DataFrame:
    """Vote over vote rows: the most frequent label per key wins, ties go to
    the label whose first vote has the lowest ``ord``; confidence = mean of
    the winning votes (summed in ``ord`` order), +0.1 capped at 0.98 if
    unanimous. Returns ``(key, label, confidence)`` with confidence in 0..1.
    A row without label is no vote; a key without any vote has null results.

    Votes are ``(key, ord)``-unique, so what is gathered per key and label is
    one number per model that gave the label."""
    per_label = votes.groupBy(key, "label").agg(
        F.min("ord").alias("first"), F.array_sort(F.collect_list(F.struct("ord", "confidence"))).alias("given"))
    total = F.aggregate(F.col("given.confidence"), F.lit(0.0), lambda a, c: a + c)
    per_label = per_label.select(key, "label", "first", F.size("given").alias("n"), (total / F.size("given")).alias("mean"))
    best = per_label.groupBy(key).agg(
        F.max(F.when(F.col("label").isNotNull(), F.struct(F.col("n"), (-F.col("first")).alias("neg_first"), F.col("label"), F.col("mean")))).alias("b"),
        F.count("label").alias("n_labels"),
    )
    mean = F.col("b.mean")
    conf = F.when((F.col("n_labels") == 1) & mean.isNotNull(), F.least(mean + F.lit(UNANIMOUS_BONUS), F.lit(UNANIMOUS_CAP))).otherwise(mean)
    return best.select(F.col(key), F.col("b.label").alias("label"), conf.alias("confidence"))


def with_ensemble_struct(df: DataFrame, text_col: str = "text", out: str = "ensemble",
                         lexicon: Lexicon = DEFAULT_LEXICON, valence_lexicon=None, classifier=None,
                         normalise: str = "ternary", valence_strategy: str = "arrow", **scorer_kw) -> DataFrame:
    """Add ``out`` = vote of rules, valence (rules again when no valence
    lexicon is given) and, if given, the classifier; unrounded confidences."""
    rules, val, cls = "__tm_e_rules", "__tm_e_val", "__tm_e_cls"
    staged = with_rules_struct(df, text_col, lexicon, rules)
    if valence_lexicon is not None:
        staged = with_valence_struct(staged, valence_lexicon, text_col, val, strategy=valence_strategy)
    else:
        staged = staged.withColumn(val, F.col(rules))
    results = [F.col(rules), F.col(val)]
    if classifier is not None:
        staged = with_scorer_struct(staged, classifier, normalise, text_col, cls, lexicon=lexicon,
                                    fallback_col=rules, **scorer_kw)
        results.append(F.col(cls))
    staged = staged.withColumn(out, ensemble_vote(*results))
    return staged.drop(rules, val, cls)


def label_ensemble(df: DataFrame, text_col: str = "text", label_col: str = "label",
                   confidence_col: str = "confidence", **kw) -> DataFrame:
    """Label every row with the ensemble vote (confidence in percent)."""
    tmp = "__tm_ens"
    return unpack_label(with_ensemble_struct(df, text_col, tmp, **kw), tmp, label_col, confidence_col)
