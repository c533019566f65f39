"""Inputs derived from the test tables that exercise every branch.

The test prose is made of pseudo-words that hardly ever hit the default
lexicon. These derivations keep the work proportional to the tables (every
document is used, whole) while giving the labelers something to decide:

* the *review view* prefixes each document with one of a fixed set of
  review texts, chosen by ``doc_id``;
* a deterministic *demo classifier* and *demo responder* stand in for
  models, as functions of the model input only (so scoring distinct inputs
  once is valid), with a null result on some inputs to exercise fallback;
* a small *demo valence lexicon* of pseudo-words.

Each has an equivalent SQL form for the reference queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tonemill.lexicon import POSITIVE_WORDS
from tonemill.plans.sql import q
from tonemill.sources.reviews import SAMPLE_REVIEWS
from tonemill.sources.tables import load_table

# Edge texts of the rule labeler and three strongly positive
# texts (4, 9 and all 36 positive words) that reach the upper tiers.
EDGE_TEXTS = (
    "great but bad",
    "not great but bad",
    "never again",
    "the piano was great",
    "cannot fail",
    "good not",
    "good every day",
    "worst worst worst",
    "good\nbad day",
    "",
)
STRONG_TEXTS = (
    "excellent amazing wonderful fantastic",
    "excellent amazing wonderful fantastic great good best love awesome",
    " ".join(w for w in POSITIVE_WORDS if " " not in w),
)
REVIEW_TEXTS = tuple(SAMPLE_REVIEWS) + EDGE_TEXTS + STRONG_TEXTS

# Invented valences of pseudo-words of the test prose.
DEMO_VALENCE = {
    "best": 3.2,
    "than": 1.1,
    "thble": 0.8,
    "thes": 0.6,
    "pathetic": -2.7,
    "disgusting": -2.4,
    "thth": -1.2,
    "thre": -0.9,
    "thon": -1.5,
}

# Demo classifier labels and demo answers.
DEMO_CLASSES = ("POSITIVE", "NEGATIVE", "LABEL_2")
DEMO_NULL_EVERY, DEMO_NO_SCORE_EVERY, DEMO_RAISE_EVERY = 11, 13, 7
DEMO_ANSWERS = (
    "Positive 85",
    "Positive, 95.5",
    "Positive",
    "Neutral 60",
    "negative 80",
    "Negative",
    "not positive, negative",
    "mixed",
    None,
)


def review_view(spark, sf_dir):
    """``documents`` with ``text`` = review text (by ``doc_id``) + ' ' + the
    whole document text."""
    docs = load_table(spark, sf_dir, "documents")
    texts = F.array(*[F.lit(t) for t in REVIEW_TEXTS])
    pick = F.element_at(texts, (F.col("doc_id") % F.lit(len(REVIEW_TEXTS))).cast("int") + 1)
    return docs.withColumn("text", F.concat(pick, F.lit(" "), F.col("text")))


def review_view_sql() -> str:
    """``SELECT`` of the review view over ``documents``."""
    cases = " ".join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(REVIEW_TEXTS))
    return (
        f"SELECT doc_id, (CASE doc_id % {len(REVIEW_TEXTS)} {cases} END) || ' ' || text AS text, "
        f"lang, source, n_chars FROM documents"
    )


def demo_classifier(texts: pd.Series) -> pd.DataFrame:
    """Deterministic stand-in for a classifier: class by input length mod 3,
    score ((len * 37) mod 100) / 100, no result when len is a multiple of 11,
    a label without a score when it is a multiple of 13."""
    n = texts.str.len().fillna(0).astype("int64").to_numpy()
    labels = np.array(DEMO_CLASSES, dtype=object)[n % 3]
    labels = np.where(n % DEMO_NULL_EVERY == 0, None, labels)
    scores = np.where(n % DEMO_NO_SCORE_EVERY == 0, np.nan, ((n * 37) % 100) / 100.0)
    return pd.DataFrame({"label": labels, "score": scores})


def demo_classifier_sql(input_expr: str) -> tuple[str, str]:
    """(label, score) SQL expressions of :func:`demo_classifier`."""
    n = f"length({input_expr})"
    label = (
        f"CASE WHEN {n} % {DEMO_NULL_EVERY} = 0 THEN NULL "
        + " ".join(f"WHEN {n} % 3 = {i} THEN {q(c)}" for i, c in enumerate(DEMO_CLASSES))
        + " END"
    )
    score = f"CASE WHEN {n} % {DEMO_NO_SCORE_EVERY} <> 0 THEN CAST(({n} * 37) % 100 AS DOUBLE) / CAST(100.0 AS DOUBLE) END"
    return label, score


def failing_classifier(texts: pd.Series) -> pd.DataFrame:
    """:func:`demo_classifier` that raises on inputs whose length is a multiple
    of 7, as a model does that cannot take some text."""
    if (texts.str.len() % DEMO_RAISE_EVERY == 0).any():
        raise RuntimeError("the model cannot take this text")
    return demo_classifier(texts)


def failing_classifier_sql(input_expr: str) -> tuple[str, str]:
    label, score = demo_classifier_sql(input_expr)
    return f"CASE WHEN length({input_expr}) % {DEMO_RAISE_EVERY} <> 0 THEN {label} END", score


def demo_responder(prompts: pd.Series) -> list:
    """Deterministic stand-in for a language model: answer by prompt length."""
    k = len(DEMO_ANSWERS)
    return [DEMO_ANSWERS[len(p) % k] for p in prompts]


def demo_answer_sql(input_expr: str) -> str:
    k = len(DEMO_ANSWERS)
    cases = " ".join(f"WHEN {i} THEN {'NULL' if a is None else q(a)}" for i, a in enumerate(DEMO_ANSWERS))
    return f"(CASE length({input_expr}) % {k} {cases} END)"


def responses_table(spark, sf_dir):
    """Offline answers per document, derived from ``documents``."""
    docs = load_table(spark, sf_dir, "documents")
    answers = F.array(*[F.lit(a) if a is not None else F.lit(None).cast("string") for a in DEMO_ANSWERS])
    pick = F.element_at(answers, (F.length("text") % F.lit(len(DEMO_ANSWERS))).cast("int") + 1)
    return docs.select("doc_id", pick.alias("response"))


def demo_valence_sql() -> str:
    rows = ", ".join(f"({q(k)}, CAST({v!r} AS DOUBLE))" for k, v in DEMO_VALENCE.items())
    return f"(VALUES {rows}) AS lex(token, valence)"


def demo_valence_rules():
    """Context rules over pseudo-words frequent in the test prose."""
    from tonemill.functions.valence import BOOSTER_INCREMENT, EXCLAMATION_STEP, ValenceRules

    return ValenceRules(negators=("no", "by"), boosters={"as": BOOSTER_INCREMENT, "with": -BOOSTER_INCREMENT},
                        exclamation_step=EXCLAMATION_STEP)
