"""Batch inference: classifier and language-model labelers.

A *scorer* is any picklable callable ``pandas.Series[str] -> result`` run on
Arrow batches inside Python workers:

* a classifier returns a DataFrame with ``label`` and ``score`` columns (or
  a sequence of ``(label, score)`` pairs), one per input; a null label or a
  missing score means "no result" and the row falls back to the rule labeler;
* a responder returns the answer text per prompt (null = no answer).

The model runs as a pandas UDF on the cut model input: that one column crosses
into Python and back, the rest of the row stays in the JVM, and nothing is
shuffled. A batch the model raises on is halved until the rows it fails for
stand alone; those have no result, the others keep theirs. With ``distinct``
(the default) each batch hands every different input to the model once.

Results are not stored unless an answer table is named (``answers=path``, see
:mod:`tonemill.operators.answers`): then every different input of the whole table
is asked once, in this run and later ones. Otherwise run several actions over a
labeled table from :func:`tonemill.session.keep_table`. Heavy models should be built once per
worker process: wrap their factory in :class:`load_once`.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.functions import models as M
from tonemill.lexicon import DEFAULT_LEXICON, Lexicon
from tonemill.operators.answers import AnswerTable
from tonemill.operators.labeling import unpack_label, with_rules_struct

_MODEL = "__tm_model_out"

_CACHE: dict = {}
_LOCK = threading.Lock()


def _built(token: str, factory: Callable[[], Callable]) -> Callable:
    with _LOCK:
        if token not in _CACHE:
            _CACHE[token] = factory()
        return _CACHE[token]


class load_once:
    """A callable that builds ``factory()`` on first use in each Python worker
    process and reuses it for every later batch. Every instance has a model of
    its own unless two are given the same ``name``."""

    def __init__(self, factory: Callable[[], Callable], name: str | None = None):
        self.factory, self.token = factory, name or uuid.uuid4().hex

    def __call__(self, batch):
        return _built(self.token, self.factory)(batch)


def _attempt(model: Callable, inputs: pd.Series, rows: Callable) -> list:
    """One result per input; None where the model raises. ``rows`` turns what
    the model returns into a list and checks its length."""
    if not len(inputs):
        return []
    try:
        result = model(inputs)
    except Exception:  # noqa: BLE001  any failure of the model for a row means "no result"
        if len(inputs) == 1:
            return [None]
        half = len(inputs) // 2
        return _attempt(model, inputs.iloc[:half], rows) + _attempt(model, inputs.iloc[half:], rows)
    return rows(result, len(inputs))


def _over(model: Callable, inputs: pd.Series, rows: Callable, distinct: bool) -> list:
    if not distinct:
        return _attempt(model, inputs, rows)
    different = inputs.drop_duplicates()
    found = dict(zip(different, _attempt(model, different, rows)))
    return [found[x] for x in inputs]


def _scored_rows(result, n: int) -> list:
    if isinstance(result, pd.DataFrame):
        pairs = list(zip(result["label"], result["score"]))
    else:
        pairs = [(None, None) if r is None else (r[0], r[1]) for r in result]
    if len(pairs) != n:
        raise ValueError(f"scorer returned {len(pairs)} results for {n} inputs")
    return pairs


def _answer_rows(result, n: int) -> list:
    answers = [None if r is None else str(r) for r in result]
    if len(answers) != n:
        raise ValueError(f"responder returned {len(answers)} answers for {n} prompts")
    return answers


def _classifier(scorer: Callable, distinct: bool):
    def run(inputs: pd.Series) -> pd.DataFrame:
        pairs = [(None, None) if r is None else r for r in _over(scorer, inputs, _scored_rows, distinct)]
        out = pd.DataFrame(pairs, columns=["label", "score"], dtype=object)
        out["label"] = out["label"].where(out["label"].notna(), None)
        out["score"] = pd.to_numeric(out["score"], errors="coerce").astype("float64")
        return out

    # Nondeterministic: Spark then evaluates it once and in its place.
    return F.pandas_udf(run, "label string, score double").asNondeterministic()


def _responder(responder: Callable, distinct: bool):
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(_over(responder, prompts, _answer_rows, distinct), dtype=object)

    return F.pandas_udf(run, "string").asNondeterministic()


def score_texts(df: DataFrame, scorer: Callable, text_col: str = "text", n_chars: int = M.CLASSIFIER_CHARS,
                distinct: bool = True, answers: str | None = None, **filling) -> DataFrame:
    """Add raw classifier output ``model_label``/``model_score`` per row. With
    ``answers``, the path of an answer table, each different input of the whole
    table is scored once and kept for later runs (this happens at once;
    ``filling``: see :meth:`tonemill.operators.answers.AnswerTable.fill`)."""
    if answers:
        table = AnswerTable(df.sparkSession, answers, "label string, score double")
        model_input = M.model_input(text_col, n_chars)
        table.fill(df, model_input, lambda model: _classifier(model, False), scorer, **filling)
        scored = table.attach(df.withColumn(_MODEL, F.struct(*[F.col(f"`{c}`") for c in df.columns])).select(_MODEL, model_input.alias("__tm_in")), F.col("__tm_in"))
        return scored.select(f"{_MODEL}.*", F.col("label").alias("model_label"), F.col("score").alias("model_score"))
    out = df.withColumn(_MODEL, _classifier(scorer, distinct)(M.model_input(text_col, n_chars)))
    return out.withColumns({"model_label": F.col(f"{_MODEL}.label"), "model_score": F.col(f"{_MODEL}.score")}).drop(_MODEL)


def with_scorer_struct(df: DataFrame, scorer: Callable, normalise="ternary", text_col: str = "text",
                       out: str = "model", n_chars: int = M.CLASSIFIER_CHARS, distinct: bool = True,
                       lexicon: Lexicon = DEFAULT_LEXICON,
                       fallback_col: str | None = None, source_col: str | None = None, **answers) -> DataFrame:
    """Add ``out`` = normalised classifier result, rule result where the
    classifier gave none. ``fallback_col`` names a rule result the table
    already has (so the rule labeler is not computed twice). ``source_col``
    adds who labeled the row, ``model`` or ``rules``; ``answers`` as in
    :func:`score_texts`."""
    norm = M.NORMALISERS[normalise] if isinstance(normalise, str) else normalise
    scored = score_texts(df, scorer, text_col, n_chars, distinct, **answers)
    rules = fallback_col or "__tm_fallback"
    staged = scored if fallback_col else with_rules_struct(scored, text_col, lexicon, rules)
    own = norm(F.col("model_label"), F.col("model_score"))
    if source_col:
        staged = staged.withColumn(source_col, _source(own))
    staged = staged.withColumn(out, M.with_fallback(own, F.col(rules))).drop("model_label", "model_score")
    return staged if fallback_col else staged.drop(rules)


def _source(result):
    return F.when(result.isNotNull(), "model").otherwise("rules")


def label_with_scorer(df: DataFrame, scorer: Callable, normalise="ternary", text_col: str = "text",
                      label_col: str = "label", confidence_col: str = "confidence", **kw) -> DataFrame:
    """Label every row with a classifier (confidence in percent)."""
    tmp = "__tm_model"
    return unpack_label(with_scorer_struct(df, scorer, normalise, text_col, tmp, **kw), tmp, label_col, confidence_col)


def respond(df: DataFrame, responder: Callable, style: str = "chat", text_col: str = "text",
            distinct: bool = True, answers: str | None = None, **filling) -> DataFrame:
    """Add the model's answer ``response`` per row. ``style='chat'`` sends
    the user turn of :func:`~tonemill.functions.models.chat_messages` (the
    system turn is fixed), ``'plain'`` the single prompt. ``answers`` names an
    answer table, as in :func:`score_texts`; ``per_minute=60, tasks=4`` lets four
    tasks share 60 requests a minute."""
    prompt = M.chat_user_content(text_col) if style == "chat" else M.plain_prompt(text_col)
    if answers:
        table = AnswerTable(df.sparkSession, answers, "response string")
        table.fill(df, prompt, lambda model: _responder(model, False), responder, **filling)
        return table.attach(df.drop("response"), prompt)
    return df.withColumn("response", _responder(responder, distinct)(prompt))


def _label_from_answers(df: DataFrame, parse, text_col: str, label_col: str, confidence_col: str,
                        lexicon: Lexicon, source_col: str | None = None) -> DataFrame:
    parser = M.PARSERS[parse] if isinstance(parse, str) else parse
    rules, tmp = "__tm_fallback", "__tm_answer"
    staged = with_rules_struct(df, text_col, lexicon, rules)
    if source_col:
        staged = staged.withColumn(source_col, _source(parser(F.col("response"))))
    staged = staged.withColumn(tmp, M.with_fallback(parser(F.col("response")), F.col(rules))).drop(rules)
    return unpack_label(staged, tmp, label_col, confidence_col)


def label_with_llm(df: DataFrame, responder: Callable, style: str = "chat", text_col: str = "text",
                   label_col: str = "label", confidence_col: str = "confidence", distinct: bool = True,
                   lexicon: Lexicon = DEFAULT_LEXICON, keep_response: bool = False,
                   source_col: str | None = None, **answers) -> DataFrame:
    """Label every row from a language model's answers; ``chat`` answers are
    parsed as "<Label> <confidence>", ``plain`` answers by keyword. ``answers``
    as in :func:`respond`; ``source_col`` adds who labeled the row."""
    answered = respond(df, responder, style, text_col, distinct, **answers)
    out = _label_from_answers(answered, "scored" if style == "chat" else "plain", text_col, label_col,
                              confidence_col, lexicon, source_col)
    return out if keep_response else out.drop("response")


def label_with_responses(df: DataFrame, key: str, responses: DataFrame, parse: str = "scored",
                         text_col: str = "text", label_col: str = "label", confidence_col: str = "confidence",
                         lexicon: Lexicon = DEFAULT_LEXICON, response_col: str = "response") -> DataFrame:
    """Label rows from answers obtained offline: ``responses(key, response)``
    is left-joined on ``key`` (rows without an answer fall back to rules). Of
    several answers for one key the smallest text that is not null counts."""
    ans = responses.groupBy(key).agg(F.min(response_col).alias("response"))
    joined = df.join(ans, key, "left")
    return _label_from_answers(joined, parse, text_col, label_col, confidence_col, lexicon)
