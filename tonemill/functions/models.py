"""Column expressions around model labelers: input cutting, prompt
building, output normalisation, answer parsing and the rules fallback.

A model result is ``struct<label string, confidence double>`` (0..1) or
null when the model is missing or failed for that row; :func:`with_fallback`
then substitutes the rule label.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonemill.lexicon import NEGATIVE, NEUTRAL, NULL_TEXT, POSITIVE

# How much text a model sees, the prompts, and the constants
# that turn model outputs into a label and a confidence.
CLASSIFIER_CHARS = 512
PROMPT_CHARS = 500
CHAT_SYSTEM_PROMPT = (
    "You are a sentiment analysis expert. Respond with only: "
    "'Positive', 'Negative', or 'Neutral' followed by confidence 0-100."
)
CHAT_USER_PREFIX = "Analyze sentiment: "
PLAIN_PROMPT_PREFIX = (
    "Analyze the sentiment of this text and respond with only "
    "'Positive', 'Negative', or 'Neutral': "
)
BINARY_BONUS, BINARY_CAP = 0.05, 0.98
TERNARY_BONUS, TERNARY_CAP, TERNARY_NEUTRAL_CAP = 0.02, 0.98, 0.90
SCORED_DEFAULT, SCORED_MIN, SCORED_MAX = 0.95, 0.7, 0.98
PLAIN_CONFIDENCE, PLAIN_NEUTRAL = 0.96, 0.85


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _result(label: Column, confidence: Column) -> Column:
    return F.struct(label.alias("label"), confidence.alias("confidence"))


def model_input(text, n: int = CLASSIFIER_CHARS) -> Column:
    """The first ``n`` characters of the text (``'nan'`` for a missing one)."""
    return F.substring(F.coalesce(_col(text).cast("string"), F.lit(NULL_TEXT)), 1, n)


def _usable(label, score: Column) -> Column:
    # least() skips nulls: without this a missing score would become the cap.
    return _col(label).isNotNull() & score.isNotNull() & ~F.isnan(score)


def normalise_binary(label, score) -> Column:
    """Two-class classifier output → result. Upper-cased label containing
    ``POS``/``NEG`` gives Positive/Negative with ``min(score+0.05, 0.98)``,
    anything else Neutral with the raw score; null label, null or NaN score
    → null."""
    up, s = F.upper(_col(label)), _col(score).cast("double")
    boosted = F.least(s + F.lit(BINARY_BONUS), F.lit(BINARY_CAP))
    lab = F.when(up.contains("POS"), F.lit(POSITIVE)).when(up.contains("NEG"), F.lit(NEGATIVE)).otherwise(F.lit(NEUTRAL))
    conf = F.when(up.contains("POS") | up.contains("NEG"), boosted).otherwise(s)
    return F.when(_usable(label, s), _result(lab, conf))


def normalise_ternary(label, score) -> Column:
    """Three-class classifier output → result. Lower-cased label containing
    ``positive``/``negative`` gives ``min(score+0.02, 0.98)``, else Neutral
    with ``min(score, 0.90)``; null label, null or NaN score → null."""
    low, s = F.lower(_col(label)), _col(score).cast("double")
    boosted = F.least(s + F.lit(TERNARY_BONUS), F.lit(TERNARY_CAP))
    lab = (
        F.when(low.contains("positive"), F.lit(POSITIVE))
        .when(low.contains("negative"), F.lit(NEGATIVE))
        .otherwise(F.lit(NEUTRAL))
    )
    conf = F.when(low.contains("positive") | low.contains("negative"), boosted).otherwise(
        F.least(s, F.lit(TERNARY_NEUTRAL_CAP))
    )
    return F.when(_usable(label, s), _result(lab, conf))


NORMALISERS = {"binary": normalise_binary, "ternary": normalise_ternary}


def chat_user_content(text) -> Column:
    return F.concat(F.lit(CHAT_USER_PREFIX), model_input(text, PROMPT_CHARS))


def chat_messages(text) -> Column:
    """``array<struct<role, content>>``: the system prompt and the user turn."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(CHAT_SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), chat_user_content(text).alias("content")),
    )


def plain_prompt(text) -> Column:
    """Single-string prompt for a plain completion model."""
    return F.concat(F.lit(PLAIN_PROMPT_PREFIX), model_input(text, PROMPT_CHARS))


def parse_scored_answer(response) -> Column:
    """Answer of the form "<Label> <confidence 0-100>".

    Label: case-sensitive ``Positive``, else ``Negative``, else Neutral.
    Confidence: all ASCII digits of the answer joined and divided by 100,
    clamped to [0.7, 0.98]; 0.95 when there is no digit. Null answer → null.
    """
    r = _col(response)
    lab = F.when(r.contains("Positive"), F.lit(POSITIVE)).when(r.contains("Negative"), F.lit(NEGATIVE)).otherwise(
        F.lit(NEUTRAL)
    )
    digits = F.regexp_replace(r, "[^0-9]", "")
    value = digits.cast("double") / F.lit(100.0)
    # An explicit branch for "no digits": greatest() would skip the null.
    conf = F.when(digits == F.lit(""), F.lit(SCORED_DEFAULT)).otherwise(
        F.least(F.greatest(value, F.lit(SCORED_MIN)), F.lit(SCORED_MAX))
    )
    return F.when(r.isNotNull(), _result(lab, conf))


def parse_plain_answer(response) -> Column:
    """Free answer: lower-cased, contains ``positive`` → Positive 0.96,
    ``negative`` → Negative 0.96, else Neutral 0.85. Null answer → null."""
    r = F.lower(_col(response))
    lab = F.when(r.contains("positive"), F.lit(POSITIVE)).when(r.contains("negative"), F.lit(NEGATIVE)).otherwise(
        F.lit(NEUTRAL)
    )
    conf = F.when(r.contains("positive") | r.contains("negative"), F.lit(PLAIN_CONFIDENCE)).otherwise(
        F.lit(PLAIN_NEUTRAL)
    )
    return F.when(_col(response).isNotNull(), _result(lab, conf))


PARSERS = {"scored": parse_scored_answer, "plain": parse_plain_answer}


def with_fallback(model, rules) -> Column:
    """The model result, or the rule result where the model gave none."""
    return F.coalesce(_col(model), _col(rules))
