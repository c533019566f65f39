"""Column expressions of the valence (lexicon-sum) labeler."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonemill.functions.numeric import py_round
from tonemill.lexicon import NEGATIVE, NEUTRAL, NULL_TEXT, POSITIVE

# The compound normalisation constant, the label thresholds on
# the compound score, the confidence mapping and the compound's precision.
ALPHA = 15.0
THRESHOLD = 0.05
CONF_OFFSET, CONF_CAP, NEUTRAL_CONFIDENCE = 0.2, 0.95, 0.65
COMPOUND_DECIMALS = 4
# Valences are decimals of so many places; they are summed as whole multiples
# of 1/VALENCE_SCALE, so the sum is exact and does not depend on the order.
VALENCE_DECIMALS = 10
VALENCE_SCALE = 10**VALENCE_DECIMALS

# A token: letters/digits, optionally joined by inner apostrophes ("don't").
TOKEN_PATTERN = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valence_tokens(text) -> Column:
    """Lower-cased word tokens of the text (``'nan'`` for a missing one)."""
    low = F.lower(F.coalesce(_col(text).cast("string"), F.lit(NULL_TEXT)))
    return F.regexp_extract_all(low, F.lit(TOKEN_PATTERN), F.lit(0))


def scaled_valence(valence) -> Column:
    """Valence as a whole number of 1/VALENCE_SCALE units."""
    exact = _col(valence).cast("double").cast(f"decimal(18,{VALENCE_DECIMALS})")
    return (exact * F.lit(VALENCE_SCALE)).cast("long")


def compound_from_sum(scaled_sum) -> Column:
    """Normalise a (scaled) valence sum to [-1, 1]: s / sqrt(s^2 + alpha),
    rounded to 4 decimals; 0 without any hit."""
    s = F.coalesce(_col(scaled_sum), F.lit(0)).cast("double") / F.lit(float(VALENCE_SCALE))
    raw = s / F.sqrt(s * s + F.lit(ALPHA))
    clamped = F.least(F.greatest(raw, F.lit(-1.0)), F.lit(1.0))
    return py_round(clamped, COMPOUND_DECIMALS)


def label_from_compound(compound) -> Column:
    """Compound → result: >= 0.05 Positive, <= -0.05 Negative, both with
    ``min((|c|+1)/2 + 0.2, 0.95)``; otherwise Neutral 0.65."""
    c = _col(compound)
    conf = F.least((F.abs(c) + F.lit(1.0)) / F.lit(2.0) + F.lit(CONF_OFFSET), F.lit(CONF_CAP))
    lab = F.when(c >= F.lit(THRESHOLD), F.lit(POSITIVE)).when(c <= F.lit(-THRESHOLD), F.lit(NEGATIVE)).otherwise(
        F.lit(NEUTRAL)
    )
    confidence = F.when((c >= F.lit(THRESHOLD)) | (c <= F.lit(-THRESHOLD)), conf).otherwise(F.lit(NEUTRAL_CONFIDENCE))
    return F.struct(lab.alias("label"), confidence.alias("confidence"))


@dataclass(frozen=True)
class ValenceRules:
    """Optional context rules of the valence scorer (all off by default).

    For each lexicon hit, the up to ``window`` preceding tokens are visited
    nearest first; at distance ``j`` a booster adds its increment (damped by
    ``damping[j-1]``, sign-flipped while the running valence is negative) and
    then a negator multiplies the running valence by ``negation_scalar``.
    Each ``!`` in the text (at most ``exclamation_max``) pushes the sum
    ``exclamation_step`` further from zero. The word lists are inputs; the
    constants default to the published values of the valence-aware scorer.
    """

    negators: tuple[str, ...] = ()
    boosters: dict = field(default_factory=dict)
    window: int = 3
    negation_scalar: float = -0.74
    damping: tuple[float, ...] = (1.0, 0.95, 0.9)
    exclamation_step: float = 0.0
    exclamation_max: int = 4

    @property
    def active(self) -> bool:
        return bool(self.negators or self.boosters or self.exclamation_step)


# Published constants of the valence-aware scorer (used when asked for).
BOOSTER_INCREMENT = 0.293
EXCLAMATION_STEP = 0.292


def with_emphasis(total, text, rules: ValenceRules) -> Column:
    """``total`` pushed ``exclamation_step`` further from zero per ``!`` in
    the text (at most ``exclamation_max``); unchanged without the rule."""
    total = _col(total)
    if not rules.exclamation_step:
        return total
    raw = F.coalesce(_col(text).cast("string"), F.lit(NULL_TEXT))
    marks = F.least(F.length(raw) - F.length(F.replace(raw, F.lit("!"), F.lit(""))), F.lit(rules.exclamation_max))
    emph = marks.cast("double") * F.lit(rules.exclamation_step)
    return F.when(total > 0, total + emph).when(total < 0, total - emph).otherwise(total)


def compound_from_double(s) -> Column:
    """Normalise an (unscaled) valence sum to [-1, 1], 4 decimals."""
    s = F.coalesce(_col(s), F.lit(0.0))
    raw = s / F.sqrt(s * s + F.lit(ALPHA))
    return py_round(F.least(F.greatest(raw, F.lit(-1.0)), F.lit(1.0)), COMPOUND_DECIMALS)
