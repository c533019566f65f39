"""Lexicons for the rule labeler.

A :class:`Lexicon` is plain data: word lists plus the scoring constants.
The rule labeler in :mod:`tonemill.functions.rules` turns it into Column
expressions, so a lexicon is folded into the plan as literals (it is small
and bounded by construction) and never touches the data path.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values. These must equal the labeler being re-implemented for the
# labels to match: the word lists, the negation and amplifier strings (with
# their trailing spaces), and the scoring constants. Keep them as written.
# ---------------------------------------------------------------------------
POSITIVE_WORDS = (
    "excellent", "amazing", "wonderful", "fantastic", "great", "good", "best", "love",
    "awesome", "perfect", "outstanding", "superb", "brilliant", "fabulous", "incredible",
    "delightful", "impressive", "exceptional", "satisfied", "happy", "pleased", "enjoy",
    "recommend", "beautiful", "stunning", "remarkable", "favorite", "phenomenal", "loved",
    "thrilled", "excited", "glad", "grateful", "appreciate", "positive", "success",
)
NEGATIVE_WORDS = (
    "terrible", "awful", "horrible", "worst", "bad", "poor", "hate", "disappointing",
    "disappointed", "useless", "waste", "pathetic", "disgusting", "annoying", "frustrated",
    "angry", "sad", "upset", "regret", "complaint", "defective", "broken", "fail", "failed",
    "never again", "avoid", "refund", "scam", "fraud", "cheap", "junk", "negative",
)
NEGATIONS = ("not ", "n't ", "no ", "never ", "without ", "don't ", "won't ")
AMPLIFIERS = ("very ", "really ", "extremely ", "absolutely ", "totally ", "completely ")
HIT_WEIGHT = 3.0          # score per distinct lexicon hit
NEGATION_SWAP = 1.5       # both sides are swapped and multiplied by this
AMPLIFIER_WEIGHT = 1.0    # added per amplifier to the strictly larger side
BASE_CONFIDENCE = 0.65
CONFIDENCE_SPAN = 0.3
CONFIDENCE_SMOOTHING = 5.0
MAX_CONFIDENCE = 0.92
TIE_CONFIDENCE = 0.6
EMPTY_CONFIDENCE = 0.5
NULL_TEXT = "nan"         # what a missing text is scored as

LABELS = ("Positive", "Negative", "Neutral")
POSITIVE, NEGATIVE, NEUTRAL = LABELS


@dataclass(frozen=True)
class Lexicon:
    """Word lists and constants of the rule labeler.

    ``positive``/``negative`` entries hit when they occur surrounded by
    single spaces in ``' ' + lower(text) + ' '`` (presence, not count).
    ``negations``/``amplifiers`` are plain substrings of ``lower(text)``.
    """

    positive: tuple[str, ...] = POSITIVE_WORDS
    negative: tuple[str, ...] = NEGATIVE_WORDS
    negations: tuple[str, ...] = NEGATIONS
    amplifiers: tuple[str, ...] = AMPLIFIERS
    weight: float = HIT_WEIGHT
    swap: float = NEGATION_SWAP
    amplifier_weight: float = AMPLIFIER_WEIGHT
    base: float = BASE_CONFIDENCE
    span: float = CONFIDENCE_SPAN
    smoothing: float = CONFIDENCE_SMOOTHING
    cap: float = MAX_CONFIDENCE
    tie: float = TIE_CONFIDENCE
    empty: float = EMPTY_CONFIDENCE

    def __post_init__(self):
        for name in ("positive", "negative", "negations", "amplifiers"):
            values = tuple(getattr(self, name))
            if any(not isinstance(v, str) or v == "" for v in values):
                raise ValueError(f"lexicon {name} entries must be non-empty strings")
            if len(set(values)) != len(values):
                raise ValueError(f"lexicon {name} has duplicate entries")
            object.__setattr__(self, name, values)


DEFAULT_LEXICON = Lexicon()

# Lexicon used only to exercise every branch on the synthetic test tables,
# whose pseudo-word prose hardly ever contains a default entry.
COVERAGE_LEXICON = Lexicon(
    positive=("best", "thble", "thnt", "than", "thes"),
    negative=("pathetic", "disgusting", "thth", "thre", "thon"),
    negations=("no ", "by "),
    amplifiers=("as ", "with "),
)
