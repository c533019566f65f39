"""Column expressions of the rule labeler.

Everything here returns a :class:`~pyspark.sql.Column` built from built-in
functions, so the labeler runs inside whole-stage codegen with no Python
worker. The pieces are separate so an operator can stage them with
``withColumns`` (each costly sub-expression then appears once in the plan).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonemill.functions.numeric import py_round
from tonemill.lexicon import (
    DEFAULT_LEXICON,
    NEGATIVE,
    NEUTRAL,
    NULL_TEXT,
    POSITIVE,
    Lexicon,
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _str_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def scoring_text(text) -> Column:
    """Lower-cased text as the labelers see it; a missing text scores as ``'nan'``."""
    return F.lower(F.coalesce(_col(text).cast("string"), F.lit(NULL_TEXT)))


def tokens(lowered) -> Column:
    """Split on single spaces, keeping empty tokens: a token equals a word
    exactly when ``' ' + word + ' '`` occurs in ``' ' + text + ' '``."""
    return F.split(_col(lowered), " ", -1)


def lexicon_hits(lowered, toks, words) -> Column:
    """Number of *distinct* entries of ``words`` that hit.

    One-word entries are matched against the token array with a hash-based
    ``array_intersect`` (one pass over the text); phrases fall back to a
    substring test on the space-padded text.
    """
    single = tuple(w for w in words if " " not in w)
    phrases = tuple(w for w in words if " " in w)
    total = F.lit(0)
    if single:
        total = total + F.size(F.array_intersect(_col(toks), _str_array(single)))
    if phrases:
        padded = F.concat(F.lit(" "), _col(lowered), F.lit(" "))
        for p in phrases:
            total = total + padded.contains(f" {p} ").cast("int")
    return total


def lexicon_candidates(toks, lexicon: Lexicon) -> Column:
    """Distinct tokens that are one-word entries of either list: the one
    pass over the token array; the per-side counts then intersect this
    short array only."""
    words = tuple(dict.fromkeys(w for w in lexicon.positive + lexicon.negative if " " not in w))
    return F.array_intersect(_col(toks), _str_array(words))


def any_substring(lowered, needles) -> Column:
    """True when any of ``needles`` occurs anywhere in the text."""
    if not needles:
        return F.lit(False)
    out = None
    for n in needles:
        c = _col(lowered).contains(n)
        out = c if out is None else (out | c)
    return out


def count_substrings(lowered, needles) -> Column:
    """Number of distinct ``needles`` that occur anywhere in the text."""
    total = F.lit(0)
    for n in needles:
        total = total + _col(lowered).contains(n).cast("int")
    return total


def rule_scores(pos_hits, neg_hits, negated, amplifiers, lexicon: Lexicon = DEFAULT_LEXICON):
    """(positive score, negative score) after the negation swap and the
    amplifier bonus, as two double Columns."""
    w = F.lit(float(lexicon.weight))
    p0 = _col(pos_hits).cast("double") * w
    n0 = _col(neg_hits).cast("double") * w
    s = F.lit(float(lexicon.swap))
    neg_flag = _col(negated)
    p1 = F.when(neg_flag, n0 * s).otherwise(p0)
    n1 = F.when(neg_flag, p0 * s).otherwise(n0)
    bonus = _col(amplifiers).cast("double") * F.lit(float(lexicon.amplifier_weight))
    pos = F.when(p1 > n1, p1 + bonus).otherwise(p1)
    neg = F.when(n1 > p1, n1 + bonus).otherwise(n1)
    return pos, neg


def rule_label(pos, neg, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """``struct<label string, confidence double>`` from the two scores;
    confidence is in 0..1."""
    p, n = _col(pos), _col(neg)
    total = p + n

    def conf(side):
        raw = F.lit(lexicon.base) + (side / (total + F.lit(lexicon.smoothing))) * F.lit(lexicon.span)
        return F.least(raw, F.lit(lexicon.cap))

    label = (
        F.when(total == 0, F.lit(NEUTRAL))
        .when(p > n, F.lit(POSITIVE))
        .when(n > p, F.lit(NEGATIVE))
        .otherwise(F.lit(NEUTRAL))
    )
    confidence = (
        F.when(total == 0, F.lit(lexicon.empty))
        .when(p > n, conf(p))
        .when(n > p, conf(n))
        .otherwise(F.lit(lexicon.tie))
    )
    return F.struct(label.alias("label"), confidence.alias("confidence"))


def rules_sentiment(text, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """The whole rule labeler as one nested Column.

    Convenient for ad-hoc use; the operator
    :func:`tonemill.operators.labeling.label_rules` stages the same pieces so
    the lowered text and token array are computed once per row.
    """
    low = scoring_text(text)
    toks = tokens(low)
    pos, neg = rule_scores(
        lexicon_hits(low, toks, lexicon.positive),
        lexicon_hits(low, toks, lexicon.negative),
        any_substring(low, lexicon.negations),
        count_substrings(low, lexicon.amplifiers),
        lexicon,
    )
    return rule_label(pos, neg, lexicon)


def to_percent(confidence) -> Column:
    """Confidence in 0..1 → percent with two decimals, rounded as Python's
    ``round`` does (see :mod:`tonemill.functions.numeric`)."""
    return py_round(_col(confidence) * F.lit(100.0), 2)
