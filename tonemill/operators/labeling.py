"""Rule labeler as DataFrame operators (a pure projection: no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.functions import rules as R
from tonemill.lexicon import DEFAULT_LEXICON, Lexicon

_LOW = "__tm_low"
_TOK = "__tm_tok"
_HIT = "__tm_hit"
_POS = "__tm_pos"
_NEG = "__tm_neg"
_CONF = "__tm_conf"


def rule_features(
    df: DataFrame,
    text_col: str = "text",
    lexicon: Lexicon = DEFAULT_LEXICON,
    names: tuple[str, str, str, str] = ("pos_hits", "neg_hits", "negated", "amplifiers"),
) -> DataFrame:
    """Add the four rule features: distinct positive and negative lexicon
    hits, the negation flag and the amplifier count."""
    staged = df.withColumn(_LOW, R.scoring_text(text_col)).withColumn(_TOK, R.tokens(_LOW))
    # One pass over the tokens finds every one-word entry present; the two
    # sides then count within that short array.
    staged = staged.withColumn(_HIT, R.lexicon_candidates(_TOK, lexicon))
    pos_n, neg_n, flag_n, amp_n = names
    out = staged.withColumns(
        {
            pos_n: R.lexicon_hits(_LOW, _HIT, lexicon.positive),
            neg_n: R.lexicon_hits(_LOW, _HIT, lexicon.negative),
            flag_n: R.any_substring(_LOW, lexicon.negations),
            amp_n: R.count_substrings(_LOW, lexicon.amplifiers),
        }
    )
    return out.drop(_LOW, _TOK, _HIT)


def with_rules_struct(
    df: DataFrame, text_col: str = "text", lexicon: Lexicon = DEFAULT_LEXICON, out: str = "rules"
) -> DataFrame:
    """Add ``out`` = ``struct<label, confidence>`` (confidence in 0..1)."""
    feats = ("__tm_ph", "__tm_nh", "__tm_nf", "__tm_am")
    staged = rule_features(df, text_col, lexicon, feats)
    pos, neg = R.rule_scores(*[F.col(c) for c in feats], lexicon=lexicon)
    staged = staged.withColumns({_POS: pos, _NEG: neg})
    staged = staged.withColumn(out, R.rule_label(_POS, _NEG, lexicon))
    return staged.drop(*feats, _POS, _NEG)


def unpack_label(
    df: DataFrame, struct_col: str, label_col: str = "label", confidence_col: str = "confidence", percent: bool = True
) -> DataFrame:
    """Replace a ``struct<label, confidence>`` column by ``label`` and
    ``confidence`` columns; confidence becomes a percent with 2 decimals.

    The two columns come out of a one-row ``inline`` (a Generate node). A
    filter on them then stays above it: pushed below, the optimizer would
    inline the whole labeler into the predicate and compute it twice."""
    label, raw = F.col(f"{struct_col}.label"), F.col(f"{struct_col}.confidence")
    keep = [F.col(f"`{c}`") for c in df.columns if c not in (struct_col, label_col, confidence_col)]
    out = df.select(*keep, F.inline(F.array(F.struct(label.alias(label_col), raw.alias(_CONF)))))
    # The rounding reads a finished column, so it stays plain generated code.
    conf = R.to_percent(_CONF) if percent else F.col(_CONF)
    out = out.withColumn(confidence_col, conf).drop(_CONF)
    # Keep the input's column order when label/confidence already existed.
    order = [c for c in df.columns if c != struct_col]
    order += [c for c in (label_col, confidence_col) if c not in order]
    return out.select(*[F.col(f"`{c}`") for c in order])


def label_rules(
    df: DataFrame,
    text_col: str = "text",
    lexicon: Lexicon = DEFAULT_LEXICON,
    label_col: str = "label",
    confidence_col: str = "confidence",
    percent: bool = True,
) -> DataFrame:
    """Label every row with the rule labeler.

    Keeps all input columns and adds (or overwrites) ``label`` and
    ``confidence`` (percent, 2 decimals, half-even).
    """
    tmp = "__tm_rules"
    return unpack_label(with_rules_struct(df, text_col, lexicon, tmp), tmp, label_col, confidence_col, percent)
