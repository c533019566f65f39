"""tonemill: sentiment labeling of text tables as Spark DataFrame operators."""

from tonemill.lexicon import COVERAGE_LEXICON, DEFAULT_LEXICON, LABELS, Lexicon

__all__ = ["COVERAGE_LEXICON", "DEFAULT_LEXICON", "LABELS", "Lexicon"]
