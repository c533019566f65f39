"""The named labelers and one entry point to label a table with any of them.

A model needs its resources as arguments (there are no hidden downloads or
network clients): a valence lexicon, a classifier scorer, or a language
model responder. Without them a labeler falls back to the rule labeler, row
for row, as the original behaviour does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tonemill.lexicon import DEFAULT_LEXICON, Lexicon
from tonemill.operators.ensemble import label_ensemble
from tonemill.operators.labeling import label_rules
from tonemill.operators.scoring import label_with_llm, label_with_scorer
from tonemill.operators.valence import label_valence


@dataclass(frozen=True)
class ModelInfo:
    name: str
    kind: str
    accuracy: str
    speed: str
    requires: str
    cost: str
    description: str
    needs_key: bool = False


# The seven labelers in their menu order with their metadata.
MODELS = {
    m.name: m
    for m in (
        ModelInfo("Enhanced Rules (Fast)", "rules", "80-85%", "Very Fast", "None", "Free",
                  "Rule-based with advanced negation handling"),
        ModelInfo("VADER (Social Media)", "valence", "82-87%", "Fast", "pip install vaderSentiment", "Free",
                  "Optimized for social media & reviews"),
        ModelInfo("DistilBERT (AI)", "binary", "88-92%", "Medium", "pip install transformers torch", "Free",
                  "Fast transformer model (~250MB)"),
        ModelInfo("RoBERTa (Best Free)", "ternary", "92-95%", "Medium", "pip install transformers torch", "Free",
                  "State-of-the-art Twitter-trained model"),
        ModelInfo("Ensemble (Hybrid)", "ensemble", "90-94%", "Slow", "Multiple models", "Free",
                  "Combines 3+ models with voting"),
        ModelInfo("OpenAI GPT-3.5", "chat", "94-97%", "Slowest", "pip install openai + API key", "$0.002/1K tokens",
                  "ChatGPT-powered analysis", True),
        ModelInfo("Google Gemini Pro", "plain", "94-97%", "Slowest", "pip install google-generativeai + API key",
                  "Free tier available", "Google's latest AI model", True),
    )
}
DEFAULT_MODEL = "RoBERTa (Best Free)"


def model_catalog(spark: SparkSession) -> DataFrame:
    """The registry as a table, in menu order."""
    rows = [(i, m.name, m.kind, m.accuracy, m.speed, m.requires, m.cost, m.description, m.needs_key)
            for i, m in enumerate(MODELS.values())]
    return spark.createDataFrame(
        rows,
        "ord int, name string, kind string, accuracy string, speed string, requires string, cost string, "
        "description string, needs_key boolean",
    )


def export_name(model: str) -> str:
    """Default file name of a full export labeled with ``model``."""
    return f"labeled_{model.replace(' ', '_').lower()}.csv"


def label_dataset(
    df: DataFrame,
    model: str,
    *,
    text_col: str = "text",
    api_key: str | None = None,
    lexicon: Lexicon = DEFAULT_LEXICON,
    valence_lexicon=None,
    classifier=None,
    responder=None,
    **kw,
) -> DataFrame:
    """Label ``df`` with the named model; adds ``label`` and ``confidence``
    (percent). Unknown names raise ``KeyError``.

    The two language models also need ``api_key`` (any non-empty value; the
    responder carries its own client) — without key or responder they fall
    back to the rule labeler.
    """
    info = MODELS[model]
    if info.kind == "rules":
        return label_rules(df, text_col, lexicon)
    if info.kind == "valence":
        if valence_lexicon is None:
            return label_rules(df, text_col, lexicon)
        return label_valence(df, valence_lexicon, text_col, keep_compound=False, **kw)
    if info.kind in ("binary", "ternary"):
        if classifier is None:
            return label_rules(df, text_col, lexicon)
        return label_with_scorer(df, classifier, info.kind, text_col, lexicon=lexicon, **kw)
    if info.kind == "ensemble":
        return label_ensemble(df, text_col, lexicon=lexicon, valence_lexicon=valence_lexicon,
                              classifier=classifier, **kw)
    if info.kind in ("chat", "plain"):
        if not api_key or responder is None:
            return label_rules(df, text_col, lexicon)
        return label_with_llm(df, responder, info.kind, text_col, lexicon=lexicon, **kw)
    raise KeyError(model)
