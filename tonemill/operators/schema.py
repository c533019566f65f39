"""Schema checks and the label slots of a table to be labeled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT = "text"


class MissingTextColumn(ValueError):
    """The table has no text column; the message lists the available ones."""


def ensure_text(df: DataFrame, text_col: str | None = None) -> DataFrame:
    """Make sure the table has a ``text`` column.

    Without ``text_col`` a missing ``text`` column is an error listing the
    available columns; with it, that column is renamed to ``text``.
    """
    if text_col is None or text_col == TEXT:
        if TEXT not in df.columns:
            raise MissingTextColumn(f"the table has no column named text; its columns are: {', '.join(df.columns)}")
        return df
    if text_col not in df.columns:
        raise MissingTextColumn(f"the table has no column named {text_col}; its columns are: {', '.join(df.columns)}")
    if TEXT in df.columns:
        raise ValueError("the table already has a 'text' column; drop or rename it first")
    return df.withColumnRenamed(text_col, TEXT)


def with_label_slots(df: DataFrame, label_col: str = "label", confidence_col: str = "confidence") -> DataFrame:
    """Add (or reset) ``label = ''`` and ``confidence = 0.0``."""
    return df.withColumns({label_col: F.lit(""), confidence_col: F.lit(0.0)})
