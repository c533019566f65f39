"""CSV exports of a labeled table.

Files are written the way a spreadsheet-style writer does: header, minimal
quoting with ``"``, a doubled ``""`` inside quoted fields, null and empty
values as empty fields, whitespace kept. Spark writes a folder of part
files under the given name, one per task, so exports scale with the
cluster. The confidence tiers are written in one pass as partition folders.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.functions.report import HIGH, VERY_HIGH, confidence_tier
from tonemill.lexicon import LABELS
from tonemill.operators.registry import export_name
from tonemill.operators.views import label_filter
from tonemill.session import keep_table  # noqa: F401  (a sink like the others)

# The export file names.
HIGH_NAME = "high_confidence_85plus.csv"
VERY_HIGH_NAME = "very_high_confidence_90plus.csv"
FILTERED_NAME = "filtered_data.csv"
TIER_COLUMN = "confidence_tier"

_WRITE_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def export_path(base: str, model: str | None = None, name: str | None = None) -> str:
    """``base/labeled_<model>.csv`` or ``base/<name>``."""
    return os.path.join(base, name if name is not None else export_name(model))


def export_csv(df: DataFrame, path: str, mode: str = "overwrite", **options) -> str:
    """Write all rows and columns of ``df`` as CSV under ``path``; ``options``
    are further writer options (``sep``, ``encoding``, ``extension``)."""
    df.write.mode(mode).options(**_WRITE_OPTIONS, **options).csv(path)
    return path


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Read an export back (all columns as strings, empty fields as null)."""
    return (
        spark.read.option("header", True).option("quote", '"').option("escape", '"')
        .option("multiLine", True).csv(path)
    )


def export_high(df: DataFrame, path: str, min_confidence: float = HIGH, confidence_col: str = "confidence",
                mode: str = "overwrite") -> bool:
    """Write rows with confidence >= ``min_confidence``, only if there are
    any; returns whether a file was written. The selection is stored once, so
    a labeler above it runs once per row."""
    sel = keep_table(df.filter(F.col(confidence_col) >= F.lit(float(min_confidence))), name="selection")
    if not sel.take(1):
        return False
    export_csv(sel, path, mode)
    return True


def export_very_high(df: DataFrame, path: str, confidence_col: str = "confidence", mode: str = "overwrite") -> bool:
    return export_high(df, path, VERY_HIGH, confidence_col, mode)


def export_filtered(df: DataFrame, path: str, labels: Iterable[str] = LABELS, min_confidence: float = 0.0,
                    label_col: str = "label", confidence_col: str = "confidence", mode: str = "overwrite") -> bool:
    """Write the filtered view only if it is smaller than the whole table
    (both counts come from one aggregate); returns whether it was written. The
    table is stored once, so a labeler above it runs once per row."""
    df = keep_table(df)
    pred = label_filter(labels, min_confidence, label_col, confidence_col)
    row = df.agg(F.count_if(F.coalesce(pred, F.lit(False))).alias("shown"), F.count(F.lit(1)).alias("total")).first()
    if row["shown"] >= row["total"]:
        return False
    export_csv(df.filter(pred), path, mode)
    return True


def export_tiers(df: DataFrame, path: str, confidence_col: str = "confidence", mode: str = "overwrite") -> str:
    """Write every row once into ``confidence_tier=<tier>`` folders
    (``very_high`` >= 90, ``high`` >= 85, ``medium`` >= 60, ``low``); the
    >= 85 export is the ``very_high`` and ``high`` folders together."""
    tiered = df.withColumn(TIER_COLUMN, confidence_tier(confidence_col))
    tiered.write.mode(mode).partitionBy(TIER_COLUMN).options(**_WRITE_OPTIONS).csv(path)
    return path


def read_tiers(spark: SparkSession, path: str, tiers: Iterable[str]) -> DataFrame:
    """Read some tiers of :func:`export_tiers` (partition pruning skips the
    other folders)."""
    return read_export(spark, path).filter(F.col(TIER_COLUMN).isin(list(tiers)))
