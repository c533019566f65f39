"""Label and confidence statistics.

Every report is one global aggregate: each task folds its rows into a
handful of counters (partial aggregation) and only those partial rows are
exchanged, so the cost is one scan regardless of the table size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemill.functions.numeric import py_round
from tonemill.functions.report import HIGH, LOW_BELOW, VERY_HIGH
from tonemill.lexicon import LABELS


def _count_if(cond: Column) -> Column:
    return F.count_if(cond).cast("long")


def _cents(confidence: Column) -> Column:
    # Confidences carry two decimals; summing whole cents keeps the mean
    # exact and independent of summation order.
    return F.round(confidence * F.lit(100.0)).cast("long")


COUNTERS = ["total", *(label.lower() for label in LABELS), "cents", "n_confidence", "high_count", "very_high_count", "low_count"]


def counters(label_col: str = "label", confidence_col: str = "confidence") -> list[Column]:
    """The aggregates the report is made of, named as ``COUNTERS``; those of parts
    of a table add up to those of the table."""
    lab, conf = F.col(label_col), F.col(confidence_col)
    found = [
        F.count(F.lit(1)).cast("long"), *[_count_if(lab == F.lit(l)) for l in LABELS],
        F.coalesce(F.sum(_cents(conf)), F.lit(0)).cast("long"), F.count(conf).cast("long"),
        _count_if(conf >= HIGH), _count_if(conf >= VERY_HIGH), _count_if(conf < LOW_BELOW),
    ]
    return [c.alias(name) for c, name in zip(found, COUNTERS)]


def metrics_of(counted: DataFrame) -> DataFrame:
    """The report's numbers from a row of counters: the exact mean (whole cents
    summed), and the 1-decimal value the report shows."""
    mean = F.when(F.col("n_confidence") > 0, F.col("cents").cast("double") / F.col("n_confidence") / F.lit(100.0))
    out = counted.withColumn("avg_confidence", mean)
    return out.withColumn("avg_confidence_display", py_round(F.col("avg_confidence"), 1)).drop("cents", "n_confidence")


def report_metrics(
    df: DataFrame, label_col: str = "label", confidence_col: str = "confidence"
) -> DataFrame:
    """Every number of the report in one row, from one aggregate."""
    return metrics_of(df.agg(*counters(label_col, confidence_col)))


def confidence_stats(df: DataFrame, label_col: str = "label", confidence_col: str = "confidence") -> DataFrame:
    """Total rows, mean confidence, and the >= 85, >= 90 and < 60 counts."""
    return report_metrics(df, label_col, confidence_col).select(
        "total", "avg_confidence", "avg_confidence_display", "high_count", "very_high_count", "low_count"
    )


def label_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows ``(label, n)`` for exactly the three labels; an absent label
    counts 0 and other values are not counted."""
    lab = F.col(label_col)
    wide = df.agg(*[_count_if(lab == F.lit(l)).alias(f"__n{i}") for i, l in enumerate(LABELS)])
    args = ", ".join(f"'{l}', __n{i}" for i, l in enumerate(LABELS))
    return wide.selectExpr(f"stack({len(LABELS)}, {args}) as (label, n)")


def label_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows ``(label, n, share)``: share = n / total * 100 (1 decimal),
    0 when the table is empty."""
    lab = F.col(label_col)
    wide = df.agg(
        F.count(F.lit(1)).cast("long").alias("__total"),
        *[_count_if(lab == F.lit(l)).alias(f"__n{i}") for i, l in enumerate(LABELS)],
    )
    args = ", ".join(f"'{l}', __n{i}" for i, l in enumerate(LABELS))
    long = wide.selectExpr("__total", f"stack({len(LABELS)}, {args}) as (label, n)")
    share = F.when(
        F.col("__total") > 0, py_round(F.col("n").cast("double") / F.col("__total") * F.lit(100.0), 1)
    ).otherwise(F.lit(0.0))
    return long.select("label", "n", share.alias("share"))


def filter_counts(df: DataFrame, predicate: Column) -> DataFrame:
    """``(shown, total)``: rows passing ``predicate`` and all rows, from one
    aggregate."""
    return df.agg(
        _count_if(F.coalesce(predicate, F.lit(False))).alias("shown"),
        F.count(F.lit(1)).cast("long").alias("total"),
    )
