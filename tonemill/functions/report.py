"""Column helpers for confidence bands and export tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The thresholds (percent) used by the report, the colour
# band of the preview and the export tiers.
HIGH = 85.0
VERY_HIGH = 90.0
MEDIUM = 60.0
LOW_BELOW = 60.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def confidence_band(confidence="confidence") -> Column:
    """Preview colour band: ``high`` (>= 85), ``medium`` (>= 60), ``low``."""
    c = _col(confidence)
    return F.when(c >= HIGH, "high").when(c >= MEDIUM, "medium").otherwise("low")


def confidence_tier(confidence="confidence") -> Column:
    """Export tier: ``very_high`` (>= 90), ``high`` (>= 85), ``medium``
    (>= 60), ``low``. Tiers are disjoint, so ">= 85" is the union of the
    ``very_high`` and ``high`` tiers."""
    c = _col(confidence)
    return (
        F.when(c >= VERY_HIGH, "very_high")
        .when(c >= HIGH, "high")
        .when(c >= MEDIUM, "medium")
        .otherwise("low")
    )
