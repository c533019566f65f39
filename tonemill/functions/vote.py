"""Majority vote over labeler results in one row (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The unanimity bonus and its cap.
UNANIMOUS_BONUS = 0.1
UNANIMOUS_CAP = 0.98


def ensemble_vote(*results: Column) -> Column:
    """Vote over ``struct<label, confidence>`` results given in model order.

    The most frequent label wins; a tie goes to the label seen first. The
    confidence is the mean confidence of the winning votes (summed in model
    order), plus 0.1 capped at 0.98 when all votes agree. A null result or label
    is no vote; without any vote label and confidence are null.
    """
    if not results:
        raise ValueError("a vote needs at least one result")
    labels = [r.getField("label") for r in results]
    confs = [r.getField("confidence") for r in results]
    same = lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int")
    shares = [sum((same(other, lab) for other in labels[1:]), same(labels[0], lab)) for lab in labels]
    most = F.greatest(*shares) if len(shares) > 1 else shares[0]
    winner = F.coalesce(*[F.when((n == most) & lab.isNotNull(), lab) for n, lab in zip(shares, labels)])
    unanimous = most == sum((lab.isNotNull().cast("int") for lab in labels[1:]), labels[0].isNotNull().cast("int"))
    total, count = F.lit(0.0), F.lit(0)
    for lab, conf in zip(labels, confs):
        hit = F.coalesce(lab == winner, F.lit(False))
        total = total + F.when(hit, conf).otherwise(F.lit(0.0))
        count = count + hit.cast("int")
    mean = F.when(count > 0, total / F.when(count > 0, count))
    confidence = F.when(unanimous & mean.isNotNull(), F.least(mean + F.lit(UNANIMOUS_BONUS), F.lit(UNANIMOUS_CAP))).otherwise(mean)
    return F.struct(winner.alias("label"), confidence.alias("confidence"))
