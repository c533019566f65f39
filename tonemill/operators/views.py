"""Filters and positional access over a labeled table.

Spark tables have no row order, so positions are defined by an explicit key
order. :func:`positions` numbers the rows without moving them all to one task:
the table is stored once, its keys are range-partitioned and sorted, and each
partition's offset is the sum of the counts of the partitions before it (one
row per partition). :func:`page_by_cursor` needs no index at all.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemill.functions.report import HIGH, LOW_BELOW, VERY_HIGH
from tonemill.lexicon import LABELS
from tonemill.session import checkpointed

ROW_INDEX = "row_idx"
_ROW = "__tm_row"


def label_filter(labels: Iterable[str] = LABELS, min_confidence: float = 0.0,
                 label_col: str = "label", confidence_col: str = "confidence") -> Column:
    """Predicate: label in ``labels`` and confidence >= ``min_confidence``.
    An empty label set selects nothing."""
    labels = list(labels)
    if not 0 <= min_confidence <= 100:
        raise ValueError("min_confidence must be within 0..100")
    if not labels:
        return F.lit(False)
    return F.col(label_col).isin(labels) & (F.col(confidence_col) >= F.lit(float(min_confidence)))


def filter_labeled(df: DataFrame, labels: Iterable[str] = LABELS, min_confidence: float = 0.0,
                   label_col: str = "label", confidence_col: str = "confidence") -> DataFrame:
    return df.filter(label_filter(labels, min_confidence, label_col, confidence_col))


def high_confidence(df: DataFrame, threshold: float = HIGH, confidence_col: str = "confidence") -> DataFrame:
    return df.filter(F.col(confidence_col) >= F.lit(float(threshold)))


def very_high_confidence(df: DataFrame, threshold: float = VERY_HIGH, confidence_col: str = "confidence") -> DataFrame:
    return high_confidence(df, threshold, confidence_col)


def low_confidence(df: DataFrame, below: float = LOW_BELOW, confidence_col: str = "confidence") -> DataFrame:
    return df.filter(F.col(confidence_col) < F.lit(float(below)))


def positions(df: DataFrame, order_by: str | Sequence[str], index_col: str = ROW_INDEX,
              num_partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The stored table and its index ``(row id, index_col)``: dense 0-based
    positions in ``order_by`` order.

    The table is checkpointed first, so a labeler above it runs once per row;
    only keys and row ids are range-partitioned and sorted, into as many
    partitions as the table has (or ``num_partitions``). ``order_by`` should be
    unique; a per-row id breaks ties, so rows that share a (hot) key value
    spread over several ranges.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    stored = checkpointed(df.withColumn(_ROW, F.monotonically_increasing_id()))
    n = num_partitions or max(1, stored.rdd.getNumPartitions())
    order = [F.col(k) for k in keys] + [F.col(_ROW)]
    slim = stored.select(*keys, _ROW).repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered = checkpointed(slim.select(_ROW))
    pid, local = "__tm_pid", "__tm_local"
    tagged = ordered.withColumn(pid, F.spark_partition_id()).withColumn(
        local, F.monotonically_increasing_id() - F.shiftleft(F.col(pid).cast("long"), 33)
    )
    # One row per partition: bounded by the partition count, not the data.
    counts = tagged.groupBy(pid).agg(F.count(F.lit(1)).alias("__tm_n"))
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(pid, F.coalesce(F.sum("__tm_n").over(before), F.lit(0)).alias("__tm_off"))
    numbered = tagged.join(F.broadcast(offsets), pid, "inner")
    return stored, numbered.select(_ROW, (F.col("__tm_off") + F.col(local)).cast("long").alias(index_col))


def with_row_index(df: DataFrame, order_by: str | Sequence[str], index_col: str = ROW_INDEX,
                   num_partitions: int | None = None) -> DataFrame:
    """Attach a dense 0-based position in ``order_by`` order to every row."""
    stored, index = positions(df, order_by, index_col, num_partitions)
    return stored.join(index, _ROW).drop(_ROW)


def page_at(df: DataFrame, order_by: str | Sequence[str], offset: int, size: int, index_col: str = ROW_INDEX) -> DataFrame:
    """Rows at positions ``offset .. offset+size-1`` with their position: the
    page's row ids (``size`` at most) go to the stored table, which never moves."""
    stored, index = positions(df, order_by, index_col)
    return stored.join(F.broadcast(preview_page(index, offset, size, index_col)), _ROW).drop(_ROW)


def clamp_index(i: int, n: int) -> int:
    """Clamp a position to ``[0, n-1]`` (0 for an empty table)."""
    return 0 if n <= 0 else max(0, min(int(i), n - 1))


def navigate(current: int, action: str, n: int, target: int | None = None) -> int:
    """Next preview position for ``first``/``prev``/``next``/``last``/``jump``."""
    if action == "first":
        return clamp_index(0, n)
    if action == "prev":
        return clamp_index(current - 1, n)
    if action == "next":
        return clamp_index(current + 1, n)
    if action == "last":
        return clamp_index(n - 1, n)
    if action == "jump":
        if target is None:
            raise ValueError("jump needs a target")
        return clamp_index(target, n)
    raise ValueError(f"unknown action {action!r}")


def row_at(indexed: DataFrame, i: int, index_col: str = ROW_INDEX) -> DataFrame:
    """The row at position ``i`` of a table from :func:`with_row_index`,
    with ``position`` (1-based, for "sample i+1 of n")."""
    return indexed.filter(F.col(index_col) == F.lit(int(i))).withColumn("position", F.col(index_col) + 1)


def preview_page(indexed: DataFrame, offset: int, size: int, index_col: str = ROW_INDEX) -> DataFrame:
    """Rows at positions ``offset .. offset+size-1``."""
    if size < 0 or offset < 0:
        raise ValueError("offset and size must be >= 0")
    idx = F.col(index_col)
    return indexed.filter((idx >= F.lit(int(offset))) & (idx < F.lit(int(offset) + int(size))))


def head(df: DataFrame, order_by: str | Sequence[str], n: int = 5) -> DataFrame:
    """First ``n`` rows in key order (a bounded top-n, no full sort)."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*keys).limit(int(n))


def _beyond(keys: Sequence[str], cursor: Sequence, ahead: bool) -> Column:
    """Rows that come after (``ahead``) or before the cursor's key values, nulls first."""
    out, equal = F.lit(False), F.lit(True)
    for name, value in zip(keys, cursor):
        c, null = F.col(name), value is None
        if ahead:
            past = c.isNotNull() if null else F.coalesce(c > F.lit(value), F.lit(False))
        else:
            past = F.lit(False) if null else F.coalesce(c < F.lit(value), F.lit(True))
        out, equal = out | (equal & past), equal & c.eqNullSafe(F.lit(value))
    return out


def page_by_cursor(df: DataFrame, order_by: str | Sequence[str], cursor=None, size: int = 10,
                   direction: str = "next") -> DataFrame:
    """Keyset paging both ways over any keys, nulls first: the page after the
    cursor (``next``), before it (``previous``), or the ``first`` or ``last``
    page. ``cursor`` holds the key values of the current page's last row
    (``next``) or first row (``previous``); None starts from that end.

    A page has ``size`` rows, and those that share all keys with the last of
    them: whoever walks all pages sees each row once, repeated and null keys
    included. Two bounded top-n scans; no index, no full sort."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    if size < 0:
        raise ValueError("size must be >= 0")
    if direction not in ("first", "next", "previous", "last"):
        raise ValueError(f"unknown direction {direction!r}")
    ahead = direction in ("first", "next")
    at = None if direction in ("first", "last") or cursor is None else cursor if isinstance(cursor, (tuple, list)) else (cursor,)
    if at is not None and len(at) != len(keys):
        raise ValueError("the cursor needs one value for each key")
    rows = df if at is None else df.filter(_beyond(keys, at, ahead))
    up, down = [F.asc_nulls_first(k) for k in keys], [F.desc_nulls_last(k) for k in keys]
    edge = rows.select(*keys).orderBy(*(up if ahead else down)).limit(int(size)).orderBy(*(down if ahead else up)).first()
    if edge is None:
        return rows.limit(0)
    return rows.filter(~_beyond(keys, tuple(edge), ahead)).orderBy(*up)


def page_after(df: DataFrame, order_by: str | Sequence[str], last_key, size: int) -> DataFrame:
    """The page after ``last_key`` (``None`` for the first page, ``(None,)`` after
    a null key); see :func:`page_by_cursor`."""
    return page_by_cursor(df, order_by, last_key, size)
