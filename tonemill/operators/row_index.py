"""A position index that is kept: built once, then each lookup reads one folder.

:func:`build` numbers the rows of a table in key order (see
:func:`tonemill.operators.views.positions`) and writes them, with their positions, in
folders of consecutive positions, ``block=0``, ``block=1``, ... of equal size, so that
the folder of a position is a division. :class:`RowIndex` opens the result: a row
or a page is a pruned scan of the folders it lies in, with a filter on the position
that reaches the Parquet footers. No sort, no exchange, no checkpoint, no pass over
the table, however often and from however many sessions it is asked.

There are ``MAX_BLOCKS`` folders at most; their rows follow from that and from
``BLOCK_ROWS``. Rows move once, while the index is built, each block to one task.
Ties in the key get positions in the order the table was stored in. An empty
table has an index without rows; a column named as the position is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tonemill.operators.views import ROW_INDEX, clamp_index, with_row_index

BLOCK_ROWS = 100_000
MAX_BLOCKS = 10_000
_BLOCK = "__tm_block"


def build(df: DataFrame, order_by: str | Sequence[str], path: str, index_col: str = ROW_INDEX) -> RowIndex:
    """Write the index of ``df`` below ``path`` (which must not hold one) and open it."""
    spark = df.sparkSession
    indexed = with_row_index(df.drop(index_col), order_by, index_col)
    n = indexed.agg(F.max(index_col)).first()[0]
    n = 0 if n is None else n + 1
    size = max(BLOCK_ROWS, -(-n // MAX_BLOCKS))
    block = F.floor(F.col(index_col) / size).cast("int")
    blocks = max(1, -(-n // size))
    rows = indexed.withColumn(_BLOCK, block).repartitionByRange(blocks, _BLOCK).sortWithinPartitions(_BLOCK, index_col)
    rows.write.partitionBy(_BLOCK).parquet(f"{path}/rows")
    about = spark.createDataFrame([(n, size, index_col, indexed.schema.json())], "n long, size long, index_col string, fields string")
    about.coalesce(1).write.parquet(f"{path}/about")  # last: an index without it is not whole
    return RowIndex(spark, path)


class RowIndex:
    """An index written by :func:`build`."""

    def __init__(self, spark: SparkSession, path: str):
        about = spark.read.parquet(f"{path}/about").first()
        self.n, self.size, self.index_col = about["n"], about["size"], about["index_col"]
        schema = StructType.fromJson(json.loads(about["fields"]))
        self.columns = list(schema.names)
        self.rows = spark.read.schema(schema.add(_BLOCK, IntegerType())).parquet(f"{path}/rows")

    def page(self, offset: int, size: int) -> DataFrame:
        """Rows at positions ``offset .. offset+size-1``."""
        if size < 0 or offset < 0:
            raise ValueError("offset and size must be >= 0")
        first, last = offset // self.size, max(offset + size - 1, 0) // self.size
        at = F.col(self.index_col)
        found = self.rows.where(F.col(_BLOCK).between(first, last) & (at >= F.lit(offset)) & (at < F.lit(offset + size)))
        return found.select(*[F.col(f"`{c}`") for c in self.columns])

    def row_at(self, i: int) -> DataFrame:
        """The row at position ``i``, clamped to the table, with ``position`` from 1 on."""
        return self.page(clamp_index(i, self.n), 1).withColumn("position", F.col(self.index_col) + 1)
