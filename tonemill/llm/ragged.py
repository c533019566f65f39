"""Arrow string columns as flat byte arrays with offsets, and the small
vectorised helpers the operators share.

A batch of texts is one ``uint8`` array plus ``offsets`` (document ``i`` is
``data[offsets[i]:offsets[i + 1]]``); no Python string is built per document.
Nulls are empty texts. ``chunks`` cuts a batch into runs of whole documents of
about a million bytes, so working arrays stay small whatever the batch holds
(a single longer document is a chunk of its own).
"""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tonemill.session import checkpoint_dir, scratch_path

CHUNK_BYTES = 1 << 20
SLICE_BYTES = 4 << 20
ARROW_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table, as it lies in the folder (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends
    there, so a lost executor costs no recomputation of what led to it."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written:
    they go once the driver's garbage, which still names them, is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def train_rows(key, folds: int, held: int):
    """Column: true for rows to learn from (crc32 of the key's text, modulo)."""
    return F.crc32(key.cast("string").cast("binary")) % folds != held


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary Arrow array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def slices(batches, size: int = SLICE_BYTES):
    """Arrow batches cut into batches of about ``size`` bytes (one row at
    least): what a task holds at a time follows this, not the batch's rows."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * size // max(batch.nbytes, 1)))
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def in_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` in small batches: on their way to Python they are capped
    at ``ARROW_BYTES`` (a session that sets less keeps its value), ``run`` gets
    slices of them, and a task that ends gives freed memory back, since idle
    workers are kept for the next task."""
    conf = df.sparkSession.conf
    number, unit = re.match(r"(-?\d+)([kmgt]?)", conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower()).groups()
    if int(number) << 10 * " kmgt".index(unit or " ") > ARROW_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b")

    def task(batches):
        yield from run(slices(batches))
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError, TypeError):
            pass  # another C library: it keeps its memory

    return df.mapInArrow(task, schema)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every (start, length), end to end."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], new: dict[str, object]) -> DataFrame:
    """Add columns computed per Arrow batch (``new``: name -> Spark type).

    Existing columns of the same name (case aside, as Spark resolves them) are
    replaced, all others pass through."""
    names = {n.lower(): n for n in new}
    fields = [StructField(names[f.name.lower()], new[names[f.name.lower()]]) if f.name.lower() in names else f for f in df.schema.fields]
    seen = {f.name for f in fields}
    schema = StructType(fields + [StructField(n, t) for n, t in new.items() if n not in seen])
    keep = [f.name for f in df.schema.fields]
    order = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            columns = dict(zip([names.get(n.lower(), n) for n in keep], batch.columns)) | fn(batch)
            yield pa.RecordBatch.from_arrays([columns[n] for n in order], names=order)

    return in_batches(df, run, schema)


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte slices: polynomial over seeded byte codes, mixed.

    Equal slices have equal hashes at any position (prefix sums modulo 2^64,
    multiplied back by the inverse power of the start)."""
    n = len(data)
    up, down = _powers(n + 1)
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(_CODES[data] * up[:n], out=prefix[1:])
    h = (prefix[starts + lengths] - prefix[starts]) * down[starts]
    return mix(h + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (every input bit reaches every output bit)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_CODES = np.random.default_rng(20260801).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n``."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS[i] = np.multiply.accumulate(factors)
    return _POWERS
