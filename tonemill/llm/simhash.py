"""SimHash near-duplicate detection with multi-index hashing.

Fingerprints: A-Z are lower-cased, words are runs of anything but ASCII white
space, shingles are ``shingle`` words joined by one space (the whole sequence
if there are fewer), each hashed with XXH64, seed 42. A bit is set if more than
half of the shingles (repeats counted) have it; without words it is 0.

Links: two fingerprints at ``max_bits`` or fewer differing bits are linked.
The 64 bits are cut into segments; some segment of a linked pair differs in at
most ``max_bits // segments`` bits, so each distinct fingerprint enumerates
that small Hamming ball in every segment, fetches the matches of a table keyed
by (segment, value), and the whole distance of each match is verified.

Rows of one fingerprint are one class, so copies are never paired. The link
rows are at most the matching pairs of *distinct* fingerprints; components come
from star contraction in the shared folder.

Defined cases: null and empty texts have fingerprint 0 and are linked like any
other; repeated rows give repeated rows of the result; a null ``doc_id`` never
is a component's id unless all of its rows have none.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tonemill.llm.components import connected_components
from tonemill.llm.ragged import chunks, flat, map_batches, spans, written

SEED = 42


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with one space after each word, word starts in them
    (and, as a last entry, their length + 1), and word ranges per document."""
    upper = (data >= 65) & (data <= 90)
    lower = data + upper * np.uint8(32)
    solid = (lower != 32) & ((lower < 9) | (lower > 13))
    head = np.zeros(len(data) + 1, bool)
    head[offsets[:-1]] = True
    first = solid & (head[:-1] | ~np.concatenate([[False], solid[:-1]]))
    starts = np.flatnonzero(first)
    last = solid & (head[1:] | ~np.concatenate([solid[1:], [False]]))
    if len(data):
        last[-1] = solid[-1]
    lengths = np.flatnonzero(last) + 1 - starts
    at = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.full(int(at[-1]), 32, np.uint8)
    out[spans(at[:-1], lengths)] = lower[spans(starts, lengths)]
    return out, at, np.searchsorted(starts, offsets)


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """SimHash of each document of a chunk."""
    text, at, ranges = words(data, offsets)
    n_words = np.diff(ranges)
    n = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    first = spans(ranges[:-1], n)
    width = np.repeat(np.where(n_words >= shingle, shingle, n_words), n)
    raw, digest = text.tobytes(), xxhash.xxh64_intdigest
    hashes = np.array([digest(raw[s:e], SEED) for s, e in zip(at[first].tolist(), (at[first + width] - 1).tolist())], np.uint64)
    out = np.zeros(len(n), np.uint64)
    filled = np.flatnonzero(n)
    if len(filled):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ends = np.cumsum(n[filled])
        counts = np.add.reduceat(bits, ends - n[filled], axis=0, dtype=np.int64)
        packed = np.packbits(2 * counts > n[filled][:, None], axis=1, bitorder="little")
        out[filled] = np.ascontiguousarray(packed).view("<u8")[:, 0]
    return out


def with_fingerprint(df: DataFrame, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Add ``simhash`` (the 64 bits as a long)."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data, offsets = flat(batch.column(text_col))
        parts = [fingerprints(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], shingle) for a, b in chunks(offsets, 1 << 19)]
        out = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        return {"simhash": pa.array(out.view(np.int64), pa.int64())}

    return map_batches(df, run, {"simhash": LongType()})


def signed(bits: int) -> int:
    """The long with these 64 bits."""
    return bits - (1 << 64) if bits >> 63 else bits


def balls(max_bits: int, segments: int) -> list[tuple[int, int, int, list[int]]]:
    """For each segment: number, shift, width, and the masks of its ball."""
    out, shift = [], 0
    for k in range(segments):
        width = 64 // segments + (k < 64 % segments)
        masks = [signed(sum(1 << b for b in bits)) for r in range(max_bits // segments + 1) for bits in combinations(range(width), r)]
        out.append((k, shift, width, masks))
        shift += width
    return out


def links(prints: DataFrame, max_bits: int = 3, segments: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct values of column ``simhash`` at
    ``max_bits`` or fewer differing bits."""
    parts = balls(max_bits, segments)

    def value(shift, width):
        return F.shiftrightunsigned("simhash", shift).bitwiseAND(F.lit(signed((1 << width) - 1)).cast("long"))

    table = prints.select(F.col("simhash").alias("b"), F.explode(F.array(*[F.struct(F.lit(k).alias("segment"), value(shift, width).alias("value")) for k, shift, width, _ in parts])).alias("s"))
    probes = prints.select(F.col("simhash").alias("a"), F.explode(F.array(*[F.struct(F.lit(k).alias("segment"), value(shift, width).alias("value"), F.lit(k).alias("k")) for k, shift, width, _ in parts])).alias("s"))
    ball = F.array(*[F.array(*[F.lit(m).cast("long") for m in masks]) for *_, masks in parts])
    probes = probes.select("a", "s.segment", F.col("s.value").alias("centre"), F.explode(F.get(ball, F.col("s.k"))).alias("mask")).select("a", "segment", F.col("centre").bitwiseXOR(F.col("mask")).alias("value"))
    # A merge join by name: Spark takes an exploded side for as small as its source, and would broadcast it.
    found = probes.hint("merge").join(table.select("b", "s.segment", "s.value"), ["segment", "value"])
    return found.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3, segments: int = 2) -> DataFrame:
    """One row per document: key, ``simhash``, ``component_id`` (the smallest
    key that is reachable over links, the document's own included)."""
    slim = df.select(F.col(key).alias("doc_id"), F.col(text_col).alias("text"))
    docs = written(with_fingerprint(slim, "text", shingle).select("doc_id", "simhash"), "simhash")
    classes = written(docs.groupBy("simhash").agg(F.min("doc_id").alias("first_id")), "simhash_classes")
    roots = connected_components(links(classes, max_bits, segments)).select(F.col("a").alias("simhash"), F.col("b").alias("root"))
    rooted = classes.join(roots, "simhash", "left").withColumn("root", F.coalesce("root", "simhash"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.select("simhash", "root").join(smallest, "root").select("simhash", "component_id")
    named = written(named, "simhash_components")  # a plain exchange on both sides: Spark can split a fingerprint with very many rows
    return docs.join(named, "simhash").select(F.col("doc_id").alias(key), "simhash", "component_id")
