"""Token counts per section by offset-mapped attribution.

Each document is encoded once, whole. Its tokens' byte ends give character
spans; an interval join (binary search in the document's sorted section
bounds) maps every token to the sections its characters lie in. A token that
crosses a boundary is allocated by a stated rule:

* ``start``: to the section of its first character;
* ``majority``: to the section holding most of its characters, the earlier one
  on a tie (the default);
* ``each``: to every section it touches (sums then exceed the document's total).

A token shorter than a character (bytes of a wide character) has the span of
that character, as in the tokenizers library's offsets.

Sections come from a column ``array<struct<name, start, end>>`` of character
spans, sorted and not overlapping (half open); without one they are the lines
of the text, each with its newline. Characters outside all sections belong to
none: their tokens are counted in the document's ``n_tokens`` only.

Defined cases: a null or empty text has one line section ``0`` of no tokens;
null or empty section lists give no rows; a section that is null or has a null
bound keeps its row and name, with null bounds and counts, and takes no tokens;
lists that are unsorted or overlap are an error; tokens outside all sections
count for no section; other columns are not carried along, only the key is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tonemill.llm.bpe import EncoderSource, default_vocabulary
from tonemill.llm.ragged import chunks, flat, in_batches

RULES = ("start", "majority", "each")


def char_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character start and end of tokens that end at these bytes of ``data``."""
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    inside = np.zeros(len(starts), np.int64)
    if len(starts):
        inside = ((data[starts] & 0xC0) == 0x80).astype(np.int64)  # starts within a character: that character's start
    return chars[starts] - inside, chars[ends]


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section (sorted, disjoint bounds)."""
    n = np.zeros(len(starts), np.int64)
    crossing = np.zeros(len(starts), np.int64)
    if not len(starts) or not len(first):
        return n, crossing
    low = np.searchsorted(ends, first, "right")  # first section that ends after the token starts
    high = np.searchsorted(starts, last, "left") - 1  # last section that starts before the token ends
    touches = (low <= high) & (low < len(starts))
    single = touches & (low == high)
    plain = single & (starts[np.minimum(low, len(starts) - 1)] <= first) & (last <= ends[np.minimum(low, len(starts) - 1)])
    n += np.bincount(low[plain], minlength=len(starts))
    for t in np.flatnonzero(touches & ~plain):
        held = np.arange(low[t], high[t] + 1)
        share = np.minimum(ends[held], last[t]) - np.maximum(starts[held], first[t])
        held, share = held[share > 0], share[share > 0]
        if rule == "each":
            chosen = held
        elif rule == "majority":
            outside = last[t] - first[t] - share.sum()
            chosen = held[[share.argmax()]] if len(held) and share.max() >= outside else held[:0]
        else:
            chosen = held[(starts[held] <= first[t]) & (first[t] < ends[held])]
        n[chosen] += 1
        crossing[chosen] += 1
    return n, crossing


def count_tokens(df: DataFrame, key: str = "doc_id", text_col: str = "text", sections: str | None = None, rule: str = "majority", vocabulary: str | None = None) -> DataFrame:
    """One row per section: the key, ``section`` (its place in the document),
    ``name`` if sections are given, ``start_char``, ``end_char``, ``n_tokens``,
    ``n_crossing`` (of those, tokens shared with a neighbour) and ``doc_tokens``."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    source = EncoderSource(df.sparkSession, vocabulary or default_vocabulary())
    names = ["section", "start_char", "end_char", "n_tokens", "n_crossing"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    lists = pa.list_(pa.struct(list(zip(names, kinds))))
    chosen = [F.col(key).alias("key"), F.col(text_col).alias("text")]
    if sections:
        spans = F.transform(sections, lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")))
        chosen += [F.col(sections).alias("sections"), F.coalesce(spans, F.array()).alias("bounds")]

    def run(batches):
        encoder = source.get()
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            rows, sizes, totals, missing = [], [], [], []
            for a, b in chunks(offsets):
                part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                ids, count = encoder.encode(part, at)
                ends = np.cumsum(encoder.v.lengths[ids])
                last = np.cumsum(count)
                for i, (s, e) in enumerate(zip(last - count, last)):
                    text = part[at[i]:at[i + 1]]
                    first, final = char_spans(text, ends[s:e] - at[i])
                    starts, stops, known = bounds(batch, a + i, text, sections)
                    n, crossing = attribute(first, final, starts[known], stops[known], rule)
                    rows.append((np.arange(len(known)), starts[known], stops[known], n, crossing))
                    missing.append(~known)
                    sizes.append(len(known))
                totals.append(count)
            values = filled(rows, missing, kinds)
            parts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.StructArray.from_arrays(values, names=names)).cast(lists)
            total = pa.array(np.concatenate(totals) if totals else [], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in batch.schema.names if c not in ("text", "bounds")] + [total, parts], names=[c for c in batch.schema.names if c not in ("text", "bounds")] + ["doc_tokens", "parts"])

    picked = df.select(*chosen)
    struct = StructType([StructField(n, IntegerType() if n == "section" else LongType()) for n in names])
    carried = [f for f in picked.schema.fields if f.name not in ("text", "bounds")]
    counted = in_batches(picked, run, StructType(carried + [StructField("doc_tokens", LongType()), StructField("parts", ArrayType(struct))]))
    out = counted.select(*[f.name for f in carried], "doc_tokens", F.inline("parts"))
    name = [F.get("sections", F.col("section"))["name"].alias("name")] if sections else []
    return out.select(F.col("key").alias(key), "section", *name, "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens")


def filled(rows: list[tuple], missing: list[np.ndarray], kinds: list) -> list[pa.Array]:
    """The columns of all sections: places, then values that are null where a
    section is ``missing``."""
    gone = np.concatenate(missing) if missing else np.zeros(0, bool)
    out = [pa.array(np.concatenate([r[0] for r in rows]) if rows else [], kinds[0])]
    for k, kind in enumerate(kinds[1:], 1):
        values = np.zeros(len(gone), np.int64)
        values[~gone] = np.concatenate([r[k] for r in rows]) if rows else []
        out.append(pa.array(values, kind, mask=gone))
    return out


def bounds(batch: pa.RecordBatch, row: int, text: np.ndarray, sections: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Section bounds of one document, in characters, and whether both are known."""
    if not sections:
        lead = np.flatnonzero((text & 0xC0) != 0x80)
        ends = np.flatnonzero(text[lead] == 10) + 1
        if not len(ends) or ends[-1] < len(lead):
            ends = np.append(ends, len(lead))
        return np.concatenate([[0], ends[:-1]]), ends, np.ones(len(ends), bool)
    spans = [s if s and s["start"] is not None and s["end"] is not None else None for s in batch.column("bounds")[row].as_py()]
    known = np.array([s is not None for s in spans], bool)
    starts, ends = (np.array([s[k] if s else 0 for s in spans], np.int64) for k in ("start", "end"))
    if (starts[known] > ends[known]).any() or (starts[known][1:] < ends[known][:-1]).any():
        raise ValueError("sections must be sorted and must not overlap")
    return starts, ends, known
