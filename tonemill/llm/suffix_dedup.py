"""Removal of repeated passages by a common-prefix-aware distributed merge sort
of suffixes.

A byte is removed if a string of ``length`` bytes that covers it also starts at
any other place of any text. Every such string holds the smallest byte-window
hash of its first ``window`` bytes at one place, its *anchor*; equal strings have
their anchors at equal distance, and consecutive strings share anchors. So:

1. Each distinct text gives its anchors with the run of starts they stand for
   and a hash of the ``length - window + 1`` bytes after the anchor, which all
   those strings contain. Anchors whose hash stands at one place only are done
   with (the duplicate detection step of prefix-doubling string sorting).
2. For the others, each task sorts its suffixes (the bytes from the anchor to the
   end of the last string) into a run, front-codes it (length of the prefix
   shared with the predecessor, then the rest) and cuts it at sampled
   splitters, which are as long as what strings of one anchor agree in. Where more
   ranges are needed than splitters are sampled (``SAMPLE``), each range is dealt
   further by a hash of these bytes, so ranges do not grow with the corpus. The bytes before the anchor travel along. Equal suffixes within
   a run are kept once and settled on the spot, so a passage that a third of all
   texts share costs one entry per run.
3. Each range merges its runs with a loser tree that keeps the common-prefix
   length of each contender with the last output: contenders with different
   lengths are ordered without looking at the strings, equal ones are compared
   only beyond it. The output's common prefixes show which suffixes agree far
   enough; their strings are counted start by start.
   Anchors whose hash stands at over ``HOT_PLACES`` places (near copies by the
   hundred thousand) are not merged in one range: their strings are counted
   over the whole cluster, by hash.
4. The repeated starts go back to the texts, whose bytes are cut there.

Texts are told apart by two 64-bit hashes; a text that occurs twice is repeated
whole (if it has ``length`` bytes) and takes part once. Text travels compressed.

Defined cases: null and empty texts have no bytes; matches never cross texts;
repeated rows are copies of each other; a text shorter than ``length`` loses
nothing; other columns pass through ``strip_repeats`` unchanged.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tonemill.llm.ragged import SLICE_BYTES, chunks, flat, in_batches, mix, released, slices, spans, word_hashes, written

LENGTH = 400
GRAM = 8
PLACE_BITS = 28
SEGMENT = 1 << 20
MAX_LENGTH = 4096  # distances from an anchor are packed in 12 bits
SAMPLE = 20_000
RUN_BYTES = 24 << 20
RANGE_BYTES = 16 << 20
HOT_PLACES = 100_000
PLACE = np.uint64((1 << PLACE_BITS) - 1)


def window_of(length: int) -> int:
    """Bytes in which an anchor is sought: the more, the fewer anchors, the
    fewer, the longer the string that the duplicate detection sees."""
    if not 2 * GRAM <= length <= MAX_LENGTH:
        raise ValueError(f"length must be {2 * GRAM} to {MAX_LENGTH}")
    return min(length * 3 // 4, length - GRAM + 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, place in the chunk, and largest and smallest distance from a
    start it stands for (``back`` >= ``fore``), of each anchor."""
    window, n = window_of(length), len(data)
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    starts = spans(offsets[:-1], counts)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    padded = np.concatenate([data, np.zeros(GRAM, np.uint8)])
    grams = np.ndarray((n,), "<u8", buffer=padded, strides=(1,)).copy()
    h = grams * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    least = (h & ~PLACE) | np.arange(n, dtype=np.uint64)  # ties: the leftmost
    span = 1
    while span * 2 <= window:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < window:
        least = np.minimum(least[:len(least) - (window - span)], least[window - span:])
    at = (least[starts] & PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    place = at[first]
    return np.repeat(np.arange(len(counts)), counts)[first], place, place - starts[first], place - starts[last]


def segments(offsets: np.ndarray, length: int):
    """(first text, last text, begin, end) of what is worked on at a time: runs of
    whole texts, and of a text over SEGMENT bytes parts that each hold SEGMENT
    starts and the strings from there on."""
    for a, b in chunks(offsets):
        begin, end = int(offsets[a]), int(offsets[b])
        if end - begin <= 2 * SEGMENT or b - a > 1:
            yield a, b, begin, end
        else:
            for at in range(begin, end - length + 1, SEGMENT):
                yield a, b, at, min(at + SEGMENT + length - 1, end)


def keyed(df: DataFrame, text_col: str) -> DataFrame:
    """Add the two hashes that stand for a text (null is the empty text)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit("second"), text)})


def anchor_table(texts: DataFrame, length: int) -> DataFrame:
    """Rows (h, k1, k2, place, head) of all anchors of (k1, k2, text); ``place``
    packs anchor, back and fore; ``head`` is set on a sample."""
    core = length - window_of(length) + 1

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            k1, k2 = (np.asarray(batch.column(c)) for c in ("k1", "k2"))
            fresh = [i for i, k in enumerate(zip(k1.tolist(), k2.tolist())) if not (k in seen or seen.add(k))]
            if len(fresh) < batch.num_rows:
                batch, k1, k2 = batch.take(pa.array(fresh, pa.int64())), k1[fresh], k2[fresh]
            data, offsets = flat(batch.column("text"))
            for a, b, begin, end in segments(offsets, length):
                part, at = data[begin:end], np.clip(offsets[a:b + 1], begin, end) - begin
                doc, place, back, fore = anchors(part, at, length)
                if not len(doc):
                    continue
                h = word_hashes(part, place, np.full(len(place), core))
                sampled = np.flatnonzero(h % np.uint64(16) == 0)
                heads = [None] * len(h)
                for i in sampled.tolist():
                    heads[i] = part[place[i]:place[i] + core].tobytes()
                packed = (place + begin - offsets[a:b][doc]) << 24 | back << 12 | fore
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k1[a:b][doc]), pa.array(k2[a:b][doc]), pa.array(packed), pa.array(heads, pa.binary())], names=["h", "k1", "k2", "place", "head"])

    return in_batches(texts.select("k1", "k2", "text"), run, "h long, k1 long, k2 long, place long, head binary")


def squeezed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unsqueezed(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def pack(texts: DataFrame) -> DataFrame:
    """Compress column ``text`` into ``packed`` for its way through a shuffle."""
    fields = [f for f in texts.schema.fields if f.name != "text"]
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            raw = [squeezed(data[s:e].tobytes()) for s, e in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(raw, pa.binary())], names=names + ["packed"])

    return in_batches(texts, run, StructType(fields + [StructField("packed", BinaryType())]))


# A run: sorted, front-coded suffixes of one task ---------------------------


def shared_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of ``a`` and ``b``, known to be ``start`` at least."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    x = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - (x.bit_length() + 7) // 8


def encode_run(items: list[tuple[bytes, bytes, int, int, int]]) -> bytes:
    """Front-code sorted items (suffix, bytes before, k1, k2, anchor or -1)."""
    lcp, rest, last = [], [], b""
    for suffix, *_ in items:
        k = shared_prefix(last, suffix)
        lcp.append(k)
        rest.append(suffix[k:])
        last = suffix
    numbers = np.array([lcp, [len(r) for r in rest], [len(i[1]) for i in items], [i[2] for i in items], [i[3] for i in items], [i[4] for i in items]], "<i8")
    raw = len(items).to_bytes(8, "little") + numbers.tobytes() + b"".join(rest) + b"".join(i[1] for i in items)
    return squeezed(raw)


class Run:
    """Reads a front-coded run item by item."""

    def __init__(self, payload: bytes):
        raw = unsqueezed(payload)
        n = int.from_bytes(raw[:8], "little")
        self.numbers = np.frombuffer(raw[8:8 + 48 * n], "<i8").reshape(6, n)
        self.lcps, self.rests, self.backs, self.k1, self.k2, self.anchor = self.numbers.tolist()
        self.raw, self.at, self.back_at = raw, 8 + 48 * n, 8 + 48 * n + sum(self.rests)
        self.n, self.i, self.suffix = n, -1, b""

    def advance(self) -> int:
        """Go to the next item; its common prefix with the one before, -1 at the end."""
        self.i += 1
        if self.i == self.n:
            self.suffix = None
            return -1
        k, r = self.lcps[self.i], self.rests[self.i]
        self.suffix = self.suffix[:k] + self.raw[self.at:self.at + r]
        self.at += r
        return k

    def item(self) -> tuple[bytes, bytes, int, int, int]:
        b, i = self.backs[self.i], self.i
        before = self.raw[self.back_at:self.back_at + b]
        self.back_at += b
        return self.suffix, before, self.k1[i], self.k2[i], self.anchor[i]


def merge(payloads: list[bytes]):
    """Merge runs with a loser tree: yields (common prefix with the item before,
    item). No byte within a known common prefix is compared again."""
    runs = [Run(p) for p in payloads]
    k = len(runs)
    lcp = [r.advance() for r in runs]
    lcp = [0 if x >= 0 else -1 for x in lcp]  # against the empty string before the first output

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; both lengths refer to the same last output."""
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        if lcp[a] < 0:
            return a, b
        x, y = runs[a].suffix, runs[b].suffix
        m = shared_prefix(x, y, lcp[a])
        smaller = m == len(x) or m < len(y) and x[m] < y[m]
        winner, loser = (a, b) if smaller else (b, a)
        lcp[loser] = m
        return winner, loser

    losers = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while runs[winner].suffix is not None:
        yield lcp[winner], runs[winner].item()
        lcp[winner] = runs[winner].advance()
        node = (winner + k) >> 1
        while node:
            winner, losers[node] = play(winner, losers[node])
            node >>= 1


def repeated_starts(items, length: int, core: int):
    """(k1, k2, first start, last start) of every run of repeated starts of the
    merged items."""
    group: list = []

    def settle():
        out, batch, size = [], [], 0
        for g in groups:
            batch.append(g)
            size += sum(len(i[0]) + len(i[1]) for _, i in g)
            if size > 1 << 20:
                out += count_starts(batch, length)
                batch, size = [], 0
        return out + (count_starts(batch, length) if batch else [])

    groups, held = [], 0
    for lcp, item in items:
        if group and lcp < core:
            if len(group) > 1:
                groups.append(group)
                held += sum(len(i[0]) + len(i[1]) for _, i in group)
            group = []
            if held > 4 << 20:
                yield from settle()
                groups, held = [], 0
        group.append((lcp, item))
    if len(group) > 1:
        groups.append(group)
    yield from settle()


def count_starts(groups: list, length: int) -> list[tuple[int, int, int, int]]:
    """Count every start of the items of these groups within its group. A start
    is looked at only if its string ends within the longest prefix that the
    item shares with a neighbour of the sorted order."""
    blobs, first, many, owner, rows = [], [], [], [], []
    at = 0
    for g, members in enumerate(groups):
        after = [lcp for lcp, _ in members[1:]] + [0]
        for k, (lcp, item) in enumerate(members):
            suffix, before = item[0], item[1]
            reach = max(lcp if k else 0, after[k])
            n = min(len(before) + len(suffix) - length + 1, len(before) - length + reach + 1)
            blobs += [before, suffix]
            if n > 0:
                first.append(at)
                many.append(n)
                owner.append(g)
                rows.append(item)
            at += len(before) + len(suffix)
    if not rows:
        return []
    data, many = np.frombuffer(b"".join(blobs), np.uint8), np.array(many)
    starts = spans(np.array(first), many)
    keys = word_hashes(data, starts, np.full(len(starts), length)) ^ mix(np.repeat(np.array(owner, np.uint64), many) + np.uint64(1))
    _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
    twice = times[inverse] > 1
    of = np.repeat(np.arange(len(many)), many)
    new = np.ones(len(twice), bool)
    new[1:] = (of[1:] != of[:-1]) | ~twice[:-1]
    begins = np.flatnonzero(twice & new)
    stop = np.ones(len(twice), bool)
    stop[:-1] = (of[1:] != of[:-1]) | ~twice[1:]
    ends = np.flatnonzero(twice & stop)
    base = np.cumsum(many) - many
    out = []
    for s, e in zip(begins.tolist(), ends.tolist()):
        _, before, k1, k2, anchor = rows[of[s]]
        if anchor >= 0:
            low = anchor - len(before) - int(base[of[s]])
            out.append((k1, k2, low + s, low + e))
    return out


# The distributed steps -----------------------------------------------------

RUNS = "range long, payload binary, settled binary"


def build_runs(texts: DataFrame, splitters: list[bytes], parts_of_range: int, length: int) -> DataFrame:
    """Per task: sorted front-coded runs cut at the splitters (range, payload),
    each range dealt to ``parts_of_range`` by a hash of what its suffixes agree
    in; starts that are settled within a run go along under negative ranges,
    dealt by run, as packed (k1, k2, low, high)."""

    head = length - window_of(length) + 1  # suffixes that agree so far must share a range

    def flush(items: list) -> pa.RecordBatch:
        items.sort(key=lambda i: (i[0], i[1]))
        kept, settled, i = [], [], 0
        while i < len(items):
            j = i + 1
            while j < len(items) and items[j][:2] == items[i][:2]:
                j += 1
            suffix, before, k1, k2, anchor = items[i]
            if j - i > 1:
                n = len(before) + len(suffix) - length
                settled += [(x[2], x[3], x[4] - len(before), x[4] - len(before) + n) for x in items[i:j]]
                kept.append((suffix, before, 0, 0, -1))
            else:
                kept.append(items[i])
            i = j
        parts, i = [], 0
        ranges = [bisect_right(splitters, k[0][:head]) for k in kept]
        while i < len(kept):
            j = bisect_right(ranges, ranges[i])
            dealt = {}
            for k in kept[i:j]:
                dealt.setdefault(zlib.crc32(k[0][:head]) % parts_of_range, []).append(k)
            parts += [(ranges[i] * parts_of_range + d, encode_run(run)) for d, run in dealt.items()]
            i = j
        rows = [(r, payload, None) for r, payload in parts]
        if settled:
            deal = -1 - int(mix(np.array([settled[0][0]]).view(np.uint64))[0] % np.uint64(len(splitters) + 1))
            rows.append((deal, None, squeezed(np.array(settled, "<i8").tobytes())))
        kinds = [pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["range", "payload", "settled"])

    def run(batches):
        seen, items, size = set(), [], 0
        for batch in batches:
            for k1, k2, packed, places in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "packed", "places"))):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                text = unsqueezed(packed)
                for place in places:
                    anchor, back, fore = place >> 24, place >> 12 & 4095, place & 4095
                    items.append((text[anchor:anchor - fore + length], text[anchor - back:anchor], k1, k2, anchor))
                    size += length + back - fore
                if size > RUN_BYTES:
                    yield flush(items)
                    items, size = [], 0
        if items:
            yield flush(items)

    return in_batches(texts, run, RUNS)


def repeats(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, low, high): all starts ``low`` to ``high`` of the text repeat.
    ``texts`` has k1, k2, text."""
    spark, core = texts.sparkSession, length - window_of(length) + 1
    long = texts.where(F.octet_length("text") >= length)
    table = anchor_table(long, length)
    place = F.xxhash64("k1", "k2", "place")
    twice = table.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b"), (F.count(F.lit(1)) > HOT_PLACES).alias("hot")).where("a <> b").select("h", "hot")
    # Written, so that both join sides come straight from an exchange: only then can Spark split a hot hash.
    twice = written(twice, "repeated_hashes")
    found = table.join(twice, "h")
    cool = F.when(~F.col("hot"), F.col("place"))
    places = found.groupBy("k1", "k2").agg(F.collect_set(cool).alias("places"), F.collect_set(F.when(F.col("hot"), F.col("place"))).alias("hot"), F.collect_set(F.when(~F.col("hot"), F.col("head"))).alias("heads"))
    places = written(places, "anchors")
    released(spark)
    total = places.agg(F.sum(F.size("places"))).first()[0] or 0
    heads = places.select(F.explode("heads").alias("head")).distinct()
    sample = sorted(bytes(r.head) for r in heads.orderBy(F.xxhash64("head"), "head").limit(SAMPLE).collect())  # bounded by SAMPLE
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total * 2 * length // RANGE_BYTES)
    splitters = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []
    parts_of_range = -(-ranges // (len(splitters) + 1))  # one, until there are more ranges than sampled heads
    packed = pack(long.select("k1", "k2", "text")).hint("merge")  # neither side has a size bound
    joined = packed.join(places.where(F.size("places") > 0).select("k1", "k2", "places"), ["k1", "k2"])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["range"].iloc[0] < 0:
            rows = np.concatenate([np.frombuffer(unsqueezed(p), "<i8").reshape(-1, 4) for p in pdf["settled"]])
        else:
            rows = list(repeated_starts(merge([bytes(p) for p in pdf["payload"]]), length, core))
        return pd.DataFrame(rows, columns=["k1", "k2", "low", "high"])

    out = build_runs(joined, splitters, parts_of_range, length).groupBy("range").applyInPandas(settle, "k1 long, k2 long, low long, high long")
    if twice.where("hot").limit(1).count():
        hot = packed.join(places.where(F.size("hot") > 0).select("k1", "k2", F.col("hot").alias("places")), ["k1", "k2"])
        out = out.union(hot_repeats(hot, length))
    return out


def hot_repeats(texts: DataFrame, length: int) -> DataFrame:
    """Repeated starts of anchors whose hash stands at more than HOT_PLACES
    places, more than one range should hold: their starts are spread over the
    cluster by the hashes of their strings instead of being merged in one task.
    ``texts`` has k1, k2, packed, places."""
    core = length - window_of(length) + 1

    def starts(batches):
        for batch in slices(batches, 1 << 18):
            for k1, k2, packed, places in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "packed", "places"))):
                data, place = np.frombuffer(unsqueezed(packed), np.uint8), np.array(places, np.int64)
                anchor, back, fore = place >> 24, place >> 12 & 4095, place & 4095
                many = back - fore + 1
                at = spans(anchor - back, many)
                group = np.repeat(word_hashes(data, anchor, np.full(len(anchor), core)), many)
                s = word_hashes(data, at, np.full(len(at), length))
                columns = [pa.array(c.view(np.int64)) for c in (group, s)] + [pa.array(np.full(len(at), k, np.int64)) for k in (k1, k2)] + [pa.array(at)]
                yield pa.RecordBatch.from_arrays(columns, names=["core", "s", "k1", "k2", "at"])

    rows = in_batches(texts, starts, "core long, s long, k1 long, k2 long, at long")
    own = F.xxhash64("k1", "k2", "at")
    twice = rows.groupBy("core", "s").agg(F.min(own).alias("a"), F.max(own).alias("b")).where("a <> b").select("core", "s")
    found = rows.join(written(twice, "repeated_starts"), ["core", "s"], "left_semi")
    return found.select("k1", "k2", F.col("at").alias("low"), F.col("at").alias("high"))


def cut(raw: bytes, lows: list[int], highs: list[int], length: int, whole: bool, least_words: int = 0) -> tuple[list[bytes], int, int]:
    """Remaining pieces, removed bytes and removed runs of one text; runs of fewer
    than ``least_words`` words (parts of words count) stay."""
    if whole:
        lows, highs = [0], [len(raw) - length]
    if not lows:
        return [raw], 0, 0
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, lows, 1)
    np.add.at(edge, np.asarray(highs) + length, -1)
    gone = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0)
    runs = [(s, e) for s, e in zip(np.flatnonzero(gone > 0).tolist(), np.flatnonzero(gone < 0).tolist()) if not least_words or len(raw[s:e].split()) >= least_words]
    edges = [0, *(x for run in runs for x in run), len(raw)]
    return [raw[s:e] for s, e in zip(edges[::2], edges[1::2])], sum(e - s for s, e in runs), len(runs)


def strip_repeats(df: DataFrame, text_col: str = "text", length: int = LENGTH, least_words: int = 0, without: tuple[str, ...] = ()) -> DataFrame:
    """All columns of ``df`` and ``kept`` (binary: the remaining bytes),
    ``kept_text`` (their text, without characters that lost a byte),
    ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``; columns of these
    names are replaced. Repeated runs of fewer than ``least_words`` words stay.
    Columns named in ``without`` are not built: each of the text, ``kept`` and
    ``kept_text`` is as large as the texts, and Spark cannot leave out what a
    Python step returns."""
    new = {"kept": "binary", "kept_text": "string", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}
    carried = [f for f in df.schema.fields if f.name.lower() not in new and f.name not in without]
    rows = keyed(df.select(F.struct(*[F.col(f"`{f.name}`") for f in carried if f.name != text_col]).alias("row"), F.col(text_col).alias("text")), "text")
    starts = repeats(rows.select("k1", "k2", "text"), length)
    copies = rows.where(F.octet_length("text") >= length).groupBy("k1", "k2").count().where("count > 1").select("k1", "k2", F.lit(True).alias("whole"))
    lists = starts.groupBy("k1", "k2").agg(F.collect_set(F.struct("low", "high")).alias("starts"))
    fate = written(lists.join(copies, ["k1", "k2"], "full"), "fate")  # written: a text with very many copies can then be split
    released(df.sparkSession)
    joined = pack(rows).hint("merge").join(fate, ["k1", "k2"], "left").select("row", "packed", F.col("starts.low").alias("low"), F.col("starts.high").alias("high"), "whole")
    row_type = joined.schema["row"]
    built = {"original": "binary", **new}
    built = {n: t for n, t in built.items() if (text_col if n == "original" else n) not in without}

    def run(batches):
        def as_batch(rows: pa.Array, out: list[dict]) -> pa.RecordBatch:
            arrays = [pa.array([o[n] for o in out], {"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}[t]) for n, t in built.items()]
            return pa.RecordBatch.from_arrays([rows, *arrays], names=["row", *built])

        for batch in batches:
            out, done, size = [], 0, 0
            for k, (packed_text, low, high, whole) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("packed", "low", "high", "whole")))):
                raw = unsqueezed(packed_text)
                left, removed, n_spans = cut(raw, low or [], high or [], length, bool(whole), least_words)
                kept = b"".join(left)
                row = {"n_bytes": len(raw), "n_removed": removed, "n_spans": n_spans, "kept_sha256": hashlib.sha256(kept).hexdigest()}
                if "original" in built:
                    row["original"] = raw
                if "kept" in built:
                    row["kept"] = kept
                if "kept_text" in built:
                    row["kept_text"] = "".join(x.decode("utf-8", "ignore") for x in left)
                out.append(row)
                size += len(raw)
                if size > SLICE_BYTES:  # the batch is as small as its compressed texts, what comes of it is not
                    yield as_batch(batch.column("row").slice(done, k + 1 - done), out)
                    out, done, size = [], k + 1, 0
            if out:
                yield as_batch(batch.column("row").slice(done), out)

    out = in_batches(joined, run, StructType([row_type] + [StructField(n, StructType.fromDDL(f"x {t}")[0].dataType) for n, t in built.items()]))
    return out.select(*[F.decode("original", "UTF-8").alias(text_col) if f.name == text_col else F.col(f"row.`{f.name}`") for f in carried], *[n for n in built if n != "original"])
