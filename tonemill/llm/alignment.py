"""Cross-tokenizer alignment by pointer jumping.

Two tokenizers cut the same bytes (a space and the text): a byte-level BPE (A)
and a sentence-piece BPE with byte fallback (B). Every token points to the
farthest-right token of the other side that overlaps it, or to itself where
none ends later; a B token that ends with an A token points to that A token.
Doubling all successors at once (``succ[succ]``) until nothing changes brings
every token to the last A token of its component, which names the group: the
bytes between two places where tokens of both sides end. The two tokens that
end a group are linked.

Scale: encoding and alignment are one pass over the texts (Arrow batches). Each
row keeps its distinct links with how often they occur, so what is exchanged to
count an id pair over the corpus is pre-aggregated per text and per task. The
counts are joined back to the links as a table: broadcast up to
``BROADCAST_PAIRS`` counted pairs, else by a merge join whose hot partitions
Spark splits; the exploded links are summed per row before any exchange.

Memory of a task: a few hundred bytes for each byte of ``PIECE_BYTES``, since
texts are worked on in pieces, cut before a blank that follows a visible ASCII
character (both tokenizers start a word there). A run without such a place is
one piece. A row's own text, groups and links are held whole.

Defined cases: texts that are null, empty, no valid UTF-8, or whose tokens on
either side do not spell a space and the text (a text with U+2581, which B
reads as a blank) have no tokens: zeros, an empty ``groups`` and no links.
Strings of special tokens are plain text. Null and repeated keys are rows like
any others; an empty table gives an empty table; columns whose names clash with
the new ones are replaced.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tonemill.llm.bpe import Encoder, Vocabulary, default_vocabulary
from tonemill.llm.ragged import flat, map_batches, spans, written

PIECE_BYTES = 1 << 19
MAX_MODEL_BYTES = 64 << 20
CACHE_FRAGMENTS = 300_000
CACHE_BYTES = 32 << 20
BROADCAST_PAIRS = 1_000_000
BLANKS = re.compile(rb" +[^ ]*")
COMMA, BAR, SEMICOLON = (ord(c) for c in ",|;")
LINK = StructType([StructField("a", IntegerType()), StructField("b", IntegerType()), StructField("times", LongType())])
COLUMNS = {"n_a": LongType(), "n_b": LongType(), "n_groups": LongType(), "n_links": LongType(), "groups": StringType(), "links": ArrayType(LINK)}


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceEncoder:
    """Sentence-piece ids and the bytes they stand for.

    No piece goes from a visible character on to a blank, so a text splits at
    such places into fragments (blanks, then the rest up to the next blank)
    that are encoded on their own, each different one once. The encoder adds a
    blank of its own in front, hence a fragment is handed over without its
    first one."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece goes across the start of a word")
        raw = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.blank = pieces.index("▁")
        self.lengths = np.array([len(r) for r in raw], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.reset()

    def reset(self) -> None:
        self.at, self.held = {}, 0
        self.first, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (each starts with its added blank), end to end, and
        each one's count."""
        found = [BLANKS.findall(t) for t in texts]
        if len(self.at) > CACHE_FRAGMENTS or self.held > CACHE_BYTES:
            self.reset()
        new = list(set().union(*found).difference(self.at))
        if new:
            ids = self.model.encode([f[1:].decode("utf-8", "replace") for f in new], num_threads=1)
            ids = [i if f != b" " else [self.blank] for f, i in zip(new, ids)]
            count = np.array([len(i) for i in ids], np.int64)
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.ids = np.concatenate([self.ids, np.array([x for i in ids for x in i], np.int32)])
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self.held += sum(map(len, new))
        at = np.array([self.at[f] for text in found for f in text], np.int64)
        counts = self.count[at]
        total = np.concatenate([[0], np.cumsum(counts)])
        ends = np.cumsum([len(text) for text in found])
        return self.ids[spans(self.first[at], counts)], np.diff(total[np.concatenate([[0], ends])])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.lengths[ids]
        return self.bytes[spans(self.starts[ids], lengths)], lengths


def terminals(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Terminal token of every A token, then of every B token (an index into
    A), from the rising end places of the tokens of both sides, whose last end
    is the same."""
    n = len(a_end)
    over_a, over_b = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end)  # who covers my last byte
    succ = np.concatenate([np.where(b_end[over_a] > a_end, n + over_a, np.arange(n)), over_b])
    while True:
        farther = succ[succ]
        if np.array_equal(farther, succ):
            return succ
        succ = farther


class Aligner:
    """Both encoders and the decimal digits of every id; one per worker."""

    def __init__(self, vocabulary: str, pieces: bytes):
        vocabulary = Vocabulary(vocabulary)
        vocabulary.added = {}
        self.a, self.b = Encoder(vocabulary), PieceEncoder(pieces)
        digits = [str(i).encode() for i in range(max(len(self.a.v.lengths), len(self.b.lengths)))]
        self.n_digits = np.array([len(d) for d in digits], np.int64)
        self.digit_starts = np.cumsum(self.n_digits) - self.n_digits
        self.digits = np.frombuffer(b"".join(digits), np.uint8)

    def align(self, texts: list[bytes]) -> list[tuple | None]:
        """For each text (a blank in front): token counts of both sides, text of
        the groups with an end mark each, and distinct links (packed ids and how
        often); None where the tokens do not spell the text."""
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        data = np.frombuffer(b"".join(texts), np.uint8)
        sides = []
        right = np.ones(len(texts), bool)
        for ids, count, coder in ((*self.a.encode(data, offsets), self.a), (*self.b.encode(texts), self.b)):
            spelled, lengths = coder.decode(ids)
            if not np.array_equal(spelled, data):
                at = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(count)])]
                right &= np.array([spelled[at[k]:at[k + 1]].tobytes() == t for k, t in enumerate(texts)], bool)
            sides.append((ids, count, lengths))
        if not right.all():
            sides = [(ids[kept], np.where(right, count, 0), lengths[kept]) for ids, count, lengths in sides for kept in [np.repeat(right, count)]]
        (a, a_count, a_len), (b, b_count, b_len) = sides
        if not len(a):
            return [None] * len(texts)
        mark = terminals(np.cumsum(a_len), np.cumsum(b_len))
        mark_a, mark_b = mark[:len(a)], mark[len(a):]
        last_a = np.flatnonzero(np.append(mark_a[1:] != mark_a[:-1], True))
        last_b = np.flatnonzero(np.append(mark_b[1:] != mark_b[:-1], True))
        owner = np.repeat(np.arange(len(texts)), a_count)[last_a]
        groups = self.written_groups(a, b, last_a, last_b)
        pairs, times = np.unique(owner << 34 | a[last_a].astype(np.int64) << 17 | b[last_b], return_counts=True)
        edge = np.searchsorted(owner, np.arange(len(texts) + 1))
        pair_edge = np.searchsorted(pairs, np.arange(len(texts) + 1) << 34)
        pairs &= (1 << 34) - 1
        text, ends = groups
        at = np.concatenate([[0], ends])[edge]
        return [
            (a_count[k], b_count[k], edge[k + 1] - edge[k], text[at[k]:at[k + 1]], pairs[pair_edge[k]:pair_edge[k + 1]], times[pair_edge[k]:pair_edge[k + 1]]) if right[k] else None
            for k in range(len(texts))
        ]

    def written_groups(self, a, b, last_a, last_b) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3;`` as bytes, and the end of each group in it."""
        n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        end = np.cumsum(n_a + n_b)
        ids = np.empty(len(a) + len(b), np.int64)
        at_a, at_b = spans(end - n_a - n_b, n_a), spans(end - n_b, n_b)
        ids[at_a], ids[at_b] = a, b
        sign = np.full(len(ids), COMMA, np.uint8)
        sign[end - n_b - 1], sign[end - 1] = BAR, SEMICOLON
        size = self.n_digits[ids]
        ends = np.cumsum(size + 1)
        text = np.empty(ends[-1], np.uint8)
        text[ends - 1] = sign
        text[spans(ends - size - 1, size)] = self.digits[spans(self.digit_starts[ids], size)]
        return text, ends[end - 1]


def pieces_of(text: bytes) -> list[bytes]:
    """The text with its blank in front, cut where both tokenizers start a word."""
    text = b" " + text
    if len(text) <= 2 * PIECE_BYTES:
        return [text]
    raw = np.frombuffer(text, np.uint8)
    may = np.flatnonzero((raw[1:] == 0x20) & (raw[:-1] > 0x20) & (raw[:-1] < 0x7F)) + 1
    at = np.searchsorted(may, np.arange(PIECE_BYTES, len(text), PIECE_BYTES))
    cuts = [0, *np.unique(may[at[at < len(may)]]).tolist(), len(text)]
    return [text[s:e] for s, e in zip(cuts, cuts[1:])]


def joined(parts: list[tuple | None]) -> tuple:
    """One text's result from those of its pieces."""
    if not parts or any(p is None for p in parts):
        return 0, 0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(parts) == 1:
        n_a, n_b, n, text, pairs, times = parts[0]
        return n_a, n_b, n, text[:-1].tobytes(), pairs, times
    pairs, at = np.unique(np.concatenate([p[4] for p in parts]), return_inverse=True)
    times = np.zeros(len(pairs), np.int64)
    np.add.at(times, at, np.concatenate([p[5] for p in parts]))
    return *(sum(p[k] for p in parts) for k in range(3)), b"".join(p[3].tobytes() for p in parts)[:-1], pairs, times


_ALIGNERS: dict[tuple, Aligner] = {}


class AlignerSource:
    """Hands tasks an aligner: both files are broadcast once (their sizes are
    checked) and parsed once in each Python worker."""

    def __init__(self, spark, vocabulary: str, pieces: str):
        for path in (vocabulary, pieces):
            if os.path.getsize(path) > MAX_MODEL_BYTES:
                raise ValueError(f"vocabulary file over {MAX_MODEL_BYTES} bytes: {path}")
        with open(vocabulary, encoding="utf-8") as a, open(pieces, "rb") as b:
            self.files = spark.sparkContext.broadcast((a.read(), b.read()))
        self.key = tuple((p, os.path.getmtime(p)) for p in (vocabulary, pieces))

    def get(self) -> Aligner:
        if self.key not in _ALIGNERS:
            _ALIGNERS.clear()
            _ALIGNERS[self.key] = Aligner(*self.files.value)
        return _ALIGNERS[self.key]


def align(df: DataFrame, text_col: str = "text", vocabulary: str | None = None, pieces: str | None = None) -> DataFrame:
    """Add to every row ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``,
    ``groups`` (``a1,a2|b1;a3|b2,b3``: ids of both sides, group by group) and
    ``links`` (distinct linked ids and how often they are linked in the text)."""
    source = AlignerSource(df.sparkSession, vocabulary or default_vocabulary(), pieces or default_pieces())

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        aligner = source.get()
        data, offsets = flat(batch.column(text_col))
        raw, out, waiting, size = data.tobytes(), [], [], 0
        for row in range(batch.num_rows):
            text = raw[offsets[row]:offsets[row + 1]]
            waiting.append(pieces_of(text) if text else [])
            size += len(text)
            if size >= PIECE_BYTES:
                out += aligned(aligner, waiting)
                waiting, size = [], 0
        out += aligned(aligner, waiting)
        n_a, n_b, n_groups, groups, pairs, times = zip(*out) if out else ((),) * 6
        edges = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]), pa.int32())
        pairs, times = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (pairs, times))
        links = pa.StructArray.from_arrays([pa.array(pairs >> 17, pa.int32()), pa.array(pairs & 0x1FFFF, pa.int32()), pa.array(times)], ["a", "b", "times"])
        return {
            "n_a": pa.array(n_a, pa.int64()), "n_b": pa.array(n_b, pa.int64()), "n_groups": pa.array(n_groups, pa.int64()), "n_links": pa.array(n_groups, pa.int64()),
            "groups": pa.array(groups, pa.binary()).cast(pa.string()), "links": pa.ListArray.from_arrays(edges, links),
        }

    return map_batches(df, run, COLUMNS)


def aligned(aligner: Aligner, rows: list[list[bytes]]) -> list[tuple]:
    """Results of rows given as pieces: about ``PIECE_BYTES`` are worked on at a time."""
    results, todo, size = [], [], 0
    for piece in [p for row in rows for p in row]:
        todo.append(piece)
        size += len(piece)
        if size >= PIECE_BYTES:
            results += aligner.align(todo)
            todo, size = [], 0
    results += aligner.align(todo) if todo else []
    edges = np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(int)
    return [joined(results[s:e]) for s, e in zip(edges, edges[1:])]


def pair_counts(rows: DataFrame) -> DataFrame:
    """``a``, ``b``, ``n`` (how many links of all rows hold the pair) and
    ``best`` (no A id is linked more often with this B id). A window group holds
    one B id's partners: at most the other vocabulary."""
    from pyspark.sql import Window

    counts = rows.select(F.inline("links")).groupBy("a", "b").agg(F.sum("times").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def with_link_counts(rows: DataFrame, counts: DataFrame, keep: list[str]) -> DataFrame:
    """Per row (told apart by the ``keep`` columns) ``n_best`` and ``count_sum``:
    its links whose pair is the best of its B id, and its links' counts summed."""
    few = counts.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    counts = counts.select(F.col("a").alias("to_a"), F.col("b").alias("to_b"), "n", "best")
    links = rows.select(*keep, F.inline_outer("links"))
    if not few:
        links = links.hint("merge")
    met = links.join(F.broadcast(counts) if few else counts, (F.col("a") == F.col("to_a")) & (F.col("b") == F.col("to_b")), "left")
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0))
    return met.groupBy(*keep).agg(best.alias("n_best"), F.coalesce(F.sum(F.col("times") * F.col("n")), F.lit(0)).alias("count_sum"))


def alignment(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **files) -> DataFrame:
    """The whole alignment: per row of ``df`` its id, token, group and link
    counts, ``groups_sha256`` (empty without tokens), ``n_best`` and
    ``count_sum``. The rows' links are written to the shared folder once; the
    row number keeps rows with equal ids apart."""
    found = align(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), **files)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256")
    keep = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row"]
    rows = written(found.select("id", "n_a", "n_b", "n_groups", "n_links", digest, F.monotonically_increasing_id().alias("row"), "links"), "links")
    out = with_link_counts(rows, written(pair_counts(rows), "pairs"), keep)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
