"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A byte pair that stands inside no vocabulary token can never be merged, so a
text may be cut there without changing its encoding. The same holds at the
starts of the tokenizer's words. Texts are cut at both kinds of places, every
distinct fragment is encoded once (merges of lowest rank first, all fragments
of a chunk side by side in numpy), and a document's ids are its fragments' ids
end to end. Distinct fragments stay in a bounded cache per Python worker.

The vocabulary file (``tokenizers`` JSON, byte-level BPE) is read on the driver
and broadcast; its size is checked against ``MAX_VOCAB_BYTES``.

Defined cases: a null or empty text has no ids and decodes to the empty text;
the added token's own string (``<|endoftext|>``) is that one token, as in the
library's default; columns whose names clash with the new ones are replaced.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType

from tonemill.llm.ragged import chunks, flat, map_batches, spans, word_hashes

MAX_VOCAB_BYTES = 64 << 20
CACHE_FRAGMENTS = 400_000
NEVER = np.int32(2**31 - 1)
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: visible
    Latin-1 characters for themselves, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Token bytes, merge ranks and the table of byte pairs that force a cut."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, letters = spec["model"], byte_alphabet()
        plain = {t: bytes(letters[c] for c in t) for t in model["vocab"]}
        size = 1 + max([*model["vocab"].values(), *(a["id"] for a in spec["added_tokens"])])
        self.tokens = [b""] * size
        for token, i in model["vocab"].items():
            self.tokens[i] = plain[token]
        self.added = {a["content"].encode(): a["id"] for a in spec["added_tokens"]}
        for content, i in self.added.items():
            self.tokens[i] = content
        self.byte_ids = np.zeros(256, np.int32)
        joined = np.ones(65536, bool)
        for token, i in model["vocab"].items():
            raw = plain[token]
            if len(raw) == 1:
                self.byte_ids[raw[0]] = i
            for a, b in zip(raw, raw[1:]):
                joined[a << 8 | b] = False
        self.forced = joined
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocab = model["vocab"]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs] or [-1], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs] or [0], np.int32)
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids; NEVER if there is no such merge."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)


def char_classes() -> np.ndarray:
    """Class of every code point as the word pattern sees it."""
    out = np.full(0x110000, OTHER, np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            a, b = ord(m.group()[0]), ord(m.group()[-1])
            out[a:b + 1] = kind
    out[0xD800:0xE000] = OTHER
    out[0x1C:0x20] = OTHER  # separators that only Python's \s takes for white space
    return out


class Encoder:
    """Encodes chunks of documents; one per Python worker and vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.classes = vocabulary, char_classes()
        self.reset()

    def reset(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def word_starts(self, data: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """Byte mask: a word of the pre-tokenizer starts here. ``breaks`` are
        byte places where no word goes across (document and added-token ends)."""
        n = len(data)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        code = data[lead].astype(np.int32)
        wide = np.flatnonzero(code >= 0x80)
        if len(wide):
            padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
            at, c = lead[wide], code[wide]
            b1, b2, b3 = (padded[at + k] & 0x3F for k in (1, 2, 3))
            code[wide] = np.where(c < 0xE0, (c & 0x1F) << 6 | b1, np.where(c < 0xF0, (c & 0xF) << 12 | b1 << 6 | b2, ((c & 7) << 18 | b1 << 12 | b2 << 6 | b3) & 0x1FFFFF))
            code[code >= 0x110000] = 0xFFFD
        m = len(code)
        kind = self.classes[code]
        head = np.zeros(m + 1, bool)  # no word goes across the place before this character
        head[np.searchsorted(lead, breaks)] = True
        head[0] = head[m] = True
        space = kind == SPACE
        first = head[:m]
        start = np.ones(m, bool)
        before = np.concatenate([[OTHER], kind[:-1]])
        after_space = np.concatenate([[False], space[:-1]]) & ~first
        after_blank = np.concatenate([[False], code[:-1] == 0x20]) & ~first
        next_ends = np.concatenate([space[1:], [True]]) | head[1:]
        start = np.where(space, ~after_space | ~next_ends, np.where(after_space, ~after_blank, kind != before)) | first
        quote = np.flatnonzero((code == 0x27) & start)
        if len(quote):
            c = np.concatenate([code, np.zeros(3, np.int32)])
            open1, open2 = ~head[np.minimum(quote + 1, m)], ~head[np.minimum(quote + 2, m)]
            one, two = c[quote + 1], c[quote + 2]
            short = open1 & np.isin(one, [ord(x) for x in "stmd"])
            long = open1 & open2 & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
            start[quote[short | long] + 1] = False
            ends = np.concatenate([quote[short] + 2, quote[long] + 3])
            start[ends[ends < m]] = True
        out = np.zeros(n, bool)
        out[lead[start]] = True
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a chunk, end to end, and each one's count."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        raw, special = data.tobytes(), []
        for content, i in self.v.added.items():
            at = raw.find(content)
            while at >= 0:
                end = at + len(content)
                if np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, end, "left"):
                    special.append((at, end, i))
                    at = raw.find(content, end)
                else:
                    at = raw.find(content, at + 1)
        inner = offsets[offsets < n]
        breaks = np.concatenate([inner, np.array([x for a, b, _ in special for x in (a, b) if x < n], np.int64)])
        cut = self.word_starts(data, breaks)
        cut[1:] |= self.v.forced[data[:-1].astype(np.int32) << 8 | data[1:]]
        for a, b, _ in special:
            cut[a + 1:b] = False
        cut[0] = True
        cut[breaks] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(starts, append=n)
        keys = word_hashes(data, starts, lengths)
        distinct, sample, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at = self.lookup(data, starts[sample], lengths[sample], distinct)
        first, count = self.first[at][inverse], self.count[at][inverse]
        ids = self.ids[spans(first, count)]
        total = np.concatenate([[0], np.cumsum(count)])
        if special:  # each is one fragment; its ids give way to the added token's
            order = sorted(special)
            where = np.searchsorted(starts, [a for a, _, _ in order])
            keep = np.ones(len(ids), bool)
            for k, (_, _, i) in zip(where, order):
                keep[total[k] + 1:total[k + 1]] = False
                ids[total[k]] = i
            ids, count = ids[keep], count.copy()
            count[where] = 1
            total = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(total[np.searchsorted(starts, offsets)])

    def lookup(self, data, starts, lengths, keys) -> np.ndarray:
        """Cache rows of distinct fragments; unknown ones are encoded first."""
        if len(self.keys) > CACHE_FRAGMENTS:
            self.reset()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            ids, count = self.merge(data, starts[new], lengths[new])
            rows = len(self.first) + np.arange(len(new))
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
            self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, ids])
            self.keys, self.at = np.insert(self.keys, at[new], keys[new]), np.insert(self.at, at[new], rows)
            at = np.searchsorted(self.keys, keys)
        return self.at[at]

    def merge(self, data, starts, lengths) -> tuple[np.ndarray, np.ndarray]:
        """BPE of all given fragments side by side: in each round every fragment
        merges its pair of lowest rank, left to right."""
        v, n = self.v, len(starts)
        symbols = v.byte_ids[data[spans(starts, lengths)]]
        owner = np.repeat(np.arange(n), lengths)
        done_ids, done_owner = [], []
        while len(symbols):
            last = np.concatenate([owner[1:] != owner[:-1], [True]])
            rank = np.full(len(symbols), NEVER, np.int32)
            inner = np.flatnonzero(~last)
            rank[inner] = v.ranks(symbols[inner], symbols[inner + 1])
            heads = np.flatnonzero(np.concatenate([[True], last[:-1]]))
            size = np.diff(heads, append=len(symbols))
            least = np.minimum.reduceat(rank, heads)
            ended = least == NEVER
            least, ended_each = np.repeat(least, size), np.repeat(ended, size)
            if ended.any():
                done_ids.append(symbols[ended_each])
                done_owner.append(owner[ended_each])
            hit = (rank == least) & ~ended_each
            run = np.flatnonzero(hit)
            if len(run):  # of overlapping places (a a a) every second one, from the left
                fresh = np.concatenate([[True], np.diff(run) > 1])
                begin = run[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
                run = run[(run - begin) % 2 == 0]
                symbols = symbols.copy()
                symbols[run] = v.merged[rank[run]]
            keep = ~ended_each
            keep[run + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=n)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a run of ids and each token's length in bytes."""
        lengths = self.v.lengths[ids]
        return self.v.bytes[spans(self.v.starts[ids], lengths)], lengths


_ENCODERS: dict[str, Encoder] = {}


class EncoderSource:
    """Hands tasks an encoder: the vocabulary text is broadcast once, parsed
    once in each Python worker."""

    def __init__(self, spark, path: str):
        if os.path.getsize(path) > MAX_VOCAB_BYTES:
            raise ValueError(f"vocabulary file over {MAX_VOCAB_BYTES} bytes: {path}")
        with open(path, encoding="utf-8") as f:
            self.text = spark.sparkContext.broadcast(f.read())
        self.key = f"{path}:{os.path.getmtime(path)}"

    def get(self) -> Encoder:
        if self.key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[self.key] = Encoder(Vocabulary(self.text.value))
        return _ENCODERS[self.key]


def encode(df: DataFrame, text_col: str = "text", vocabulary: str | None = None, decode: bool = False) -> DataFrame:
    """Add ``n_tokens`` and ``ids`` (binary: unsigned 32-bit little-endian ids);
    with ``decode`` also ``decoded``, the text the ids stand for."""
    source = EncoderSource(df.sparkSession, vocabulary or default_vocabulary())

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        encoder = source.get()
        data, offsets = flat(batch.column(text_col))
        counts, packed, texts = [], [], []
        for a, b in chunks(offsets):
            part = data[offsets[a]:offsets[b]]
            ids, count = encoder.encode(part, offsets[a:b + 1] - offsets[a])
            ends = np.cumsum(count)
            counts.append(count)
            raw = ids.astype("<u4").tobytes()
            packed += [raw[4 * s:4 * e] for s, e in zip(ends - count, ends)]
            if decode:
                texts += decode_parts(encoder, ids, ends - count, ends)
        out = {"n_tokens": pa.array(np.concatenate(counts) if counts else [], pa.int64()), "ids": pa.array(packed, pa.binary())}
        return out | ({"decoded": pa.array(texts, pa.string())} if decode else {})

    new = {"n_tokens": LongType(), "ids": BinaryType()} | ({"decoded": StringType()} if decode else {})
    return map_batches(df, run, new)


def decode(df: DataFrame, ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Add ``decoded``: the text of packed ids; bytes that are no UTF-8 become
    U+FFFD, null ids the empty text."""
    source = EncoderSource(df.sparkSession, vocabulary or default_vocabulary())

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        encoder, (data, offsets), texts = source.get(), flat(batch.column(ids_col)), []
        for a, b in chunks(offsets):
            ids = np.frombuffer(data[offsets[a]:offsets[b]].tobytes(), "<u4")
            at = (offsets[a:b + 1] - offsets[a]) // 4
            texts += decode_parts(encoder, ids, at[:-1], at[1:])
        return {"decoded": pa.array(texts, pa.string())}

    return map_batches(df, run, {"decoded": StringType()})


def decode_parts(encoder: Encoder, ids, starts, ends) -> list[str]:
    raw, lengths = encoder.decode(ids)
    at = np.concatenate([[0], np.cumsum(lengths)])
    raw = raw.tobytes()
    return [raw[s:e].decode("utf-8", "replace") for s, e in zip(at[starts], at[ends])]
