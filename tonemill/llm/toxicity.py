"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model (a-z, other letters as one symbol, word ends) is
   counted over all documents: per-task counts, summed by Spark.
2. Words that may be disguised (look-alike digits and symbols among letters,
   letters spread over spaces or separators, letters repeated three times or
   more) become lattices: a look-alike may stand for each of its letters or for
   itself, a separator (blanks between single characters, too) may vanish or end
   a word, invisible characters vanish, a repeated letter may stand once or twice.
   Viterbi decoding under the trigram model picks the restored word or words; a
   run of single characters stays as it is if no decoding reads like words.
3. Documents are scored on the restored text: words and word beginnings whose
   share ``p`` of toxic training documents is high and significant (signed G2
   statistic) add ``-log(1 - p)`` once per document. A logistic link, fitted on
   a quarter of the training rows that the words were not counted on, turns
   the sum into the score. Words live in ``2 ** BUCKET_BITS`` hash buckets, so
   the model's size is fixed whatever the vocabulary.

Training labels: at most ``max_labels`` rows, those with the smallest hash of
their key, so that they can be sent to the tasks without moving any text; the
character model and the scoring cover all documents.

Defined cases: null and empty texts get the score of a text without toxic
words; label rows with null key or label are left out, of rows that repeat a
key the largest label holds; without labels of both classes the score is the
smoothed share of toxic rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from tonemill.llm.quality import logistic
from tonemill.llm.ragged import chunks, flat, in_batches, map_batches, mix, word_hashes
from tonemill.llm.simhash import words

BUCKET_BITS = 20
MAX_LABELS = 50_000
PREFIXES = (4, 5, 6)
LEAST_G2, LEAST_SHARE = 12.0, 0.7
CALIBRATION_FOLDS = 4
BINS, SPAN = 1000, 5.0
# Look-alike characters and the letters they may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t"}
SEPARATORS = " .-_*"
# Other separators (no-break space, middle dot, hyphens and dashes, bullets) and invisible characters.
WIDE_SEPARATORS = "\u00a0\u00b7\u2010\u2011\u2012\u2013\u2014\u2022\u2027"
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
BETWEEN = re.compile(f"(?<=[A-Za-z0-9@$!|+])(?:[{WIDE_SEPARATORS}]|[{INVISIBLE}]+)(?=[A-Za-z0-9@$!|+])")
# A spelled-out word: letters or look-alikes with one separator between, and
# punctuation at its edges.
EDGE = rb"(?:[!-/:-@\[-`{-~]|\xe2\x80[\x80-\xbf])*"
SPELLED = re.compile(EDGE + rb"[a-z0-9@$!|+](?:[.\-_*][a-z0-9@$!|+]){2,}" + EDGE)
END, WIDE = 0, 27
SYMBOLS = 28


def symbol_table() -> np.ndarray:
    """Symbol of each byte: 1-26 letters, 27 a byte beyond ASCII, 0 the rest."""
    out = np.zeros(256, np.int64)
    for i in range(26):
        out[97 + i] = out[65 + i] = i + 1
    out[0x80:] = WIDE
    return out


TABLE = symbol_table()


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of symbol triples; bytes that are no letters end a word, and a
    run of them counts once, as does a wide character's run of bytes."""
    s = TABLE[data]
    keep = np.concatenate([[True], (s[1:] != s[:-1]) | (s[1:] % WIDE != 0)])
    head = np.zeros(len(s) + 1, bool)
    head[offsets] = True
    s = np.where(head[:-1] & (s != END), s, s)
    keep |= head[:-1]
    at, s = np.flatnonzero(keep), s[keep]
    first = np.flatnonzero(head[:-1][at])
    s = np.insert(s, first, END)  # every document begins after a word end
    if len(s) < 3:
        return np.zeros(SYMBOLS**3, np.int64)
    return np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities [a, b, c] of symbol c after a, b, over all documents."""

    def count(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for a, b in chunks(offsets):
                if offsets[b] > offsets[a]:
                    total += trigrams(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["triple", "n"])

    rows = in_batches(docs.select(text_col), count, "triple int, n long").groupBy("triple").agg(F.sum("n").alias("n")).collect()  # 28^3 at most
    counts = np.zeros(SYMBOLS**3)
    for r in rows:
        counts[r.triple] = r.n
    return interpolated(counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS))


def interpolated(tri: np.ndarray) -> np.ndarray:
    """Witten-Bell interpolation of trigram, bigram and unigram estimates."""
    out = np.full(SYMBOLS, 1 / SYMBOLS)
    for counts in (tri.sum((0, 1)), tri.sum(0), tri):
        total, kinds = counts.sum(-1, keepdims=True), (counts > 0).sum(-1, keepdims=True)
        seen = total + kinds
        out = np.where(seen > 0, (counts + kinds * out) / np.where(seen > 0, seen, 1), out)
    return np.log(out)


# Log weights of the channel: a look-alike read as a letter, kept as a word
# end, a symbol dropped at an edge, a separator dropped, a letter run shortened.
# A blank between single characters that ends a word costs KEPT.
AS_LETTER, AS_ITSELF, AT_EDGE, DROPPED, ONCE, TWICE, ONCE_OF_TWO, KEPT = -0.7, -9.0, -0.3, -0.1, -0.4, -0.6, -6.0, -3.0
# Least mean log weight of a symbol of a decoded run of single characters (letters in no order of words have less).
LIKE_WORDS = -4.5
# Longer words are decoded each time and not remembered.
REMEMBERED = 64


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """The (text, log weight) choices of each run of one character. A letter that
    stands again behind a separator may repeat the one before."""
    runs, i = [], 0
    while i < len(word):
        j = i
        while j < len(word) and word[j] == word[i]:
            j += 1
        runs.append((word[i], j - i))
        i = j
    out, again = [], 1
    for k, (c, n) in enumerate(runs):
        edge = k in (0, len(runs) - 1)
        if c in LOOKALIKES:
            letters = LOOKALIKES[c]
            choices = [(x * m, AS_LETTER * n) for x in letters for m in {min(n, 2), 1}] + [(" ", AS_ITSELF)]
            if not c.isdigit() and edge:
                choices.append(("", AT_EDGE * n))
        elif c in SEPARATORS:
            choices = [("", DROPPED), (" ", KEPT if c == " " else AS_ITSELF)]
        elif c.isalpha():
            choices = [(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, ONCE_OF_TWO)] if n == 2 else [(c, ONCE), (c * 2, TWICE)]
            same = n == 1 and k > 1 and runs[k - 1][0] in SEPARATORS and runs[k - 2] == (c, 1)
            again = again + 1 if same else 1
            if again == 2:
                third = k + 2 < len(runs) and runs[k + 1][0] in SEPARATORS and runs[k + 2] == (c, 1)
                choices = [(c, TWICE), ("", ONCE)] if third else [(c, 0.0), ("", ONCE_OF_TWO)]
            elif again > 2:
                choices = [("", 0.0)]
        else:
            choices = [("", AT_EDGE)] if edge else [(" ", 0.0)]
        out.append(choices)
    return out


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else END if c == " " else WIDE


def best_path(choices: list[list[tuple[str, float]]], model: np.ndarray) -> tuple[float, str]:
    """Log probability and text of the most probable path through the lattice, a
    word end before and after."""
    best = {(END, END): (0.0, None)}
    for options in [*choices, [(" ", 0.0)]]:
        after = {}
        for (a, b), (score, path) in best.items():
            for piece, weight in options:
                x, y, s = a, b, score + weight
                for c in piece:
                    z = symbol(c)
                    if z == y and z in (END, WIDE):
                        continue
                    s += model[x, y, z]
                    x, y = y, z
                if (x, y) not in after or after[x, y][0] < s:
                    after[x, y] = (s, (path, piece))
        best = after
    score, path = max(best.values(), key=lambda v: v[0])
    parts = []
    while path:
        path, piece = path
        parts.append(piece)
    return float(score), "".join(reversed(parts)).strip()


def viterbi(choices: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """Most probable text through the lattice."""
    return best_path(choices, model)[1]


def joined(word: str) -> str:
    """A word without invisible characters between its letters, other separators
    as hyphens if it is spelled out with them."""
    plain = BETWEEN.sub(lambda m: "" if m.group()[0] in INVISIBLE else m.group(), word)
    hyphens = BETWEEN.sub("-", plain)
    return hyphens if hyphens == plain or SPELLED.fullmatch(hyphens.encode()) else plain


def restored(word: str, spread: bool, model: np.ndarray) -> str:
    """A disguised word decoded; a ``spread`` run of single characters only if
    that reads like words."""
    score, text = best_path(lattice(joined(word)), model)
    return word if spread and score < LIKE_WORDS * (len(text) + 1) else text


def wide_between(text: np.ndarray) -> np.ndarray:
    """Places of bytes that may begin one of the wider separators or invisible
    characters: the lead bytes of any, an ASCII unit before them."""
    leads = np.unique([c.encode()[0] for c in WIDE_SEPARATORS + INVISIBLE]).astype(np.uint8)
    ascii_before = np.concatenate([[False], text[:-1] < 0x80])
    return np.flatnonzero((text >= 0x80) & ascii_before & np.isin(text, leads))


class Restorer:
    """Finds and restores disguised words of chunks of documents."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.known = lru_cache(100_000)(lambda word, spread: restored(word, spread, model))

    def decode(self, word: str, spread: bool) -> str:
        return self.known(word, spread) if len(word) <= REMEMBERED else restored(word, spread, self.model)

    def flags(self, text: np.ndarray, at: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Masks over words: may be disguised; is one character of a spread word."""
        n = len(at) - 1
        letter = (text >= 97) & (text <= 122)
        digit = (text >= 48) & (text <= 57)
        alike = np.isin(text, [ord(c) for c in LOOKALIKES])
        next_letter = np.concatenate([letter[1:], [False]])
        last_letter = np.concatenate([[False], letter[:-1]])
        hit = alike & next_letter | digit & last_letter
        triple = np.zeros(len(text), bool)
        triple[:-2] = letter[:-2] & (text[1:-1] == text[:-2]) & (text[2:] == text[:-2])
        of = np.repeat(np.arange(n), np.diff(at))
        suspect = np.zeros(n, bool)
        suspect[of[hit | triple]] = True
        length = np.diff(at) - 1
        letters = np.bincount(of, letter, minlength=n)
        unit = letter | alike
        between = np.concatenate([[False], unit[:-1]]) & np.concatenate([unit[1:], [False]])
        seps = np.bincount(of, np.isin(text, [ord(c) for c in SEPARATORS[1:]]) & between, minlength=n)
        for i in np.flatnonzero(~suspect & (seps >= 2) & (letters >= 2)):
            suspect[i] = SPELLED.fullmatch(text[at[i]:at[i + 1] - 1].tobytes()) is not None
        for i in np.unique(of[wide_between(text)]):
            word = text[at[i]:at[i + 1] - 1].tobytes().decode("utf-8", "replace")
            suspect[i] |= joined(word) != word
        single = (length == 1) & unit[at[:-1]]
        head = np.zeros(n + 1, bool)
        head[ranges] = True
        follows = ~head[:-1] & np.concatenate([[False], single[:-1]])
        begins = single & ~follows
        # The last character of a spread word may carry punctuation.
        real_bytes = np.bincount(of, letter | digit | (text >= 0x80), minlength=n)
        part = single | follows & (length > 1) & (real_bytes == 1) & (letter | digit)[at[:-1]]
        run = np.cumsum(begins) - 1
        size = np.bincount(run[part], minlength=max(run.max(initial=-1) + 1, 0))
        spread = np.zeros(n, bool)
        if len(size):
            real = np.bincount(run[part], letter[at[:-1]][part], minlength=len(size))
            spread[part] = ((size >= 3) & (real >= 2))[run[part]]
        return suspect, spread

    def restore(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Restored, lower-cased texts of a chunk (words joined by one space)."""
        text, at, ranges = words(data, offsets)
        suspect, spread = self.flags(text, at, ranges) if len(at) > 1 else (np.zeros(0, bool),) * 2
        todo = np.flatnonzero(suspect | spread)
        if not len(todo):
            return text, at[ranges]
        raw, pieces, done, shift = text.tobytes(), [], 0, []
        ends, k = np.append(ranges[1:], -1), 0
        doc = np.searchsorted(ranges, todo, "right") - 1
        while k < len(todo):
            i, j = todo[k], todo[k] + 1
            if spread[i]:
                while k + 1 < len(todo) and todo[k + 1] == j and spread[j] and doc[k + 1] == doc[k] and at[j] - at[j - 1] == 2:
                    k, j = k + 1, j + 1
            word = raw[at[i]:at[j] - 1].decode("utf-8", "replace")
            new = self.decode(word, bool(spread[i])).encode()
            pieces += [raw[done:at[i]], new, b" "]
            done = at[j]
            shift.append((ends[doc[k]], len(new) + 1 - (at[j] - at[i])))
            k += 1
        pieces.append(raw[done:])
        bounds = at[ranges].copy()
        moved = np.zeros(len(ranges), np.int64)
        np.add.at(moved, np.searchsorted(ranges, [s for s, _ in shift]), [d for _, d in shift])
        return np.frombuffer(b"".join(pieces), np.uint8), bounds + np.cumsum(moved)


def buckets(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash bucket of every word (run of letters) of a chunk and
    of the word's beginnings, which catch inflected and compound forms."""
    letter = (text >= 97) & (text <= 122) | (text >= 0x80)
    first = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    last = np.flatnonzero(letter & ~np.concatenate([letter[1:], [False]])) + 1
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, size = np.searchsorted(bounds, first, "right") - 1, last - first
    cuts = [np.flatnonzero(size > n) for n in PREFIXES]
    rows = np.concatenate([np.arange(len(first)), *cuts])
    lengths = np.concatenate([size, *[np.full(len(c), n) for n, c in zip(PREFIXES, cuts)]])
    hashes = word_hashes(text, first[rows], lengths)
    return doc[rows], (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


_RESTORERS: dict[int, Restorer] = {}


def restorer(broadcast) -> Restorer:
    """One restorer (and its cache) per Python worker and model."""
    if broadcast.id not in _RESTORERS:
        _RESTORERS.clear()
        _RESTORERS[broadcast.id] = Restorer(broadcast.value)
    return _RESTORERS[broadcast.id]


class SharedModel:
    """A broadcast model with a name for the per-worker cache."""

    def __init__(self, spark, value):
        self.broadcast, self.id = spark.sparkContext.broadcast(value), hash(value.tobytes())

    @property
    def value(self):
        return self.broadcast.value


def restore_texts(df: DataFrame, model: np.ndarray, text_col: str = "text") -> DataFrame:
    """Add ``restored``: the lower-cased text with disguised words decoded."""
    shared = SharedModel(df.sparkSession, model)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data, offsets, out = *flat(batch.column(text_col)), []
        for a, b in chunks(offsets):
            text, at = restorer(shared).restore(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            raw = text.tobytes()
            out += [raw[s:e].decode("utf-8", "replace").rstrip(" ") for s, e in zip(at, at[1:])]
        return {"restored": pa.array(out, pa.string())}

    return map_batches(df, run, {"restored": StringType()})


@dataclass
class Scorer:
    """Weight of every hash bucket and the logistic link on their sum."""

    weights: np.ndarray
    slope: float
    offset: float

    def evidence(self, doc: np.ndarray, bucket: np.ndarray, n_docs: int) -> np.ndarray:
        hits = self.weights[bucket] != 0
        doc, bucket = np.divmod(np.unique(doc[hits] << BUCKET_BITS | bucket[hits]), 1 << BUCKET_BITS)
        return np.log1p(np.bincount(doc, self.weights[bucket], minlength=n_docs))

    def score(self, doc: np.ndarray, bucket: np.ndarray, n_docs: int) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.evidence(doc, bucket, n_docs) + self.offset)))


class Marked:
    """The training labels by key (bounded), for looking up in tasks."""

    def __init__(self, known: dict[int, int]):
        self.ids = np.array(sorted(known), np.int64)
        self.marks = np.array([known[i] for i in self.ids.tolist()], np.int64)

    def rows(self, column: pa.Array, calibration: bool) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of labelled keys of that part, and their labels."""
        keys = np.asarray(column.fill_null(0))
        at = np.minimum(np.searchsorted(self.ids, keys), len(self.ids) - 1)
        part = mix(keys.view(np.uint64)) % np.uint64(CALIBRATION_FOLDS) == 0
        rows = np.flatnonzero((self.ids[at] == keys) & np.asarray(column.is_valid()) & (part == calibration))
        return rows, self.marks[at[rows]]


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, label: str = "toxic", key: str = "doc_id", text_col: str = "text", max_labels: int = MAX_LABELS) -> Scorer:
    """Count words in the training rows, then fit the link on the rest of them."""
    size = 1 << BUCKET_BITS
    picked = labels.select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    known = {}
    for r in picked.orderBy(F.xxhash64("k"), "k", F.desc("y")).limit(max_labels).collect():  # bounded by max_labels
        known[r.k] = max(known.get(r.k, 0), r.y)
    share = (sum(known.values()) + 1) / (len(known) + 2)
    base = Scorer(np.zeros(size), 0.0, float(np.log(share / (1 - share))))
    if not 0 < sum(known.values()) < len(known):
        return base
    spark = docs.sparkSession
    marked, shared = spark.sparkContext.broadcast(Marked(known)), SharedModel(spark, model)
    slim = docs.select(F.col(key).cast("long").alias("k"), F.col(text_col).alias("text"))

    def parts(batch, calibration):
        rows, y = marked.value.rows(batch.column(0), calibration)
        data, offsets = flat(batch.column(1).take(pa.array(rows)))
        for a, b in chunks(offsets):
            yield y[a:b], *buckets(*restorer(shared).restore(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]))

    def count(batches):
        total, n = np.zeros((2, size), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            for y, doc, bucket in parts(batch, False):
                doc, bucket = np.divmod(np.unique(doc * size + bucket), size)
                for c in (0, 1):
                    total[c] += np.bincount(bucket[y[doc] == c], minlength=size).astype(np.int32)
                n += np.bincount(y, minlength=2)
        seen = np.flatnonzero(total.any(0))
        columns = [np.append(seen, -1), np.append(total[0][seen], n[0]), np.append(total[1][seen], n[1])]
        for s in range(0, len(columns[0]), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(c[s:s + 65536], pa.int64()) for c in columns], names=["bucket", "n0", "n1"])

    counted = in_batches(slim, count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    rows = np.array([(r.bucket, r.n0, r.n1) for r in counted.where("bucket = -1 or n1 >= 3 and n1 > n0").collect()], np.int64).reshape(-1, 3)  # at most one per bucket
    (n0, n1), words_seen = rows[rows[:, 0] < 0][0, 1:], rows[rows[:, 0] >= 0]
    if not n0 or not n1:
        return base
    first = spark.sparkContext.broadcast(Scorer(weights(words_seen, n0, n1), 0.0, 0.0))

    def evidence(batches):
        total = np.zeros((2, BINS + 1), np.int64)
        for batch in batches:
            for y, doc, bucket in parts(batch, True):
                at = np.rint(np.clip(first.value.evidence(doc, bucket, len(y)), 0, SPAN) * BINS / SPAN).astype(int)
                np.add.at(total, (y, at), 1)
        y, at = total.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int64()), pa.array(at, pa.int64()), pa.array(total[y, at])], names=["y", "bin", "n"])

    bins = in_batches(slim, evidence, "y long, bin long, n long").groupBy("y", "bin").agg(F.sum("n").alias("n")).collect()  # 2 x BINS at most
    if not bins:
        return base
    x, y, n = (np.array([r[k] for r in bins], float) for k in ("bin", "y", "n"))
    slope, offset = logistic(x * SPAN / BINS, y, n, prior=0.01)
    return Scorer(first.value.weights, slope, offset)


def weights(rows: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """-log(1 - p) of the significant buckets of (bucket, clean documents,
    toxic documents); 0 for all others."""
    out = np.zeros(1 << BUCKET_BITS)
    b, k0, k1 = rows.T.astype(float)
    share, k = n1 / (n0 + n1), k0 + k1
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * (np.where(k1 > 0, k1 * np.log(k1 / (k * share)), 0) + np.where(k0 > 0, k0 * np.log(k0 / (k * (1 - share))), 0))
    p = (k1 + share) / (k + 1)
    chosen = (g2 >= LEAST_G2) & (p >= LEAST_SHARE) & (k1 > k * share)
    out[b[chosen].astype(int)] = -np.log1p(-np.minimum(p[chosen], 0.999))
    return out


def with_score(df: DataFrame, model: np.ndarray, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) of the restored text."""
    shared, sent = SharedModel(df.sparkSession, model), df.sparkSession.sparkContext.broadcast(scorer)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data, offsets, out = *flat(batch.column(text_col)), []
        for a, b in chunks(offsets):
            doc, bucket = buckets(*restorer(shared).restore(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]))
            out.append(sent.value.score(doc, bucket, b - a))
        return {"score": pa.array(np.concatenate(out) if out else [], pa.float64())}

    return map_batches(df, run, {"score": DoubleType()})
