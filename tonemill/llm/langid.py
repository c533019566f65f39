"""Language identification by hierarchical discrimination.

First the language *family* is predicted, then one-versus-one linear support
vector machines tell the closely related languages within it apart.

A text's features are its character 1-, 2- and 3-grams (bytes of the lower-cased
letters, everything else one separator), hashed into ``2 ** BITS`` counts,
square-rooted and scaled to length 1. The family step is a one-versus-rest set
of the same linear machines. Machines are trained by Newton steps on the squared
hinge loss, on at most ``per_language`` labelled texts of each language (those
with the smallest hash of their key; only they are gathered, as feature rows).
Prediction reads every whole text, in place.

``FAMILIES`` groups language codes; a code that is not listed is a family of its
own. Defined cases: null texts and texts without a letter are ``und`` with score
0; rows without a language teach nothing; with no training rows at all every
text is ``und``; codes are compared as they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType

from tonemill.llm.ragged import chunks, flat, map_batches

BITS = 12
PER_LANGUAGE = 400
MAX_BROADCAST = 10_000
# Which languages are closely related.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("es", "fr", "it", "pt", "ca", "ro", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tt"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "gu", "pa", "ne"),
}
UNKNOWN = "und"


def family(code: str) -> str:
    return next((name for name, codes in FAMILIES.items() if code in codes), code)


def letter_table() -> np.ndarray:
    """Byte codes for features: lower-cased letters and bytes beyond ASCII as
    they are, all else one separator."""
    out = np.full(256, 32, np.int64)
    for i in range(26):
        out[97 + i] = out[65 + i] = 97 + i
    out[0x80:] = np.arange(0x80, 256)
    return out


TABLE = letter_table()
NON_ASCII_LETTER = regex.compile(r"\p{L}")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed n-gram features (float32 rows of length 1) of a chunk's texts."""
    n, size = len(offsets) - 1, 1 << BITS
    if not len(data):
        return np.zeros((n, size), np.float32)
    s = TABLE[data]
    head = np.zeros(len(s) + 1, bool)
    head[offsets] = True
    keep = (s != 32) | head[:-1] | np.concatenate([[True], s[:-1] != 32])
    of = np.repeat(np.arange(n), np.diff(offsets))[keep]
    s = s[keep]
    cells = [of * size + spread(s)]
    for k in (1, 2):
        same = of[k:] == of[:-k]
        grams = s[k:] + 256 * s[k - 1:len(s) - 1] + (65536 * s[:-2] if k == 2 else 0) + (k << 24)
        cells.append((of[k:] * size + spread(grams))[same])
    counts = sum(np.bincount(c, minlength=n * size) for c in cells).reshape(n, size)
    x = np.sqrt(counts, dtype=np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Chunks of few documents: a feature row may take more room than its text."""
    for a, b in chunks(offsets, 1 << 18):
        for s in range(a, b, 256):
            yield s, min(b, s + 256)


def spread(grams: np.ndarray) -> np.ndarray:
    """Hash cell of each n-gram code."""
    return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts of a chunk hold any letter."""
    ascii_letter = (TABLE[data] >= 97) & (data < 0x80)
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = bool(NON_ASCII_LETTER.search(data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace").replace("�", "")))
    return out


def train_svm(x: np.ndarray, y: np.ndarray, penalty: float = 20.0) -> np.ndarray:
    """Weights (bias last) of a linear SVM on labels -1/+1: squared hinge, L2
    penalty, Newton steps in the span of the training rows."""
    gram = x @ x.T + 1.0
    n, alpha = len(y), np.zeros(len(y))
    weight = np.where(y > 0, n / (2 * max((y > 0).sum(), 1)), n / (2 * max((y < 0).sum(), 1))) * penalty
    active = np.ones(n, bool)
    for _ in range(30):
        rows = np.flatnonzero(active)
        alpha = np.zeros(n)
        alpha[rows] = np.linalg.solve(gram[np.ix_(rows, rows)] + np.diag(1 / weight[rows]), y[rows])
        margins = y * (gram @ alpha)
        now = margins < 1
        if (now == active).all():
            break
        active = now
        if not active.any():
            break
    return np.append(x.T @ alpha, alpha.sum())


@dataclass
class Model:
    """Family machines (one row each) and, per family, its languages and pairs."""

    families: list[str]
    top: np.ndarray
    members: dict[str, list[str]]
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each feature row."""
        n = len(x)
        lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
        if not self.families:
            return lang, score
        margins = x @ self.top[:, :-1].T + self.top[:, -1]
        chosen = margins.argmax(1) if len(self.families) > 1 else np.zeros(n, int)
        first = 1 / (1 + np.exp(-2 * margins.max(1))) if len(self.families) > 1 else np.ones(n)
        for f, name in enumerate(self.families):
            rows, codes = np.flatnonzero(chosen == f), self.members[name]
            votes, sums = np.zeros((len(rows), len(codes))), np.zeros((len(rows), len(codes)))
            for i, j in combinations(range(len(codes)), 2):
                w = self.pairs[codes[i], codes[j]]
                p = 1 / (1 + np.exp(-2 * (x[rows] @ w[:-1] + w[-1])))
                votes[:, i] += p >= 0.5
                votes[:, j] += p < 0.5
                sums[:, i] += p
                sums[:, j] += 1 - p
            best = (votes + sums / (len(codes) + 1)).argmax(1) if len(codes) > 1 else np.zeros(len(rows), int)
            lang[rows] = np.array(codes, object)[best]
            share = sums[np.arange(len(rows)), best] / (len(codes) - 1) if len(codes) > 1 else 1.0
            score[rows] = first[rows] * share
        return lang, score


def fit(train: DataFrame, key: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Train on rows with a language and a text."""
    rows = train.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(key), F.col(text_col)).alias("h"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    # Hashes are spread evenly, so twice the wanted share of them leaves about
    # twice the wanted rows of each language for the exact choice.
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # one row per language
    near = rows.join(F.broadcast(counts) if counts.count() <= MAX_BROADCAST else counts, "lang")
    near = near.where((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("n") <= 2.0 * per_language).select("lang", "h", "text")

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data, offsets = flat(batch.column("text"))
        parts = [r.astype(np.float16).tobytes() for a, b in pieces(offsets) for r in features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])]
        return {"text": pa.array(parts, pa.binary())}

    featured = map_batches(near, run, {"text": BinaryType()})
    order = Window.partitionBy("lang").orderBy("h")
    picked = featured.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).collect()  # per_language rows of each language
    by = {}
    for r in sorted(picked, key=lambda r: (r.lang, bytes(r.text))):
        by.setdefault(r.lang, []).append(np.frombuffer(r.text, np.float16).astype(np.float32))
    by = {code: np.stack(v) for code, v in by.items()}
    members = {}
    for code in sorted(by):
        members.setdefault(family(code), []).append(code)
    names = sorted(members)
    everything = np.concatenate([by[c] for f in names for c in members[f]]) if by else np.zeros((0, 1 << BITS), np.float32)
    owner = np.concatenate([np.full(len(by[c]), i) for i, f in enumerate(names) for c in members[f]]) if by else np.zeros(0)
    top = np.stack([train_svm(everything, np.where(owner == i, 1.0, -1.0)) for i in range(len(names))]) if len(names) > 1 else np.zeros((len(names), (1 << BITS) + 1))
    pairs = {}
    for f in names:
        for a, b in combinations(members[f], 2):
            pairs[a, b] = train_svm(np.concatenate([by[a], by[b]]), np.concatenate([np.ones(len(by[a])), -np.ones(len(by[b]))]))
    return Model(names, top, members, pairs)


def with_language(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data, offsets, langs, scores = *flat(batch.column(text_col)), [], []
        for a, b in pieces(offsets):
            part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
            lang, score = shared.value.predict(features(part, at))
            some = has_letter(part, at)
            langs += np.where(some, lang, UNKNOWN).tolist()
            scores.append(np.where(some, score, 0.0))
        return {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(np.concatenate(scores) if scores else [], pa.float64())}

    return map_batches(df, run, {"lang_pred": StringType(), "score": DoubleType()})
