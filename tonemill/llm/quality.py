"""Quality classifier: regularised quadratic discriminant analysis.

Each text gives ``len(STATISTICS)`` statistics (letter and symbol shares, word
lengths, repetition), square-root or log transformed so that their scatter is
closer to normal. Training needs per class only the count, the sum and the
outer-product sum of these vectors: partial sums in every task, added up by
Spark, a few hundred numbers in all. Class covariances are shrunk towards the
pooled one (``pooling``) and towards a multiple of the identity (``ridge``). A
document's log-density difference comes from the Mahalanobis distances to both
means, with Cholesky factors that are computed (and inverted) once and cached in
the model; a logistic link, fitted on a fixed-size histogram of the
training differences, turns it into the score.

Defined cases: null and empty texts have the statistics of no text and are
scored as such; every label row counts once, label rows of unknown documents
or with a null label not at all; without labels of both classes the score is
the smoothed share of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tonemill.llm.ragged import chunks, flat, in_batches, map_batches, mix, word_hashes
from tonemill.llm.simhash import words

STATISTICS = (
    "log_words", "mean_word", "sd_word", "lower", "upper", "digits", "exclaim", "bars", "symbols", "points", "lines",
    "marked_words", "distinct_words", "herdan", "simpson", "twins", "distinct_pairs", "wide",
)
BINS, SPAN = 2000, 60.0


def byte_kinds() -> np.ndarray:
    kinds = np.full(256, 9, np.uint8)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".,;:?", b"!", b"|", b"#$%&*@^~+=<>\\/_")):
        kinds[list(chars)] = k
    kinds[0x80:0xC0], kinds[0xC0:] = 11, 10
    return kinds


KINDS = byte_kinds()


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Transformed statistics of each document of a chunk."""
    n_docs, sizes = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(n_docs), sizes)
    count = np.bincount(owner * 12 + KINDS[data], minlength=12 * n_docs).reshape(n_docs, 12).astype(float)
    chars = np.maximum(sizes - count[:, 11], 1)
    letters = np.maximum(count[:, 0] + count[:, 1], 1)
    text, at, ranges = words(data, offsets)
    n = np.diff(ranges)
    some, length = np.maximum(n, 1), np.diff(at) - 1
    of = np.repeat(np.arange(n_docs), n)

    def per_doc(values=None):
        return np.bincount(of, values, minlength=n_docs)

    mean = per_doc(length) / some
    sd = np.sqrt(np.maximum(per_doc(length.astype(float) ** 2) / some - mean**2, 0))
    marked = np.isin(KINDS[text[at[1:] - 2]], (6, 7, 8)) if len(of) else np.zeros(0)
    hashes = word_hashes(text, at[:-1], length)
    salt = mix(of.astype(np.uint64) + np.uint64(1))
    _, first, times = np.unique(hashes ^ salt, return_index=True, return_counts=True)
    distinct = np.bincount(of[first], minlength=n_docs)
    simpson = np.bincount(of[first], times.astype(float) ** 2, minlength=n_docs) / some**2
    same = of[1:] == of[:-1]
    twins = np.bincount(of[1:][same & (hashes[1:] == hashes[:-1])], minlength=n_docs) / some
    pairs = (mix(hashes[:-1]) + hashes[1:])[same] ^ salt[1:][same]
    _, first = np.unique(pairs, return_index=True)
    distinct_pairs = np.bincount(of[1:][same][first], minlength=n_docs) / np.maximum(n - 1, 1)
    columns = [
        np.log1p(n), np.log1p(mean), np.log1p(sd), count[:, 0] / chars, np.sqrt(count[:, 1] / letters), np.sqrt(count[:, 2] / chars),
        np.sqrt(count[:, 6] / chars), np.sqrt(count[:, 7] / chars), np.sqrt(count[:, 8] / chars), np.sqrt(count[:, 5] / chars), np.sqrt(count[:, 4] / chars),
        np.sqrt(per_doc(marked) / some), distinct / some, np.log1p(distinct) / np.log1p(some), np.sqrt(simpson), np.sqrt(twins), distinct_pairs, np.sqrt(count[:, 10] / chars),
    ]
    return np.column_stack(columns)


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``statistics`` (array<double>)."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data, offsets = flat(batch.column(text_col))
        parts = [statistics(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in chunks(offsets)]
        values = np.concatenate(parts).ravel() if parts else np.zeros(0)
        at = np.arange(batch.num_rows + 1) * len(STATISTICS)
        return {"statistics": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))}

    return map_batches(df, run, {"statistics": ArrayType(DoubleType())})


@dataclass
class Model:
    """Means, inverted Cholesky factors (so a Mahalanobis distance is one
    product) and log determinants of both classes, and the logistic link.
    ``share`` alone stands in when a class has no rows."""

    share: float
    means: list | None = None
    factors: list | None = None
    log_dets: list | None = None
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        if self.means is None:
            return np.zeros(len(x))
        parts = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets):
            z = factor @ (x - mean).T
            parts.append(-0.5 * (z**2).sum(0) - 0.5 * log_det)
        return parts[1] - parts[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.share)
        d = np.clip(self.difference(x), -SPAN, SPAN)
        return 1 / (1 + np.exp(-(self.slope * d + self.offset)))


def moments(train: DataFrame, d: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and outer-product sum per class of (label, statistics) rows."""

    def partial(batches):
        total = {}
        for batch in batches:
            labels = np.asarray(batch.column("label"))
            x = np.asarray(batch.column("statistics").flatten()).reshape(-1, d)
            for c in np.unique(labels):
                own = np.column_stack([np.ones((labels == c).sum()), x[labels == c]])
                total[int(c)] = total.get(int(c), 0) + own.T @ own
        for c, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], names=["label", "m"])

    parts = in_batches(train, partial, "label int, m array<double>")
    rows = parts.select("label", F.posexplode("m").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v")).collect()  # 2 classes x (d + 1)^2
    out = {}
    for c in {r.label for r in rows}:
        m = np.zeros((d + 1) ** 2)
        for r in rows:
            if r.label == c:
                m[r.at] = r.v
        m = m.reshape(d + 1, d + 1)
        out[c] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return out


def fit(train: DataFrame, d: int = len(STATISTICS), pooling: float = 0.05, ridge: float = 0.02) -> Model:
    """Train on rows (``label`` 0 or 1, ``statistics``)."""
    train = train.where("label in (0, 1)").select(F.col("label").cast("int").alias("label"), "statistics")
    found = moments(train, d)
    n = [found[c][0] if c in found else 0.0 for c in (0, 1)]
    model = Model(share=(n[1] + 1) / (sum(n) + 2))
    if min(n) < 2:
        return model
    model.means = [found[c][1] / n[c] for c in (0, 1)]
    scatter = [found[c][2] - n[c] * np.outer(m, m) for c, m in zip((0, 1), model.means)]
    pooled = (scatter[0] + scatter[1]) / sum(n)
    model.factors, model.log_dets = [], []
    for c in (0, 1):
        cov = (1 - pooling) * scatter[c] / n[c] + pooling * pooled
        cov = (1 - ridge) * cov + ridge * np.trace(cov) / d * np.eye(d) + 1e-9 * np.eye(d)
        factor = np.linalg.cholesky(cov)
        model.factors.append(np.linalg.inv(factor))
        model.log_dets.append(2 * np.log(np.diag(factor)).sum())
    return link(train, model)


def link(train: DataFrame, model: Model) -> Model:
    """Fit the logistic link on a histogram of the training differences."""

    def binned(batches):
        counts = np.zeros((2, BINS + 1), np.int64)
        for batch in batches:
            x = np.asarray(batch.column("statistics").flatten()).reshape(batch.num_rows, -1)
            at = np.rint((np.clip(model.difference(x), -SPAN, SPAN) + SPAN) * BINS / (2 * SPAN)).astype(int)
            np.add.at(counts, (np.asarray(batch.column("label")), at), 1)
        label, at = counts.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(at, pa.int32()), pa.array(counts[label, at])], names=["label", "bin", "n"])

    rows = in_batches(train, binned, "label int, bin int, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")).collect()  # 2 x BINS at most
    d = np.array([r.bin for r in rows]) * 2 * SPAN / BINS - SPAN
    y, w = np.array([r.label for r in rows], float), np.array([r.n for r in rows], float)
    model.slope, model.offset = logistic(d, y, w)
    return model


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, prior: float = 1.0) -> tuple[float, float]:
    """Slope (not negative) and offset of a weighted logistic regression, by Newton steps."""
    design, beta = np.column_stack([x / 10, np.ones(len(x))]), np.array([0.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (w * (y - p)) - prior * beta * [1, 0]
        curve = (design * (w * p * (1 - p))[:, None]).T @ design + prior * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(beta[0] / 10, 0.0), beta[1]


def with_score(df: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` to rows with ``statistics``."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        x = np.asarray(batch.column("statistics").flatten()).reshape(batch.num_rows, len(STATISTICS))
        return {"score": pa.array(model.score(x))}

    return map_batches(df, run, {"score": DoubleType()})


def score_texts(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``score`` to documents, straight from their texts."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data, offsets = flat(batch.column(text_col))
        parts = [model.score(statistics(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])) for a, b in chunks(offsets)]
        return {"score": pa.array(np.concatenate(parts) if parts else [], pa.float64())}

    return map_batches(df, run, {"score": DoubleType()})


def labelled(stats: DataFrame, labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """(label, statistics) of the documents with a label, by key."""
    marks = labels.select(F.col(key).alias("label_key"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    return stats.select(F.col(key).alias("label_key"), "statistics").join(marks, "label_key").select("label", "statistics")
