"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of the whole text (shares of kinds of characters, repetition of words and lines, lengths) are
standardised and mapped to random Fourier features, whose products approximate a Gaussian kernel.  Each
partition of the training rows sums its part of the normal equations; the sums give the ridge weights.
Their scores are calibrated by isotonic regression on training rows kept out of the equations.

The fit takes at most about FIT_ROWS labelled rows of each label (a documented bound, chosen by a hash of
the id); every text is then scored whole.

Defined results: a null text counts as empty, and an empty one is scored from its statistics like any
other; null labels are not learned from; without rows of both labels the score is the share of label 1
(0.5 without any); rows with equal or null doc_id stay rows of their own; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import gc
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import as_text, cut, rows_with_id
from larkspur.llm.training import bounded_sample, calibrated, isotonic

FIT_ROWS = 8000
FEATURES = 192
RIDGE = 1e-3
WIDTH = 0.35
SEED = 5

_KINDS = np.zeros((256, 8), np.int64)
for _b in range(256):
    _c = chr(_b)
    _KINDS[_b] = [
        97 <= _b <= 122,
        65 <= _b <= 90,
        48 <= _b <= 57,
        _b in b" \t",
        _b == 10,
        _c in ".,;:?'\"()-",
        33 <= _b < 127 and not _c.isalnum() and _c not in ".,;:?'\"()-",
        _b >= 128,
    ]

STATISTICS = ["log_bytes", "lower", "upper", "digit", "blank", "newline", "punctuation", "symbol", "non_ascii", "entropy", "log_words", "mean_word", "type_token", "top_word", "short_words", "marked_words", "log_lines", "repeated_lines", "mean_line", "one_word_lines", "repeated_pairs"]


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = hist @ _KINDS / n
    p = hist[hist > 0] / n
    words = text.split()
    count, m = Counter(words), max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(len(raw)),
        *kinds.tolist(),
        float(-(p * np.log2(p)).sum()) if len(raw) else 0.0,
        np.log1p(len(words)),
        np.log1p(len(text) / m),
        len(count) / m,
        max(count.values(), default=0) / m,
        sum(v for w, v in count.items() if len(w) <= 3) / m,
        sum(v for w, v in count.items() if not w[-1].isalnum() and w[-1] not in ".,") / m,
        np.log1p(len(lines)),
        1 - len(set(lines)) / k,
        np.log1p(len(text) / k),
        sum(1 for x in lines if " " not in x.strip()) / k,
        1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
    ]


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    width: float = WIDTH
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    knots: tuple = (np.zeros(0), np.zeros(0))
    prior: float = 0.5

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant; the directions follow from SEED alone."""
        rng = np.random.default_rng(SEED)
        directions = rng.standard_normal((stats.shape[1], FEATURES)) * self.width
        phases = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ directions + phases) * np.sqrt(2 / FEATURES), np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(stats), self.prior)
        return np.clip(calibrated(self.raw(stats), self.knots), 0, 1)


def _with_statistics(rows: DataFrame, text_at: int, schema: str) -> DataFrame:
    """Replaces the text column, at place text_at, by its statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        for b in batches:
            stats = [statistics(t) for t in as_text(b.column(text_at))]
            cols = [c for k, c in enumerate(b.columns) if k != text_at]
            yield pa.record_batch([*cols, pa.array(stats, pa.list_(pa.float64()))], names=[f"c{k}" for k in range(len(cols) + 1)])

    return rows.mapInArrow(run, schema)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label", id_col: str = "doc_id", rows: int | None = FIT_ROWS) -> QualityModel:
    usable = labelled.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("long").alias("y"), F.col(text_col).alias("t"))
    # every fourth row, by another hash, is for the calibration
    sample = (usable if rows is None else bounded_sample(usable, "k", "y", rows)).select((F.pmod(F.xxhash64(F.lit("calibration"), "k"), F.lit(4)) == 0).alias("c0"), F.col("y").alias("c1"), "t")
    stats = cut(_with_statistics(sample, 2, "c0 boolean, c1 long, c2 array<double>"), "quality-fit")
    width = len(STATISTICS)
    first = stats.select(F.count(F.lit(1)), F.sum("c1"), *[F.avg(F.col("c2")[k]) for k in range(width)], *[F.stddev_pop(F.col("c2")[k]) for k in range(width)]).collect()[0]
    n, ones = first[0], first[1] or 0
    if not n:
        return QualityModel(np.zeros(width), np.ones(width))
    model = QualityModel(np.array(first[2 : 2 + width], float), np.maximum(np.array(first[2 + width :], float), 1e-6), prior=ones / n)
    if ones in (0, n):
        return model
    size = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for b in batches:
            keep = ~b.column(0).to_numpy(zero_copy_only=False)
            if keep.any():
                y = b.column(1).to_numpy(zero_copy_only=False)[keep].astype(float)
                w = np.where(y == 1, 0.5 / ones, 0.5 / (n - ones)) * n  # both labels weigh the same
                z = model.features(np.array(b.column(2).to_pylist())[keep])
                total += np.hstack([z.T @ (z * w[:, None]), (z.T @ (w * y))[:, None]])
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = [np.frombuffer(r[0]).reshape(size, size + 1) for r in stats.coalesce(16).mapInArrow(sums, "part binary").collect()]
    total = np.sum(parts, 0)
    model.weights = np.linalg.solve(total[:, :size] + RIDGE * n * np.eye(size) / size, total[:, size])
    held = stats.filter("c0").select("c1", "c2").collect()
    if held:
        model.knots = isotonic(model.raw(np.array([r[1] for r in held])), np.array([float(r[0]) for r in held]))
    return model


def scores(model: QualityModel, texts: list[str]) -> np.ndarray:
    return model.score(np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS)))


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per document: doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(scores(model, as_text(b.column(1))), pa.float64())], names=["doc_id", "score"])

    return rows_with_id(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
