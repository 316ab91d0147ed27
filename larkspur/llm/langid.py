"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of letter n-grams (two and three characters of case-folded words,
hashed to DIMENSIONS).  Each language has several centroids, found by clustering its training rows; a text
takes the language of the centroid with the highest cosine.  A text farther from that centroid than nearly
all of its training rows were is marked rejected (the prediction stays, for callers that must have one).

The fit takes a sample of at most about FIT_ROWS rows of each language (a documented bound, chosen by a
hash of the id); every text is then scored whole.

Defined results: a null text, or one without letters, is "und" with score 0; null languages are not
learned from; with no training rows at all, everything is "und" with score 0; rows with equal or null
doc_id stay rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import as_text, rows_with_id
from larkspur.llm.training import bounded_sample

DIMENSIONS = 1 << 12
FIT_ROWS = 600
CLUSTERS = 3
SHARPNESS = 30.0
REJECT_QUANTILE, REJECT_SLACK = 0.999, 1.15
SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean, distance double"
_FOLD: list[np.ndarray] = []


def _folding() -> np.ndarray:
    """Code point -> lower-case code point of a letter, 32 of anything else."""
    if not _FOLD:
        t = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(t)
    return _FOLD[0]


def has_letter(text: str) -> bool:
    return bool(len(text)) and bool((_folding()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")] != 32).any())


def gram_counts(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Counts (texts x dimensions) of hashed n-grams; a row of zeros has no letter."""
    fold, rows = _folding(), np.zeros((len(texts), dimensions), np.float32)
    for k, t in enumerate(texts):
        c = fold[np.frombuffer(f" {t} ".encode("utf-32-le", "replace"), "<u4")]
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        if len(c) < 3:
            continue
        pair = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
        three = (pair[:-1] ^ (pair[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F)
        h = np.concatenate([pair, three])
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x7FEB352D)
        h ^= h >> np.uint32(15)
        rows[k] = np.bincount(h & np.uint32(dimensions - 1), minlength=dimensions)
    return rows


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n == 0, 1, n)


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]  # of each centroid
    limits: np.ndarray  # distance beyond which a centroid's text is rejected

    def vectors(self, texts: list[str]) -> np.ndarray:
        return _unit(np.log1p(gram_counts(texts, len(self.idf))) * self.idf)

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool, float]]:
        if not self.langs:
            return [("und", 0.0, True, 1.0)] * len(texts)
        v = self.vectors(texts)
        cosine = v @ self.centroids.T
        names = sorted(set(self.langs))
        member = np.array([[lang == n for n in names] for lang in self.langs])
        best = np.stack([cosine[:, member[:, j]].max(1) for j in range(len(names))], 1)
        share = np.exp(SHARPNESS * (best - best.max(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        out = []
        for k in range(len(texts)):
            if not v[k].any():
                out.append(("und", 0.0, True, 1.0))
                continue
            j, c = int(best[k].argmax()), int(cosine[k].argmax())
            gap = float(max(0.0, 1 - cosine[k, c]))
            out.append((names[j], float(min(1.0, share[k, j])), bool(gap > self.limits[c]), gap))
        return out


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart first rows; no randomness."""
    chosen = [int((x @ _unit(x.mean(0, keepdims=True)).T)[:, 0].argmax())]
    while len(chosen) < min(k, len(x)):
        far = (x @ x[chosen].T).max(1)
        if far.min() > 0.999:
            break
        chosen.append(int(far.argmin()))
    centre = x[chosen]
    for _ in range(rounds):
        near = (x @ centre.T).argmax(1)
        centre = np.stack([_unit(x[near == j].mean(0, keepdims=True))[0] if (near == j).any() else centre[j] for j in range(len(centre))])
    return centre


def fit(training: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows: int = FIT_ROWS, clusters: int = CLUSTERS, dimensions: int = DIMENSIONS) -> LanguageModel:
    usable = training.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sample = sorted(bounded_sample(usable, "k", "lang", rows).select("lang", "k", "text").collect(), key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2]))
    sample = [r for r in sample if has_letter(r[2])]
    if not sample:
        return LanguageModel(np.ones(dimensions, np.float32), np.zeros((0, dimensions), np.float32), [], np.zeros(0))
    counts = gram_counts([r[2] for r in sample], dimensions)
    idf = (np.log((1 + len(sample)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    x, langs = _unit(np.log1p(counts) * idf), np.array([r[0] for r in sample])
    centroids, names, limits = [], [], []
    for lang in sorted(set(langs)):
        own = x[langs == lang]
        centre = _cluster(own, clusters)
        cosine = own @ centre.T
        for j in range(len(centre)):
            mine = 1 - cosine[cosine.argmax(1) == j, j]
            limits.append(float(np.quantile(mine, REJECT_QUANTILE)) * REJECT_SLACK if len(mine) else 1.0)
            names.append(str(lang))
        centroids.append(centre)
    return LanguageModel(idf, np.concatenate(centroids), names, np.array(limits))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per document (SCHEMA).  The model is a fixed number of vectors and travels with the function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        for b in batches:
            found = []
            texts = as_text(b.column(1))
            for at in range(0, len(texts), 256):
                found += model.predict(texts[at : at + 256])
            cols = list(zip(*found, strict=True)) if found else [[]] * 4
            yield pa.record_batch([b.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.float64())], names=["doc_id", "lang_pred", "score", "rejected", "distance"])

    return rows_with_id(docs, id_col, text_col).mapInArrow(run, SCHEMA)
