"""Bounded samples of labelled rows, and monotone calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids are in no fold."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def bounded_sample(rows: DataFrame, key: str, strata: str, per_stratum: int, weight: str | None = None) -> DataFrame:
    """About per_stratum rows of each value of strata (all, where there are no more), chosen by a hash of key.

    With weight, a column of that name tells how many rows each one stands for.

    A count for each stratum gives its rate; the rate is then a filter on the scan, so no row is
    shuffled or ranked.  The number of strata must be small by nature (languages, labels).
    """
    counts = {r[0]: r[1] for r in rows.groupBy(strata).count().collect() if r[0] is not None}
    if not counts:
        none = rows.limit(0)
        return none.withColumn(weight, F.lit(1.0)) if weight else none
    rate = F.create_map(*[x for s, n in counts.items() for x in (F.lit(s), F.lit(min(1.0, per_stratum / n)))])
    at = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    some = rows.filter(at < rate[F.col(strata)])
    return some.withColumn(weight, 1 / rate[F.col(strata)]) if weight else some


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (x, mean y) of the best non-decreasing fit; equal x are pooled first."""
    w = np.ones(len(x)) if w is None else w
    order = np.argsort(x, kind="stable")
    levels, first = np.unique(x[order], return_index=True)
    sw = np.add.reduceat(w[order], first)
    sy = np.add.reduceat((w * y)[order], first)
    pools: list[list[float]] = []  # weight, weighted sum, lowest x, highest x
    for lx, a, b in zip(levels, sw, sy, strict=True):
        pools.append([a, b, lx, lx])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            a2, b2, _, hi = pools.pop()
            pools[-1][0] += a2
            pools[-1][1] += b2
            pools[-1][3] = hi
    xs = np.array([v for p in pools for v in (p[2], p[3])])
    ys = np.array([v for p in pools for v in (p[1] / p[0],) * 2])
    return xs, ys


def calibrated(x: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Value of the isotonic fit, linear between knots, held beyond them; x itself, cut to 0..1, without knots."""
    return np.interp(x, *knots) if len(knots[0]) else np.clip(x, 0, 1)
