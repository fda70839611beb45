"""Moving statistics with a width for each place, and any function of a window.

A series is one row, an array in its order; statistics of all its windows come
from prefix sums (mean, sd), from a table of minima over powers of two (min,
max), or from a function of a matrix of windows, a row each. Only one series
need fit into a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import DimFrame

#: Values of windows that are laid out at once.
AT_ONCE = 2_000_000


def bounds(widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and place after the last of the window around each place; an even width takes one more value before than after."""
    at, n = np.arange(len(widths)), len(widths)
    return np.maximum(at - widths // 2, 0), np.minimum(at + widths - widths // 2, n)


def sums_over(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(x)))
    return total[last] - total[first]


def moments(x: np.ndarray, first: np.ndarray, last: np.ndarray, stat: str) -> np.ndarray:
    """Means or standard deviations of windows by prefix sums, NaN being no value."""
    known = ~np.isnan(x)
    middle = x[known].mean() if known.any() else 0.0
    y = np.where(known, x - middle, 0.0)  # centred, so that squares do not swamp the differences
    n = sums_over(known.astype(float), first, last)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = sums_over(y, first, last) / n
        if stat == "mean":
            return np.where(n > 0, mean + middle, np.nan)
        return np.where(n > 1, np.sqrt(np.maximum(sums_over(y * y, first, last) - n * mean**2, 0.0) / (n - 1)), np.nan)


def least(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minima of windows, from minima over all ranges of 1, 2, 4, ... places; NaN where a window holds nothing."""
    rows = [np.where(np.isnan(x), np.inf, x)]
    size = last - first
    for k in range(int(size.max(initial=1)).bit_length() - 1):
        rows.append(np.minimum(rows[-1][: -(1 << k)], rows[-1][1 << k :]))
    level = np.maximum(np.frexp(np.maximum(size, 1))[1] - 1, 0)
    out = np.full(len(first), np.inf)
    for k, row in enumerate(rows):
        at = np.flatnonzero((level == k) & (size > 0))
        out[at] = np.minimum(row[first[at]], row[last[at] - (1 << k)])
    return np.where(np.isinf(out), np.nan, out)


def over_windows(x: np.ndarray, first: np.ndarray, last: np.ndarray, fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``fn`` of matrices of windows, a row each, windows of equal size together; NaN for windows without places."""
    size, out = last - first, np.full(len(first), np.nan)
    for n in np.unique(size[size > 0]):
        at = np.flatnonzero(size == n)
        view = np.lib.stride_tricks.sliding_window_view(x, n)
        for a in range(0, len(at), max(1, AT_ONCE // n)):
            some = at[a : a + max(1, AT_ONCE // n)]
            made = np.asarray(fn(view[first[some]]), float)
            if made.shape != (len(some),):
                raise ValueError(f"a function of {len(some)} windows must give as many numbers, it gave the shape {made.shape}")
            out[some] = made
    return out


def without_nan(fn: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """A function of matrices that skips NaN; rows of nothing else give NaN."""

    def run(windows: np.ndarray) -> np.ndarray:
        out, some = np.full(len(windows), np.nan), ~np.isnan(windows).all(1)
        out[some] = fn(windows[some])
        return out

    return run


def _mad(windows: np.ndarray) -> np.ndarray:
    return 1.4826 * np.nanmedian(np.abs(windows - np.nanmedian(windows, 1, keepdims=True)), 1)


def statistic(stat: str | Callable[[np.ndarray], np.ndarray], prob: float = 0.5) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """A function of a series and its windows' bounds."""
    if callable(stat):
        return lambda x, a, z: over_windows(x, a, z, stat)
    known = {"median": lambda w: np.nanmedian(w, 1), "quantile": lambda w: np.nanquantile(w, prob, 1), "mad": _mad}
    if stat in ("mean", "sd"):
        return lambda x, a, z: moments(x, a, z, stat)
    if stat == "min":
        return least
    if stat == "max":
        return lambda x, a, z: -least(-x, a, z)
    if stat not in known:
        raise ValueError(f"no moving statistic {stat!r}")
    return lambda x, a, z: over_windows(x, a, z, without_nan(known[stat]))


def rolled_by(cube: DimFrame, along: str, width: int | Column | DataFrame, stat: str | Callable[[np.ndarray], np.ndarray] = "mean", prob: float = 0.5, endrule: str = "shrink") -> DimFrame:
    """A centred moving statistic whose window may have another width at each place.

    ``width``: a number, a column of numbers over the cube's rows, or a frame
    with some dimensions, ``along`` among them, and ``width``. ``stat``: mean, sd,
    min, max, median, quantile or mad, which skip nulls, or a function of a matrix
    (windows by places, NaN for null) that gives a number for each row. Windows
    shrink at the ends, or with ``endrule='NA'`` give null there. A width that is
    null or below 1 gives null.
    """
    if endrule not in ("shrink", "NA"):
        raise ValueError(f"no rule {endrule!r} for the ends")
    others, rows = cube.others(along), cube.df
    if isinstance(width, DataFrame):
        on = [c for c in width.columns if c in cube.names]
        rows = rows.join(width.select(*on, F.col("width").alias("_w")), on, "left")
    else:
        rows = rows.withColumn("_w", width if isinstance(width, Column) else F.lit(width))
    kind = cube.df.schema[along].dataType
    cells = F.array_sort(F.collect_list(F.struct(cube.ordinal(along).alias("o"), F.col(along).alias("l"), F.col(cube.value).cast("double").alias("v"), F.col("_w").cast("long").alias("w"))))
    series = rows.groupBy(*others).agg(cells.alias("s"))
    run = statistic(stat, prob)

    @F.pandas_udf("array<double>")
    def made(values: pd.Series, widths: pd.Series) -> pd.Series:
        out = []
        for v, w in zip(values, widths, strict=True):
            x = np.array([np.nan if y is None else y for y in v], float)
            size = np.array([0 if y is None or np.isnan(y) or y < 1 else y for y in w], np.int64)
            a, z = bounds(size)
            y = run(x, a, np.maximum(a, z))
            y = np.where((size < 1) | ((endrule == "NA") & (z - a < size)), np.nan, y)
            out.append([None if np.isnan(k) else float(k) for k in y])
        return pd.Series(out)

    part = lambda k: F.transform("s", lambda c: c[k])
    shown = series.select(*others, F.arrays_zip(part("l").alias("l"), made(part("v"), part("w")).alias("v")).alias("z")).select(*others, F.explode("z").alias("z"))
    return cube.but(shown.select(*others, F.col("z.l").cast(kind).alias(along), F.col("z.v").alias(cube.value)))
