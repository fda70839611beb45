"""t tests and ANOVA with cluster enhancement and permutation, in one call.

A relabelling is a row of a matrix of permutations by ids, which is metadata of
the analysis: its size is checked, and it travels with the task. Each cell's
values of all ids are one row, and the statistics of all relabellings follow
from it by products with that matrix, so no row is made for a cell, an id and a
permutation. Planes of channels by times are dealt out by permutation for the
enhancement; of each only the largest value goes on. The data never reach the
driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Dim, DimFrame
from .anova import anova
from .clusters import enhanced_maxima, tfce_cube
from .permutation import corrected_p
from .permuted import BROADCAST_BYTES, Design, Given, Shuffles, by_blocks, design_of, each_shuffle, largest, permuted_f, responses
from .ttest import random_groups, random_signs

#: A variance below this share of the mean square is rounding.
ROUNDING = 1e-12


def t_values(y: np.ndarray, labels: np.ndarray, kind: str = "welch") -> np.ndarray:
    """t of each row of ``y`` (cells by ids, NaN is missing) for each row of ``labels`` (permutations by ids): cells by permutations.

    ``kind``: welch or pooled (labels 1 and 2, the first less the second), or one
    (labels are signs). NaN where a group has fewer than two values or nothing varies.
    """
    known = ~np.isnan(y)
    count = np.maximum(known.sum(1, keepdims=True), 1)
    filled = np.where(known, y, 0.0)
    known = known.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        if kind == "one":
            n, sums, squares = known.sum(1, keepdims=True), filled @ labels.T.astype(float), (filled**2).sum(1, keepdims=True)
            variance = (squares - sums**2 / n) / (n - 1)
            return np.where((n > 1) & (variance > ROUNDING * squares / n), sums / n / np.sqrt(variance / n), np.nan)
        filled = (filled - filled.sum(1, keepdims=True) / count) * known
        scale = (filled**2).sum(1, keepdims=True) / count
        parts = []
        for k in (1, 2):
            g = (labels == k).T.astype(float)
            n, sums = known @ g, filled @ g
            parts.append((n, sums / n, (filled**2 @ g - sums**2 / n) / (n - 1)))
        (n1, m1, v1), (n2, m2, v2) = parts
        if kind == "welch":
            error = v1 / n1 + v2 / n2
        elif kind == "pooled":
            error = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)
        else:
            raise ValueError(f"no kind {kind!r} of t test")
        return np.where((n1 > 1) & (n2 > 1) & (error > ROUNDING * scale), (m1 - m2) / np.sqrt(error), np.nan)


def t_blocks(cube: DimFrame, labels: np.ndarray, ids: Sequence, kind: str = "welch", id_dim: str = "id", by: Sequence[str] | None = None) -> DataFrame:
    """The t of every cell for every row of ``labels``, in blocks of rows; with ``by`` the largest of each combination, see ``permuted.by_blocks``.

    Ids that are not among ``ids`` are left out; a null value is missing for its
    cell alone. A cell without any value has no rows.
    """
    labels = np.asarray(labels, np.int8)
    if labels.nbytes > BROADCAST_BYTES:
        raise ValueError(f"{len(labels)} permutations of {len(ids)} ids are more than may be broadcast; pass them in parts")
    outside = cube.others(id_dim)
    design = Design(list(ids), [()], (), {}, {}, {}, {})

    def statistic(rows: pd.DataFrame, first: int, last: int) -> np.ndarray:
        y = np.full((len(rows), len(ids)), np.nan)
        for row, k, v in zip(y, rows["_k"], rows["_v"], strict=True):
            row[k] = v
        return t_values(y, labels[first:last], kind)[None]

    return by_blocks(responses(cube, design, outside, id_dim), outside, ["t"], len(labels), len(ids), statistic, by)


def permuted_t(cube: DimFrame, labels: np.ndarray, ids: Sequence, kind: str = "welch", id_dim: str = "id") -> DimFrame:
    """``stat`` of every cell for every row of ``labels``, numbered as dimension ``perm``; see ``t_blocks``."""
    made = each_shuffle(t_blocks(cube, labels, ids, kind, id_dim), cube.others(id_dim))
    return DimFrame(made, (*cube.drop_dims(id_dim), Dim("perm")), "stat")


def permuted_maxima(cube: DimFrame, labels: np.ndarray, ids: Sequence, kind: str = "pooled", id_dim: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """``most``: the largest absolute t over all cells of each combination of ``by``, for each row of ``labels``; ``kind`` as in ``t_values``."""
    return largest(t_blocks(cube, labels, ids, kind, id_dim, by), list(by))


def ttest_tfce(
    cube: DimFrame, neighbours: dict, n: int, groups: dict | None = None, seed: int = 1, kind: str | None = None, by: Sequence[str] = (), id_dim: str = "id", chan: str = "chan", time: str = "time", e: float = 0.66, h: float = 2.0, steps: int = 50,
    relabellings: np.ndarray | None = None,
) -> DataFrame:
    """stat, tfce and p_corr of every cell: a t test, its enhancement, and maxima over ``n`` relabellings.

    With ``groups`` (id to one of two groups) independent samples, Welch's t
    unless ``kind`` is pooled; without, one sample against 0, whose signs change
    (for pairs pass their differences). The maxima are over all cells of a
    combination of ``by``. A cell whose statistic is null enhances nothing.
    ``relabellings``, a matrix of groups or signs of the sorted ids, takes the place of ``n``
    and ``seed``.
    """
    if groups is None:
        most = BROADCAST_BYTES // max(n, 1)  # a sign takes a byte at least
        ids = sorted(r[0] for r in cube.df.select(id_dim).where(F.col(id_dim).isNotNull()).distinct().limit(most + 1).collect())
        if len(ids) > most:
            raise ValueError("too many ids for so many relabellings")
        kind, seen, relabelled = "one", np.ones((1, len(ids)), int), random_signs(len(ids), n, seed)
    else:
        ids, levels = sorted(groups), sorted(set(groups.values()))
        if len(levels) != 2:
            raise ValueError(f"two groups are asked for, there are {len(levels)}")
        labels = [levels.index(groups[i]) + 1 for i in ids]
        kind, seen, relabelled = kind or "welch", np.array([labels]), random_groups(labels, n, seed)
    relabelled = relabelled if relabellings is None else np.asarray(relabellings)
    observed = permuted_t(cube, seen, ids, kind, id_dim)
    observed = observed.but(observed.df.drop("perm"), observed.drop_dims("perm"))
    clusters = tfce_cube(observed, neighbours, chan, time, e, h, steps).df.withColumnRenamed("stat", "tfce")
    cells = observed.df.join(clusters, observed.names)
    maxima = enhanced_maxima(t_blocks(cube, relabelled, ids, kind, id_dim), cube.others(id_dim), neighbours, by, chan, time, e, h, steps)
    return corrected_p(cells, maxima, by, stat="tfce")


def anova_tfce(
    cube: DimFrame,
    subjects: DataFrame | None,
    neighbours: dict,
    n: int = 999,
    between: Sequence[str] = (),
    within: Sequence[str] = (),
    seed: int = 1,
    id_dim: str = "id",
    chan: str = "chan",
    time: str = "time",
    e: float = 0.66,
    h: float = 1.0,
    steps: int = 50,
    covariates: Sequence[str] = (),
    what: str = "residuals",
    by: Sequence[str] = (),
    shuffles: Shuffles | Given | None = None,
) -> DataFrame:
    """ANOVA of every cell with ``tfce`` of F and p_corr: how often the largest enhanced F of a term, over all cells of a combination of ``by``, is greater after a shuffle.

    Every term has its own maxima. ``what`` and ``shuffles`` as in ``anova_permuted``.
    """
    observed = anova(cube, subjects, between, within, id_dim, covariates=covariates)
    dims = (*cube.drop_dims(id_dim, *within), Dim("modelterm"))
    planes = tfce_cube(DimFrame(observed, dims, "stat"), neighbours, chan, time, e, h, steps)
    cells = observed.join(planes.df.withColumnRenamed("stat", "tfce"), planes.names)
    design, keys = design_of(cube, subjects, between, within, covariates, id_dim), [*by, "modelterm"]
    blocks = permuted_f(cube, design, shuffles or Shuffles(design, n, seed), what, id_dim)
    return corrected_p(cells, enhanced_maxima(blocks, cube.others(id_dim, *within), neighbours, keys, chan, time, e, h, steps), keys, stat="tfce")
