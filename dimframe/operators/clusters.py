"""Threshold-free cluster enhancement by a component tree.

As the threshold falls, clusters of a plane only grow and join, so they form a
tree: a node is a cluster between the threshold at which it arose and the one at
which it became part of a larger one, and has one size in between. Each node's
gain is found once and handed down; a cell's enhancement is the sum of the gains
above it. Links are taken threshold by threshold, all of one at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import DimFrame
from .permuted import BLOCK


class Grid:
    """Cells of channels by times, and pairs of cells next to each other: channels near (or the same), times the same or one apart."""

    def __init__(self, neighbours: np.ndarray, times: int):
        near = np.asarray(neighbours, bool)
        near = near | near.T | np.eye(len(near), dtype=bool)
        self.size, at, pairs = len(near) * times, np.arange(times), []
        for step in range(min(2, times)):
            a, b = np.nonzero(near if step else np.triu(near, 1))  # one step apart: both orders of channels
            one, two = a[:, None] * times + at[: times - step], b[:, None] * times + at[step:]
            pairs.append((one.ravel(), two.ravel()))
        self.a, self.b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int), np.zeros(0, int))


def _roots(top: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The clusters that hold some cells; ways walked are shortened."""
    root = top[at]
    while (up := top[root]) is not root and (up != root).any():
        root = up
    top[at] = root
    return root


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least of ``n`` members that each is linked to."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def one_sided(x: np.ndarray, grid: Grid, thresholds: np.ndarray, gains: np.ndarray, e: float) -> np.ndarray:
    """The sum, over thresholds that a cell reaches, of its cluster's size to the power ``e`` times the threshold's gain."""
    reach = np.searchsorted(thresholds, x, side="right")  # thresholds that a cell reaches
    if not reach.any():
        return np.zeros(len(x))
    total = np.concatenate(([0.0], np.cumsum(gains)))
    n = len(x)
    top, parent, level, size = np.arange(2 * n), np.full(2 * n, -1), np.zeros(2 * n, int), np.ones(2 * n)
    level[:n], made, batches = reach, n, []
    weight = np.minimum(reach[grid.a], reach[grid.b])
    order = np.argsort(-weight, kind="stable")
    order = order[: np.count_nonzero(weight)]
    cuts = np.flatnonzero(np.diff(weight[order])) + 1
    for links in np.split(order, cuts) if len(order) else []:
        a, b = _roots(top, grid.a[links]), _roots(top, grid.b[links])
        apart = a != b
        if not apart.any():
            continue
        nodes, places = np.unique(np.concatenate((a[apart], b[apart])), return_inverse=True)
        half = len(places) // 2
        label, place = np.unique(_joined(places[:half], places[half:], len(nodes)), return_inverse=True)
        new = made + np.arange(len(label))
        size[new] = np.bincount(place, size[nodes], len(label))
        level[new] = weight[links[0]]
        parent[nodes] = top[nodes] = new[place]
        batches.append(new)
        made += len(label)
    above = np.where(parent[:made] >= 0, level[parent[:made]], 0)
    out = size[:made] ** e * (total[level[:made]] - total[above])
    for nodes in [*batches[::-1], np.arange(n)]:
        down = nodes[parent[nodes] >= 0]
        out[down] += out[parent[down]]
    return np.where(reach > 0, out[:n], 0.0)


def tfce(plane: np.ndarray, neighbours: np.ndarray | Grid, e: float = 0.66, h: float = 2.0, steps: int = 50) -> np.ndarray:
    """Threshold-free cluster enhancement of a channel-by-time plane.

    ``neighbours`` is a boolean matrix of channels, or the grid made of one. At
    each threshold, in the middle of one of ``steps`` equal parts of the largest
    absolute value, each cell of a cluster gains size^e * threshold^h * step;
    clusters of negative cells lose it. Cells are neighbours if their channels
    are (or are the same) and their times are next to each other or the same.
    """
    top = np.nanmax(np.abs(plane), initial=0.0)
    if not top > 0:
        return np.zeros(plane.shape)
    grid = neighbours if isinstance(neighbours, Grid) else Grid(neighbours, plane.shape[1])
    step = top / steps
    thresholds = step / 2 + np.arange(steps) * step
    gains, out = thresholds**h * step, np.zeros(plane.size)
    for sign in (1, -1):
        out += sign * one_sided(np.where(np.isnan(plane), -np.inf, sign * plane).ravel(), grid, thresholds, gains, e)
    return out.reshape(plane.shape)


def links(levels: Sequence, neighbours: dict) -> np.ndarray:
    """The boolean matrix of channels of a mapping from a channel to those near it; near is near both ways."""
    return np.array([[b in neighbours.get(a, ()) or a in neighbours.get(b, ()) for b in levels] for a in levels])


def tfce_cube(cube: DimFrame, neighbours: dict, chan: str = "chan", time: str = "time", e: float = 0.66, h: float = 2.0, steps: int = 50) -> DimFrame:
    """TFCE of each channel-by-time plane; ``neighbours`` maps a channel to those near it."""
    others, value = cube.others(chan, time), cube.value

    def run(g: pd.DataFrame) -> pd.DataFrame:
        wide = g.pivot(index=chan, columns=time, values=value)
        wide = wide.sort_index().sort_index(axis=1)
        made = pd.DataFrame(tfce(wide.to_numpy(float), links(wide.index, neighbours), e, h, steps), index=wide.index, columns=wide.columns)
        long = made.stack().rename(value).reset_index()
        for o in others:
            long[o] = g[o].iloc[0]
        return long[[*others, chan, time, value]]

    schema = ", ".join(f"`{n}` {cube.df.schema[n].dataType.simpleString()}" for n in [*others, chan, time]) + f", `{cube.value}` double"
    rows = cube.df.select(*others, chan, time, F.col(cube.value).cast("double").alias(cube.value))
    return cube.but(rows.groupBy(*others).applyInPandas(run, schema))


def enhanced_maxima(blocks: DataFrame, outside: Sequence[str], neighbours: dict, by: Sequence[str], chan: str, time: str, e: float, h: float, steps: int) -> DataFrame:
    """``most``: the largest absolute enhanced statistic of each shuffle and combination of ``by``.

    ``blocks`` are statistics by ``permuted.by_blocks``. A plane meets with the
    statistics of a block of shuffles, numbers in arrays; of each shuffle one
    number goes on. ``by`` may name dimensions and modelterm.
    """
    keys = [*[o for o in outside if o not in (chan, time)], "modelterm", "block"]
    kept = [c for c in keys if c in by]
    fields = "".join(f"`{c}` {blocks.schema[c].dataType.simpleString()}, " for c in kept)

    def run(g: pd.DataFrame) -> Iterator[pd.DataFrame] | pd.DataFrame:
        chans, c = np.unique(g[chan].to_numpy(), return_inverse=True)
        times, t = np.unique(g[time].to_numpy(), return_inverse=True)
        stats, grid = np.stack(g["stats"].to_list()), Grid(links(chans.tolist(), neighbours), len(times))
        out = pd.DataFrame({k: [g[k].iloc[0]] * stats.shape[1] for k in kept})
        out["perm"] = g["block"].iloc[0] * BLOCK + np.arange(stats.shape[1])
        most = []
        for s in stats.T:
            plane = np.full((len(chans), len(times)), np.nan)
            plane[c, t] = s
            most.append(np.abs(tfce(plane, grid, e, h, steps)).max())
        out["most"] = most
        return out

    planes = blocks.groupBy(*keys).applyInPandas(run, f"{fields}perm int, most double")
    return planes.groupBy(*kept, "perm").agg(F.max("most").alias("most"))
