"""Contrasts between levels, and sweeping statistics out of series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Dim, DimFrame


def pairwise(levels: Sequence) -> dict[str, dict]:
    """All pairs of levels, the later minus the earlier."""
    return {f"{b}-{a}": {a: -1.0, b: 1.0} for a, b in combinations(levels, 2)}


def side_name(weights: Mapping, sign: float) -> str:
    parts = [(v, abs(w)) for v, w in weights.items() if w * sign > 0]
    named = "+".join(f"{v}" if w == 1 else f"{w:.4g}*{v}" for v, w in parts)
    return f"({named})" if len(parts) > 1 else named


def contrast_name(weights: Mapping) -> str:
    """``plus side - minus side``, weights to four digits, several levels in parentheses."""
    plus, minus = side_name(weights, 1), side_name(weights, -1)
    return f"{plus}-{minus}" if minus else plus


def compare_levels(cube: DimFrame, name: str, contrasts: Mapping[str, Mapping] | Sequence[Mapping] | None = None) -> DimFrame:
    """Weighted sums over a dimension's levels; by default all differences of pairs.

    A null in any level of the dimension makes a cell's contrasts null. The
    weights, levels by contrasts, are broadcast: the dimension lists its levels.
    """
    levels = cube.dim(name).levels
    if contrasts is None:
        if levels is None:
            raise ValueError(f"the levels of {name} are not listed; name contrasts")
        contrasts = pairwise(levels)
    if not isinstance(contrasts, Mapping):
        contrasts = {contrast_name(w): w for w in contrasts}
    others = cube.others(name)
    v = F.col(cube.value)
    sums = []
    for weights in contrasts.values():
        w = F.coalesce(F.create_map(*[F.lit(x) for k, x in weights.items() for x in (k, float(x))])[F.col(name)], F.lit(0.0))
        sums.append(F.when(F.count(v) == F.count(F.lit(1)), F.sum(w * v)))
    wide = cube.df.groupBy(*others).agg(*[s.alias(f"_c{k}") for k, s in enumerate(sums)])
    cells = F.array(*[F.struct(F.lit(n).alias(name), F.col(f"_c{k}").alias(cube.value)) for k, n in enumerate(contrasts)])
    long = wide.select(*others, F.inline(cells))
    return cube.but(long, [Dim(name, tuple(contrasts)) if d.name == name else d for d in cube.dims])


#: The operations of ``sweep``, as functions of a value and a statistic.
SWEEPS = {
    "-": lambda v, s: v - s,
    "+": lambda v, s: v + s,
    "*": lambda v, s: v * s,
    "/": lambda v, s: v / F.nullif(s, F.lit(0.0)),
    "^": lambda v, s: F.pow(v, s),
    "==": lambda v, s: (v == s).cast("double"),
    "!=": lambda v, s: (v != s).cast("double"),
    "<": lambda v, s: (v < s).cast("double"),
    "<=": lambda v, s: (v <= s).cast("double"),
    ">": lambda v, s: (v > s).cast("double"),
    ">=": lambda v, s: (v >= s).cast("double"),
}


def sweep(cube: DimFrame, stats: DataFrame, on: Sequence[str], op: str = "-", stat: str = "stat") -> DimFrame:
    """Combines each value with a statistic (a column of ``stats``) that has a row for each combination of ``on``.

    A null in either gives null; a division by 0 gives null.
    """
    rows = cube.df.join(stats.select(*on, F.col(stat).alias("_s")), list(on), "left")
    return cube.but(rows.withColumn(cube.value, SWEEPS[op](F.col(cube.value), F.col("_s"))).drop("_s"))


def interaction_contrasts(means: DataFrame, a: str, b: str, a_levels: Sequence, b_levels: Sequence, others: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Differences of differences of all pairs of levels of two factors, named ``a1-a2.b1-b2`` (the later minus the earlier)."""
    v = F.col(value)
    cells = []
    for a1, a2 in combinations(a_levels, 2):
        for b1, b2 in combinations(b_levels, 2):
            sign = lambda c, x, y: F.when(F.col(c) == y, 1.0).when(F.col(c) == x, -1.0).otherwise(0.0)
            cells.append((f"{a2}-{a1}.{b2}-{b1}", F.sum(v * sign(a, a1, a2) * sign(b, b1, b2))))
    wide = means.groupBy(*others).agg(*[c.alias(f"_c{k}") for k, (_, c) in enumerate(cells)])
    return wide.select(*others, F.inline(F.array(*[F.struct(F.lit(n).alias("contrast"), F.col(f"_c{k}").alias(value)) for k, (n, _) in enumerate(cells)])))


def weighted_sums(cube: DimFrame, name: str, weights: DataFrame, into: str) -> DataFrame:
    """The product of series with a matrix given as rows (``name``, ``into``, weight)."""
    joined = cube.df.join(weights, name)
    return joined.groupBy(*cube.others(name), into).agg(F.sum(F.col("weight") * F.col(cube.value)).alias(cube.value))


def as_column(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)
