"""Labelled N-dimensional data as a tidy DataFrame.

A ``DimFrame`` has one row for each cell: a column for each dimension and one
value column. The order of a dimension's levels is data of its own, as many
operators (contrasts, runs, windows) depend on it and rows have no order. Levels
are listed where they are few and ordered by meaning; a dimension whose order is
that of its values (times, ids) lists none and may have any number of levels.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dim:
    name: str
    levels: tuple | None = None


@dataclass(frozen=True)
class DimFrame:
    df: DataFrame
    dims: tuple[Dim, ...]
    value: str = "value"
    steps: tuple[str, ...] = field(default=(), compare=False)

    @property
    def names(self) -> list[str]:
        return [d.name for d in self.dims]

    def dim(self, name: str) -> Dim:
        for d in self.dims:
            if d.name == name:
                return d
        raise KeyError(f"no dimension {name!r} among {self.names}")

    def others(self, *names: str) -> list[str]:
        """The dimensions but ``names``, which must exist."""
        for n in names:
            self.dim(n)
        return [d.name for d in self.dims if d.name not in names]

    def ordinal(self, name: str) -> Column:
        """What sorts the levels of a dimension: their place in the list, or the value itself."""
        d = self.dim(name)
        return F.col(name) if d.levels is None else F.array_position(F.array(*[F.lit(v) for v in d.levels]), F.col(name))

    def drop_dims(self, *names: str) -> tuple[Dim, ...]:
        return tuple(d for d in self.dims if d.name not in names)

    def but(self, df: DataFrame, dims: Iterable[Dim] | None = None, step: str | None = None, value: str | None = None) -> DimFrame:
        """The same kind of frame over other rows."""
        return replace(self, df=df, dims=self.dims if dims is None else tuple(dims), value=value or self.value, steps=self.steps + ((step,) if step else ()))

    def long(self) -> DataFrame:
        return self.df.select(*self.names, self.value)


def from_long(df: DataFrame, dims: Sequence[str] | Mapping[str, Sequence | None], value: str = "value") -> DimFrame:
    """A DimFrame over the rows of ``df``; a mapping gives the levels of dimensions in their order. NaN becomes null."""
    dims = {d: None for d in dims} if not isinstance(dims, Mapping) else dims
    kind = df.schema[value].dataType.simpleString()
    v = F.when(F.isnan(value), None).otherwise(F.col(value)) if kind in ("double", "float") else F.col(value)
    return DimFrame(df.select(*dims, v.alias(value)), tuple(Dim(d, tuple(ls) if ls is not None else None) for d, ls in dims.items()), value)


def from_values(spark: SparkSession, values: Sequence, dims: Mapping[str, Sequence], value: str = "value") -> DimFrame:
    """A small cube from a list of values, the first dimension changing fastest; short lists are recycled."""
    sizes = [len(ls) for ls in dims.values()]
    rows = []
    for k in range(math.prod(sizes)):
        rest, row = k, []
        for ls in dims.values():
            row.append(list(ls)[rest % len(ls)])
            rest //= len(ls)
        rows.append((*row, values[k % len(values)]))
    return from_long(spark.createDataFrame(rows, [*dims, value]), dims, value)


def decorated(names: Sequence[str | None], base: str = "_Dim") -> list[str]:
    """Names for dimensions: blanks get ``base`` and their number, repeats a suffix."""
    out: list[str] = []
    for k, n in enumerate(names, 1):
        n = n or f"{base}{k}"
        while n in out:
            n += "__"
        out.append(n)
    return out


def densified(cube: DimFrame) -> DimFrame:
    """Every combination of the levels present, null where there was no row.

    The grid is the product of each dimension's levels, so its size is that of
    the dense cube itself.
    """
    grid = None
    for d in cube.dims:
        levels = cube.df.select(d.name).distinct()
        grid = levels if grid is None else grid.crossJoin(levels)
    return cube.but(grid.join(cube.df, cube.names, "left"))


def packed(cube: DimFrame, along: str) -> DataFrame:
    """One row for each combination of the other dimensions with the array of values along one."""
    cells = F.array_sort(F.collect_list(F.struct(cube.ordinal(along).alias("o"), F.col(cube.value).alias("v"))))
    return cube.df.groupBy(*cube.others(along)).agg(F.transform(cells, lambda c: c["v"]).alias(cube.value))


def unpacked(df: DataFrame, others: Sequence[str], along: str, levels: Sequence, value: str = "value") -> DimFrame:
    """Inverse of ``packed``."""
    rows = df.select(*others, F.posexplode(value).alias("_o", value))
    named = rows.withColumn(along, F.get(F.array(*[F.lit(v) for v in levels]), F.col("_o")))
    return DimFrame(named.select(*others, along, value), (*(Dim(o) for o in others), Dim(along, tuple(levels))), value)
