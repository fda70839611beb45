"""The usual pipeline over a cube in one lazy plan: slice, average, group, derive, export."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from ..core import DimFrame
from ..operators import aggregate, shape
from ..operators.convert import auto_convert


def transform(
    cube: DimFrame,
    average: Sequence[str] = (),
    groups: Mapping[str, Mapping] | None = None,
    group_fun: Callable[[DimFrame], DimFrame] | None = None,
    fun: Callable[[DimFrame], DimFrame] | None = None,
    where: Mapping[str, object] | None = None,
    measures: tuple[str, Sequence] | None = None,
    convert: bool = False,
) -> DataFrame:
    """A long (or, by ``measures``, wide) table of a cube.

    In this order: the slice ``where``; the mean over dimensions ``average``;
    the levels of dimensions put into ``groups``, a new dimension ``<dim>_group``
    each; ``group_fun`` and ``fun``, functions of cubes (after averaging, and in
    one plan over all groups, which are dimensions); ``measures``, a dimension
    and its levels to spread into columns; the narrowest types of text columns.
    """
    if where:
        cube = shape.subset(cube, **where)
    if average:
        cube = aggregate.avg_dims(cube, *average)
    for name, mapping in (groups or {}).items():
        cube = shape.split_groups(cube, name, mapping, f"{name}_group")
    for f in (group_fun, fun):
        if f is not None:
            cube = f(cube)
    out = shape.pivoted(cube, *measures) if measures else cube.long()
    return auto_convert(out) if convert else out


def global_field_power_table(cube: DimFrame, chan: str = "chan", id_dim: str = "id", groups: Mapping | None = None) -> DataFrame:
    """The mean over ids of each group, then the global field power over channels."""
    if groups:
        cube = shape.split_groups(cube, id_dim, groups)
    return transform(aggregate.avg_dims(cube, id_dim), fun=lambda c: aggregate.gfp(c, chan))
