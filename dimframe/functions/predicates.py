"""Composable predicates on values or on the levels of a dimension.

A predicate compiles to a boolean Column, null counting as false, or, if it looks
at more than a cell, to a plan that runs before the filter. It may be
limited to a slice of the cube (``subset``), be taken from one slice for all
levels (``expand``), be negated, and be optional: in a combination with a strict
predicate an optional one gives way when the combination holds nowhere.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import DimFrame

#: Fixed value: the tolerance of comparisons, the square root of the double's epsilon.
TOLERANCE = 1.490116119384766e-08

Test = Callable[[DimFrame, Column], Column]


@dataclass(frozen=True)
class Predicate:
    test: Test
    strict: bool = True
    negate: bool = False
    subset: Mapping[str, object] | None = None
    expand: Mapping[str, object] | None = None
    parts: tuple[Predicate, ...] = ()
    how: str = ""
    #: for tests of more than a cell: the cube's dimensions and a boolean column of the name given
    plan: Callable[[DimFrame, str], DataFrame] | None = None

    def options(self, **kw) -> Predicate:
        return replace(self, **kw)

    def __invert__(self) -> Predicate:
        return replace(self, negate=not self.negate)

    def __and__(self, other: Predicate) -> Predicate:
        return _combined("and", self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return _combined("or", self, other)

    def __xor__(self, other: Predicate) -> Predicate:
        return _combined("xor", self, other)


def _combined(how: str, a: Predicate, b: Predicate) -> Predicate:
    return Predicate(lambda cube, v: F.lit(False), a.strict or b.strict, parts=(a, b), how=how)


def slice_of(where: Mapping[str, object]) -> Column:
    """A slice of a cube: a level, a list of levels or a test of a column for each dimension named."""

    def one(d: str, v: object) -> Column:
        return v(F.col(d)) if callable(v) else F.col(d).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(d) == v

    return reduce(lambda x, y: x & y, (one(d, v) for d, v in where.items()), F.lit(True))


def marked(cube: DimFrame, predicate: Predicate, name: str = "hit") -> DataFrame:
    """The cube's rows with a boolean column: where the predicate holds."""
    p, out = predicate, cube.df
    if p.parts:
        a, b = (f"_{name}{k}" for k in "ab")
        rows = marked(cube.but(marked(cube, p.parts[0], a)), p.parts[1], b)
        x, y = F.col(a), F.col(b)
        both = {"and": x & y, "or": x | y, "xor": x != y}[p.how]
        strict = [q.strict for q in p.parts]
        if not all(strict):
            # whether it holds anywhere: partial aggregates make one row, which is joined to every row
            found = rows.agg(F.coalesce(F.bool_or(both), F.lit(False)).alias("_any"))
            rows = rows.crossJoin(F.broadcast(found))
            fallback = x if strict[0] else y if strict[1] else F.lit(False)
            both = F.when(F.col("_any"), both).otherwise(fallback)
        rows = rows.withColumn(name, ~both if p.negate else both)
        return rows.drop(a, b, "_any")
    v = F.col(cube.value)
    if p.expand:
        over = [d for d in cube.names if d not in p.expand]
        if set(p.expand) & set(p.subset or {}):
            raise ValueError("a dimension is both expanded and subset")
        seen = cube.but(cube.df.where(slice_of(p.expand)))
        hits = (_planned(seen, p, name) if p.plan else seen.df.withColumn(name, _plain(seen, p, v))).select(*over, name)
        return out.join(hits, over, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return _planned(cube, p, name) if p.plan else out.withColumn(name, _plain(cube, p, v))


def _planned(cube: DimFrame, p: Predicate, name: str) -> DataFrame:
    """The rows with the outcome of a predicate that looks at more than a cell; with a slice it sees the slice alone."""
    seen = cube.but(cube.df.where(slice_of(p.subset)).select(*cube.names, cube.value)) if p.subset else cube.but(cube.long())
    hits = p.plan(seen, name).select(*cube.names, name)
    hit = F.coalesce(F.col(name), F.lit(False))
    return cube.df.join(hits, cube.names, "left").withColumn(name, ~hit if p.negate else hit)


def _plain(cube: DimFrame, p: Predicate, v: Column) -> Column:
    hit = F.coalesce(p.test(cube, v), F.lit(False))
    # outside its slice a predicate is false; negation comes last, so a negated one is true there
    hit = F.when(slice_of(p.subset), hit).otherwise(F.lit(False)) if p.subset else hit
    return ~hit if p.negate else hit


def is_pattern(pattern: str, ignore_case: bool = False) -> Predicate:
    """The value matches a regular expression; ``*`` alone matches all."""
    pattern = ".*" if pattern == "*" else pattern
    return Predicate(lambda cube, v: v.cast("string").rlike(("(?i)" if ignore_case else "") + pattern))


def is_equal(ref: float, tol: float = TOLERANCE) -> Predicate:
    return Predicate(lambda cube, v: F.abs(v.cast("double") - F.lit(float(ref))) <= tol)


def is_equal_by(refs: Mapping, along: str, tol: float = TOLERANCE) -> Predicate:
    """Equal to a reference of its own for each level of a dimension."""
    pairs = [F.lit(x) for kv in refs.items() for x in kv]
    return Predicate(lambda cube, v: F.abs(v.cast("double") - F.create_map(*pairs)[F.col(along)]) <= tol)


def is_equal_to(refs: DimFrame, tol: float = TOLERANCE) -> Predicate:
    """Equal to the value that another cube has for the same levels of its dimensions, any number of them; where it has none, false."""

    def plan(cube: DimFrame, name: str) -> DataFrame:
        wanted = refs.df.select(*refs.names, F.col(refs.value).cast("double").alias("_ref"))
        rows = cube.df.join(wanted, refs.names, "left") if refs.dims else cube.df.crossJoin(F.broadcast(wanted))  # without dimensions one value
        return rows.select(*cube.names, (F.abs(F.col(cube.value).cast("double") - F.col("_ref")) <= tol).alias(name))

    return Predicate(lambda cube, v: F.lit(False), plan=plan)


def is_same(ref: object) -> Predicate:
    return Predicate(lambda cube, v: v == F.lit(ref))


def is_between(lwr: float, upr: float, open: str = "none") -> Predicate:
    """Between two bounds, in either order; ``open``: none, both, lwr or upr."""
    lwr, upr = min(lwr, upr), max(lwr, upr)

    def test(cube: DimFrame, v: Column) -> Column:
        low = v > lwr if open in ("both", "lwr") else v >= lwr
        return low & (v < upr if open in ("both", "upr") else v <= upr)

    return Predicate(test)


def is_negative() -> Predicate:
    return Predicate(lambda cube, v: v < 0)


def is_positive() -> Predicate:
    return Predicate(lambda cube, v: v > 0)


def is_extremum(along: str, what: str = "both", **options) -> Predicate:
    """A minimum (``what``: min), a maximum (max) or either (both) of the series along a dimension; ``options`` as of ``sequence.extrema``.

    A constant series counts as what is asked for. With ``subset`` or ``expand``
    the extrema are those of the slice. It combines like any other predicate.
    """
    code = {"min": 1, "max": 2, "both": 3}[what]

    def plan(cube: DimFrame, name: str) -> DataFrame:
        from ..operators.sequence import extrema

        codes = extrema(cube, along, **({"constant": code} | options))
        found = F.col(cube.value) > 0 if what == "both" else F.col(cube.value) == code
        return codes.df.select(*cube.names, found.alias(name))

    return Predicate(lambda cube, v: F.lit(False), plan=plan)


def is_local_maximum(along: str, **options) -> Predicate:
    return is_extremum(along, "max", **options)


def is_local_minimum(along: str, **options) -> Predicate:
    return is_extremum(along, "min", **options)


def is_maximum(along: str, **options) -> Predicate:
    return is_extremum(along, "max", global_=True, **options)


def is_minimum(along: str, **options) -> Predicate:
    return is_extremum(along, "min", global_=True, **options)


def select_values(cube: DimFrame, predicate: Predicate, with_index: bool = False) -> DataFrame:
    """The cells where a predicate holds: dimensions and value, and with ``with_index`` the place (from 1) of each level."""
    rows = marked(cube, predicate, "_hit").where("_hit").drop("_hit")
    if with_index:
        for d in cube.dims:
            levels = cube.df.select(d.name).distinct() if d.levels is None else None
            if d.levels is not None:
                rows = rows.withColumn(f"index_{d.name}", cube.ordinal(d.name).cast("long"))
            else:
                numbered = levels.withColumn(f"index_{d.name}", F.row_number().over(Window.orderBy(d.name)).cast("long"))
                rows = rows.join(numbered, d.name)
    return rows
