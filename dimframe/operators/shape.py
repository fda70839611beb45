"""Selecting, renaming, joining and reshaping cubes: projections, maps and unions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Dim, DimFrame
from ..functions.predicates import slice_of


def subset(cube: DimFrame, drop: bool = False, **where) -> DimFrame:
    """Levels of dimensions by label, list of labels or test (a function of the column); an empty list keeps all.

    The dimension's order becomes the order asked for; a label asked for twice
    is there once. ``drop`` removes dimensions asked for by one label.
    """
    where = {d: v for d, v in where.items() if not (isinstance(v, (list, tuple)) and not v)}
    dims = [d if not isinstance(where.get(d.name), (list, tuple)) else Dim(d.name, tuple(dict.fromkeys(where[d.name]))) for d in cube.dims]
    out = cube.but(cube.df.where(slice_of(where)), dims)
    single = [d for d, v in where.items() if drop and not callable(v) and not isinstance(v, (list, tuple))]
    return cube.but(out.df.drop(*single), out.drop_dims(*single)) if single else out


def subset_at(cube: DimFrame, drop: bool = False, **where: Sequence) -> DimFrame:
    """Levels of dimensions by place: places from 1, places to leave out (all negative), or a truth value for each level, repeated if there are fewer."""
    labels = {}
    for name, wanted in where.items():
        levels, wanted = _levels(cube, name), list(wanted) if isinstance(wanted, Sequence) else [wanted]
        if wanted and all(isinstance(w, bool) for w in wanted):
            kept = [v for k, v in enumerate(levels) if wanted[k % len(wanted)]]
        elif any(isinstance(w, bool) or w == 0 or abs(w) > len(levels) for w in wanted):
            raise ValueError(f"{wanted} are no places of the {len(levels)} levels of {name}")
        elif all(w < 0 for w in wanted):
            kept = [v for k, v in enumerate(levels, 1) if -k not in wanted]
        elif all(w > 0 for w in wanted):
            kept = [levels[w - 1] for w in wanted]
        else:
            raise ValueError(f"places to keep and to leave out are mixed for {name}")
        labels[name] = kept[0] if drop and len(kept) == 1 else kept
    empty = [n for n, kept in labels.items() if isinstance(kept, list) and not kept]
    return subset(cube, drop, **{n: (lambda c: F.lit(False)) if n in empty else kept for n, kept in labels.items()})


def drop_dims(cube: DimFrame, *names: str) -> DimFrame:
    """Removes dimensions that have one level; another number of levels is an error."""
    seen = cube.df.agg(*[F.min(n).eqNullSafe(F.max(n)).alias(n) for n in names]).first() if names else {}
    more = [n for n in names if not seen[n]]
    if more:
        raise ValueError(f"{more} have more than one level")
    return cube.but(cube.df.drop(*names), cube.drop_dims(*names))


def permuted(cube: DimFrame, *first: str) -> DimFrame:
    """Another order of dimensions, ``first`` ones first: metadata alone."""
    return cube.but(cube.df, [*(cube.dim(n) for n in first), *cube.drop_dims(*first)])


def assign(cube: DimFrame, values: DataFrame | float | None, where: Mapping[str, object] | None = None) -> DimFrame:
    """Replaces the cells of a slice: by one value, or by the ``value`` of the rows of a DataFrame with the cube's dimensions."""
    hit = slice_of(where or {})
    if isinstance(values, DataFrame):
        new = values.select(*cube.names, F.col(cube.value).alias("_new"), F.lit(True).alias("_there"))
        df = cube.df.join(new, cube.names, "left")
        return cube.but(df.withColumn(cube.value, F.when(hit & F.col("_there"), F.col("_new")).otherwise(F.col(cube.value))).drop("_new", "_there"))
    return cube.but(cube.df.withColumn(cube.value, F.when(hit, F.lit(values)).otherwise(F.col(cube.value))))


def replaced(col: str, mapping: Mapping, digits: int = 10):
    """A column with values replaced all at once; null stays, doubles are compared at ``digits`` digits."""
    if not mapping:
        return F.col(col)
    source = F.col(col)
    if all(isinstance(k, float) for k in mapping):
        mapping = {round(k, digits): v for k, v in mapping.items()}
        source = F.round(col, digits)
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.when(F.col(col).isNull(), None).otherwise(F.coalesce(F.get(F.array(F.element_at(pairs, source)), F.lit(0)), F.col(col)))


def recode(cube: DimFrame, levels: Mapping[str, Mapping] | None = None, names: Mapping[str, str] | None = None) -> DimFrame:
    """Renames levels and dimensions."""
    df, dims = cube.df, []
    for d in cube.dims:
        m = (levels or {}).get(d.name)
        if m:
            df = df.withColumn(d.name, replaced(d.name, m))
            d = Dim(d.name, tuple(m.get(v, v) for v in d.levels) if d.levels else None)
        new = (names or {}).get(d.name, d.name)
        df = df.withColumnRenamed(d.name, new)
        dims.append(Dim(new, d.levels))
    return cube.but(df, dims)


def merge_dims(cube: DimFrame, names: Sequence[str], into: str, sep: str = ".") -> DimFrame:
    """Several dimensions as one of joined labels."""
    parts = [cube.dim(n) for n in names]
    levels: tuple | None = None
    if all(d.levels is not None for d in parts):
        levels = reduce(lambda out, d: tuple(f"{a}{sep}{b}" if a is not None else str(b) for b in d.levels for a in out), parts, (None,))
    df = cube.df.withColumn("_into", F.concat_ws(sep, *[F.col(n).cast("string") for n in names])).drop(*names).withColumnRenamed("_into", into)
    return cube.but(df, [Dim(into, levels), *cube.drop_dims(*names)])


def split_dim(cube: DimFrame, name: str, into: Sequence[str], sep: str = ".") -> DimFrame:
    """Inverse of ``merge_dims``: a dimension of joined labels as several."""
    parts = F.split(F.col(name), "\\Q" + sep + "\\E")
    df = cube.df.select("*", *[F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(into)]).drop(name)
    return cube.but(df, [*(Dim(n) for n in into), *cube.drop_dims(name)])


def dim_to_multidim(cube: DimFrame, name: str, table: DataFrame) -> DimFrame:
    """Splits a dimension by a table of its levels (a column ``name``) and the new dimensions' levels."""
    new = [c for c in table.columns if c != name]
    return cube.but(cube.df.join(table, name).drop(name), [*(Dim(n) for n in new), *cube.drop_dims(name)])


def _levels(cube: DimFrame, name: str, most: int = 100_000) -> list:
    """The levels of a dimension in order, if it lists them or they are few."""
    d = cube.dim(name)
    if d.levels is not None:
        return list(d.levels)
    rows = cube.df.select(name).distinct().orderBy(name).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{name} has more than {most} levels; levels can be matched by name alone")
    return [r[0] for r in rows]


def expand_into(cube: DimFrame, target: DimFrame, value: str = "expanded", levels: Mapping[str, Sequence] | None = None, safe: bool = True, fill: bool = True) -> DimFrame:
    """A smaller cube's values on the grid of a larger one.

    Levels are matched by name. ``levels`` gives, for a dimension, the smaller
    cube's level for each of the target's, in their order. A dimension with a
    single level stands for all of the target's. Otherwise a level that the
    smaller cube lacks is an error, or without ``safe`` its levels are repeated in
    their order until there are enough. ``fill`` makes the values as the
    target's are.
    """
    missing = set(cube.names) - set(target.names)
    if missing:
        raise ValueError(f"the target lacks {sorted(missing)}")
    levels, dropped, rows = dict(levels or {}), [], target.df.select(*target.names)
    unknown = set(levels) - set(cube.names)
    if unknown:
        raise ValueError(f"levels are given for {sorted(unknown)}, which the smaller cube lacks")
    for name in cube.names:
        given = levels.get(name)
        if given is None and safe:
            own, wanted = cube.dim(name).levels, target.dim(name).levels
            inside = set(wanted) <= set(own) if own is not None and wanted is not None else target.df.select(name).distinct().join(cube.df.select(name).distinct(), name, "left_anti").isEmpty()
            if inside:
                continue
            if cube.df.select(name).distinct().limit(2).count() == 1:
                dropped.append(name)
                continue
            raise ValueError(f"{name} lacks levels of the target and has more than one; give `levels`, or set `safe` to False")
        new = _levels(target, name)
        old = list(given) if given is not None else _levels(cube, name)
        if given is not None and len(old) != len(new):
            raise ValueError(f"{len(old)} levels are given for {name}, the target has {len(new)}")
        pairs = [(n, old[k % len(old)]) for k, n in enumerate(new)]
        kinds = target.df.schema[name].dataType.simpleString(), cube.df.schema[name].dataType.simpleString()
        rows = rows.join(F.broadcast(cube.df.sparkSession.createDataFrame(pairs, f"`{name}` {kinds[0]}, `_of_{name}` {kinds[1]}")), name, "left")
    moved = [n for n in cube.names if f"_of_{n}" in rows.columns]
    kept = [n for n in cube.names if n not in dropped]
    kind = target.df.schema[target.value].dataType if fill else cube.df.schema[cube.value].dataType
    small = cube.df.select(*[F.col(n).alias(f"_of_{n}" if n in moved else n) for n in kept], F.col(cube.value).cast(kind).alias(value))
    on = [f"_of_{n}" if n in moved else n for n in kept]
    out = rows.join(small, on, "left") if on else rows.crossJoin(F.broadcast(small))  # no dimension left: one row
    return target.but(out.select(*target.names, value), value=value)


def split_groups(cube: DimFrame, name: str, groups: Mapping, into: str = "group") -> DimFrame:
    """Adds the group of each level as a dimension; a level without a group leaves."""
    df = cube.df.withColumn(into, replaced_or_null(name, groups)).where(F.col(into).isNotNull())
    return cube.but(df, [Dim(into, tuple(sorted(set(groups.values())))), *cube.dims])


def replaced_or_null(name: str, mapping: Mapping):
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[F.col(name)]


def bind(cubes: Mapping[str, DimFrame], along: str) -> DimFrame:
    """Cubes of equal dimensions one after the other: along a new dimension named by the keys, or along one they have."""
    parts = list(cubes.items())
    first = parts[0][1]
    if along in first.names:
        levels = [c.dim(along).levels for _, c in parts]
        joined = tuple(dict.fromkeys(v for ls in levels for v in ls)) if all(ls is not None for ls in levels) else None
        df = reduce(DataFrame.unionByName, [c.long().withColumnRenamed(c.value, first.value) for _, c in parts])
        return first.but(df, [Dim(d.name, joined) if d.name == along else d for d in first.dims])
    df = reduce(DataFrame.unionByName, [c.long().withColumnRenamed(c.value, first.value).withColumn(along, F.lit(k)) for k, c in parts])
    return first.but(df, [*first.dims, Dim(along, tuple(cubes))])


def merge_cubes(cubes: Sequence[DimFrame], base: float | None = None) -> DimFrame:
    """One cube over the union of all levels; cells of no cube get ``base``.

    A cell of two cubes is an error, raised when the result is computed.
    """
    first = cubes[0]
    df = reduce(DataFrame.unionByName, [c.long().withColumnRenamed(c.value, first.value) for c in cubes])
    df = df.groupBy(*first.names).agg(F.count(F.lit(1)).alias("_n"), F.first(first.value).alias(first.value))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit("two cubes hold the same cell"))).otherwise(F.col(first.value))
    df = df.withColumn(first.value, checked.cast("double")).drop("_n")
    grid = None
    for d in first.names:
        levels = reduce(DataFrame.union, [c.df.select(d).distinct() for c in cubes]).distinct()
        grid = levels if grid is None else grid.crossJoin(levels)
    out = grid.join(df.withColumn("_there", F.lit(True)), first.names, "left")
    dims = []
    for k, d in enumerate(first.dims):
        levels = [c.dims[k].levels for c in cubes]
        dims.append(Dim(d.name, tuple(dict.fromkeys(v for ls in levels for v in ls)) if all(ls is not None for ls in levels) else None))
    return first.but(out.withColumn(first.value, F.when(F.col("_there"), F.col(first.value)).otherwise(F.lit(base))).drop("_there"), dims)


def pivoted(cube: DimFrame, name: str, levels: Sequence, na_omit: bool = False) -> DataFrame:
    """A dimension's levels as columns ``<value>.<dim>_<level>``."""
    wide = cube.df.groupBy(*cube.others(name)).pivot(name, list(levels)).agg(F.first(cube.value))
    wide = wide.select(*cube.others(name), *[F.col(f"`{v}`").alias(f"{cube.value}.{name}_{v}") for v in levels])
    return wide.dropna() if na_omit else wide


def chunked(cube: DimFrame, name: str, chunks: int | Mapping, apply: Callable[[DimFrame], DimFrame]) -> DimFrame:
    """Applies a function of cubes to chunks of a dimension's levels; the chunk is one more dimension meanwhile.

    ``chunks``: how many, dealt out by hash, or each level's chunk; a level that is given none leaves.
    """
    chunk = replaced_or_null(name, chunks) if isinstance(chunks, Mapping) else F.pmod(F.xxhash64(name), F.lit(chunks))
    df = cube.df.withColumn("chunk", chunk).where("chunk is not null")
    out = apply(cube.but(df, [Dim("chunk"), *cube.dims]))
    return out.but(out.df.drop("chunk"), out.drop_dims("chunk"))
