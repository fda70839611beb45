"""Means, bins and other aggregates over dimensions, by partial aggregation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import Dim, DimFrame


def strict_avg(v: Column) -> Column:
    """The mean, null if any value is null."""
    return F.when(F.count(v) == F.count(F.lit(1)), F.avg(v))


def avg_dims(cube: DimFrame, *names: str, na_rm: bool = True) -> DimFrame:
    """The mean over dimensions; nulls are skipped, or with ``na_rm=False`` make the mean null."""
    v = F.col(cube.value)
    mean = (F.avg(v) if na_rm else strict_avg(v)).alias(cube.value)
    return cube.but(cube.df.groupBy(*cube.others(*names)).agg(mean), cube.drop_dims(*names))


def fn_dims(cube: DimFrame, names: Sequence[str], fn: Callable, into: str | None = None, schema: str = "double", aggregate: bool = False) -> DimFrame:
    """Applies a function over dimensions.

    With ``aggregate`` the function gets the column of values and gives an SQL
    aggregate of it. Else it gets each series as a numpy array, in the order of
    the dimensions, and gives a number, or with ``into`` an array, whose places
    become a dimension of that name.
    """
    others = cube.others(*names)
    if aggregate:
        return cube.but(cube.df.groupBy(*others).agg(fn(F.col(cube.value)).alias(cube.value)), cube.drop_dims(*names))

    def run(values: pd.Series) -> pd.Series:
        out = [fn(np.asarray(v, float)) for v in values]
        return pd.Series([np.asarray(o, float).tolist() for o in out] if into else [float(o) for o in out])

    series = cube.df.groupBy(*others).agg(F.array_sort(F.collect_list(F.struct(*[cube.ordinal(n).alias(f"o{k}") for k, n in enumerate(names)], F.col(cube.value).alias("v")))).alias("s"))
    udf = F.pandas_udf(run, "array<double>" if into else schema)
    applied = series.select(*others, udf(F.transform("s", lambda c: c["v"])).alias(cube.value))
    if into:
        applied = applied.select(*others, F.posexplode(cube.value).alias(into, cube.value))
        return cube.but(applied, [*cube.drop_dims(*names), Dim(into)])
    return cube.but(applied, cube.drop_dims(*names))


def avg_bin(cube: DimFrame, name: str, length: int) -> DimFrame:
    """Means of bins of ``length`` consecutive levels of a numeric dimension.

    An incomplete last bin leaves; a null makes its bin null; the new label is
    the mean of the labels. The levels are numbered in a table of their own, so
    no series is sorted.
    """
    levels = cube.df.select(name).distinct()
    whole = levels.count() // length
    numbered = levels.withColumn("_bin", F.floor((F.row_number().over(Window.orderBy(name)) - 1) / length)).where(F.col("_bin") < whole)
    labels = numbered.withColumn("_label", F.avg(name).over(Window.partitionBy("_bin")))
    others = cube.others(name)
    out = cube.df.join(labels, name).groupBy(*others, "_bin").agg(F.first("_label").alias(name), strict_avg(F.col(cube.value)).alias(cube.value))
    return cube.but(out.drop("_bin"), [Dim(d.name) if d.name == name else d for d in cube.dims])


def avg_codes(cube: DimFrame, name: str, codes: Column) -> DimFrame:
    """Means over groups of levels given by a code, which becomes the label."""
    df = cube.df.withColumn("_code", codes).groupBy(*cube.others(name), "_code").agg(strict_avg(F.col(cube.value)).alias(cube.value))
    return cube.but(df.withColumnRenamed("_code", name), [Dim(d.name) if d.name == name else d for d in cube.dims])


def gfp(cube: DimFrame, chan: str = "chan", keep: bool = False) -> DimFrame:
    """The sample standard deviation over channels; ``keep`` has it as a channel ``GFP`` beside the others."""
    v = F.col(cube.value)
    others = cube.others(chan)
    out = cube.df.groupBy(*others).agg(F.when(F.count(v) == F.count(F.lit(1)), F.stddev_samp(v)).alias(cube.value))
    if not keep:
        return cube.but(out, cube.drop_dims(chan))
    d = cube.dim(chan)
    both = cube.long().unionByName(out.withColumn(chan, F.lit("GFP")))
    return cube.but(both, [Dim(chan, (*d.levels, "GFP")) if x.name == chan and d.levels else x for x in cube.dims])


def model_terms(factors: Sequence[str]) -> list[tuple[str, ...]]:
    """Main effects first, then interactions of rising order."""
    return [t for n in range(1, len(factors) + 1) for t in combinations(factors, n)]


def marginal_means(cube: DimFrame, factors: Sequence[str]) -> DataFrame:
    """The mean and number of cells of every level combination of every model term: one pass, grouping sets."""
    terms = model_terms(factors)
    sets = [[F.col(f) for f in t] for t in terms]
    out = cube.df.groupingSets(sets, *[F.col(f) for f in factors]).agg(F.avg(cube.value).alias(cube.value), F.count(cube.value).alias("freq"), F.grouping_id(*[F.col(f) for f in factors]).alias("_g"))
    mask = {t: sum(1 << (len(factors) - 1 - k) for k, f in enumerate(factors) if f not in t) for t in terms}
    named = F.coalesce(*[F.when(F.col("_g") == m, F.lit(":".join(t))) for t, m in mask.items()])
    return out.withColumn("modelterm", named).drop("_g")


def sequential_means(cube: DimFrame, factors: Sequence[str], terms: Sequence[str] | None = None, no_icpt: bool = False) -> DataFrame:
    """As ``marginal_means``, each term's means taken from what the terms before it leave; with ``no_icpt`` the grand mean goes first.

    A term's means are constant within the cells of the design, so they are
    taken from the cells' sums: the data are aggregated once. ``terms`` (names
    joined by colons) says which are shown.
    """
    # few rows: as many as combinations of levels
    df, outs = cube.df.groupBy(*factors).agg(F.coalesce(F.sum(cube.value), F.lit(0.0)).cast("double").alias("_rest"), F.count(cube.value).alias("_n")), []
    without = lambda df, *t: df.withColumn("_mean", F.sum("_rest").over(Window.partitionBy(*t)) / F.nullif(F.sum("_n").over(Window.partitionBy(*t)), F.lit(0))).withColumn("_rest", F.col("_rest") - F.col("_n") * F.coalesce("_mean", F.lit(0.0)))
    if no_icpt:
        df = without(df).drop("_mean")
    for t in model_terms(factors):
        df = without(df, *t)
        if terms is None or ":".join(t) in terms:
            shown = df.groupBy(*t).agg(F.first("_mean").alias(cube.value), F.sum("_n").alias("freq")).withColumn("modelterm", F.lit(":".join(t)))
            outs.append(shown.select(*[F.col(f) if f in t else F.lit(None).cast(cube.df.schema[f].dataType).alias(f) for f in factors], cube.value, "freq", "modelterm"))
        df = df.drop("_mean")
    if not outs:
        raise ValueError(f"no term of {factors} is among {terms}")
    return reduce(DataFrame.unionByName, outs)


def model_means(cube: DimFrame, term: Sequence[str], factors: Sequence[str], adjusted: bool = False) -> DataFrame:
    """Means of a term: of all cells, or ``adjusted`` the unweighted mean of the highest-order cell means."""
    if not adjusted:
        return cube.df.groupBy(*term).agg(F.avg(cube.value).alias(cube.value))
    cells = cube.df.groupBy(*factors).agg(F.avg(cube.value).alias(cube.value))
    return cells.groupBy(*term).agg(F.avg(cube.value).alias(cube.value))


def unique_rows(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """Distinct rows with their number and the place of the first, by ``order``."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("freq"), F.min(order).alias("first"))


def collapsed(cube: DimFrame, name: str, sep: str = "") -> DimFrame:
    """The texts of a series joined in the order of a dimension."""
    cells = F.array_sort(F.collect_list(F.struct(cube.ordinal(name).alias("o"), F.col(cube.value).cast("string").alias("v"))))
    return cube.but(cube.df.groupBy(*cube.others(name)).agg(F.array_join(F.transform(cells, lambda c: c["v"]), sep).alias(cube.value)), cube.drop_dims(name))


def group_sums(cube: DimFrame, name: str, codes: Column) -> DataFrame:
    return cube.df.groupBy(*cube.others(name), codes.alias("code")).agg(F.sum(cube.value).alias(cube.value))


def summarised(results: DataFrame, by: Iterable[str], slots: Sequence[str], basis: Column, stats_absolute: Sequence[str] = ()) -> DataFrame:
    """Of the cells that pass ``basis``: min, median and max of every slot, their number and share."""
    aggs = []
    for s in slots:
        v = F.when(basis, F.abs(s) if s in stats_absolute else F.col(s))
        aggs += [F.min(v).alias(f"{s}_min"), F.percentile(v, 0.5).alias(f"{s}_median"), F.max(v).alias(f"{s}_max")]
    n = F.count(F.when(basis, True))
    return results.groupBy(*by).agg(*aggs, n.alias("size"), (n / F.count(F.lit(1))).alias("ratio"))


def centroid(cube: DimFrame, positions: DataFrame, chan: str = "chan") -> DataFrame:
    """The mean position (x, y, z) of the channels below zero and of the others, for each series."""
    rows = cube.df.join(positions, chan).where(F.col(cube.value).isNotNull())
    side = F.when(F.col(cube.value) < 0, "negative").otherwise("positive").alias("side")
    return rows.groupBy(*cube.others(chan), side).agg(*[F.avg(c).alias(c) for c in ("x", "y", "z")])


def avg_trials(cube: DimFrame, markers: DataFrame, factors: Sequence[str], trial: str = "trial", into: str = "factor_level") -> DimFrame:
    """Means over the trials of each combination of factors that occurs; a null makes the mean null."""
    labels = markers.select(trial, F.concat_ws("|", *[F.col(f).cast("string") for f in factors]).alias(into))
    others = cube.others(trial)
    out = cube.df.join(labels, trial).groupBy(*others, into).agg(strict_avg(F.col(cube.value)).alias(cube.value))
    return cube.but(out, [*cube.drop_dims(trial), Dim(into)], step="averaged trials")


def mapping_of(df: DataFrame, key: str, value: str) -> Mapping:
    """A small table as a dict."""
    return {r[key]: r[value] for r in df.select(key, value).collect()}
