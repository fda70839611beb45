"""Permutation inference: largest statistics of relabelled data, corrected p, topographic ANOVA.

Relabellings given as rows (perm, id, group) join the cells and are aggregated
like another dimension; ``inference`` and ``permuted`` have the statistics by
matrix products. Of each permutation only the largest statistic goes on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import DimFrame

#: Effects that differ by less than this share are ties: relabellings that swap the groups give the same effect but for rounding.
TIE = 1e-9


def group_maxima(cube: DimFrame, table: DataFrame, id_dim: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """The largest absolute difference-of-groups t (pooled) over all cells of each combination of ``by``, for each relabelling.

    Relabellings are rows (perm, id, g), g being 1 or 2; they join the cells and
    are aggregated like another dimension. ``inference.permuted_maxima`` takes a
    matrix instead.
    """
    others = cube.others(id_dim)
    stats = _pooled_t(cube.df.join(table, id_dim), ["perm", *others], cube.value)
    return stats.groupBy("perm", *by).agg(F.max(F.abs("stat")).alias("most"))


def _pooled_t(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    v = F.col(value)
    one = [F.when(F.col("g") == k, v) for k in (1, 2)]
    sums = rows.groupBy(*keys).agg(*[f(x).alias(f"{n}{k}") for k, x in enumerate(one, 1) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
    return sums.select(*keys, ((F.col("m1") - F.col("m2")) / F.nullif(F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2"))), F.lit(0.0))).alias("stat"))


def corrected_p(observed: DataFrame, maxima: DataFrame, by: Sequence[str] = (), stat: str = "stat", n: int | None = None) -> DataFrame:
    """p_corr = (number of permutations whose largest statistic is greater + 1) / (permutations + 1).

    The maxima of a combination, as many as permutations, come to the observed
    cells as one sorted array.
    """
    arrays = maxima.groupBy(*by).agg(F.collect_list("most").alias("_all"))
    joined = observed.join(arrays, list(by)) if by else observed.crossJoin(F.broadcast(arrays))
    above = F.size(F.filter("_all", lambda m: m > F.abs(F.col(stat))))
    return joined.withColumn("p_corr", (above + 1) / (F.size("_all") + 1)).drop("_all")


def tanova_effect(cube: DimFrame, group: str, chan: str = "chan", id_dim: str = "id", kind: str = "both", keys: Sequence[str] = ()) -> DataFrame:
    """The size of a factor's effect on the topography, for each combination of the other dimensions.

    The means of a factor's levels less the grand mean are maps over channels;
    the effect is the unweighted mean over levels of their standard deviation.
    ``kind``: both, topography (each id's map scaled to length 1 first) or
    intensity (global field power first; the mean absolute effect).
    """
    from .aggregate import gfp
    from .sequence import scaled

    extra = [group, *keys]
    others = [d for d in cube.others(chan, id_dim) if d not in extra]
    if kind == "topography":
        cube = scaled(cube, [*others, id_dim, *extra])
    if kind == "intensity":
        cube = gfp(cube, chan)
    maps = [] if kind == "intensity" else [chan]
    means = cube.df.groupBy(*keys, *others, *maps, group).agg(F.avg(cube.value).alias("_m"))
    grand = means.groupBy(*keys, *others, *maps).agg(F.avg("_m").alias("_g"))
    effects = means.join(grand, [*keys, *others, *maps]).withColumn("_e", F.col("_m") - F.col("_g"))
    if kind == "intensity":
        return effects.groupBy(*keys, *others).agg(F.avg(F.abs("_e")).alias("effect"))
    return effects.groupBy(*keys, *others, group).agg(F.stddev_samp("_e").alias("_s")).groupBy(*keys, *others).agg(F.avg("_s").alias("effect"))


def tanova_p(effects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """effect, p and z of perm 0, the observed labelling, among all permutations (a column ``perm``)."""
    seen = effects.where("perm = 0").select(*keys, F.col("effect").alias("obs"))
    rest = effects.where("perm > 0")
    joined = rest.join(seen, list(keys)) if keys else rest.crossJoin(F.broadcast(seen))
    out = joined.groupBy(*keys, "obs").agg(F.count(F.when(F.col("effect") > F.col("obs") * (1 + TIE), True)).alias("above"), F.count(F.lit(1)).alias("n"), F.avg("effect").alias("m"), F.stddev_samp("effect").alias("s"))
    return out.select(*keys, F.col("obs").alias("effect"), ((F.col("above") + 1) / (F.col("n") + 1)).alias("p"), ((F.col("obs") - F.col("m")) / F.nullif("s", F.lit(0.0))).alias("z"))


def tanova(
    cube: DimFrame,
    subjects: DataFrame | None,
    n: int,
    between: Sequence[str] = (),
    within: Sequence[str] = (),
    seed: int = 1,
    kind: str = "both",
    what: str = "residuals",
    covariates: Sequence[str] = (),
    id_dim: str = "id",
    chan: str = "chan",
    time: str | None = "time",
    alphas: Sequence[float] = (),
) -> DataFrame:
    """Topographic ANOVA of every term of a design: effect, p, z and, with ``alphas``, p_corr by duration.

    Factors between ids (and ``covariates``, numbers) are columns of
    ``subjects``, factors within ids dimensions of the cube. Either what the
    model of all terms leaves of the responses (``what``: residuals) is shuffled,
    or the responses themselves (observations).
    """
    from .permuted import Shuffles, design_of, permuted_maps

    design = design_of(cube, subjects, between, within, covariates, id_dim)
    effects = permuted_maps(cube, design, Shuffles(design, n, seed), what, id_dim, chan, kind)
    keys = effects.others("perm")
    out = tanova_p(effects.df, keys)
    return duration_corrected(out, effects.df, keys, time, alphas) if alphas and time else out


def duration_corrected(observed: DataFrame, effects: DataFrame, keys: Sequence[str], time: str, alphas: Sequence[float]) -> DataFrame:
    """p_corr: the smallest alpha at which a run of significant times is longer than chance allows, else 1.

    Chance: the 1 - alpha quantile of the lengths of runs with p below alpha
    among the permutations, each against all others.
    """
    others = [k for k in keys if k != time]
    cells = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(cells)
    ranked = effects.withColumn("p", (n - F.rank().over(cells.orderBy("effect")) + 1) / n)
    out, best, order = observed, F.lit(1.0), sorted(alphas, reverse=True)
    for k, a in enumerate(order):
        lengths = _run_lengths(ranked.withColumn("_hit", F.col("p") < a), ["perm", *others], time).where("_hit")
        limit = lengths.groupBy(*others).agg(F.percentile("_n", 1 - a).alias("_limit"))
        seen = _run_lengths(out.withColumn("_hit", F.col("p") < a), others, time)
        seen = seen.join(limit, others, "left") if others else seen.crossJoin(F.broadcast(limit))
        out = seen.withColumn(f"_ok{k}", F.col("_hit") & (F.col("_n") >= F.coalesce("_limit", F.lit(0.0)))).drop("_limit", "_n", "_hit", "_run")
        best = F.when(F.col(f"_ok{k}"), F.lit(float(a))).otherwise(best)
    return out.withColumn("p_corr", best).drop(*[f"_ok{k}" for k in range(len(order))])


def _run_lengths(rows: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(time)
    rows = rows.withColumn("_new", F.coalesce((F.col("_hit") != F.lag("_hit").over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, "_run")))

