"""Series along a dimension: moving statistics, scaling, runs and extrema, by window functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import DimFrame
from ..functions.predicates import TOLERANCE, slice_of


def series(cube: DimFrame, along: str):
    """The window over each series, in order."""
    return Window.partitionBy(*cube.others(along)).orderBy(cube.ordinal(along))


def rolled(cube: DimFrame, along: str, width: int, stat: str = "mean", prob: float = 0.5, endrule: str = "shrink") -> DimFrame:
    """A centred moving statistic: mean, min, max, sd, median, quantile or mad.

    Windows shrink at the ends, or with ``endrule='NA'`` are null there. An even
    width takes one more value before than after. Nulls are skipped.
    """
    before, after = width // 2, width - 1 - width // 2
    w = series(cube, along).rowsBetween(-before, after)
    v = F.col(cube.value)
    made = {
        "mean": lambda: F.avg(v).over(w),
        "min": lambda: F.min(v).over(w),
        "max": lambda: F.max(v).over(w),
        "sd": lambda: F.stddev_samp(v).over(w),
        "median": lambda: F.percentile(v, F.lit(0.5)).over(w),
        "quantile": lambda: F.percentile(v, F.lit(prob)).over(w),
        "mad": lambda: _mad(F.collect_list(v).over(w)),
    }[stat]()
    if endrule == "NA":
        made = F.when(F.count(F.lit(1)).over(w) == width, made)
    return cube.but(cube.df.withColumn(cube.value, made))


def _mad(values: Column) -> Column:
    """1.4826 times the median distance from the median."""

    def median(a: Column) -> Column:
        s, n = F.array_sort(a), F.size(a)
        return F.when(n == 0, None).otherwise((F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)

    middle = median(values)
    return 1.4826 * median(F.transform(values, lambda x: F.abs(x - middle)))


def scaled(cube: DimFrame, along: list[str], center: bool = True, scale: bool = True, base: Mapping | None = None, center_base: Mapping | None = None, scale_base: Mapping | None = None) -> DimFrame:
    """Subtracts the mean and divides by the root mean square of what is left, for each combination of ``along``.

    The statistics may come from a slice (``base``, or one for each step); they
    apply to all cells. The divisor is the root of the centred squares' sum over
    their number less one. One aggregate of each combination, joined back.
    """
    v = F.col(cube.value)
    middle, part = (F.when(slice_of(own or base or {}), v) for own in (center_base, scale_base))
    stats = cube.df.groupBy(*along).agg(F.avg(middle).alias("_m"), F.avg(part).alias("_a"), F.var_pop(part).alias("_v"), F.count(part).alias("_n"))
    mean = F.col("_m") if center else F.lit(0.0)
    root = F.sqrt(F.col("_n") * (F.col("_v") + F.pow(F.col("_a") - mean, 2)) / (F.col("_n") - 1))
    stats = stats.select(*along, mean.alias("_m"), F.when(F.col("_n") > 1, root).alias("_r"))
    out = v - F.col("_m") if center else v
    out = out / F.nullif("_r", F.lit(0.0)) if scale else out
    joined = cube.df.join(stats, along) if along else cube.df.crossJoin(F.broadcast(stats))  # without dimensions one row
    return cube.but(joined.withColumn(cube.value, out).select(*cube.df.columns), step="scaled")


def scaled_channels(cube: DimFrame, chan: str = "chan") -> DimFrame:
    return scaled(cube, cube.others(chan))


def baseline(cube: DimFrame, along: list[str], base: Mapping | None) -> DimFrame:
    """Subtracts each combination's mean over the baseline, all levels if ``base`` is None."""
    out = scaled(cube, along, scale=False, base=base)
    return out.but(out.df, step="baseline")


def run_ids(cube: DimFrame, along: str, v: Column | None = None) -> DataFrame:
    """The rows with ``run``: the number of the run of equal values, null equal to null."""
    v = F.col(cube.value) if v is None else v
    w = series(cube, along)
    rows = cube.df.withColumn("_v", v).withColumn("_new", (~F.col("_v").eqNullSafe(F.lag("_v").over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    return rows.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def rle(cube: DimFrame, along: str) -> DataFrame:
    """Runs of equal values: run, value, length, first and last level."""
    rows = run_ids(cube, along)
    others = cube.others(along)
    return rows.groupBy(*others, "run").agg(F.first("_v").alias(cube.value), F.count(F.lit(1)).alias("length"), F.min(along).alias("first"), F.max(along).alias("last"))


def inverse_rle(runs: DataFrame, others: list[str], value: str = "value") -> DataFrame:
    """The values of runs again, with their place from 1."""
    w = Window.partitionBy(*others).orderBy("run")
    begun = runs.withColumn("_b", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return begun.select(*others, value, F.explode(F.sequence(F.col("_b") + 1, F.col("_b") + F.col("length"))).alias("place"))


def longest_run(cube: DimFrame, along: str, hit: Column) -> DataFrame:
    """The length of the longest run of true of each series (0 without any)."""
    rows = run_ids(cube, along, F.coalesce(hit, F.lit(False)))
    lengths = rows.groupBy(*cube.others(along), "run").agg(F.count(F.when(F.col("_v"), True)).alias("n"))
    return lengths.groupBy(*cube.others(along)).agg(F.max("n").alias("longest"))


def consecutive_p(cube: DimFrame, along: str, level: float = 0.05, least: int = 1) -> DimFrame:
    """p-values in runs of at least ``least`` values up to ``level``; 1 everywhere else."""
    rows = run_ids(cube, along, F.col(cube.value) <= level)
    n = F.count(F.lit(1)).over(Window.partitionBy(*cube.others(along), "run"))
    kept = F.when(F.col("_v") & (n >= least), F.col(cube.value)).otherwise(F.lit(1.0))
    return cube.but(rows.withColumn(cube.value, kept).select(*cube.names, cube.value))


def phases(cube: DimFrame, along: str, code: Column) -> DataFrame:
    """The ranges of levels [start, end] over which a code stays the same, for codes above 0."""
    rows = run_ids(cube, along, code)
    out = rows.groupBy(*cube.others(along), "run").agg(F.first("_v").alias("code"), F.min(along).alias("start"), F.max(along).alias("end"))
    return out.where("code > 0").drop("run")


def extrema(cube: DimFrame, along: str, n: int = 1, global_: bool = False, tail: str = "if_plateau", constant: int = 3, top: int | None = None) -> DimFrame:
    """Codes extrema of each series: 1 minimum, 2 maximum, 0 neither, null near a null.

    Plateaus of equal values count as one value. A value is an extremum if none
    of the ``n`` runs on either side (all, if ``global_``) goes beyond it by more
    than the tolerance; a maximum wins over a minimum. At the ends of a series
    an extremum counts only as a plateau (``tail``: if_plateau, never,
    do_not_care). A constant series gets ``constant``. Values within ``n`` of a
    null get null. ``top`` keeps the most extreme ones by rank.
    """
    others = cube.others(along)
    rows = run_ids(cube.but(cube.df.where(F.col(cube.value).isNotNull())), along)
    w = Window.partitionBy(*others).orderBy("run")
    runs = rows.groupBy(*others, "run").agg(F.first("_v").alias("v"), F.count(F.lit(1)).alias("length"))
    near = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) if global_ else w.rowsBetween(-n, n)
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    low, high = F.min("v").over(near), F.max("v").over(near)
    edge = (F.row_number().over(w) == 1) | (F.lead("run").over(w).isNull())
    code = F.when(F.col("v") >= high - TOLERANCE, 2).when(F.col("v") <= low + TOLERANCE, 1).otherwise(0)
    if tail == "never":
        code = F.when(edge, 0).otherwise(code)
    elif tail == "if_plateau":
        code = F.when(edge & (F.col("length") == 1), 0).otherwise(code)
    flat = F.max("v").over(everything) - F.min("v").over(everything) <= TOLERANCE
    runs = runs.withColumn("code", F.when(flat, F.lit(constant)).otherwise(code)).select(*others, "run", "code")
    coded = rows.join(runs, [*others, "run"]).select(*others, along, "code")
    full = cube.df.join(coded, [*others, along], "left")
    at = series(cube, along)
    lost = F.max(F.col(cube.value).isNull()).over(at.rowsBetween(-n, n))
    full = full.withColumn("_code", F.when(lost, None).otherwise(F.col("code")))
    if top is not None:
        out = []
        for c, order in ((1, F.col(cube.value)), (2, F.desc(cube.value))):
            out.append(F.when((F.col("_code") == c) & (F.rank().over(Window.partitionBy(*others, "_code").orderBy(order)) > top), 0))
        full = full.withColumn("_code", F.coalesce(*out, F.col("_code")))
    return cube.but(full.withColumn(cube.value, F.col("_code").cast("int")).select(*cube.names, cube.value))


def differences(cube: DimFrame, along: str) -> DimFrame:
    """Absolute successive differences; null for the first level."""
    v = F.col(cube.value)
    return cube.but(cube.df.withColumn(cube.value, F.abs(v - F.lag(v).over(series(cube, along)))))


def ranks(cube: DimFrame, over: list[str], ties: str = "max") -> DimFrame:
    """Ranks of values among each combination of ``over``; ties get the largest or the smallest rank."""
    w = Window.partitionBy(*over).orderBy(cube.value)
    r = F.rank().over(w) if ties == "min" else F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, 0))
    return cube.but(cube.df.withColumn(cube.value, r.cast("long")))


def peaks(cube: DimFrame, along: str, low, high, largest: bool = True, around: int = 0) -> DataFrame:
    """The level of the largest (smallest) value in a range of levels, and the mean of ``around`` values either side."""
    others = cube.others(along)
    w = series(cube, along).rowsBetween(-around, around)
    rows = cube.df.withColumn("_m", F.avg(cube.value).over(w)).where(F.col(along).between(low, high) & F.col(cube.value).isNotNull())
    best = F.max_by if largest else F.min_by
    # ties go to the earlier level
    order = F.struct(F.col(cube.value), -F.col(along)) if largest else F.struct(F.col(cube.value), F.col(along))
    return rows.groupBy(*others).agg(best(along, order).alias("peak"), best("_m", order).alias("amplitude"))
