"""Reading results: slots of tests, significance codes for display, permuted ANOVA, ANOVA of peaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import Dim, DimFrame
from .anova import anova
from .permutation import corrected_p
from .permuted import Given, Shuffles, design_of, largest, permuted_f
from .sequence import peaks


def extract(results: DataFrame, what: Sequence[str], window: tuple | None = None, term: Sequence[str] | None = None, chan: Sequence[str] | None = None, time: str = "time") -> DataFrame:
    """Some slots (stat, p, es, p_corr, ...) of a result within an inclusive range of times, for some terms and channels.

    Slots and dimensions that the result lacks are left out.
    """
    slots = {"stat", "df", "df1", "df2", "p", "es", "p_corr", "effect", "z", "stat_corr"}
    out = results.select(*[c for c in results.columns if c not in slots or c in what])
    if window and time in out.columns:
        out = out.where(F.col(time).between(*window))
    if term and "modelterm" in out.columns:
        out = out.where(F.col("modelterm").isin(list(term)))
    if chan and "chan" in out.columns:
        out = out.where(F.col("chan").isin(list(chan)))
    return out


def p_codes(results: DataFrame, p: str, levels: Sequence[float], by: Sequence[str], time: str = "time", shift: bool = False) -> DataFrame:
    """``code``: how many of the levels p does not exceed; with ``shift`` a time takes the code of the next one if that is larger."""
    code = sum((F.when(F.col(p) <= a, 1).otherwise(0) for a in levels), F.lit(0))
    out = results.withColumn("code", code)
    if shift:
        out = out.withColumn("code", F.greatest("code", F.coalesce(F.lead("code").over(Window.partitionBy(*by).orderBy(time)), F.lit(0))))
    return out


def anova_permuted(
    cube: DimFrame,
    subjects: DataFrame | None,
    between: Sequence[str] = (),
    within: Sequence[str] = (),
    n: int = 999,
    seed: int = 1,
    id_dim: str = "id",
    covariates: Sequence[str] = (),
    what: str = "residuals",
    by: Sequence[str] = (),
    shuffles: Shuffles | Given | None = None,
) -> DataFrame:
    """ANOVA with p_corr: how often the largest F of a term, over all cells of a combination of ``by``, is greater after a shuffle.

    ``what``: residuals of the model of all terms are shuffled, or observations.
    ``shuffles`` takes the place of ``n`` and ``seed``.
    """
    design = design_of(cube, subjects, between, within, covariates, id_dim)
    keys = [*by, "modelterm"]
    maxima = largest(permuted_f(cube, design, shuffles or Shuffles(design, n, seed), what, id_dim, by), keys)
    return corrected_p(anova(cube, subjects, between, within, id_dim, covariates=covariates), maxima, keys)


def peak_anova(cube: DimFrame, subjects: DataFrame | None, low, high, between: Sequence[str] = (), within: Sequence[str] = (), time: str = "time", id_dim: str = "id", around: int = 1, largest: bool = True) -> DataFrame:
    """ANOVA of the time (measure ``peak``) and the height (``amplitude``) of each series' peak in a range of times."""
    found = peaks(cube, time, low, high, largest, around)
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias(cube.value)) for m in ("peak", "amplitude")])
    long = found.select(*cube.others(time), F.inline(cells))
    return anova(DimFrame(long, (*cube.drop_dims(time), Dim("measure", ("peak", "amplitude"))), cube.value), subjects, between, within, id_dim)


