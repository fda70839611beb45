"""Mass-univariate t tests: one for each combination of the other dimensions, in one aggregation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import DimFrame
from ..functions.dist import t_p_col


def _finish(df: DataFrame, keep: list[str], with_p: bool) -> DataFrame:
    out = df.select(*keep, "stat", "df", "es")
    return out.withColumn("p", t_p_col(F.col("stat"), F.col("df"))) if with_p else out


def ttest_independent(cube: DimFrame, group: str, first, second, id_dim: str = "id", var_equal: bool = False, with_p: bool = True) -> DataFrame:
    """Two groups of ids (a column ``group`` of the cube's rows): stat, df, es (Cohen's d), p.

    Welch's test, or with ``var_equal`` the pooled one. Rows of no group are left
    out; zero variance gives nulls.
    """
    others = [d for d in cube.others(id_dim) if d != group]
    v = F.col(cube.value)
    one = [F.when(F.col(group) == g, v) for g in (first, second)]
    aggs = [f(x).alias(f"{n}{k}") for k, x in enumerate(one, 1) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))]
    rows = cube.df.groupBy(*others).agg(*aggs)
    m = F.col("m1") - F.col("m2")
    s1, s2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    if var_equal:
        df = F.col("n1") + F.col("n2") - 2
        pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / df
        rows = rows.withColumn("stat", m / F.nullif(F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2"))), F.lit(0.0))).withColumn("df", df.cast("double")).withColumn("es", F.abs(m) / F.nullif(F.sqrt(pooled), F.lit(0.0)))
    else:
        rows = rows.withColumn("stat", m / F.nullif(F.sqrt(s1 + s2), F.lit(0.0)))
        rows = rows.withColumn("df", (s1 + s2) * (s1 + s2) / F.nullif(s1 * s1 / (F.col("n1") - 1) + s2 * s2 / (F.col("n2") - 1), F.lit(0.0)))
        rows = rows.withColumn("es", F.abs(m) / F.nullif(F.sqrt((F.col("v1") + F.col("v2")) / 2), F.lit(0.0)))
    return _finish(rows, others, with_p)


def ttest_one(cube: DimFrame, mu: float = 0.0, id_dim: str = "id", with_p: bool = True) -> DataFrame:
    """One sample against ``mu``: stat, df, es, p."""
    others = cube.others(id_dim)
    v = F.col(cube.value)
    rows = cube.df.groupBy(*others).agg(F.avg(v).alias("m"), F.stddev_samp(v).alias("s"), F.count(v).alias("n"))
    z = (F.col("m") - F.lit(float(mu))) / F.nullif(F.col("s"), F.lit(0.0))
    return _finish(rows.withColumn("stat", z * F.sqrt("n")).withColumn("df", (F.col("n") - 1).cast("double")).withColumn("es", F.abs(z)), others, with_p)


def ttest_paired(first: DimFrame, second: DimFrame, mu: float = 0.0, id_dim: str = "id", with_p: bool = True) -> DataFrame:
    """The first cube minus the second, cell by cell, against ``mu``."""
    other = second.df.select(*first.names, F.col(second.value).alias("_other"))
    diff = first.df.join(other, first.names).withColumn(first.value, F.col(first.value) - F.col("_other")).drop("_other")
    return ttest_one(first.but(diff), mu, id_dim, with_p)


def random_groups(labels: list[int], n: int, seed: int | None = None) -> np.ndarray:
    """``n`` distinct relabellings of two groups (1, 2), a row each, none as observed.

    All are listed and chosen from when ``n`` is over a third of their number;
    asking for more than there are is an error.
    """
    labels, rng = np.asarray(labels), np.random.default_rng(seed)
    size, ones = len(labels), int((labels == labels.min()).sum())
    most = math.comb(size, ones) - 1
    if n > most:
        raise ValueError(f"{n} permutations asked for, {most} exist")
    low, high = labels.min(), labels.max()
    if n > most / 3:
        from itertools import combinations

        every = []
        for at in combinations(range(size), ones):
            row = np.full(size, high)
            row[list(at)] = low
            if (row != labels).any():
                every.append(row)
        return np.array(every)[rng.choice(len(every), n, replace=False)]
    seen, out = {labels.tobytes()}, []
    while len(out) < n:
        row = rng.permutation(labels)
        if row.tobytes() not in seen:
            seen.add(row.tobytes())
            out.append(row)
    return np.array(out)


def random_labels(labels: list, n: int, seed: int | None = None) -> np.ndarray:
    """``n`` distinct rearrangements of any labels, none as observed; more than exist is an error."""
    labels, rng = np.asarray(labels), np.random.default_rng(seed)
    most = math.factorial(len(labels))
    for c in np.unique(labels, return_counts=True)[1]:
        most //= math.factorial(int(c))
    if n > most - 1:
        raise ValueError(f"{n} permutations asked for, {most - 1} exist")
    seen, out = {labels.tobytes()}, []
    while len(out) < n:
        row = rng.permutation(labels)
        if row.tobytes() not in seen:
            seen.add(row.tobytes())
            out.append(row)
    return np.array(out)


def random_signs(size: int, n: int, seed: int | None = None) -> np.ndarray:
    """``n`` distinct rows of signs, none all positive; more than exist is an error."""
    rng, most = np.random.default_rng(seed), 2**size - 1
    if n > most:
        raise ValueError(f"{n} sign changes asked for, {most} exist")
    if n > most / 3:
        codes = rng.choice(most, n, replace=False) + 1
        return 1 - 2 * ((codes[:, None] >> np.arange(size)) & 1)
    seen, out = {np.ones(size, int).tobytes()}, []
    while len(out) < n:
        row = rng.integers(0, 2, size) * 2 - 1
        if row.tobytes() not in seen:
            seen.add(row.tobytes())
            out.append(row)
    return np.array(out)
