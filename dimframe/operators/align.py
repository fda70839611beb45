"""Resampling and elastic registration of series in time."""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import DimFrame


def _series(cube: DimFrame, time: str) -> DataFrame:
    return cube.df.groupBy(*cube.others(time)).agg(F.array_sort(F.collect_list(F.struct(F.col(time).cast("double").alias("t"), F.col(cube.value).cast("double").alias("v")))).alias("s"))


def aligned(cube: DimFrame, gammas: DataFrame, time: str = "time", gamma: str = "gamma") -> DimFrame:
    """Each series read at (t_last - t_first) * gamma + t_first, linearly between samples, null outside.

    ``gammas`` has some of the cube's dimensions, ``time`` among them, and the
    warping value in [0, 1]; it holds for all levels of the other dimensions.
    """
    on = [c for c in gammas.columns if c in cube.names and c != time]
    warps = gammas.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(F.col(time).cast("double").alias("t"), F.col(gamma).cast("double").alias("g")))).alias("w"))
    rows = _series(cube, time).join(warps, on) if on else _series(cube, time).crossJoin(F.broadcast(warps))

    @F.pandas_udf("array<double>")
    def read(s: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for a, g in zip(s, w, strict=True):
            t, v = (np.array([x[k] if x[k] is not None else np.nan for x in a], float) for k in ("t", "v"))
            at = (t[-1] - t[0]) * np.array([x["g"] for x in g], float) + t[0]
            y = np.interp(at, t, v, left=np.nan, right=np.nan)
            out.append([None if np.isnan(x) else float(x) for x in y])
        return pd.Series(out)

    others = cube.others(time)
    shown = rows.select(*others, F.arrays_zip(F.transform("w", lambda x: x["t"]).alias("t"), read("s", "w").alias("v")).alias("z")).select(*others, F.explode("z").alias("z"))
    kind = cube.df.schema[time].dataType
    return cube.but(shown.select(*others, F.col("z.t").cast(kind).alias(time), F.col("z.v").alias(cube.value)))


def _slope(v: np.ndarray) -> np.ndarray:
    d = np.gradient(v)
    return np.sign(d) * np.sqrt(np.abs(d))


#: Steps (forward in the template, in the series) of the warping path.
_STEPS = tuple((a, b) for a in range(1, 5) for b in range(1, 5) if np.gcd(a, b) == 1)


def best_warp(template: np.ndarray, series: np.ndarray, stiffness: float = 0.0) -> np.ndarray:
    """The warping of [0, 1] that moves a series' square-root slope nearest to the template's, by dynamic programming."""
    n = len(template)
    cost, back = np.full((n, n), np.inf), np.zeros((n, n), int)
    cost[0, 0] = 0
    for i in range(1, n):
        best = np.full(n, np.inf)
        for s, (a, b) in enumerate(_STEPS):
            if i < a:
                continue
            root = np.sqrt(b / a)
            j = np.arange(b, n)
            part = np.zeros(len(j))
            for k in range(a):
                at = j - b + k * b / a
                part += (template[i - a + k] - root * np.interp(at, np.arange(n), series)) ** 2
            total = cost[i - a, j - b] + part + stiffness * (1 - root) ** 2 * a
            better = total < best[j]
            best[j[better]] = total[better]
            back[i, j[better]] = s
        cost[i] = best
    i = j = n - 1
    path = [(i, j)]
    while i > 0 and j > 0:
        a, b = _STEPS[back[i, j]]
        i, j = i - a, j - b
        path.append((i, j))
    if path[-1] != (0, 0):
        path.append((0, 0))
    x, y = np.array(path[::-1], float).T / (n - 1)
    return np.interp(np.linspace(0, 1, n), x, y)


def _cut(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder that the cluster names; on one machine a fresh folder takes its place."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="dimframe-"))
    return df.checkpoint()


def warped(cube: DimFrame, align: str, time: str = "time", rounds: int = 5, stiffness: float = 0.0, median: bool = False) -> DimFrame:
    """gamma in [0, 1] for each time of each series: elastic registration over the levels of ``align``.

    The series of a combination of the other dimensions, one for each level of
    ``align`` and all at the same times, are moved onto their common mean (or
    median) in square-root slope space. A template, first the series nearest to
    the mean, goes to the series, each of which is warped in its own row; the
    mean of what comes out, by place, is the next template. A combination whose
    template hardly changes keeps it.
    """
    others = cube.others(align, time)
    kind = cube.df.schema[time].dataType
    part = lambda k: F.transform("s", lambda x: x[k])

    @F.pandas_udf("array<double>")
    def slopes(v: pd.Series) -> pd.Series:
        return pd.Series([_slope(np.asarray(x, float)).tolist() for x in v])

    @F.pandas_udf("array<double>")
    def gammas(q: pd.Series, template: pd.Series) -> pd.Series:
        return pd.Series([best_warp(np.asarray(t, float), np.asarray(x, float), stiffness).tolist() for x, t in zip(q, template, strict=True)])

    @F.pandas_udf("array<double>")
    def moved(v: pd.Series, gamma: pd.Series) -> pd.Series:
        return pd.Series([_slope(np.interp(g, np.linspace(0, 1, len(x)), x)).tolist() for x, g in zip(v, gamma, strict=True)])

    def middle(rows: DataFrame, name: str, into: str) -> DataFrame:
        """The mean or median of arrays, place by place."""
        places = rows.select(*others, F.posexplode(name).alias("_k", "_x")).groupBy(*others, "_k").agg((F.median if median else F.avg)("_x").alias("_x"))
        return places.groupBy(*others).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_x"))), lambda c: c["_x"]).alias(into))

    def met(rows: DataFrame, table: DataFrame) -> DataFrame:
        return rows.join(table, others) if others else rows.crossJoin(F.broadcast(table))  # without other dimensions the table is one row

    far = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x - y, 2)), F.lit(0.0), lambda x, y: x + y)
    base = _cut(_series(cube, time).select(*others, align, part("t").alias("t"), part("v").alias("v")).withColumn("q", slopes("v")))
    template = met(base, middle(base, "q", "_m")).groupBy(*others).agg(F.min_by("q", F.struct(far("q", "_m"), F.col(align))).alias("template"))
    for _ in range(rounds - 1):
        template = _cut(template)
        new = middle(met(base, template).withColumn("_g", gammas("q", "template")).withColumn("_w", moved("v", "_g")), "_w", "_new")
        near = far("_new", "template") < 1e-6 * F.greatest(far("template", F.transform("template", lambda x: F.lit(0.0))), F.lit(1e-12))
        template = met(template, new).select(*others, F.when(near, F.col("template")).otherwise(F.col("_new")).alias("template"))
    out = met(base, _cut(template)).withColumn("_g", gammas("q", "template"))
    shown = out.select(*others, align, F.explode(F.arrays_zip("t", "_g")).alias("z"))
    return cube.but(shown.select(*others, align, F.col("z.t").cast(kind).alias(time), F.col("z._g").alias("gamma")), value="gamma")
