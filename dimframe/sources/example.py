"""A made-up recording of averaged potentials: conditions x channels x times x subjects, with two groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import Dim, DimFrame

CONDITIONS, PAIRS = ("A", "B", "C"), ("ident", "subst", "transp")


def example_cube(spark: SparkSession, channels: int = 33, first: int = -50, last: int = 500, step: int = 2, subjects: int = 20) -> DimFrame:
    """Two bumps over time whose size depends on condition, pair and group, smooth over channels, with noise by hash.

    Made in parallel from a range of cell numbers, so it may have any size.
    """
    times = (last - first) // step + 1
    sizes = (("stimclass", len(CONDITIONS)), ("pairtype", len(PAIRS)), ("chan", channels), ("time", times), ("id", subjects))
    total = 1
    for _, n in sizes:
        total *= n
    df, rest = spark.range(total).withColumnRenamed("id", "_n"), F.col("_n")
    for name, n in sizes:
        df = df.withColumn(f"_{name}", F.pmod(rest, F.lit(n)).cast("int"))
        rest = F.floor(rest / n)
    t = F.lit(first) + F.col("_time") * step
    bump = lambda at, width: F.exp(-F.pow((t - at) / width, F.lit(2.0)))
    size = 1 + 0.3 * F.col("_stimclass") - 0.2 * F.col("_pairtype") + 0.4 * (F.col("_id") % 2)
    noise = (F.pmod(F.xxhash64("_n"), F.lit(20001)) - 10000) / 10000.0
    value = size * (2 * bump(120, 40.0) - 1.5 * bump(300, 80.0)) * F.cos(F.col("_chan") * 3.1416 / channels) + noise
    pick = lambda names, c: F.get(F.array(*[F.lit(v) for v in names]), F.col(c))
    df = df.select(
        pick(CONDITIONS, "_stimclass").alias("stimclass"), pick(PAIRS, "_pairtype").alias("pairtype"), F.format_string("E%02d", F.col("_chan") + 1).alias("chan"),
        t.cast("int").alias("time"), F.format_string("%02d", F.col("_id") + 1).alias("id"), value.alias("value"),
    )
    return DimFrame(df, (Dim("stimclass", CONDITIONS), Dim("pairtype", PAIRS), Dim("chan"), Dim("time"), Dim("id")))


def example_subjects(spark: SparkSession, subjects: int = 20) -> DataFrame:
    """id, group: control or dl."""
    return spark.range(1, subjects + 1).select(F.format_string("%02d", F.col("id")).alias("id"), F.when(F.col("id") % 2 == 1, "control").otherwise("dl").alias("group"))
