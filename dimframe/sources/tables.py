"""Cubes over tables, and frames as tables again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import Dim, DimFrame


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube_of(df: DataFrame, dims: Mapping[str, Column], value: Column, levels: Mapping[str, Sequence] | None = None) -> DimFrame:
    """A cube of means of ``value`` over the combinations of some columns; NaN counts as null."""
    v = F.when(F.isnan(value.cast("double")), None).otherwise(value.cast("double"))
    out = df.groupBy(*[c.alias(n) for n, c in dims.items()]).agg(F.avg(v).alias("value"))
    return DimFrame(out, tuple(Dim(n, tuple(levels[n]) if levels and n in levels else None) for n in dims))


def write(cube: DimFrame, path: str, by: Sequence[str] = (), mode: str = "error") -> None:
    """The cube's cells as Parquet, in folders by dimensions of few levels."""
    writer = cube.long().write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)
