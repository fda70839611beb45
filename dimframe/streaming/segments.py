"""Segments over streams: means of event values in windows of event time.

An addition for streams of samples: the same binning that ``avg_bin`` does over
a stored cube, with a watermark for late data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned(stream: DataFrame, chan: str, time: str, value: str, length: str, late: str = "10 minutes") -> DataFrame:
    """chan, bin_start, value, n: means of windows of ``length``; rows later than ``late`` are left out.

    ``stream`` may be a batch DataFrame, too. State: one row for each channel and
    open window.
    """
    rows = stream.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late)
    out = rows.groupBy(chan, F.window(time, length).alias("_w")).agg(F.avg(value).alias("value"), F.count(value).alias("n"))
    return out.select(F.col(chan).alias("chan"), F.col("_w.start").alias("bin_start"), "value", "n")
