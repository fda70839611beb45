"""Segments of recordings: cutting, bad intervals and artifact rejection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import DimFrame


@dataclass(frozen=True)
class ArtifactOptions:
    """Limits: the largest step per millisecond, the least and largest range within an interval of ms, the least and largest value."""

    max_step: float | None = 50.0
    range_low: float | None = 0.5
    range_high: float | None = 100.0
    interval: int = 200
    low: float | None = -200.0
    high: float | None = 200.0
    hz: float = 1000.0


def artifacts(cube: DimFrame, options: ArtifactOptions = ArtifactOptions(), chan: str = "chan", time: str = "time", trial: str = "trial") -> DataFrame:  # noqa: B008
    """bad_step, bad_range, bad_value of each channel and trial. All windows share one sort."""
    o = options
    w = Window.partitionBy(*cube.others(time)).orderBy(time)
    v = F.col(cube.value)
    n = max(1, round(o.interval * o.hz / 1000))
    frame = w.rowsBetween(-(n - 1), 0)
    rows = cube.df.withColumn("_step", F.abs(v - F.lag(v).over(w)))
    rows = rows.withColumn("_range", F.when(F.count(F.lit(1)).over(frame) == n, F.max(v).over(frame) - F.min(v).over(frame)))
    either = lambda c, low, high: (F.lit(False) if low is None else c < low) | (F.lit(False) if high is None else c > high)
    hit = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return rows.groupBy(*cube.others(time)).agg(
        hit(F.lit(False) if o.max_step is None else F.col("_step") > o.max_step * 1000 / o.hz).alias("bad_step"),
        hit(either(F.col("_range"), o.range_low, o.range_high)).alias("bad_range"),
        hit(either(v, o.low, o.high)).alias("bad_value"),
    )


def artifact_summary(found: DataFrame, chan: str = "chan", trial: str = "trial") -> DataFrame:
    """The share of bad trials by criterion and channel, with ``all`` for any criterion and any channel."""
    long = found.select(F.col(chan).cast("string").alias("chan"), trial, F.inline(F.array(*[F.struct(F.lit(c).alias("crit"), F.col(c).alias("bad")) for c in ("bad_step", "bad_range", "bad_value")])))
    parts = []
    for chans in ((F.col("chan"),), (F.lit("all"),)):
        for crits in ((F.col("crit"),), (F.lit("all"),)):
            any_ = long.groupBy(chans[0].alias("chan"), crits[0].alias("crit"), trial).agg(F.bool_or("bad").alias("bad"))
            parts.append(any_.groupBy("chan", "crit").agg(F.avg(F.col("bad").cast("double")).alias("share")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reject(cube: DimFrame, found: DataFrame, trial: str = "trial") -> DimFrame:
    """The cube without the trials that are bad in any channel."""
    bad = found.where("bad_step or bad_range or bad_value").select(trial).distinct()
    return cube.but(cube.df.join(bad, trial, "left_anti"), step="rejected artifacts")


def segment_numbers(markers: DataFrame, position: str, is_new: Column, by: list[str] | None = None) -> DataFrame:
    """segmind: how many segments have begun at each marker's position; one window for each recording (``by``)."""
    w = Window.partitionBy(*(by or [])).orderBy(position).rangeBetween(Window.unboundedPreceding, 0)
    return markers.withColumn("segmind", F.sum(F.when(is_new, 1).otherwise(0)).over(w))


def segments(samples: DataFrame, anchors: DataFrame, first: int, last: int, position: str = "sample", anchor: str = "position", keys: list[str] | None = None) -> DataFrame:
    """The samples from ``first`` to ``last`` around each anchor, with their offset: an explode and an equi-join."""
    wanted = anchors.withColumn("offset", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn(position, F.col(anchor) + F.col("offset"))
    return samples.join(wanted, [*(keys or []), position])


def bad_intervals(markers: DataFrame, is_start: Column, is_stop: Column, position: str, last: int, by: list[str]) -> DataFrame:
    """start, stop of bad intervals: the k-th start goes with the k-th stop of each channel.

    One missing stop is the last sample, one missing start the first; more, or
    a stop before its start, is an error.
    """
    w = Window.partitionBy(*by).orderBy(position)
    starts = markers.where(is_start).select(*by, position).withColumn("k", F.row_number().over(w)).withColumnRenamed(position, "start")
    stops = markers.where(is_stop).select(*by, position).withColumn("k", F.row_number().over(w)).withColumnRenamed(position, "stop")
    counts = starts.groupBy(*by).agg(F.count(F.lit(1)).alias("a")).join(stops.groupBy(*by).agg(F.count(F.lit(1)).alias("b")), by, "full")
    counts = counts.select(*by, (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("d"))
    # with a start missing the first stop has none: the starts move on by one
    starts = starts.join(counts, by).withColumn("k", F.when(F.col("d") == -1, F.col("k") + 1).otherwise(F.col("k")))
    both = starts.select(*by, "k", "start").join(stops, [*by, "k"], "full").join(counts, by)
    start, stop = F.coalesce("start", F.lit(1)), F.coalesce("stop", F.lit(last))
    wrong = (F.abs("d") > 1) | (stop < start)
    return both.select(*by, F.when(wrong, F.raise_error(F.lit("starts and stops of bad intervals do not match")).cast("long")).otherwise(start.cast("long")).alias("start"), stop.cast("long").alias("stop"))


def blanked(samples: DataFrame, intervals: DataFrame, by: list[str], position: str = "sample", value: str = "value") -> DataFrame:
    """The samples with null inside intervals: an equi-join on buckets of 1024 positions and a check of the bounds."""
    size = 1024
    cover = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("stop") / size))))
    hits = samples.withColumn("_b", F.floor(F.col(position) / size)).join(cover, [*by, "_b"]).where(F.col(position).between(F.col("start"), F.col("stop")))
    hits = hits.select(*by, position).distinct().withColumn("_hit", F.lit(True))
    out = samples.join(hits, [*by, position], "left")
    return out.withColumn(value, F.when(F.col("_hit"), None).otherwise(F.col(value))).drop("_hit")
