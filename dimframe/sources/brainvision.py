"""Reading BrainVision recordings: a header, binary samples and markers, as DataFrames."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..core import Dim, DimFrame
from ..operators.artifacts import blanked, segment_numbers, segments
from .samples import NAME, RANGE, Samples


@dataclass(frozen=True)
class ImportOptions:
    """Which markers begin, keep and spoil segments (regular expressions)."""

    new_segment: str = "New Segment"
    time0: str = "Time 0"
    segment: str = "Target"
    keep: str = ".*"
    bad_category: str = "Bad Interval"
    bad_stimulus: str | None = None
    first: int = -100
    last: int = 1023


def read_header(spark: SparkSession, path: str) -> dict[str, str]:
    """The ``key=value`` lines of a header, values in lower case; keys that repeat keep the first value."""
    lines = spark.read.text(path).where(F.col("value").contains("=")).select(F.trim(F.element_at(F.split("value", "=", 2), 1)).alias("k"), F.lower(F.trim(F.element_at(F.split("value", "=", 2), 2))).alias("v"))
    out: dict[str, str] = {}
    for k, v in lines.collect():  # a header has some lines for each channel
        out.setdefault(k, v)
    return out


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    """chan, n, r, theta, phi: the first ``Ch<n>=`` line of a channel has its name, the second its place."""
    lines = [r["value"] for r in spark.read.text(path).where(F.col("value").rlike(r"^Ch\d+=")).collect()]
    half = len(lines) // 2
    names = [x.split("=", 1)[1].split(",")[0] for x in lines[:half]]
    places = [[float(v) for v in x.split("=", 1)[1].split(",")[:3]] for x in lines[half:]]
    return spark.createDataFrame([(n, k + 1, *p) for k, (n, p) in enumerate(zip(names, places, strict=True))], "chan string, n int, r double, theta double, phi double")


def read_samples(spark: SparkSession, path: str, header: dict[str, str], names: list[str]) -> DataFrame:
    """chan, sample (from 1), value of a binary file of 32-bit integers, in thousandths.

    One file is one task's work; ``samples_of`` reads large files and many
    recordings in ranges.
    """
    channels, by_channel = int(header["NumberOfChannels"]), header["DataOrientation"].startswith("vectorized")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["content"]:
                x = np.frombuffer(raw, "<i4") / 1000
                x = x.reshape(channels, -1) if by_channel else x.reshape(-1, channels).T
                for k in range(channels):
                    yield pd.DataFrame({"chan": names[k], "sample": np.arange(1, x.shape[1] + 1), "value": x[k]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "chan string, sample long, value double")


def read_markers(spark: SparkSession, path: str, options: ImportOptions = ImportOptions()) -> DataFrame:  # noqa: B008
    """type, description, position, size, channel, segmind of the markers that have a position."""
    return segment_numbers(marker_fields(spark.read.text(path)), "position", F.col("type").rlike(options.new_segment))


def marker_fields(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The fields of lines of markers (``value``) that have a position."""
    parts = F.split(F.regexp_replace("value", r"^Mk\d+=", ""), ",")
    field = lambda k: F.trim(F.get(parts, F.lit(k)))
    rows = lines.where(F.col("value").rlike(r"^Mk\d+="))
    rows = rows.select(*keys, field(0).alias("type"), field(1).alias("description"), field(2).try_cast("long").alias("position"), field(3).try_cast("long").alias("size"), field(4).try_cast("long").alias("channel"))
    return rows.where("position is not null")


def good_segments(markers: DataFrame, options: ImportOptions = ImportOptions(), keys: Sequence[str] = ()) -> DataFrame:  # noqa: B008
    """The anchors of segments to keep: none of their markers is bad, and they have a segment's marker at time 0; ``keys`` tell recordings apart."""
    o, by = options, [*keys, "segmind"]
    bad = F.col("type").rlike(o.bad_category) | (F.col("description").rlike(o.bad_stimulus) if o.bad_stimulus else F.lit(False))
    spoiled = markers.groupBy(*by).agg(F.bool_or(bad).alias("bad")).where("bad").select(*by)
    kept = markers.where(F.col("type").rlike(o.segment) & F.col("description").rlike(".*" if o.keep == "*" else o.keep))
    anchors = markers.where(F.col("type").rlike(o.time0) | F.col("description").rlike(o.time0)).groupBy(*by).agg(F.min("position").alias("position"))
    labels = kept.groupBy(*by).agg(F.min("description").alias("segment"))
    return anchors.join(labels, by).join(spoiled, by, "left_anti")


def check_segments(header: dict[str, str], markers: DataFrame) -> None:
    """Raises ValueError unless the samples of a header make as many segments as its markers begin."""
    expected = int(header["DataPoints"]) / int(header["SegmentDataPoints"])
    found = markers.agg(F.max("segmind")).first()[0] or 0
    if found != expected:
        raise ValueError(f"markers and samples do not match: {found} segments begin, the samples make {expected:g}")


def recording(spark: SparkSession, header_path: str, sample_path: str, marker_path: str, options: ImportOptions = ImportOptions()) -> DimFrame:  # noqa: B008
    """The good segments of one recording as a cube of chan, time (ms) and trial.

    A segment has the samples from ``options.first`` to ``options.last`` around
    its anchor; samples that the recording lacks have no cells. A trial is named
    by its marker, and by its segment's number too where the marker repeats.
    Fails if markers and samples do not match. Intervals in which a channel is
    bad are not blanked here: see ``artifacts.bad_intervals`` and ``blanked``.
    """
    header = read_header(spark, header_path)
    names = [r["chan"] for r in read_channels(spark, header_path).orderBy("n").collect()]  # as many as channels
    if len(names) != int(header["NumberOfChannels"]):
        raise ValueError(f"the header says {header['NumberOfChannels']} channels and lists {len(names)}")
    markers = read_markers(spark, marker_path, options)
    check_segments(header, markers)
    good = good_segments(markers, options)
    repeats = F.count(F.lit(1)).over(Window.partitionBy("segment")) > 1
    trial = F.when(repeats, F.concat_ws("_", "segment", "segmind")).otherwise(F.col("segment"))
    anchors = good.select("position", trial.alias("trial"))
    cells = segments(read_samples(spark, sample_path, header, names), anchors, options.first, options.last)
    ms = float(header["SamplingInterval"]) / 1000
    return DimFrame(cells.select("chan", (F.col("offset") * ms).alias("time"), "trial", "value"), (Dim("chan", tuple(names)), Dim("time"), Dim("trial")))


def _of_file(paths: Mapping[str, str]) -> Column:
    """The recording that a line of text was read from."""
    known = {unquote(urlparse(p).path): i for i, p in paths.items()}
    if len(known) < len(paths):
        raise ValueError("two recordings share a file")
    return F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.url_decode(F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z0-9]+:(//[^/]*)?(?=/)", ""), r"\+", "%2B"))]


def read_headers(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, tuple[dict[str, str], list[str]]]:
    """The header and the channels' names of each recording, all headers in one read."""
    rows = spark.read.text(list(paths.values()), wholetext=True).select(_of_file(paths).alias("id"), "value").collect()  # some lines for each channel
    out = {}
    for r in rows:
        pairs = [(k.strip(), v.strip()) for k, v in (x.split("=", 1) for x in r["value"].splitlines() if "=" in x)]
        header = {k: v.lower() for k, v in reversed(pairs)}
        names: dict[str, str] = {}
        for k, v in pairs:
            if re.fullmatch(r"Ch\d+", k):
                names.setdefault(k, v.split(",")[0])
        if len(names) != int(header["NumberOfChannels"]):
            raise ValueError(f"the header of {r['id']} says {header['NumberOfChannels']} channels and lists {len(names)}")
        out[r["id"]] = header, list(names.values())
    return out


def samples_of(spark: SparkSession, paths: Mapping[str, str], headers: Mapping[str, tuple[dict[str, str], list[str]]], size: int = RANGE) -> DataFrame:
    """id, chan, sample (from 1), value of many recordings, ``size`` samples to a task; filters on the first three are read no further."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Samples)
    known = [{"id": i, "path": p, "channels": headers[i][1], "by_channel": headers[i][0]["DataOrientation"].startswith("vectorized"), "points": int(headers[i][0]["DataPoints"])} for i, p in paths.items()]
    return spark.read.format(NAME).option("recordings", json.dumps(known)).option("range", size).load()


def recordings(spark: SparkSession, files: Mapping[str, tuple[str, str, str]], options: ImportOptions = ImportOptions(), bad: DataFrame | None = None, size: int = RANGE) -> DimFrame:  # noqa: B008
    """The good segments of many recordings as one cube of chan, time (ms), trial and id.

    ``files`` gives each id's header, samples and markers. Segments are as in
    ``recording``; times follow from each recording's own sampling interval.
    ``bad`` (id, chan, start, stop: samples, both included) makes the samples of
    a channel null. Channels need not be the same everywhere. A recording whose
    markers and samples do not match is an error.
    """
    headers = read_headers(spark, {i: f[0] for i, f in files.items()})
    at = {i: f[2] for i, f in files.items()}
    lines = spark.read.text(list(at.values())).select(_of_file(at).alias("id"), "value")
    markers = segment_numbers(marker_fields(lines, ["id"]), "position", F.col("type").rlike(options.new_segment), by=["id"])
    found = {r["id"]: r["n"] for r in markers.groupBy("id").agg(F.max("segmind").alias("n")).collect()}  # a row for each recording
    for i, (header, _) in headers.items():
        expected = int(header["DataPoints"]) / int(header["SegmentDataPoints"])
        if found.get(i, 0) != expected:
            raise ValueError(f"markers and samples of {i} do not match: {found.get(i, 0)} segments begin, the samples make {expected:g}")
    good = good_segments(markers, options, ["id"])
    repeats = F.count(F.lit(1)).over(Window.partitionBy("id", "segment")) > 1
    trial = F.when(repeats, F.concat_ws("_", "segment", "segmind")).otherwise(F.col("segment"))
    samples = samples_of(spark, {i: f[1] for i, f in files.items()}, headers, size)
    if bad is not None:
        samples = blanked(samples, bad.select("id", "chan", "start", "stop"), ["id", "chan"])
    cells = segments(samples, good.select("id", "position", trial.alias("trial")), options.first, options.last, keys=["id"])
    ms = F.create_map(*[F.lit(x) for i, (header, _) in headers.items() for x in (i, float(header["SamplingInterval"]) / 1000)])[F.col("id")]
    names = tuple(dict.fromkeys(c for _, cs in headers.values() for c in cs))
    return DimFrame(cells.select("chan", (F.col("offset") * ms).alias("time"), "trial", "id", "value"), (Dim("chan", names), Dim("time"), Dim("trial"), Dim("id")))


def split_markers(markers: DataFrame, column: str, names: list[str], kinds: list[str], sep: str = "_") -> DataFrame:
    """A code as typed columns; the types are recycled."""
    parts = F.split(F.col(column), "\\Q" + sep + "\\E")
    return markers.select("*", *[F.get(parts, F.lit(k)).try_cast(kinds[k % len(kinds)]).alias(n) for k, n in enumerate(names)])
