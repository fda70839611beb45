"""A Spark data source of the samples of BrainVision recordings, by byte ranges.

A partition is a range of samples of one recording, of one channel where the
file goes channel by channel. Filters on recording, channel and sample choose
partitions and bytes before anything is read. Files are opened in the tasks by
pyarrow, so a path is a URI of a store that pyarrow knows, or a local file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

NAME = "brainvision_samples"
#: Samples of a partition, unless the option ``range`` says otherwise.
RANGE = 1_000_000
#: Values of a batch.
BATCH = 65_536


@dataclass
class Part(InputPartition):
    """Samples ``first`` to before ``last`` (from 0) of some channels (by place) of a recording."""

    id: str
    path: str
    first: int
    last: int
    names: tuple[str, ...]
    places: tuple[int, ...]
    channels: int
    points: int
    by_channel: bool


class Samples(DataSource):
    """id, chan, sample (from 1) and value, thousandths of 32-bit integers.

    The option ``recordings`` is a JSON list of objects with id, path, channels
    (names in order), by_channel (whether the file goes channel by channel) and
    points (samples of a channel).
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "id string, chan string, sample long, value double"

    def reader(self, schema) -> SamplesReader:
        return SamplesReader(json.loads(self.options["recordings"]), int(self.options.get("range", RANGE)))


class SamplesReader(DataSourceReader):
    def __init__(self, recordings: list[dict], size: int):
        if size < 1:
            raise ValueError("a range has at least one sample")
        self.recordings, self.size = recordings, size
        self.only: dict[str, set] = {}
        self.first, self.last = 1, None

    def pushFilters(self, filters):  # noqa: N802 - the name Spark asks for
        """Takes filters on id, chan and sample; hands the others back."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in ("id", "chan") and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[name] = self.only.get(name, wanted) & wanted
            elif name == "sample" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif name == "sample" and isinstance(f, LessThan | LessThanOrEqual):
                end = f.value - isinstance(f, LessThan)
                self.last = end if self.last is None else min(self.last, end)
            else:
                yield f

    def partitions(self) -> list[Part]:
        out = []
        for r in self.recordings:
            wanted = [(k, c) for k, c in enumerate(r["channels"]) if "chan" not in self.only or c in self.only["chan"]]
            if ("id" in self.only and r["id"] not in self.only["id"]) or not wanted:
                continue
            end = r["points"] if self.last is None else min(r["points"], self.last)
            groups = [[w] for w in wanted] if r["by_channel"] else [wanted]
            for g in groups:
                for a in range(self.first - 1, end, self.size):
                    out.append(Part(r["id"], r["path"], a, min(a + self.size, end), tuple(c for _, c in g), tuple(k for k, _ in g), len(r["channels"]), r["points"], r["by_channel"]))
        return out or [Part("", "", 0, 0, (), (), 0, 0, True)]  # Spark asks for one partition at least

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.first >= part.last:
            return
        from pyarrow.fs import FileSystem

        system, path = FileSystem.from_uri(part.path)
        wide = 1 if part.by_channel else part.channels  # values of a sample that lie together
        step = max(1, BATCH // wide)
        with system.open_input_file(path) as f:
            for a in range(part.first, part.last, step):
                n = min(step, part.last - a)
                start = part.places[0] * part.points + a if part.by_channel else a * part.channels
                raw = f.read_at(4 * n * wide, 4 * start)
                if len(raw) != 4 * n * wide:
                    raise ValueError(f"{part.path} ends before sample {a + n}")
                x = np.frombuffer(raw, "<i4").reshape(n, wide)[:, [0] if part.by_channel else list(part.places)] / 1000
                sample = np.arange(a + 1, a + n + 1)
                for k, name in enumerate(part.names):
                    yield pa.RecordBatch.from_arrays([pa.array([part.id] * n), pa.array([name] * n), pa.array(sample), pa.array(np.ascontiguousarray(x[:, k]))], ["id", "chan", "sample", "value"])
