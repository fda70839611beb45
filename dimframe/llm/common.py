"""Helpers shared by the training-data operators.

Words are maximal runs of characters other than ASCII white space (``WORD``).
Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
all machines of a cluster share; only where that setting is missing (tests,
a laptop) a fresh local folder takes its place.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)
#: ASCII characters at which str.split() splits although they belong to words
_CONTROLS = re.compile(r"[\x1c-\x1f]")


def words(text: str | None) -> list[str]:
    """The words of a text, in order; none for null."""
    if not text:
        return []
    # str.split() without an argument also splits at other Unicode spaces, which belong to words here
    return text.split() if text.isascii() and not _CONTROLS.search(text) else _WORD.findall(text)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, on one machine a fresh local folder if that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="dimframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as a table to the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that no later plan reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is computed inside sends Python ``rows`` rows at a time, for rows that may be large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def empty_text(col: str | Column) -> Column:
    """The text, the empty text for null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64), for whole arrays."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash64(word: str) -> int:
    """A 64-bit hash of a word that is the same on every machine."""
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class WordHashes(dict):
    """Remembers the hashes of words, ``most`` of up to ``longest`` characters, and then starts afresh; made for one task."""

    def __init__(self, most: int = 250_000, longest: int = 40):
        super().__init__()
        self.most, self.longest = most, longest

    def __missing__(self, word: str) -> int:
        value = hash64(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value

    def array(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))
