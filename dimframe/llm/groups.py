"""Distributed helpers: connected components, and groups of rows inside a partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def pieces(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """A stream of frames that is sorted by ``keys``, cut where they change."""
    for b in batches:
        if not len(b):
            continue
        new = np.zeros(len(b), bool)
        new[0] = True
        for k in keys:
            v = b[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cuts = [*np.flatnonzero(new), len(b)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            yield b.iloc[a:z]


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a stream of frames that is sorted by ``keys``, each whole."""
    held: list[pd.DataFrame] = []
    for b in pieces(batches, keys):
        if held and any(held[-1][k].iloc[-1] != b[k].iloc[0] for k in keys):
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        held.append(b)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a group in one partition, next to each other."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner", share: int = 1000) -> DataFrame:
    """``rows`` joined ("inner" or "left") with ``table``, so that no key brings a large part of ``rows`` into one task.

    ``table`` has one row for each key ``on`` and a column ``n``, the key's rows
    in ``rows``. Keys with more than 1 / ``share`` of all rows, fewer than
    ``share`` whatever the data, are broadcast, and their rows stay where they
    are; the others meet in a shuffle. Both are read twice: pass written tables.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * share > total
    hot, cold = table.where(is_hot).drop("n"), table.where(~is_hot).drop("n")
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(cold, on, how))


def salted_join(rows: DataFrame, table: DataFrame, on: list[str], spread: list[str], counts: DataFrame, each: int = 1000, share: int = 1000, how: str = "inner") -> DataFrame:
    """``rows`` joined ("inner" or "left") with ``table``, whose rows may be large, so that no key brings a large part of ``rows`` into one task.

    ``counts`` has the keys and ``n``, the rows of each; keys with few rows may
    be missing. Keys with more than 1 / ``share`` of the rows counted are split into parts of ``each`` rows, by a hash of
    the columns ``spread``, and their rows of ``table`` are sent to every part.
    Only the keys that are split, fewer than ``share``, are broadcast, as
    numbers. ``counts`` is read twice: pass a written table.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    parts = F.broadcast(counts.where((F.col("n") * share > total) & (F.col("n") > each)).select(*on, F.ceil(F.col("n") / each).alias("_parts")))
    number = F.coalesce("_parts", F.lit(1)).cast("long")
    left = rows.join(parts, on, "left").withColumn("_part", F.pmod(F.xxhash64(*spread), number)).drop("_parts")
    right = table.join(parts, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), number - 1))).drop("_parts")
    return left.join(right, [*on, "_part"], how).drop("_part")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the undirected edges (a, b): columns a (node), b (least node reachable).

    Nodes that are the least of their component have no row. Alternates large-
    and small-star steps, which move every node's links to the least node near
    it, until nothing changes; each round is written to the shared folder, and
    only its row count and checksum come to the driver. A node with many links
    is handled by partial minima and a join that may be split, not in one group.
    """
    edges = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        last, edges = edges, written(small, name)
        discard(last)
        after = _state(edges)
        if after == before:
            return edges
        before = after
