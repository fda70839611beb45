"""Line deduplication by pairwise alignment.

A later document is aligned by patience diff with earlier ones that share rare
lines with it, and blocks of aligned lines are deleted from the later one. A
block is a run of lines that stand one after the other in both documents, and
has at least one line of some length; short and blank lines go as parts of it.

Which documents are aligned:

* A document with the same lines as an earlier one, whatever their length, is a
  copy and goes whole; the others, one of each kind, are *units*.
* Features of a unit are its long lines, and each of them with the line after it
  and with the line before it. The first unit that has a feature is a partner of
  every later unit that has it. For a rare line that is every holder.
* A long line that a unit holds once, and that no partner aligned, is tried with
  the other earlier units that hold it, in waves of about WAVE of them, until
  one aligns it or none is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, empty_text, small_batches, written
from .groups import salted_join, spread_join
from .sequences import patience_pairs

#: Characters that a line has at least, without white space around it, to be a feature.
LEAST_CHARS = 20
#: Holders of a line in a wave, on average.
WAVE = 8
#: Pairs of texts that a task hands to Python at once.
BATCH = 200


def aligned_places(mine: list[int], other: list[int]) -> list[int]:
    """Places of ``mine`` in aligned blocks. Documents are digests of lines, odd ones for long lines."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for p, q in [*patience_pairs(mine, other), (-2, -2)]:
        if (p, q) != (last[0] + 1, last[1] + 1):
            if any(mine[k] & 1 for k in block):
                out += block
            block = []
        block.append(p)
        last = p, q
    return out


def _coded(docs: DataFrame, least_chars: int) -> DataFrame:
    """doc (null ids are the largest), t (digest of the text), h (digests of the lines), x, y (digest of h) of rows with text."""
    lines = F.transform(F.split("text", "\n"), lambda s: F.trim(F.translate(s, "\r\t", "  ")))
    digest = lambda s: F.when(F.length(s) >= least_chars, F.xxhash64(F.lit(1), s).bitwiseOR(F.lit(1))).otherwise(F.xxhash64(F.lit(1), s).bitwiseAND(F.lit(-2)))
    rows = docs.where("text is not null").select(_order(), F.xxhash64("text").alias("t"), lines.alias("lines"))
    rows = rows.select("doc", "t", F.transform("lines", digest).alias("h"))
    return rows.select("doc", "t", "h", F.xxhash64("h").alias("x"), F.xxhash64(F.lit(7), "h").alias("y"))


def _order() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc")


def _long(v: Column) -> Column:
    return v.bitwiseAND(F.lit(1)) == 1


def _align(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """x, y, places: what the units (x, y) have in blocks aligned with any of their partners (a, b)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            places = [aligned_places(m.tolist(), o.tolist()) for m, o in zip(b["h"], b["other"], strict=True)]
            yield pd.DataFrame({"x": b["x"], "y": b["y"], "places": places})

    pairs = written(pairs, "pairs")
    lines = units.select("x", "y", "h")
    # a unit may be the partner of a large part of all others, or have many partners; arrays of lines are sent, never broadcast
    sides = [written(pairs.groupBy(*k).agg(F.count(F.lit(1)).alias("n")), "sides") for k in (["a", "b"], ["x", "y"])]
    both = salted_join(pairs, lines.withColumnsRenamed({"x": "a", "y": "b", "h": "other"}), ["a", "b"], ["x", "y"], sides[0])
    both = salted_join(both, lines, ["x", "y"], ["a", "b"], sides[1])
    found = both.select("x", "y", "h", "other").mapInPandas(run, "x long, y long, places array<int>")
    with small_batches(pairs.sparkSession, BATCH):
        out = written(found.groupBy("x", "y").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")), "aligned")
    discard(*sides)
    discard(pairs)
    return out


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc, t, n, places: for the texts that lose lines their places (null: all of them), and how many rows have the text."""
    coded = written(_coded(docs.where(F.col("text").rlike(r"[^\s]")), least_chars), "lines")
    units = written(coded.groupBy("x", "y").agg(F.min("doc").alias("unit"), F.count(F.lit(1)).alias("n"), F.first("h").alias("h")), "units")
    beside = lambda step: F.transform("h", lambda v, i: F.when(_long(v) & (i + step >= 0) & (i + step < F.size("h")), F.xxhash64(F.lit(step), v, F.get("h", i + step))))
    features = F.array_distinct(F.concat(F.filter("h", _long), F.array_compact(beside(1)), F.array_compact(beside(-1))))
    every = written(units.select(F.explode(features).alias("key"), "unit", "x", "y"), "features")
    shared = every.groupBy("key").agg(F.min(F.struct("unit", "x", "y")).alias("first"), F.max("unit").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = written(shared.where("first.unit < last").drop("last"), "shared")
    pairs = spread_join(every, shared, ["key"]).where("unit > first.unit").select("x", "y", F.col("first.x").alias("a"), F.col("first.y").alias("b")).distinct()
    cut = _align(pairs, units)

    # long lines held once that are left over, with their places, and have more holders than those tried
    rest = F.filter(
        F.transform("h", lambda v, i: F.struct(v.alias("key"), i.alias("place"))),
        lambda s: _long(s["key"]) & ~F.array_contains("places", s["place"]) & (F.size(F.filter("h", lambda w: w == s["key"])) == 1),
    )
    more = shared.where("n > 2").select("key", F.ceil(F.col("n") / WAVE).alias("waves"))
    left = units.join(cut, ["x", "y"]).select("x", "y", "unit", F.inline(rest)).join(more, "key")
    left, low, high, cuts = written(left, "left"), 0, 1, [cut]
    while not left.isEmpty():
        asked = left.where(F.col("waves") > low).withColumn("wave", F.explode(F.sequence(F.lit(low).cast("long"), F.least(F.lit(high), "waves") - 1)))
        holders = every.withColumnsRenamed({"unit": "earlier", "x": "a", "y": "b"}).join(left.select("key", "waves").distinct(), "key")
        holders = holders.select("key", F.pmod(F.xxhash64("key", "a", "b"), "waves").alias("wave"), "earlier", "a", "b")
        # all that ask for a common line ask for it in the first wave
        askers = written(asked.groupBy("key", "wave").agg(F.count(F.lit(1)).alias("n")), "askers")
        found = _align(salted_join(asked, holders, ["key", "wave"], ["x", "y"], askers).where("earlier < unit").select("x", "y", "a", "b").distinct(), units)
        discard(askers)
        cuts.append(found)
        low, high = high, 8 * high
        # only units that ask are looked at again: lines leave when a partner aligned them, or all their holders were tried
        before = left
        left = written(left.where(F.col("waves") > low).join(found, ["x", "y"], "left").where(F.coalesce(~F.array_contains("places", F.col("place")), F.lit(True))).drop("places"), "left")
        discard(before)
    discard(left, every, shared)
    every_cut = reduce(DataFrame.union, cuts).groupBy("x", "y").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))

    # from units to the rows of their texts: the first of a kind loses its places, later ones go whole
    kinds = units.select("x", "y", "unit", "n").join(every_cut, ["x", "y"], "left")
    rows = spread_join(coded.select("doc", "t", "x", "y"), written(kinds, "kinds"), ["x", "y"])
    rows = rows.where("doc > unit or size(places) > 0").select("doc", "t", F.when(F.col("doc") == F.col("unit"), F.col("places")).alias("places"))
    out = written(rows.groupBy("doc", "t").agg(F.count(F.lit(1)).alias("n"), F.first("places", ignorenulls=True).alias("places")), "repeated")
    discard(coded, units, *cuts)
    return out


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("removed", T.ArrayType(T.IntegerType()))]))
def without(text: pd.Series, places: pd.Series) -> pd.DataFrame:
    """Texts without the lines at some places (null: without any line), and these places in order."""
    out = []
    for t, at in zip(text, places, strict=True):
        if t is None:
            out.append((None, None))
            continue
        lines = t.split("\n")
        gone = set(range(len(lines)) if at is None else at.tolist())
        out.append(("\n".join(s for k, s in enumerate(lines) if k not in gone), sorted(gone)))
    return pd.DataFrame(out, columns=["text", "removed"])


# evaluated once, whatever is asked of its result
without = without.asNondeterministic()


def line_dedup(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Every row of ``docs`` with its ``text`` without the lines deleted, and n_lines, n_removed, removed (their places, from 0).

    Lines end at a newline, and are compared without white space around them. A
    text that is null or blank, or loses nothing, stays as it is (null has no
    lines); a text without a line of ``least_chars`` characters loses nothing
    unless it is a copy of an earlier one, and then all. Documents
    are in the order of doc_id; rows with equal ids are of one rank and take
    nothing from each other, whatever their texts; a null id is larger than all
    others. Columns n_lines, n_removed and removed of ``docs`` are replaced,
    other columns stay.
    """
    docs = docs.drop("n_lines", "n_removed", "removed")
    places = repeated_lines(docs, least_chars).withColumn("cut", F.lit(True))
    # whatever the columns are called, they travel as one; rows without text have keys of their own, which nothing has
    digest = F.when(F.col("text").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _order(), digest.alias("t"))
    rows = spread_join(rows, places, ["doc", "t"], "left")
    # Python gets the texts that lose lines, and no others
    rows = rows.withColumn("left", without(F.when(F.col("cut"), F.col("row.text")), F.col("places")))
    rows = rows.withColumn("removed", F.coalesce("left.removed", F.array().cast("array<int>")))
    text = F.when(F.col("cut"), F.col("left.text")).otherwise(F.col("row.text")).alias("text")
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(F.split("row.text", "\n"))).cast("long").alias("n_lines")
    return rows.select(*[text if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns], n_lines, F.size("removed").cast("long").alias("n_removed"), "removed")


def line_dedup_digest(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (places joined by commas), kept_sha256 of every row of ``docs``."""
    out = line_dedup(docs.select("doc_id", "text"), least_chars)
    return out.select("doc_id", "n_lines", "n_removed", F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed"), F.sha2(empty_text("text"), 256).alias("kept_sha256"))
