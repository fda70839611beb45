"""Near-duplicate documents by HyperMinHash banding and confirmation on whole shingle sets.

1. One pass over the texts gives each document the size, a 128-bit digest, the
   compressed registers and the band keys of its set of word shingles.
   Documents with equal sets become one class.
2. Classes that share a band key are candidates. First every class of a band
   bucket is compared with the bucket's least class: as many pairs as rows.
   Pairs pass if sizes and the corrected estimate allow the similarity asked
   for (five standard deviations are granted), and are confirmed on whole sets.
3. The links give components. A bucket that lies in one component is done. In
   every other bucket all pairs across components are compared by registers, in
   blocks of bounded size, each pair in its first common bucket; what passes is
   confirmed in place, and only true links leave a task.

With 32 bands of 4 registers, a pair at a similarity of 0.85 shares no bucket
with a probability of 6e-11 (0.80: 5e-8).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, discard, written
from .groups import components, dealt, runs, spread_join
from .shingles import REGISTERS, band_keys, estimated_jaccard, registers, shingle_set

BANDS = 32
#: Members of a block in which all pairs are compared.
BLOCK = 512
#: Sets up to this size are compared whatever their registers say: their registers are copies of few independent ones.
SMALL = 256


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |intersection| >= percent * |union| of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def least_estimate(percent: int) -> float:
    j = percent / 100
    return j - 5 * math.sqrt(j * (1 - j) / REGISTERS)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, t (digest of the text), n_shingles, cls (digest of the set; null if empty), regs, keys for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingle_set(t, hashes) for t in b["text"]]
            regs = np.stack([registers(s) if len(s) else np.zeros(REGISTERS, np.uint16) for s in sets]) if sets else np.zeros((0, REGISTERS), np.uint16)
            keys = band_keys(regs, BANDS).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "t": b["t"], "n_shingles": [len(s) for s in sets], "cls": [_digest(s) if len(s) else None for s in sets], "regs": [r.tobytes() for r in regs], "keys": list(keys)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInPandas(run, f"doc_id {kind}, t long, n_shingles long, cls binary, regs binary, keys array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, items (the sorted set as bytes) of the classes in ``wanted`` (cls, doc_id, t), made again from the texts. Rows without an id, or of one id, are told apart by their texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingle_set(t, hashes) for t in b["text"]]
            yield pd.DataFrame([(c, s.tobytes()) for c, s in zip(b["cls"], sets, strict=True) if _digest(s) == bytes(c)], columns=["cls", "items"])

    wanted = wanted.select("cls", F.col("doc_id").alias("_id"), F.col("t").alias("_t"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("t")).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))).select("cls", "text")
    return rows.mapInPandas(run, "cls binary, items binary").dropDuplicates(["cls"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar on whole sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b["x"], b["y"], strict=True)]
            yield b.loc[ok, ["a", "b"]]

    first = sets.select(F.col("cls").alias("a"), F.col("items").alias("x"))
    second = sets.select(F.col("cls").alias("b"), F.col("items").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInPandas(run, "a binary, b binary")


def _star_pairs(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Every member of a bucket with the bucket's least class, if registers and sizes allow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x, y = (np.stack([np.frombuffer(v, np.uint16) for v in b[c]]) for c in ("x", "y"))
            small = b[["n", "m"]].to_numpy().min(1) <= SMALL
            yield b.loc[small | (estimated_jaccard((x == y).sum(1)) >= least_estimate(percent)), ["a", "b"]]

    pairs = members.where("cls != least").select(F.col("cls").alias("a"), F.col("least").alias("b")).distinct()
    first = classes.select(F.col("cls").alias("a"), F.col("regs").alias("x"), F.col("n_shingles").alias("n"))
    second = classes.select(F.col("cls").alias("b"), F.col("regs").alias("y"), F.col("n_shingles").alias("m"))
    rows = pairs.join(first, "a").join(second, "b").where(F.lit(100) * F.least("n", "m") >= F.lit(percent) * F.greatest("n", "m"))
    return rows.select("a", "b", "x", "y", "n", "m").mapInPandas(run, "a binary, b binary")


def _across(regs: np.ndarray, n: np.ndarray, comp: np.ndarray, key: np.ndarray, side: np.ndarray, both: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs across components that may be similar and have no earlier bucket in common."""
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if both else (np.arange(len(n)),) * 2
    out = []
    for a in left:
        may = (comp[right] != comp[a]) & (100 * np.minimum(n[right], n[a]) >= percent * np.maximum(n[right], n[a]))
        if not both:
            may &= right > a
        others = right[may]
        if not len(others):
            continue
        equal = regs[others] == regs[a]
        near = (np.minimum(n[others], n[a]) <= SMALL) | (estimated_jaccard(equal.sum(1)) >= least_estimate(percent))
        others, equal = others[near], equal[near]
        if not len(others):
            continue
        shared = equal[:, : BANDS * (REGISTERS // BANDS)].reshape(len(others), BANDS, -1).all(2)
        first = band_keys(regs[a][None], BANDS)[0].view(np.int64)[shared.argmax(1)]
        others = others[shared.any(1) & (first == key)]
        out += [(a, o) for o in others]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _links_across(members: DataFrame, classes: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All links between different components in the buckets that hold more than one component."""
    comp = labels.select(F.col("a").alias("cls"), F.col("b").alias("comp"))
    rows = written(members.select("key", "cls").join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "labelled")
    mixed = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("n")).where("x != y")
    blocks = F.ceil(F.col("size") / BLOCK)
    rows = spread_join(rows, written(mixed.select("key", "n", F.col("n").alias("size")), "mixed"), ["key"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cls", "key"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", (F.col("own") == F.col("j")).cast("int"))
    rows = rows.select("key", "i", "j", "side", "cls", "comp").join(classes.select("cls", "regs", "n_shingles"), "cls")
    at = ["key", "i", "j"]

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, at):
            regs = np.stack([np.frombuffer(v, np.uint16) for v in g["regs"]])
            comp = np.unique(g["comp"].map(bytes), return_inverse=True)[1]
            key, i, j = (g[c].iloc[0] for c in at)
            a, b = _across(regs, g["n_shingles"].to_numpy(), comp, key, g["side"].to_numpy(), i != j, percent)
            if not len(a):
                continue
            partners: dict[int, list[int]] = {}
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                partners.setdefault(x, []).append(y)
                partners.setdefault(y, [])
            yield pd.DataFrame([(key, i, j, x, g["cls"].iloc[x], ys) for x, ys in partners.items()], columns=[*at, "place", "cls", "partners"])

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, at):
            place = {p: k for k, p in enumerate(g["place"])}
            items = [np.frombuffer(v, np.uint64) for v in g["items"]]
            cls, found = g["cls"].tolist(), []
            for k, ys in enumerate(g["partners"]):
                found += [(cls[k], cls[place[y]]) for y in ys if similar(items[k], items[place[y]], percent)]
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    asked = dealt(rows, at).mapInPandas(candidates, "key long, i long, j long, place long, cls binary, partners array<long>")
    return dealt(asked.join(sets, "cls"), at).mapInPandas(links, "a binary, b binary")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Groups of documents whose shingle sets are linked by a Jaccard similarity of ``percent`` / 100 or more.

    Returns a row for every row of ``docs``: doc_id, n_shingles (size of the
    set), component_id (the smallest doc_id reachable over links, the own one
    included) and kept (doc_id = component_id). Sets hold the distinct
    five-word shingles of the text with A-Z lower-cased; fewer words make one
    shingle. Texts that are null or without words have no shingles and are
    linked with nothing. Repeated rows are copies of each other; all rows that
    carry the smallest id are kept. A null doc_id is larger than any other: its
    row is kept only if its group has no other id (component_id is null then).
    Columns other than doc_id and text are ignored.
    """
    rows = written(sketches(docs), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first")
    classes = rows.where("cls is not null").groupBy("cls").agg(first, F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("n_shingles"), F.min("regs").alias("regs"), F.min("keys").alias("keys"))
    classes = written(classes.select("cls", "first.doc_id", "first.t", "n", "n_shingles", "regs", "keys"), "classes")
    keys = classes.select("cls", F.explode("keys").alias("key"))
    shared = written(keys.groupBy("key").agg(F.min("cls").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = written(spread_join(keys, shared, ["key"]).select("key", "cls", "least"), "members")
    discard(shared)
    wanted = classes.select("cls", "doc_id", "t").join(members.select("cls").distinct(), "cls", "left_semi")
    sets = written(sets_of(docs, wanted), "sets")
    links = _confirmed(_star_pairs(members, classes, percent), sets, percent)
    labels = components(links, "links")
    more = _links_across(members, classes, sets, labels, percent)
    labels = components(labels.union(more), "links")

    ids = classes.select("cls", "doc_id", "n").join(labels.select(F.col("a").alias("cls"), F.col("b").alias("comp")), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = ids.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    found = written(ids.join(least, "comp").select("cls", "component_id", "n"), "found")
    some = rows.select("doc_id", "n_shingles", "cls")
    # a class may have a large part of all rows; rows without words meet nothing
    out = spread_join(some.where("cls is not null"), found, ["cls"]).unionByName(some.where("cls is null").withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
