"""Removal of long repeats across documents by recompression.

Rounds of locally consistent renaming turn a document's words into symbols:
each round names short runs of one symbol, then pairs of neighbouring symbols.
A pair is named when a bit of its left symbol's name is 0 and the bit of its
right one's is 1, so the parse at a place depends on what stands there alone.
Names are 64-bit digests of what they stand for, which makes them global: equal
substrings get equal names in every document, without a dictionary to shuffle.

The length of a symbol is limited in each round. A window of words therefore
has the same symbols in every document, but for a margin at either end, and
the middle of the window holds a whole symbol (see ``MARGIN``). The longest
symbol of the middle, ties to the least name, is the window's anchor. Anchors
that two documents share, with what stands around them, reveal windows that may
repeat; those windows alone
are compared by 128-bit digests of all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, discard, mix, words, written
from .groups import salted_join, spread_join

#: Words of a window.
WINDOW = 50
#: The longest symbol after each step, in words: a round is a step of runs and one of pairs.
STEPS = (("runs", 3), ("pairs", 4), ("pairs", 6), ("pairs", 8))
#: Words that a window may lose on each side until its symbols are those of any other context: a run of up
#: to three words may go on outside, and in each step of pairs the outermost symbol may join one outside.
MARGIN = 3 + 3 + 4 + 6
LONGEST = 8


def symbols(w: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, lengths) of the symbols of documents laid end to end, given their word hashes and lengths."""
    name, size, doc = w, np.ones(len(w), np.int64), np.repeat(np.arange(len(lens)), lens)
    for step, (kind, most) in enumerate(STEPS):
        salt = mix(np.array([step + 1], np.uint64))[0]
        together = doc[1:] == doc[:-1]
        keep, new, length = np.ones(len(name), bool), name.copy(), size.copy()
        if kind == "runs":
            first = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | ~together])
            times = np.diff(np.r_[first, len(name)])
            ok = (times > 1) & (times * size[first] <= most)
            keep = np.repeat(~ok, times)
            keep[first] = True
            new[first[ok]] = mix(name[first[ok]] ^ mix(times[ok].astype(np.uint64) + salt))
            length[first[ok]] = times[ok] * size[first[ok]]
        else:
            side = (mix(name ^ salt) >> np.uint64(63)).astype(bool)
            at = np.flatnonzero(together & ~side[:-1] & side[1:] & (size[:-1] + size[1:] <= most))
            keep[at + 1] = False
            new[at] = mix(mix(name[at] + salt) * np.uint64(3) + name[at + 1])
            length[at] = size[at] + size[at + 1]
        name, size, doc = new[keep], length[keep], doc[keep]
    return name, size


def anchors(w: np.ndarray, lens: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place in it, anchor) of every window of documents laid end to end.

    An anchor is named by the digest of its symbol's words with MARGIN more
    words on either side, all of which lie in every window whose anchor it is.
    """
    count = np.maximum(lens - window + 1, 0)
    doc = np.repeat(np.arange(len(lens)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    if not len(doc):
        return doc, place, np.zeros(0, np.uint64)
    at = place + np.repeat(np.cumsum(lens) - lens, count)
    name, size = symbols(w, lens)
    start = np.cumsum(size) - size
    # the middle of the window at s: symbols that begin at s + MARGIN or later and end by s + window - MARGIN
    low = np.searchsorted(start, at + MARGIN)
    high = np.searchsorted(start + size, at + window - MARGIN, side="right")
    # longest first, then the least name: the smallest rank in the range wins
    order = np.lexsort((name, -size))
    rank = np.empty(len(name), np.int64)
    rank[order] = np.arange(len(name))
    chosen = order[_range_min(rank, low, high)]
    first, end = start[chosen] - MARGIN, start[chosen] + size[chosen] + MARGIN
    up, down = _powers(_room(len(w)), 0x9E3779B97F4A7C15)
    total = np.r_[np.uint64(0), np.cumsum(w * up[: len(w)], dtype=np.uint64)]
    return doc, place, mix((total[end] - total[first]) * down[first] + size[chosen].astype(np.uint64))


def _together(texts: list[str | None], hashes: WordHashes, most: int = 100_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, lengths) of consecutive texts with about ``most`` words together."""
    first, parts, n = 0, [], 0
    for k, t in enumerate(texts):
        parts.append(hashes.array(words(t)))
        n += len(parts[-1])
        if n >= most or k == len(texts) - 1:
            yield first, np.concatenate(parts), np.array([len(p) for p in parts])
            first, parts, n = k + 1, [], 0


def _range_min(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(x[low:high]) for non-empty ranges, from minima over powers of two."""
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    out, table = np.empty(len(low), np.int64), x
    for k in range(int(level.max(initial=0)) + 1):
        at = level == k
        out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
        if len(table) > 1 << k:
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
    return out


_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=8)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _room(n: int) -> int:
    """A power of two of at least ``n``, so that few tables of powers are made."""
    return 1 << max(10, int(n).bit_length())


def window_digests(w: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of every window of words: sums of words times powers of a base, modulo 2^64, mixed."""
    out, n = [], len(w) - window + 1
    size = _room(len(w))
    for salt, base in ((np.uint64(0), 0x9E3779B97F4A7C15), (_ODD, 0xC2B2AE3D27D4EB4F)):
        up, down = _powers(size, base)
        total = np.r_[np.uint64(0), np.cumsum(mix(w + salt) * up[: len(w)], dtype=np.uint64)]
        out.append(mix((total[window:] - total[:-window]) * down[:n]).view(np.int64))
    return out[0], out[1]


def _spans(places: np.ndarray) -> list[int]:
    """Sorted places as a flat list: first, length, first, length, ..."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) != 1)
    first = places[np.r_[0, cut + 1]]
    last = places[np.r_[cut, len(places) - 1]]
    return np.stack((first, last - first + 1), 1).ravel().tolist()


def _digest(kept: list[str]) -> str:
    return hashlib.sha256(" ".join(kept).encode("utf-8", "surrogatepass")).hexdigest()


def without_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Removes every word that lies in a window of ``window`` words which a document with a smaller id holds too.

    Windows are judged on the input. Returns a row for each row of ``docs``:
    doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one
    space), and with ``with_text`` the kept words as text. A null text has no
    words. Texts shorter than a window lose nothing. Rows with equal ids count
    as one document and take nothing from each other, and each loses what its own
    text repeats; a null id is larger than
    all others. Columns other than doc_id and text are ignored. ``window`` is at
    least 2 * MARGIN + 2 * LONGEST - 1 = 47.
    """
    if window < 2 * MARGIN + 2 * LONGEST - 1:
        raise ValueError("the window is too short for these steps")
    kind = docs.schema["doc_id"].dataType.simpleString()
    # a row is known by its document and its text's digest: rows of one document may have different texts
    # rows without text have keys of their own, which nothing has
    number = F.monotonically_increasing_id()
    rows = docs.select("doc_id", "text", F.when(F.col("text").isNull(), number).otherwise(F.xxhash64("text")).alias("key"), number.alias("number"))
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc")
    row = ["doc", "key"]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            ids, keys = b["doc"].to_numpy(), b["key"].to_numpy()
            for first, w, lens in _together(b["text"].tolist(), hashes):
                doc, _, name = anchors(w, lens, window)
                new = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])][: len(name)])
                yield pd.DataFrame({"anchor": name[new].view(np.int64), "doc": ids[first + doc[new]], "key": keys[first + doc[new]]})

    found = written(rows.select(order, "key", "text").where("text is not null").mapInPandas(find, "anchor long, doc long, key long"), "anchors")
    # anchors, windows and texts that very many documents have are joined where they are
    least = found.groupBy("anchor").agg(F.min("doc").alias("x"), F.max("doc").alias("y"), F.count(F.lit(1)).alias("n")).where("x < y").select("anchor", "n")
    least = written(least, "shared-anchors")
    shared = spread_join(found, least, ["anchor"]).groupBy(*row).agg(F.collect_set("anchor").alias("shared"))
    # an exact copy of an earlier text is removed whole: it need not show its windows, as the first one does
    copies = written(rows.where(F.length("text") > window).select(order, "key", F.sha2("text", 256).alias("text_sha")), "digests")
    first = copies.groupBy("text_sha").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last")
    later = spread_join(copies, written(first, "copied"), ["text_sha"]).where("doc > first").select(*row, F.lit(True).alias("copied")).distinct()
    known = written(shared.join(later, row, "full"), "shared")
    discard(found, least)
    texts = rows.withColumn("doc", order)
    # the same text with the same id (or none) many times is one key: its rows are split by their number
    often = written(copies.groupBy(*row).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")

    def show(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            ids, keys, sets = b["doc"].to_numpy(), b["key"].to_numpy(), b["shared"].tolist()
            for first, w, lens in _together(b["text"].tolist(), hashes):
                doc, place, name = anchors(w, lens, window)
                begin, cut = np.cumsum(lens) - lens, np.searchsorted(doc, np.arange(len(lens) + 1))
                for k in range(len(lens)):
                    mine = slice(cut[k], cut[k + 1])
                    at = place[mine][np.isin(name[mine], np.asarray(sets[first + k], np.int64).view(np.uint64))]
                    if len(at):
                        x, y = window_digests(w[begin[k] : begin[k] + lens[k]], window)
                        yield pd.DataFrame({"x": x[at], "y": y[at], "doc": ids[first + k], "key": keys[first + k], "place": at.astype(np.int32)})

    joined = salted_join(texts, known, row, ["number"], often)
    shown = joined.where("shared is not null and copied is null").select("doc", "key", "text", "shared").mapInPandas(show, "x long, y long, doc long, key long, place int")
    shown = written(shown, "windows")
    earliest = shown.groupBy("x", "y").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last")
    repeated = spread_join(shown, written(earliest.drop("last"), "earliest"), ["x", "y"]).where("doc > first").groupBy(*row).agg(F.collect_set("place").alias("places"))
    marks = written(repeated.join(later, row, "full"), "marks")
    discard(shown, known)

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text, places, copied in zip(b["doc_id"], b["text"], b["places"], b["copied"], strict=True):
                ws = words(text)
                n, removed = len(ws), 0
                if copied is not None and copied == True and n >= window:  # noqa: E712
                    ws, removed = [], n
                elif places is not None and len(places):
                    change = np.zeros(n + 1, np.int64)
                    at = np.unique(np.asarray(places, np.int64))
                    change[at] += 1
                    change[at + window] -= 1
                    keep = np.cumsum(change)[:n] == 0
                    ws = [v for v, k in zip(ws, keep, strict=True) if k]
                    removed = n - len(ws)
                out.append((doc, n, removed, _digest(ws), *([" ".join(ws)] * with_text)))
            made = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", *["text"] * with_text])
            made["doc_id"] = made["doc_id"].astype(b["doc_id"].dtype)
            yield made

    final = salted_join(texts, marks, row, ["number"], often, how="left").select("doc_id", "text", "places", "copied")
    return final.mapInPandas(remove, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)
