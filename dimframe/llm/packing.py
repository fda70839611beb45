"""Packing of token sequences by minimum bin slack.

Documents are cut into full sequences and a remainder. The remainders' lengths
are counted (at most as many numbers as a sequence has tokens); from the counts
a bitset subset-sum programme finds the multiset of lengths that fills a
sequence closest to its capacity, and the multiset is used as often as the
counts allow. Which remainder goes where follows from its number among the
remainders of its length, which Spark gives out in salted groups.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import PATTERN, byte_letters, default_vocab, special_strings, vocabulary
from .common import empty_text, written

#: Pieces numbered in one group, on average.
NUMBERED = 2000


class TextIds:
    """Token ids of texts as unsigned 32-bit little-endian bytes.

    In this vocabulary a token's id is its rank, so tiktoken, given the
    vocabulary's tokens as ranks, yields the ids of the tokenizers library in a
    quarter of the time. For any other vocabulary, and for texts with special
    strings, the tokenizers library itself is asked.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.special, self.fast = Tokenizer.from_file(path), special_strings(path), None
        model = vocabulary(path)["model"]
        ids, merges = model["vocab"], [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        if all(ids["".join(m.split(" "))] == 256 + k for k, m in enumerate(merges)):
            import tiktoken

            letters = {c: b for b, c in enumerate(byte_letters())}
            ranks = {bytes(letters[c] for c in t): i for t, i in ids.items() if t not in self.special}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN.pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if self.fast is not None and not any(s in text for s in self.special):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=2)
def _encoder(path: str) -> TextIds:
    return TextIds(path)


def pieces(docs: DataFrame, size: int, vocab: str | None, end_id: int, with_ids: bool) -> DataFrame:
    """Every document's ids, the end id last, cut into pieces of ``size`` ids and a remainder; ``seen`` numbers a task's pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end, seen = _encoder(vocab or default_vocab()), end_id.to_bytes(4, "little"), 0
        for b in batches:
            rows = []
            for name, text in zip(b["doc_id"].tolist(), b["text"].tolist(), strict=True):
                ids = encoder.ids(text) + end
                for a in range(0, len(ids), 4 * size):
                    part = ids[a : a + 4 * size]
                    seen += 1
                    rows.append((name, a // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, seen, *([part] * with_ids)))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "seen", *["ids"] * with_ids])
            out["doc_id"] = out["doc_id"].astype(b["doc_id"].dtype)
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, seen long" + ", ids binary" * with_ids
    return docs.select("doc_id", empty_text("text").alias("text")).mapInPandas(run, schema)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, with the largest sum up to ``capacity``: {length: copies}.

    Bit s of a bitset says that some multiset of the lengths seen so far sums to
    s. Copies enter as powers of two; the bitsets before each step are kept and
    give the copies back, last step first.
    """
    mask, bits, steps = (1 << capacity + 1) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, power = min(counts[length], capacity // length), 1
        while left > 0 and not bits >> capacity & 1:
            take = min(power, left)
            steps.append((length, take, bits))
            bits |= bits << length * take & mask
            left, power = left - take, power * 2
    at, out = bits.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            out[length] = out.get(length, 0) + take
    return out


def plan(counts: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Sequences for ``counts`` pieces of each length: [({length: copies}, times)].

    As in minimum bin slack, every sequence holds the longest piece left, and
    the rest of it is filled as closely as the pieces left allow. A filling is
    used as many times as the counts allow.
    """
    left, out = {k: n for k, n in counts.items() if n}, []
    while left:
        seed = max(left)
        left[seed] -= 1
        filling = fullest({k: n for k, n in left.items() if n and k <= size - seed}, size - seed)
        left[seed] += 1
        filling[seed] = filling.get(seed, 0) + 1
        times = min(left[k] // c for k, c in filling.items())
        for k, c in filling.items():
            left[k] -= c * times
            if not left[k]:
                del left[k]
        out.append((filling, times))
    return out


def packed(docs: DataFrame, size: int = 2048, vocab: str | None = None, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Packs the tokens of all rows of ``docs`` into sequences of at most ``size`` tokens.

    A document is the ids of its text without special tokens, then ``end_id``;
    a null text is empty and gives the end id alone. Returns a row for each
    piece: doc_id, start (the document's ids before it), length, ids_crc32 (of
    the ids as unsigned little-endian 32-bit numbers), doc_tokens, sequence_id
    (from 0, without gaps), offset (in the sequence, without gaps), and with
    ``with_ids`` the ids themselves. Each id lies in exactly one piece. Rows
    with null or repeated ids are packed like any other; other columns are
    ignored; an empty table gives an empty table. The driver sees the number of
    pieces of each length, ``size`` numbers at most, and broadcasts where each
    length goes, which is bounded by ``size`` too.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, size, vocab, end_id, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    slots, base, used = [], 0, dict.fromkeys(counts, 0)
    for filling, times in plan(counts, size):
        offset = 0
        for length, copies in sorted(filling.items(), reverse=True):
            slots.append((length, used[length], used[length] + copies * times, copies, base, offset))
            used[length] += copies * times
            offset += length * copies
        base += times
    slots = spark.createDataFrame(slots, "length long, first long, beyond long, copies long, base long, shift long")
    salts = spark.createDataFrame([(k, -(-n // NUMBERED)) for k, n in counts.items()], "length long, salts long")

    cut = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "seen"), "salts"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = cut.groupBy("length", "salt").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "seen")) - 1
    ranked = cut.withColumn("number", number).join(groups, ["length", "salt"]).withColumn("number", F.col("number") + F.col("before"))
    placed = ranked.join(F.broadcast(slots), "length").where("number >= first and number < beyond").withColumn("number", F.col("number") - F.col("first"))
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.floor(F.col("number") / F.col("copies"))).alias("sequence_id"),
        (F.col("shift") + F.pmod("number", "copies") * F.col("length")).alias("offset"),
        *(["ids"] * with_ids),
    )
