"""Token counts of texts by rank-synchronous array merging.

Every batch of distinct pre-tokens is held as one ragged numpy array of
symbols. In each round every sequence finds the lowest rank among its adjacent
pairs, and all sequences apply their own lowest-rank pair at once; sequences
without a ranked pair leave with the number of symbols that survive. As a pair
made from a merged symbol always ranks after the merge itself, this equals
merging one pair at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import PATTERN, byte_letters, chunks, default_vocab, has_unassigned, library_pieces, special_strings, vocabulary
from .common import empty_text

_NONE = np.int64(1 << 40)
#: Distinct chunks that a task remembers before it starts afresh.
REMEMBERED = 400_000


class RankedPairs:
    """The ranked pairs of a byte-level BPE vocabulary as sorted arrays."""

    def __init__(self, path: str):
        model = vocabulary(path)["model"]
        ids, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.byte_ids = np.array([ids[c] for c in byte_letters()], np.int64)
        self.size = np.int64(max(ids.values()) + 1)
        left, right = (np.array([ids[m[i]] for m in merges], np.int64) for i in (0, 1))
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank_of = key[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], _NONE)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each piece after all merges."""
        n = len(pieces)
        lens = np.fromiter(map(len, pieces), np.int64, n)
        out = np.zeros(n, np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        seq = np.repeat(np.arange(n), lens)
        rank = np.full(len(sym), _NONE)  # of the pair that begins at each symbol
        stale = np.ones(len(sym), bool)
        while len(sym):
            ask = np.flatnonzero(stale)
            rank[ask] = _NONE
            ask = ask[ask + 1 < len(sym)]
            ask = ask[seq[ask] == seq[ask + 1]]
            rank[ask] = self.ranks(sym[ask], sym[ask + 1])
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            size = np.diff(np.r_[starts, len(sym)])
            lowest = np.minimum.reduceat(rank, starts)
            ended = lowest == _NONE
            out[seq[starts[ended]]] = size[ended]
            at = np.flatnonzero((rank == np.repeat(lowest, size)) & (rank < _NONE))
            fresh = np.r_[True, np.diff(at) != 1][: len(at)]  # of a, a, a every other pair merges, from the left
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
            sym[at] = self.merged[rank[at]]
            stale = np.zeros(len(sym), bool)
            stale[at] = True
            stale[at[at > 0] - 1] = True
            keep = np.repeat(~ended, size)
            keep[at + 1] = False
            # the symbol before a merged one may be two places before it when that one was merged away too
            before = at[at > 1]
            stale[before[~keep[before - 1]] - 2] = True
            sym, seq, rank, stale = sym[keep], seq[keep], rank[keep], stale[keep]
        return out


class ChunkCounts:
    """Counts tokens of texts, each distinct chunk once."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.path, self.pairs, self.special, self.remembered = path, _pairs(path), special_strings(path), remembered
        self.raw: dict[str, int] = {}
        self.spaced: dict[str, int] = {}

    def learn(self, known: dict[str, int], new: list[str], prefix: str) -> None:
        for a in range(0, len(new), 50_000):
            some = new[a : a + 50_000]
            split = [PATTERN.findall(prefix + c) for c in some]
            distinct = {p: k for k, p in enumerate(dict.fromkeys(p for ps in split for p in ps))}
            counts = self.pairs.counts([p.encode("utf-8", "replace") for p in distinct])
            for c, ps in zip(some, split, strict=True):
                known[c] = int(sum(counts[distinct[p]] for p in ps))

    def parts(self, text: str) -> list[str]:
        """The text between special strings, which the vocabulary gives one id each."""
        out = [text]
        for s in self.special:
            out = [y for x in out for y in x.split(s)]
        return out

    def odd(self, text: str) -> int:
        """Tokens of a text with unassigned characters, without remembering any of it."""
        pieces = [p.encode("utf-8", "replace") for part in self.parts(text) for p in library_pieces(part, self.path)]
        return len(self.parts(text)) - 1 + int(self.pairs.counts(pieces).sum())

    def count(self, texts: list[str]) -> np.ndarray:
        odd = {k: self.odd(t) for k, t in enumerate(texts) if has_unassigned(t)}
        cut = [[chunks(p) for p in self.parts("" if k in odd else t)] for k, t in enumerate(texts)]
        if len(self.raw) + len(self.spaced) > self.remembered:
            self.raw.clear()
            self.spaced.clear()
        for known, which, prefix in ((self.raw, 0, ""), (self.spaced, 1, " ")):
            seen: set[str] = set()
            for doc in cut:
                for part in doc:
                    seen.update(part[which])
            self.learn(known, [c for c in seen if c not in known], prefix)
        raw, spaced = self.raw.__getitem__, self.spaced.__getitem__
        return np.array([odd[k] if k in odd else len(doc) - 1 + sum(sum(map(raw, a)) + sum(map(spaced, b)) for a, b in doc) for k, doc in enumerate(cut)], np.int64)


@lru_cache(maxsize=1)
def _pairs(path: str) -> RankedPairs:
    return RankedPairs(path)


def in_slices(texts: list[str], most: int = 4_000_000) -> Iterator[slice]:
    """Slices of whole texts, of about ``most`` characters each."""
    a = total = 0
    for b, t in enumerate(texts):
        total += len(t)
        if total > most:
            yield slice(a, b + 1)
            a, total = b + 1, 0
    if a < len(texts):
        yield slice(a, len(texts))


def token_counts(docs: DataFrame, vocab: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``) of every row of ``docs``.

    ``vocab`` is the path of a byte-level BPE vocabulary in JSON that every
    machine can read (default: the installed byte_bpe_50k.json). No special
    tokens are added; special strings inside a text count as one token each.
    A null or empty text has 0 bytes and 0 tokens. Rows with a null doc_id and
    repeated rows are kept as they are. Columns other than doc_id and text are
    ignored. An empty table gives an empty table. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = ChunkCounts(vocab or default_vocab())
        for b in batches:
            texts = b["text"].tolist()
            n = [counter.count(texts[s]) for s in in_slices(texts)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": np.concatenate(n) if n else np.zeros(0, np.int64)})

    table = docs.select("doc_id", F.octet_length(empty_text("text")).cast("long").alias("n_bytes"), empty_text("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return table.mapInPandas(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
