"""Alignment of two tokenizers' tokens by byte ranges.

In every task DuckDB holds the tokens of a slice of distinct pieces of text as
tables of byte intervals: window sums number the groups between places where
both tokenizers cut, an ASOF join finds the token of A that holds the end of
each token of B, and a range join counts overlaps. Neither tokenizer has a token
that crosses from a word to the space behind it, so texts fall apart into words
that are aligned once. How often a pair of ids is linked is added up within a
slice first, then in Spark, and comes back to the slices as arrays.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import _SPACE_AT_SPACE, byte_letters, default_vocab, vocabulary
from .common import empty_text, written
from .token_counts import in_slices

#: Pieces that a task remembers before it starts afresh, and the length of the longest of them.
REMEMBERED, SHORT = 400_000, 60
#: Characters of a slice, whose pairs of ids are added up before they leave the task.
SLICE = 4_000_000
#: An id of B within a pair of ids.
ID_BITS = 20

#: Tables a and b hold the tokens of all parts as ranges (s, e) of their bytes laid end to end; c is the part.
ENDS_SQL = """
create or replace temp table ends as
select a.*, b.id as linked, coalesce(sum((b.id is not null)::int) over (order by a.e rows between unbounded preceding and 1 preceding), 0)::bigint as g
from a left join b on a.e = b.e order by a.e"""
HELD_SQL = "create or replace temp table held as select b.*, ends.g from b asof join ends on b.e <= ends.e order by b.e"
OVERLAPS_SQL = "select x.c, count(*) as n from ends x join held y on x.g = y.g and x.s < y.e and y.s < x.e group by x.c"


class Tokens:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters = {c: b for b, c in enumerate(byte_letters())}
        every = {i: t for t, i in vocabulary(a_path)["model"]["vocab"].items()}
        self.bytes_a = [bytes(letters[c] for c in every[i]) if all(c in letters for c in every.get(i, "\0")) else b"" for i in range(max(every) + 1)]
        self.bytes_b = [self._piece(i) for i in range(self.b.vocab_size())]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        #: whether all of B's pieces have their spaces in front, so that a space begins a new piece of text
        self.apart = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.vocab_size()))

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace("▁", " ").encode()

    def parts(self, text: str) -> list[str]:
        """The parts of " " + text that both encode alone, each without the space in front of it."""
        spaced = " " + text
        if not self.apart or "  " in spaced or text.endswith(" ") or _SPACE_AT_SPACE.search(spaced):
            return [text]
        return text.split(" ")

    def intervals(self, parts: list[str]) -> tuple[pa.Table, pa.Table, np.ndarray]:
        """The tables a and b (c, id, s, e) of the parts that both give back byte by byte, and which parts these are."""
        want = [(" " + p).encode("utf-8", "replace") for p in parts]
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        ids_b = self.b.encode(parts, num_threads=1)
        good = np.ones(len(parts), bool)
        for ids, known in ((ids_a, self.bytes_a), (ids_b, self.bytes_b)):
            good &= np.fromiter((b"".join(map(known.__getitem__, x)) == w for x, w in zip(ids, want, strict=True)), bool, len(parts))
        return *(self._ranges(x, good, sizes) for x, sizes in ((ids_a, self.sizes_a), (ids_b, self.sizes_b))), good

    @staticmethod
    def _ranges(ids: list[list[int]], good: np.ndarray, sizes: np.ndarray) -> pa.Table:
        ids = ids if good.all() else [x if ok else [] for x, ok in zip(ids, good, strict=True)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum()))
        end = np.cumsum(sizes[flat])
        return pa.table({"c": np.repeat(np.arange(len(ids)), counts), "id": flat, "s": end - sizes[flat], "e": end})


@lru_cache(maxsize=1)
def tokens_of(a_path: str, b_path: str) -> Tokens:
    return Tokens(a_path, b_path)


class Aligner:
    """What is known of parts: numbers of tokens, groups, overlaps and links; arrays by the part's number."""

    def __init__(self, a_path: str, b_path: str, remembered: int = REMEMBERED):
        import duckdb

        self.tokens, self.remembered = tokens_of(a_path, b_path), remembered
        self.db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 5), np.int64)  # n_a, n_b, n_groups, n_overlaps, whether the part comes back byte by byte
        self.pairs, self.starts = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, parts: list[str]) -> None:
        a, b, good = self.tokens.intervals(parts)
        self.db.register("a", a)
        self.db.register("b", b)
        self.db.execute(ENDS_SQL)
        self.db.execute(HELD_SQL)
        ends, held, overlaps = (self.db.sql(q).to_arrow_table() for q in ("select id, linked, g, c from ends order by e", "select id, g from held order by e", OVERLAPS_SQL))
        linked = ends["linked"].combine_chunks()
        is_link = linked.is_valid().to_numpy(zero_copy_only=False)
        of = ends["c"].to_numpy()[is_link]
        counts = np.zeros((len(parts), 5), np.int64)
        counts[:, 0], counts[:, 1] = (np.bincount(t["c"].to_numpy(), minlength=len(parts)) for t in (a, b))
        counts[:, 2], counts[:, 4] = np.bincount(of, minlength=len(parts)), good
        counts[overlaps["c"].to_numpy(), 3] = overlaps["n"].to_numpy()
        self.number.update(zip(parts, range(len(self.groups), len(self.groups) + len(parts)), strict=True))
        self.groups += self._texts(ends["id"].to_numpy(), ends["g"].to_numpy(), held["id"].to_numpy(), held["g"].to_numpy(), counts[:, :2].sum(1))
        self.counts = np.concatenate((self.counts, counts))
        self.pairs = np.concatenate((self.pairs, ends["id"].to_numpy()[is_link] << ID_BITS | linked.drop_null().to_numpy()))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(counts[:, 2])))

    @staticmethod
    def _texts(a: np.ndarray, g_a: np.ndarray, b: np.ndarray, g_b: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The groups of each part as text; ids and groups are in order, a part has ``sizes`` tokens of both."""
        order = np.argsort(np.concatenate((2 * g_a, 2 * g_b + 1)), kind="stable")
        kind = np.concatenate((2 * g_a, 2 * g_b + 1))[order]
        last = np.r_[kind[1:] != kind[:-1], True][: len(kind)]  # of a group's tokens of one side
        sign = np.where(last, np.where(kind % 2 == 0, 1, 2), 0)
        pieces = [f"{i}{',|;'[k]}" for i, k in zip(np.concatenate((a, b))[order].tolist(), sign.tolist(), strict=True)]
        cuts = np.concatenate(([0], np.cumsum(sizes))).tolist()
        return ["".join(pieces[x:y])[:-1] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    def slice(self, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """(a row for each text, the pairs of ids that are linked, how often); a row's links are numbers of these pairs, and how often each."""
        if len(self.number) > self.remembered:
            self.clear()
        split = [self.tokens.parts(t) if t else [] for t in texts]
        self._learn_new(split)
        at = [np.fromiter(map(self.number.__getitem__, ps), np.int64, len(ps)) for ps in split]
        odd = [k for k, x in enumerate(at) if len(x) > 1 and not self.counts[x, 4].all()]  # the whole text decides
        if odd:
            self._learn_new([[texts[k]] for k in odd])
            for k in odd:
                at[k] = np.array([self.number[texts[k]]])
        sizes = np.diff(self.starts)
        flat = np.concatenate(at) if at else np.zeros(0, np.int64)
        links = sizes[flat]
        begin = np.repeat(self.starts[flat] - np.cumsum(links) + links, links)
        pair = self.pairs[begin + np.arange(int(links.sum()))]
        pairs, local = np.unique(pair, return_inverse=True)
        doc = np.repeat(np.repeat(np.arange(len(at)), [len(x) for x in at]), links)
        keys, often = np.unique(doc * max(1, len(pairs)) + local, return_counts=True)
        doc, local = np.divmod(keys, max(1, len(pairs)))
        cut = np.searchsorted(doc, np.arange(len(at) + 1))
        rows = []
        for k, x in enumerate(at):
            n_a, n_b, n_groups, n_overlaps, _ = self.counts[x].sum(0).tolist()
            digest = hashlib.sha256(";".join(map(self.groups.__getitem__, x.tolist())).encode()).hexdigest() if n_a else ""
            mine = slice(cut[k], cut[k + 1])
            rows.append((n_a, n_b, n_groups, n_overlaps, int(often[mine].sum()), digest, local[mine].astype("<u4").tobytes(), often[mine].astype("<u4").tobytes()))
        total = np.bincount(local, often, len(pairs)).astype(np.int64)
        if any(len(p) > SHORT for ps in split for p in ps) or odd:
            self.clear()
        return rows, pairs, total

    def _learn_new(self, split: list[list[str]]) -> None:
        new = [p for p in dict.fromkeys(p for ps in split for p in ps) if p not in self.number]
        if new:
            self.learn(new)


def default_pieces() -> str:
    """The place of piece_bpe_32k.model on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_overlaps of every row of ``docs``.

    " " + text is encoded by A (a byte-level BPE vocabulary of the tokenizers
    library, ``a_path``) and by B (a sentencepiece model, ``b_path``, that adds the
    space itself), without special tokens. Tokens are byte ranges; where both
    end, a group ends and a link joins the two tokens. ``count_sum`` adds up, over
    a text's links, how many links of all texts have the same two ids; ``n_best``
    counts the links for which no other id of A has more with that id of B.
    ``groups_sha256`` is of ids as a1,a2|b1;a3|b2,b3. ``n_overlaps``: pairs of a
    token of A and one of B whose ranges share bytes.

    A text that is null, empty or does not come back byte by byte from either
    has zeros and an empty digest. Rows with a null doc_id and repeated rows
    count each; other columns are ignored; an empty table gives an empty table.

    Slices of a task's rows (4 million characters, or one longer text) are
    written with their own pairs of ids, of which a slice has no more than links.
    Pairs are added up over slices by two aggregations and joined back to them;
    a slice then meets its pairs' counts in one group.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner, slices = Aligner(a_path or default_vocab(), b_path or default_pieces()), 0
        task = TaskContext.get().partitionId()
        for b in batches:
            texts = b["text"].tolist()
            for s in in_slices(texts, SLICE):
                rows, pairs, total = aligner.slice(texts[s])
                out = pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "n_overlaps", "n_links", "groups_sha256", "links", "often"])
                out.insert(0, "doc_id", b["doc_id"].iloc[s].reset_index(drop=True))
                out.insert(0, "slice", (task << 32) + slices)
                none = [None] * (len(out) - 1)
                out["pairs"], out["total"] = [pairs, *none], [total, *none]
                slices += 1
                yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = "n_a long, n_b long, n_groups long, n_overlaps long, n_links long, groups_sha256 string"
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), empty_text("text").alias("text"))
    table = written(rows.mapInPandas(run, f"slice long, doc_id string, {numbers}, links binary, often binary, pairs array<long>, total array<long>"), "aligned")

    pairs = table.where("pairs is not null").select(F.col("slice").alias("part"), F.posexplode(F.arrays_zip("pairs", "total")).alias("k", "p")).select("part", "k", F.col("p.pairs").alias("pair"), F.col("p.total").alias("n"))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    best = counts.groupBy(F.col("pair").bitwiseAND((1 << ID_BITS) - 1).alias("b")).agg(F.max("n").alias("most"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND((1 << ID_BITS) - 1)).join(best, "b").select("pair", F.col("n").alias("count"), (F.col("n") == F.col("most")).alias("best"))
    known = pairs.select("part", "k", "pair").join(written(counts, "pairs"), "pair").select("part", "k", "count", "best")

    def scored(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        count, best = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        count[known["k"]], best[known["k"]] = known["count"], known["best"]
        links, often = ([np.frombuffer(v, "<u4").astype(np.int64) for v in docs[c]] for c in ("links", "often"))
        docs["n_best"] = [int(best[x] @ n) for x, n in zip(links, often, strict=True)]
        docs["count_sum"] = [int(count[x] @ n) for x, n in zip(links, often, strict=True)]
        return docs.drop(columns=["slice", "links", "often"])

    left = table.drop("pairs", "total").groupBy("slice")
    out = left.cogroup(known.groupBy("part")).applyInPandas(scored, f"doc_id string, {numbers}, n_best long, count_sum long")
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")
