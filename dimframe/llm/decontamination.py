"""Benchmark decontamination by latent semantic retrieval.

Terms are the words of the benchmark's items. Documents are cut into passages;
TF-IDF weights come from how many passages of the whole corpus hold a term. A
randomised SVD finds the leading directions of the passage-term matrix A: every
task adds up its rows' part of A'(A R) for a random matrix R, the sum (terms by
directions) is made orthonormal as Q, and a second pass gives Q'A'A Q, whose
eigenvectors turn Q into A's right singular vectors. Passages and items become
vectors over whitened directions; an item longer than a passage has also one for
each of its own passages. Pairs of high cosine are candidates. A candidate is
confirmed by longest common subsequences of words between the item and the
document around the passage (two, so that a paraphrase may swap its clauses), and
by the item's answer: its rarest words must be among those matched.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .sequences import common_pairs

#: Words of a passage; passages begin at every half of it.
PASSAGE = 32
HALF = PASSAGE // 2
#: Directions kept, and random ones more to find them.
RANK, MORE = 64, 8
#: The most frequent terms, which are counted into dense columns; the others are gathered word by word.
DENSE = 64
#: Cosine from which a passage is a candidate for an item.
COSINE = 0.4
#: Share of an item's words, and of its rarest fifth, that must stand in (at most two) orders in the document.
MATCHED, ANSWERED = 0.6, 0.3
#: Bytes of items that are searched at once, and item vectors that passages are multiplied with at once.
ITEMS_AT_ONCE, QUERIES_AT_ONCE = 1 << 26, 4096
#: Words of an item that is looked for word by word.
SHORTEST = 3
#: The id of words that are no terms: larger than any term's.
UNKNOWN = 2**32 - 1


_AROUND = ".,;:!?\"'()[]{}<>|*#$%&-_"


def terms(text: str | None) -> list[str]:
    """The words of a text, cut at white space, in lower case, without punctuation around them."""
    return [t for w in (text or "").split() if (t := w.lower().strip(_AROUND))]


class Ids(dict):
    """Term ids of words as they stand; words that are no terms are UNKNOWN, words without letters -1. Made for one task.

    Remembers the forms of terms alone, so it stays small: most other words are seen once.
    """

    def __init__(self, vocabulary: dict[str, int], most: int = 250_000):
        super().__init__()
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, word: str) -> int:
        t = word.lower().strip(_AROUND)
        out = self.vocabulary.get(t)
        if out is None:
            return UNKNOWN if t else -1
        if len(self) < self.most:
            self[word] = out
        return out

    def of(self, text: str | None) -> np.ndarray:
        ws = (text or "").split()
        ids = np.fromiter(map(self.__getitem__, ws), np.int64, len(ws))
        return ids[ids >= 0].astype(np.uint32)


def _some(batches: Iterator[pd.DataFrame], most: int = 50_000) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, lengths, blocks of HALF words, number of blocks of each document), about ``most`` words at a time.

    Documents without words are left out. Every document begins a block, and has
    an even number of them; the places left over are UNKNOWN.
    """

    def laid() -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        lens = np.array([len(p) for p in parts])
        n = 2 * -(-lens // PASSAGE)
        blocks = np.full(n.sum() * HALF, UNKNOWN, np.uint32)
        shift = HALF * (np.cumsum(n) - n) - (np.cumsum(lens) - lens)
        blocks[np.arange(lens.sum()) + np.repeat(shift, lens)] = np.concatenate(parts)
        return docs, lens, blocks.reshape(-1, HALF), n

    docs, parts, total = [], [], 0
    for b in batches:
        for doc, raw in zip(b["doc_id"], b["ids"], strict=True):
            ids = np.frombuffer(raw, np.uint32)
            if len(ids):
                docs.append(doc)
                parts.append(ids)
                total += len(ids)
            if total >= most:
                yield laid()
                docs, parts, total = [], [], 0
    if parts:
        yield laid()


class Mixture:
    """The product of rows of term ids, as counts, with a table of vectors of terms."""

    def __init__(self, table: np.ndarray, dense: np.ndarray):
        self.table, self.dense = table, dense
        self.column = np.full(len(table) + 1, -1)
        self.column[dense] = np.arange(len(dense))
        self.rare = np.append(table.any(1), False) & (self.column < 0)

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """How often each dense term stands in each row of ids (clipped to the table's length)."""
        column = self.column[rows]
        at = np.flatnonzero(column.ravel() >= 0)
        n = len(self.dense)
        return np.bincount(at // rows.shape[1] * n + column.ravel()[at], minlength=len(rows) * n).reshape(len(rows), n).astype(np.float32)

    def sums(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = counts @ self.table[self.dense]
        some = self.rare[rows]
        at, where = rows[some], np.repeat(np.arange(len(rows)), some.sum(1))
        if len(at):
            first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
            out[where[first]] += np.add.reduceat(self.table[at], first)
        return out

    def add_back(self, total: np.ndarray, rows: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
        """Adds the transposed counts times ``sums`` to ``total`` (terms by directions)."""
        total[self.dense] += counts.T @ sums
        some = self.rare[rows]
        at, where = rows[some], np.repeat(np.arange(len(rows)), some.sum(1))
        if len(at):
            order = np.argsort(at, kind="stable")
            heads = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
            total[at[order][heads]] += np.add.reduceat(sums[where[order]], heads)


def passage_counts(coded: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """How many passages of the corpus hold each term, and how many passages there are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = np.zeros(n_terms + 1, np.int64), 0
        for _, lens, blocks, _ in _some(batches):
            total += int((-(-lens // PASSAGE)).sum())
            passages = np.sort(np.minimum(blocks, n_terms).reshape(-1, PASSAGE), axis=1)
            held += np.bincount(passages[:, 0], minlength=n_terms + 1)
            held += np.bincount(passages[:, 1:][passages[:, 1:] != passages[:, :-1]], minlength=n_terms + 1)
        at = np.flatnonzero(held[:n_terms])
        yield pd.DataFrame({"term": np.r_[at, -1], "n": np.r_[held[at], total]})

    rows = coded.mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # as many rows as the items have words
    held, total = np.zeros(n_terms, np.int64), 0
    for term, n in rows:
        if term < 0:
            total = n
        else:
            held[term] = n
    return held, total


def gram_times(coded: DataFrame, weight: np.ndarray, dense: np.ndarray, r: np.ndarray, terms_at_once: int = 1024) -> np.ndarray:
    """A'A r for the passage-term matrix A of the whole corpus, columns scaled by ``weight``.

    Every task sends its sum in blocks of terms, which are added up block by block.
    """
    scaled, width = (weight[:, None] * r).astype(np.float32), r.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, mixture = np.zeros((len(weight), width)), Mixture(scaled, dense)
        for _, _, blocks, _ in _some(batches):
            passages = np.minimum(blocks.reshape(-1, PASSAGE), len(weight))
            counts = mixture.counts(passages)
            mixture.add_back(total, passages, counts, mixture.sums(passages, counts))
        for a in range(0, len(weight), terms_at_once):
            yield pd.DataFrame({"a": [a], "part": [total[a : a + terms_at_once].tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for a, part in zip(b["a"], b["part"], strict=True):
                sums[a] = sums.get(a, 0) + np.frombuffer(part)
        yield pd.DataFrame({"a": list(sums), "part": [x.tobytes() for x in sums.values()]})

    parts = coded.mapInPandas(run, "a long, part binary").repartition("a").mapInPandas(add, "a long, part binary")
    out = np.zeros((len(weight), width))
    for a, part in parts.collect():  # terms of the items by directions
        out[a : a + terms_at_once] = np.frombuffer(part).reshape(-1, width)
    return out * weight[:, None]


def directions(coded: DataFrame, weight: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors as columns, singular values) of the whole corpus by a randomised SVD."""
    width = min(RANK + MORE, len(weight))
    q, _ = np.linalg.qr(gram_times(coded, weight, dense, np.random.default_rng(11).normal(size=(len(weight), width))))
    small = q.T @ gram_times(coded, weight, dense, q)
    squares, v = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-squares)[:RANK]
    best = best[squares[best] > 1e-9 * max(squares.max(initial=0), 1e-300)]
    return q @ v[:, best], np.sqrt(squares[best])


def matched_places(item: list[int], around: list[int]) -> set[int]:
    """Places of ``item`` in a longest common subsequence, and in another one of what is left of both."""
    pairs = common_pairs(item, around)
    mine, theirs = {i for i, _ in pairs}, {j for _, j in pairs}
    left = [k for k in range(len(item)) if k not in mine]
    if left:
        mine |= {left[k] for k, _ in common_pairs([item[k] for k in left], [v for k, v in enumerate(around) if k not in theirs])}
    return mine


def item_passages(item: np.ndarray) -> list[np.ndarray]:
    """An item, and if it is longer than a passage its passages too; documents' begin at every half, so one is never off by more than a quarter."""
    n = len(item)
    return [item] if n <= PASSAGE else [item, *(item[a : a + PASSAGE] for a in (*range(0, n - PASSAGE, PASSAGE), n - PASSAGE))]


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, matched: float = MATCHED, answered: float = ANSWERED) -> DataFrame:
    """doc_id, item_id, matched, answered, cosine, start for every item of ``benchmark`` that leaked into a row of ``docs``.

    ``matched`` is the share of the item's words that stand in the document in
    order (at most two orders) around the best passage, ``answered`` that of its
    rarest fifth, ``start`` the passage's first word. Documents and items that
    are null or have no words match nothing; of repeated rows, and of items with
    one id, each gives its own rows; other columns are ignored. The items are a
    stated set of queries: they, their words and matrices of words by directions
    go to every task. There is one model of all items; more than ITEMS_AT_ONCE
    bytes of them are searched in parts, an item being in one part.

    The vector of a passage is that of an item it holds only if the item is a
    good part of it. Items of SHORTEST words or more, but fewer than a passage's,
    are looked for word by word, too; such a find is verbatim and has the cosine 1.
    """
    spark = docs.sparkSession
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, matched double, answered double, cosine double, start long"
    benchmark = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    items = [(i, t) for i, text in benchmark.collect() if (t := terms(text))]
    vocabulary = {t: k for k, t in enumerate(sorted({t for _, ts in items for t in ts}))}
    if not items:
        return spark.createDataFrame([], schema)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = Ids(vocabulary)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [ids.of(t).tobytes() for t in b["text"]]})

    coded = written(docs.where("text is not null").select("doc_id", "text").mapInPandas(code, f"doc_id {kinds[0]}, ids binary"), "coded")
    held, total = passage_counts(coded, len(vocabulary))
    idf = np.log((1 + total) / (1 + held))
    weight = np.maximum(idf, 1e-6)
    dense = np.argsort(-held, kind="stable")[:DENSE]
    coded_items = [np.array([vocabulary[t] for t in ts], np.int64) for _, ts in items]
    v, s = directions(coded, weight, dense)
    table = (weight[:, None] * v / np.maximum(s, 1e-300)).astype(np.float32)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-30)
    answers = [np.argsort(-idf[c], kind="stable")[: max(1, len(c) // 5)] for c in coded_items]
    # the rarest word of each short item, and where it stands in it
    anchors = {j: int(np.argmax(idf[c])) for j, c in enumerate(coded_items) if SHORTEST <= len(c) < PASSAGE}

    def part(members: list[int]) -> bytes:
        """What a task needs to search some items."""
        pieces = [(k, p) for k, j in enumerate(members) for p in item_passages(coded_items[j])]
        queries = unit(np.stack([table[p].sum(0) for _, p in pieces]))
        places = {k: anchors[j] for k, j in enumerate(members) if j in anchors}
        return pickle.dumps((queries, np.array([k for k, _ in pieces]), [coded_items[j] for j in members], [answers[j] for j in members], places, [items[j][0] for j in members]))

    model = spark.sparkContext.broadcast(pickle.dumps((table, dense)))
    found = [coded.mapInPandas(_searcher(model, spark.sparkContext.broadcast(part(m)), cosine, matched, answered), schema) for m in in_parts([sum(map(len, t)) for _, t in items], ITEMS_AT_ONCE)]
    return reduce(DataFrame.union, found)


def in_parts(sizes: list[int], most: int) -> list[list[int]]:
    """Numbers from 0 in parts whose sizes add up to ``most``, or to one larger size."""
    out, total = [[]], 0
    for k, size in enumerate(sizes):
        if out[-1] and total + size > most:
            out.append([])
            total = 0
        out[-1].append(k)
        total += size
    return out


def verbatim(ids: np.ndarray, items: list[np.ndarray], anchors: dict[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """(item, places where it begins) for the items in ``anchors`` that stand in ``ids`` word by word."""
    if not anchors:
        return
    words_of = np.array([items[j][at] for j, at in anchors.items()])
    seen = np.flatnonzero(np.isin(ids, words_of))
    seen = seen[np.argsort(ids[seen], kind="stable")]
    low, high = (np.searchsorted(ids[seen], words_of, side) for side in ("left", "right"))
    shorts = list(anchors.items())
    for k in np.flatnonzero(high > low):
        j, at = shorts[k]
        item = items[j]
        begin = seen[low[k] : high[k]] - at
        begin = begin[(begin >= 0) & (begin + len(item) <= len(ids))]
        for place, t in enumerate(item.tolist()):
            begin = begin[ids[begin + place] == t]
        if len(begin):
            yield j, begin


def with_answers(ids: np.ndarray, answering: np.ndarray, words_of: list[np.ndarray], of: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether the range of ``ids`` from ``low`` to ``high`` holds a word of the answer of item ``of``, for candidates sorted by item.

    ``answering`` has the places of words of any answer, sorted by word.
    """
    out, cuts = np.zeros(len(of), bool), [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
    words = ids[answering].astype(np.int64)  # of one type with the words looked for
    for a, b in pairwise(cuts if len(of) else []):
        mine = words_of[of[a]]
        ranges = zip(np.searchsorted(words, mine, "left").tolist(), np.searchsorted(words, mine, "right").tolist(), strict=True)
        places = np.sort(np.concatenate([answering[x:y] for x, y in ranges]))
        out[a:b] = np.searchsorted(places, high[a:b]) > np.searchsorted(places, low[a:b])
    return out


def _searcher(model, part, cosine: float, matched: float, answered: float):
    """The function of batches that finds the items of a part."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-30)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (table, dense), (queries, owners, coded_items, answers, anchors, names) = pickle.loads(model.value), pickle.loads(part.value)
        mixture, rows = Mixture(table, dense), []
        words_of, least = [np.unique(c[a]) for c, a in zip(coded_items, answers, strict=True)], [answered * len(a) for a in answers]
        sizes = np.array([len(c) for c in coded_items])
        # words of answers, with the blocks within which a passage may see them
        reach = np.zeros(len(table) + 1, np.int64)
        for c, a in zip(coded_items, answers, strict=True):
            np.maximum.at(reach, c[a], -(-len(c) // HALF) + 2)
        for docs, lens, blocks, n in _some(batches):
            blocks = np.minimum(blocks, len(table))
            seen = np.zeros(len(blocks) + 1, np.int64)  # passages with a word of an answer in reach: others cannot be confirmed
            far = reach[blocks].max(1)
            some = np.flatnonzero(far)
            np.add.at(seen, np.maximum(some - far[some], 0), 1)
            np.add.at(seen, np.minimum(some + far[some] + 1, len(blocks)), -1)
            begin, best = HALF * (np.cumsum(n) - n), {}
            doc_of, ids = np.repeat(np.arange(len(docs)), n), blocks.ravel()
            for j, places in verbatim(ids, coded_items, anchors):
                d = doc_of[places // HALF]
                inside = places + len(coded_items[j]) <= begin[d] + lens[d]
                for p, e in zip(d[inside][::-1].tolist(), (places - begin[d])[inside][::-1].tolist(), strict=True):
                    best[p, j] = (1.0, 1.0, 1.0, -e)
            look = np.flatnonzero(np.cumsum(seen[:-1]) > 0)
            after = np.ones(len(blocks), bool)  # blocks with another one of their document after them
            after[np.cumsum(n) - 1] = False
            second = np.where(after[look, None], blocks[np.minimum(look + 1, len(blocks) - 1)], len(table))
            passages = np.concatenate((blocks[look], second), 1)
            vectors = unit(mixture.sums(passages, mixture.counts(passages)))
            answering = np.flatnonzero(reach[ids])
            answering = answering[np.argsort(ids[answering], kind="stable")]
            for a in range(0, len(queries) if len(look) else 0, QUERIES_AT_ONCE):
                near = vectors @ queries[a : a + QUERIES_AT_ONCE].T
                at, of = np.nonzero(near >= cosine)
                of, near = owners[a + of], near[at, of]
                order = np.lexsort((-near, look[at], of))
                at, of, near = at[order], of[order], near[order]
                first = np.r_[True, (at[1:] != at[:-1]) | (of[1:] != of[:-1])][: len(at)]  # the nearest of an item's vectors
                at, of, near = look[at[first]], of[first], near[first]
                of_doc = doc_of[at]
                low, high = np.maximum(HALF * at - sizes[of], begin[of_doc]), np.minimum(HALF * at + PASSAGE + sizes[of], (begin + lens)[of_doc])
                for k in np.flatnonzero(with_answers(ids, answering, words_of, of, low, high)).tolist():
                    p, j, c, d = int(at[k]), int(of[k]), float(near[k]), int(of_doc[k])
                    item, around = coded_items[j], ids[low[k] : high[k]].tolist()
                    held, bag = Counter(around), Counter(item.tolist())
                    if sum(min(held[t], m) for t, m in bag.items()) < matched * len(item) or sum(held[t] > 0 for t in item[answers[j]].tolist()) < least[j]:
                        continue
                    places = matched_places(item.tolist(), around)
                    share, answer = len(places) / len(item), sum(k in places for k in answers[j]) / len(answers[j])
                    if share >= matched and answer >= answered:
                        found = (share, answer, c, -int(HALF * p - begin[d]))
                        best[d, j] = max(best.get((d, j), found), found)
            rows += [(docs[d], names[j], a, b, c, -e) for (d, j), (a, b, c, e) in best.items()]
            if len(rows) > 5000:
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "matched", "answered", "cosine", "start"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "matched", "answered", "cosine", "start"])

    return search
