"""Quality classifier: ordinal cumulative-link regression on hashed text.

Ratings are graded 0 (harmful), 1 (poor), 2 (good). All thresholds share one
weight vector over hashed features: P(grade <= j) = sigmoid(t_j - s), where s is
the sum of the weights of a text's features and t_0 < t_1. The expected grade is
the sum of P(grade > j); the tail probability P(grade = 2) selects documents.

Features of a text: each distinct word (in lower case, without punctuation
around it) and each distinct beginning of a word, the share of distinct words of each shape (what is left of a word
when letters and digits are removed, and whether it is in capitals), and how
often words repeat.
"""

from __future__ import annotations

import pickle
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

#: Places of the hashed features; the last ones are for what repeats.
PLACES = 1 << 18
REPEATS = 12
#: Rows of labels that the classifier is fitted on, at most.
FIT_ROWS = 20_000
GRADES = 3
_LETTERS = re.compile(r"[^\W_]+")


_AROUND = ".,;:!?\"'()[]{}<>|*#$%&-_"


def place(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "replace")) % (PLACES - REPEATS)


def shape(word: str) -> str:
    """What is left of a word without letters and digits, after a sign for capitals."""
    if word.isalnum():
        letters, rest = word, ""
    elif word[:-1].isalnum():
        letters, rest = word[:-1], word[-1]
    else:
        letters, rest = "".join(_LETTERS.findall(word)), _LETTERS.sub("", word)[:6]
    return ("A" if len(letters) > 1 and letters.isupper() else "a") + rest


class WordTable(dict):
    """Numbers words from 0, and holds the places of each; starts afresh after ``most`` words. Made for one task."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.at, self.begins, self.shapes = array("i"), {}, {}

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        bare, kind = word.strip(_AROUND).lower(), shape(word)
        begin = bare[:4]
        if begin not in self.begins:
            self.begins[begin] = place("p" + begin)
        if kind not in self.shapes:
            self.shapes[kind] = place("s" + kind)
        self.at.extend((place("w" + bare), self.begins[begin], self.shapes[kind]))
        return k

    def read(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, number of a word in it, times it stands there) of every distinct word of every text."""
        if len(self) > self.most:
            self.forget()
        lens = np.array([len(ws) for ws in texts], np.int64)
        ids = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(self.__getitem__, ws), np.int64, len(ws)) for ws in texts)])
        key = np.sort(np.repeat(np.arange(len(texts)), lens) * len(self) + ids)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        key, times = key[first], np.diff(np.r_[first, len(key)])
        return key // max(len(self), 1), key % max(len(self), 1), times

    def places(self) -> np.ndarray:
        """The places of the words' lower-case forms, beginnings and shapes, a row for each word."""
        return np.array(self.at, np.int64).reshape(-1, 3)


def slices(texts: list[str | None], most: int = 100_000) -> Iterator[list[list[str]]]:
    """The words of consecutive texts, about ``most`` words at a time."""
    held, total = [], 0
    for t in texts:
        held.append(words(t))
        total += len(held[-1])
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held


def text_features(text: str | None, table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text's features; a text without words has none."""
    ws = words(text)
    if not ws:
        return np.zeros(0, np.int64), np.zeros(0)
    _, ids, _ = table.read([ws])
    n = len(ids)
    at = table.places()[ids]
    shapes, times = np.unique(at[:, 2], return_counts=True)
    lexical = np.unique(at[:, :2])
    return np.concatenate((lexical, shapes, [repeat_place(n, len(ws))])), np.concatenate((np.ones(len(lexical)), 4.0 * times / n, [1.0]))


def repeat_place(distinct: np.ndarray | int, total: np.ndarray | int) -> np.ndarray:
    """The feature that says how often words repeat; short texts repeat nothing."""
    repeated = np.minimum(REPEATS - 2, (REPEATS - 1) * np.asarray(distinct) // np.maximum(total, 1))
    return PLACES - REPEATS + np.where(np.asarray(total) >= 12, repeated, REPEATS - 1)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class OrdinalModel:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, passes: int = 8, rate: float = 0.25, sparsity: float | None = None) -> OrdinalModel:
        """Follow-the-regularised-leader with L1, one text at a time; ``sparsity`` silences words seen now and then, the more the more rows there are."""
        sparsity = min(5.0, max(2.0, 5.0 * (len(rows) / 8000) ** 0.5)) if sparsity is None else sparsity
        z, n, t = np.zeros(PLACES), np.zeros(PLACES), np.linspace(-1.0, 1.0, GRADES - 1)
        order = np.random.default_rng(7)

        def weight(at):
            return np.where(np.abs(z[at]) <= sparsity, 0, -(z[at] - np.sign(z[at]) * sparsity) / ((1 + np.sqrt(n[at])) / rate))

        for p in range(passes):
            for k in order.permutation(len(rows)):
                at, x = rows[k]
                w = weight(at)
                s, y = float(w @ x), int(grades[k])
                up = sigmoid(t[y] - s) if y < GRADES - 1 else 1.0
                low = sigmoid(t[y - 1] - s) if y else 0.0
                g = (1 - up - low) * x
                root = np.sqrt(n[at] + g * g)
                z[at] += g - (root - np.sqrt(n[at])) / rate * w
                n[at] += g * g
                step, mass = 0.02 / (1 + p), max(up - low, 1e-6)
                if y < GRADES - 1:
                    t[y] += step * up * (1 - up) / mass
                if y:
                    t[y - 1] -= step * low * (1 - low) / mass
                t.sort()
        return cls(weight(np.arange(PLACES)).astype(np.float32), t)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) for every j, a column each."""
        return 1 - sigmoid(self.thresholds[None] - np.asarray(scores)[:, None])


class Scorer:
    """Scores texts with a model, many at once."""

    def __init__(self, model: OrdinalModel):
        self.model, self.table = model, WordTable()

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The sum of each text's weights; 0 for texts without words."""
        return np.concatenate([np.zeros(0), *(self._scores(part) for part in slices(texts))])

    def _scores(self, texts: list[list[str]]) -> np.ndarray:
        w, count = self.model.weights, len(texts)
        text, ids, times = self.table.read(texts)
        at = self.table.places()[ids]
        distinct, total = np.bincount(text, minlength=count), np.bincount(text, times, minlength=count)
        # words and beginnings count once in a text, even if several words share them
        lex, of = at[:, :2].ravel(), np.repeat(text, 2)
        some = w[lex] != 0
        key = np.sort(of[some] * PLACES + lex[some])
        key = key[np.r_[True, key[1:] != key[:-1]][: len(key)]]
        lexical = np.bincount(key // PLACES, w[key % PLACES], minlength=count)
        shapes = np.bincount(text, w[at[:, 2]], minlength=count)
        out = lexical + 4.0 * shapes / np.maximum(distinct, 1) + w[repeat_place(distinct, total.astype(np.int64))]
        return np.where(distinct > 0, out, 0.0)


def grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    """The grade of a rating: 0 if toxic, else 1 if of low quality, else 2; null if either is null."""
    known = F.col(quality).isNotNull() & F.col(toxic).isNotNull()
    return F.when(known, F.when(F.col(toxic) > 0, 0).when(F.col(quality) <= 0, 1).otherwise(2))


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> OrdinalModel:
    """Fits the classifier on at most about ``fit_rows`` rated documents, chosen by the hash of their id.

    Ratings with a null id or grade, and ids that are not among ``docs``, are
    left out; without any rating all texts score alike. The ratings are
    bounded, so they are broadcast; texts become features where they are read,
    and one task fits on the bounded features.
    """
    rated = labels.select(F.col("doc_id").alias("_id"), grade().alias("_grade")).where("_id is not null and _grade is not null")
    n = rated.count()
    if n > fit_rows:
        rated = rated.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 50)) < int((1 << 50) * 0.97 * fit_rows / n))
    rows = docs.select("doc_id", "text").join(F.broadcast(rated), F.col("doc_id") == F.col("_id"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = WordTable()
        for b in batches:
            made = [text_features(t, table) for t in b["text"]]
            yield pd.DataFrame({"id": b["_id"].astype(str), "grade": b["_grade"].astype("int32"), "at": [a.astype(np.int32) for a, _ in made], "x": [x.astype(np.float32) for _, x in made]})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_rows = pd.concat([pd.DataFrame({"id": [], "grade": [], "at": [], "x": []}), *batches]).sort_values("id", kind="stable")
        rows = list(zip(all_rows["at"], all_rows["x"], strict=True))
        model = OrdinalModel.fit(rows, all_rows["grade"].to_numpy())
        at = np.flatnonzero(model.weights)
        yield pd.DataFrame({"model": [pickle.dumps((at.astype(np.int32), model.weights[at], model.thresholds))]})

    made = rows.select("_id", "text", "_grade").mapInPandas(read, "id string, grade int, at array<int>, x array<float>")
    at, values, thresholds = pickle.loads(made.repartition(1).mapInPandas(fit, "model binary").first()["model"]) if n else (np.zeros(0, int), np.zeros(0), np.linspace(-1, 1, GRADES - 1))
    weights = np.zeros(PLACES, np.float32)
    weights[at] = values
    return OrdinalModel(weights, thresholds)


def _grader(model: OrdinalModel):
    """A column function from text to struct(expected_grade, tail_probability, p_harmful)."""
    at = np.flatnonzero(model.weights)
    packed = (at, model.weights[at], model.thresholds)

    @F.pandas_udf("expected_grade double, tail_probability double, p_harmful double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights = np.zeros(PLACES, np.float32)
        weights[packed[0]] = packed[1]
        scorer = Scorer(OrdinalModel(weights, packed[2]))
        for texts in batches:
            tails = scorer.model.tails(scorer.scores(texts.tolist()))
            yield pd.DataFrame({"expected_grade": tails.sum(1), "tail_probability": tails[:, -1], "p_harmful": 1 - tails[:, 0]})

    return run.asNondeterministic()  # evaluated once, whatever is asked of its result


def graded(docs: DataFrame, model: OrdinalModel, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade (0 to 2), tail_probability (of grade 2), p_harmful, kept of every row of ``docs``.

    ``kept``: the tail probability is at least ``least``. Null texts and texts
    without words have no features and get the grades of the thresholds alone.
    Null and repeated ids are graded like any other row. No shuffle.
    """
    rows = docs.select("doc_id", _grader(model)("text").alias("g"))
    return rows.select("doc_id", "g.expected_grade", "g.tail_probability", "g.p_harmful", (F.col("g.tail_probability") >= least).alias("kept"))


def selected(docs: DataFrame, model: OrdinalModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose tail probability is at least ``least``. Only texts go to Python, only grades come back."""
    # whatever the columns are called, they travel as one
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _grader(model)("text").alias("g"))
    return rows.where(F.col("g.tail_probability") >= least).select("row.*")
