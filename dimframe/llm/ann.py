"""Nearest neighbours by inner product with score-aware quantisation.

Vectors are dealt to cells by their nearest centroid, and cells to lists. What
is left of a vector is brought to length one and quantised to four bits for each
pair of dimensions, under the anisotropic loss: the part of the error parallel
to the vector, which shifts its large inner products, costs more than the part
across it. A query scans the tables of the lists that promise most and reranks
the best of each scan by exact inner products in double precision. How far the
code is from its vector is kept beside it, which bounds the error of a scan: an
exact check of all that might still reach the best found follows, so no list
that is scanned hides a neighbour, whatever the vectors are like.

Copies of a vector are indexed once, with their smallest ids. Lists are split
into chunks of vectors, which stay where they are; the queries, far fewer, are
sent to every chunk of their lists and pass it as a stream.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .groups import pieces, spread_join

#: Distinct vectors that centroids and codebooks are fitted on, at most about so many.
FIT_ROWS = 10_000
CENTRES = 16  # four bits
#: Inner products above this share of the norm matter: sets the price of the parallel error.
SCORE_SHARE = 0.2
#: Vectors that queries pass at a time.
CHUNK = 16384
#: Lists, at most: centroids go to every task.
LISTS = 256
#: Cells, at most, where fewer lists are needed; a cell has 16 fitted vectors on average, or more.
CELLS = 256
#: Vectors of a scan that are reranked first for each query.
RERANK = 512
EPS = np.finfo(np.float64).eps


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    scale = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) or 1.0  # squares neither overflow nor vanish
    x, c = x / scale, c / scale
    return ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)


def _lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows whose squares may overflow or vanish."""
    most = np.abs(x).max(1, initial=0)
    most[most == 0] = 1.0
    return np.linalg.norm(x / most[:, None], axis=1) * most


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's centroids, ``k`` at most."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        for j in range(len(c)):
            if (mine := near == j).any():
                c[j] = x[mine].mean(0)
    return c


class Quantiser:
    """Centroids, and codebooks of 16 centres for each pair of dimensions."""

    def __init__(self, centroids: np.ndarray, books: np.ndarray, price: float):
        self.centroids, self.books, self.price = centroids, books, price

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, rounds: int = 8) -> Quantiser:
        rng = np.random.default_rng(5)
        d = x.shape[1]
        scale = np.abs(x).max(initial=0) or 1.0
        c = _means(x / scale, lists, rounds, rng) * scale
        parts = -(-d // 2)
        price = (d - 1) * SCORE_SHARE**2 / (1 - SCORE_SHARE**2) - 1
        books = np.zeros((parts, CENTRES, 2))
        out = cls(c, books, max(price, 0.0))
        rest, unit = out.split(x, _nearest(x, c))
        for m in range(parts):
            books[m] = rest[rng.choice(len(x), CENTRES), m] + rng.normal(0, 1e-9, (CENTRES, 2))
        for _ in range(rounds):
            codes = out.codes(rest, unit, sweeps=1)
            chosen = np.stack([books[m][codes[:, m]] for m in range(parts)], 1)
            along = ((rest - chosen) * unit).sum((1, 2))
            for m in range(parts):  # each centre solves its own weighted least squares, the other parts fixed
                other = along - ((rest[:, m] - chosen[:, m]) * unit[:, m]).sum(1)
                u, r = unit[:, m], rest[:, m]
                left = np.eye(2)[None] + out.price * u[:, :, None] * u[:, None, :]
                right = r + out.price * u * (other + (r * u).sum(1))[:, None]
                for k in range(CENTRES):
                    if (mine := codes[:, m] == k).any():
                        books[m, k] = np.linalg.solve(left[mine].sum(0), right[mine].sum(0))
                chosen[:, m] = books[m][codes[:, m]]
                along = other + ((r - chosen[:, m]) * u).sum(1)
        return out

    def split(self, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The directions of what the centroids leave of the vectors (zero, if nothing), and of the vectors, by pairs of dimensions."""
        odd = x.shape[1] % 2

        def pairs(a: np.ndarray) -> np.ndarray:
            a = a / np.maximum(np.abs(a).max(1, initial=0, keepdims=True), np.finfo(np.float64).tiny)
            return np.pad(a / np.maximum(_lengths(a), 1e-300)[:, None], ((0, 0), (0, odd))).reshape(len(a), -1, 2)

        return pairs(x - self.centroids[near]), pairs(x)

    def codes(self, rest: np.ndarray, unit: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes of least anisotropic loss, found part by part: |e|^2 + price * (e . direction)^2."""
        parts = rest.shape[1]
        out = np.stack([((rest[:, m, None] - self.books[m][None]) ** 2).sum(2).argmin(1) for m in range(parts)], 1)
        along = sum(((rest[:, m] - self.books[m][out[:, m]]) * unit[:, m]).sum(1) for m in range(parts))
        for _ in range(sweeps):
            for m in range(parts):
                other = along - ((rest[:, m] - self.books[m][out[:, m]]) * unit[:, m]).sum(1)
                error = rest[:, m, None] - self.books[m][None]
                part = (error * unit[:, m, None]).sum(2)
                out[:, m] = ((error**2).sum(2) + self.price * (other[:, None] + part) ** 2).argmin(1)
                along = other + np.take_along_axis(part, out[:, m, None], 1)[:, 0]
        return out.astype(np.uint8)

    def packed(self, x: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Two codes to a byte; then, eight bytes each, the length of what is coded and by how much a scan for a query of length one may err."""
        rest, unit = self.split(x, near)
        codes = self.codes(rest, unit)
        coded = np.stack([self.books[m][codes[:, m]] for m in range(codes.shape[1])], 1)
        length, total = _lengths(x - self.centroids[near]), _lengths(x) + _lengths(self.centroids[near])
        codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
        codes = codes[:, 0::2] | codes[:, 1::2] << 4
        # the error of the code, of its sum in single precision, and of the rest in double precision
        single = (codes.shape[1] + 8) * np.finfo(np.float32).eps * np.sqrt((coded**2).sum((1, 2)))
        miss = (np.sqrt(((rest - coded) ** 2).sum((1, 2))) + single) * length * (1 + 1e-9) + 8 * (x.shape[1] + 8) * EPS * total
        return np.hstack([codes, length[:, None].view(np.uint8), miss[:, None].view(np.uint8)])

    def scan(self, q: np.ndarray, centroid: int | np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products of queries with the vectors of one centroid, or of one for each vector, by table."""
        odd = q.shape[1] % 2
        parts = np.pad(q, ((0, 0), (0, odd))).reshape(len(q), -1, 2)
        table = np.einsum("qmd,mkd->qmk", parts, self.books).astype(np.float32)
        table = np.pad(table, ((0, 0), (0, table.shape[1] % 2), (0, 0)))
        both = (table[:, 1::2, :, None] + table[:, 0::2, None, :]).reshape(len(q), -1, 256)  # byte: high code, low code
        out = np.zeros((len(q), len(packed)), np.float32)
        for j in range(both.shape[1]):
            out += both[:, j][:, packed[:, j]]
        return (q @ self.centroids.T)[:, np.broadcast_to(centroid, len(packed))] + out * _doubles(packed, -16)

    @staticmethod
    def miss(packed: np.ndarray) -> np.ndarray:
        """By how much a scan for a query of length one may err."""
        return _doubles(packed, -8)


def _doubles(packed: np.ndarray, at: int) -> np.ndarray:
    return np.ascontiguousarray(packed[:, at : at + 8 or None]).view(np.float64)[:, 0]


class Chunk:
    """Vectors that queries pass, with their codes."""

    def __init__(self, quantiser: Quantiser, ids: np.ndarray, x: np.ndarray, cell: np.ndarray, packed: np.ndarray):
        self.quantiser, self.ids, self.x, self.cell, self.packed = quantiser, ids, x, cell, packed
        self.miss, self.lengths = quantiser.miss(packed), _lengths(x)

    def best(self, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, inner product) of the ``n`` largest inner products of every query, ties to smaller ids."""
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            return self._best(q, n)

    def _best(self, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, d, length = self.x, q.shape[1], _lengths(q)
        unit = q / length[:, None]
        about = self.quantiser.scan(unit, self.cell, self.packed)
        some = np.argpartition(-about, RERANK - 1, 1)[:, :RERANK] if len(x) > RERANK else np.broadcast_to(np.arange(len(x)), about.shape)
        # inner products in double precision are right within this; more where they vanish, and anything goes where they overflow
        slack, vanish = 4 * (d + 8) * EPS * self.lengths, d * 1e-320 * (1 + 1 / length)
        vanish[~(length < 1e307 / max(self.lengths.max(), 1.0))] = np.inf
        least = _nth(np.einsum("qrd,qd->qr", x[some], unit) - slack[some], n) - vanish
        may = ~(about + self.miss < least[:, None])
        at = np.flatnonzero(may.any(0))
        exact = np.hstack([unit @ x[at[a : a + 4096]].T for a in range(0, len(at), 4096)])
        least = np.fmax(least, _nth(exact - slack[at], n) - vanish)
        row, col = np.nonzero(may[:, at] & ~(exact + slack[at] < least[:, None]))
        col = at[col]
        step = max(1, (1 << 21) // d)
        score = np.concatenate([np.einsum("nd,nd->n", x[col[a : a + step]], q[row[a : a + step]]) for a in range(0, len(row), step)])
        order = np.lexsort((self.ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < n
        return row[first], self.ids[col[first]], score[first]


def _nth(score: np.ndarray, n: int) -> np.ndarray:
    """The n-th largest of each row, no bound if there are fewer."""
    return np.partition(score, -n, 1)[:, -n] if score.shape[1] >= n else np.full(len(score), -np.inf)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in col]) if len(col) else np.zeros((0, 1))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (array of double): rows that take part; the most common number of dimensions counts."""
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False))).where(F.exists("vector", lambda x: x != 0))
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vector") == (common["d"] if common else 0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, probe: float = 1.0, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The ``k`` vectors of largest inner product for every row of ``vectors`` (vec_id, embedding) with ``is_query``.

    Returns query_id, rank (from 1), vec_id, score: the inner product in double
    precision, ties to the smaller vec_id, the query's own vec_id left out, all
    candidates if there are fewer than ``k``. Rows with a null id, and vectors
    that are null, zero or hold null or non-finite components, take no part as
    queries or candidates, nor do vectors of another number of dimensions than
    the most common one. Repeated rows are candidates each. Other columns are
    ignored. ``probe``: the share of lists that a query scans. At 1 the result is
    exact; below 1 it saves work where vectors are clustered, and costs recall
    where they are not.

    The quantiser is fitted in one task on about ``fit_rows`` distinct vectors
    at most, chosen by hash; every vector is indexed. The driver sees the
    quantiser and the sizes of lists, of which there are ``LISTS`` at most.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    classes = rows.withColumn("n", first).where(F.col("n") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = written(classes.select(F.col("ids")[0].alias("cls"), "ids", "vector"), "vectors")
    total = classes.count()
    result = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], result)
    lists = min(LISTS, math.ceil(total / CHUNK))
    probed = max(1, math.ceil(lists * probe))
    sample = classes.where(F.pmod(F.xxhash64("cls"), F.lit(1 << 50)) < int((1 << 50) * 0.97 * fit_rows / total)) if total > fit_rows else classes

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = pd.concat(list(batches)).sort_values("cls")
        x = _matrix(b["vector"])
        q = Quantiser.fit(x, max(lists, min(CELLS, len(x) // 16)))
        groups = _means(q.centroids, lists, 8, np.random.default_rng(5))
        yield pd.DataFrame({"model": [pickle.dumps(((q.centroids, q.books, q.price), groups))]})

    model = sample.select("cls", "vector").repartition(1).mapInPandas(fit, "model binary").first()["model"]

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted, groups = pickle.loads(model)
        q = Quantiser(*fitted)
        list_of = _nearest(q.centroids, groups).astype(np.int32)
        for b in batches:
            if len(b):
                x = _matrix(b["vector"])
                near = _nearest(x, q.centroids)
                yield pd.DataFrame({"list": list_of[near], "cls": b["cls"], "cell": near.astype(np.int32), "codes": [c.tobytes() for c in q.packed(x, near)], "x": [v.tobytes() for v in x]})

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups = pickle.loads(model)[1]
        for b in batches:
            if len(b):
                x = _matrix(b["vector"])
                best = np.argsort(-(x @ groups.T), 1, kind="stable")[:, :probed]
                yield pd.DataFrame({"list": best.ravel().astype(np.int32), "q": np.repeat(b["cls"].to_numpy(), best.shape[1]), "x": [v.tobytes() for v in np.repeat(x, best.shape[1], 0)]})

    asked = written(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vector"), "queries")
    of = asked.groupBy("vector").agg(F.count(F.lit(1)).alias("n")).join(classes.select("vector", F.col("cls").alias("q")), "vector")
    of = written(of, "asked")
    queries = of.select(F.col("q").alias("cls"), "vector")
    indexed = written(classes.select("cls", "vector").mapInPandas(index, "list int, cls long, cell int, codes binary, x binary"), "index")
    sizes = indexed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks")).collect()
    sizes = F.broadcast(spark.createDataFrame([tuple(r) for r in sizes], "list int, chunks long"))  # LISTS rows at most
    here = indexed.join(sizes, "list").select("list", F.pmod(F.xxhash64("cls"), "chunks").alias("chunk"), F.lit(0).alias("kind"), F.col("cls").alias("id"), "cell", "codes", "x")
    routed = queries.mapInPandas(route, "list int, q long, x binary").join(sizes, "list")
    sent = routed.select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("kind"), F.col("q").alias("id"), F.lit(None).cast("int").alias("cell"), F.lit(None).cast("binary").alias("codes"), "x")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quantiser, at, held = Quantiser(*pickle.loads(model)[0]), None, []
        for g in pieces(batches, ["list", "chunk", "kind"]):
            key, kind = (g["list"].iloc[0], g["chunk"].iloc[0]), g["kind"].iloc[0]
            if kind == 0:
                held = (held if key == at else []) + [g]
                at, whole = key, None
                continue
            if key != at:  # a chunk that holds nothing
                continue
            if whole is None:
                every = pd.concat(held)
                whole = Chunk(quantiser, every["id"].to_numpy(), _bytes_matrix(every["x"]), every["cell"].to_numpy(np.int64), np.stack([np.frombuffer(c, np.uint8) for c in every["codes"]]))
            q, ids, step = _bytes_matrix(g["x"]), g["id"].to_numpy(), max(1, min(64, 4096 // whole.x.shape[1]))
            for a in range(0, len(q), step):
                row, cls, score = whole.best(q[a : a + step], k + 1)
                yield pd.DataFrame({"q": ids[a + row], "cls": cls, "score": score})

    met = here.unionByName(sent).repartition("list", "chunk").sortWithinPartitions("list", "chunk", "kind")
    found = met.mapInPandas(search, "q long, cls long, score double")
    place = lambda *by: F.row_number().over(Window.partitionBy(by[0]).orderBy(F.desc("score"), by[1]))
    found = found.withColumn("n", place("q", "cls")).where(F.col("n") <= k + 1).drop("n")
    spread = found.join(classes.select("cls", "ids"), "cls").select("q", "score", F.explode("ids").alias("vec_id"))
    spread = spread.withColumn("n", place("q", "vec_id")).where(F.col("n") <= k + 1)
    # the nearest of each distinct query, at most k + 1, for all rows that ask it
    best = spread.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best")).join(of.select("q", "n"), "q")
    rows = spread_join(spread_join(asked, of, ["vector"]).select("query_id", "q"), written(best, "nearest"), ["q"])
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    pairs = rows.select("query_id", F.posexplode(others).alias("p", "b"))
    return pairs.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def _bytes_matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float64) for v in col])
