"""Clustering around integer centroids by delta Lloyd rounds.

Vectors are held in blocks with their owners and distances, and the sums and
counts of each centroid's vectors are held beside the centroids. A round
compares a vector only with the centroids that moved, unless its own moved. What
changes owner is taken from one sum and added to another: blocks hand out these
signed transfers, Spark adds them up, and the sums follow without a look at the
vectors that stayed. All arithmetic is on integers, so results do not depend on
the order of rows, on partitions or on lost executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, written

#: Components beyond this are refused: squared distances would not fit into a long.
LARGEST = 1 << 26
#: Vectors of a block.
BLOCK = 8192
NEVER = np.iinfo(np.int64).max

BLOCKS = "ids array<string>, x binary, width int, owners binary, distances binary, moved array<struct<cluster int, n long, sums array<long>>>"


def integers(vectors: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and the integer vector floor(scale * x) of the rows with exactly ``dims`` components, none null or non-finite."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where((F.size(vector) == dims) & F.coalesce(finite, F.lit(False)))
    whole = lambda v: F.when(F.abs(v * scale) <= LARGEST, F.floor(v * scale)).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")).cast("long"))
    return rows.select(F.col(id_col).alias("vec_id"), F.transform(x, whole).alias("x"))


def seeds(rows: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The vectors of the ``k`` rows with the smallest SHA-256 of ``salt`` and id; ties go to the smaller vector, null ids are no seeds."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return [r["x"] for r in rows.where(F.col("vec_id").isNotNull()).select(digest.alias("h"), "x").orderBy("h", "x").limit(k).collect()]


def _distances(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = x - centroid
    return np.einsum("nd,nd->n", d, d)


def assigned(x: np.ndarray, owners: np.ndarray, distances: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and squared distances after the centroids ``moved`` (booleans) have moved; owner -1 has none yet."""
    lost = (owners < 0) | moved[owners]
    best, to = np.where(lost, NEVER, distances), np.where(lost, len(centroids), owners)
    some = np.flatnonzero(lost)
    for c, centroid in enumerate(centroids):
        if moved[c]:
            at, d = slice(None), _distances(x, centroid)
        elif len(some):
            at, d = some, _distances(x[some], centroid)
        else:
            continue
        nearer = (d < best[at]) | ((d == best[at]) & (c < to[at]))
        best[at], to[at] = np.where(nearer, d, best[at]), np.where(nearer, c, to[at])
    return to, best


def transfers(x: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[dict]:
    """For each centroid that won or lost vectors: how many more it has, and what its sum gains."""
    at = np.flatnonzero(before != after)
    out = []
    for c in np.unique(np.r_[before[at], after[at]]):
        if c >= 0:
            won, gone = at[after[at] == c], at[before[at] == c]
            out.append({"cluster": int(c), "n": len(won) - len(gone), "sums": (x[won].sum(0) - x[gone].sum(0)).tolist()})
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 1 << 15 else np.int32)


def blocks(rows: DataFrame) -> DataFrame:
    """The vectors of each partition in blocks that have no owners yet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for a in range(0, len(whole), BLOCK):
                b = whole.iloc[a : a + BLOCK]
                x = _narrow(np.stack(b["x"].to_list()))
                yield pd.DataFrame({"ids": [b["vec_id"].tolist()], "x": [x.tobytes()], "width": [x.itemsize], "owners": [np.full(len(b), -1, np.int32).tobytes()], "distances": [np.zeros(len(b), np.int64).tobytes()], "moved": [[]]})

    return rows.select(F.col("vec_id").cast("string").alias("vec_id"), "x").mapInPandas(run, BLOCKS)


def reassigned(table: DataFrame, dims: int, centroids: list[list[int]], moved: list[bool]) -> DataFrame:
    """The blocks after some centroids moved, each with its signed transfers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, changed = np.array(centroids, np.int64), np.array(moved)
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                x = np.frombuffer(r.x, f"i{r.width}").reshape(-1, dims).astype(np.int64)
                before = np.frombuffer(r.owners, np.int32)
                after, distances = assigned(x, before, np.frombuffer(r.distances, np.int64), places, changed)
                rows.append((r.ids, r.x, r.width, after.astype(np.int32).tobytes(), distances.tobytes(), transfers(x, before, after)))
            yield pd.DataFrame(rows, columns=list(b.columns))

    return table.mapInPandas(run, BLOCKS)


def delta_lloyd(vectors: DataFrame, k: int = 8, dims: int = 64, scale: int = 1024, rounds: int = 10, salt: str = "3:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that is kept.

    Rows of ``vectors`` (vec_id, embedding) with exactly ``dims`` components, none
    null or non-finite, are kept; a component x becomes floor(scale * x). The
    ``k`` centroids start as the vectors with the smallest SHA-256 of ``salt`` and
    id (all of them, if there are fewer). Each of ``rounds`` rounds gives every
    vector to its nearest centroid by squared distance, ties to the smaller
    number, and moves each centroid that has vectors to the floor of their mean;
    then vectors are given out once more. ``distance`` is squared;
    ``cluster_inertia`` and ``inertia`` are its sums; ``centroid_sha256`` is of the
    centroid's components in decimal, joined by commas.

    Rows with a null id are kept but start no centroid; repeated rows count each;
    other columns are ignored; no kept row gives an empty table. A component
    whose multiple is beyond 2^26 raises an error. The driver holds centroids and
    sums, ``k`` by ``dims`` numbers. Nothing is shuffled but a row for each
    centroid and task; of two rounds' tables one is deleted. Rounds end early
    once no centroid moves.
    """
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    rows = integers(vectors, dims, scale)
    centroids = seeds(rows, k, salt)
    if not centroids:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    counts, sums = [0] * len(centroids), [[0] * dims for _ in centroids]
    table, moved = written(blocks(rows), "vectors"), [True] * len(centroids)
    for r in range(rounds + 1):
        last, table = table, written(reassigned(table, dims, centroids, moved), "owners")
        discard(last)
        if r == rounds:
            break
        more = table.select(F.inline("moved")).groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(d))).alias(f"s{d}") for d in range(dims)])
        for t in more.collect():  # a row for each centroid
            counts[t["cluster"]] += t["n"]
            sums[t["cluster"]] = [s + t[f"s{d}"] for d, s in enumerate(sums[t["cluster"]])]
        placed = [[s // n for s in ss] if n else c for c, n, ss in zip(centroids, counts, sums, strict=True)]
        moved, centroids = [a != b for a, b in zip(placed, centroids, strict=True)], placed
        if not any(moved):
            break
    return _rows(spark, table, centroids, kind)


def _rows(spark: SparkSession, table: DataFrame, centroids: list[list[int]], kind: str) -> DataFrame:
    """A row for each vector of the blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                yield pd.DataFrame({"vec_id": list(r.ids), "cluster": np.frombuffer(r.owners, np.int32), "distance": np.frombuffer(r.distances, np.int64)})

    long: Column = F.col("vec_id").cast(kind).alias("vec_id")
    out = table.select("ids", "owners", "distances").mapInPandas(run, "vec_id string, cluster int, distance long").select(long, "cluster", "distance")
    inertia = {r["cluster"]: r["d"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row for each centroid
    known = [(c, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, d in inertia.items()]
    return out.join(F.broadcast(spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def lloyd_sql(k: int = 8, dims: int = 64, scale: int = 1024, rounds: int = 10, salt: str = "3:") -> str:
    """The same in SQL, a common table expression for each half of a round."""
    away = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    parts = [
        f"v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda e: floor({scale} * e::double)::bigint) as x from embeddings "
        f"where len(embedding) = {dims} and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0)",
        f"c0 as materialized (select row_number() over (order by sha256('{salt}' || vec_id), x) - 1 as c, x from v where vec_id is not null order by sha256('{salt}' || vec_id), x limit {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} as materialized (select v.r, any_value(v.vec_id) as vec_id, any_value(v.x) as x, min(({away}, c.c)) as d from v, c{r} as c group by v.r)")
        if r < rounds:
            parts.append(f"s{r} as (select c, list(m order by i) as x from (select d[2] as c, i, (sum(x[i]) // count(*) - (sum(x[i]) % count(*) < 0)::int)::bigint as m from a{r}, range(1, {dims + 1}) as t(i) group by all) group by c)")
            parts.append(f"c{r + 1} as materialized (select c, coalesce(s{r}.x, c{r}.x) as x from c{r} left join s{r} using (c))")
    return (
        "with " + ",\n".join(parts) + f"\nselect vec_id, d[2]::int as cluster, d[1]::bigint as distance, (sum(d[1]) over (partition by d[2]))::bigint as cluster_inertia, (sum(d[1]) over ())::bigint as inertia, "
        f"sha256(array_to_string(c.x, ',')) as centroid_sha256 from a{rounds} join c{rounds} as c on d[2] = c.c"
    )
