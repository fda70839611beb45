"""Statistics of relabelled responses by matrix products.

The responses of a cell, one for each id and combination of levels within ids,
are one row. The design is a matrix of orthonormal columns, term after term,
that travels with the tasks after a check of its size. A shuffle moves ids as
wholes and, within each id, its combinations; shuffles are made in the tasks
from a seed and their number, or are given as a matrix, which may draw an id more
than once and others not at all. Either the responses
move or, as usual, what the full model leaves of them. The statistics of a block
of shuffles are one array in a row, so no row is made for a cell, an id and a
shuffle; where only the largest value counts, a task hands on its largest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Dim, DimFrame
from .anova import helmert

#: Bytes of a design, or of shuffles given as a matrix, that may travel with tasks.
BROADCAST_BYTES = 200 << 20
#: Responses that a task holds at once, and shuffles of a block.
AT_ONCE, BLOCK = 1_000_000, 64
#: A sum of squares below this share of the whole is rounding.
ROUNDING = 1e-12


@dataclass(frozen=True)
class Design:
    """Columns over the observations (ids by combinations within, the ids' order outermost), orthonormal and free of the mean."""

    ids: list
    combos: list[tuple]
    within: tuple[str, ...]
    columns: dict[str, np.ndarray]
    #: orthonormal contrasts over the combinations, by error term
    strata: dict[str, np.ndarray]
    errors: dict[str, str]
    df: dict[str, int]
    #: responses at each place of an id, if a draw puts other than one there; columns are orthonormal over responses
    weights: np.ndarray | None = None

    @property
    def size(self) -> int:
        return len(self.ids) * len(self.combos)

    @property
    def basis(self) -> np.ndarray:
        return np.hstack(list(self.columns.values()))

    @property
    def spans(self) -> list[tuple[int, int]]:
        """Where each term's columns stand in the basis."""
        ends = np.cumsum([0, *[c.shape[1] for c in self.columns.values()]]).tolist()
        return list(zip(ends[:-1], ends[1:], strict=True))


def cleared(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns of what ``basis`` leaves of ``x``."""
    for _ in range(2):
        x = x - basis @ (basis.T @ x)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    return u[:, s > 1e-8 * max(1.0, s.max(initial=0))]


def _subsets(names: Sequence[str]) -> list[tuple[str, ...]]:
    return [t for n in range(1, len(names) + 1) for t in combinations(names, n)]


def design_of(cube: DimFrame, subjects: DataFrame | None, between: Sequence[str] = (), within: Sequence[str] = (), covariates: Sequence[str] = (), id_dim: str = "id") -> Design:
    """The design of factors and ``covariates`` (numbers) between ids, columns of ``subjects``, and factors within ids, dimensions of the cube.

    Main effects come first, then interactions; each term's columns are cleared
    of those before it. Ids without levels are left out. A design of more than
    BROADCAST_BYTES is refused before any id is fetched.
    """
    between, within = [*between, *[c for c in covariates if c not in between]], list(within)
    if not between and not within:
        raise ValueError("name factors between or within subjects, or covariates")
    rows = cube.df.select(id_dim).where(F.col(id_dim).isNotNull()).distinct()
    if between:
        rows = rows.join(subjects.select(id_dim, *between).dropna().dropDuplicates([id_dim]), id_dim)
    levels = {w: list(cube.dim(w).levels or sorted(r[0] for r in cube.df.select(w).distinct().collect())) for w in within}
    combos, n = list(product(*levels.values())), rows.count()
    if n * len(combos) * 8 * 2 > BROADCAST_BYTES:
        raise ValueError(f"{n} ids by {len(combos)} combinations are more than may be broadcast; `anova` has no such limit, relabelling does")
    found = sorted(tuple(r) for r in rows.select(id_dim, *between).collect())
    ids, coded, once = [r[0] for r in found], {}, np.ones((1, 1))
    for k, name in enumerate(between, 1):
        values = [r[k] for r in found]
        if name in covariates:
            x = np.array(values, float)
            codes = ((x - x.mean()) / (x.std(ddof=1) or 1.0))[:, None] if len(x) > 1 else np.zeros((len(x), 1))
        else:
            known = sorted(set(values))
            codes = helmert(len(known))[[known.index(v) for v in values]]
        coded[name] = np.repeat(codes, len(combos), 0)
    for k, (name, known) in enumerate(levels.items()):
        coded[name] = np.tile(helmert(len(known))[[known.index(c[k]) for c in combos]], (len(ids), 1))
    size = len(ids) * len(combos)
    if size * 8 * int(np.prod([1 + c.shape[1] for c in coded.values()])) > BROADCAST_BYTES:
        raise ValueError(f"a design of {size} rows is more than may be broadcast")
    basis, columns = np.full((size, 1), 1 / np.sqrt(max(1, size))), {}
    for t in _subsets([*between, *within]):
        x = np.ones((size, 1))
        for f in t:
            x = (x[:, :, None] * coded[f][:, None, :]).reshape(size, -1)
        columns[":".join(t)] = cleared(x, basis)
        basis = np.hstack((basis, columns[":".join(t)]))
    strata, errors, df = {}, {}, {t: c.shape[1] for t, c in columns.items()}
    for t in [(), *_subsets(within)]:
        part = once
        for f in within:
            h = helmert(len(levels[f]))
            part = np.kron(part, h / np.linalg.norm(h, axis=0) if f in t else np.full((len(levels[f]), 1), len(levels[f]) ** -0.5))
        name, own = ":".join(("id", *t)), [m for m in columns if tuple(f for f in m.split(":") if f in within) == t]
        strata[name] = part
        df[name] = len(ids) * part.shape[1] - sum(df[m] for m in own) - (not t)
        errors.update(dict.fromkeys(own, name))
    return Design(ids, combos, tuple(within), columns, strata, errors, df)


class Shuffles:
    """``n`` random orders of a design's observations: ids trade places as wholes, and so do the combinations within each id.

    Order p follows from the seed and p alone, so any task makes it.
    """

    places: Design | None = None

    def __init__(self, design: Design, n: int, seed: int = 1):
        self.ids, self.combos, self.n, self.seed = len(design.ids), len(design.combos), n, seed

    def order(self, p: int) -> np.ndarray:
        rng = np.random.default_rng([self.seed, p])
        within = np.argsort(rng.random((self.ids, self.combos)), axis=1)
        return (rng.permutation(self.ids)[:, None] * self.combos + within).ravel()


class Given:
    """Orders of observations given as a matrix, a row each; -1 leaves one out.

    An order may draw observations more than once, if it draws the combinations
    of an id equally often; it leaves out ids as wholes. ``places`` is the design
    to whose places observations go, if that is not their own.
    """

    def __init__(self, design: Design, orders: np.ndarray, places: Design | None = None):
        self.orders, self.n, self.places = np.asarray(orders, np.int32), len(orders), places
        if self.orders.nbytes > BROADCAST_BYTES:
            raise ValueError("these shuffles are more than may be broadcast; pass them in parts")
        to, combos = places or design, len(design.combos)
        if self.orders.shape[1:] != (design.size,) or to.combos != design.combos or ((self.orders < -1) | (self.orders >= to.size)).any():
            raise ValueError("every row must hold a place, or -1, for each observation")
        for order in self.orders:
            for x in (order < 0, np.bincount(order[order >= 0], minlength=to.size)):
                if (np.diff(x.reshape(-1, combos).astype(int), axis=1) != 0).any():
                    raise ValueError("every row must draw, or leave out, the combinations of an id equally often")

    def order(self, p: int) -> np.ndarray:
        return self.orders[p]


def drawn(design: Design, held: np.ndarray) -> Design:
    """The design of a draw that puts ``held`` responses on each place, as many on all places of an id; ids without any are left out.

    A term keeps its degrees of freedom where the draw lacks some of its levels; those of the errors follow from the ids drawn.
    """
    if (held == 1).all():
        return design
    full, weights = held > 0, held.reshape(-1, len(design.combos))[:, 0]
    root, columns = np.sqrt(held[full])[:, None], {}
    basis = root / np.linalg.norm(root)
    for t, c in design.columns.items():
        new = cleared(c[full] * root, basis)
        basis, columns[t] = np.hstack((basis, new)), new / root
    ids = [i for i, w in zip(design.ids, weights, strict=True) if w]
    errors = {e: design.df[e] - (len(design.ids) - len(ids)) * part.shape[1] for e, part in design.strata.items()}
    return replace(design, ids=ids, columns=columns, df=design.df | errors, weights=weights[weights > 0])


def residuals(y: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """What the mean and the model leave of each row of ``y``."""
    y = y - y.mean(1, keepdims=True)
    return y - (y @ basis) @ basis.T


def moved(y: np.ndarray, design: Design, order: np.ndarray, what: str, places: Design | None = None) -> tuple[np.ndarray, Design, np.ndarray | float]:
    """(sums of the responses at each place, the design of these places, squares of what differs within a place) after a shuffle.

    Residuals take the order; of observations the design does, so that they go the other way.
    """
    kept = order >= 0
    if what == "residuals":
        return y[:, order[kept]], drawn(design, kept.astype(int)), 0.0
    held = np.bincount(order[kept], minlength=(places or design).size)
    to, now, counts = drawn(places or design, held), y[:, np.flatnonzero(kept)[np.argsort(order[kept], kind="stable")]], held[held > 0]
    if (counts == 1).all():
        return now, to, 0.0
    sums = np.add.reduceat(now, np.cumsum(counts) - counts, axis=1)
    return sums, to, ((now - np.repeat(sums / counts, counts, axis=1)) ** 2).sum(1)


def centred(sums: np.ndarray, design: Design) -> np.ndarray:
    """Sums of responses at the places of a design less what the mean of all makes of them."""
    if design.weights is None:
        return sums - sums.mean(1, keepdims=True)
    held = np.repeat(design.weights, len(design.combos))
    return sums - held * (sums.sum(1, keepdims=True) / max(1, held.sum()))


def f_values(y: np.ndarray, design: Design, orders: Sequence[np.ndarray] | None = None, what: str = "residuals", places: Design | None = None) -> np.ndarray:
    """F of each term, row of ``y`` (cells by observations) and order (None: the observed one): terms by cells by orders.

    NaN where the error has no degrees of freedom or is nothing but rounding, or a value is missing.
    What differs between the responses that a draw puts on one place counts in the innermost error term.
    """
    every, innermost = np.hstack(list(design.strata.values())), list(design.strata)[-1]
    ends = np.cumsum([0, *[s.shape[1] for s in design.strata.values()]]).tolist()
    start = y if orders is None or what == "observations" else residuals(y, design.basis)
    out = np.full((len(design.columns), len(y), 1 if orders is None else len(orders)), np.nan)
    whole = ((start - start.mean(1, keepdims=True)) ** 2).sum(1)
    for p in range(out.shape[2]):
        now, to, within = (start, design, 0.0) if orders is None else moved(start, design, orders[p], what, places)
        now = centred(now, to)
        parts = (now @ to.basis) ** 2
        ss = {t: parts[:, a:z].sum(1) for t, (a, z) in zip(to.columns, to.spans, strict=True)}
        squares = ((now.reshape(-1, len(to.combos)) @ every) ** 2).reshape(len(y), len(to.ids), every.shape[1])
        squares = squares.sum(1) if to.weights is None else (squares / to.weights[:, None]).sum(1)
        error = {e: squares[:, a:z].sum(1) - sum(ss[m] for m, o in to.errors.items() if o == e) for e, a, z in zip(to.strata, ends[:-1], ends[1:], strict=True)}
        error[innermost] = error[innermost] + within
        for k, t in enumerate(to.columns):
            e = to.errors[t]
            if to.df[t] and to.df[e] > 0:
                with np.errstate(divide="ignore", invalid="ignore"):
                    f = (ss[t] / to.df[t]) / (error[e] / to.df[e])
                out[k, :, p] = np.where(error[e] > ROUNDING * whole, f, np.nan)
    return out


def map_effects(y: np.ndarray, design: Design, orders: Sequence[np.ndarray] | None = None, what: str = "residuals", places: Design | None = None) -> np.ndarray:
    """Sizes of the maps of each term, for ``y`` of cells by channels by observations: terms by cells by orders.

    A term's maps are what its columns explain, at each distinct row of theirs;
    the effect is the unweighted mean over maps of their standard deviation over
    channels, or of their absolute value if there is a single channel.
    """
    cells, chans, size = y.shape
    flat = y.reshape(-1, size)
    start = flat if orders is None or what == "observations" else residuals(flat, design.basis)
    out, seen = np.full((len(design.columns), cells, 1 if orders is None else len(orders)), np.nan), None
    for p in range(out.shape[2]):
        now, to, _ = (start, design, 0.0) if orders is None else moved(start, design, orders[p], what, places)
        if to is not seen:
            seen, distinct = to, [np.unique(c.round(10), axis=0) for c in to.columns.values()]
        coefficients = centred(now, to) @ to.basis
        for k, (t, (a, z), rows) in enumerate(zip(to.columns, to.spans, distinct, strict=True)):
            if z == a and to.df[t]:  # the draw has no two of the term's levels
                out[k, :, p] = 0.0 * now.sum(1).reshape(cells, chans).sum(1)
            elif z > a:
                maps = (coefficients[:, a:z] @ rows.T).reshape(cells, chans, -1)
                out[k, :, p] = (maps.std(1, ddof=1) if chans > 1 else np.abs(maps[:, 0])).mean(1)
    return out


def responses(cube: DimFrame, design: Design, outside: Sequence[str], id_dim: str, along: str | None = None) -> DataFrame:
    """One row for each combination of ``outside``: places (_k) and values (_v) of its responses; with ``along`` all its levels' in one row, first level first."""
    spark, schema = cube.df.sparkSession, cube.df.schema
    table = spark.createDataFrame([(i, k) for k, i in enumerate(design.ids)], f"`{id_dim}` {schema[id_dim].dataType.simpleString()}, _i long")
    value = F.col(cube.value).cast("double")
    rows = cube.df.where(value.isNotNull() & ~F.isnan(value)).join(F.broadcast(table), id_dim)  # bounded: the design's size was checked
    place = F.col("_i") * len(design.combos)
    if design.within:
        fields = ", ".join(f"`{w}` {schema[w].dataType.simpleString()}" for w in design.within)
        rows = rows.join(F.broadcast(spark.createDataFrame([(*c, k) for k, c in enumerate(design.combos)], f"{fields}, _c long")), list(design.within))
        place = place + F.col("_c")
    if along is None:
        return rows.groupBy(*outside).agg(F.collect_list(place).alias("_k"), F.collect_list(value).alias("_v"))
    return rows.groupBy(*outside).agg(F.collect_list(place).alias("_k"), F.collect_list(value).alias("_v"), F.collect_list(F.col(along).cast("string")).alias("_a"))


Statistic = Callable[[pd.DataFrame, int, int], np.ndarray]


def by_blocks(cells: DataFrame, outside: Sequence[str], terms: Sequence[str], n: int, each: int, statistic: Statistic, by: Sequence[str] | None = None) -> DataFrame:
    """``outside``, modelterm, block and stats, the array of a block's statistics, for each row of ``cells``; with ``by`` the largest of each task's rows.

    ``statistic`` takes some rows, a first shuffle and the one after the last,
    and gives terms by rows by shuffles; ``each`` row has so many values.
    """
    keys = list(outside if by is None else by)
    fields = "".join(f"`{c}` {cells.schema[c].dataType.simpleString()}, " for c in keys)
    step = max(1, AT_ONCE // max(1, each, BLOCK))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), step):
                rows = whole.iloc[at : at + step].reset_index(drop=True)
                groups = list(rows.groupby(keys, dropna=False, sort=False).indices.values()) if by else [np.arange(len(rows))]
                for first in range(0, n, BLOCK):
                    stats = statistic(rows, first, min(n, first + BLOCK))
                    for k, t in enumerate(terms):
                        if by is None:
                            out = rows[keys].copy()
                            out["stats"] = list(stats[k])
                        else:
                            out = rows[keys].iloc[[g[0] for g in groups]].reset_index(drop=True)
                            out["stats"] = [np.fmax.reduce(np.abs(stats[k][g]), 0) for g in groups]
                        out.insert(len(keys), "block", first // BLOCK)
                        out.insert(len(keys), "modelterm", t)
                        yield out

    return cells.mapInPandas(run, f"{fields}modelterm string, block int, stats array<double>")


def each_shuffle(blocks: DataFrame, keys: Sequence[str], name: str = "stat") -> DataFrame:
    """A row for each shuffle (``perm``) of the blocks; NaN becomes null."""
    long = blocks.select(*keys, "block", F.posexplode("stats").alias("_p", "_s"))
    return long.select(*keys, (F.col("block") * BLOCK + F.col("_p")).cast("int").alias("perm"), F.when(~F.isnan("_s"), F.col("_s")).alias(name))


def largest(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``most``: the largest statistic of each shuffle and combination of ``keys``, 0 where none is known."""
    return each_shuffle(blocks, keys).groupBy(*keys, "perm").agg(F.coalesce(F.max(F.abs("stat")), F.lit(0.0)).alias("most"))


def _filled(rows: pd.DataFrame, size: int) -> np.ndarray:
    y = np.full((len(rows), size), np.nan)
    for row, k, v in zip(y, rows["_k"], rows["_v"], strict=True):
        row[k] = v
    return y


def permuted_f(cube: DimFrame, design: Design, shuffles: Shuffles | Given, what: str = "residuals", id_dim: str = "id", by: Sequence[str] | None = None) -> DataFrame:
    """F of every term and cell for all shuffles, in blocks; with ``by`` the largest of each combination, see ``by_blocks``."""
    if what not in ("residuals", "observations"):
        raise ValueError(f"residuals or observations are shuffled, not {what!r}")
    if what == "residuals" and shuffles.places is not None:
        raise ValueError("residuals stay with their own design")
    outside = cube.others(id_dim, *design.within)

    def statistic(rows: pd.DataFrame, first: int, last: int) -> np.ndarray:
        return f_values(_filled(rows, design.size), design, [shuffles.order(p) for p in range(first, last)], what, shuffles.places)

    return by_blocks(responses(cube, design, outside, id_dim), outside, list(design.columns), shuffles.n, design.size, statistic, by)


def permuted_maps(cube: DimFrame, design: Design, shuffles: Shuffles | Given | None, what: str = "residuals", id_dim: str = "id", chan: str = "chan", kind: str = "both") -> DimFrame:
    """``effect`` of every term on the topography: the observed one as ``perm`` 0, then those of the shuffles.

    ``kind``: both, topography (every map scaled to length 1 first) or intensity
    (global field power first; mean absolute effects).
    """
    from .aggregate import gfp
    from .sequence import scaled

    places = shuffles.places if shuffles else None
    if what == "residuals" and places is not None:
        raise ValueError("residuals stay with their own design")
    outside = cube.others(id_dim, chan, *design.within)
    if kind == "topography":
        cube = scaled(cube, [*outside, id_dim, *design.within])
    elif kind == "intensity":
        cube = gfp(cube, chan)
    elif kind != "both":
        raise ValueError(f"no kind {kind!r} of effect")
    single = kind == "intensity"
    levels = [""] if single else sorted(str(r[0]) for r in cube.df.select(chan).distinct().collect())
    if len(levels) * design.size * 8 > BROADCAST_BYTES:
        raise ValueError(f"maps of {len(levels)} channels by {design.size} responses are more than a row may hold")
    cells = responses(cube, design, outside, id_dim, None if single else chan)
    at = {a: k for k, a in enumerate(levels)}

    def statistic(rows: pd.DataFrame, first: int, last: int) -> np.ndarray:
        y = np.full((len(rows), len(levels), design.size), np.nan)
        for k, (place, v) in enumerate(zip(rows["_k"], rows["_v"], strict=True)):
            y[k, 0 if single else [at[a] for a in rows["_a"].iloc[k]], place] = v
        orders = [shuffles.order(p - 1) for p in range(max(1, first), last)]
        parts = [map_effects(y, design)] * (first == 0) + [map_effects(y, design, orders, what, places)] * bool(orders)
        return np.concatenate(parts, 2)

    blocks = by_blocks(cells, outside, list(design.columns), 1 + (shuffles.n if shuffles else 0), design.size * len(levels), statistic)
    dims = (*[d for d in cube.dims if d.name in outside], Dim("modelterm"), Dim("perm"))
    return DimFrame(each_shuffle(blocks, [*outside, "modelterm"], "effect"), dims, "effect")
