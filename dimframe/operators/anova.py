"""Mass-univariate analysis of variance with sequential sums of squares.

Subjects are many, the cells of the design (levels between by levels within)
are few. The sum of squares of a model term is the squared length of the data's
projection on the term's orthonormal columns, which are constant within a cell
of the design, so it follows from the cells' sums. The variation of subjects, and
of subjects over a term within, follows from squared sums of each subject: the
length of the projection on subjects by levels, less that on fewer levels, less
the model terms of that stratum. Each subject is one row of one shuffle; no
subject reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations, product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import DimFrame
from ..functions.dist import f_p_col


def helmert(n: int) -> np.ndarray:
    """Each level against the mean of those before it: n by n - 1."""
    out = np.zeros((n, n - 1))
    for k in range(n - 1):
        out[: k + 1, k] = -1
        out[k + 1, k] = k + 1
    return out


def _terms(factors: Sequence[str]) -> list[tuple[str, ...]]:
    return [t for n in range(1, len(factors) + 1) for t in combinations(factors, n)]


def model_columns(groups: Sequence[tuple], sizes: Sequence[int], between: Sequence[str], within: dict[str, Sequence]) -> dict[str, np.ndarray]:
    """The columns of every model term over the cells of the design: orthonormal over subjects, term after term.

    ``groups`` are the combinations of levels between that occur, with ``sizes``
    subjects each. Rows are groups by combinations of levels within. Main
    effects come first, then interactions.
    """
    combos = list(product(*within.values()))
    coded: dict[str, np.ndarray] = {}
    for k, name in enumerate(between):
        levels = sorted({g[k] for g in groups})
        coded[name] = np.repeat(helmert(len(levels))[[levels.index(g[k]) for g in groups]], len(combos), 0)
    for k, (name, levels) in enumerate(within.items()):
        coded[name] = np.tile(helmert(len(levels))[[list(levels).index(c[k]) for c in combos]], (len(groups), 1))
    weight = np.sqrt(np.repeat(np.asarray(sizes, float), len(combos)))[:, None]  # a row stands for so many subjects
    basis, out = weight / np.linalg.norm(weight), {}
    for t in _terms([*between, *within]):
        x = weight
        for f in t:
            x = (x[:, :, None] * coded[f][:, None, :]).reshape(len(weight), -1)
        for _ in range(2):
            x = x - basis @ (basis.T @ x)
        u, s, _ = np.linalg.svd(x, full_matrices=False)
        new = u[:, s > 1e-8 * max(1.0, s.max(initial=0))]
        basis = np.hstack((basis, new))
        out[":".join(t)] = new / weight
    return out


def sums_of_squares(cube: DimFrame, subjects: DataFrame | None, between: Sequence[str], within: dict[str, Sequence], id_dim: str) -> tuple[DataFrame, dict[str, str], dict[str, int]]:
    """(a row of sums of squares for each combination of the other dimensions, error terms of model terms, degrees of freedom).

    ``subjects`` has ids and their levels between, each id once. A column is named by
    its term; error terms are ``id`` and ``id`` with terms within. A combination
    with a cell missing or null has nulls.
    """
    spark, outside, v = cube.df.sparkSession, cube.others(id_dim, *within), F.col(cube.value)
    ids = cube.df.select(id_dim).distinct()
    found = sorted(tuple(r) for r in ids.join(subjects, id_dim).groupBy(*between).count().collect()) if between else [(ids.count(),)]
    kinds, sizes = [r[:-1] for r in found], [r[-1] for r in found]  # as many as levels between
    combos, n_ids = list(product(*within.values())), sum(sizes)
    columns = model_columns(kinds, sizes, between, within)
    weights = np.hstack([*columns.values(), np.zeros((len(kinds) * len(combos), 0))])
    # one row for each subject: its values over the combinations within
    is_combo = lambda c: reduce(lambda a, b: a & b, [F.col(n) == F.lit(x) for n, x in zip(within, c, strict=True)], F.lit(True))
    wide = (cube.df.join(subjects, id_dim) if between else cube.df).groupBy(*outside, id_dim, *between).agg(*[F.max(F.when(is_combo(c), v)).alias(f"_v{k}") for k, c in enumerate(combos)])
    strata = [(), *_terms(list(within))]
    at = {f: k for k, f in enumerate(within)}

    def length(t: tuple[str, ...]) -> Column:
        """The squared length of a subject's projection on the levels of some factors within."""
        parts: dict[tuple, list[Column]] = {}
        for k, c in enumerate(combos):
            parts.setdefault(tuple(c[at[f]] for f in t), []).append(F.col(f"_v{k}"))
        return reduce(Column.__add__, [F.pow(reduce(Column.__add__, p), 2) / len(p) for p in parts.values()])

    lengths = [F.sum(length(t)).alias(f"_q{k}") for k, t in enumerate(strata)]
    full = reduce(Column.__add__, [F.col(f"_v{k}").isNotNull().cast("long") for k in range(len(combos))])
    cells = wide.groupBy(*outside, *between).agg(*[F.sum(f"_v{k}").alias(f"_s{k}") for k in range(len(combos))], *lengths, F.sum(full).alias("_n"))
    table = [(*g, weights[k * len(combos) : (k + 1) * len(combos)].T.tolist()) for k, g in enumerate(kinds)]
    fields = "".join(f"`{b}` {subjects.schema[b].dataType.simpleString()}, " for b in between)
    table = spark.createDataFrame(table, fields + "_w array<array<double>>")
    cells = cells.join(F.broadcast(table), list(between)) if between else cells.crossJoin(F.broadcast(table))
    sums = F.array(*[F.col(f"_s{k}") for k in range(len(combos))])
    cells = cells.withColumn("_p", F.transform("_w", lambda w: F.aggregate(F.zip_with(w, sums, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)))
    total = reduce(Column.__add__, [F.col(f"_s{k}") for k in range(len(combos))])
    whole = cells.groupBy(*outside).agg(
        *[F.sum(F.get("_p", F.lit(k))).alias(f"_p{k}") for k in range(weights.shape[1])], *[F.sum(f"_q{k}").alias(f"_q{k}") for k in range(len(strata))], F.sum(total).alias("_t"), F.sum("_n").alias("_n")
    )
    ss, df, errors, first = {}, {}, {}, 0
    for t, x in columns.items():
        df[t] = x.shape[1]
        ss[t] = reduce(Column.__add__, [F.pow(F.col(f"_p{first + k}"), 2) for k in range(df[t])], F.lit(0.0))
        first += df[t]
    for t in strata:
        name = ":".join(("id", *t))
        own = [m for m in columns if tuple(f for f in m.split(":") if f in within) == t]
        alone = [(-1) ** (len(t) - len(u)) * F.col(f"_q{k}") for k, u in enumerate(strata) if set(u) <= set(t)]
        rest = reduce(Column.__add__, alone) - reduce(Column.__add__, [ss[m] for m in own], F.lit(0.0))
        df[name] = n_ids * int(np.prod([len(within[f]) - 1 for f in t])) - sum(df[m] for m in own)
        if not t:
            rest, df[name] = rest - F.pow("_t", 2) / (n_ids * len(combos)), df[name] - 1
        ss[name] = F.greatest(rest, F.lit(0.0))
        errors.update(dict.fromkeys(own, name))
    complete = F.col("_n") == n_ids * len(combos)
    return whole.select(*outside, *[F.when(complete, x).alias(t) for t, x in ss.items()]), errors, df


def in_sequence(products: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(column, weights of the columns up to it) of each column that is no combination of those before it, orthonormal under the cross-products."""
    out: list[tuple[int, np.ndarray]] = []
    for j in range(len(products)):
        v = np.eye(len(products))[j]
        for _ in range(2):
            for _, u in out:
                v = v - (u @ products @ v) * u
        length = v @ products @ v
        if length > 1e-10 * max(products[j, j], 1e-300):
            out.append((j, v / np.sqrt(length)))
    return out


def sums_by_products(cube: DimFrame, subjects: DataFrame, between: Sequence[str], covariates: Sequence[str], within: dict[str, Sequence], id_dim: str) -> tuple[DataFrame, dict[str, str], dict[str, int]]:
    """As ``sums_of_squares``, where some predictors between subjects are numbers, each with as many values as subjects.

    Contrasts within are orthogonal over every subject's cells, so the columns
    of a stratum differ only in their part between. Its cross-products are summed
    over subjects once, those with the data for each combination of the other
    dimensions; the columns are cleared of the ones before them on the few sums.
    """
    outside, v, col = cube.others(id_dim, *within), F.col(cube.value), F.col
    rows = cube.df.select(id_dim).distinct().join(subjects, id_dim)
    factors = [b for b in between if b not in covariates]
    codes: dict[str, list[Column]] = {}
    for f in factors:
        levels = sorted(r[0] for r in rows.select(f).distinct().collect())  # as many as levels
        table = helmert(len(levels))
        codes[f] = [reduce(Column.__add__, [F.when(col(f) == F.lit(x), F.lit(float(table[k, j]))).otherwise(0.0) for k, x in enumerate(levels)]) for j in range(len(levels) - 1)]
    seen = rows.agg(F.count(F.lit(1)).alias("n"), *[f(col(c).cast("double")).alias(f"{n}_{c}") for c in covariates for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    for c in covariates:
        codes[c] = [(col(c).cast("double") - F.lit(seen[f"m_{c}"])) / F.lit(seen[f"s_{c}"] or 1.0)]
    parts: list[tuple[tuple[str, ...], Column]] = [((), F.lit(1.0))]
    for t in _terms(list(between)):
        parts += [(t, reduce(Column.__mul__, x)) for x in product(*[codes[b] for b in t])]
    size = range(len(parts))
    named = rows.select(*[p.alias(f"b{k}") for k, (_, p) in enumerate(parts)])
    sums = named.agg(*[F.sum(col(f"b{i}") * col(f"b{j}")).alias(f"g{i}_{j}") for i in size for j in size if j <= i]).first()
    kept = in_sequence(np.array([[sums[f"g{max(i, j)}_{min(i, j)}"] or 0.0 for j in size] for i in size]))

    combos = list(product(*within.values()))
    is_combo = lambda c: reduce(lambda a, b: a & b, [col(n) == F.lit(x) for n, x in zip(within, c, strict=True)], F.lit(True))
    wide = cube.df.join(subjects, id_dim).groupBy(*outside, id_dim, *between).agg(*[F.max(F.when(is_combo(c), v)).alias(f"_v{k}") for k, c in enumerate(combos)])
    strata, contrasts = [(), *_terms(list(within))], {}
    for t in strata:
        part = np.ones((1, 1))
        for f, levels in within.items():
            h = helmert(len(levels))
            part = np.kron(part, h / np.linalg.norm(h, axis=0) if f in t else np.full((len(levels), 1), len(levels) ** -0.5))
        contrasts[t] = [reduce(Column.__add__, [float(w) * col(f"_v{k}") for k, w in enumerate(x)]) for x in part.T]
    names = {(t, k): f"_c{a}_{k}" for a, t in enumerate(strata) for k in range(len(contrasts[t]))}
    wide = wide.select(*outside, *[p.alias(f"_b{k}") for k, (_, p) in enumerate(parts)], *[contrasts[t][k].alias(n) for (t, k), n in names.items()])
    whole = wide.groupBy(*outside).agg(
        *[F.sum(col(f"_b{j}") * col(n)).alias(f"_s{j}{n}") for j in size for n in names.values()],
        *[F.sum(reduce(Column.__add__, [F.pow(col(names[t, k]), 2) for k in range(len(contrasts[t]))])).alias(f"_q{a}") for a, t in enumerate(strata)],
        F.sum(reduce(lambda a, b: a & b, [col(n).isNotNull() for n in names.values()]).cast("long")).alias("_n"),
    )
    squared = lambda w, n: F.pow(reduce(Column.__add__, [float(x) * col(f"_s{j}{n}") for j, x in enumerate(w) if x]), 2)
    ss, df, errors = {}, {}, {}
    order = [(b, t) for size_ in range(len(between) + len(within) + 1) for b in dict.fromkeys(p for p, _ in parts) for t in strata if len(b) + len(t) == size_ and (b or t)]
    for b, t in order:
        own, ns = [w for j, w in kept if parts[j][0] == b], [names[t, k] for k in range(len(contrasts[t]))]
        term = ":".join((*b, *t))
        df[term], errors[term] = len(own) * len(ns), ":".join(("id", *t))
        ss[term] = reduce(Column.__add__, [squared(w, n) for w in own for n in ns], F.lit(0.0))
    for a, t in enumerate(strata):
        name = ":".join(("id", *t))
        own = [m for m, e in errors.items() if e == name]
        rest = col(f"_q{a}") - reduce(Column.__add__, [ss[m] for m in own], F.lit(0.0))
        df[name] = seen["n"] * len(contrasts[t]) - sum(df[m] for m in own)
        if not t:
            rest, df[name] = rest - squared(kept[0][1], names[(), 0]), df[name] - 1
        ss[name] = F.greatest(rest, F.lit(0.0))
    complete = col("_n") == seen["n"]
    return whole.select(*outside, *[F.when(complete, x).alias(t) for t, x in ss.items()]), errors, df


def anova(
    cube: DimFrame, subjects: DataFrame | None, between: Sequence[str] = (), within: Sequence[str] = (), id_dim: str = "id", with_p: bool = True, observed: Sequence[str] = (), covariates: Sequence[str] = ()
) -> DataFrame:
    """modelterm, stat (F), df1, df2, es (generalised eta squared) and p for each combination of the other dimensions.

    ``subjects`` gives each id's levels between (joined on the id, whatever the
    order of rows; ids without levels are left out). A combination in which any
    cell of the design is missing or null has nulls. Generalised eta squared is
    SS / (SS + all error terms), plus terms of ``observed`` factors but the own.
    ``covariates``, columns of ``subjects``, are predictors between subjects that
    are numbers, not factors; they come after the factors unless ``between``
    names them, too. Sums of squares are sequential.
    """
    between = [*between, *[c for c in covariates if c not in between]]
    if not between and not within:
        raise ValueError("name factors between or within subjects, or covariates")
    levels = {w: list(cube.dim(w).levels or sorted(r[0] for r in cube.df.select(w).distinct().collect())) for w in within}
    known = subjects.select(id_dim, *between).dropna().dropDuplicates([id_dim]) if between else None
    ss, errors, df = sums_by_products(cube, known, between, covariates, levels, id_dim) if covariates else sums_of_squares(cube, known, between, levels, id_dim)
    col = lambda t: F.col(f"`{t}`")
    all_errors = reduce(Column.__add__, [col(e) for e in df if e.split(":")[0] == "id" and df[e] > 0], F.lit(0.0))
    cells = []
    for t, e in errors.items():
        seen = lambda m: bool(set(m.split(":")) & set(observed))
        more = reduce(Column.__add__, [col(o) for o in errors if o != t and seen(o)], F.lit(0.0))
        stat = (col(t) / F.nullif(F.lit(df[t]), F.lit(0))) / F.nullif(col(e) / F.nullif(F.lit(df[e]), F.lit(0)), F.lit(0.0))
        cells.append(F.struct(F.lit(t).alias("modelterm"), stat.alias("stat"), F.lit(float(df[t])).alias("df1"), F.lit(float(df[e])).alias("df2"), (col(t) / F.nullif(all_errors + col(t) + more, F.lit(0.0))).alias("es")))
    out = ss.select(*cube.others(id_dim, *within), F.inline(F.array(*cells)))
    return out.withColumn("p", f_p_col(F.col("stat"), F.col("df1"), F.col("df2"))) if with_p else out
