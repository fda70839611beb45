"""Permutation by matrix products, covariates and the component tree, against definitions."""

import time
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dimframe.core import Dim, from_long
from dimframe.operators import aggregate, anova, clusters, permutation, permuted, results
from dimframe.plans import catalog


@pytest.fixture(scope="module")
def cube(spark):
    rng = np.random.default_rng(1)
    rows = [(c, t, i, w, u, float(rng.normal() + i % 3 * 0.3 + w * 0.2)) for c in range(3) for t in range(2) for i in range(11) for w in range(3) for u in range(2)]
    return from_long(spark.createDataFrame(rows, "chan int, time int, id int, w int, u int, value double"), ["chan", "time", "id", "w", "u"])


@pytest.fixture(scope="module")
def subjects(spark):
    rng = np.random.default_rng(2)
    return spark.createDataFrame([(i, "abc"[i % 3], float(rng.normal() * 3 + 10), i % 2) for i in range(11)], "id int, g string, age double, h int")


def brute_f(y, ids, combos, between, within, codes):
    """Sequential sums of squares by least squares over all columns, error terms by id dummies."""

    def dummies(v):
        known = sorted(set(v))
        return np.array([[float(x == k) for k in known[:-1]] for x in v])

    n = len(ids) * len(combos)
    col = {b: np.repeat(codes[b], len(combos), 0) if np.ndim(codes[b]) == 2 else np.repeat(dummies(codes[b]), len(combos), 0) for b in between}
    col |= {w: np.tile(dummies([c[k] for c in combos]), (len(ids), 1)) for k, w in enumerate(within)}

    def times(*xs):
        out = np.ones((n, 1))
        for x in xs:
            out = (out[:, :, None] * x[:, None, :]).reshape(n, -1)
        return out

    def rss(x):
        return ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum(), np.linalg.matrix_rank(x)

    x, ss, df = np.ones((n, 1)), {}, {}
    before = rss(x)
    for size in range(1, len(between) + len(within) + 1):
        for t in combinations([*between, *within], size):
            x = np.hstack((x, times(*[col[f] for f in t])))
            now = rss(x)
            ss[":".join(t)], df[":".join(t)] = before[0] - now[0], now[1] - before[1]
            before = now
    who = np.repeat(np.eye(len(ids)), len(combos), 0)
    error = {}
    for size in range(len(within) + 1):
        for t in combinations(within, size):
            x = np.hstack((x, times(who, *[col[f] for f in t])))
            now = rss(x)
            error[t] = before[0] - now[0], now[1] - before[1]
            before = now
    return {t: (ss[t] / df[t]) / (error[e][0] / error[e][1]) for t in ss for e in [tuple(f for f in t.split(":") if f in within)]}


@pytest.mark.parametrize("between, covariates, within", [(["g"], [], ["w", "u"]), (["g"], ["age"], ["w"]), ([], ["age"], []), (["g", "h"], [], []), (["age", "g"], ["age"], ["u"]), ([], [], ["w", "u"])])
def test_designs(cube, subjects, between, covariates, within):
    """The engine, the distributed ANOVA and least squares agree."""
    c = aggregate.avg_dims(cube, *[x for x in ("w", "u") if x not in within])
    d = permuted.design_of(c, subjects, between, within, covariates)
    y = np.full((6, d.size), np.nan)
    for r in c.df.collect():
        y[r["chan"] * 2 + r["time"], d.ids.index(r["id"]) * len(d.combos) + d.combos.index(tuple(r[x] for x in within))] = r["value"]
    f = permuted.f_values(y, d)[:, :, 0]
    rows = {r["id"]: r for r in subjects.collect()}
    codes = {b: np.array([[rows[i][b]] for i in d.ids]) if b in covariates else [rows[i][b] for i in d.ids] for b in dict.fromkeys([*between, *covariates])}
    got = anova.anova(c, subjects, between, within, covariates=covariates).collect()
    assert len(got) == f.size
    want = [brute_f(v, d.ids, d.combos, list(codes), within, codes) for v in y]
    for r in got:
        k, cell = list(d.columns).index(r["modelterm"]), r["chan"] * 2 + r["time"]
        assert np.isclose(f[k, cell], want[cell][r["modelterm"]]) and np.isclose(r["stat"], f[k, cell])
        assert (r["df1"], r["df2"]) == (d.df[r["modelterm"]], d.df[d.errors[r["modelterm"]]]) and 0 <= r["p"] <= 1


def test_constant_covariate(spark, cube):
    """A predictor that says nothing has no degrees of freedom, and no statistic."""
    same = spark.createDataFrame([(i, 2.0) for i in range(11)], "id int, x double")
    out = anova.anova(aggregate.avg_dims(cube, "w", "u"), same, covariates=["x"], with_p=False).collect()
    assert all(r["stat"] is None and r["df1"] == 0 for r in out)


def test_shuffles(cube, subjects):
    d = permuted.design_of(cube, subjects, ["g"], ["w", "u"])
    some = permuted.Shuffles(d, 20, 5)
    for p in range(20):
        order = some.order(p)
        assert sorted(order) == list(range(d.size)) and (order == permuted.Shuffles(d, 99, 5).order(p)).all()
        assert all(len(set(x // 6)) == 1 for x in order.reshape(11, 6))  # an id stays together
    assert (some.order(0) != some.order(1)).any() and (some.order(0) != permuted.Shuffles(d, 1, 6).order(0)).any()
    with pytest.raises(ValueError):
        permuted.Given(d, np.zeros((1, d.size)))
    with pytest.raises(ValueError):
        permuted.permuted_f(cube, d, some, "both")
    with pytest.raises(ValueError):
        permuted.design_of(cube, subjects)


def test_limits(cube, subjects, monkeypatch):
    monkeypatch.setattr(permuted, "BROADCAST_BYTES", 500)
    with pytest.raises(ValueError, match="more than may be broadcast"):
        permuted.design_of(cube, subjects, ["g"], ["w", "u"])


@pytest.mark.parametrize("what", ["residuals", "observations"])
def test_blocks_and_maxima(cube, subjects, monkeypatch, what):
    monkeypatch.setattr(permuted, "BLOCK", 4)
    monkeypatch.setattr(permuted, "AT_ONCE", 1)
    c = aggregate.avg_dims(cube, "u")
    d = permuted.design_of(c, subjects, ["g"], ["w"])
    some = permuted.Shuffles(d, 11, 3)
    rows = permuted.each_shuffle(permuted.permuted_f(c, d, some, what), ["chan", "time", "modelterm"])
    assert rows.count() == 6 * 3 * 11
    y = np.zeros((6, d.size))
    for r in c.df.collect():
        y[r["chan"] * 2 + r["time"], d.ids.index(r["id"]) * 3 + r["w"]] = r["value"]
    if what == "residuals":
        cells = {}
        for k, i in enumerate(d.ids):
            cells.setdefault(i % 3, []).append(k)
        for members in cells.values():
            for w in range(3):
                at = [k * 3 + w for k in members]
                y[:, at] -= y[:, at].mean(1, keepdims=True)
    for r in rows.where("perm = 7").collect():
        order = some.order(7)
        now = y[:, order] if what == "residuals" else y[:, np.argsort(order)]
        f = permuted.f_values(now, d)[list(d.columns).index(r["modelterm"]), r["chan"] * 2 + r["time"], 0]
        assert np.isclose(r["stat"], f)
    for by in ([], ["chan"]):
        keys = [*by, "modelterm"]
        got = {tuple(r[k] for k in [*keys, "perm"]): r["most"] for r in permuted.largest(permuted.permuted_f(c, d, some, what, by=by), keys).collect()}
        want = {tuple(r[k] for k in [*keys, "perm"]): r["most"] for r in rows.groupBy(*keys, "perm").agg(F.max("stat").alias("most")).collect()}
        assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)
    out = results.anova_permuted(c, subjects, ["g"], ["w"], n=11, seed=3, what=what, by=["chan"])
    most = {(r["chan"], r["modelterm"], r["perm"]): r["most"] for r in rows.groupBy("chan", "modelterm", "perm").agg(F.max("stat").alias("most")).collect()}
    for r in out.collect():
        assert np.isclose(r["p_corr"], (1 + sum(m > r["stat"] for (ch, t, _), m in most.items() if (ch, t) == (r["chan"], r["modelterm"]))) / 12)


def brute_draw(y, place, who, w, g):
    """F of g, w and g:w for rows of a draw, by least squares; what differs within a place counts in the innermost error."""

    def dummies(*v):
        rows = list(zip(*v, strict=True))
        return np.array([[float(r == k) for k in sorted(set(rows))] for r in rows])

    def rss(*xs):
        x = np.hstack((np.ones((len(y), 1)), *xs))
        return ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()

    steps = [[], [dummies(g)], [dummies(g), dummies(w)], [dummies(g, w)], [dummies(g, w), dummies(who)]]
    none, a, b, c, left = (rss(*x) for x in steps)
    n = len(set(who))
    return {"g": (none - a) / 2 / ((c - left) / (n - 3)), "w": (a - b) / 2 / (left / (2 * (n - 3))), "g:w": (b - c) / 4 / (left / (2 * (n - 3)))}


def test_draws(cube, subjects):
    """Orders that draw some ids repeatedly and leave others out, against least squares over the rows drawn."""
    c = aggregate.avg_dims(cube, "u", "time")
    d = permuted.design_of(c, subjects, ["g"], ["w"])
    to = np.array([0, 4, 2, 0, 7, 7, 7, 10, -1, 3, 8])
    turned = [np.roll(range(3), k) for k in range(11)]
    order = np.concatenate([np.full(3, -1) if t < 0 else t * 3 + r for t, r in zip(to, turned, strict=True)])
    given, y = permuted.Given(d, order[None]), np.zeros((3, d.size))
    for r in c.df.collect():
        y[r["chan"], d.ids.index(r["id"]) * 3 + r["w"]] = r["value"]
    kept = order >= 0
    for what in ("residuals", "observations"):
        rows, place = (permuted.residuals(y, d.basis)[:, order[kept]], np.flatnonzero(kept)) if what == "residuals" else (y[:, kept], order[kept])
        got = {(r["chan"], r["modelterm"]): r["stat"] for r in permuted.each_shuffle(permuted.permuted_f(c, d, given, what), ["chan", "modelterm"]).collect()}
        for k in range(3):
            want = brute_draw(rows[k], place, place // 3, place % 3, place // 3 % 3)
            assert all(np.isclose(got[k, t], f) for t, f in want.items()) and len(want) == 3
    with pytest.raises(ValueError):
        permuted.Given(d, np.where(np.arange(d.size) == 4, -1, np.arange(d.size))[None])  # a part of an id
    with pytest.raises(ValueError):
        permuted.Given(d, np.full((1, d.size), d.size))
    with pytest.raises(ValueError):
        permuted.permuted_f(c, d, permuted.Given(d, order[None], d), "residuals")


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Copies of the smallest tables: three in a row, whose 30 suppliers share a divisor with some factors, and three with gaps between their keys."""
    out = {}
    for name, shift in (("row", 10), ("gaps", 1003)):
        out[name] = str(tmp_path_factory.mktemp(name))
        for t, k in (("supplier", "s_suppkey"), ("lineitem", "l_suppkey")):
            more = "" if t == "supplier" else ", l_quantity + c.range * (l_linenumber % 4) as l_quantity"
            duckdb.execute(f"copy (select * replace ({k} + {shift} * c.range as {k}{more}) from '/root/testdata/sf0.001/{t}.parquet', range(3) c) to '{out[name]}/{t}.parquet'")
    return out


@pytest.mark.parametrize("keys", ["row", "gaps"])
@pytest.mark.parametrize("name", ["anova_observations", "anova_permuted_fixed", "anova_residuals", "tanova_mixed", "tanova_within"])
def test_fixed_shuffles_of_more_suppliers(spark, copies, name, keys):
    con = duckdb.connect()
    for t in ("supplier", "lineitem"):
        con.execute(f"create view {t} as select * from '{copies[keys]}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, copies[keys])
    res = con.execute(catalog.ORACLES[name])
    names = [x[0] for x in res.description]
    assert sorted(map(repr, (tuple(r[c] for c in sorted(names)) for r in df.collect()))) == sorted(repr(tuple(v + 0.0 if isinstance(v, float) else v for _, v in sorted(zip(names, row, strict=True)))) for row in res.fetchall())


def test_missing_responses(cube, subjects):
    c = aggregate.avg_dims(cube, "u")
    gone = c.but(c.df.where("not (chan = 1 and time = 0 and id = 4 and w = 2)"))
    d = permuted.design_of(gone, subjects, ["g"], ["w"])
    out = permuted.each_shuffle(permuted.permuted_f(gone, d, permuted.Shuffles(d, 3)), ["chan", "time", "modelterm"]).collect()
    assert all((r["stat"] is None) == (r["chan"] == 1 and r["time"] == 0) for r in out)


@pytest.mark.parametrize("kind", ["both", "topography", "intensity"])
def test_maps_of_a_factor(cube, subjects, kind):
    """The observed effect of one factor is that of its levels' means."""
    c = aggregate.avg_dims(cube, "u", "w")
    even = c.but(c.df.where("id < 10"))  # groups of equal size
    d = permuted.design_of(even, subjects, ["h"])
    got = {r["time"]: r["effect"] for r in permuted.permuted_maps(even, d, None, kind=kind).df.collect()}
    grouped = even.but(even.df.join(subjects.select("id", "h"), "id"), [*even.dims, Dim("h")])
    want = {r["time"]: r["effect"] for r in permutation.tanova_effect(grouped, "h", kind=kind).collect()}
    assert set(got) == {0, 1} and all(np.isclose(got[t], want[t]) for t in want)


def test_tanova_of_a_mixed_design(cube, subjects):
    c = aggregate.avg_dims(cube, "u")
    out = permutation.tanova(c, subjects, 19, ["g"], ["w"], covariates=["age"], alphas=[0.05, 0.2]).collect()
    assert len(out) == 2 * 7 and all(0.05 <= r["p"] <= 1 and r["p_corr"] in (0.05, 0.2, 1.0) and r["effect"] > 0 for r in out)


def slow_tfce(plane, near, e, h, steps):
    out, top = np.zeros(plane.shape), np.nanmax(np.abs(plane))
    step = top / steps
    for s in range(steps):
        threshold = step / 2 + s * step
        for sign in (1, -1):
            todo = {tuple(x) for x in np.argwhere(sign * np.nan_to_num(plane) >= threshold)}
            while todo:
                group, ask = set(), [todo.pop()]
                while ask:
                    c, t = ask.pop()
                    group.add((c, t))
                    more = {(a, b) for a, b in todo if abs(b - t) <= 1 and (a == c or near[a, c] or near[c, a])}
                    todo -= more
                    ask += more
                for x in group:
                    out[x] += sign * len(group) ** e * threshold**h * step
    return out


def test_component_tree():
    rng = np.random.default_rng(3)
    for k in range(12):
        chans, times = rng.integers(1, 6), rng.integers(1, 8)
        near = rng.random((chans, chans)) < 0.3
        plane = rng.normal(size=(chans, times)).round(k % 3)  # with ties
        plane[rng.random(plane.shape) < 0.1] = np.nan
        if np.nanmax(np.abs(plane), initial=0) > 0:
            assert np.allclose(clusters.tfce(plane, near, 0.66, 2.0, 20), slow_tfce(plane, near, 0.66, 2.0, 20))
    assert not clusters.tfce(np.full((2, 2), np.nan), np.ones((2, 2), bool)).any()


def test_a_large_plane_takes_little_time():
    rng = np.random.default_rng(4)
    near = np.abs(np.subtract.outer(range(64), range(64))) <= 3
    plane = rng.normal(size=(64, 400)) + np.sin(np.arange(400) / 30)
    began = time.time()
    out = clusters.tfce(plane, near)
    assert time.time() - began < 5 and (np.sign(out) == np.sign(plane))[np.abs(plane) > 0.1].all()
