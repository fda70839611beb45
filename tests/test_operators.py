"""Literal cases and properties of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dimframe.core import densified, decorated, from_long, from_values, packed, unpacked
from dimframe.functions import dist, geometry
from dimframe.functions import predicates as pr
from dimframe.operators.clusters import tfce
from dimframe.operators import aggregate, align, anova, artifacts, contrasts, convert, inference, permutation, permuted, sequence, shape, ttest


def line(spark, values):
    rows = [(k + 1, None if v is None else float(v)) for k, v in enumerate(values)]
    return from_long(spark.createDataFrame(rows, "place int, value double"), ["place"])


def along(cube):
    return [r["value"] for r in cube.df.orderBy("place").collect()]


SERIES = [10, 7, -1, 6, 2, -1, 5, 4, 3]


@pytest.mark.parametrize(
    ("values", "options", "want"),
    [
        (SERIES, {}, [0, 0, 1, 2, 0, 1, 2, 0, 0]),
        (SERIES, {"n": 2}, [0, 0, 1, 0, 0, 1, 2, 0, 0]),
        (SERIES, {"top": 1}, [0, 0, 1, 2, 0, 1, 0, 0, 0]),
        (SERIES, {"global_": True}, [0, 0, 1, 0, 0, 1, 0, 0, 0]),
        (SERIES, {"n": 9}, [0, 0, 1, 0, 0, 1, 0, 0, 0]),
        ([10, 10, 7, -1, 6, 2, -1, None, 4, 3], {}, [2, 2, 0, 1, 2, 0, None, None, None, 0]),
        ([10, 10, 7, -1, 6, 2, -1, None, 4, 3], {"tail": "never"}, [0, 0, 0, 1, 2, 0, None, None, None, 0]),
        ([10] * 8, {}, [3] * 8),
        ([10] * 8, {"constant": 0}, [0] * 8),
        ([None] + [10] * 8, {"constant": 0}, [None, None] + [0] * 7),
        ([10] * 8 + [None], {"constant": 0}, [0] * 7 + [None, None]),
    ],
)
def test_extrema(spark, values, options, want):
    assert along(sequence.extrema(line(spark, values), "place", **options)) == want


def hits(spark, values, predicate):
    rows = [(k, v) for k, v in enumerate(values)]
    cube = from_long(spark.createDataFrame(rows, ["place", "value"]), ["place"])
    return [r["hit"] for r in pr.marked(cube, predicate).orderBy("place").collect()]


def test_predicates(spark):
    assert hits(spark, ["a", "A", "ba"], pr.is_pattern("^a", ignore_case=True)) == [True, True, False]
    assert hits(spark, ["0", "0.000001", "1"], pr.is_equal(0, 1e-4)) == [True, True, False]
    assert hits(spark, ["a", "A"], ~pr.is_same("A")) == [True, False]
    assert hits(spark, [-1.0, 1.0, 101.0], pr.is_between(100, 0)) == [False, True, False]
    assert hits(spark, [1.0], ~pr.is_equal(0)) == [True]
    assert hits(spark, [0.0, 1.0], pr.is_between(0, 1, "both")) == [False, False]
    assert hits(spark, [-1.0, 0.0, 1.0], pr.is_positive()) == [False, False, True]
    assert hits(spark, [-1.0, 0.0, 1.0], ~pr.is_positive()) == [True, True, False]
    assert hits(spark, [None, 1.0], pr.is_between(0, 5)) == [False, True]
    assert hits(spark, ["x", "y"], pr.is_pattern("*")) == [True, True]


def test_optional_predicates(spark):
    some = pr.is_between(1, 100)
    rare = pr.is_between(500, 600).options(strict=False)
    assert hits(spark, [0.0, 5.0], some & rare) == [False, True]
    assert hits(spark, [0.0, 5.0, 550.0], pr.is_positive() & rare) == [False, False, True]
    assert hits(spark, [0.0, 5.0], rare & rare) == [False, False]


def test_slice_and_expand(spark):
    cube = from_values(spark, [1.001, 1.6, 1.2, 1.003, 1.01, 1.0, 4.0, 3.5], {"observation": ["a", "b"], "measure": ["width", "height"], "time": ["pre", "post"]})
    got = pr.marked(cube, pr.is_equal(1, 0.1).options(subset={"time": "pre"}, expand={"measure": "width"}))
    assert {(r["observation"], r["measure"], r["time"]) for r in got.where("hit").collect()} == {("a", "width", "pre"), ("a", "height", "pre")}


def test_replace_and_convert(spark):
    df = spark.createDataFrame([(None,), ("a",), ("a",), ("z",), ("e",), ("q",)], "x string")
    got = [r[0] for r in df.select(shape.replaced("x", {"w": "ww", "a": "aa", "e": "ee"})).collect()]
    assert got == [None, "aa", "aa", "z", "ee", "q"]
    df = spark.createDataFrame([("1.12", "7", "TRUE", "2024-01-31", "b", "1.0"), ("3.4", "8", "FALSE", "2023-01-01", "a", "2")], ["d", "i", "b", "t", "s", "r"])
    assert dict(convert.auto_convert(df).dtypes) == {"d": "double", "i": "int", "b": "boolean", "t": "date", "s": "string", "r": "string"}


def test_shape(spark):
    assert decorated([None, "", "a", "a"]) == ["_Dim1", "_Dim2", "a", "a__"]
    cube = from_values(spark, [1.0, 2.0, 3.0, 4.0], {"a": ["x", "y"], "b": ["u", "v"]})
    assert shape.permuted(cube, "b").names == ["b", "a"]
    assert shape.merge_dims(cube, ["a", "b"], "c").dims[0].levels == ("x.u", "y.u", "x.v", "y.v")
    back = unpacked(packed(cube, "b"), ["a"], "b", ["u", "v"])
    assert sorted(map(tuple, back.long().collect())) == sorted(map(tuple, cube.long().collect()))
    lost = cube.but(cube.df.where("not (a = 'x' and b = 'u')"))
    assert densified(lost).df.where("value is null").count() == 1
    with pytest.raises(Exception, match="same cell"):
        shape.merge_cubes([cube, cube]).df.collect()
    table = spark.createDataFrame([("x", 1, "p"), ("y", 1, "q")], "a string, a1 int, a2 string")
    assert shape.dim_to_multidim(cube, "a", table).names == ["a1", "a2", "b"]


def test_scaling_and_identities(spark):
    rng = np.random.default_rng(1)
    cube = from_values(spark, rng.normal(size=24).tolist(), {"chan": ["a", "b", "c"], "time": list(range(8))})
    z = sequence.scaled(cube, ["chan"]).df.groupBy("chan").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).collect()
    assert all(abs(r["m"]) < 1e-12 and abs(r["s"] - 1) < 1e-12 for r in z)
    one = ttest.ttest_paired(cube, cube.but(cube.df.withColumn("value", F.lit(0.5))), id_dim="time").collect()
    two = ttest.ttest_one(cube, 0.5, "time").collect()
    assert {r["chan"]: round(r["stat"], 9) for r in one} == {r["chan"]: round(r["stat"], 9) for r in two}
    runs = sequence.inverse_rle(sequence.rle(cube, "time"), ["chan"])
    assert runs.count() == 24


def test_distributions():
    f = np.array([0.1, 1.0, 2.5, 30.0])
    assert np.allclose(dist.f_p(f, 2, 17), (1 + 2 * f / 17) ** (-17 / 2), rtol=1e-12)
    t = np.array([-3.0, 0.0, 0.4, 12.0])
    assert np.allclose(dist.t_p(t, 1), 1 - 2 / np.pi * np.arctan(np.abs(t)), rtol=1e-10)
    assert np.allclose(dist.t_p(t, 2), 1 - np.abs(t) / np.sqrt(2 + t * t), rtol=1e-10)
    assert np.allclose(dist.f_p(t[2:] ** 2, 1, 9), dist.t_p(t[2:], 9), rtol=1e-10)


def test_permutations():
    with pytest.raises(ValueError):
        ttest.random_groups([1] * 4 + [2] * 4, 1000)
    rows = ttest.random_groups([1] * 20 + [2] * 20, 2000, 1)
    assert len({r.tobytes() for r in rows}) == 2000 and (rows == 1).sum(1).tolist() == [20] * 2000
    with pytest.raises(ValueError):
        ttest.random_signs(8, 10_000)
    assert len({r.tobytes() for r in ttest.random_signs(10, 500, 1)}) == 500


def test_tfce_by_definition():
    rng = np.random.default_rng(2)
    x, near = rng.normal(size=(4, 6)), np.eye(4, dtype=bool) | np.eye(4, k=1, dtype=bool) | np.eye(4, k=-1, dtype=bool)
    want, step = np.zeros_like(x), np.abs(x).max() / 50
    for sign in (1, -1):
        for s in range(50):
            level, left = step / 2 + s * step, {tuple(c) for c in np.argwhere(sign * x >= step / 2 + s * step)}
            while left:
                todo, cluster = [left.pop()], []
                while todo:
                    c, t = todo.pop()
                    cluster.append((c, t))
                    for o in [(a, b) for a, b in left if near[c, a] and abs(b - t) <= 1]:
                        left.remove(o)
                        todo.append(o)
                for c in cluster:
                    want[c] += sign * len(cluster) ** 0.66 * level**2 * step
    assert np.allclose(tfce(x, near), want)
    assert not tfce(np.zeros((2, 3)), near[:2, :2]).any()


def test_anova_is_the_squared_t(spark):
    rng = np.random.default_rng(3)
    cube = from_values(spark, rng.normal(size=40).tolist(), {"id": list(range(10)), "cond": ["a", "b"], "chan": ["x", "y"]})
    f = anova.anova(cube, None, within=["cond"]).orderBy("chan").collect()
    first, second = (shape.subset(cube, drop=True, cond=c) for c in "ab")
    t = ttest.ttest_paired(first, second).orderBy("chan").collect()
    assert np.allclose([r["stat"] for r in f], [r["stat"] ** 2 for r in t]) and np.allclose([r["p"] for r in f], [r["p"] for r in t])


def test_geometry():
    x = np.array([(0, 0, 1), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0.6, 0.6, 0.53)], float)
    w = geometry.spline_weights(x, np.arange(5), np.array([5]))
    assert np.allclose(w.sum(), 1, atol=1e-6)
    near = geometry.nearest_channels({str(k): p for k, p in enumerate(x[:5])}, 1.5)
    assert "0" in near["1"] and all(k in v for k, v in near.items())


def registered(values, rounds=5):
    """Elastic registration in one place, as defined."""
    slopes = np.array([align._slope(v) for v in values])
    template = slopes[np.argmin(((slopes - slopes.mean(0)) ** 2).sum(1))]
    for _ in range(rounds):
        gammas = np.array([align.best_warp(template, s) for s in slopes])
        new = np.mean([align._slope(np.interp(g, np.linspace(0, 1, len(v)), v)) for g, v in zip(gammas, values, strict=True)], 0)
        if np.sum((new - template) ** 2) < 1e-6 * max(np.sum(template**2), 1e-12):
            break
        template = new
    return gammas


def test_align_and_warp(spark):
    cube = from_values(spark, [float(v) for v in range(10)], {"time": list(range(10))})
    same = spark.createDataFrame([(k, k / 9) for k in range(10)], "time int, gamma double")
    assert np.allclose([r["value"] for r in align.aligned(cube, same).df.orderBy("time").collect()], range(10))
    t = np.linspace(0, 1, 40)
    bump = lambda c: np.exp(-((t - c) ** 2) / 0.01)
    rows = [("x", c, k, float(v)) for c in (0.4, 0.5, 0.6) for k, v in enumerate(bump(c))] + [("y", c, k, float(v)) for c in (0.3, 0.35) for k, v in enumerate(bump(c))]
    bumps = from_long(spark.createDataFrame(rows, "part string, c double, time int, value double"), ["part", "c", "time"])
    made = {}
    for r in align.warped(bumps, "c").df.orderBy("time").collect():
        made.setdefault((r["part"], r["c"]), []).append(r["gamma"])
    for part, centres in (("x", (0.4, 0.5, 0.6)), ("y", (0.3, 0.35))):
        assert np.allclose([made[part, c] for c in centres], registered(np.array([bump(c) for c in centres])))
    alone = align.warped(bumps.but(bumps.df.where("part = 'x'").drop("part"), bumps.drop_dims("part")), "c", median=True).df.count()
    assert alone == 120
    g = np.array([made["x", c] for c in (0.4, 0.5, 0.6)])
    assert np.all(np.diff(g, axis=1) >= -1e-12) and np.allclose(g[:, 0], 0) and np.allclose(g[:, -1], 1)
    peaks = [t[np.argmax(np.interp(gg, t, bump(c)))] for gg, c in zip(g, (0.4, 0.5, 0.6), strict=True)]
    assert np.ptp(peaks) < 0.1


def test_intervals(spark):
    markers = spark.createDataFrame([("c1", 5, "start"), ("c1", 9, "stop"), ("c1", 20, "start"), ("c2", 4, "stop")], "chan string, position long, kind string")
    found = artifacts.bad_intervals(markers, F.col("kind") == "start", F.col("kind") == "stop", "position", 30, ["chan"])
    assert sorted(map(tuple, found.collect())) == [("c1", 5, 9), ("c1", 20, 30), ("c2", 1, 4)]
    bad = spark.createDataFrame([("c", k, "start") for k in (1, 5, 9)] + [("c", 20, "stop")], "chan string, position long, kind string")
    with pytest.raises(Exception, match="do not match"):
        artifacts.bad_intervals(bad, F.col("kind") == "start", F.col("kind") == "stop", "position", 30, ["chan"]).collect()


def test_contrast_names():
    assert contrasts.contrast_name({"a": 0.5, "b": 0.5, "c": -1}) == "(0.5*a+0.5*b)-c"
    assert list(contrasts.pairwise(["a", "b", "c"])) == ["b-a", "c-a", "c-b"]


def test_bins_drop_the_tail(spark):
    cube = from_values(spark, [float(v) for v in range(7)], {"time": list(range(7))})
    assert sorted(map(tuple, aggregate.avg_bin(cube, "time", 3).long().collect())) == [(1.0, 1.0), (4.0, 4.0)]


def test_example_and_pipeline(spark):
    from dimframe.operators.results import anova_permuted
    from dimframe.plans.transform import global_field_power_table, transform
    from dimframe.sources.example import example_cube, example_subjects

    cube = example_cube(spark, channels=4, first=0, last=400, step=100, subjects=6)
    assert cube.df.count() == 3 * 3 * 4 * 5 * 6 and cube.df.where("value is null").count() == 0
    groups = {r["id"]: r["group"] for r in example_subjects(spark, 6).collect()}
    table = global_field_power_table(cube, groups=groups)
    assert table.count() == 2 * 3 * 3 * 5
    wide = transform(cube, average=["id", "time"], where={"chan": ["E01", "E02"]}, measures=("chan", ["E01", "E02"]))
    assert wide.columns == ["stimclass", "pairtype", "value.chan_E01", "value.chan_E02"] and wide.count() == 9
    small = shape.subset(cube, drop=True, pairtype="ident", time=100)
    out = anova_permuted(small, example_subjects(spark, 6), ["group"], ["stimclass"], n=9).collect()
    assert len(out) == 4 * 3 and all(0.1 <= r["p_corr"] <= 1 for r in out)


def test_signs_and_labels(spark):
    rng = np.random.default_rng(4)
    cube = from_values(spark, rng.normal(size=24).tolist(), {"id": list(range(8)), "chan": ["a", "b", "c"]})
    ones = inference.permuted_maxima(cube, np.ones((1, 8), int), list(range(8)), "one").first()["most"]
    assert ones == pytest.approx(max(abs(r["stat"]) for r in ttest.ttest_one(cube, with_p=False).collect()))
    rows = ttest.random_labels([1, 1, 2, 2, 3, 3], 89, 1)
    assert len({r.tobytes() for r in rows}) == 89
    with pytest.raises(ValueError):
        ttest.random_labels([1, 1, 2, 2, 3, 3], 90, 1)
    time = from_values(spark, rng.normal(size=6 * 3 * 2).tolist(), {"id": list(range(6)), "chan": ["a", "b", "c"], "time": [0, 1]})
    groups = spark.createDataFrame([(i, i % 3) for i in range(6)], "id long, g int")
    out = permutation.tanova(time, groups, 20, ["g"]).collect()
    assert len(out) == 2 and all(1 / 21 <= r["p"] <= 1 for r in out)


def test_chunks_by_codes(spark):
    cube = from_values(spark, [1.0, 2.0, 5.0, 9.0], {"a": ["w", "x", "y", "z"]})
    out = shape.chunked(cube, "a", {"w": 1, "x": 1, "y": 2}, lambda c: sequence.scaled(c, ["chunk"], scale=False))
    assert out.names == ["a"]
    assert {r["a"]: r["value"] for r in out.long().collect()} == {"w": -0.5, "x": 0.5, "y": 0.0}


def test_tests_with_clusters_and_permutations(spark):
    rng = np.random.default_rng(8)
    chans, times, ids = ["a", "b", "c"], [1, 2, 3, 4], list(range(9))
    y = rng.normal(size=(9, 4, 3))
    y[:4, 1:3] += 2
    y[2, 0, 0] = np.nan
    cube = from_values(spark, [None if np.isnan(v) else float(v) for v in y.ravel()], {"chan": chans, "time": times, "id": ids})
    near = {"a": ["b"], "b": ["a", "c"], "c": ["b"]}
    links = np.eye(3, dtype=bool) | np.eye(3, k=1, dtype=bool) | np.eye(3, k=-1, dtype=bool)

    def planes(labels, kind):
        out = np.zeros((3, 4))
        for c in range(3):
            for t in range(4):
                v = y[:, t, c]
                ok = ~np.isnan(v)
                if kind == "one":
                    x = (v * labels)[ok]
                    out[c, t] = x.mean() / x.std(ddof=1) * len(x) ** 0.5
                else:
                    a, b = v[ok & (labels == 1)], v[ok & (labels == 2)]
                    out[c, t] = (a.mean() - b.mean()) / (a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b)) ** 0.5
        return out

    groups = {i: "x" if i < 4 else "y" for i in ids}
    observed = np.array([1] * 4 + [2] * 5)
    cases = (("welch", groups, observed, ttest.random_groups(observed.tolist(), 30, 1)), ("one", None, np.ones(9), ttest.random_signs(9, 30, 1)))
    for kind, given, labels, relabelled in cases:
        got = inference.ttest_tfce(cube, near, 30, given).collect()
        most = [np.abs(tfce(planes(row, kind), links)).max() for row in relabelled]
        stat = planes(labels, kind)
        clusters = tfce(stat, links)
        assert len(got) == 12
        for r in got:
            at = chans.index(r["chan"]), r["time"] - 1
            assert np.isclose(r["stat"], stat[at]) and np.isclose(r["tfce"], clusters[at])
            assert np.isclose(r["p_corr"], (1 + sum(m > abs(clusters[at]) for m in most)) / 31)
    with pytest.raises(ValueError):
        inference.ttest_tfce(cube, near, 5, {i: i % 3 for i in ids})
    # nothing varies, or too few values: no statistic
    assert np.isnan(inference.t_values(np.array([[1.0, 1, 1, 1], [1, 2, 3, np.nan]]), np.array([[1, 1, 2, 2]]))).all()


def test_anova_with_clusters(spark):
    rng = np.random.default_rng(9)
    cube = from_values(spark, rng.normal(size=72).tolist(), {"chan": ["a", "b"], "time": [1, 2, 3], "id": list(range(6)), "cond": ["p", "q"]})
    near, links = {"a": ["b"], "b": ["a"]}, np.ones((2, 2), bool)

    def enhanced(rows):
        plane = np.zeros((2, 3))
        for r in rows:
            plane["ab".index(r["chan"]), r["time"] - 1] = r["stat"]
        return tfce(plane, links, 0.66, 1.0)

    got = inference.anova_tfce(cube, None, near, 9, within=["cond"]).collect()
    clusters = enhanced(got)
    design = permuted.design_of(cube, None, within=["cond"])
    blocks = permuted.permuted_f(cube, design, permuted.Shuffles(design, 9, 1))
    shuffled = permuted.each_shuffle(blocks, ["chan", "time", "modelterm"]).collect()
    most = [enhanced([r for r in shuffled if r["perm"] == p]).max() for p in range(9)]
    for r in got:
        at = "ab".index(r["chan"]), r["time"] - 1
        assert np.isclose(r["tfce"], clusters[at]) and np.isclose(r["p_corr"], (1 + sum(m > clusters[at] for m in most)) / 10)
