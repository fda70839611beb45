"""Windows of many widths, extrema as predicates, conversion rules, expansion and the sample source."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dimframe.core import from_long, from_values
from dimframe.functions import predicates as pr
from dimframe.operators import aggregate, convert, shape, windows
from dimframe.sources import brainvision as bv
from dimframe.sources.samples import SamplesReader


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.default_rng(1)
    rows = [(c, t, None if rng.random() < 0.2 else float(rng.normal()), int(rng.integers(0, 9))) for c in "ab" for t in range(25)] + [("none", t, None, 3) for t in range(4)]
    return spark.createDataFrame(rows, "chan string, time int, value double, w int")


FUNCTIONS = {
    "mean": np.mean, "sd": lambda x: np.std(x, ddof=1) if len(x) > 1 else np.nan, "min": np.min, "max": np.max, "median": np.median, "quantile": lambda x: np.quantile(x, 0.3),
    "mad": lambda x: 1.4826 * np.median(np.abs(x - np.median(x))),
}


@pytest.mark.parametrize("stat", FUNCTIONS)
@pytest.mark.parametrize("endrule", ["shrink", "NA"])
def test_widths(gappy, stat, endrule):
    cube = from_long(gappy, ["chan", "time"])
    got = {(r["chan"], r["time"]): r["value"] for r in windows.rolled_by(cube, "time", gappy.select("chan", "time", F.col("w").alias("width")), stat, 0.3, endrule).long().collect()}
    rows = gappy.orderBy("chan", "time").collect()
    assert len(got) == len(rows)
    for r in rows:
        x = [s["value"] for s in rows if s["chan"] == r["chan"]]
        a, z = r["time"] - r["w"] // 2, r["time"] + r["w"] - r["w"] // 2
        values = np.array([v for v in x[max(a, 0) : z] if v is not None])
        want = FUNCTIONS[stat](values) if len(values) and r["w"] and (endrule == "shrink" or (a >= 0 and z <= len(x))) else np.nan
        assert np.isnan(want) if got[r["chan"], r["time"]] is None else np.isclose(got[r["chan"], r["time"]], want)


def test_functions_of_windows(gappy, monkeypatch):
    monkeypatch.setattr(windows, "AT_ONCE", 7)
    cube = from_long(gappy.fillna({"value": 0.5}), ["chan", "time"])
    one = windows.rolled_by(cube, "time", F.lit(5), lambda w: w.mean(1)).long().collect()
    two = {(r["chan"], r["time"]): r["value"] for r in windows.rolled_by(cube, "time", 5).long().collect()}
    assert all(np.isclose(r["value"], two[r["chan"], r["time"]]) for r in one) and len(one) == 54
    with pytest.raises(Exception, match="as many numbers"):
        windows.rolled_by(cube, "time", 3, lambda w: w).long().collect()
    with pytest.raises(ValueError):
        windows.rolled_by(cube, "time", 3, "mode")
    with pytest.raises(ValueError):
        windows.rolled_by(cube, "time", 3, endrule="keep")


def test_extrema_combine(spark):
    cube = from_values(spark, [-1.0, 1.0, 0.0, 100.0, 50.0, 0.0, 3.0, 0.0], {"time": list(range(8))})
    hits = lambda p: [r["time"] for r in pr.marked(cube, p).orderBy("time").collect() if r["hit"]]
    assert hits(pr.is_local_maximum("time")) == [1, 3, 6]
    assert hits(pr.is_local_maximum("time") & pr.is_between(0, 10)) == [1, 6]
    assert hits(~pr.is_local_maximum("time") & pr.is_between(0, 10)) == [2, 5, 7]
    assert hits(pr.is_extremum("time", global_=True, tail="do_not_care")) == [0, 3]
    assert hits(pr.is_minimum("time") | pr.is_local_maximum("time").options(subset={"time": lambda t: t <= 2})) == [1]  # a value at an end is none
    assert hits(pr.is_local_minimum("time").options(negate=True, subset={"time": lambda t: t >= 4})) == [0, 1, 2, 3, 4, 6, 7]
    two = from_values(spark, [0.0, 5.0, 0.0, 1.0, 0.0, 1.0], {"time": [0, 1, 2], "chan": ["x", "y"]})
    rows = pr.marked(two, pr.is_local_maximum("time").options(expand={"chan": "x"})).collect()
    assert sorted((r["time"], r["chan"]) for r in rows if r["hit"]) == [(1, "x"), (1, "y")]


def test_places(spark):
    cube = from_values(spark, [float(v) for v in range(8)], {"a": ["w", "x", "y", "z"], "b": [1, 2]})
    kept = lambda c: sorted({r["a"] for r in c.long().collect()})
    assert kept(shape.subset_at(cube, a=[3, 1])) == ["w", "y"] and shape.subset_at(cube, a=[3, 1]).dim("a").levels == ("y", "w")
    assert kept(shape.subset_at(cube, a=[-1])) == ["x", "y", "z"] and kept(shape.subset_at(cube, a=[False, True])) == ["x", "z"]
    assert kept(shape.subset_at(cube, a=[False])) == [] and shape.subset_at(cube, drop=True, b=[2]).names == ["a"]
    for wrong in ([0], [5], [1, -1], [True, 1]):
        with pytest.raises(ValueError):
            shape.subset_at(cube, a=wrong)


def test_equal_to_a_cube(spark):
    cube = from_values(spark, [1.0, 2.0, 3.0, 4.0], {"a": ["x", "y"], "b": [1, 2]})
    hits = lambda p: sorted((r["a"], r["b"]) for r in pr.marked(cube, p).collect() if r["hit"])
    assert hits(pr.is_equal_to(cube)) == [("x", 1), ("x", 2), ("y", 1), ("y", 2)]
    some = from_values(spark, [1.0, 5.0], {"b": [1, 3]})
    assert hits(pr.is_equal_to(some)) == [("x", 1)] and len(hits(~pr.is_equal_to(some))) == 3 and hits(pr.is_equal_to(some) & pr.is_negative()) == []


def test_rules(spark):
    df = spark.createDataFrame([("yes", 1, 2.0, "x"), ("no", 0, 3.0, None), (None, None, None, None)], "a string, b int, c double, d string")
    yes_no = convert.Rule(lambda f: f.dataType.simpleString() == "string", {"int": lambda c: c.try_cast("int"), "boolean": lambda c: F.when(c == "yes", True).when(c == "no", False)}, lambda c, made: made.isNotNull())
    rules = {"yes": yes_no, "whole": convert.WHOLE, "number": convert.NUMBER}
    assert dict(convert.auto_convert(df, rules=rules).dtypes) == {"a": "boolean", "b": "boolean", "c": "int", "d": "string"}
    assert dict(convert.auto_convert(df, ["c"], rules).dtypes)["a"] == "string"
    found = {r["column"]: r.asDict() for r in convert.convertible(df, rules=rules).collect()}
    assert found["a"] == {"column": "a", "n_n": 2, "n_int": 0, "n_boolean": 2} and found["c"] == {"column": "c", "n_n": 2, "n_int": 2, "n_boolean": 0}
    assert convert.auto_convert(df.select("b")).dtypes == [("b", "int")] and convert.convertible(df.select("b")).count() == 0
    keep = {"keep": convert.Rule(lambda f: f.name == "b", {}, lambda c, made: made == c), **rules}
    assert dict(convert.auto_convert(df, rules=keep).dtypes)["b"] == "int"


def test_expansion(spark):
    small = from_values(spark, [1, 2], {"a": ["x", "y"]})
    target = from_values(spark, [0.0] * 6, {"a": ["x", "y", "z"], "b": [1, 2]})
    with pytest.raises(ValueError, match="lacks levels"):
        shape.expand_into(small, target)
    got = lambda cube: {(r["a"], r["b"]): r[cube.value] for r in cube.long().collect()}
    assert got(shape.expand_into(small, target, safe=False)) == {(a, b): v for a, v in zip("xyz", (1.0, 2.0, 1.0), strict=True) for b in (1, 2)}
    assert got(shape.expand_into(small, target, levels={"a": ["y", "y", "x"]})) == {(a, b): v for a, v in zip("xyz", (2.0, 2.0, 1.0), strict=True) for b in (1, 2)}
    one = from_values(spark, [7], {"a": ["w"]})
    whole = shape.expand_into(one, target, fill=False)
    assert set(got(whole).values()) == {7} and dict(whole.df.dtypes)["expanded"] == "bigint" and dict(shape.expand_into(one, target).df.dtypes)["expanded"] == "double"
    for wrong in ({"a": ["x"]}, {"q": ["x"]}):
        with pytest.raises(ValueError):
            shape.expand_into(small, target, levels=wrong)


def test_dropped_dimensions_have_one_level(spark):
    cube = from_values(spark, [1.0, 2.0], {"a": ["x", "y"], "b": [1]})
    assert shape.drop_dims(cube, "b").names == ["a"]
    with pytest.raises(ValueError, match="more than one level"):
        shape.drop_dims(cube, "a")


def test_means_in_sequence(spark):
    rng = np.random.default_rng(2)
    rows = [(a, b, None if k == 5 else float(rng.normal() + (a == "x") * 2)) for k, (a, b) in enumerate([("x", "p"), ("x", "q"), ("y", "p"), ("y", "q"), ("y", "q")] * 4)]
    cube = from_long(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a string, b string, value double"), ["k", "a", "b"])
    got = {(r["modelterm"], r["a"], r["b"]): (r["value"], r["freq"]) for r in aggregate.sequential_means(cube, ["a", "b"], no_icpt=True).collect()}
    known = [(a, b, v) for a, b, v in rows if v is not None]
    rest = np.array([v for _, _, v in known])
    rest = rest - rest.mean()
    for t in (("a",), ("b",), ("a", "b")):
        key = [tuple(x if n in t else None for n, x in zip("ab", r[:2], strict=True)) for r in known]
        means = {k: rest[[q == k for q in key]].mean() for k in set(key)}
        for k, m in means.items():
            assert np.isclose(got[(":".join(t), *k)][0], m) and got[(":".join(t), *k)][1] == key.count(k)
        rest = rest - np.array([means[k] for k in key])
    assert {r["modelterm"] for r in aggregate.sequential_means(cube, ["a", "b"], terms=["a:b"]).collect()} == {"a:b"}


@pytest.fixture
def files(tmp_path):
    rng, out, data = np.random.default_rng(3), {}, {}
    for i, (layout, hz) in {"s 1": ("VECTORIZED", 2000), "s+2": ("MULTIPLEXED", 4000)}.items():
        x = rng.integers(-9999, 9999, (2, 50)).astype("<i4")
        base = tmp_path / i
        base.mkdir()
        (base / "r.dat").write_bytes((x if layout == "VECTORIZED" else x.T).tobytes())
        (base / "r.vhdr").write_text(f"DataOrientation={layout}\nNumberOfChannels=2\nSegmentDataPoints=25\nDataPoints=50\nSamplingInterval={hz}\nCh1=Fz,x\nCh2=Cz,x\nCh1=1,45,90\nCh2=1,0,0\n")
        (base / "r.vmrk").write_text("\n".join(["Mk1=New Segment,,1,1,0", "Mk2=Target,t,10,1,0", "Mk3=Time 0,,10,1,0", "Mk4=New Segment,,26,1,0", "Mk5=Target,t,30,1,0", "Mk6=Time 0,,30,1,0"]))
        out[i], data[i] = tuple(str(base / f"r.{e}") for e in ("vhdr", "dat", "vmrk")), x / 1000
    return out, data


def test_samples_in_ranges(spark, files):
    paths, data = files
    headers = bv.read_headers(spark, {i: f[0] for i, f in paths.items()})
    assert headers["s 1"][1] == ["Fz", "Cz"] and headers["s+2"][0]["SamplingInterval"] == "4000"
    df = bv.samples_of(spark, {i: f[1] for i, f in paths.items()}, headers, 7)
    assert df.rdd.getNumPartitions() == 2 * 8 + 8  # by channel and range, and by range
    got = {(r["id"], r["chan"], r["sample"]): r["value"] for r in df.collect()}
    assert got == {(i, c, s + 1): x[k, s] for i, x in data.items() for k, c in enumerate(("Fz", "Cz")) for s in range(50)}
    some = df.where("chan = 'Cz' and id = 's 1' and sample between 8 and 20")
    assert [r["value"] for r in some.orderBy("sample").collect()] == data["s 1"][1, 7:20].tolist() and some.rdd.getNumPartitions() == 2
    assert df.where("chan = 'none'").count() == 0 and df.where("value > 0 and sample > 40").count() == sum(int((x[:, 40:] > 0).sum()) for x in data.values())


def test_filters_of_the_source():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThan

    reader = SamplesReader([{"id": "i", "path": "/x", "channels": ["a", "b"], "by_channel": True, "points": 100}], 10)
    left = list(reader.pushFilters([EqualTo(("chan",), "b"), In(("id",), ("i", "j")), GreaterThan(("sample",), 35), LessThan(("sample",), 60), IsNotNull(("chan",))]))
    assert [type(f) for f in left] == [IsNotNull]
    assert [(p.first, p.last, p.places) for p in reader.partitions()] == [(35, 45, (1,)), (45, 55, (1,)), (55, 59, (1,))]


def test_many_recordings(spark, files):
    paths, data = files
    bad = spark.createDataFrame([("s 1", "Fz", 9, 10)], "id string, chan string, start long, stop long")
    cube = bv.recordings(spark, paths, bv.ImportOptions(first=-2, last=1), bad, size=11)
    got = {(r["id"], r["chan"], r["time"], r["trial"]): r["value"] for r in cube.long().collect()}
    want = {(i, c, ms * o, f"t_{s}"): x[k, at + o - 1] for (i, x), ms in zip(data.items(), (2.0, 4.0), strict=True) for k, c in enumerate(("Fz", "Cz")) for s, at in ((1, 10), (2, 30)) for o in range(-2, 2)}
    want |= {("s 1", "Fz", 2.0 * o, "t_1"): None for o in (-1, 0)}
    assert cube.names == ["chan", "time", "trial", "id"] and got == want
    one = {k[1:]: v for k, v in got.items() if k[0] == "s+2"}
    alone = bv.recording(spark, *paths["s+2"], bv.ImportOptions(first=-2, last=1))
    assert {(r["chan"], r["time"], r["trial"]): r["value"] for r in alone.long().collect()} == one
    header = paths["s 1"][0]
    text = open(header).read()
    with open(header, "w") as f:
        f.write(text.replace("SegmentDataPoints=25", "SegmentDataPoints=10"))
    with pytest.raises(ValueError, match="s 1 do not match"):
        bv.recordings(spark, paths)
