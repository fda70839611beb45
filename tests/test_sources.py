"""Reading a recording and binning a stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dimframe.core import from_values
from dimframe.sources import brainvision as bv
from dimframe.sources.tables import write
from dimframe.streaming.segments import binned


@pytest.mark.parametrize("layout", ["VECTORIZED", "MULTIPLEXED"])
def test_recording(spark, tmp_path, layout):
    x = (np.arange(2 * 50).reshape(2, 50) * 10).astype("<i4")
    (tmp_path / "r.dat").write_bytes((x if layout == "VECTORIZED" else x.T).tobytes())
    (tmp_path / "r.vhdr").write_text(f"DataOrientation={layout}\nNumberOfChannels=2\nSamplingInterval=2000\nCh1=Fz,x\nCh2=Cz,x\nCh1=1,45,90\nCh2=1,0,0\n")
    marks = ["header"] * 3 + ["Mk1=New Segment,,1,1,0", "Mk2=Target,t_1,10,1,0", "Mk3=Time 0,,10,1,0", "Mk4=New Segment,,25,1,0", "Mk5=Target,t_2,30,1,0", "Mk6=Time 0,,30,1,0", "Mk7=Bad Interval,,31,1,0", "Mk8=Comment,x,none,1,0"]
    (tmp_path / "r.vmrk").write_text("\n".join(marks))
    header = bv.read_header(spark, str(tmp_path / "r.vhdr"))
    assert header["SamplingInterval"] == "2000" and header["DataOrientation"] == layout.lower()
    channels = bv.read_channels(spark, str(tmp_path / "r.vhdr")).orderBy("n").collect()
    assert [(c["chan"], c["theta"]) for c in channels] == [("Fz", 45.0), ("Cz", 0.0)]
    samples = bv.read_samples(spark, str(tmp_path / "r.dat"), header, ["Fz", "Cz"])
    got = samples.where("chan = 'Cz'").orderBy("sample").collect()
    assert np.allclose([r["value"] for r in got], x[1] / 1000)
    markers = bv.read_markers(spark, str(tmp_path / "r.vmrk"))
    assert markers.count() == 7
    assert [tuple(r) for r in bv.good_segments(markers).collect()] == [(1, 10, "t_1")]
    split = bv.split_markers(bv.good_segments(markers), "segment", ["kind", "n"], ["string", "int"]).first()
    assert (split["kind"], split["n"]) == ("t", 1)


def test_whole_recording(spark, tmp_path):
    x = (np.arange(2 * 50).reshape(2, 50) * 10).astype("<i4")
    (tmp_path / "r.dat").write_bytes(x.tobytes())
    head = "DataOrientation=VECTORIZED\nNumberOfChannels=2\nSegmentDataPoints={}\nDataPoints=50\nSamplingInterval=2000\nCh1=Fz,x\nCh2=Cz,x\nCh1=1,45,90\nCh2=1,0,0\n"
    marks = ["Mk1=New Segment,,1,1,0", "Mk2=Target,t,10,1,0", "Mk3=Time 0,,10,1,0", "Mk4=New Segment,,26,1,0", "Mk5=Target,t,30,1,0", "Mk6=Time 0,,30,1,0"]
    (tmp_path / "r.vmrk").write_text("\n".join(marks))
    paths = [str(tmp_path / f"r.{e}") for e in ("vhdr", "dat", "vmrk")]
    (tmp_path / "r.vhdr").write_text(head.format(25))
    cube = bv.recording(spark, *paths, bv.ImportOptions(first=-2, last=1))
    got = {(r["chan"], r["time"], r["trial"]): r["value"] for r in cube.long().collect()}
    # samples count from 1
    expected = {(c, 2.0 * o, f"t_{s}"): x[k, at + o - 1] / 1000 for k, c in enumerate(("Fz", "Cz")) for s, at in ((1, 10), (2, 30)) for o in range(-2, 2)}
    assert cube.names == ["chan", "time", "trial"] and got == pytest.approx(expected)
    (tmp_path / "r.vhdr").write_text(head.format(10))
    with pytest.raises(ValueError, match="do not match"):
        bv.recording(spark, *paths)


def test_stream(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:{m:02d}:00", float(m)) for m in range(0, 60, 5)]
    df = spark.createDataFrame(rows, "chan string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = binned(stream, "chan", "ts", "value", "15 minutes").writeStream.format("memory").queryName("bins").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = binned(df, "chan", "ts", "value", "15 minutes")
    assert sorted(map(tuple, spark.table("bins").collect())) == sorted(map(tuple, batch.collect()))


def test_write(spark, tmp_path):
    cube = from_values(spark, [1.0, 2.0], {"a": ["x", "y"]})
    write(cube, str(tmp_path / "out"), ["a"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
