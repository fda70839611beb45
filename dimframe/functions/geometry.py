"""Positions on a sphere as columns, angles, a map projection, neighbours and spherical splines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import DimFrame


def _rad(c: Column, deg: bool) -> Column:
    return F.radians(c) if deg else c


def _deg(c: Column, deg: bool) -> Column:
    return F.degrees(c) if deg else c


def _acos(c: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def sph2cart(theta: Column, phi: Column, r: Column | float = 1.0, deg: bool = True) -> dict[str, Column]:
    t, p = _rad(theta, deg), _rad(phi, deg)
    r = r if isinstance(r, Column) else F.lit(float(r))
    return {"x": r * F.sin(t) * F.cos(p), "y": r * F.sin(t) * F.sin(p), "z": r * F.cos(t)}


def cart2sph(x: Column, y: Column, z: Column, deg: bool = True) -> dict[str, Column]:
    r = F.sqrt(x * x + y * y + z * z)
    theta = F.when(r == 0, 0.0).otherwise(_acos(z / F.nullif(r, F.lit(0.0))))
    return {"theta": _deg(theta, deg), "phi": _deg(F.atan2(y, x), deg), "r": r}


def sph2geo(theta: Column, phi: Column, long360: bool = False) -> dict[str, Column]:
    """Longitude and latitude in degrees; a negative theta lies on the other side."""
    long = F.when(theta < 0, phi + 180).otherwise(phi)
    long = F.pmod(long, F.lit(360.0)) if long360 else F.pmod(long + 180, F.lit(360.0)) - 180
    return {"long": long, "lat": 90 - F.abs(theta)}


def geo2sph(long: Column, lat: Column) -> dict[str, Column]:
    return {"theta": 90 - lat, "phi": F.pmod(long + 180, F.lit(360.0)) - 180}


def geo2cart(long: Column, lat: Column, r: Column | float = 1.0, deg: bool = True) -> dict[str, Column]:
    a, b = _rad(long, deg), _rad(lat, deg)
    r = r if isinstance(r, Column) else F.lit(float(r))
    return {"x": r * F.cos(b) * F.cos(a), "y": r * F.cos(b) * F.sin(a), "z": r * F.sin(b)}


def cart2geo(x: Column, y: Column, z: Column, deg: bool = True) -> dict[str, Column]:
    r = F.sqrt(x * x + y * y + z * z)
    lat = F.when(r == 0, 0.0).otherwise(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / F.nullif(r, F.lit(0.0))))))
    return {"long": _deg(F.atan2(y, x), deg), "lat": _deg(lat, deg), "r": r}


def laea(long: Column, lat: Column, r: float = 1.0, long0: float = 270.0, lat0: float = 90.0) -> dict[str, Column]:
    """Lambert's azimuthal equal-area projection of a sphere (degrees)."""
    a, b, b0 = F.radians(long - F.lit(long0)), F.radians(lat), float(np.radians(lat0))
    sin0, cos0 = float(np.sin(b0)), float(np.cos(b0))
    c = 1 + sin0 * F.sin(b) + cos0 * F.cos(b) * F.cos(a)
    k = F.sqrt(2 / F.nullif(c, F.lit(0.0)))
    return {"px": r * k * F.cos(b) * F.sin(a), "py": r * k * (cos0 * F.sin(b) - sin0 * F.cos(b) * F.cos(a))}


def laea_inverse(px: Column, py: Column, r: float = 1.0, long0: float = 270.0, lat0: float = 90.0) -> dict[str, Column]:
    b0 = float(np.radians(lat0))
    sin0, cos0 = float(np.sin(b0)), float(np.cos(b0))
    rho = F.sqrt(px * px + py * py)
    c = 2 * F.asin(F.least(F.lit(1.0), rho / (2 * r)))
    lat = F.when(rho == 0, F.lit(b0)).otherwise(F.asin(F.cos(c) * sin0 + py * F.sin(c) * cos0 / F.nullif(rho, F.lit(0.0))))
    long = F.lit(long0) + F.degrees(F.atan2(px * F.sin(c), rho * cos0 * F.cos(c) - py * sin0 * F.sin(c)))
    return {"long": F.pmod(long, F.lit(360.0)), "lat": F.degrees(lat)}


def cos_angles(vectors: DataFrame, targets: DataFrame, key: str, vector: str, other: str = "other") -> DataFrame:
    """The cosine of the angle between each vector and each of a set of target vectors, which must be small."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    small = targets.select(F.col(key).alias(other), F.col(vector).alias("_t"))
    dot = F.aggregate(F.zip_with(vector, "_t", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return vectors.crossJoin(F.broadcast(small)).select(key, other, (dot / F.nullif(norm(F.col(vector)) * norm(F.col("_t")), F.lit(0.0))).alias("cosine"))


def nearest_channels(positions: Mapping[str, Sequence[float]], alpha: float) -> dict[str, list[str]]:
    """Neighbours among electrodes: edges of triangles whose empty ball has radius ``alpha`` at most, and each itself.

    A ball through three points with none inside, of a radius up to alpha, shows
    a face of the alpha shape. Electrodes are tens, so all triples are tried.
    """
    from itertools import combinations

    names, x = list(positions), np.array(list(positions.values()), float)
    out = {n: {n} for n in names}
    for i, j, k in combinations(range(len(names)), 3):
        a, b = x[j] - x[i], x[k] - x[i]
        cross = np.cross(a, b)
        area = cross @ cross
        if area < 1e-18:
            continue
        centre = x[i] + (np.cross(cross, a) * (b @ b) + np.cross(b, cross) * (a @ a)) / (2 * area)
        flat = np.sum((centre - x[i]) ** 2)
        if flat > alpha**2:
            continue
        lift = cross / np.sqrt(area) * np.sqrt(alpha**2 - flat)
        for ball in (centre + lift, centre - lift):
            d = np.sum((x - ball) ** 2, 1)
            d[[i, j, k]] = np.inf
            if (d >= alpha**2 - 1e-9).all():
                for p, q in combinations((i, j, k), 2):
                    out[names[p]].add(names[q])
                    out[names[q]].add(names[p])
                break
    return {n: sorted(v) for n, v in out.items()}


def spline_weights(positions: np.ndarray, good: np.ndarray, wanted: np.ndarray, m: int = 4, n: int = 7, smooth: float = 1e-10) -> np.ndarray:
    """Weights (wanted by good) of a spherical spline through the values at ``good`` positions.

    The kernel is 1/(4 pi) sum (2k+1) / (k(k+1))^m P_k(cosine); ``smooth`` is
    added along the diagonal of the bordered system.
    """
    unit = positions / np.linalg.norm(positions, axis=1, keepdims=True)
    order = np.arange(1, n + 1)
    coef = np.r_[0.0, (2 * order + 1) / (order * (order + 1.0)) ** m] / (4 * np.pi)
    kernel = lambda a, b: np.polynomial.legendre.legval(np.clip(unit[a] @ unit[b].T, -1, 1), coef)
    k = len(good)
    system = np.ones((k + 1, k + 1))
    system[:k, :k] = kernel(good, good)
    system[k, k] = 0
    system += smooth * np.eye(k + 1)
    return np.c_[kernel(wanted, good), np.ones(len(wanted))] @ np.linalg.pinv(system)[:, :k]


def interpolated(cube: DimFrame, positions: Mapping[str, Sequence[float]], chan: str = "chan", most: float = 0.3, **options) -> DimFrame:
    """Null channels filled by spherical splines from the others of the same sample.

    Samples with a larger share of nulls than ``most`` (or, from 1 on, more of
    them) stay. Weights are solved once for each pattern of nulls that occurs
    and broadcast; patterns are few, and more than 10,000 are an error.
    """
    others, names = cube.others(chan), list(positions)
    x = np.array([positions[n] for n in names], float)
    samples = cube.df.groupBy(*others).agg(F.array_sort(F.collect_set(F.when(F.col(cube.value).isNull(), F.col(chan)))).alias("_lost"))
    enough = F.size("_lost") / len(names) <= most if most < 1 else F.size("_lost") <= most
    samples = samples.where((F.size("_lost") > 0) & enough)
    patterns = [r[0] for r in samples.select("_lost").distinct().limit(10_001).collect()]
    if len(patterns) > 10_000:
        raise ValueError("too many patterns of missing channels")
    rows = []
    for lost in patterns:
        wanted = np.array([names.index(c) for c in lost])
        good = np.array([k for k, c in enumerate(names) if c not in lost])
        w = spline_weights(x, good, wanted, **options)
        rows += [(lost, names[t], names[g], float(w[a, b])) for a, t in enumerate(wanted) for b, g in enumerate(good)]
    if not rows:
        return cube
    kind = cube.df.schema[chan].dataType.simpleString()
    weights = F.broadcast(cube.df.sparkSession.createDataFrame(rows, f"_lost array<{kind}>, _target {kind}, `{chan}` {kind}, _w double"))
    made = cube.df.join(samples, others).join(weights, ["_lost", chan]).groupBy(*others, "_target").agg(F.sum(F.col("_w") * F.col(cube.value)).alias("_made")).withColumnRenamed("_target", chan)
    df = cube.df.join(made, [*others, chan], "left")
    return cube.but(df.withColumn(cube.value, F.coalesce(cube.value, "_made")).drop("_made"), step="interpolated")
