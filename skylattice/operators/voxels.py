"""Voxel sets as rows (ix, iy, iz): closures, set algebra, smoothing, interpolation.

Dense arrays become sparse rows. Mask algebra is relational: union, intersection and difference are
distinct unions, semi joins and anti joins on the voxel key.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["ix", "iy", "iz"]
# Dynamic closure half-width, height, reach and instrument factor; static closure half-width.
CLOSE_HALF_M, CLOSE_TOP_M, CLOSE_REACH_M, IMC_FACTOR = 3 * 1852.0, 1500 * 0.3048, 15_000.0, 1.25
STATIC_HALF_M, STATIC_REACH_M, STATIC_TOP_M = 228.6, 3 * 1852.0, 5000 * 0.3048


def index(value: str | Column, low: float, step: float) -> Column:
    return F.floor(((F.col(value) if isinstance(value, str) else value) - low) / step).cast("long")


def union(*sets: DataFrame, key: list[str] = KEY) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), (s.select(*key) for s in sets)).distinct()


def intersection(a: DataFrame, b: DataFrame, key: list[str] = KEY) -> DataFrame:
    return a.select(*key).intersect(b.select(*key))


def difference(a: DataFrame, b: DataFrame, key: list[str] = KEY) -> DataFrame:
    return a.select(*key).distinct().join(b.select(*key), key, "left_anti")


def closed(along: Column, across: Column, z: Column, landing: Column, length: Column, imc: Column) -> Column:
    """Whether traffic of an active end closes a voxel: before the threshold landing, past the runway departing."""
    width = F.when(imc, CLOSE_HALF_M * IMC_FACTOR).otherwise(CLOSE_HALF_M)
    reach = F.when(landing, along.between(-CLOSE_REACH_M, 0)).otherwise(along.between(F.lit(0.0), length + CLOSE_REACH_M))
    return (F.abs(across) <= width) & reach & (z < CLOSE_TOP_M)


def statically_closed(along: Column, across: Column, z: Column, length: Column, elevation: Column) -> Column:
    """The strip around a runway and its extended centre lines, whatever is active."""
    return (F.abs(across) <= STATIC_HALF_M) & along.between(F.lit(-STATIC_REACH_M), length + STATIC_REACH_M) & (z <= elevation + STATIC_TOP_M)


def kernel(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    """Offsets and weights of a normalised Gaussian, cut at truncate standard deviations."""
    reach = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    return [(d - reach, w / sum(raw)) for d, w in enumerate(raw)]


def smooth(voxels: DataFrame, value: str, shape: dict[str, int], sigma: dict[str, float], by: list[str]) -> DataFrame:
    """Separable Gaussian over sparse voxels, one pass an axis; what would leave the grid stays at its edge cell's nearest value."""
    for axis, s in sigma.items():
        n = shape[axis]
        weights = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in kernel(s)))
        keys = [*by, *(k for k in shape)]
        spread = voxels.select(*keys, value, F.explode(weights).alias("k")).withColumn("__to", F.col(axis) + F.col("k.d"))
        # Nearest mode: an edge value also stands for the cells beyond it, so it reaches each target by all their offsets.
        inner = spread.where(F.col("__to").between(0, n - 1)).select(*(F.col("__to").alias(k) if k == axis else k for k in keys), (F.col(value) * F.col("k.w")).alias(value))
        beyond = voxels.where((F.col(axis) == 0) | (F.col(axis) == n - 1))
        reach = len(kernel(s)) // 2
        outside = F.explode(F.sequence(F.lit(1), F.lit(reach)))
        ghost = beyond.withColumn("__far", outside).withColumn("__at", F.when(F.col(axis) == 0, -F.col("__far")).otherwise(n - 1 + F.col("__far")))
        ghost = ghost.select(*keys, value, "__at", F.explode(weights).alias("k")).withColumn("__to", F.col("__at") + F.col("k.d")).where(F.col("__to").between(0, n - 1))
        ghost = ghost.select(*(F.col("__to").alias(k) if k == axis else k for k in keys), (F.col(value) * F.col("k.w")).alias(value))
        voxels = inner.unionByName(ghost).groupBy(*keys).agg(F.sum(value).alias(value))
    return voxels


#: Voxels of a grid whose corners go to every task with points to be interpolated.
SHARED_MOST = 200_000


def trilinear(points: DataFrame, voxels: DataFrame, value: str, low: tuple[float, float, float], step: tuple[float, float, float], shape: tuple[int, int, int], key: list[str]) -> DataFrame:
    """Value at each point between the eight cell centres around it, clamped to the grid; missing voxels count as 0.

    The eight values around each place of the grid stand in one row, so a point meets one row and is not multiplied."""
    corners = [(i, j, l) for i in (0, 1) for j in (0, 1) for l in (0, 1)]
    bits = F.array(*(F.struct(F.lit(n).alias("n"), *(F.lit(b).alias(f"b{k}") for k, b in enumerate(c))) for n, c in enumerate(corners)))
    around = voxels.select(*KEY, value, F.explode(bits).alias("__c"))
    around = around.select(F.col("__c.n").alias("__n"), F.col(value).cast("double").alias("__v"), *((F.col(name) - (F.col(f"__c.b{k}") if n > 1 else F.lit(0))).cast("long").alias(f"__i{k}") for k, (name, n) in enumerate(zip(KEY, shape, strict=True))))
    for k, n in enumerate(shape):
        around = around.where(F.col(f"__i{k}").between(0, max(n - 2, 0)))
    around = around.groupBy("__i0", "__i1", "__i2").agg(*(F.sum(F.when(F.col("__n") == n, F.col("__v"))).alias(f"__v{n}") for n in range(8)))
    if math.prod(shape) <= SHARED_MOST:
        around = F.broadcast(around)
    place, shares = {}, []
    for k, (c, a, s, n) in enumerate(zip("xyz", low, step, shape, strict=True)):
        f = F.least(F.greatest((F.col(c) - a) / s - 0.5, F.lit(0.0)), F.lit(float(n - 1)))
        place |= {f"__f{k}": f, f"__i{k}": F.least(F.floor(f), F.lit(max(n - 2, 0))).cast("long")}
        shares.append(F.col(f"__f{k}") - F.col(f"__i{k}"))
    weights = [math.prod((s if b else 1 - s for s, b in zip(shares[1:], c[1:], strict=True)), start=shares[0] if c[0] else 1 - shares[0]) for c in corners]
    met = points.withColumns(place).join(around, ["__i0", "__i1", "__i2"], "left")
    total = sum((w * F.coalesce(f"__v{n}", F.lit(0.0)) for n, w in enumerate(weights[1:], 1)), weights[0] * F.coalesce("__v0", F.lit(0.0)))
    return met.groupBy(*key).agg(F.sum(total).alias(value))
