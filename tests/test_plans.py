"""What a plan does before it shuffles: rows that multiply too early fit small tables only."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from skylattice.operators import voxels as V
from skylattice.plans import catalogue


def plan_of(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_cones_multiply_points_after_paths_are_ordered(spark, sf):
    plan = plan_of(catalogue.QUERIES["cone_seconds"](spark, sf))
    assert plan.index("NestedLoopJoin") < plan.index("Window")  # the join is above the window


def test_closures_count_slices_by_sets_of_uses(spark, sf):
    plan = plan_of(catalogue.QUERIES["voxel_closure_rate"](spark, sf))
    assert not re.search(r"keys=\[path#\d+L?, (pos|slice|landing)", plan)


def test_interpolation_does_not_multiply_points(spark):
    points = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 0.5).alias("x"), (F.col("id") * 0.25).alias("y"), F.lit(0.5).alias("z"))
    voxels = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 0, 2.0), (1, 1, 0, 4.0)], "ix long, iy long, iz long, v double")
    found = V.trilinear(points, voxels, "v", (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (3, 3, 1), ["k"])
    plan = plan_of(found)
    assert plan.index("Range") < plan.index("Generate")  # the points' side of the join generates nothing
    value = {(0, 0): 1.0, (1, 0): 2.0, (1, 1): 4.0}
    for r in found.collect():
        fx, fy = (min(max(c - 0.5, 0.0), 2.0) for c in (r["k"] * 0.5, r["k"] * 0.25))
        i, j = min(int(fx), 1), min(int(fy), 1)
        want = sum(value.get((i + a, j + b), 0.0) * (fx - i if a else 1 - fx + i) * (fy - j if b else 1 - fy + j) for a in (0, 1) for b in (0, 1))
        assert abs(r["v"] - want) < 1e-9
