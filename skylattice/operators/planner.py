"""Corridor planning over a voxel lattice: snapping, straight lines, best-first search, smoothing.

Each query is a group of its own: the voxels around its corridor travel with it, so a sweep spreads
over the cluster by query. Only the search and the line simplification are Python, one Arrow group
at a time, bounded by a corridor's grid.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OFFSETS = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) != (0, 0, 0)]


@dataclass(frozen=True)
class Vehicle:
    """Speeds m/s, vertical limits m/s, power W. descent_limit can be lifted, as coarse grids make every descending step steeper than it."""

    cruise: float = 67.0
    climb: float = 30.0
    descent: float = 25.0
    climb_limit: float = 7.0
    descent_limit: float | None = 5.0
    cruise_w: float = 250_000.0
    hover_w: float = 850_000.0


@dataclass(frozen=True)
class Weights:
    time: float = 1.0
    energy: float = 5e-4
    risk: float = 200.0
    noise: float = 1e-3
    impact: float = 100.0
    turn: float = 1.0
    far_m: float = 1500.0
    most_expansions: int = 5_000_000


#: Gates of the baselines: whether a voxel must be clear, open, and whether risk and impact cost.
BASELINES = {"B0": (False, False, False, False), "B1": (False, False, False, False), "B2": (True, False, False, False), "B3": (True, True, False, True), "B4": (True, True, True, True)}


def snap(queries: DataFrame, allowed: DataFrame, key: str, radius: int = 5) -> DataFrame:
    """The nearest allowed voxel of each query (key, ix, iy, iz) by rings, then by neighbour order; none within radius gives no row."""
    grid = F.expr(f"flatten(transform(sequence(-{radius}, {radius}), i -> flatten(transform(sequence(-{radius}, {radius}), j -> transform(sequence(-{radius}, {radius}), k -> struct(greatest(abs(i), abs(j), abs(k)) as ring, i as di, j as dj, k as dk))))))")
    cell = ["ix", "iy", "iz"]
    spread = queries.select(*cell).distinct().withColumn("o", F.explode(grid))  # queries share cells, each looks around itself once
    there = spread.select("o", *(F.col(c).alias(f"q_{c}") for c in cell), *((F.col(c) + F.col(f"o.{d}")).alias(c) for c, d in zip(cell, ("di", "dj", "dk"), strict=True)))
    # The planner does not see that rows multiply: without the hint it would broadcast them.
    found = there.join(allowed.select(*cell).hint("merge"), cell)
    found = found.groupBy(*(f"q_{c}" for c in cell)).agg(F.min(F.struct("o", *cell)).alias("s"))
    met = queries.select(key, *(F.col(c).alias(f"q_{c}") for c in cell)).join(found, [f"q_{c}" for c in cell])
    return met.groupBy(key).agg(F.min("s").alias("s")).select(key, *(F.col(f"s.{c}").alias(c) for c in cell), F.col("s.o.ring").alias("ring"))


def straight(queries: DataFrame, n: int = 200) -> DataFrame:
    """n points of the chord between the ends of each query (x0..z1), flown at the higher altitude."""
    at = queries.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("f", F.col("k") / (n - 1))
    level = F.greatest("z0", "z1").cast("double")
    return at.select(*queries.columns, "k", *((F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * F.col("f")).alias(c) for c in "xy"), level.alias("z"))


def edge_cost(length: Column, dz: Column, v: Vehicle, w: Weights, clearance: Column, risk: Column) -> Column:
    """Cost of a step in columns, to check planned paths by."""
    speed = F.when(dz > 0, v.climb).when(dz < 0, v.descent).otherwise(v.cruise)
    dt = length / speed
    power = v.cruise_w + (v.hover_w - v.cruise_w) * F.least(F.greatest(F.abs(dz) / dt / v.climb_limit, F.lit(0.0)), F.lit(1.0))
    impact = F.least(F.greatest(1 - clearance / w.far_m, F.lit(0.0)), F.lit(1.0))
    return w.time * dt + w.energy * power * dt + w.risk * risk * dt + w.impact * impact


def search(voxels: pd.DataFrame, start: tuple[int, int, int], goal: tuple[int, int, int], cell: tuple[float, float, float], gates: tuple[bool, bool, bool, bool], v: Vehicle, w: Weights) -> tuple[list[tuple[int, int, int]], float, int]:
    """Least-cost path over the given voxels (ix, iy, iz, sdf, open, risk); empty if there is none. Ties leave in the order they came."""
    clear, opened, use_risk, use_impact = gates
    ok = np.ones(len(voxels), bool)
    ok &= (voxels["sdf"].to_numpy() > 0) if clear else True
    ok &= voxels["open"].to_numpy(bool) if opened else True
    at = {k: n for n, k in enumerate(zip(voxels["ix"], voxels["iy"], voxels["iz"], strict=True)) if ok[n]}
    sdf, risk = voxels["sdf"].to_numpy(float), voxels["risk"].to_numpy(float)
    if start not in at or goal not in at:
        return [], math.inf, 0
    steps = []
    for o in OFFSETS:
        d = [a * b for a, b in zip(o, cell, strict=True)]
        length = math.sqrt(sum(x * x for x in d))
        speed = v.climb if d[2] > 0 else v.descent if d[2] < 0 else v.cruise
        dt = length / speed
        rate = abs(d[2]) / dt
        if (d[2] > 0 and rate > v.climb_limit) or (d[2] < 0 and v.descent_limit is not None and rate > v.descent_limit):
            continue
        power = v.cruise_w + (v.hover_w - v.cruise_w) * min(max(rate / v.climb_limit, 0.0), 1.0)
        steps.append((o, tuple(x / length for x in d), dt, w.time * dt + w.energy * power * dt))

    def ahead(n: tuple[int, int, int]) -> float:
        return w.time * math.dist([a * b for a, b in zip(n, cell, strict=True)], [a * b for a, b in zip(goal, cell, strict=True)]) / v.cruise

    best, came, done, count = {start: 0.0}, {start: (None, None)}, set(), 0
    heap = [(ahead(start), 0, start)]
    expanded = 0
    while heap and expanded < w.most_expansions:
        _, _, here = heapq.heappop(heap)
        if here in done:
            continue
        if here == goal:
            path = [here]
            while came[path[-1]][0] is not None:
                path.append(came[path[-1]][0])
            return path[::-1], best[goal], expanded
        done.add(here)
        expanded += 1
        before = came[here][1]
        for o, unit, dt, cost in steps:
            there = (here[0] + o[0], here[1] + o[1], here[2] + o[2])
            n = at.get(there)
            if n is None or there in done:
                continue
            cost += w.risk * risk[n] * dt if use_risk else 0.0
            cost += w.impact * min(max(1 - sdf[n] / w.far_m, 0.0), 1.0) if use_impact else 0.0
            cost += w.turn * math.acos(min(max(sum(a * b for a, b in zip(unit, before, strict=True)), -1.0), 1.0)) if before else 0.0
            if best[here] + cost < best.get(there, math.inf):
                best[there], came[there] = best[here] + cost, (here, unit)
                count += 1
                heapq.heappush(heap, (best[there] + ahead(there), count, there))
    return [], math.inf, expanded


PATHS = "query long, feasible boolean, cost double, n_expansions long, n_waypoints int, path array<struct<ix:int,iy:int,iz:int>>"


def answering(cell: tuple[float, float, float], gates: tuple[bool, bool, bool, bool], v: Vehicle, w: Weights):
    def one(ask: pd.DataFrame, grid: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for a in ask.itertuples(index=False):
            path, cost, n = search(grid, (a.s_ix, a.s_iy, a.s_iz), (a.g_ix, a.g_iy, a.g_iz), cell, gates, v, w)
            rows.append((a.query, bool(path), cost if path else None, n, len(path), [{"ix": int(i), "iy": int(j), "iz": int(k)} for i, j, k in path]))
        return pd.DataFrame(rows, columns=["query", "feasible", "cost", "n_expansions", "n_waypoints", "path"])

    return one


def plan(queries: DataFrame, voxels: DataFrame, cell: tuple[float, float, float], baseline: str = "B3", v: Vehicle = Vehicle(), w: Weights = Weights()) -> DataFrame:
    """PATHS of queries (query, s_ix.., g_ix..) over voxels (query, ix, iy, iz, sdf, open, risk)."""
    one = answering(cell, BASELINES[baseline], v, w)
    grid = voxels.select(F.col("query").alias("of_query"), "ix", "iy", "iz", "sdf", "open", "risk")
    return queries.groupBy("query").cogroup(grid.groupBy("of_query")).applyInPandas(lambda key, ask, own: one(ask, own), PATHS)


#: Voxels of a grid that every query shares.
SHARED_MOST = 100_000


def plan_shared(queries: DataFrame, grid: pd.DataFrame, cell: tuple[float, float, float], baseline: str = "B3", v: Vehicle = Vehicle(), w: Weights = Weights()) -> DataFrame:
    """PATHS of queries over one grid (ix, iy, iz, sdf, open, risk) of bounded size, which goes to each executor once."""
    if len(grid) > SHARED_MOST:
        raise ValueError(f"{len(grid)} voxels are more than {SHARED_MOST}")
    context = queries.sparkSession.sparkContext
    one, shared = answering(cell, BASELINES[baseline], v, w), context.broadcast(grid)
    ends = [f"{p}_{c}" for p in "sg" for c in ("ix", "iy", "iz")]
    # Queries share ends, so each pair of ends is searched once; a given number of tasks stays, where small rows would be packed into one.
    asked = queries.select(*ends).dropna().distinct().repartition(4 * context.defaultParallelism, *ends).withColumn("query", F.lit(0))
    schema = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in ends)
    searched = asked.groupBy(*ends).applyInPandas(lambda ask: pd.concat([ask[ends], one(ask, shared.value)], axis=1), f"{schema}, {PATHS}").drop("query")
    none = {"feasible": F.lit(False), "n_expansions": F.lit(0).cast("long"), "n_waypoints": F.lit(0), "path": F.array().cast(PATHS.rpartition(" ")[2])}
    found = queries.select(F.col("query").cast("long").alias("query"), *ends).join(searched, ends, "left")
    return found.select("query", *(F.coalesce(c, none[c]).alias(c) if c in none else c for c in ("feasible", "cost", "n_expansions", "n_waypoints", "path")))


def simplify_line(points: np.ndarray, epsilon: float) -> np.ndarray:
    """Flags of the points that stay when all others are within epsilon of the line kept."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        chord, inner = points[b] - points[a], points[a + 1 : b] - points[a]
        size = float(np.hypot(*chord))
        off = np.abs(inner[:, 0] * chord[1] - inner[:, 1] * chord[0]) / size if size else np.hypot(inner[:, 0], inner[:, 1])
        far = int(np.argmax(off))
        if off[far] > epsilon:
            keep[a + 1 + far] = True
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return keep


def simplify(points: DataFrame, key: str, order: list[str], epsilon: float) -> DataFrame:
    """(key, order..., x, y) of the points of each polyline that simplification keeps."""

    @F.pandas_udf("array<boolean>")
    def kept(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([simplify_line(np.stack([x, y], axis=1).astype(float), epsilon) for x, y in zip(xs, ys, strict=True)])

    lines = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, "x", "y"))).alias("line"))
    flagged = lines.withColumn("kept", kept(F.transform("line", lambda p: p["x"]), F.transform("line", lambda p: p["y"])))
    return flagged.select(key, F.inline(F.arrays_zip("line", "kept"))).where("kept").select(key, "line.*")
