"""Protection surfaces as rows: a polygon footprint, a lower height, and an affine or radial top.

A prism row has surface, end_id, z_form, a, b, c (top = a x + b y + c) or c, slope, r0, cx, cy
(top = c + slope (r - r0)), z_low and its footprint: ring, a counter-clockwise array of four corners,
or the ring between the radii r_in and r_out around (cx, cy), a disc where r_in is null. There are
some hundred prisms at an airport, so they are broadcast; points never are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"
# Approach sections (length m, slope), takeoff, transitional and conical parameters.
APPROACH = ((3000.0, 0.02), (3600.0, 0.025), (8400.0, 0.0))
APPROACH_START, APPROACH_HALF, APPROACH_SPREAD = 60.0, 150.0, 0.15
TAKEOFF_START, TAKEOFF_HALF, TAKEOFF_SPREAD, TAKEOFF_MOST, TAKEOFF_LENGTH, TAKEOFF_SLOPE = 60.0, 90.0, 0.125, 900.0, 15000.0, 0.02
INNER_HEIGHT, TRANSITION, CONICAL_RADIUS, CONICAL_SLOPE, CONICAL_HEIGHT = 45.0, 1 / 7, 4000.0, 0.05, 100.0
# Half width and overrun of the strip; length and half width of the end safety area; obstacle-free zone: start, length, half width and slope of the inner approach, slope of the inner transitional.
STRIP_HALF, STRIP_OVER, SAFETY_LENGTH, SAFETY_HALF = 150.0, 60.0, 240.0, 75.0
FREE_START, FREE_LENGTH, FREE_HALF, FREE_SLOPE, FREE_SIDE = 60.0, 900.0, 60.0, 0.02, 0.333
FUNNEL_LOW, FUNNEL_HIGH, FUNNEL_TOP = 8.0, 80.0, 300.0


class Axis:
    """A runway axis from (x0, y0) along the unit vector (ux, uy), in plain numbers: runways are configuration."""

    def __init__(self, x0: float, y0: float, ux: float, uy: float):
        self.x0, self.y0, self.ux, self.uy = x0, y0, ux, uy

    def corner(self, along: float, left: float) -> tuple[float, float]:
        return self.x0 + along * self.ux - left * self.uy, self.y0 + along * self.uy + left * self.ux

    def trapezoid(self, s0: float, w0: float, s1: float, w1: float) -> list[tuple[float, float]]:
        return [self.corner(s0, -w0), self.corner(s1, -w1), self.corner(s1, w1), self.corner(s0, w0)]

    def sloped(self, start: float, height: float, slope: float) -> tuple[float, float, float]:
        """Coefficients of the top that is height at `start` along the axis and rises by slope."""
        return slope * self.ux, slope * self.uy, height - slope * (self.x0 * self.ux + self.y0 * self.uy + start)


PRISM = f"surface string, end_id string, z_form string, a double, b double, c double, slope double, r0 double, cx double, cy double, z_low double, ring {RING}, r_in double, r_out double"


def prism(surface: str, end: str, ring: list[tuple[float, float]], top: tuple[float, float, float]) -> tuple:
    return (surface, end, "affine", *map(float, top), 0.0, 0.0, 0.0, 0.0, 0.0, ring, None, None)


def round_prisms() -> list[tuple]:
    """The inner horizontal disc and the conical ring around the airport's reference point."""
    disc = ("inner_horizontal", "arp", "affine", 0.0, 0.0, INNER_HEIGHT, 0.0, 0.0, 0.0, 0.0, 0.0, [], None, CONICAL_RADIUS)
    ring = ("conical", "arp", "radial", 0.0, 0.0, INNER_HEIGHT, CONICAL_SLOPE, CONICAL_RADIUS, 0.0, 0.0, 0.0, [], CONICAL_RADIUS, CONICAL_RADIUS + CONICAL_HEIGHT / CONICAL_SLOPE)
    return [disc, ring]


def runway_prisms(end: str, x0: float, y0: float, ux: float, uy: float, length: float) -> list[tuple]:
    """Surfaces of one runway end, whose axis is the landing direction."""
    axis, back, far = Axis(x0, y0, ux, uy), Axis(x0, y0, -ux, -uy), Axis(x0 + length * ux, y0 + length * uy, ux, uy)
    rows, s, h = [], APPROACH_START, 0.0
    for size, slope in APPROACH:
        near, wide = (APPROACH_HALF + APPROACH_SPREAD * (d - APPROACH_START) for d in (s, s + size))
        rows.append(prism("approach", end, back.trapezoid(s, near, s + size, wide), back.sloped(s, h, slope)))
        s, h = s + size, h + slope * size
    widen = (TAKEOFF_MOST - TAKEOFF_HALF) / TAKEOFF_SPREAD
    for a, b, w0, w1 in ((0.0, widen, TAKEOFF_HALF, TAKEOFF_MOST), (widen, TAKEOFF_LENGTH, TAKEOFF_MOST, TAKEOFF_MOST)):
        rows.append(prism("takeoff", end, far.trapezoid(TAKEOFF_START + a, w0, TAKEOFF_START + b, w1), far.sloped(TAKEOFF_START, 0.0, TAKEOFF_SLOPE)))
    for surface, inner, slope in (("transitional", APPROACH_HALF, TRANSITION), ("ofz_inner_transitional", STRIP_HALF, FREE_SIDE)):
        for side in (1.0, -1.0):
            across, outer = Axis(x0, y0, -side * uy, side * ux), inner + INNER_HEIGHT / slope
            ring = [across.corner(p, -side * q) for p, q in ((inner, 0.0), (outer, 0.0), (outer, length), (inner, length))]
            rows.append(prism(surface, end, ring[:: -int(side)], across.sloped(inner, 0.0, slope)))
    rows.append(prism("ofz_inner_approach", end, back.trapezoid(FREE_START, FREE_HALF, FREE_START + FREE_LENGTH, FREE_HALF), back.sloped(FREE_START, 0.0, FREE_SLOPE)))
    rows.append(prism("strip", end, axis.trapezoid(-STRIP_OVER, STRIP_HALF, length + STRIP_OVER, STRIP_HALF), (0, 0, 0)))
    rows.append(prism("resa", end, far.trapezoid(0.0, SAFETY_HALF, SAFETY_LENGTH, SAFETY_HALF), (0, 0, 0)))
    return rows


def prisms_of(ends: DataFrame, airport: bool = True, most: int = 1_000) -> DataFrame:
    """All surfaces of runway ends (end_id, x0, y0, ux, uy, length): approach, takeoff, transitional, strip, end safety area
    and both obstacle-free zones; and those around the airport, if asked for. More than `most` ends are an error."""
    rows = ends.select("end_id", *(F.col(c).cast("double") for c in ("x0", "y0", "ux", "uy", "length"))).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} runway ends")
    found = [p for r in rows for p in runway_prisms(*r)]
    return ends.sparkSession.createDataFrame([*found, *(round_prisms() if airport else [])], PRISM)


def edges(ring: Column) -> Column:
    """Pairs of neighbouring corners."""
    following = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def signed_distance_2d(x: Column, y: Column, ring: Column) -> Column:
    """Distance to a polygon's outline, negative inside (even-odd rule)."""

    def gap(e: Column) -> Column:
        ex, ey = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        px, py = x - e["a"]["x"], y - e["a"]["y"]
        t = F.least(F.greatest((px * ex + py * ey) / F.greatest(ex * ex + ey * ey, F.lit(1e-12)), F.lit(0.0)), F.lit(1.0))
        return F.sqrt(F.pow(px - t * ex, 2) + F.pow(py - t * ey, 2))

    def crosses(e: Column) -> Column:
        straddles = (e["a"]["y"] > y) != (e["b"]["y"] > y)
        at = e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / F.when(straddles, e["b"]["y"] - e["a"]["y"]).otherwise(F.lit(1.0))
        return straddles & (x < at)

    sides = edges(ring)
    outside = F.array_min(F.transform(sides, gap))
    inside = F.size(F.filter(sides, crosses)) % 2 == 1
    return F.when(inside, -outside).otherwise(outside)


def box_distance(d_xy: Column, z: Column, z_low: Column, z_top: Column) -> Column:
    """Signed distance to a prism from the plane distance: the larger of both inside, the diagonal outside."""
    d_z = F.greatest(z - z_top, z_low - z)
    inside = (d_xy <= 0) & (d_z <= 0)
    return F.when(inside, F.greatest(d_xy, d_z)).otherwise(F.sqrt(F.pow(F.greatest(d_xy, F.lit(0.0)), 2) + F.pow(F.greatest(d_z, F.lit(0.0)), 2)))


class PrismTable:
    """Prisms as arrays, in the order of surface and end, for batches of points.

    Prisms come from configuration, so the driver may hold them; more than `most` are an error. As one compiled
    expression a prism is larger than a JVM compiles, so points meet prisms in Arrow batches."""

    def __init__(self, prisms: DataFrame, most: int = 5_000):
        rows = prisms.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} prisms")
        rows = sorted(rows, key=lambda r: (r["surface"], r["end_id"], r["c"], r["a"], r["b"]))
        self.surface, self.end = [r["surface"] for r in rows], [r["end_id"] for r in rows]
        nan = float("nan")
        self.fields = {k: np.array([nan if r[k] is None else r[k] for r in rows], float) for k in ("a", "b", "c", "slope", "r0", "cx", "cy", "z_low", "r_in", "r_out")}
        self.radial = np.array([r["z_form"] == "radial" for r in rows], bool)
        self.corners = np.array([[(p["x"], p["y"]) for p in r["ring"]] or [(nan, nan)] * 4 for r in rows], float).reshape(-1, 4, 2)

    def footprints(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Signed distance of every point (columns) to every prism's outline in the plane, negative inside."""
        f = self.fields
        gap, inside = np.full((len(x), len(self.surface)), np.inf), np.zeros((len(x), len(self.surface)), bool)
        for k in range(4):
            (ax, ay), (bx, by) = self.corners[:, k].T, self.corners[:, (k + 1) % 4].T
            ex, ey, px, py = bx - ax, by - ay, x - ax, y - ay
            t = np.clip((px * ex + py * ey) / np.maximum(ex * ex + ey * ey, 1e-12), 0.0, 1.0)
            gap = np.fmin(gap, np.sqrt((px - t * ex) ** 2 + (py - t * ey) ** 2))
            straddles = (ay > y) != (by > y)
            inside ^= straddles & (x < ax + py * ex / np.where(straddles, ey, 1.0))
        away = np.sqrt((x - f["cx"]) ** 2 + (y - f["cy"]) ** 2)
        return np.where(np.isnan(f["r_out"]), np.where(inside, -gap, gap), np.fmax(away - f["r_out"], f["r_in"] - away))

    def distances(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Signed distance of every point to every prism."""
        f, (x, y, z) = self.fields, (v[:, None] for v in (x, y, z))
        flat, away = self.footprints(x, y), np.sqrt((x - f["cx"]) ** 2 + (y - f["cy"]) ** 2)
        top = np.where(self.radial, f["c"] + f["slope"] * (away - f["r0"]), f["a"] * x + f["b"] * y + f["c"])
        high = np.maximum(z - top, f["z_low"] - z)
        return np.where((flat <= 0) & (high <= 0), np.maximum(flat, high), np.sqrt(np.maximum(flat, 0) ** 2 + np.maximum(high, 0) ** 2))

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Slices of batches, with the distances of their points."""
        size = max(1, PAIRS // max(1, len(self.surface)))
        for batch in batches:
            for k in range(0, batch.num_rows, size):
                part = batch.slice(k, size)
                yield part, self.distances(*(part.column(c).to_numpy(zero_copy_only=False) for c in ("__x", "__y", "__z")))


#: Pairs of points and prisms that a task works on at once.
PAIRS = 500_000


def placed(points: DataFrame, columns: list[str]) -> DataFrame:
    return points.select(*columns, *(F.col(c).cast("double").alias(f"__{c}") for c in "xyz"))


def prism_distances(points: DataFrame, prisms: DataFrame, key: list[str]) -> DataFrame:
    """(key, surface, end_id, sd): the signed distance of each point to every prism."""
    table, kinds = PrismTable(prisms), placed(points, key).select(*key).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sd in table.batches(batches):
            n, names = len(table.surface), [*key, "surface", "end_id", "sd"]
            each = np.repeat(np.arange(part.num_rows), n)
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(each)) for c in key), pa.array(table.surface * part.num_rows, pa.string()), pa.array(table.end * part.num_rows, pa.string()), pa.array(sd.ravel())], names)

    return placed(points, key).mapInArrow(run, kinds.add("surface", "string").add("end_id", "string").add("sd", "double"))


def prism_use(points: DataFrame, prisms: DataFrame) -> DataFrame:
    """(surface, end_id, n_pairs, n_inside, sd) of the prisms: how many points were tested, how many are inside, and the least signed
    distance. Batches are summed before anything leaves them, a row for each prism's kind and end."""
    table = PrismTable(prisms)
    groups = sorted(set(zip(table.surface, table.end, strict=True)))
    member = np.array([groups.index(g) for g in zip(table.surface, table.end, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tested, inside, least = np.zeros(len(groups), np.int64), np.zeros(len(groups), np.int64), np.full(len(groups), np.inf)
        for _, sd in table.batches(batches):
            tested += np.bincount(member, minlength=len(groups)) * len(sd)
            inside += np.bincount(member, (sd <= 0).sum(axis=0), len(groups)).astype(np.int64)
            np.minimum.at(least, member, sd.min(axis=0, initial=np.inf))
        yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in groups], pa.string()) for k in (0, 1)] + [pa.array(tested), pa.array(inside), pa.array(least)], ["surface", "end_id", "n_pairs", "n_inside", "sd"])

    found = placed(points, []).mapInArrow(run, "surface string, end_id string, n_pairs long, n_inside long, sd double")
    return found.groupBy("surface", "end_id").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("n_inside").alias("n_inside"), F.min("sd").alias("sd"))


def family_distances(points: DataFrame, prisms: DataFrame, key: list[str], families: dict[str, list[str] | None]) -> DataFrame:
    """(key, one column for each family): the plane distance of each point to the union of the footprints of a family's
    surfaces (None: of all), 0 inside of it; infinite for a family without any. What overlaps needs no union: a point is
    inside if it is in one footprint, and outside of all the nearest one is the nearest of the union."""
    table, kinds = PrismTable(prisms), points.select(*key).schema
    members = {name: np.array([surfaces is None or s in surfaces for s in table.surface], bool) for name, surfaces in families.items()}
    for name in families:
        kinds = kinds.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, PAIRS // max(1, len(table.surface)))
        for batch in batches:
            for k in range(0, batch.num_rows, size):
                part = batch.slice(k, size)
                flat = np.maximum(table.footprints(*(part.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("__x", "__y"))), 0.0)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in key), *(pa.array(flat[:, m].min(axis=1, initial=np.inf)) for m in members.values())], [*key, *families])

    return points.select(*key, *(F.col(c).cast("double").alias(f"__{c}") for c in "xy")).mapInArrow(run, kinds)


def near_prisms(points: DataFrame, prisms: DataFrame, key: list[str]) -> DataFrame:
    """(key, n_inside, sd, surface) of each point: in how many prisms it is, the least signed distance, and the surface
    that is nearest to a millionth; the first by surface and end wins ties. Nothing is shuffled."""
    table, kinds = PrismTable(prisms), placed(points, key).select(*key).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sd in table.batches(batches):
            nearest = np.argmin(np.round(sd * 1e6), axis=1)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in key), pa.array((sd <= 0).sum(axis=1)), pa.array(sd.min(axis=1)), pa.array([table.surface[k] for k in nearest], pa.string())], [*key, "n_inside", "sd", "surface"])

    return placed(points, key).mapInArrow(run, kinds.add("n_inside", "long").add("sd", "double").add("surface", "string"))


def active_prisms(prisms: DataFrame, arrivals: list[str] | None, departures: list[str] | None) -> DataFrame:
    """Static surfaces with the approaches and takeoffs of the active ends; None means all, an empty list none."""

    def on(surface: str, ends: list[str] | None) -> Column:
        return F.col("surface") != surface if ends == [] else F.lit(True) if ends is None else (F.col("surface") != surface) | F.col("end_id").isin(ends)

    return prisms.where(on("approach", arrivals) & on("takeoff", departures))


def funnel_distance(dx: Column, dy: Column, dz: Column) -> Column:
    """Signed distance into a vertiport's funnel, negative where flight is allowed."""
    radius = FUNNEL_LOW + (FUNNEL_HIGH - FUNNEL_LOW) * F.least(F.greatest(dz / FUNNEL_TOP, F.lit(0.0)), F.lit(1.0))
    return F.greatest(F.sqrt(dx * dx + dy * dy) - radius, -dz, dz - FUNNEL_TOP)
