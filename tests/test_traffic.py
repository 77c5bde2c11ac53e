"""Nearest traffic, queues, projection, archives, forecasts, surface families and drawn flights against loops and known values."""

from __future__ import annotations

import gzip
import io
import json
import math
import random
import tarfile
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skylattice.functions import exprs as X
from skylattice.functions import geodesy as G
from skylattice.operators import joins as J
from skylattice.operators import risk as M
from skylattice.operators import surfaces as S
from skylattice.operators import windows as W
from skylattice.operators import proximity as N
from skylattice.operators.nearest import nearest
from skylattice.sources import archives as A
from skylattice.sources import readers as R
from skylattice.sources import sinks as K


def clouds(kind: str) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(3)
    left = rng.uniform(-1000, 1000, (150, 2))
    right = {
        "even": rng.uniform(-1000, 1000, (400, 2)),
        "far": rng.uniform(50_000, 50_100, (60, 2)),
        "crowd": np.concatenate([rng.normal(5, 0.01, (500, 2)), rng.uniform(-1000, 1000, (5, 2))]),
        "ring": 5000 * np.stack([np.cos(np.linspace(0, 6.28, 200)), np.sin(np.linspace(0, 6.28, 200))], 1),
    }[kind]
    return np.concatenate([left, right[:3], [[np.nan, 1.0]]]), right


@pytest.mark.parametrize("kind", ["even", "far", "crowd", "ring"])
def test_nearest_without_reach_matches_brute_force(spark, kind):
    left, right = clouds(kind)
    rows = [(float(a) if a == a else None, float(b)) for a, b in left]
    a = spark.createDataFrame([*rows, rows[0]], "x double, y double")
    b = spark.createDataFrame([*((float(p), float(q)) for p, q in right), (None, 0.0)], "ox double, oy double")
    found = {(r["x"], r["y"]): r["distance"] for r in nearest(a, b, [("x", "ox"), ("y", "oy")]).collect()}
    whole = [r for r in rows if r[0] is not None]
    assert len(found) == len(set(whole))
    for x, y in whole:
        assert found[x, y] == pytest.approx(np.hypot(right[:, 0] - x, right[:, 1] - y).min(), abs=1e-9)
    if kind != "even":
        return
    one = {r["x"]: r["distance"] for r in nearest(a, b, [("x", "ox")]).collect()}
    assert all(one[x] == pytest.approx(np.abs(right[:, 0] - x).min(), abs=1e-9) for x, _ in whole)


def test_nearest_multiplies_the_left_side_in_its_last_join(spark):
    left, right = (spark.createDataFrame([(float(k * 7 % 90), float(k % 50)) for k in range(200)], f"{x} double, {y} double") for x, y in (("x", "y"), ("ox", "oy")))
    plan = nearest(left, right, [("x", "ox"), ("y", "oy")])._jdf.queryExecution().optimizedPlan().toString()
    last = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "__q0" in last and "__o0" not in last


def test_nearest_of_nothing(spark):
    a, none = spark.createDataFrame([(1.0, 2.0)], "x double, y double"), spark.createDataFrame([], "ox double, oy double")
    on = [("x", "ox"), ("y", "oy")]
    assert nearest(a, none, on).collect() == [] and nearest(none.toDF("x", "y"), a.toDF("ox", "oy"), on).collect() == []
    same = nearest(a, a.toDF("ox", "oy"), on).collect()
    assert [r["distance"] for r in same] == [0.0]


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_queue_scan_in_ranges_equals_a_loop(spark, ranges):
    rng = random.Random(5)
    rows = []
    for key in ("a", "b", None):
        n = 300 if key == "a" else 40
        rows += [(key, rng.randrange(20_000 if key == "a" else 4000), i, rng.choice([30, 60, 60, 90])) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, at long, id int, service long")
    found = {(r["k"], r["id"]): r["wait"] for r in W.fifo_scan(df, ["k"], ["at", "id"], "at", "service", ranges).collect()}
    expected = {}
    for key in ("a", "b", None):
        free = -1
        for _, at, i, service in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            expected[key, i] = max(free - at, 0)
            free = max(free, at) + service
    assert found == expected and max(expected.values()) > 500
    plain = {(r["k"], r["id"]): r["wait"] for r in W.fifo_waits(df, ["k"], ["at", "id"], "at", "service").collect()}
    assert plain == expected


def dms(d: float, m: float, s: float) -> float:
    return math.copysign(abs(d) + m / 60 + s / 3600, d)


def test_projection_of_known_geodesics(spark):
    """A published pair of trig points: 54,972.271 m, azimuth 306 52 05.37 there and 127 10 25.07 back."""
    flinders, buninyong = (dms(-37, 57, 3.72030), dms(144, 25, 29.52440)), (dms(-37, 39, 10.15610), dms(143, 55, 35.38390))
    for origin, place, azimuth in ((flinders, buninyong, dms(306, 52, 5.37)), (buninyong, flinders, dms(127, 10, 25.07))):
        r = G.to_plane(spark.createDataFrame([place], "lat double, lon double"), "lat", "lon", *origin).first()
        assert math.hypot(r["x"], r["y"]) == pytest.approx(54972.271, abs=1e-3)
        assert math.degrees(math.atan2(r["x"], r["y"])) % 360 == pytest.approx(azimuth, abs=1e-5)
    e2 = X.WGS_F * (2 - X.WGS_F)
    arc = np.linspace(math.radians(33.9425), math.radians(34.4425), 200_001)
    meridian = np.trapezoid(X.WGS_A * (1 - e2) / (1 - e2 * np.sin(arc) ** 2) ** 1.5, arc)
    r = G.to_plane(spark.createDataFrame([(34.4425, -118.4081)], "lat double, lon double"), "lat", "lon", 33.9425, -118.4081).first()
    assert r["x"] == pytest.approx(0, abs=1e-6) and r["y"] == pytest.approx(meridian, abs=1e-3)
    r = G.to_plane(spark.createDataFrame([(0.0, 179.9)], "lat double, lon double"), "lat", "lon", 0.0, -179.9).first()
    assert r["x"] == pytest.approx(-math.radians(0.2) * X.WGS_A, abs=1e-3) and r["y"] == pytest.approx(0, abs=1e-6)


@pytest.mark.parametrize("origin", [(33.9425, -118.4081), (0.0, 0.0), (-45.0, 179.95), (69.7, 18.9)])
def test_projection_round_trip_is_exact(spark, origin):
    lat0, lon0 = origin
    rows = [(lat0 + a * 0.15, (lon0 + b * 0.2 + 180) % 360 - 180) for a in range(-5, 6) for b in range(-5, 6)] + [(None, 1.0)]
    df = G.to_plane(spark.createDataFrame(rows, "lat double, lon double"), "lat", "lon", lat0, lon0)
    back = G.from_plane(df.withColumnsRenamed({"lat": "a", "lon": "b"}), "x", "y", lat0, lon0).collect()
    assert len(back) == len(rows)
    for r in back:
        if r["a"] is None:
            assert r["x"] is None and r["lat"] is None
        else:
            assert abs(r["lat"] - r["a"]) < 1e-9 and abs((r["lon"] - r["b"] + 180) % 360 - 180) < 1e-9


def test_local_approximation_is_near_the_geodesic(spark):
    rows = [(33.9425 + a * 0.1, -118.4081 + b * 0.12) for a in range(-5, 6) for b in range(-5, 6)]
    e, n = X.to_local(F.col("lat"), F.col("lon"), 33.9425, -118.4081)
    df = G.to_plane(spark.createDataFrame(rows, "lat double, lon double").withColumns({"e": e, "n": n}), "lat", "lon", 33.9425, -118.4081)
    assert max(math.hypot(r["x"] - r["e"], r["y"] - r["n"]) for r in df.collect()) < 30


def tar_of(members: list[tuple[str, bytes]], mode: str = "w", **how) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode, **how) as archive:
        for name, content in members:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            archive.addfile(info, io.BytesIO(content))
        folder = tarfile.TarInfo("folder")
        folder.type = tarfile.DIRTYPE
        archive.addfile(folder)
    return out.getvalue()


@pytest.fixture(scope="module")
def members(spark):
    spark.dataSource.register(A.MemberSource)
    return lambda path, **options: spark.read.format("members").options(**options).load(str(path))


def test_members_of_archives_by_byte_ranges(members, tmp_path):
    files = [(f"traces/{i:03d}.json", json.dumps({"i": i, "pad": "x" * (i * 37)}).encode()) for i in range(40)]
    files += [("long/" + "n" * 150 + ".json", b"{}"), ("é/" + "m" * 120 + ".json", b"[1]"), ("empty.json", b"")]
    packed = [(n, gzip.compress(c) if k % 2 else c) for k, (n, c) in enumerate(files)]
    for name, kind in (("gnu.tar", tarfile.GNU_FORMAT), ("pax.tar", tarfile.PAX_FORMAT)):
        (tmp_path / name).write_bytes(tar_of(packed, format=kind))
    (tmp_path / "stream.tgz").write_bytes(tar_of(packed, "w:gz"))
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for k, (n, c) in enumerate(packed):
            z.writestr(n, c, zipfile.ZIP_DEFLATED if k % 3 else zipfile.ZIP_STORED)
        z.writestr("dir/", b"")
    (tmp_path / "no.txt").write_text("no archive")
    for name in ("gnu.tar", "pax.tar", "stream.tgz", "z.zip"):
        df = members(tmp_path / name, partitionBytes="3000")
        rows = df.collect()
        assert {r["member"]: bytes(r["content"]) for r in rows} == dict(files) and len(rows) == len(files), name
        assert {r["archive"] for r in rows} == {str(tmp_path / name)}
        assert (df.rdd.getNumPartitions() > 2) == (name != "stream.tgz")
    assert members(tmp_path).count() == 4 * len(files) and members(tmp_path / "no.txt").count() == 0 and members(tmp_path / "*.none").count() == 0
    assert members(tmp_path / "*.tar", pattern="traces/00*.json").count() == 20


def test_cut_off_and_broken_members(members, tmp_path, spark):
    files = [(f"{i}.json", bytes([65 + i]) * 3000) for i in range(10)]
    whole = tar_of(files)
    for cut in (100, 512, 3000, 512 * 7 * 3 + 900, 512 * 7 * 5 + 511, len(whole) - 600):
        (tmp_path / "cut.tar").write_bytes(whole[:cut])
        found = {r["member"]: bytes(r["content"]) for r in members(tmp_path / "cut.tar").collect()}
        assert found == dict(files[: max(0, (cut - 512 + 512 * 7 - 3000) // (512 * 7))] if cut >= 3512 else []), cut
    (tmp_path / "cut.tgz").write_bytes(gzip.compress(whole)[:-40])
    assert set(r["member"] for r in members(tmp_path / "cut.tgz").collect()) <= {n for n, _ in files}
    broken = gzip.compress(random.Random(1).randbytes(2000))
    (tmp_path / "bad.tar").write_bytes(tar_of([("ok.gz", gzip.compress(b"ok")), ("bad.gz", broken[:40]), ("worse.gz", broken[:20] + b"zzzz" + broken[24:])]))
    assert {r["member"]: r["content"] and bytes(r["content"]) for r in members(tmp_path / "bad.tar").collect()} == {"ok.gz": b"ok", "bad.gz": None, "worse.gz": None}
    with zipfile.ZipFile(tmp_path / "cut.zip", "w") as z:
        z.writestr("a", b"b" * 1000)
    (tmp_path / "cut.zip").write_bytes((tmp_path / "cut.zip").read_bytes()[:500])
    assert members(tmp_path / "cut.zip").count() == 0


def test_forecast_groups_and_their_timeline(spark):
    hour = 3600
    t0 = 1_722_470_400
    taf = {"icaoId": "KLAX", "issueTime": "2024-08-01T00:00:00Z", "validTimeFrom": t0, "validTimeTo": t0 + 24 * hour, "fcsts": [
        {"timeFrom": t0, "timeTo": t0 + 10 * hour, "fcstChange": None, "wdir": 250, "wspd": 8, "visib": "6+", "clouds": [{"cover": "FEW", "base": 500}, {"cover": "BKN", "base": 3500}]},
        {"timeFrom": t0 + 2 * hour, "timeTo": t0 + 4 * hour, "fcstChange": "TEMPO", "visib": "2", "clouds": [{"cover": "OVC", "base": 800}]},
        {"timeFrom": t0 + 10 * hour, "timeTo": t0 + 24 * hour, "fcstChange": "FM", "wdir": "VRB", "wspd": 3, "wgst": 15, "visib": "0.5", "clouds": []},
        {"timeFrom": t0 + 18 * hour, "timeTo": t0 + 24 * hour, "timeBec": t0 + 20 * hour, "fcstChange": "BECMG", "visib": "6+", "clouds": []},
        {"timeFrom": t0 + 9 * hour, "timeTo": t0 + 9 * hour, "fcstChange": "TEMPO"},
    ]}
    later = {"icaoId": "KLAX", "issueTime": "2024-08-01T06:00:00Z", "fcsts": [{"timeFrom": t0 + 6 * hour, "timeTo": t0 + 7 * hour, "fcstChange": None, "visib": "1", "clouds": []}]}
    lines = [json.dumps([taf]), json.dumps(later), "no json", json.dumps([{"x": 1}])]
    groups = R.forecast_groups(spark.createDataFrame([(x,) for x in lines], "value string"), "value")
    got = {(r["issued"].hour, r["group_no"]): r for r in groups.collect()}
    assert set(got) == {(0, 0), (0, 1), (0, 2), (0, 3), (6, 0)}
    assert (got[0, 0]["vis_sm"], got[0, 0]["ceiling_ft"], got[0, 0]["flight_rule"]) == (6.0, 3500.0, "VFR")
    assert (got[0, 1]["kind"], got[0, 1]["flight_rule"], got[0, 2]["wind_dir_deg"], got[0, 2]["wind_gust_kt"], got[0, 2]["flight_rule"]) == ("TEMPO", "IFR", None, 15.0, "LIFR")
    timeline = sorted(((r["from_us"] // 1_000_000 - t0) // hour, (r["to_us"] // 1_000_000 - t0) // hour, r["kind"], r["vis_sm"]) for r in R.forecast_timeline(groups).collect())
    assert timeline == [(0, 2, "BASE", 6.0), (2, 4, "TEMPO", 2.0), (4, 6, "BASE", 6.0), (6, 7, "BASE", 1.0), (7, 10, "BASE", 6.0), (10, 20, "FM", 0.5), (20, 24, "BECMG", 6.0)]


@pytest.mark.parametrize("width", [3, 10, 1000])
def test_overlay_of_intervals_equals_a_raster(spark, width):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), a := rng.randrange(100), a + rng.randrange(-2, 30), i, rng.randrange(4)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, a long, b long, r int, v int")
    cells: dict = {}
    for k, a, b, r, v in rows:
        for t in range(a, b):
            cells[k, t] = max(cells.get((k, t), (-1, -1)), (r, v))
    found = J.interval_overlay(df, ["k"], "a", "b", ["r"], ["v"], width).collect()
    drawn = {}
    for r in found:
        for t in range(r["a"], r["b"]):
            assert (r["k"], t) not in drawn
            drawn[r["k"], t] = r["v"]
    assert drawn == {kt: v for kt, (_, v) in cells.items()}
    for k in ("a", "b", None):  # what touches differs
        runs = sorted((r["a"], r["b"], r["v"]) for r in found if r["k"] == k)
        assert all(p[1] < q[0] or p[2] != q[2] for p, q in zip(runs, runs[1:], strict=False))


def test_crowded_overlay_splits_its_buckets(spark, monkeypatch):
    monkeypatch.setattr(J, "ENDS_EACH", 16)
    rng = random.Random(4)
    rows = [(1, a := rng.randrange(-5_000, 5_000), a + rng.randrange(1, 4_000), i, i % 3) for i in range(3_000)]
    df = spark.createDataFrame(rows, "k int, a long, b long, r int, v int")
    widths = J.overlay_widths(df, ["k"], "a", "b", 100_000)
    assert len(widths) > 1 and all(p == q * J.PARTS for p, q in zip(widths, widths[1:], strict=False))
    cells: dict = {}
    for _, a, b, r, v in rows:
        for t in range(a, b):
            cells[t] = max(cells.get(t, (-1, -1)), (r, v))
    found = J.interval_overlay(df, ["k"], "a", "b", ["r"], ["v"], 100_000).collect()
    assert {t: r["v"] for r in found for t in range(r["a"], r["b"])} == {t: v for t, (_, v) in cells.items()}
    split = df.select(F.struct("k").alias("__key"), F.col("a").alias("__lo"), F.col("b").alias("__hi"), F.struct(F.struct("r").alias("rank"), F.struct("v").alias("v")).alias("__won"), F.lit(False).alias("__done"))
    for w in widths:
        split = J.overlay_split(split, w)
    assert split.groupBy("__key", "__b").count().agg(F.max("count")).first()[0] <= 32  # of 3,000 that share the first bucket


@pytest.mark.parametrize("n", [40, 3_000])
def test_moving_segments_meet_few_points_where_traffic_is_dense(spark, n, monkeypatch):
    monkeypatch.setattr(J, "WITNESSES", 4)
    rng = random.Random(n)
    points = [(rng.randrange(1_000), rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(0, 40)) for _ in range(n)] + [(None, 0.0, 0.0, 0.0)]
    rows = [(i, a := rng.randrange(1_000), a + rng.choice([-3, 0, 30, 200]), *(rng.uniform(-60, 60) for _ in range(4)), rng.uniform(0, 60), rng.uniform(0, 60)) for i in range(120)]
    o = spark.createDataFrame(points, "t long, x double, y double, z double")
    seg = spark.createDataFrame(rows, "k long, t0 long, t1 long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    want = set()
    for k, a, b, x0, x1, y0, y1, z0, z1 in rows:
        for t, x, y, z in points[:-1]:
            if a < b and a <= t <= b:
                f = (t - a) / (b - a)
                if math.hypot(x - x0 - f * (x1 - x0), y - y0 - f * (y1 - y0)) < 8 and abs(z - z0 - f * (z1 - z0)) < 5:
                    want.add(k)
    found = J.near_moving(o, seg, "k", 8.0, 5.0, 100)
    assert sorted(r["k"] for r in found.collect()) == sorted(want)
    assert 0 < len(want) < 120


@pytest.mark.parametrize("n, limits", [(30, {}), (4_000, {}), (4_000, {"PART_SEGMENTS": 20, "SEGMENTS_AT_ONCE": 7, "PAIRS": 50, "FEW": 0})])
def test_least_distances_of_moving_segments_match_brute_force(spark, n, limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(N, name, value)
    rng = random.Random(n)
    points = [(rng.randrange(1_000), rng.uniform(-500, 500), rng.uniform(-500, 500), rng.uniform(0, 400)) for _ in range(n)] + [(None, 0.0, 0.0, 0.0), (5, 0.0, None, 0.0)]
    far = lambda: rng.choice([600, 60, 5_000])
    rows = [(i, a := rng.randrange(1_100), a + rng.choice([-3, 2, 30, 400]), *(rng.uniform(-d, d) for d in (far(), far(), far(), far())), rng.uniform(0, 600), rng.uniform(0, 600)) for i in range(150)]
    o = spark.createDataFrame(points, "t long, x double, y double, z double")
    seg = spark.createDataFrame([*rows, (None,) * 9], "k long, t0 long, t1 long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    want = {}
    for k, a, b, x0, x1, y0, y1, z0, z1 in rows:
        met = []
        for t, x, y, z in points[:-2]:
            if a < b and a <= t <= b:
                f = (t - a) / (b - a)
                met.append((math.hypot(x - x0 - f * (x1 - x0), y - y0 - f * (y1 - y0)), abs(z - z0 - f * (z1 - z0))))
        if met:
            want[k] = (pytest.approx(min(d for d, _ in met), abs=1e-9), pytest.approx(min(h for _, h in met), abs=1e-9), any(d < 80 and h < 50 for d, h in met))
    got = {r["k"]: (r["lat"], r["vert"], r["near"]) for r in N.least_moving(o, seg, "k", 80.0, 50.0, 100).collect()}
    assert got == want
    assert n == 30 or {near for *_, near in got.values()} == {True, False}


def test_bounded_search_of_moving_segments_meets_few_points(monkeypatch):
    met, pairs, rng = [], N.pairs, np.random.default_rng(1)
    monkeypatch.setattr(N, "pairs", lambda start, count: met.append(int(count.sum())) or pairs(start, count))
    for n in (2_000, 8_000):
        traffic = N.Traffic(rng.integers(0, 900, n), {c: rng.uniform(0, 10_000, n) for c in "xyz"}, 0, 900, 500.0, 500.0)
        s = {c: rng.uniform(0, 10_000, 300) for c in ("x0", "y0", "z0", "z1")}
        traffic.meet(s | {"t0": np.zeros(300, int), "t1": np.full(300, 899), "x1": s["x0"] + 50, "y1": s["y0"] + 50})
    assert sum(met) < 300 * 10_000 / 5


@pytest.mark.parametrize("parts", [50_000, 9])
def test_points_around_are_counted_in_buckets_of_time(spark, parts, monkeypatch):
    monkeypatch.setattr(N, "PART_SEGMENTS", parts)
    rng = random.Random(parts)
    spot = lambda d: (rng.randrange(-300, 300), rng.choice([rng.randrange(-40, 40), 7_000]), rng.uniform(-40, 40), rng.uniform(-d, d))
    points, rows = [spot(20) for _ in range(3_000)], [(k % 140, *spot(60)) for k in range(150)]
    want = {}
    for k, *q in rows:
        n = sum(abs(p[0] - q[0]) <= 30 and abs(p[1] - q[1]) < 10 and abs(p[2] - q[2]) < 10 and abs(p[3] - q[3]) < 5 for p in points)
        if n:
            want[k] = want.get(k, 0) + n
    o = spark.createDataFrame([*points, (None, 0, 0.0, 0.0)], "t long, x long, y double, z double")
    asks = spark.createDataFrame([*rows, (900, None, 0, 0.0, 0.0)], "k long, t long, x long, y double, z double")
    made = N.count_around(o, asks, "k", 10.0, 5.0, 30, 100)
    assert {r["k"]: r["n"] for r in made.collect()} == want and 20 < len(want) < 140


@pytest.mark.parametrize("limits", [{}, {"GROUP_POINTS": 150, "PART_PLACES": 60, "PAIRS": 7, "TOGETHER": 3, "SEEN": 5, "MANY": 4}])
def test_owners_near_paths_are_counted_in_blocks(spark, limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(N, name, value)
    rng = random.Random(5)
    spot = lambda: (rng.uniform(-60, 60), float(rng.randrange(-60, 60)), rng.uniform(0, 40))
    points = [(rng.choice([*range(40), None]), *spot()) for _ in range(400)] + [(41, None, 0.0, 0.0), (42, 0.0, 0.0, None), (43, 3.0, 4.0, 5.0)]
    places = [(rng.choice([*range(50), None]), *spot()) for _ in range(200)] + [(90, *spot()) for _ in range(40)] + [(91, 900.0, 0.0, 0.0), (92, 0.0, 0.0, None), (93, 0.0, 0.0, 5.0), (None, 0.0, 0.0, 1.0)]
    want = {}
    for k, x, y, z in places:
        for w, a, b, c in points:
            if a is not None and (d := math.hypot(x - a, y - b)) <= 10:
                lat, near = want.get(k, (math.inf, set()))
                high = None not in (z, c, w) and abs(z - c) < 6
                want[k] = (min(lat, d), near | ({w} if high else set()))
    w = spark.createDataFrame(places, "path long, x double, y double, z double")
    o = spark.createDataFrame(points, "who long, x double, y double, z double")
    got = {r["path"]: (r["lat"], r["n"]) for r in N.near_owners(w, o, "path", "who", 10.0, 6.0).collect()}
    assert got == {k: (pytest.approx(lat, abs=1e-9), len(near)) for k, (lat, near) in want.items()}
    assert 91 not in got and got[92][1] == 0 and max(n for _, n in got.values()) > 20
    assert N.near_owners(w.limit(0), o, "path", "who", 10.0, 6.0).collect() == N.near_owners(w, o.limit(0), "path", "who", 10.0, 6.0).collect() == []


@pytest.mark.parametrize(("limits", "spread"), [({}, False), ({"THIN": 0, "SEEN": 50}, False), ({"LAYERS": 2_000}, False), ({"LAYERS": 40_000, "PAIRS": 20_000}, True), ({}, True)])
def test_owners_around_a_place_are_stretches(limits, spread, monkeypatch):
    """What is surely near is marked without a look at each point; only points of cells and layers that a reach cuts are tested."""
    met, pairs, rng = [], N.pairs, np.random.default_rng(3)
    for name, value in limits.items():
        monkeypatch.setattr(N, name, value)
    monkeypatch.setattr(N, "pairs", lambda start, count: met.append(int(count.sum())) or pairs(start, count))
    n, m = 40_000 if spread else 6_000, 200
    x, y = (rng.uniform(-30, 30, n) if spread else 7.0 * rng.integers(-4, 5, n) for _ in "xy")
    z, who = rng.integers(0, 90, n).astype(float), rng.integers(0, 400, n)
    key, (px, py), pz = np.sort(rng.integers(0, 60, m)), (rng.uniform(-40, 40, m) for _ in "xy"), rng.integers(0, 90, m).astype(float)
    z[5], pz[7] = np.nan, np.nan
    near = (np.hypot(x - px[:, None], y - py[:, None]) <= 10) & (np.abs(z - pz[:, None]) < 30)
    got = N.Block(pa.array(who), x, y, z, 10.0, 30.0).owners_near(key, 60, px, py, pz)
    assert got.tolist() == [len(set(who[near[key == k].any(axis=0)].tolist())) for k in range(60)] and got.max() > 100
    assert sum(met) < near.sum() / (1.2 if limits or spread else 20)


def test_rows_of_blocks_are_packed(spark):
    """What a block gets is a few rows of compressed columns, so copies of points and places cost their bytes, not their rows."""
    df = spark.range(0, 40_000, 1, 2).select("id", *(F.pmod(F.hash("id", F.lit(c)), F.lit(20_001)).alias(c) for c in "xyz"))
    rows = N.packed(df, "id", F.col("id") % 3).collect()
    assert len(rows) == 6 and sum(len(r["__rows"]) for r in rows) < 40_000 * 12
    ids, x, _, z = N.unpacked([pa.py_buffer(r["__rows"]) for r in rows], "id")
    want = {r["id"]: (r["x"], r["z"]) for r in df.collect()}
    assert dict(zip(ids.to_pylist(), zip(x.tolist(), z.tolist(), strict=True), strict=True)) == want


@pytest.mark.parametrize(("kind", "group"), [("even", 12_000_000), ("even", 40), ("far", 25), ("crowd", 90), ("ring", 12_000_000)])
def test_least_distances_of_paths_are_found_in_blocks(spark, kind, group, monkeypatch):
    """Places are shuffled once, packed and by their paths; however far traffic is, and where much of it is at one spot."""
    monkeypatch.setattr(N, "GROUP_POINTS", group)
    monkeypatch.setattr(N, "MANY", 7)
    left, right = clouds(kind)
    whole = left[:-1]
    heights = [float(k % 13 * 7) for k in range(len(right))]
    rows = [(k % 40 if k % 41 else None, *map(float, p), float(k % 60)) for k, p in enumerate(whole)]
    w = spark.createDataFrame([*rows, (90, None, 1.0, 1.0), (91, 1.0, 1.0, None)], "path long, x double, y double, z double")
    o = spark.createDataFrame([*((*map(float, p), h) for p, h in zip(right, heights, strict=True)), (None, 0.0, 3.0), (0.0, None, None)], "x double, y double, z double")
    heights.append(3.0)
    lat, vert = {}, {}
    for path, x, y, z in rows:
        lat[path] = min(lat.get(path, np.inf), np.hypot(right[:, 0] - x, right[:, 1] - y).min())
        vert[path] = min(vert.get(path, np.inf), min(abs(z - h) for h in heights))
    found = N.least_apart(w, o, "path")
    got = {r["path"]: (r["lat"], r["vert"]) for r in found.collect()}
    assert got == {k: (pytest.approx(v, abs=1e-9), vert[k]) for k, v in lat.items()} and None in got
    assert N.least_apart(w, o.limit(0), "path").collect() == N.least_apart(w.limit(0), o, "path").collect() == []
    assert "SortMergeJoin" not in found._jdf.queryExecution().sparkPlan().toString()


def test_crowds_of_positions_are_not_all_met(monkeypatch):
    met, pairs, rng = [], N.pairs, np.random.default_rng(4)
    monkeypatch.setattr(N, "pairs", lambda start, count: met.append(int(count.sum())) or pairs(start, count))
    x, y = (np.concatenate([rng.normal(0, 0.01, 20_000), [1e6, -1e6]]) for _ in "xy")
    px, py = (np.concatenate([rng.normal(0, 0.02, 300), rng.uniform(-1e7, 1e7, 50)]) for _ in "xy")
    got = N.Spots(x, y).least(px, py)
    assert got == pytest.approx(np.hypot(x - px[:, None], y - py[:, None]).min(axis=1), rel=1e-12) and sum(met) < 350 * 200


def test_families_of_surfaces(spark):
    """By plain loops over the corners; inside of one footprint of a family is inside of the union."""
    base = S.prisms_of(spark.createDataFrame([("09", 0.0, 0.0, 1.0, 0.0, 3000.0)], "end_id string, x0 double, y0 double, ux double, uy double, length double"), airport=False)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([(-500, 0), (1500, 400), (1500, 100), (-5000, 900), (4000, -300), (20000, 0), (-2000, 20)])], "id long, x double, y double")
    found = {r["id"]: r for r in S.family_distances(points, base, ["id"], {"d_all": None, "d_runway": ["strip"], "d_air": ["approach", "takeoff"], "d_none": ["moon"]}).collect()}
    rows = base.collect()

    def away(x, y, surfaces):
        best = math.inf
        for r in rows:
            if surfaces is None or r["surface"] in surfaces:
                c = [(p["x"], p["y"]) for p in r["ring"]]
                n, inside = len(c), False
                for (ax, ay), (bx, by) in zip(c, c[1:] + c[:1], strict=True):
                    t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / max(1e-12, (bx - ax) ** 2 + (by - ay) ** 2)))
                    best = min(best, math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
                    inside ^= ((ay > y) != (by > y)) and x < ax + (y - ay) * (bx - ax) / ((by - ay) or 1)
                best = 0.0 if inside and n else best
        return best

    for r in points.collect():
        for column, surfaces in (("d_all", None), ("d_runway", ["strip"]), ("d_air", ["approach", "takeoff"]), ("d_none", ["moon"])):
            assert found[r["id"]][column] == pytest.approx(away(r["x"], r["y"], surfaces))
    assert found[2]["d_runway"] == 0 and found[0]["d_air"] == 0 < found[5]["d_air"] and found[0]["d_none"] == math.inf


def test_drawn_flights_follow_their_distributions(spark):
    n, n_slices, n_ports = 4000, 12, 3
    slices = spark.range(n_slices).select(F.col("id").alias("slice_no"), (F.col("id") * 900_000_000 + 450_000_000).alias("t"))
    ports = spark.createDataFrame([(k, 1000.0 * k, -500.0 * k, 10.0 * k) for k in range(n_ports)], "port_no long, px double, py double, pz double")
    draw = lambda frame: M.draw_flights(spark, n, frame, n_slices, ports, n_ports, 10_000.0, 200.0, 3_500.0, funnel=(8.0, 80.0, 300.0)).collect()
    rows = draw(slices)
    assert sorted(r["seg_id"] for r in rows) == list(range(n))
    assert sorted(rows, key=lambda r: r["seg_id"]) == sorted(draw(slices.repartition(5)), key=lambda r: r["seg_id"])
    counts = [sum(r["slice_no"] == k for r in rows) for k in range(n_slices)]
    assert min(counts) > n / n_slices * 0.75 and max(counts) < n / n_slices * 1.25
    climb, descent = M.angle_limits()
    heights, shares = [], []
    for r in rows:
        px, py, pz = 1000.0 * r["port_no"], -500.0 * r["port_no"], 10.0 * r["port_no"]
        h, away = (r["z0"] - pz) / 300, math.hypot(r["x0"] - px, r["y0"] - py)
        radius = 8 + 72 * h
        assert -1e-6 <= h <= 1 + 1e-6 and away <= radius + 0.01
        heights.append(((8 + 72 * h) ** 3 - 8**3) / (80**3 - 8**3))
        shares.append((away / radius) ** 2)
        flat = math.hypot(r["x1"] - r["x0"], r["y1"] - r["y0"])
        assert flat >= 200 and -descent <= math.degrees(math.atan2(r["z1"] - r["z0"], flat)) <= climb
        length, middle = math.dist((r["x0"], r["y0"], r["z0"]), (r["x1"], r["y1"], r["z1"])), r["slice_no"] * 900_000_000 + 450_000_000
        assert (r["t1"] - r["t0"]) / 1e6 == pytest.approx(length / 67, abs=1e-5) and middle - 450_000_000 <= r["t0"] and (r["t1"] <= middle + 450_000_002 or length / 67 > 900)
    assert np.mean(shares) == pytest.approx(0.5, abs=0.03) and abs(np.corrcoef(heights, shares)[0, 1]) < 0.06
    assert len({(r["x0"], r["y0"]) for r in rows}) > n * 0.99
    with pytest.raises(Exception, match="no fitting draw"):
        M.draw_flights(spark, 50, slices, n_slices, ports, n_ports, 10_000.0, 200.0, 3_500.0, least_m=1e9).collect()


GRID = {"x_min": 0.0, "y_min": 0.0, "z_min": 0.0, "dx": 1.0, "dy": 1.0, "dz": 1.0, "nx": 64, "ny": 64, "nz": 8}


def test_sliced_fields_are_read_by_box(spark, tmp_path):
    """A small box of one slice meets the statistics of few files; what it reads is right."""
    import pyarrow.parquet as pq

    n = 64 * 64 * 8
    v = spark.range(2 * n).select((F.col("id") % 2).alias("slice"), (F.expr("id div 2") % 64).alias("ix"), (F.expr("id div 128") % 64).alias("iy"), (F.expr("id div 8192") % 8).alias("iz"), F.col("id").alias("v"))
    K.write_slices(v.repartition(7), GRID, str(tmp_path / "f"), file_voxels=2048)
    box = {"ix": (3, 9), "iy": (40, 47), "iz": (2, 3)}
    found = R.voxel_box(spark, str(tmp_path / "f"), box, (1, 1))
    expected = v.where("slice = 1 and ix between 3 and 9 and iy between 40 and 47 and iz between 2 and 3")
    assert sorted(r["v"] for r in found.collect()) == sorted(r["v"] for r in expected.collect()) and found.count() == 7 * 8 * 2
    files = sorted((tmp_path / "f" / "voxels").glob("slice=1/*.parquet"))
    met = 0
    for f in files:
        groups = pq.ParquetFile(f).metadata
        for g in range(groups.num_row_groups):
            stats = {groups.row_group(g).column(c).path_in_schema: groups.row_group(g).column(c).statistics for c in range(groups.num_columns)}
            met += all(stats[c].min <= high and stats[c].max >= low for c, (low, high) in box.items())
    assert len(files) >= 16 and 1 <= met <= 4
    assert sorted(r["v"] for r in R.voxels_under(spark, str(tmp_path / "f"), "v", 20.0, {"ix": (0, 3)}).collect()) == list(range(8))
    assert R.voxel_slice(spark, str(tmp_path / "f" / "voxels"), 5).select("slice").distinct().collect()[0][0] == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ix)" in plan and "PartitionFilters: [isnotnull(slice" in plan


def test_places_on_the_curve_are_apart(spark):
    rows = spark.range(8 * 8 * 8).select((F.col("id") % 8).alias("ix"), (F.expr("id div 8") % 8).alias("iy"), F.expr("id div 64").alias("iz"))
    got = {r["c"]: (r["ix"], r["iy"], r["iz"]) for r in rows.withColumn("c", K.curve("ix", "iy", "iz")).collect()}
    assert sorted(got) == list(range(512)) and {got[k] for k in range(8)} == {(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)}


@pytest.mark.parametrize("absent", ["events", "lineitem"])
def test_indicators_of_absent_tables_are_null(spark, sf, tmp_path, absent):
    import os

    from skylattice.plans import airspace

    for f in os.listdir(sf):
        if f != f"{absent}.parquet":
            os.symlink(f"{sf}/{f}", tmp_path / f)
    rows = airspace.kpi_table(spark, str(tmp_path)).collect()
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert len(rows) == n
    null = {"events": ["min_lateral_nm", "min_vertical_ft", "reliability_pct"], "lineitem": ["violation_rate", "min_lateral_nm", "ops_per_hour"]}[absent]
    assert all(r[c] is None for r in rows if r["feasible"] for c in null)


def test_configuration_is_bounded_in_the_plan_that_uses_it(spark):
    df = spark.range(10)
    assert df.join(J.configured(spark.range(3)), "id").count() == 3 and J.configured(spark.range(0)).count() == 0
    with pytest.raises(Exception, match="no configuration"):
        df.crossJoin(J.configured(spark.range(7).withColumnRenamed("id", "k"), 6)).collect()


def test_stray_times_leave_slices_near_their_size(spark, monkeypatch):
    """One time in 1970 and one far ahead; the others lie within a minute."""
    monkeypatch.setattr(J, "SLICE_ROWS", 100)
    rng = random.Random(3)
    times = [rng.randrange(1_700_000_000, 1_700_000_060) for _ in range(1000)]
    left = spark.createDataFrame([(i, t) for i, t in enumerate([*times[:500], 5])], "id int, t long")
    right = spark.createDataFrame([(i, t, i) for i, t in enumerate([*times[500:], 0, 9_999_999_999])], "k int, t long, v int")
    counts = [r["count"] for r in left.select("t").unionByName(right.select("t")).groupBy(J.slice_of(left, right, "t")).count().collect()]
    assert len(counts) >= 7 and max(counts) < 250
    facts = [(r["t"], r["k"]) for r in right.collect()]
    for r in J.asof_nearest(left, right, "t", [], ["v"], "k").collect():
        assert abs(facts[r["v"]][0] - r["t"]) == min(abs(t - r["t"]) for t, _ in facts)


def test_calibration_uses_scores_that_no_fold_trained_on(spark, tmp_path):
    """The label is the day's own coin, which only a model that saw the day could know, plus what x tells."""
    rng = np.random.default_rng(1)
    days = {d: int(rng.integers(0, 2)) for d in range(30)}
    rows = [(i, int(d), float(x), float(d), int((x > 0.5) if rng.random() < 0.7 else days[int(d)])) for i, (d, x) in enumerate(zip(rng.integers(0, 30, 900), rng.random(900), strict=True))]
    df = spark.createDataFrame(rows, "id int, day int, x double, d double, y int").repartition(4)
    scored = M.out_of_fold(df, ["x", "d"], "y", "day", 3, "lr").cache()
    assert scored.count() == 900 and scored.select("id").distinct().count() == 900
    model, half = M.fit_calibrated(df, ["x", "d"], "y", "day", 3, 0.1, "lr")
    errors = sorted(abs(r["p"] - r["y"]) for r in scored.collect())
    assert half == pytest.approx(errors[math.ceil(899 * math.ceil(901 * 0.9) / 900)])
    M.save_calibrated(model, half, str(tmp_path / "m"), spark)
    again, same = M.load_calibrated(str(tmp_path / "m"), spark)
    assert same == half
    cover = M.with_interval(M.score(again, df), same, "y").agg(F.avg(F.col("covered").cast("double"))).first()[0]
    assert 0.85 <= cover <= 0.97


def test_single_day_is_held_out_by_hash(spark):
    one = spark.range(2000).withColumn("day", F.lit(3))
    share = W.temporal_holdout(one, "day", ["id"]).agg(F.avg(F.col("held_out").cast("double"))).first()[0]
    assert 0.16 < share < 0.24
    two = spark.range(10).withColumn("day", F.col("id") % 2)
    assert {(r["day"], r["held_out"]) for r in W.temporal_holdout(two, "day", ["id"]).collect()} == {(0, False), (1, True)}


def test_risk_of_voxels_follows_what_the_model_learned(spark, sf):
    from skylattice.plans import models

    rows = models.risk_field(spark, sf).collect()
    n = len({(r["ix"], r["iy"], r["iz"]) for r in rows})
    assert len(rows) == 24 * n and all(0 <= r["low"] <= r["risk"] <= r["high"] <= 1 for r in rows)
    truth = [(r["iz"] * 150 + 75 + (r["ix"] * 1000 - 9500) / 20 > 900, r["risk"] > 0.5) for r in rows]
    assert sum(a == b for a, b in truth) / len(truth) > 0.9


def test_indicators_of_paths_share_one_shuffle_of_their_keys(spark, sf):
    """Safety, capacity and access order the same paths: one shuffle of waypoints by path, reused; closures are shuffled as numbers."""
    from skylattice.plans import airspace, spatial

    found = airspace.corridor_safety(spark, sf).join(airspace.corridor_capacity(spark, sf), "path").join(airspace.corridor_access(spark, sf), "path")
    assert found.count() > 0 and len(found.collect()) == found.select("path").distinct().count()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line]
    assert sum("ReusedExchange" not in line for line in dealt) == 1 and sum("ReusedExchange" in line for line in dealt) >= 3
    closures = spatial.voxel_closure_rate(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in closures and "collect_set" not in closures


def test_table_of_indicators_shuffles_paths_once(spark, sf):
    """Margins and crossings use the shared shuffle of keys by path too, and closures are shuffled once for both of their uses."""
    from skylattice.plans import airspace, spatial

    found = airspace.corridor_safety(spark, sf).join(spatial.crossings_sign(spark, sf), "path", "left")
    assert found.count() > 0 and len(found.collect()) > 0
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert sum("REPARTITION_BY_COL" in line and "ReusedExchange" not in line for line in plan.splitlines()) == 1
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(path" in line and "REPARTITION_BY_COL" not in line]
    table = airspace.kpi_table(spark, sf)
    assert len(table.collect()) > 0
    plan = table._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    assert len([line for line in plan if "partial_bit_or(uses" in line]) == 1
