"""Planted truths and brute-force checks of operators on small rows."""

from __future__ import annotations

import gzip
import io
import json
import math
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import exprs as X
from skylattice.operators import aggs as A
from skylattice.operators import joins as J
from skylattice.operators import planner as P
from skylattice.operators import risk as M
from skylattice.operators import surfaces as S
from skylattice.operators import voxels as V
from skylattice.operators import windows as W
from skylattice.sources import readers as R
from skylattice.sources import sinks as K
from skylattice.streaming import streams as T


def test_asof_nearest_matches_brute_force(spark):
    rng = random.Random(1)
    right = [(k, rng.randrange(60), rng.choice("ab")) for k in range(40)]
    left = [(k, rng.randrange(60), rng.choice("abc")) for k in range(60)]
    a = spark.createDataFrame(left, "id long, t long, g string")
    b = spark.createDataFrame(right, "rid long, t long, g string")
    for tolerance, slice_ in ((None, 10), (3, 7), (None, 1000)):
        got = {r["id"]: r["rid"] for r in J.asof_nearest(a, b, "t", ["g"], ["rid"], "rid", tolerance, slice_).collect()}
        for k, t, g in left:
            same = [r for r in right if r[2] == g and (tolerance is None or abs(r[1] - t) <= tolerance)]
            near = min((abs(r[1] - t) for r in same), default=None)
            if near is None:
                assert got[k] is None
                continue
            back = [r[0] for r in same if r[1] == t - near]
            assert got[k] == (max(back) if back else min(r[0] for r in same if r[1] == t + near))


def test_outliers_go_with_the_row_after_them(spark):
    rows = [("a", t * 1_000_000, z, 90.0) for t, z in enumerate([100.0, 110.0, 5110.0, 120.0, 130.0, -300.0, None, 140.0])]
    got = W.reject_outliers(spark.createDataFrame(rows, "k string, t long, z double, v double"), "k", "t", "z", "v")
    assert sorted(r["t"] // 1_000_000 for r in got.collect()) == [0, 1, 4, 6, 7]


def test_winners_share_and_ties(spark):
    df = spark.createDataFrame([(1, "b", 3), (1, "a", 3), (1, "c", 1), (2, "x", 9)], "s long, i string, n long")
    got = {r["s"]: (r["active"], r["top_share"]) for r in W.winners(df, ["s"], "i", "n").collect()}
    assert got == {1: (["a", "b"], pytest.approx(3 / 7)), 2: (["x"], 1.0)}


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(33.9 + k * 0.11, -118.4 + k * 0.13) for k in range(-4, 5)], "lat double, lon double")
    e, n = X.to_local(F.col("lat"), F.col("lon"), 33.9425, -118.4081)
    back = df.withColumns({"e": e, "n": n})
    lat, lon = X.from_local(F.col("e"), F.col("n"), 33.9425, -118.4081)
    for r in back.select("lat", "lon", lat.alias("a"), lon.alias("o"), "e", "n").collect():
        assert abs(r["a"] - r["lat"]) < 1e-6 and abs(r["o"] - r["lon"]) < 1e-6
        h = 2 * 6371000 * math.asin(math.sqrt(math.sin(math.radians(r["lat"] - 33.9425) / 2) ** 2 + math.cos(math.radians(r["lat"])) * math.cos(math.radians(33.9425)) * math.sin(math.radians(r["lon"] + 118.4081) / 2) ** 2))
        assert math.hypot(r["e"], r["n"]) == pytest.approx(h, rel=0.01)


def test_bearings_wrap(spark):
    row = spark.range(1).select(X.bearing(F.lit(-1.0), F.lit(0.0)).alias("w"), X.turn(F.lit(350.0), F.lit(10.0)).alias("t"), X.circular_mean(F.lit(359.0)).alias("m")).first()
    assert (row["w"], row["t"]) == (270.0, -20.0) and row["m"] == pytest.approx(359.0)


def test_weather_fields_and_rules(spark):
    lines = ["KLAX 011253Z VRB04KT 1 1/2SM BR BKN007 OVC020 M05/M11 A2992", "KSFO 27015G25KT M1/4SM VV002 12/11 Q1013", "KXXX 09010KT 10SM FEW030 20/10 A3001", "nothing"]
    got = [r for r in R.weather_lines(spark.createDataFrame([(x,) for x in lines], "raw string"), "raw").collect()]
    by = {r["raw"][:4]: r for r in got}
    a, b, c, d = (by[x[:4]] for x in lines)
    assert (a["wind_dir_deg"], a["wind_kt"], a["vis_sm"], a["ceiling_ft"], a["temp_c"], a["flight_rule"]) == (None, 4, 1.5, 700, -5, "IFR")
    assert a["altim_hpa"] == pytest.approx(1013.2, abs=0.1) and (b["wind_gust_kt"], b["vis_sm"], b["altim_hpa"], b["flight_rule"]) == (25, 0.25, 1013, "LIFR")
    assert (c["ceiling_ft"], c["flight_rule"]) == (None, "VFR") and d["flight_rule"] == ""
    imc = spark.range(1).select(X.instrument_weather(F.lit(None).cast("double"), F.lit(900.0), F.lit(None).cast("string")).alias("a"), X.instrument_weather(F.lit(10.0), F.lit(None).cast("double"), F.lit("VFR")).alias("b")).first()
    assert imc["a"] and not imc["b"]


def test_prisms_enclose_what_they_should(spark):
    ends = spark.createDataFrame([("09", 0.0, 0.0, 1.0, 0.0, 3000.0)], "end_id string, x0 double, y0 double, ux double, uy double, length double")
    prisms = S.prisms_of(ends, airport=False)
    points = spark.createDataFrame([(0, -1060.0, 0.0, 10.0), (1, -1060.0, 0.0, 30.0), (2, -1060.0, 400.0, 5.0), (3, 4060.0, 0.0, 10.0), (4, 1500.0, 300.0, 10.0), (5, 1500.0, -300.0, 10.0), (6, 1500.0, 0.0, 0.0)], "id long, x double, y double, z double")
    got = {r["id"]: r for r in S.near_prisms(points, prisms, ["id"]).collect()}
    assert [got[k]["n_inside"] > 0 for k in range(7)] == [True, False, False, True, True, True, True]
    assert got[1]["sd"] == pytest.approx(30 - 20.0) and got[2]["sd"] == pytest.approx(100.0 * math.cos(math.atan(0.15)))
    subset = S.active_prisms(prisms, [], None)
    less = {r["id"]: r["sd"] for r in S.near_prisms(points, subset, ["id"]).collect()}
    assert all(less[k] >= got[k]["sd"] - 1e-9 for k in less)
    around = spark.createDataFrame(S.round_prisms(), S.PRISM)
    away = {(r["surface"], r["id"]): r["sd"] for r in S.prism_distances(spark.createDataFrame([(0, 0.0, 0.0, 40.0), (1, 3900.0, 0.0, 0.0), (2, 5000.0, 0.0, 95.0), (3, 0.0, 6003.0, 140.0)], "id long, x double, y double, z double"), around, ["id"]).collect()}
    assert away["inner_horizontal", 0] == -5.0 and away["inner_horizontal", 1] == 0.0 and away["inner_horizontal", 2] == pytest.approx(math.hypot(1000, 50))
    assert away["conical", 2] == pytest.approx(0.0) and away["conical", 1] == 100.0 and away["conical", 3] == pytest.approx(3.0)
    assert {r["surface"] for r in S.prisms_of(ends).collect()} == {"approach", "takeoff", "transitional", "strip", "resa", "ofz_inner_approach", "ofz_inner_transitional", "inner_horizontal", "conical"}
    ring = [r["ring"] for r in prisms.collect()]
    assert all(sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(r, r[1:] + r[:1], strict=True)) > 0 for r in ring)


def test_smoothing_keeps_mass_and_matches_a_dense_kernel(spark):
    rows = [(0, 2, 1, 5.0), (3, 3, 0, 2.0), (4, 0, 2, 1.0)]
    got = V.smooth(spark.createDataFrame(rows, "ix long, iy long, iz long, v double"), "v", {"ix": 5, "iy": 4, "iz": 3}, {"ix": 1.0, "iy": 0.5, "iz": 0.5}, [])
    dense = np.zeros((5, 4, 3))
    for i, j, k, v in rows:
        dense[i, j, k] = v
    for axis, s in enumerate((1.0, 0.5, 0.5)):
        out = np.zeros_like(dense)
        for d, w in V.kernel(s):
            at = np.clip(np.arange(dense.shape[axis]) - d, 0, dense.shape[axis] - 1)
            out += w * np.take(dense, at, axis)
        dense = out
    for r in got.collect():
        assert r["v"] == pytest.approx(dense[r["ix"], r["iy"], r["iz"]])


def test_queue_matches_a_loop(spark):
    rng = random.Random(2)
    at = sorted(rng.uniform(0, 2000) for _ in range(60))
    df = spark.createDataFrame([("k", i, a, 60.0) for i, a in enumerate(at)], "k string, i long, a double, s double")
    got = [r["wait"] for r in W.fifo_waits(df, ["k"], ["i"], "a", "s").orderBy("i").collect()]
    free = 0.0
    for a, w in zip(at, got, strict=True):
        assert w == pytest.approx(max(free - a, 0.0), abs=1e-6)
        free = max(free, a) + 60


def test_order_statistics_and_metrics(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.random(101), 2)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    q = A.higher_quantile(df, "v", F.lit(0.9)).first()
    assert (q["n"], q["quantile"]) == (101, np.quantile(values, 0.9, method="higher"))
    y = rng.integers(0, 2, 101)
    m = A.ranking_metrics(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, values, strict=True)], "y int, p double"), "y", "p").first()
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in values[y == 1] for b in values[y == 0]])
    assert m["auroc"] == pytest.approx(auc) and 0 < m["average_precision"] <= 1
    one = A.ranking_metrics(spark.createDataFrame([(1, 0.5)], "y int, p double"), "y", "p").first()
    assert one["auroc"] is None


def test_monotone_skips_missing(spark):
    rows = [("a", 0, 0.3), ("a", 1, 0.2), ("a", 2, None), ("a", 3, 0.05), ("b", 0, 0.1), ("b", 1, 0.2), ("c", 2, 1.0)]
    got = {r["g"]: r["monotone"] for r in A.monotone(spark.createDataFrame(rows, "g string, b int, v double"), ["g"], "b", "v").collect()}
    assert got == {"a": True, "b": False, "c": True}


def grid(spark, blocked=(), closed=()):
    rows = [(0, i, j, k, -50.0 if (i, j) in blocked else 500.0, (i, j) not in closed, 0.7 if 4 <= i < 6 else 0.0) for i in range(12) for j in range(12) for k in range(3)]
    return spark.createDataFrame(rows, "query long, ix int, iy int, iz int, sdf double, open boolean, risk double")


def test_planner_is_short_detours_and_respects_gates(spark):
    ask = spark.createDataFrame([(0, 1, 1, 1, 10, 10, 1)], "query long, s_ix int, s_iy int, s_iz int, g_ix int, g_iy int, g_iz int")
    cell = (200.0, 200.0, 60.0)

    def planned(baseline, **k):
        return P.plan(ask, grid(spark, **k), cell, baseline, P.Vehicle(descent_limit=None)).first()

    free = planned("B3")
    assert free["feasible"] and free["n_waypoints"] == 10
    wall = {(5, j) for j in range(11)}
    around = planned("B2", blocked=wall)
    assert around["feasible"] and around["n_waypoints"] > 10 and all((p["ix"], p["iy"]) not in wall for p in around["path"])
    assert planned("B3", closed={(5, j) for j in range(12)})["feasible"] is False
    assert planned("B2", closed={(5, j) for j in range(12)})["feasible"] is True


def test_snapping_looks_around_a_cell_once_and_broadcasts_no_rings(spark):
    asks = spark.range(2_000).select(F.col("id").alias("query"), (F.col("id") % 3).alias("ix"), (F.col("id") % 2).alias("iy"), F.lit(0).cast("long").alias("iz"))
    free = spark.createDataFrame([(4, 0, 0), (0, 2, 1), (9, 9, 9)], "ix long, iy long, iz long")
    found = P.snap(asks, free, "query", 2)
    assert found._jdf.queryExecution().sparkPlan().toString().count("Generate explode") == 1
    joins = [x for x in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x]
    assert any("SortMergeJoin" in x for x in joins)
    got = {(r["query"], r["ix"], r["iy"], r["iz"], r["ring"]) for r in found.collect()}

    def best(q):
        offsets = [(tuple(a - b for a, b in zip(f, (q % 3, q % 2, 0), strict=True)), f) for f in ((4, 0, 0), (0, 2, 1), (9, 9, 9))]
        return min(((max(map(abs, o)), o, f) for o, f in offsets if max(map(abs, o)) <= 2), default=None)

    assert got == {(q, *b[2], b[0]) for q in range(2_000) if (b := best(q))}


def test_planner_cost_is_least_without_turns():
    import heapq

    import pandas as pd

    rng = random.Random(4)
    rows = [(i, j, 0, rng.choice([-1.0, 900.0, 900.0, 200.0]), True, rng.random()) for i in range(7) for j in range(7)]
    frame = pd.DataFrame(rows, columns=["ix", "iy", "iz", "sdf", "open", "risk"])
    w, v = P.Weights(turn=0.0), P.Vehicle()
    cells = {(r[0], r[1]): r for r in rows}
    start, goal = next(k for k in cells if cells[k][3] > 0), next(k for k in reversed(cells) if cells[k][3] > 0)
    _, cost, _ = P.search(frame, (*start, 0), (*goal, 0), (200.0, 200.0, 60.0), P.BASELINES["B4"], v, w)
    best, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, (i, j) = heapq.heappop(heap)
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                n = cells.get((i + a, j + b))
                if (a or b) and n and n[3] > 0:
                    dt = 200 * math.hypot(a, b) / v.cruise
                    c = d + dt + w.energy * v.cruise_w * dt + w.risk * n[5] * dt + w.impact * min(max(1 - n[3] / w.far_m, 0), 1)
                    if c < best.get((i + a, j + b), math.inf) - 1e-12:
                        best[i + a, j + b] = c
                        heapq.heappush(heap, (c, (i + a, j + b)))
    assert cost == pytest.approx(best.get(goal, math.inf))


def farthest_first(line: list, epsilon: float) -> list:
    """Line simplification by its recursive definition, in plain Python."""
    (ax, ay), (bx, by) = line[0], line[-1]
    size = math.hypot(bx - ax, by - ay)
    off = [abs((x - ax) * (by - ay) - (y - ay) * (bx - ax)) / size if size else math.hypot(x - ax, y - ay) for x, y in line]
    far = max(range(len(line)), key=lambda k: (off[k] if 0 < k < len(line) - 1 else -1.0, -k))
    if len(line) < 3 or off[far] <= epsilon:
        return [line[0], line[-1]]
    return farthest_first(line[: far + 1], epsilon)[:-1] + farthest_first(line[far:], epsilon)


@pytest.mark.parametrize("epsilon", [0.5, 5.0, 15.0, 60.0])
def test_simplified_lines_stay_within_epsilon(spark, epsilon):
    rng = np.random.default_rng(5)
    lines = [np.cumsum(rng.normal(0, 10, (n, 2)), axis=0) for n in (2, 3, 60, 200)] + [np.array([[0.0, 0], [5, 5], [0, 0]])]
    for line in lines:
        keep = P.simplify_line(line, epsilon)
        assert [tuple(p) for p in line[keep]] == [tuple(p) for p in farthest_first([tuple(p) for p in line], epsilon)]
        ends = np.flatnonzero(keep)
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            chord = line[b] - line[a]
            if np.hypot(*chord):
                assert (np.abs((line[a : b + 1] - line[a]) @ np.array([chord[1], -chord[0]])) / np.hypot(*chord) <= epsilon + 1e-9).all()
    assert P.simplify_line(np.array([[0, 0], [1, 0], [2, 0.0]]), 0.1).tolist() == [True, False, True]
    rows = [(k, i, float(x), float(y)) for k, line in enumerate(lines) for i, (x, y) in enumerate(line)]
    found = P.simplify(spark.createDataFrame(rows, "k int, i int, x double, y double").repartition(3), "k", ["i"], epsilon).collect()
    assert sorted((r["k"], r["i"]) for r in found) == [(k, int(i)) for k, line in enumerate(lines) for i in np.flatnonzero(P.simplify_line(line, epsilon))]


def test_segments_do_not_depend_on_partitions_and_models_learn(spark):
    slices = spark.createDataFrame([(k, f"s{k}") for k in range(7)], "slice_no long, name string")
    a, b = (sorted(map(tuple, M.sample_segments(s, 50, 5000.0, 100.0, 400.0).drop("name").collect())) for s in (slices, slices.repartition(5)))
    assert a == b and len(a) >= 45
    flags = {"adsb_near": F.lit(True), "sdf_buffer": F.lit(True), "axis_cross": F.lit(False)}
    assert spark.range(1).select(M.cause(flags).alias("c")).first()["c"] == "adsb_near,sdf_buffer"
    df = spark.range(600).select(X.uniform("id").alias("f"), X.uniform("id", salt=1).alias("g")).withColumn("conflict", (F.col("f") > 0.5).cast("int"))
    for kind in ("lr", "gbt"):
        scored = M.score(M.train(df, ["f", "g"], "conflict", kind), df)
        assert M.evaluate(scored.select("conflict", "p"), "conflict").first()["auroc"] > 0.95
    covered = M.calibrated(scored.select("conflict", "p"), scored.select("conflict", "p"), "conflict").agg(F.avg(F.col("covered").cast("double"))).first()[0]
    assert covered >= 0.88


def test_readers_of_files(spark, tmp_path):
    trace = {"icao": "ABC123", "r": "N1", "timestamp": 1000.0, "trace": [[0.5, 33.9, -118.4, 1000, 100.0, 90.0, 0, 64], [5, 34.0, -118.5, "ground", None, None, 0, None]]}
    with tarfile.open(tmp_path / "day.tar", "w") as tar:
        for name, body in (("a.json", gzip.compress(json.dumps(trace).encode())), ("bad.json", b"\x1f\x8bnot gzip"), ("c.json", b"{broken")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    rows = R.trace_archives(spark, str(tmp_path / "day.tar")).orderBy("time_utc").collect()
    assert [(r["icao24"], r["on_ground"]) for r in rows] == [("abc123", False), ("abc123", True)]
    assert rows[0]["baro_alt_m"] == pytest.approx(304.8) and rows[1]["baro_alt_m"] is None
    assert R.trace_archives(spark, str(tmp_path / "day.tar"), (10, 11, 10, 11)).count() == 0

    (tmp_path / "wx.csv").write_text("#comment\nstation,valid,drct,sknt,vsby,metar\nKLAX,2024-08-01 00:53,270,10,M,KLAX 27010KT 3SM OVC009 20/10 A2992\nKLAX,M,1,1,1,x\n")
    w = R.weather_archive(spark, str(tmp_path / "wx.csv")).collect()
    assert [(r["vis_sm"], r["ceiling_ft"], r["flight_rule"]) for r in w] == [(3.0, 900.0, "IFR")]

    (tmp_path / "od.csv").write_text("ItinID,Origin,Dest,Reporting_Airline,Passengers,MktFare,MktDistance,Quarter,Year\n1,LAX,SFO,AA,2.00,99.5,337,3,2024\n2,JFK,BOS,B6,x,1,1,3,2024\n3,SFO,LAX,UA,oops,10,337,3,2024\n")
    m = R.markets(spark, str(tmp_path / "od.csv"), ["LAX"]).orderBy("itin_id").collect()
    assert [(r["itin_id"], r["passengers"]) for r in m] == [(1, 2), (3, None)]

    (tmp_path / "obs.csv").write_text("OAS,LATDEC,LONDEC,TYPE,AGL,AMSL,LIGHTING\n06-000001,33.5,-118.0,TOWER,100,200,R\n")
    assert [(r["obstacle_id"], round(r["agl_m"], 2)) for r in R.obstacles(spark, str(tmp_path / "obs.csv")).collect()] == [("06-000001", 30.48)]

    extract = {"elements": [{"type": "way", "id": 5, "tags": {"building": "yes", "building:levels": "4"}, "geometry": [{"lat": 0.0, "lon": 0.0}, {"lat": 0.0, "lon": 2.0}, {"lat": 1.0, "lon": 2.0}, {"lat": 1.0, "lon": 0.0}, {"lat": 0.0, "lon": 0.0}]}, {"type": "node", "id": 6}]}
    b = R.buildings(spark.createDataFrame([(json.dumps(extract),)], "value string"), "value").collect()
    assert [(r["id"], r["height_m"], r["area_deg2"], r["closed"]) for r in b] == [(5, 12.0, 2.0, True)]

    df = spark.createDataFrame([("2024-08-01 00:00:00", " ABC ", "x", float("nan"), 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, True)], "time_utc string, icao24 string, callsign string, lon_wgs double, lat_wgs double, baro_alt_m double, geo_alt_m double, velocity_ms double, track_deg double, vert_rate_ms double, on_ground boolean")
    K.write_table(df.withColumn("time_utc", F.to_timestamp("time_utc")), str(tmp_path / "sv"))
    r = R.state_vectors(spark, str(tmp_path / "sv")).first()
    assert (r["icao24"], r["lon_wgs"], r["lat_wgs"]) == ("abc", None, 1.0)
    with pytest.raises(ValueError):
        K.write_table(df.drop("callsign"), str(tmp_path / "sv2"))
        R.state_vectors(spark, str(tmp_path / "sv2"))
    assert R.day_window("2024-08") == ["2024-08-02", "2024-08-09", "2024-08-16", "2024-08-23", "2024-08-30"] and len(R.day_window("2024-08-01..2024-08-03")) == 3


def test_sinks_and_corridors(spark, tmp_path):
    for name, body in (("B2_a", {"feasible": True, "baseline": "B2", "time_s": 10.0, "n_waypoints": 3}), ("B0_b", {"feasible": False, "baseline": "B0"})):
        (tmp_path / "corr" / "day").mkdir(parents=True, exist_ok=True)
        (tmp_path / "corr" / "day" / f"{name}.json").write_text(json.dumps(body, indent=1))
    got = {r["corridor_id"]: (r["feasible"], r["n_waypoints"]) for r in R.corridors(spark, str(tmp_path / "corr")).collect()}
    assert got == {"B2_a": (True, 3), "B0_b": (False, None)}
    df = spark.createDataFrame([(1, [(1.0, 2.0, 3.0)]), (2, [])], "id long, p array<struct<lon:double,lat:double,z:double>>")
    K.write_features(df, str(tmp_path / "geo"), "p", ["id"])
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "geo")).collect()]
    assert {x["properties"]["id"]: x["geometry"] and x["geometry"]["coordinates"] for x in lines} == {1: [[1.0, 2.0, 3.0]], 2: None}
    found = K.manifest(spark, str(tmp_path / "corr"), {"a": 1})
    assert [f["name"] for f in found["files"]] == ["B0_b.json", "B2_a.json"] and len(found["files"][0]["sha256"]) == 64
    old, new = spark.createDataFrame([(1, "old"), (2, "old")], "k int, s string"), spark.createDataFrame([(2, "new")], "k int, s string")
    assert sorted(map(tuple, K.merge_inventory(old, new, "k").collect())) == [(1, "old"), (2, "new")]


def test_streams_run_to_completion(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    events.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for k, out in enumerate((T.resampled(source, "ts", "user_id", "5 seconds", "1 minute", ["value"]), T.sessions(source, "ts", "user_id", "1 hour", "1 minute"), T.plausible(source, "ts", "user_id", "value"))):
        q = out.writeStream.outputMode("append").format("memory").queryName(f"s{k}").option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(f"s{k}").count() > 0


def test_planned_corridors_climb_over_closed_layers(spark, sf, monkeypatch):
    from skylattice.plans import models

    n = F.when((F.col("ix") == 10) & (F.col("iz") < 5), 24).otherwise(0)
    wall = spark.range(4800).select((F.col("id") % 20).alias("ix"), (F.floor(F.col("id") / 20) % 20).alias("iy"), F.floor(F.col("id") / 400).alias("iz")).withColumn("n", n)
    monkeypatch.setattr(models, "busy_grid", lambda spark, sf_dir: wall)
    got = {r["query"]: r["feasible"] for r in models.plan_paths(spark, sf).collect()}
    ends = {k: [(k * a % 20, k * 5 % 12) for a in (7, 13)] for k in got}
    assert any((a[0] < 10) != (b[0] < 10) for a, b in ends.values())
    assert all(got[k] == all(x != 10 or z >= 5 for x, z in e) for k, e in ends.items())


def test_queries_with_equal_ends_are_searched_once(spark):
    import pandas as pd

    grid = pd.DataFrame([(i, j, 0, 100.0 + 7 * i, i != 2 or j == 3, 0.1 * j) for i in range(5) for j in range(4)], columns=["ix", "iy", "iz", "sdf", "open", "risk"])
    rows = [(k, 0, k % 3, 0, 4 if k % 5 else 2, k % 2, 0) for k in range(40)] + [(7, 0, 0, 0, 1, 1, 0), (50, None, 0, 0, 1, 1, 0)]
    asks = spark.createDataFrame(rows, "query long, s_ix int, s_iy int, s_iz int, g_ix int, g_iy int, g_iz int")
    searches, answering = spark.sparkContext.accumulator(0), P.answering

    def counted(*a):
        answer = answering(*a)

        def one(ask, voxels):
            searches.add(len(ask))
            return answer(ask, voxels)

        return one

    cell, v = (100.0, 100.0, 10.0), P.Vehicle()
    want = P.answering(cell, P.BASELINES["B3"], v, P.Weights())(pd.DataFrame(rows[:-1], columns=asks.columns), grid)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(P, "answering", counted)
        got = P.plan_shared(asks, grid, cell, "B3", v).collect()
    plain = lambda r: (r["query"], r["feasible"], r["cost"], r["n_expansions"], r["n_waypoints"], [tuple(p) if not isinstance(p, dict) else tuple(p.values()) for p in r["path"]])
    expected = [plain({**r, "cost": None if r["cost"] != r["cost"] else r["cost"]}) for r in want.to_dict("records")] + [(50, False, None, 0, 0, [])]
    assert sorted(map(repr, map(plain, got))) == sorted(map(repr, expected))
    assert searches.value == len({r[1:] for r in rows[:-1]})


def test_forests_perceptrons_and_saved_models(spark, tmp_path):
    rows = [(float(k % 7), float(k % 5), int(k % 7 > 3)) for k in range(210)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    for kind in ("rf", "mlp"):
        model = M.train(df, ["a", "b"], "y", kind)
        p = {(r["a"], r["b"]): r["p"] for r in M.score(model, df).collect()}
        assert all((p[a, b] > 0.5) == bool(y) for a, b, y in rows), kind
    M.save(model, str(tmp_path / "model"))
    again = {(r["a"], r["b"]): r["p"] for r in M.score(M.load(str(tmp_path / "model")), df).collect()}
    assert again == pytest.approx(p)
    grid = M.score_grid(model, M.hourly_slices(spark, 10, 3), df.select("a", "b").distinct())
    assert grid.count() == 3 * 35 and {r["hour"] for r in grid.select("hour").distinct().collect()} == {10, 11, 12}


def test_angle_limits_and_draws_keep_them(spark):
    climb, descent = M.angle_limits()
    assert climb == pytest.approx(13.4934, abs=1e-3) and descent == pytest.approx(11.5370, abs=1e-3)
    slices = spark.range(3).withColumnRenamed("id", "slice_no")
    for r in M.sample_segments(slices, 60, 10_000.0, 0.0, 3000.0).collect():
        flat = math.hypot(r["x1"] - r["x0"], r["y1"] - r["y0"])
        angle = math.degrees(math.atan2(r["z1"] - r["z0"], flat))
        assert flat >= 200 and -descent <= angle <= climb


def test_runways_of_a_configuration(spark):
    rows = [{"id": "09", "thr_lat": 34.0, "thr_lon": -118.0, "end_lat": 34.0, "end_lon": -117.97, "bearing_deg": 90.0}]
    r = R.runway_frame(spark, rows, 34.0, -118.0).first()
    assert (r["x0"], r["y0"]) == pytest.approx((0, 0), abs=1e-6) and r["length"] == pytest.approx(2771, rel=2e-3)
    assert (r["ux"], r["uy"], r["px"], r["py"]) == pytest.approx((1, 0, 0, 1), abs=1e-3) and r["code_letter"] == "F"
    with pytest.raises(Exception, match="degenerate runway"):
        R.runway_frame(spark, [rows[0] | {"end_lon": -118.0}], 34.0, -118.0).collect()
    x, y, z = spark.range(1).select(*R.vertiport_anchor(F.lit(34.0), F.lit(-118.0), F.lit(100.0), 34.0, -118.0)).first()
    assert (x, y, z) == pytest.approx((0, 0, 60.48), abs=1e-6)


def test_three_layouts_of_runway_use_agree(spark):
    when = "2024-01-01 00:00:00"
    a = spark.createDataFrame([(when, "09;27", "09", "x")], "time_utc string, active_arrivals string, active_departures string, config_id string")
    b = spark.createDataFrame([(when, ["09", "27"], ["09"])], "slice_start string, arrivals_active array<string>, departures_active array<string>")
    c = spark.createDataFrame([(when, "09, 27", 7)], "time_utc string, active_runways string, config int")
    got = [R.runway_configs(x).first() for x in (a, b, c)]
    assert [r["active_arrivals"] for r in got] == ["09;27"] * 3 and [r["active_departures"] for r in got] == ["09", "09", "09;27"]
    assert [r["config_id"] for r in got] == ["x", "09;27|09", "7"]
    with pytest.raises(ValueError, match="neither"):
        R.runway_configs(spark.createDataFrame([("a",)], "active_runways string"))


def test_fields_slices_days_and_summaries(spark, tmp_path):
    grid = {"x_min": -1.0, "y_min": -2.0, "z_min": 0.0, "dx": 1.0, "dy": 1.0, "dz": 0.5, "nx": 2, "ny": 4, "nz": 3}
    K.write_voxels(spark.createDataFrame([(0, 1, 2, 5.0)], "ix long, iy long, iz long, sd double"), grid, str(tmp_path / "field"))
    voxels, meta = R.voxel_table(spark, str(tmp_path / "field"))
    assert meta == grid and voxels.count() == 1
    spark.range(6).selectExpr("id", "id % 3 * 10 as slice").write.partitionBy("slice").parquet(str(tmp_path / "slices"))
    assert {r["slice"] for r in R.voxel_slice(spark, str(tmp_path / "slices"), 14).collect()} == {10}
    assert {r["slice"] for r in R.voxel_slice(spark, str(tmp_path / "slices"), 15).collect()} == {10}
    spark.range(2).write.parquet(str(tmp_path / "day" / "seg_2024-01-05.parquet"))
    named = spark.read.parquet(str(tmp_path / "day" / "seg_2024-01-05.parquet"))
    assert "sample_date" in R.with_sample_date(named).columns
    df, seen = K.counted(spark.range(10), "read", even=F.count_if(F.col("id") % 2 == 0))
    assert df.where("id > 4").count() == 5
    summary = K.write_summary(str(tmp_path / "run.json"), "run", [seen], day="2024-01-05")
    assert summary["stages"]["read"] == {"rows": 10, "even": 5} and json.loads((tmp_path / "run.json").read_text()) == summary


def test_map_shapes_and_peak_trips(spark):
    kind = "id long, type string, lon double, lat double, line array<struct<lon:double,lat:double>>"
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    rows = [(1, "node", 1.0, 2.0, None), (2, "way", None, None, square), (3, "way", None, None, square[:3]), (4, "way", None, None, square[:1]), (5, "relation", None, None, square)]
    assert {(r["id"], r["shape"]) for r in R.map_shapes(spark.createDataFrame(rows, kind)).collect()} == {(1, "point"), (2, "polygon"), (3, "line")}
    trips = R.peak_trips(spark, "LAX", 2024)
    total = trips.agg(F.sum("trips")).first()[0]
    shares = {int(r["peak_hour"][:2]): r["n"] / total for r in trips.where("direction = 'in'").groupBy("peak_hour").agg(F.sum("trips").alias("n")).collect()}
    assert trips.count() == 36 and shares == pytest.approx(R.peak_shares())


def test_snapshots_keep_what_they_can(spark):
    state = ["abc ", "CALL", "US", "1", "1", "-118.4", "33.9", "100", "true", "5", "90", "0", None, None, "7000"]
    rows = [(json.dumps({"time": 10, "states": [state, [*state[:5], None, *state[6:]]]}),), (json.dumps({"time": 10, "states": None}),), ("no json",)]
    got = R.enriched(R.snapshot_lines(spark.createDataFrame(rows, "value string"), "value"), 38.0, (33.9, -118.4)).collect()
    assert len(got) == 1 and (got[0]["icao24"], got[0]["z_msl_m"], got[0]["z_agl_m"], got[0]["on_ground"]) == ("abc", 100.0, 62.0, True)
    assert (got[0]["x_m"], got[0]["y_m"]) == pytest.approx((0, 0), abs=1e-6)
