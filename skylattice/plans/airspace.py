"""Fields, labels, envelopes and corridor indicators over the bundled tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..operators import aggs as A
from ..operators import joins as J
from ..operators import labels as L
from ..operators import planner as P
from ..operators import risk as M
from ..operators import surfaces as S
from ..operators import voxels as V
from ..operators import windows as W
from ..operators.proximity import count_around
from ..sources import readers as R
from . import kpis, spatial, tracks
from .bridge import ENDS, EPOCH, OBS, PATH_ORDER, SECOND, SLICE, SPAN, WAYPOINTS, WX, ends, obs, table, waypoints, wx
from .spatial import GRID, LOW, SEGMENTS, SHAPE, STEP, distances, segments

QUERIES, ORACLES = {}, {}
CELLS = SHAPE[0] * SHAPE[1] * SHAPE[2]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def grid(spark: SparkSession) -> DataFrame:
    """All voxels of the grid, with their centres."""
    cells = spark.range(CELLS).select((F.col("id") % 20).alias("ix"), (F.floor(F.col("id") / 20) % 20).alias("iy"), F.floor(F.col("id") / 400).alias("iz"))
    return cells.withColumns({"x": F.col("ix") * 1000.0 - 9500, "y": F.col("iy") * 1000.0 - 9500, "z": F.col("iz") * 150.0 + 75})


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ix, iy, iz, sd): signed distance to the protection surfaces, from a seed that nothing exceeds."""
    near = S.near_prisms(grid(spark), S.prisms_of(ends(spark, sf_dir)), V.KEY)
    return near.select(*V.KEY, F.least("sd", F.lit(SEED)).alias("sd"))


SEED = 5000.0
CENTRES = "grid as (select ix, iy, iz, ix * 400 + iy * 20 + iz as cell, ix * 1000.0 - 9500 as x, iy * 1000.0 - 9500 as y, iz * 150.0 + 75 as z from range(20) a(ix), range(20) b(iy), range(12) c(iz))"
FIELD = f"{CENTRES}, {distances('grid', 'cell')}, field as (select ix, iy, iz, least(min(sd), {SEED}) as sd from boxed join grid using (cell) group by all)"


@query(f"with {ENDS}, {GRID}, {FIELD} select f.ix, f.iy, f.iz, round(f.sd, 4) as sd, f.sd <= 0 as blocked, count(*) as n from inside i join field f on f.ix = i.ix and f.iy = i.iy and f.iz = i.iz group by all")
def voxel_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each voxel with traffic, its distance to the protection surfaces, and whether they block it."""
    busy = A.voxel_counts(obs(spark, sf_dir), [], LOW, STEP, SHAPE)
    return busy.join(field(spark, sf_dir), V.KEY).select(*V.KEY, F.round("sd", 4).alias("sd"), (F.col("sd") <= 0).alias("blocked"), "n")


@query(f"""with {ENDS}, {GRID}, {FIELD}, o as (select event_id, least(greatest((x + 10000) / 1000.0 - 0.5, 0), 19) as fx, least(greatest((y + 10000) / 1000.0 - 0.5, 0), 19) as fy, least(greatest(z / 150.0 - 0.5, 0), 11) as fz from obs),
i as (select *, least(floor(fx), 18) as bx, least(floor(fy), 18) as by_, least(floor(fz), 10) as bz from o), e(a, b, d) as (select * from range(2) t1(a), range(2) t2(b), range(2) t3(d)),
w as (select event_id, cast(bx + a as bigint) as ix, cast(by_ + b as bigint) as iy, cast(bz + d as bigint) as iz, (case when a = 1 then fx - bx else 1 - fx + bx end) * (case when b = 1 then fy - by_ else 1 - fy + by_ end) * (case when d = 1 then fz - bz else 1 - fz + bz end) as w from i, e),
c as (select event_id, sum(w * sd) as clearance from w join field using (ix, iy, iz) group by event_id) select event_id, round(clearance, 3) as clearance, round(clearance, 6) > 0 as clear from c""")
def point_clearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clearance of each observation, between the centres of the distance field."""
    found = V.trilinear(obs(spark, sf_dir).select("event_id", "x", "y", "z"), field(spark, sf_dir), "sd", LOW, STEP, SHAPE, ["event_id"])
    return found.select("event_id", F.round("sd", 3).alias("clearance"), (F.round("sd", 6) > 0).alias("clear"))


@query(f"""with {GRID}, v as (select ix, iy, iz, count(*) as n from inside group by all), d as (select *, ix * 1000.0 - 9500 - 500 as dx, iy * 1000.0 - 9500 as dy, iz * 150.0 + 75 as dz from v)
select ix, iy, iz, n, round(greatest(sqrt(dx * dx + dy * dy) - (8 + 72 * least(greatest(dz / 300, 0), 1)), -dz, dz - 300), 4) as sd, greatest(sqrt(dx * dx + dy * dy) - (8 + 72 * least(greatest(dz / 300, 0), 1)), -dz, dz - 300) < 0 as allowed from d""")
def funnel_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vertiport's funnel on the airport grid, at the voxels with traffic."""
    v = A.voxel_counts(obs(spark, sf_dir), [], LOW, STEP, SHAPE)
    sd = S.funnel_distance(F.col("ix") * 1000.0 - 10000, F.col("iy") * 1000.0 - 9500, F.col("iz") * 150.0 + 75)
    return v.withColumn("sd", sd).select(*V.KEY, "n", F.round("sd", 4).alias("sd"), (F.col("sd") < 0).alias("allowed"))


def active_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a few kilometres with their active ends; some have no arrival, some no departure end."""
    k = F.col("seg_id")
    seg = segments(spark, sf_dir).withColumns({"x1": F.col("x0") + 2000 - k * 13 % 4001, "y1": F.col("y0") + 2000 - k * 29 % 4001})
    return with_ends(spark, sf_dir, seg.withColumns({"arr_at": F.when(k % 7 > 0, k % 5), "dep_at": F.when(k % 11 > 0, (k * 3 + 2) % 5)}))


def with_ends(spark: SparkSession, sf_dir: str, seg: DataFrame) -> DataFrame:
    """seg with its active ends (by arr_at and dep_at, null for none) and its middle."""
    e = ends(spark, sf_dir)
    for p in ("arr", "dep"):
        seg = seg.join(L.ends_as(e, f"{p}_"), F.col(f"{p}_at") == F.col(f"{p}_pos"), "left")
    middle = {f"mid_{c}": (F.col(f"{c}0") + F.col(f"{c}1")) / 2.0 for c in "xyz"}
    return seg.withColumns(middle | {"mid_t": F.floor((F.col("t0") + F.col("t1")) / 2).cast("long")})


def volumes(x: str, y: str, z: str) -> dict[str, str]:
    """SQL of the tests and distances of a point against active ends a (arrival) and d (departure)."""
    def parts(p):
        return f"(({x} - {p}.x0) * {p}.ux + ({y} - {p}.y0) * {p}.uy)", f"(({y} - {p}.y0) * {p}.ux - ({x} - {p}.x0) * {p}.uy)"

    (aa, ac), (da, dc) = parts("a"), parts("d")
    s, q, m = f"(-{aa} - 60)", f"({da} - d.length - 60)", f"({aa} - a.length)"
    top = f"(least({s}, 3000) * 0.02 + greatest(least({s} - 3000, 3600), 0) * 0.025)"
    half, wide = f"(150 + greatest({s}, 0) * 0.15)", f"least(90 + greatest({q}, 0) * 0.125, 900)"
    climb = f"(greatest({q}, 0) * 0.02)"

    def away(s, c, half, top):
        return f"sqrt(pow(greatest(abs({c}) - {half}, 0), 2) + pow(greatest(-{s}, 0), 2) + pow(greatest({z} - case when {s} >= 0 then {top} else 0 end, 0), 2))"

    return {
        "approach": f"coalesce({s} between 0 and 15000 and abs({ac}) <= {half} and {z} between 0 and {top}, false)",
        "missed": f"coalesce({m} between 0 and 8000 and abs({ac}) <= 300 and {z} between 0 and {m} * 0.025, false)",
        "departure": f"coalesce({q} between 0 and 15000 and abs({dc}) <= {wide} and {z} between 0 and {climb}, false)",
        "d_approach": f"case when a.pos is not null then {away(s, ac, half, top)} end",
        "d_departure": f"case when d.pos is not null then {away(q, dc, wide, climb)} end",
    }


def axis_sql(p: str) -> str:
    c0, c1, a0, a1 = (f"((s.{u} - {p}.{a}) * {p}.u{b} {sign} (s.{v} - {p}.{c}) * {p}.u{d})" for u, a, b, sign, v, c, d in (("y0", "y0", "x", "-", "x0", "x0", "y"), ("y1", "y0", "x", "-", "x1", "x0", "y"), ("x0", "x0", "x", "+", "y0", "y0", "y"), ("x1", "x0", "x", "+", "y1", "y0", "y")))
    t = f"({c0} / nullif({c0} - {c1}, 0))"
    return f"coalesce({t} between 0 and 1 and {a0} + {t} * ({a1} - {a0}) between -200 and {p}.length + 200 and s.z0 + {t} * (s.z1 - s.z0) <= 609.6, false)"


ACT = f"""{SEGMENTS}, act as (select * replace (x0 + 2000 - seg_id * 13 % 4001 as x1, y0 + 2000 - seg_id * 29 % 4001 as y1), case when seg_id % 7 > 0 then seg_id % 5 end as arr_at, case when seg_id % 11 > 0 then (seg_id * 3 + 2) % 5 end as dep_at, (t0 + t1) // 2 as mid_t from segments)"""
AROUND = f"""runway as (select s.seg_id, min(sqrt(pow(al - least(greatest(al, 0), length), 2) + ac * ac + mz * mz)) as d_runway from (select seg_id, (x0 + x1) / 2.0 as mx, (y0 + y1) / 2.0 as my, (z0 + z1) / 2.0 as mz from act) s, lateral (select length, (mx - x0) * ux + (my - y0) * uy as al, (my - y0) * ux - (mx - x0) * uy as ac from ends) group by s.seg_id),
mids as (select s.*, (x0 + x1) / 2.0 as mx, (y0 + y1) / 2.0 as my, (z0 + z1) / 2.0 as mz, d_runway from act s join runway using (seg_id))"""
ACTIVE = f"{ENDS}, {OBS}, {ACT}, {AROUND}"
MID, SAMPLE = volumes("s.mx", "s.my", "s.mz"), volumes("(s.x0 + t * (s.x1 - s.x0))", "(s.y0 + t * (s.y1 - s.y0))", "(s.z0 + t * (s.z1 - s.z0))")
SD = f"coalesce(case when {MID['approach']} or {MID['missed']} or {MID['departure']} then -1 else 1 end * least({MID['d_approach']}, {MID['d_departure']}), d_runway)"


def labelled(spark: SparkSession, sf_dir: str, seg: DataFrame | None = None) -> DataFrame:
    """Causes of conflict of each segment, by default of the orders', and its distance to the active volumes halfway."""
    seg = active_segments(spark, sf_dir) if seg is None else seg
    mid = tuple(F.col(f"mid_{c}") for c in "xyz")
    runway = nearest_runway(spark, sf_dir, seg)
    traffic = J.near_moving(obs(spark, sf_dir), seg, "seg_id", 2778.0, 304.8, SLICE).withColumn("traffic", F.lit(True))
    seg = seg.join(traffic, "seg_id", "left").join(runway, "seg_id").withColumn("sdf_mid", L.active_distance(*mid, "arr_", "dep_", F.col("d_runway")))
    flags = {
        "adsb_near": F.coalesce("traffic", F.lit(False)),
        "axis_cross": L.crosses_axis("arr_") | L.crosses_axis("dep_"),
        "approach_prism": L.anywhere(L.in_approach, "arr_"),
        "departure_prism": L.anywhere(L.in_departure, "dep_"),
        "missed_approach": L.anywhere(L.in_missed, "arr_"),
        "sdf_buffer": F.col("sdf_mid") < L.BUFFER_M,
    }
    return seg.withColumns(flags).withColumn("cause", M.cause({c: F.col(c) for c in flags}))


def nearest_runway(spark: SparkSession, sf_dir: str, seg: DataFrame) -> DataFrame:
    """(seg_id, d_runway) from the middles of segments to any centre line."""
    pairs = seg.select("seg_id", "mid_x", "mid_y", "mid_z").crossJoin(L.ends_as(ends(spark, sf_dir), "any_"))
    return pairs.groupBy("seg_id").agg(F.min(L.axis_distance(F.col("mid_x"), F.col("mid_y"), F.col("mid_z"), "any_")).alias("d_runway"))


TRAFFIC = f"""b as (select seg_id, t0, t1, x0, x1, y0, y1, z0, z1, unnest(range(t0 // {SLICE}, t1 // {SLICE} + 1)) as bucket from act), ob as (select *, t // {SLICE} as slot from obs),
traffic as (select seg_id, bool_or(sqrt(pow(x - x0 - f * (x1 - x0), 2) + pow(y - y0 - f * (y1 - y0), 2)) < 2778 and abs(z - z0 - f * (z1 - z0)) < 304.8) as near from
  (select b.*, ob.x, ob.y, ob.z, (ob.t - t0) / (t1 - t0)::double as f from b join ob on slot = bucket and ob.t >= t0 and ob.t <= t1) group by seg_id)"""
CAUSES = f"""{TRAFFIC}, hits as (select s.seg_id, bool_or({SAMPLE['approach']}) as approach, bool_or({SAMPLE['departure']}) as departure, bool_or({SAMPLE['missed']}) as missed
  from mids s cross join (select i / 15.0::double as t from range(16) r(i)) left join ends a on a.pos = s.arr_at left join ends d on d.pos = s.dep_at group by s.seg_id),
flags as (select s.seg_id, coalesce(near, false) as near, {axis_sql('a')} or {axis_sql('d')} as axis, approach, departure, missed, {SD} as sd from mids s left join ends a on a.pos = s.arr_at left join ends d on d.pos = s.dep_at join hits h on h.seg_id = s.seg_id left join traffic q on q.seg_id = s.seg_id),
labelled as (select *, concat_ws(',', case when near then 'adsb_near' end, case when axis then 'axis_cross' end, case when approach then 'approach_prism' end, case when departure then 'departure_prism' end, case when missed then 'missed_approach' end, case when sd < 30 then 'sdf_buffer' end) as cause from flags)"""


LABELLED = f"{ACTIVE}, {CAUSES}"


@query(f"with {LABELLED} select seg_id, cause, cast(cause <> '' as integer) as conflict, round(sd, 3) as sdf_mid from labelled")
def segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("seg_id", "cause", (F.col("cause") != "").cast("int").alias("conflict"), F.round("sdf_mid", 3).alias("sdf_mid"))


#: Flights drawn for each time slice, and their box.
DRAWN_EACH, HALF_M, LOW_M, HIGH_M = 2, 10_000.0, 200.0, 3_500.0
U, V_ = (lambda salt: X.draw_sql("seg_id", "try_no", salt=salt)), (lambda salt: X.draw_sql("seg_id", salt=salt))
CLIMB, DESCENT = M.angle_limits()
DRAWN = f"""slices as (select slice, row_number() over (order by slice) - 1 as slice_no, slice * {SLICE} + {SLICE // 2} as t, case when slice % 7 > 0 then slice % 5 end as arr_at, case when slice % 11 > 0 then (slice * 3 + 2) % 5 end as dep_at from (select distinct t // {SLICE} as slice from obs)),
ports as (select n_nationkey as port_no, n_nationkey * 700 - 8400 as px, n_nationkey * 1100 % 9001 - 4500 as py, n_nationkey * 3 as pz from nation),
tries as (select *, cbrt({U(2)} * ({80.0**3 - 8.0**3}::double) + {8.0**3}::double) / 72::double - 8 / 72::double as h, 2 * pi() * {U(4)} as a from (select seg_id, try_no, cast(floor({U(1)} * (select count(*) from ports)) as bigint) as port_no from range((select {DRAWN_EACH} * count(*) from slices)) s(seg_id), range({M.TRIES}) r(try_no)) join ports using (port_no)),
spots as (select seg_id, try_no, port_no, round(px + sqrt({U(3)}) * (8 + 72 * h) * cos(a), 3) as x0, round(py + sqrt({U(3)}) * (8 + 72 * h) * sin(a), 3) as y0, round(pz + h * 300::double, 3) as z0,
  round(({U(5)} * 2 - 1) * {HALF_M}::double, 3) as x1, round(({U(6)} * 2 - 1) * {HALF_M}::double, 3) as y1, round({LOW_M}::double + {U(7)} * {HIGH_M - LOW_M}::double, 3) as z1 from tries),
fit as (select * from spots where sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) >= 200 and degrees(atan2(z1 - z0, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)))) between {-DESCENT!r}::double and {CLIMB!r}::double),
chosen as (select * from fit qualify row_number() over (partition by seg_id order by try_no) = 1),
timed as (select c.*, t, arr_at, dep_at, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2) + pow(z1 - z0, 2)) / 67.0::double as d from chosen c join slices on slice_no = cast(floor({V_(8)} * (select count(*) from slices)) as bigint)),
begun as (select *, t + cast(floor((case when d < 900 then {V_(9)} * (900::double - d) else 0 end - 450::double) * 1e6::double) as bigint) as t0 from timed),
ended as (select *, t0 + cast(floor(d * 1e6::double) as bigint) as t1 from begun),
act as (select * exclude (t), (t0 + t1) // 2 as mid_t from ended)"""


def drawn_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights drawn over the time slices that have traffic, from a vertiport for each nation, with the slices' active ends."""
    o = obs(spark, sf_dir).select(F.floor(F.col("t") / SLICE).cast("long").alias("slice")).distinct()
    k = F.col("slice")
    slices = W.running_sums(o.withColumn("one", F.lit(1)), "slice", {"nth": "one"}).select(
        (F.col("nth") - 1).alias("slice_no"), (k * SLICE + SLICE // 2).alias("t"), F.when(k % 7 > 0, k % 5).alias("arr_at"), F.when(k % 11 > 0, (k * 3 + 2) % 5).alias("dep_at"),
    )
    n = F.col("n_nationkey")
    ports = table(spark, sf_dir, "nation").select(n.cast("long").alias("port_no"), (n * 700 - 8400).alias("px"), (n * 1100 % 9001 - 4500).alias("py"), (n * 3).alias("pz"))
    n_slices, n_ports = o.count(), ports.count()
    return M.draw_flights(spark, DRAWN_EACH * n_slices, slices, n_slices, ports, n_ports, HALF_M, LOW_M, HIGH_M, SLICE / 1e6, funnel=(S.FUNNEL_LOW, S.FUNNEL_HIGH, S.FUNNEL_TOP))


@query(f"with {ENDS}, {OBS}, {DRAWN}, {AROUND}, {CAUSES} select l.seg_id, port_no, x0, z0, x1, z1, t0, t1, cause, cast(cause <> '' as integer) as conflict, round(sd, 3) as sdf_mid from labelled l join act using (seg_id)")
def sampled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights drawn out of funnels over all time slices, with their causes of conflict: sampling and labels in one plan."""
    found = labelled(spark, sf_dir, with_ends(spark, sf_dir, drawn_flights(spark, sf_dir)))
    return found.select("seg_id", "port_no", "x0", "z0", "x1", "z1", "t0", "t1", "cause", (F.col("cause") != "").cast("int").alias("conflict"), F.round("sdf_mid", 3).alias("sdf_mid"))


@query(f"with {LABELLED} select seg_id % 5 as config, count(*) as n, cast(count_if(cause <> '') as bigint) as n_conflict, round(avg(case when cause <> '' then 1.0 else 0.0 end), 6) as rate from labelled group by 1")
def conflict_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("cause") != ""
    return labelled(spark, sf_dir).groupBy((F.col("seg_id") % 5).alias("config")).agg(F.count("*").alias("n"), F.count_if(hit).alias("n_conflict"), F.round(F.avg(hit.cast("double")), 6).alias("rate"))


@query(f"""with {ACTIVE}, {WX}, wide as (select x, y, z, t, unnest([t // {300 * SECOND} - 1, t // {300 * SECOND}, t // {300 * SECOND} + 1]) as wt from obs),
dense as (select seg_id, count(*) as n from mids join wide w on w.wt = mid_t // {300 * SECOND} and abs(x - mx) < 1500 and abs(y - my) < 1500 and abs(z - mz) < 150 and abs(t - mid_t) <= {300 * SECOND} group by 1),
report as (select seg_id, arg_min({{'d': wind_dir, 's': event_id % 40, 'v': vis, 'c': ceil}}, (abs(m.mid_t - w.t), w.t, w.event_id)) as r from mids m, wx w group by seg_id)
select s.seg_id, round(abs({SD}), 3) as d_ols_m, round(d_runway, 3) as d_runway_m, round(coalesce({MID['d_approach']}, 1e6), 3) as d_approach_m, round(coalesce({MID['d_departure']}, 1e6), 3) as d_departure_m,
  round(coalesce(n, 0) / (9e6 * 300 * 600) * 1e12, 6) as traffic_density, round(sin(radians(r.d)), 6) as wind_dir_sin, round(cos(radians(r.d)), 6) as wind_dir_cos, round(r.s * 0.514444::double, 4) as wind_speed_mps, round(r.v * 1609.344::double, 3) as visibility_m, round(r.c * 0.3048::double, 3) as ceiling_m,
  round(sin(mid_t // 60000000 % 1440 / 60.0 * (2 * pi() / 24)), 6) as hour_sin, round(cos(mid_t // 60000000 % 1440 / 60.0 * (2 * pi() / 24)), 6) as hour_cos, {', '.join(f'cast(arr_at is not null and arr_at = {k} as integer) as cfg_{k}' for k in range(5))}
from mids s left join ends a on a.pos = s.arr_at left join ends d on d.pos = s.dep_at left join dense q on q.seg_id = s.seg_id join report w on w.seg_id = s.seg_id""")
def segment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of each segment for risk models, all joined by its id."""
    seg = active_segments(spark, sf_dir)
    x, y, z = (F.col(f"mid_{c}") for c in "xyz")
    o = obs(spark, sf_dir).select("x", "y", "z", "t")
    asks = seg.select("seg_id", "mid_x", "mid_y", "mid_z", "mid_t")
    dense = count_around(o, asks.withColumnsRenamed({f"mid_{c}": c for c in "xyzt"}), "seg_id", 1500.0, 150.0, 300 * SECOND, 2 * SLICE)
    reports = wx(spark, sf_dir).select(F.col("t").alias("mid_t"), "event_id", "wind_dir", (F.col("event_id") % 40).alias("wind_kt"), "vis", "ceil")
    weather = J.asof_nearest(asks.select("seg_id", "mid_t"), reports, "mid_t", [], ["wind_dir", "wind_kt", "vis", "ceil"], "event_id").drop("mid_t")
    seg = seg.join(nearest_runway(spark, sf_dir, seg), "seg_id").join(dense, "seg_id", "left").join(weather, "seg_id")
    sd = L.active_distance(x, y, z, "arr_", "dep_", F.col("d_runway"))
    (wind_sin, wind_cos), (hour_sin, hour_cos) = X.cyclic(F.col("wind_dir"), 360.0), X.cyclic(F.floor(F.col("mid_t") / 60_000_000) % 1440 / 60.0, 24.0)
    columns = {
        "d_ols_m": (F.abs(sd), 3), "d_runway_m": (F.col("d_runway"), 3),
        "d_approach_m": (F.coalesce(L.beside(L.approach_of(x, y, "arr_"), z, "arr_"), F.lit(L.NOWHERE_M)), 3), "d_departure_m": (F.coalesce(L.beside(L.departure_of(x, y, "dep_"), z, "dep_"), F.lit(L.NOWHERE_M)), 3),
        "traffic_density": (F.coalesce("n", F.lit(0)) / F.lit(9e6 * 300 * 600) * 1e12, 6), "wind_dir_sin": (wind_sin, 6), "wind_dir_cos": (wind_cos, 6), "wind_speed_mps": (F.col("wind_kt") * X.KT_MS, 4),
        "visibility_m": (F.col("vis") * X.SM_M, 3), "ceiling_m": (F.col("ceil") * X.FT_M, 3), "hour_sin": (hour_sin, 6), "hour_cos": (hour_cos, 6),
    }
    configs = (F.coalesce((F.col("arr_at") == k).cast("int"), F.lit(0)).alias(f"cfg_{k}") for k in range(5))
    return seg.select("seg_id", *(F.round(c, d).alias(n) for n, (c, d) in columns.items()), *configs)


ENVELOPE = f"""{ENDS}, {OBS}, {CENTRES}, active as (select distinct t // {96 * SLICE} as slice, event_id % 5 as pos, event_type = 'click' as landing, t // {96 * SLICE} % 3 = 0 as imc from obs where event_type in ('click', 'view')),
fixed as (select distinct cell from grid, ends where abs((y - y0) * ux - (x - x0) * uy) <= 228.6 and (x - x0) * ux + (y - y0) * uy between -5556 and length + 5556 and z <= 1524),
shut as (select distinct slice, cell from active join ends using (pos) cross join grid where z < 457.2 and abs((y - y0) * ux - (x - x0) * uy) <= case when imc then 6945.0 else 5556.0 end
  and case when landing then (x - x0) * ux + (y - y0) * uy between -15000 and 0 else (x - x0) * ux + (y - y0) * uy between 0 and length + 15000 end),
gone as (select slice, count(*) as n from shut where cell not in (select cell from fixed) group by slice),
slices as (select slice, any_value(imc) as imc, coalesce(any_value(n), 0) as n_dynamic, {CELLS} - (select count(*) from fixed) as n_static from active left join gone using (slice) group by slice)"""


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slice, imc, n_open, n_dynamic): voxels open to flight in each slice, and those that its traffic closes.

    Closures are worked out once for each use of an end, and joined to the slices that have it."""
    e = ends(spark, sf_dir)
    o = obs(spark, sf_dir).where("event_type in ('click', 'view')")
    slice_ = F.floor(F.col("t") / (96 * SLICE)).cast("long")
    active = o.select(slice_.alias("slice"), (F.col("event_id") % 5).alias("pos"), (F.col("event_type") == "click").alias("landing"), (slice_ % 3 == 0).alias("imc")).distinct()
    along, across = X.along_across(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("ux"), F.col("uy"))
    fixed = grid(spark).crossJoin(J.configured(e)).where(V.statically_closed(along, across, F.col("z"), F.col("length"), F.lit(0.0))).select(*V.KEY).distinct()
    free = V.difference(grid(spark), fixed)
    uses = J.configured(active.select("pos", "landing", "imc").distinct().join(J.configured(e), "pos"))
    shut = grid(spark).crossJoin(uses).where(V.closed(along, across, F.col("z"), F.col("landing"), F.col("length"), F.col("imc"))).select("pos", "landing", "imc", *V.KEY)
    gone = active.join(shut.join(free, V.KEY, "left_semi"), ["pos", "landing", "imc"]).select("slice", *V.KEY).distinct().groupBy("slice").agg(F.count("*").alias("n"))
    slices = active.select("slice", "imc").distinct().join(gone, "slice", "left").crossJoin(J.configured(free.agg(F.count("*").alias("free"))))
    return slices.select("slice", "imc", (F.col("free") - F.coalesce("n", F.lit(0))).alias("n_open"), F.coalesce("n", F.lit(0)).alias("n_dynamic"))


@query(f"with {ENVELOPE} select slice, imc, n_static - n_dynamic as n_open, n_dynamic from slices")
def envelope_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes(spark, sf_dir)


@query(f"with {ENVELOPE}, s as (select imc, (n_static - n_dynamic) / {CELLS}.0 as open_share from slices) select imc, count(*) as n, round(min(open_share), 6) as least, round(avg(open_share), 6) as mean, round(max(open_share), 6) as most from s group by imc")
def envelope_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("n_open") / float(CELLS)
    return envelopes(spark, sf_dir).groupBy("imc").agg(F.count("*").alias("n"), F.round(F.min(share), 6).alias("least"), F.round(F.avg(share), 6).alias("mean"), F.round(F.max(share), 6).alias("most"))


AT = ", ".join(f"cast(least(floor(({c} - {a}) / {s}), {n - 1}) as bigint) as {k}" for c, a, s, n, k in zip("xyz", LOW, STEP, SHAPE, V.KEY, strict=True))


def on_grid(points: DataFrame) -> DataFrame:
    """points with the voxel of each, the last one at the far edges."""
    return points.withColumns({k: F.least(V.index(c, a, s), F.lit(n - 1)) for c, a, s, n, k in zip("xyz", LOW, STEP, SHAPE, V.KEY, strict=True)})


SAFETY = f"""{WAYPOINTS}, {ENDS}, {FIELD}, w as (select *, {AT} from waypoints),
margins as (select path, round(avg(case when sd <= 0 then 1.0 else 0.0 end), 6) as violation_rate, round(min(sd), 4) as min_margin from w join field using (ix, iy, iz) group by path),
steps as (select *, lag(x) over o as px, lag(y) over o as py from waypoints window o as (partition by path order by k1, k2, k3)),
cones as (select path, sqrt(pow(x - px, 2) + pow(y - py, 2)) / 67.0 as dt, ((x - x0) * -ux + (y - y0) * -uy) as a1, abs((y - y0) * -ux + (x - x0) * uy) as c1, ((px - x0) * -ux + (py - y0) * -uy) as a0, abs((py - y0) * -ux + (px - x0) * uy) as c0, length from steps, ends),
sums as (select path, sum(case when a1 between 0 and 5000 and c1 <= 150 + 0.15 * a1 and a0 between 0 and 5000 and c0 <= 150 + 0.15 * a0 then dt else 0 end) as approach_s,
  sum(case when -a1 - length between 0 and 5000 and c1 <= 150 + 0.15 * (-a1 - length) and -a0 - length between 0 and 5000 and c0 <= 150 + 0.15 * (-a0 - length) then dt else 0 end) as departure_s from cones group by path),
tips as (select path, count(*) as n, arg_min({{'x': x, 'y': y, 'z': z}}, (k1, k2, k3)) as a, arg_max({{'x': x, 'y': y, 'z': z}}, (k1, k2, k3)) as b from waypoints group by path),
safety as (select path, violation_rate, min_margin, round(approach_s, 3) as approach_s, round(departure_s, 3) as departure_s, round(departure_s, 3) as missed_s,
  case when n < 2 then -1 when greatest(sqrt(pow(((a.x % 200) + 200) % 200 - 100, 2) + pow(((a.y % 200) + 200) % 200 - 100, 2)) - (8 + 72 * least(greatest(a.z / 300.0, 0), 1)), -a.z, a.z - 300.0) < 0
    and greatest(sqrt(pow(((b.x % 200) + 200) % 200 - 100, 2) + pow(((b.y % 200) + 200) % 200 - 100, 2)) - (8 + 72 * least(greatest(b.z / 300.0, 0), 1)), -b.z, b.z - 300.0) < 0 then 1 else 0 end as funnel_ok from margins join sums using (path) join tips using (path))"""


@query(f"with {SAFETY} select * from safety")
def corridor_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of waypoints inside the protection surfaces, least margin, seconds in the runways' cones, and whether both ends lie in their vertiports' funnels."""
    ordered = waypoints(spark, sf_dir, by_path=True)
    o = Window.partitionBy("path").orderBy(*PATH_ORDER)
    steps = ordered.withColumns({"px": F.lag("x").over(o), "py": F.lag("y").over(o)}).withColumn("dt", F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2)) / 67.0)
    steps = steps.crossJoin(L.ends_as(ends(spark, sf_dir), "e_"))

    def both(beyond: bool) -> Column:
        tests = []
        for x, y in (("x", "y"), ("px", "py")):
            along, across = L.offsets(F.col(x), F.col(y), "e_")
            s = along - F.col("e_length") if beyond else -along
            tests.append(s.between(0, 5000) & (F.abs(across) <= 150 + 0.15 * s))
        return F.round(F.sum(F.when(tests[0] & tests[1], F.col("dt")).otherwise(0.0)), 3)

    sums = steps.groupBy("path").agg(both(False).alias("approach_s"), both(True).alias("departure_s"))
    # Margins and tips are one pass over whole rows of keys, or the shuffle by path would be another one without some of them.
    here, sd = F.struct("x", "y", "z"), F.col("sd")
    margins = {"violation_rate": F.round(F.avg((sd <= 0).cast("double")), 6), "min_margin": F.round(F.min(sd), 4), "inside": F.count(sd)}
    tips = {"n": F.count("*"), "a": F.min_by(here, F.struct(*PATH_ORDER)), "b": F.max_by(here, F.struct(*PATH_ORDER))}
    whole = on_grid(ordered).join(J.configured(field(spark, sf_dir)), V.KEY, "left").groupBy("path").agg(*(c.alias(n) for n, c in (margins | tips).items())).where("inside > 0")
    port = lambda p: S.funnel_distance(F.pmod(p["x"], F.lit(200)) - 100.0, F.pmod(p["y"], F.lit(200)) - 100.0, p["z"].cast("double")) < 0
    ok = F.when(F.col("n") < 2, -1).when(port(F.col("a")) & port(F.col("b")), 1).otherwise(0)
    return whole.join(sums, "path").select("path", "violation_rate", "min_margin", "approach_s", "departure_s", F.col("departure_s").alias("missed_s"), ok.alias("funnel_ok"))


CAPACITY = f"""legs as (select *, coalesce(sqrt(pow(x - lag(x) over o, 2) + pow(y - lag(y) over o, 2)), 0) as leg from waypoints window o as (partition by path order by k1, k2, k3)),
arcs as (select *, sum(leg) over (partition by path order by k1, k2, k3) as arc, lead(x) over o as nx, lead(y) over o as ny from legs window o as (partition by path order by k1, k2, k3)),
first as (select path, arg_min(arc / 67.0, (pos, arc)) as cross_s from arcs, ends where nx is not null and sign((y - y0) * ux - (x - x0) * uy) <> sign((ny - y0) * ux - (nx - x0) * uy) and (x - x0) * ux + (y - y0) * uy between 0 and length group by path),
capacity as (select p.path, round(coalesce(cross_s, -1), 3) as cross_s, round(total / 67.0, 3) as time_s, round(3600 / (total / 67.0 + 60), 6) as ops_per_hour from (select path, max(arc) as total from arcs group by path) p left join first f on f.path = p.path)"""


@query(f"with {WAYPOINTS}, {ENDS}, {CAPACITY} select * from capacity")
def corridor_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a corridor first crosses a runway (the first one that it crosses, in order of the runways), and flights an hour."""
    arcs = W.arc_length(waypoints(spark, sf_dir, by_path=True), ["path"], PATH_ORDER, "x", "y")
    o = Window.partitionBy("path").orderBy(*PATH_ORDER)
    steps = arcs.withColumns({"nx": F.lead("x").over(o), "ny": F.lead("y").over(o)}).where("nx is not null").crossJoin(L.ends_as(ends(spark, sf_dir), "e_"))
    (along, here), (_, there) = (L.offsets(F.col(a), F.col(b), "e_") for a, b in (("x", "y"), ("nx", "ny")))
    hit = steps.where((F.signum(here) != F.signum(there)) & along.between(F.lit(0.0), F.col("e_length")))
    first = hit.groupBy("path").agg(F.min_by(F.col("arc") / 67.0, F.struct("e_pos", "arc")).alias("cross_s"))
    time = F.col("total") / 67.0
    return arcs.groupBy("path").agg(F.max("arc").alias("total")).join(first, "path", "left").select("path", F.round(F.coalesce("cross_s", F.lit(-1.0)), 3).alias("cross_s"), F.round(time, 3).alias("time_s"), F.round(3600 / (time + 60), 6).alias("ops_per_hour"))


SHARES = ", ".join(f"({h}, {round(share, 12)!r}::double)" for h, share in R.peak_shares().items())
ACCESS = f"""tip as (select path, arg_min(x, (k1, k2, k3)) as x, arg_min(y, (k1, k2, k3)) as y from waypoints group by path), shares(hour, share) as (values {SHARES}),
geo as (select path, 33.9 + y / 111320.0 as lat, -118.4 + x / 92500.0 as lon, case path % 3 when 0 then 8 when 1 then 11 else 17 end as hour from tip),
nm as (select *, 2 * 3440.065 * asin(least(1, sqrt(pow(sin(radians(33.9 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(33.9)) * pow(sin(radians(-118.4 - lon) / 2), 2)))) * 1.852 as km from geo),
pax as (select n, greatest(sum(p) / 1e6, 0.1) as weight from (select unnest(list_distinct([o_custkey % 25, o_orderkey % 25])) as n, o_totalprice as p from orders) group by n),
access as (select path, round(km * 1.4 / 50 * 60, 4) as road_min, round(km / 5 * 60 + 1, 4) as walk_min, round(km * 1.4 / 50 * 60 - (total / 67.0 + 60) / 60, 4) as saving_min, round((km * 1.4 / 50 * 60 - (total / 67.0 + 60) / 60) * weight * (1 + share), 3) as pax_score
  from nm join (select path, max(arc) as total from arcs group by path) using (path) join shares using (hour) join pax on n = path % 25)"""


@query(f"with {WAYPOINTS}, {ENDS}, {CAPACITY}, {ACCESS} select * from access")
def corridor_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes by road and on foot to the terminal, minutes saved in the air, and those weighted by passengers and peak."""
    w = waypoints(spark, sf_dir, by_path=True)
    order = F.struct(*PATH_ORDER)
    # The place is an aggregate, so that no filter on it comes below the shuffle by path, which is shared.
    tip = w.groupBy("path").agg(F.min_by("x", order).alias("x"), F.min_by("y", order).alias("y"), F.max(F.col("path") % 25).alias("place"))
    hours, shares = R.peak_shares(), list(R.peak_shares())
    geo = tip.select("path", (33.9 + F.col("y") / 111320.0).alias("lat"), (-118.4 + F.col("x") / 92500.0).alias("lon"), (F.col("path") % 3).alias("turn"), "place")
    geo = geo.withColumn("km", X.haversine_nm(F.col("lat"), F.col("lon"), F.lit(33.9), F.lit(-118.4)) * 1.852)
    share = F.get(F.array(*(F.lit(round(hours[h], 12)) for h in shares)), F.col("turn").cast("int"))
    o = table(spark, sf_dir, "orders").select(F.explode(F.array_distinct(F.array(F.col("o_custkey") % 25, F.col("o_orderkey") % 25))).alias("place"), "o_totalprice")
    pax = o.groupBy("place").agg(F.greatest(F.sum("o_totalprice") / 1e6, F.lit(0.1)).alias("weight"))
    total = W.arc_length(w, ["path"], PATH_ORDER, "x", "y").groupBy("path").agg(F.max("arc").alias("total"))
    found = geo.join(total, "path").join(J.configured(pax), "place")
    road, flight = F.col("km") * 1.4 / 50 * 60, (F.col("total") / 67.0 + 60) / 60
    return found.select("path", F.round(road, 4).alias("road_min"), F.round(F.col("km") / 5 * 60 + 1, 4).alias("walk_min"), F.round(road - flight, 4).alias("saving_min"), F.round((road - flight) * F.col("weight") * (1 + share), 3).alias("pax_score"))


def of_path(name: str) -> str:
    return f"left join ({spatial.ORACLES[name]}) {name} using (path)"


@query(f"""with {SAFETY}, {CAPACITY}, {ACCESS}, c as (select o_orderkey as path, o_orderstatus <> 'P' as feasible, o_orderkey % 5 as pos, ({EPOCH} + o_orderkey * 977 % {SPAN}) // 86400 as day, ({EPOCH} + o_orderkey * 977 % {SPAN}) // 3600 % 24 as flown from orders)
select path, feasible, case when feasible then violation_rate else 1.0 end as violation_rate, case when feasible then min_margin end as min_margin, case when feasible then approach_s else 0 end as approach_s, case when feasible then departure_s else 0 end as departure_s,
  case when feasible then funnel_ok else 0 end as funnel_ok, case when feasible then cross_s else -1 end as cross_s, case when feasible then ops_per_hour else 0 end as ops_per_hour, road_min, walk_min, case when feasible then saving_min else 0 end as saving_min, case when feasible then pax_score else 0 end as pax_score,
  case when feasible then min_lateral_nm end as min_lateral_nm, case when feasible then min_vertical_ft end as min_vertical_ft, case when feasible then coalesce(crossings, 0) else 0 end as crossings, case when feasible then coalesce(n_aircraft, 0) else 0 end as n_aircraft,
  case when feasible then closure_rate end as closure_rate, case when feasible then coalesce(extra_us, 0) end as extra_us, case when feasible then coalesce(throughput_share, 1) end as throughput_share, reliability_pct
from c left join safety using (path) left join capacity using (path) left join access using (path) {of_path("path_min_separation")} {of_path("crossings_sign")} {of_path("proximity_distinct")} {of_path("voxel_closure_rate")}
left join ({tracks.ORACLES["throughput_share"]}) t on t.pos = c.pos and t.hour = c.day left join ({kpis.ORACLES["weather_reliability"]}) w on w.hour = c.flown""")
def kpi_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each corridor with all indicators; infeasible ones have the defaults. Delay and throughput are those of
    the corridor's runway and hour, weather reliability that of its hour of the day. What an absent table would tell is null."""
    key = F.col("o_orderkey")
    begun = F.lit(EPOCH) + key * 977 % SPAN
    c = table(spark, sf_dir, "orders").select(key.alias("path"), (F.col("o_orderstatus") != "P").alias("feasible"), (key % 5).alias("pos"), F.floor(begun / 86400).alias("hour"), (F.floor(begun / 3600) % 24).alias("flown"))
    # What has no path is left out before closures are shuffled, or the join would do so on one of the two uses of that shuffle only.
    closures = spatial.closure_rate(spark, sf_dir, waypoints(spark, sf_dir).where("path is not null"))
    of_path = (f(spark, sf_dir) for f in (corridor_safety, corridor_capacity, corridor_access, spatial.path_min_separation, spatial.crossings_sign))
    k = reduce(lambda a, b: a.join(b, "path", "left"), (*of_path, closures), c)
    k = k.join(spatial.proximity_distinct(spark, sf_dir).select("path", "n_aircraft"), "path", "left")
    # Five runways by days and hours of the day are few, so the wide rows stay where their paths are.
    k = k.join(F.broadcast(tracks.throughput_share(spark, sf_dir).select("pos", "hour", "extra_us", "throughput_share")), ["pos", "hour"], "left")
    k = k.join(F.broadcast(kpis.weather_reliability(spark, sf_dir).select(F.col("hour").alias("flown"), "reliability_pct")), "flown", "left")
    k = k.fillna({"crossings": 0, "n_aircraft": 0, "extra_us": 0, "throughput_share": 1.0})
    defaults = {"violation_rate": 1.0, "min_margin": None, "approach_s": 0.0, "departure_s": 0.0, "funnel_ok": 0, "cross_s": -1.0, "ops_per_hour": 0.0, "saving_min": 0.0, "pax_score": 0.0}
    defaults |= {"crossings": 0, "n_aircraft": 0} | dict.fromkeys(("min_lateral_nm", "min_vertical_ft", "closure_rate", "extra_us", "throughput_share"))
    kept = {n: F.when(F.col("feasible"), F.col(n)).otherwise(F.lit(v)).alias(n) for n, v in defaults.items()}
    columns = ("violation_rate", "min_margin", "approach_s", "departure_s", "funnel_ok", "cross_s", "ops_per_hour", "road_min", "walk_min", "saving_min", "pax_score")
    columns += ("min_lateral_nm", "min_vertical_ft", "crossings", "n_aircraft", "closure_rate", "extra_us", "throughput_share", "reliability_pct")
    return k.select("path", "feasible", *(kept.get(n, n) for n in columns))


@query(f"""with {WAYPOINTS}, {ENDS}, {GRID}, {FIELD}, v as (select ix, iy, iz, count(*) as n from inside group by all), w as (select *, {AT} from waypoints),
d as (select *, x - lag(x) over o as dx, y - lag(y) over o as dy, z - lag(z) over o as dz from w window o as (partition by path order by k1, k2, k3)),
e as (select d.path, dz, sqrt(dx * dx + dy * dy + dz * dz) as len, coalesce(n, 0) as n, sd from d join field using (ix, iy, iz) left join v using (ix, iy, iz) where dx is not null),
t as (select *, len / case when dz > 0 then 30.0 when dz < 0 then 25.0 else 67.0 end as dt from e),
q as (select *, case when dt > 0 then 250 + 600 * least(abs(dz) / dt / 7, 1) else 250 end * 1000 * dt as energy, n * len as noise, least(greatest(1 - sd / 1500, 0), 1) as impact, least(n / 50.0::double, 1) * dt as risk, coalesce(dt > 0 and (dz / nullif(dt, 0) > 7 or dz / nullif(dt, 0) < -5), false) or sd <= 0 as banned from t)
select path, round(sum(dt), 3) as time_s, round(sum(energy) / 1e6, 4) as energy_mj, round(sum(noise) / 1000, 3) as noise, round(sum(impact), 4) as impact, round(sum(risk), 4) as risk_s, cast(count_if(banned) as bigint) as n_banned, round(sum(dt + 5e-4 * energy + 1e-3 * noise + 100 * impact), 1) as cost from q group by path""")
def path_integrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time, energy, noise, capacity impact, risk over time and cost along each path, and how many of its edges no flight may take."""
    w = on_grid(waypoints(spark, sf_dir))
    o = Window.partitionBy("path").orderBy(*PATH_ORDER)
    edges = w.withColumns({f"d{c}": F.col(c) - F.lag(c).over(o) for c in "xyz"}).where("dx is not null")
    edges = edges.join(field(spark, sf_dir), V.KEY).join(A.voxel_counts(obs(spark, sf_dir), [], LOW, STEP, SHAPE), V.KEY, "left")
    v = P.Vehicle()
    length, dz = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2), F.col("dz")
    edges = edges.withColumn("len", length).withColumn("dt", F.col("len") / F.when(dz > 0, 30.0).when(dz < 0, 25.0).otherwise(67.0))
    rate = F.col("dz") / F.nullif(F.col("dt"), F.lit(0.0))
    power = F.when(F.col("dt") > 0, 250 + 600 * F.least(F.abs(dz) / F.nullif(F.col("dt"), F.lit(0.0)) / v.climb_limit, F.lit(1.0))).otherwise(250.0)
    banned = F.coalesce((rate > v.climb_limit) | (rate < -v.descent_limit), F.lit(False)) | (F.col("sd") <= 0)
    q = edges.select("path", "dt", (power * 1000 * F.col("dt")).alias("energy"), (F.coalesce("n", F.lit(0)) * F.col("len")).alias("noise"), X.clip(1 - F.col("sd") / 1500).alias("impact"), (X.clip(F.coalesce("n", F.lit(0)) / 50.0) * F.col("dt")).alias("risk"), banned.alias("banned"))
    cost = F.col("dt") + 5e-4 * F.col("energy") + 1e-3 * F.col("noise") + 100 * F.col("impact")
    return q.groupBy("path").agg(F.round(F.sum("dt"), 3).alias("time_s"), F.round(F.sum("energy") / 1e6, 4).alias("energy_mj"), F.round(F.sum("noise") / 1000, 3).alias("noise"), F.round(F.sum("impact"), 4).alias("impact"), F.round(F.sum("risk"), 4).alias("risk_s"), F.count_if("banned").alias("n_banned"), F.round(F.sum(cost), 1).alias("cost"))


@query(f"""with {OBS}, t as (select distinct icao24, case icao24 % 3 when 0 then 'arrival' else 'departure' end as category from obs where icao24 % 4 > 0)
select coalesce(category, 'unknown') as category, cast(floor((x + 10000) / 1000.0) as bigint) as ix, cast(floor((y + 10000) / 1000.0) as bigint) as iy, count(*) as n from obs left join t using (icao24) group by all""")
def density_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by the category of their track; those of tracks without one are unknown."""
    o = obs(spark, sf_dir)
    tracks = o.where("icao24 % 4 > 0").select("icao24", F.when(F.col("icao24") % 3 == 0, "arrival").otherwise("departure").alias("category")).distinct()
    found = o.join(tracks, "icao24", "left").select(F.coalesce("category", F.lit("unknown")).alias("category"), V.index("x", LOW[0], STEP[0]).alias("ix"), V.index("y", LOW[1], STEP[1]).alias("iy"))
    return found.groupBy("category", "ix", "iy").agg(F.count("*").alias("n"))


@query(f"""with {WAYPOINTS}, r as (select *, row_number() over (partition by path order by k1, k2, k3) - 1 as "at", count(*) over (partition by path) as n from waypoints)
select path, "at", x, y, z from r where "at" % greatest(1, n // 3) = 0""")
def path_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every k-th waypoint, so that a path keeps a few."""
    return W.strided(waypoints(spark, sf_dir), ["path"], PATH_ORDER, 3).select("path", F.col("at").cast("long").alias("at"), "x", "y", "z")


@query(f"""with {OBS} select event_id, cast(icao24 as varchar) as icao24, case when event_id % 4 > 0 then z::double else z + 12.5 end as z_msl_m, case when event_id % 4 > 0 then z::double else z + 12.5 end - 38.0 as z_agl_m, event_id % 13 = 0 as on_ground from obs where event_id % 17 > 0""")
def state_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional snapshot documents, written and read again: satellite heights first, then pressure heights, above field elevation."""
    o = obs(spark, sf_dir)
    state = F.array(*(c.cast("string") for c in (F.concat(F.lit(" "), F.col("icao24")), F.lit("CALL "), F.lit("US"), F.lit(1), F.lit(1), F.when(F.col("event_id") % 17 > 0, F.col("x") / 1e5), F.col("y") / 1e5, F.col("z") + 12.5, F.col("event_id") % 13 == 0, F.col("speed"), F.lit(90.0), F.lit(0.0), F.lit(None), F.when(F.col("event_id") % 4 > 0, F.col("z").cast("double")), F.lit("7000"), F.lit(False), F.lit(0))))
    documents = o.select("event_id", F.to_json(F.struct((F.col("t") / 1e6).alias("time"), F.array(state).alias("states")), {"ignoreNullFields": "false"}).alias("value"))
    found = R.enriched(R.snapshot_lines(documents, "value"), 38.0)
    return found.select("event_id", "icao24", "z_msl_m", "z_agl_m", "on_ground")


@query(f"""with {WAYPOINTS}, r as (select *, row_number() over (partition by path order by k1, k2, k3) - 1 as "at", {AT} from waypoints) select 'corridor_' || path as corridor_id, "at", ix, iy, iz from r""")
def linestring_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corridor features as line strings, joined to their documents by stem, back to voxels."""
    w = waypoints(spark, sf_dir)
    lines = w.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*PATH_ORDER, (F.col("x") / 1e5).alias("lon"), (F.col("y") / 1e5).alias("lat"), F.col("z").cast("double").alias("z")))).alias("points"))
    stem = F.concat(F.lit("corridor_"), F.col("path"))
    features = lines.select(stem.alias("stem"), F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(F.struct(F.struct(F.lit("LineString").alias("type"), F.transform("points", lambda p: F.array(p["lon"], p["lat"], p["z"])).alias("coordinates")).alias("geometry"))).alias("features"))).alias("value"))
    corridors = table(spark, sf_dir, "orders").select(F.concat(F.lit("corridor_"), F.col("o_orderkey")).alias("corridor_id"))
    points = R.line_strings(features, "value", "stem")
    found = points.join(corridors, points.stem == corridors.corridor_id).select("corridor_id", F.col("at").cast("long").alias("at"), *(F.round(c).cast("long").alias(n) for c, n in ((F.col("lon") * 1e5, "x"), (F.col("lat") * 1e5, "y"), (F.col("z"), "z"))))
    return on_grid(found).select("corridor_id", "at", *V.KEY)


@query(f"""with {WX}, days as (select distinct t // 86400000000 as day from wx) select d.day, count(*) as n, round(avg(vis), 6) as vis from days d join wx w on w.t // 86400000000 between d.day - 1 and d.day + 1 group by d.day""")
def weather_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of each day, the day before and the day after."""
    w = wx(spark, sf_dir).withColumn("own", F.floor(F.col("t") / 86_400_000_000).cast("long"))
    days = w.select("own").distinct()
    spread = w.withColumn("day", F.explode(F.sequence(F.col("own") - 1, F.col("own") + 1))).join(days.withColumnRenamed("own", "day"), "day")
    return spread.groupBy("day").agg(F.count("*").alias("n"), F.round(F.avg("vis"), 6).alias("vis"))


RISK = {"d_runway": -0.0002, "hour_sin": 0.4, "hour_cos": -0.3, "n": 0.05}


@query(f"""with {ENDS}, {GRID}, v as (select ix, iy, iz, ix * 1000.0 - 9500 as x, iy * 1000.0 - 9500 as y, iz * 150.0 + 75 as z, count(*) as n from inside where event_type = 'purchase' group by all),
r as (select ix, iy, iz, n, min(sqrt(pow(al - least(greatest(al, 0), length), 2) + ac * ac + z * z)) as d_runway from (select v.*, length, (x - x0) * ux + (y - y0) * uy as al, (y - y0) * ux - (x - x0) * uy as ac from v, ends) group by ix, iy, iz, n)
select h as hour, ix, iy, iz, round(1 / (1 + exp(-(d_runway * -0.0002 + 0.4 * sin(h * (2 * pi() / 24)) - 0.3 * cos(h * (2 * pi() / 24)) + 0.05 * n))), 6) as risk from r, range(24) t(h)""")
def risk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of each voxel with traffic in each hour of a day, by a logistic model of given weights."""
    v = A.voxel_counts(obs(spark, sf_dir).where("event_type = 'purchase'"), [], LOW, STEP, SHAPE)
    v = v.withColumns({"x": F.col("ix") * 1000.0 - 9500, "y": F.col("iy") * 1000.0 - 9500, "z": F.col("iz") * 150.0 + 75}).crossJoin(L.ends_as(ends(spark, sf_dir), "e_"))
    v = v.groupBy(*V.KEY, "n").agg(F.min(L.axis_distance(F.col("x"), F.col("y"), F.col("z"), "e_")).alias("d_runway"))
    slices = v.withColumn("hour", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))))
    s, c = X.cyclic(F.col("hour"), 24.0)
    return M.logistic(slices.withColumns({"hour_sin": s, "hour_cos": c}), RISK).select("hour", *V.KEY, F.round("p", 6).alias("risk"))
