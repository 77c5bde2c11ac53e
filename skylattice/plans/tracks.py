"""Track, weather and time-slice queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import geodesy as G
from ..operators import aggs as A
from ..operators import joins as J
from ..operators import windows as W
from ..sources import readers as R
from .bridge import ENDS, EPOCH, OBS, SECOND, SLICE, SPAN, WX, ends, obs, table, wx

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""with {OBS}, spine as (select unnest(range(min(t) // {SLICE}, max(t) // {SLICE} + 1)) as slice from obs),
counts as (select t // {SLICE} as slice, event_type, count(*) as n from obs group by all),
ranked as (select *, sum(n) over (partition by slice order by n desc, event_type rows between unbounded preceding and current row) - n as before, sum(n) over (partition by slice) as total from counts),
won as (select slice, string_agg(event_type, '+' order by event_type) as active, round(max(n) / max(total), 6) as top_share from ranked where before < 0.5 * total group by slice)
select s.slice, coalesce(active, '') as active, coalesce(top_share, 0) as top_share from spine s left join won w on w.slice = s.slice""")
def slice_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir)
    counts = o.groupBy(F.floor(F.col("t") / SLICE).cast("long").alias("slice"), "event_type").agg(F.count("*").alias("n"))
    won = W.winners(counts, ["slice"], "event_type", "n")
    return W.slice_spine(o, "t", SLICE).join(won, "slice", "left").select("slice", F.coalesce(F.array_join("active", "+"), F.lit("")).alias("active"), F.coalesce(F.round("top_share", 6), F.lit(0.0)).alias("top_share"))


@query(f"""with {OBS} select icao24, t // {5 * SECOND} * {5 * SECOND} as bin, median(x) as x, median(z) as z, median(speed) as speed, bool_or(event_type = 'purchase') as bought,
  arg_max(event_type, (t, event_type)) as event_type, count(*) as n_points from obs group by icao24, t // {5 * SECOND}""")
def resample_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir).withColumn("bought", F.col("event_type") == "purchase")
    return A.resample(o, "icao24", "t", 5 * SECOND, ["x", "z", "speed"], ["bought"], ["event_type"])


@query(f"""with {OBS}, s as (select *, (t - lag(t) over w) / 1e6 as dt, abs(z - lag(z) over w) as dz, abs(speed - lag(speed) over w) as dv from obs window w as (partition by icao24 order by t))
select event_id, icao24, t, z, speed from s where not coalesce((dt > 0 and dt < 360000 and (dz > 1000 or dv > 200)) or z < -200, false)""")
def outlier_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.reject_outliers(obs(spark, sf_dir), "icao24", "t", "z", "speed", gap_s=360_000).select("event_id", "icao24", "t", "z", "speed")


@query("""select user_id, event_type, ts, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events where value between 0 and 1000000) where n = 1""")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").na.drop(subset=["user_id", "value"]).where(F.col("value").between(0, 1_000_000))
    return W.first_rows(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "ts", "event_id", "value")


def grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs(spark, sf_dir).withColumn("on_ground", F.col("event_id") % 13 == 0)


SUMMARY = f"""{OBS}, tracks as (select icao24, count(*) as n_points, min(t) as t_start, max(t) as t_end, min(sqrt(x * x + y * y)) as min_dist_m, min(z) as min_z,
  arg_min({{'x': x, 'y': y, 'z': z, 's': speed, 'g': event_id % 13 = 0}}, t) as a, arg_max({{'x': x, 'y': y, 'z': z, 's': speed, 'g': event_id % 13 = 0}}, t) as b from obs group by icao24 having count(*) >= 4),
named as (select *, case when (b.z < 50 or b.g) and sqrt(b.x * b.x + b.y * b.y) < 25000 and b.z - a.z < -150 and min_dist_m < 25000 then 'arrival'
  when (a.z < 50 or a.g) and sqrt(a.x * a.x + a.y * a.y) < 25000 and b.z - a.z > 150 and coalesce(a.s, 70) >= 40 then 'departure' when min_z > 1500 then 'overflight'
  when sqrt(b.x * b.x + b.y * b.y) < 25000 and b.z - a.z < -150 and coalesce(b.s, 70) between 30 and 120 then 'arrival' else 'unknown' end as category from tracks)"""


@query(f"with {SUMMARY} select icao24, n_points, t_start, t_end, round(min_dist_m, 4) as min_dist_m, category from named")
def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.track_summary(grounded(spark, sf_dir), "icao24", "t").select("icao24", "n_points", "t_start", "t_end", F.round("min_dist_m", 4).alias("min_dist_m"), A.movement().alias("category"))


@query(f"with {SUMMARY} select category, count(*) as n_tracks, round(avg(n_points), 4) as mean_points from named group by category")
def movement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = A.track_summary(grounded(spark, sf_dir), "icao24", "t").withColumn("category", A.movement())
    return tracks.groupBy("category").agg(F.count("*").alias("n_tracks"), F.round(F.avg("n_points"), 4).alias("mean_points"))


@query(f"""with {OBS}, r as (select *, row_number() over (partition by icao24 order by t) as u, row_number() over (partition by icao24 order by t desc) as d from obs),
e as (select icao24, arg_max(x, u) filter (u <= 5) - arg_min(x, u) filter (u <= 5) as sx, arg_max(y, u) filter (u <= 5) - arg_min(y, u) filter (u <= 5) as sy,
  arg_min(x, d) filter (d <= 5) - arg_max(x, d) filter (d <= 5) as ex, arg_min(y, d) filter (d <= 5) - arg_max(y, d) filter (d <= 5) as ey from r group by icao24)
select icao24, round(((degrees(atan2(sx, sy)) % 360) + 360) % 360, 4) as start_bearing, round(((degrees(atan2(ex, ey)) % 360) + 360) % 360, 4) as end_bearing from e""")
def first_last_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = W.ends_of_track(obs(spark, sf_dir), "icao24", "t", "x", "y")
    return e.select("icao24", F.round(X.bearing(F.col("start_dx"), F.col("start_dy")), 4).alias("start_bearing"), F.round(X.bearing(F.col("end_dx"), F.col("end_dy")), 4).alias("end_bearing"))


def nearest_sql(tolerance: int | None) -> str:
    limit = f"where abs(o.t - w.t) <= {tolerance}" if tolerance else ""
    return f"""with {OBS}, {WX}, near as (select o.event_id, arg_min(w.event_id, (abs(o.t - w.t), w.t, w.event_id)) as report, arg_min(w.qnh, (abs(o.t - w.t), w.t, w.event_id)) as qnh
  from obs o, wx w {limit} group by o.event_id)
select o.event_id, coalesce(report, -1) as report, round(z + (coalesce(qnh, 1013.25) - 1013.25) * 8.2296, 4) as altitude from obs o left join near n on n.event_id = o.event_id"""


def nearest(spark: SparkSession, sf_dir: str, tolerance: int | None) -> DataFrame:
    reports = wx(spark, sf_dir).withColumn("report", F.col("event_id")).select("t", "report", "qnh")
    o = J.asof_nearest(obs(spark, sf_dir), reports, "t", [], ["report", "qnh"], "report", tolerance)
    altitude = X.best_altitude(F.lit(None).cast("double"), F.col("z").cast("double"), F.col("qnh"))
    return o.select("event_id", F.coalesce("report", F.lit(-1)).alias("report"), F.round(altitude, 4).alias("altitude"))


@query(nearest_sql(5400 * SECOND))
def asof_nearest_tol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, sf_dir, 5400 * SECOND)


@query(nearest_sql(None))
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, sf_dir, None)


@query(f"""with {OBS}, slices as (select distinct t // {SLICE} as slice from obs), hours(h) as (values (8), (11), (17)),
d as (select h, slice, abs((slice * 15) % 1440 - (h * 60 + 30)) as off from slices, hours)
select h as hour, arg_min(slice, (off, slice)) as slice, min(off) as minutes_off from d group by h""")
def nearest_minute_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = obs(spark, sf_dir).select(F.floor(F.col("t") / SLICE).cast("long").alias("slice")).distinct()
    hours = F.explode(F.array(*map(F.lit, (8, 11, 17))))
    off = F.abs((F.col("slice") * 15) % 1440 - (F.col("hour") * 60 + 30)).alias("off")
    return slices.withColumn("hour", hours).select("hour", "slice", off).groupBy("hour").agg(F.min_by("slice", F.struct("off", "slice")).alias("slice"), F.min("off").alias("minutes_off"))


@query(f"""with {OBS}, {WX}, spine as (select distinct t // {4 * SLICE} as slice from obs),
hit as (select s.slice, w.* from spine s join wx w on w.t >= s.slice * {4 * SLICE} - {2 * SLICE} and w.t < (s.slice + 1) * {4 * SLICE} + {2 * SLICE}),
mode as (select slice, arg_min(vis, (-n, vis)) as vis_mode from (select slice, vis, count(*) as n from hit group by all) group by slice)
select h.slice, count(*) as n_reports, round(((degrees(atan2(avg(sin(radians(wind_dir))), avg(cos(radians(wind_dir))))) % 360) + 360) % 360, 4) as wind_mean, median(qnh) as qnh, any_value(vis_mode) as vis_mode
from hit h join mode m on m.slice = h.slice group by h.slice""")
def interval_margin_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = 4 * SLICE
    spine = obs(spark, sf_dir).select(F.floor(F.col("t") / wide).cast("long").alias("slice")).distinct()
    hit = J.interval_join(wx(spark, sf_dir), "t", spine, F.col("slice") * wide - 2 * SLICE, (F.col("slice") + 1) * wide + 2 * SLICE, wide)
    return hit.groupBy("slice").agg(F.count("*").alias("n_reports"), F.round(X.circular_mean(F.col("wind_dir")), 4).alias("wind_mean"), F.median("qnh").alias("qnh"), F.mode("vis", True).alias("vis_mode"))


@query(f"""with {OBS}, m as (select o.event_id, e.pos, e.end_id, least(degrees(acos(least(greatest((0.6 * ux + 0.8 * uy), -1), 1))), 360) as dummy, e.bearing,
  ((o.event_id * 53) % 360 - e.bearing + 180) - 360 * floor(((o.event_id * 53) % 360 - e.bearing + 180) / 360) - 180 as d,
  (x - x0) * ux + (y - y0) * uy as along, (y - y0) * ux - (x - x0) * uy as across, e.length from obs o, ({"select * from ends"}) e),
s as (select event_id, pos, end_id, abs(across) + 0.3 * (greatest(0, -along) + greatest(0, along - 1.2 * length)) + 50 * abs(d) as score from m where abs(d) <= 15 and abs(across) <= 2000)
select event_id, arg_min(end_id, (score, pos)) as end_id, round(min(score), 4) as score from s group by event_id""".replace("with obs", f"with {ENDS}, obs"))
def theta_best_runway(spark: SparkSession, sf_dir: str) -> DataFrame:
    runways = J.configured(ends(spark, sf_dir))  # at most a few hundred ends, from configuration
    pairs = obs(spark, sf_dir).crossJoin(runways)
    along, across = X.along_across(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("ux"), F.col("uy"))
    d = X.turn(((F.col("event_id") * 53) % 360).cast("double"), F.col("bearing"))
    pairs = pairs.withColumns({"along": along, "across": across, "d": d}).where((F.abs("d") <= 15) & (F.abs("across") <= 2000))
    band = F.greatest(F.lit(0.0), -F.col("along")) + F.greatest(F.lit(0.0), F.col("along") - 1.2 * F.col("length"))
    scored = pairs.withColumn("score", F.abs("across") + 0.3 * band + 50 * F.abs("d"))
    return J.best_match(scored, ["event_id"], "score", "pos", ["end_id"]).select("event_id", "end_id", F.round("score", 4).alias("score"))


@query(f"""with {WX}, {ENDS}, d as (select event_id, t // {SLICE * 96} as day, min(abs((bearing - wind_dir + 180) - 360 * floor((bearing - wind_dir + 180) / 360) - 180)) as off from wx, ends where pos <> event_id % 5 group by all)
select day, count(*) as n_reports, cast(count_if(off <= 60) as bigint) as n_match, round(avg(case when off <= 60 then 1.0 else 0.0 end), 6) as match_rate from d group by day""")
def wind_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = wx(spark, sf_dir).crossJoin(J.configured(ends(spark, sf_dir))).where(F.col("pos") != F.col("event_id") % 5)
    off = F.abs(X.turn(F.col("bearing"), F.col("wind_dir").cast("double")))
    near = pairs.groupBy("event_id", F.floor(F.col("t") / (SLICE * 96)).cast("long").alias("day")).agg(F.min(off).alias("off"))
    return near.groupBy("day").agg(F.count("*").alias("n_reports"), F.count_if(F.col("off") <= 60).alias("n_match"), F.round(F.avg((F.col("off") <= 60).cast("double")), 6).alias("match_rate"))


@query(f"""with {OBS}, r as (select *, t / 1e6 as ta, 60.0 as s, sum(60.0) over (partition by icao24 order by t, event_id) as cum from obs)
select icao24, count(*) as n, round(sum(w), 3) as total_wait, round(max(w), 3) as longest from (select icao24, cum + max(ta - (cum - s)) over (partition by icao24 order by t, event_id) - s - ta as w from r) group by icao24""")
def fifo_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrivals = obs(spark, sf_dir).withColumns({"at": F.col("t") / 1e6, "service": F.lit(60.0)})
    waits = W.fifo_waits(arrivals, ["icao24"], ["t", "event_id"], "at", "service")
    return waits.groupBy("icao24").agg(F.count("*").alias("n"), F.round(F.sum("wait"), 3).alias("total_wait"), F.round(F.max("wait"), 3).alias("longest"))


@query(f"""with {OBS}, base as (select icao24, t, event_id, t / 1e6 as ta, 60.0 as s, 0 as block from obs union all
  select icao24, min(t) + 3600000000, -1, (min(t) + 3600000000) / 1e6, 30.0, 1 from obs group by icao24),
plain as (select icao24, cum + max(ta - (cum - s)) over w - s - ta as w from (select *, sum(s) over (partition by icao24 order by t, block, event_id) as cum from base where block = 0) window w as (partition by icao24 order by t, block, event_id)),
held as (select icao24, block, cum + max(ta - (cum - s)) over w - s - ta as w from (select *, sum(s) over (partition by icao24 order by t, block, event_id) as cum from base) window w as (partition by icao24 order by t, block, event_id))
select p.icao24, round(h.w - p.w, 2) as extra_delay from (select icao24, sum(w) as w from plain group by 1) p join (select icao24, sum(w) filter (block = 0) as w from held group by 1) h on h.icao24 = p.icao24""")
def fifo_extra_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir).select("icao24", "t", "event_id", F.lit(60.0).alias("service"), F.lit(0).alias("block"))
    block = o.groupBy("icao24").agg((F.min("t") + 3_600_000_000).alias("t")).select("icao24", "t", F.lit(-1).cast("long").alias("event_id"), F.lit(30.0).alias("service"), F.lit(1).alias("block"))
    order = ["t", "block", "event_id"]
    waits = [W.fifo_waits(x.withColumn("at", F.col("t") / 1e6), ["icao24"], order, "at", "service").where("block = 0").groupBy("icao24").agg(F.sum("wait").alias("w")) for x in (o, o.unionByName(block))]
    return waits[0].withColumnRenamed("w", "plain").join(waits[1], "icao24").select("icao24", F.round(F.col("w") - F.col("plain"), 2).alias("extra_delay"))


@query(f"""with {WX}, g as (select event_id % 7 as station, event_id as issue, t as issued, k, case k when 0 then 'BASE' else ['FM', 'BECMG', 'TEMPO'][(event_id + k) % 3 + 1] end as kind,
  t + case k when 0 then 0 else (k * 5 + event_id % 4) * 3600000000 end as a, case k when 0 then vis else (event_id + k * 5) % 11 end as vis, case k when 0 then ceil else (event_id * 3 + k * 17) % 50 * 100 end as ceil from wx, range(4) r(k)),
i as (select *, case kind when 'TEMPO' then a + 7200000000 else issued + 86400000000 end as b, case kind when 'BASE' then 0 when 'TEMPO' then 2 else 1 end as rank from g),
ends as (select distinct station, unnest([a, b]) as edge from i), pieces as (select station, edge, lead(edge) over (partition by station order by edge) as upto from ends),
won as (select p.station, edge, upto, arg_max({{'issue': issue, 'k': k, 'kind': kind, 'vis': vis, 'ceil': ceil}}, (issued, issue, rank, a, k)) as v from pieces p join i on i.station = p.station and a <= edge and b >= upto where upto is not null group by p.station, edge, upto),
runs as (select *, sum(case when prev = edge and was = v then 0 else 1 end) over (partition by station order by edge) as run from (select *, lag(upto) over w as prev, lag(v) over w as was from won window w as (partition by station order by edge)))
select station, min(edge) as from_us, max(upto) as to_us, any_value(v.issue) as issue, any_value(v.kind) as kind, any_value(v.vis) as vis, any_value(v.ceil) as ceil from runs group by station, run""")
def forecast_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal forecasts, one for each sign-up, with three change groups each: the group that counts at every moment."""
    e, k, hour = F.col("event_id"), F.col("k"), 3_600_000_000
    g = wx(spark, sf_dir).select("event_id", "t", "vis", "ceil", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    kind = F.when(k == 0, "BASE").otherwise(F.get(F.array(*map(F.lit, ("FM", "BECMG", "TEMPO"))), ((e + k) % 3).cast("int")))
    begin = F.col("t") + F.when(k == 0, 0).otherwise((k * 5 + e % 4) * hour)
    g = g.select((e % 7).alias("station"), e.alias("issue"), F.struct("t", "event_id").alias("issued"), k.alias("group_no"), kind.alias("kind"), begin.alias("from_us"), F.when(kind == "TEMPO", begin + 2 * hour).otherwise(F.col("t") + 24 * hour).alias("to_us"), F.when(k == 0, F.col("vis")).otherwise((e + k * 5) % 11).alias("vis"), F.when(k == 0, F.col("ceil")).otherwise((e * 3 + k * 17) % 50 * 100).alias("ceil"))
    return R.forecast_timeline(g, hour).select("station", "from_us", "to_us", "issue", "kind", "vis", "ceil")


def geodesic_sql(rounds: int = G.ROUNDS) -> str:
    """CTEs up to plane (event_id, x, y): east and north of each place by the geodesic from the origin, round by round."""
    f, b = "(1 / 298.257223563::double)", 6378137.0 * (1 - 1 / 298.257223563)
    (s1, c1), e2 = G.reduced(33.9425), (6378137.0**2 - b**2) / b**2
    s1, c1 = f"{s1!r}::double", f"{c1!r}::double"
    out = [f"g0 as (select event_id, sin(u) as s2, cos(u) as c2, l, l as lam from (select event_id, atan((1 - {f}) * tan(radians(lat))) as u, radians(lon + 118.4081::double) as l from places))"]
    for k in range(rounds + 1):
        out.append(f"a{k} as (select *, c2 * sin(lam) as e, {c1} * s2 - {s1} * c2 * cos(lam) as n, {s1} * s2 + {c1} * c2 * cos(lam) as cs from g{k})")
        out.append(f"b{k} as (select *, sqrt(e * e + n * n) as sn, atan2(sqrt(e * e + n * n), cs) as arc from a{k})")
        out.append(f"c{k} as (select *, case when sn = 0 then 0 else {c1} * c2 * sin(lam) / sn end as al from b{k})")
        out.append(f"d{k} as (select *, 1 - al * al as sq, case when 1 - al * al = 0 then 0 else cs - 2 * {s1} * s2 / (1 - al * al) end as mid from c{k})")
        if k < rounds:
            out.append(f"e{k} as (select *, {f} / 16 * sq * (4 + {f} * (4 - 3 * sq)) as kk from d{k})")
            out.append(f"g{k + 1} as (select event_id, s2, c2, l, l + (1 - kk) * {f} * al * (arc + kk * sn * (mid + kk * cs * (2 * mid * mid - 1))) as lam from e{k})")
    out.append(f"h as (select *, sq * {e2!r}::double as u2 from d{rounds})")
    out.append("i as (select *, 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))) as aa, u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2))) as bb from h)")
    out.append(f"j as (select *, {b!r}::double * aa * (arc - bb * sn * (mid + bb / 4 * (cs * (2 * mid * mid - 1) - bb / 6 * mid * (4 * sn * sn - 3) * (4 * mid * mid - 3)))) as s from i)")
    out.append("plane as (select event_id, case when sn = 0 then 0 else s * e / sn end as x, case when sn = 0 then 0 else s * n / sn end as y from j)")
    return ", ".join(out)


@query(f"with {OBS}, places as (select event_id, 33.9425::double + y / 20000.0::double as lat, -118.4081::double + x / 20000.0::double as lon from obs), {geodesic_sql()} select p.event_id, round(x, 2) as x, round(y, 2) as y, round(lat, 7) as lat, round(lon, 7) as lon from plane p join places using (event_id)")
def geodesic_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within about 75 km of an origin on the azimuthal plane of the ellipsoid, and back again: lat and lon are the way back."""
    places = obs(spark, sf_dir).select("event_id", (33.9425 + F.col("y") / 20000.0).alias("lat"), (-118.4081 + F.col("x") / 20000.0).alias("lon"))
    plane = G.to_plane(places, "lat", "lon", 33.9425, -118.4081).drop("lat", "lon")
    back = G.from_plane(plane, "x", "y", 33.9425, -118.4081)
    return back.select("event_id", *(F.round(c, d).alias(c) for c, d in (("x", 2), ("y", 2), ("lat", 7), ("lon", 7))))


#: Runway use: the bundled events are thin, so a day of them counts as an hour; service and block in microseconds.
HOUR, SERVED, BLOCKED = 3_600_000_000, 60_000_000, 30_000_000


@query(f"""with {OBS}, arrivals as (select event_id % 5 as pos, t // 86400000000 as hour, t % 86400000000 // 24 as due, {SERVED} as service, 0 as block, event_id as id from obs where event_type = 'click'),
crossings as (select o_orderkey % 5 as pos, t0 // 86400000000 as hour, t0 % 86400000000 // 24 as due, {BLOCKED} as service, 1 as block, o_orderkey as id from (select o_orderkey, ({EPOCH} + o_orderkey * 977 % {SPAN}) * 1000000 as t0 from orders where o_orderstatus = 'P')),
held as (select *, sum(service) over w as s from (select * from arrivals union all select * from crossings) window w as (partition by pos, hour order by due, block, id)),
plain as (select *, sum(service) over w as s from arrivals window w as (partition by pos, hour order by due, block, id)),
p as (select pos, hour, due, s + max(due - s + service) over (partition by pos, hour order by due, block, id) - service - due as wait from plain),
h as (select pos, hour, due, block, s + max(due - s + service) over (partition by pos, hour order by due, block, id) - service - due as wait from held),
x as (select pos, hour, count(*) as n_arrivals, sum(wait) as wait, count(*) filter (due + wait < {HOUR}) as served from p group by pos, hour),
y as (select pos, hour, count(*) filter (block = 1) as n_crossings, sum(wait) filter (block = 0) as wait, count(*) filter (block = 0 and due + wait < {HOUR}) as served from h group by pos, hour)
select x.pos, x.hour, n_arrivals, n_crossings, cast(x.wait as bigint) as wait_us, cast(y.wait - x.wait as bigint) as extra_us, round(y.served / greatest(x.served, 1)::double, 6) as throughput_share from x join y on y.pos = x.pos and y.hour = x.hour""")
def throughput_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals of each runway and hour with and without crossings that block it: extra wait, and the share still begun within the hour."""
    day = 24 * HOUR

    def use(df: DataFrame, key: str, t: str, service: int, block: int) -> DataFrame:
        at = F.expr(f"{t} % {day} div 24")
        return df.select((F.col(key) % 5).alias("pos"), F.expr(f"{t} div {day}").alias("hour"), at.alias("at"), F.lit(service).cast("long").alias("service"), F.lit(block).alias("block"), F.col(key).alias("id"))

    arrivals = use(obs(spark, sf_dir).where("event_type = 'click'"), "event_id", "t", SERVED, 0)
    crossing = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", ((F.lit(EPOCH) + F.col("o_orderkey") * 977 % SPAN) * 1_000_000).alias("t0"))
    held = arrivals.unionByName(use(crossing, "o_orderkey", "t0", BLOCKED, 1))
    key, order, begun = ["pos", "hour"], ["at", "block", "id"], F.col("at") + F.col("wait") < HOUR
    x = W.fifo_scan(arrivals, key, order, "at", "service").groupBy(*key).agg(F.count("*").alias("n_arrivals"), F.sum("wait").alias("wait_us"), F.count_if(begun).alias("served"))
    mine = F.col("block") == 0
    y = W.fifo_scan(held, key, order, "at", "service").groupBy(*key).agg(F.count_if(~mine).alias("n_crossings"), F.sum(F.when(mine, F.col("wait"))).alias("held_us"), F.count_if(mine & begun).alias("held_served"))
    share = F.col("held_served") / F.greatest(F.col("served"), F.lit(1))
    return x.join(y, key).select(*key, "n_arrivals", "n_crossings", "wait_us", (F.col("held_us") - F.col("wait_us")).alias("extra_us"), F.round(share, 6).alias("throughput_share"))


@query(f"""with {OBS}, d as (select *, t // 86400000000 as day from obs), m as (select max(day) as last from d)
select day = last as held_out, count(*) as n, round(avg(speed), 4) as mean_speed from d, m group by 1""")
def temporal_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = obs(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86_400_000_000).cast("long"))
    return W.temporal_holdout(days, "day", ["event_id"]).groupBy("held_out").agg(F.count("*").alias("n"), F.round(F.avg("speed"), 4).alias("mean_speed"))


@query(f"""with {OBS}, t1 as (select icao24, (min(t) // {SLICE}) as slice from obs group by icao24), spine as (select unnest(range(min(slice), max(slice) + 1)) as slice from t1)
select s.slice, count(t1.icao24) as n_tracks from spine s left join t1 on t1.slice = s.slice group by s.slice""")
def track_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = obs(spark, sf_dir).groupBy("icao24").agg(F.min("t").alias("t"))
    spine = W.slice_spine(starts, "t", SLICE)
    placed = starts.select("icao24", F.floor(F.col("t") / SLICE).cast("long").alias("slice"))
    return spine.join(placed, "slice", "left").groupBy("slice").agg(F.count("icao24").alias("n_tracks"))
