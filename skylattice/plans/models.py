"""Planner and model queries. Their algorithms search or iterate, so SQL covers only parts of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import aggs as A
from ..operators import planner as P
from ..operators import risk as M
from ..operators import voxels as V
from .bridge import OBS, PATH_ORDER, WAYPOINTS, obs, table, waypoints
from .spatial import LOW, SHAPE, STEP

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def busy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every voxel of the grid with the traffic in it: crowded ones are closed, those without views risky."""
    n = A.voxel_counts(obs(spark, sf_dir), [], LOW, STEP, SHAPE)
    grid = spark.range(SHAPE[0] * SHAPE[1] * SHAPE[2]).select((F.col("id") % 20).alias("ix"), (F.floor(F.col("id") / 20) % 20).alias("iy"), F.floor(F.col("id") / 400).alias("iz"))
    return grid.join(n, V.KEY, "left").select(*V.KEY, F.coalesce("n", F.lit(0)).alias("n"))


BUSY = f"""{OBS}, n as (select cast(floor((x + 10000) / 1000.0) as bigint) as ix, cast(floor((y + 10000) / 1000.0) as bigint) as iy, cast(floor(z / 150.0) as bigint) as iz, count(*) as n from obs group by all),
busy as (select a.ix, b.iy, c.iz, coalesce(n, 0) as n from range(20) a(ix) cross join range(20) b(iy) cross join range(12) c(iz) left join n on n.ix = a.ix and n.iy = b.iy and n.iz = c.iz)"""


@query(f"""with {BUSY}, free as (select * from busy where n % 3 = 0), q as (select s_suppkey as query, s_suppkey * 7 % 20 as ix, s_suppkey * 11 % 20 as iy, s_suppkey * 5 % 12 as iz from supplier),
near as (select query, f.ix, f.iy, f.iz, greatest(abs(f.ix - q.ix), abs(f.iy - q.iy), abs(f.iz - q.iz)) as ring, f.ix - q.ix as di, f.iy - q.iy as dj, f.iz - q.iz as dk from q join free f on abs(f.ix - q.ix) <= 3 and abs(f.iy - q.iy) <= 3 and abs(f.iz - q.iz) <= 3),
s as (select query, arg_min({{'ix': ix, 'iy': iy, 'iz': iz, 'ring': ring}}, (ring, di, dj, dk)) as b from near group by query)
select query, b.ix as ix, b.iy as iy, b.iz as iz, cast(b.ring as integer) as ring from s""")
def snap_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    free = busy_grid(spark, sf_dir).where("n % 3 = 0")
    k = F.col("s_suppkey")
    asks = table(spark, sf_dir, "supplier").select(k.alias("query"), (k * 7 % 20).alias("ix"), (k * 11 % 20).alias("iy"), (k * 5 % 12).alias("iz"))
    return P.snap(asks, free, "query", 3).select("query", *V.KEY, F.col("ring").cast("int").alias("ring"))


@query()
def plan_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corridors between derived ends, one for each supplier, over the voxels that traffic leaves open."""
    k = F.col("s_suppkey")
    asks = table(spark, sf_dir, "supplier").select(k.alias("query"), *((k * a % n).cast("int").alias(c) for c, a, n in (("s_ix", 7, 20), ("s_iy", 11, 20), ("s_iz", 5, 12), ("g_ix", 13, 20), ("g_iy", 17, 20), ("g_iz", 5, 12))))
    grid = busy_grid(spark, sf_dir).select(*V.KEY, (F.lit(1000.0) - F.col("n") * 40).alias("sdf"), (F.col("n") < 20).alias("open"), (F.col("n") / 50.0).alias("risk"))
    found = P.plan_shared(asks, grid.orderBy(*V.KEY).toPandas(), (1000.0, 1000.0, 150.0), "B3", P.Vehicle(descent_limit=None))
    return found.select("query", "feasible", F.round("cost", 6).alias("cost"), "n_expansions", "n_waypoints")


@query(f"""with {WAYPOINTS}, e as (select path, arg_min({{'x': x, 'y': y, 'z': z}}, (k1, k2, k3)) as a, arg_max({{'x': x, 'y': y, 'z': z}}, (k1, k2, k3)) as b from waypoints group by path)
select path, k, round(a.x + (b.x - a.x) * (k / 9.0), 4) as x, round(a.y + (b.y - a.y) * (k / 9.0), 4) as y, greatest(a.z, b.z)::double as z from e, range(10) t(k)""")
def straight_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    here = F.struct("x", "y", "z")
    e = waypoints(spark, sf_dir).groupBy("path").agg(F.min_by(here, F.struct(*PATH_ORDER)).alias("a"), F.max_by(here, F.struct(*PATH_ORDER)).alias("b"))
    e = e.select("path", *(F.col(f"{s}.{c}").alias(f"{c}{k}") for s, k in (("a", 0), ("b", 1)) for c in "xyz"))
    return P.straight(e, 10).select("path", F.col("k").cast("long").alias("k"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "z")


@query()
def rdp_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = waypoints(spark, sf_dir)
    return P.simplify(w, "path", PATH_ORDER, 1500.0).select("path", *PATH_ORDER, "x", "y")


@query()
def risk_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on event features, days before the last for training, the last held out."""
    o = obs(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86_400_000_000).cast("long"))
    o = o.withColumn("risky", (F.col("z") + F.col("x") / 20 > 900).cast("int"))
    last = o.agg(F.max("day")).first()[0]
    known, held = o.where(F.col("day") < last), o.where(F.col("day") == last)
    fit, tune = known.where("event_id % 5 > 0"), known.where("event_id % 5 = 0")
    model = M.train(fit, ["x", "y", "z", "speed"], "risky")
    tuned, tested = (M.score(model, d).select("event_id", "risky", "p") for d in (tune, held))
    cover = M.calibrated(tuned, tested, "risky").agg(F.avg(F.col("covered").cast("double")).alias("coverage"), F.avg(F.col("high") - F.col("low")).alias("width"))
    return M.evaluate(tested, "risky").crossJoin(F.broadcast(cover))


@query()
def risk_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk of every voxel with traffic in every hour of the day, by a model fitted on all events, with intervals whose width
    comes from days that the scoring model had not seen."""
    o = obs(spark, sf_dir).withColumns({"day": F.floor(F.col("t") / 86_400_000_000).cast("long"), "risky": (F.col("z") + F.col("x") / 20 > 900).cast("int")})
    sin, cos = X.cyclic(F.floor(F.col("t") / 60_000_000) % 1440 / 60.0, 24.0)
    features = ["x", "y", "z", "hour_sin", "hour_cos"]
    known = o.select("day", "risky", *(F.col(c).cast("double").alias(c) for c in "xyz"), sin.alias("hour_sin"), cos.alias("hour_cos"))
    model, half = M.fit_calibrated(known, features, "risky", "day", folds=3, kind="lr")
    v = A.voxel_counts(o, [], LOW, STEP, SHAPE).select(*V.KEY, *((F.col(i) * s + a + s / 2).alias(c) for i, c, a, s in zip(V.KEY, "xyz", LOW, STEP, strict=True)))
    sin, cos = X.cyclic(F.col("hour"), 24.0)
    hours = spark.range(24).select(F.col("id").alias("hour")).withColumns({"hour_sin": sin, "hour_cos": cos})
    found = M.with_interval(M.score_grid(model, hours, v), half)
    return found.select("hour", *V.KEY, *(F.round(c, 6).alias(n) for c, n in (("p", "risk"), ("low", "low"), ("high", "high"))))


@query()
def sampled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments drawn over the time slices that events cover, ten for each slice."""
    slices = obs(spark, sf_dir).select(F.floor(F.col("t") / 900_000_000).cast("long").alias("slice")).distinct()
    numbered = slices.withColumn("slice_no", F.col("slice") - slices.agg(F.min("slice")).first()[0])
    n = numbered.count()
    return M.sample_segments(numbered, 10 * n, 10_000.0, 100.0, 500.0)
