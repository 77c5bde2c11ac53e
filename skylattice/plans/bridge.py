"""Domain inputs derived from the bundled tables by integer arithmetic, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import micros
from ..sources.readers import optional

SECOND = 1_000_000
MINUTE = 60 * SECOND
SLICE = 15 * MINUTE
#: Segments begin within a month from here, in seconds.
EPOCH, SPAN = 1_704_067_200, 2_592_000


#: The tables that queries read, for those that are absent.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; one of TABLES that is absent has no rows."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return optional(spark, path, TABLES[name]) if name in TABLES else spark.read.parquet(path)


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State vectors: one for each event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("user_id").alias("icao24"), micros("ts").alias("t"), "event_type",
        ((F.col("event_id") * 7919) % 20001 - 10000).alias("x"), ((F.col("event_id") * 104729) % 20001 - 10000).alias("y"), ((F.col("event_id") * 31) % 1800).alias("z"), F.col("value").alias("speed"),
    )


OBS = """obs as (select event_id, user_id as icao24, epoch_us(ts) as t, event_type, (event_id * 7919) % 20001 - 10000 as x,
  (event_id * 104729) % 20001 - 10000 as y, (event_id * 31) % 1800 as z, value as speed from events)"""


def wx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather reports: one for each sign-up."""
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return e.select("event_id", micros("ts").alias("t"), (F.col("event_id") * 37 % 360).alias("wind_dir"), (F.col("event_id") % 60 + 980).alias("qnh"), (F.col("event_id") % 11).alias("vis"), (F.col("event_id") % 50 * 100).alias("ceil"))


WX = "wx as (select event_id, epoch_us(ts) as t, event_id * 37 % 360 as wind_dir, event_id % 60 + 980 as qnh, event_id % 11 as vis, event_id % 50 * 100 as ceil from events where event_type = 'signup')"

# Axis vectors as exact decimals, so both engines compute with the same numbers.
AXES = ((0, 0.0, 1.0), (1, 0.951, 0.309), (2, 0.588, -0.809), (3, -0.588, -0.809), (4, -0.951, 0.309))


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runway ends: one for each region, landing towards its bearing, 3 km long, displaced from the origin."""
    r = table(spark, sf_dir, "region")
    pick = F.create_map(*(x for k, ux, uy in AXES for x in (F.lit(k), F.struct(F.lit(ux).alias("ux"), F.lit(uy).alias("uy")))))
    axis = F.try_element_at(pick, F.col("r_regionkey"))
    return r.select(F.col("r_name").alias("end_id"), F.col("r_regionkey").alias("pos"), (F.col("r_regionkey") * 72.0).alias("bearing"), axis["ux"].alias("ux"), axis["uy"].alias("uy"), (F.col("r_regionkey") * 400 - 800).alias("x0"), (F.col("r_regionkey") * 300 - 600).alias("y0"), F.lit(3000).alias("length"))


ENDS = f"""axes(k, ux, uy) as (values {", ".join(f"({k}, {ux:.3f}::double, {uy:.3f}::double)" for k, ux, uy in AXES)}),
ends as (select r_name as end_id, r_regionkey as pos, r_regionkey * 72.0 as bearing, ux, uy, r_regionkey * 400 - 800 as x0, r_regionkey * 300 - 600 as y0, 3000 as length from region join axes on k = r_regionkey)"""


def waypoints(spark: SparkSession, sf_dir: str, by_path: bool = False) -> DataFrame:
    """Path waypoints: one for each line item, in the order of its number and keys. by_path: dealt by their paths, by the keys alone, so
    plans that need each path's order share one shuffle of them."""
    w = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("k1"), F.col("l_partkey").alias("k2"), F.col("l_suppkey").alias("k3"))
    w = w.where("path is not null").repartition("path") if by_path else w
    return w.select(*w.columns, ((F.col("k2") * 7919) % 20001 - 10000).alias("x"), ((F.col("k3") * 104729 + F.col("k2") * 17) % 20001 - 10000).alias("y"), ((F.col("k2") * 13) % 900).alias("z"))


WAYPOINTS = """waypoints as (select l_orderkey as path, l_linenumber as k1, l_partkey as k2, l_suppkey as k3, (l_partkey * 7919) % 20001 - 10000 as x,
  (l_suppkey * 104729 + l_partkey * 17) % 20001 - 10000 as y, (l_partkey * 13) % 900 as z from lineitem)"""
PATH_ORDER = ["k1", "k2", "k3"]
