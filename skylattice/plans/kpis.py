"""Indicator, parsing, model-metric and relational queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import aggs as A
from ..operators import joins as J
from ..operators import windows as W
from ..sources import readers as R
from .bridge import OBS, SLICE, WX, obs, table, wx

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""with s as (select s_suppkey, s_name, (s_suppkey * 37 % 1800) / 10.0 - 90 as lat, (s_suppkey * 91 % 3600) / 10.0 - 180 as lon from supplier),
n as (select n_name, n_nationkey * 6.0 - 70 as lat, n_nationkey * 13.0 - 160 as lon from nation),
d as (select s_suppkey, n_name, 2 * 3440.065 * asin(least(1, sqrt(pow(sin(radians(s.lat - n.lat) / 2), 2) + cos(radians(n.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - n.lon) / 2), 2)))) as nm from s, n)
select s_suppkey, n_name, round(nm, 3) as nm from d where nm <= 600""")
def haversine_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 37 % 1800) / 10.0 - 90).alias("lat"), ((F.col("s_suppkey") * 91 % 3600) / 10.0 - 180).alias("lon"))
    n = table(spark, sf_dir, "nation").select("n_name", (F.col("n_nationkey") * 6.0 - 70).alias("lat0"), (F.col("n_nationkey") * 13.0 - 160).alias("lon0"))
    nm = X.haversine_nm(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    near = J.box_join(s, n, {("lat", "lat0"): 11.0}, nm <= 600)  # 600 NM are ten degrees of latitude
    return near.select("s_suppkey", "n_name", F.round(nm, 3).alias("nm"))


@query("select l_partkey, arg_max(l_orderkey, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) as l_orderkey, max(l_shipdate) as l_shipdate, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) as l_quantity from lineitem group by l_partkey")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.latest_version(table(spark, sf_dir, "lineitem"), ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"], ["l_orderkey", "l_shipdate", "l_quantity"])


@query("select (select count(*) from (select o_orderkey from orders except select l_orderkey from lineitem)) as only_left, (select count(*) from (select l_orderkey from lineitem except select o_orderkey from orders)) as only_right")
def key_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return J.same_keys(o, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


@query("select kind, count(*) as n, round(sum(o_totalprice), 2) as price, round(sum(c_acctbal), 2) as balance from (select 'order' as kind, o_orderkey as key, o_totalprice from orders union all by name select 'customer' as kind, c_custkey as key, c_acctbal from customer) group by kind")
def union_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("key"), "o_totalprice")
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), "c_acctbal")
    return o.unionByName(c, allowMissingColumns=True).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("select a.n_name as src, b.n_name as dst, r_name as day, h as hour, 'B' || w as baseline from nation a join nation b on a.n_nationkey <> b.n_nationkey cross join region cross join (values (8), (11), (17)) t(h) cross join (values (0), (1), (2), (3)) v(w)")
def cartesian_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The sweep's sides are configuration: a few vertiports, days, hours and baselines.
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("ka"), F.col("n_name").alias("src")), n.select(F.col("n_nationkey").alias("kb"), F.col("n_name").alias("dst"))
    sweep = a.crossJoin(J.configured(b)).where("ka <> kb").crossJoin(J.configured(table(spark, sf_dir, "region").select(F.col("r_name").alias("day"))))
    hours, lines = F.array(*map(F.lit, (8, 11, 17))), F.array(*(F.lit(f"B{k}") for k in range(4)))
    return sweep.withColumn("hour", F.explode(hours)).withColumn("baseline", F.explode(lines)).select("src", "dst", "day", "hour", "baseline")


@query("""with t as (select o_custkey % 25 as origin, o_orderkey % 25 as dest, o_totalprice as pax, hour(o_orderdate) as h from orders)
select n_nationkey, cast(count(*) as bigint) as n_markets, round(greatest(sum(pax) / 1e6, 0.1), 4) as weight from nation join t on origin = n_nationkey or dest = n_nationkey group by n_nationkey""")
def origin_or_dest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("origin"), (F.col("o_orderkey") % 25).alias("dest"), F.col("o_totalprice").alias("pax"))
    # One row for each distinct end of a trip, so the disjunction is an equi-join.
    touched = t.withColumn("n_nationkey", F.explode(F.array_distinct(F.array("origin", "dest"))))
    weight = F.greatest(F.sum("pax") / 1e6, F.lit(0.1))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"))
    return touched.join(J.configured(nations), "n_nationkey").groupBy(F.col("n_nationkey").cast("int").alias("n_nationkey")).agg(F.count("*").alias("n_markets"), F.round(weight, 4).alias("weight"))


@query("""with m as (select o_orderpriority as pair, avg(o_totalprice) filter (o_orderkey % 4 = 2) as b2, avg(o_totalprice) filter (o_orderkey % 4 = 3) as b3 from orders group by 1)
select pair, round(b2, 4) as b2, round(b3, 4) as b3, round(b3 - b2, 3) as gain from m""")
def pivot_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("pair"), F.concat(F.lit("b"), F.col("o_orderkey") % 4).alias("baseline"), "o_totalprice")
    wide = o.groupBy("pair").pivot("baseline", ["b2", "b3"]).agg(F.avg("o_totalprice"))
    return wide.select("pair", F.round("b2", 4).alias("b2"), F.round("b3", 4).alias("b3"), F.round(F.col("b3") - F.col("b2"), 3).alias("gain"))


@query("""select o_orderkey % 4 as baseline, count(*) as n, round(100.0 * avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end), 6) as feasible_pct,
  round(avg(o_totalprice) filter (o_orderstatus = 'F'), 4) as mean_length, round(avg(o_totalprice), 4) as mean_all from orders group by 1""")
def filtered_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("o_orderstatus") == "F"
    o = table(spark, sf_dir, "orders").withColumn("baseline", F.col("o_orderkey") % 4)
    return o.groupBy("baseline").agg(F.count("*").alias("n"), F.round(100.0 * F.avg(ok.cast("double")), 6).alias("feasible_pct"), F.round(F.avg(F.when(ok, F.col("o_totalprice"))), 4).alias("mean_length"), F.round(F.avg("o_totalprice"), 4).alias("mean_all"))


@query("""with m as (select o_orderpriority, year(o_orderdate) as y, o_orderkey % 4 as b, avg(o_totalprice) as v from orders group by all),
l as (select *, coalesce(v <= lag(v) over (partition by o_orderpriority, y order by b) + 1e-9, true) as ok from m)
select o_orderpriority, y as "year", bool_and(ok) as monotone, count(*) as n_ranks from l group by all""")
def pareto_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.year("o_orderdate").cast("long").alias("year"), (F.col("o_orderkey") % 4).alias("b"), "o_totalprice")
    return A.monotone(o, ["o_orderpriority", "year"], "b", "o_totalprice")


SCORED = "scored as (select l.quality as y, (n_chars % 997) / 1000.0 as p from labels l join documents d on d.doc_id = l.doc_id)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") % 997 / 1000.0).alias("p"))


@query(f"""with {SCORED}, c as (select p, sum(y) as pos, count(*) as n from scored group by p),
r as (select *, sum(n - pos) over (order by p) - (n - pos) as below, sum(pos) over (order by p desc) as found, sum(n) over (order by p desc) as shown from c),
s as (select sum(pos) as np, sum(n - pos) as nn, sum(pos * (below + (n - pos) / 2.0)) as a, sum(pos * found::double / shown) as ap, sum(-(pos * ln(greatest(least(p, 1 - 1e-6), 1e-6)) + (n - pos) * ln(1 - greatest(least(p, 1 - 1e-6), 1e-6)))) as ll from r)
select cast(np as bigint) as n_positive, cast(nn as bigint) as n_negative, round(a / (np * nn), 6) as auroc, round(ap / np, 6) as average_precision, round(ll / (np + nn), 6) as log_loss from s""")
def auroc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.ranking_metrics(scored(spark, sf_dir), "y", "p")
    return m.select("n_positive", "n_negative", *(F.round(c, 6).alias(c) for c in ("auroc", "average_precision", "log_loss")))


@query("""with s as (select abs(value - 100) / 1000.0 as s, event_id, value from events), n as (select count(*) as n from s),
r as (select s, row_number() over (order by s) as k, n from s, n), q as (select min(s) filter (k >= ceil((n - 1) * least(1, ceil((n + 1) * 0.9) / n)) + 1) as q, any_value(n) as n from r)
select n, round(q, 6) as quantile, round(avg(case when s <= q then 1.0 else 0.0 end), 6) as coverage from s, q group by all""")
def conformal_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").select((F.abs(F.col("value") - 100) / 1000.0).alias("s"))
    q = A.higher_quantile(s, "s", A.conformal_level(0.1))
    return s.crossJoin(F.broadcast(q)).groupBy("n", "quantile").agg(F.avg((F.col("s") <= F.col("quantile")).cast("double")).alias("coverage")).select("n", F.round("quantile", 6).alias("quantile"), F.round("coverage", 6).alias("coverage"))


CONFIGS = ("click", "view", "purchase", "signup")


@query(f"select event_id, {', '.join(f"(event_type = '{c}')::int as cfg_{c}" for c in CONFIGS)} from events")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", *((F.col("event_type") == c).cast("int").alias(f"cfg_{c}") for c in CONFIGS))


@query(f"""with {WX} select event_id, round(sin((t // 3600000000 % 24) * (2 * pi() / 24)), 6) as hour_sin, round(cos((t // 3600000000 % 24) * (2 * pi() / 24)), 6) as hour_cos,
  round(coalesce(sin(radians(case when event_id % 7 > 0 then wind_dir end)), 0), 6) as wind_sin, round(coalesce(cos(radians(case when event_id % 7 > 0 then wind_dir end)), 0), 6) as wind_cos,
  round(coalesce(case when vis > 0 then vis * 1609.344 end, 16000.0), 3) as visibility_m from wx""")
def cyclic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wx(spark, sf_dir)
    hour = F.floor(F.col("t") / 3_600_000_000) % 24
    (hs, hc), (ws, wc) = X.cyclic(hour, 24.0), X.cyclic(F.when(F.col("event_id") % 7 > 0, F.col("wind_dir")), 360.0)
    vis = F.coalesce(F.when(F.col("vis") > 0, F.col("vis") * X.SM_M), F.lit(16000.0))
    return w.select("event_id", F.round(hs, 6).alias("hour_sin"), F.round(hc, 6).alias("hour_cos"), F.round(ws, 6).alias("wind_sin"), F.round(wc, 6).alias("wind_cos"), F.round(vis, 3).alias("visibility_m"))


REPORT = """'KXYZ 011253Z ' || case when event_id % 9 = 0 then 'VRB' else lpad(cast(event_id * 10 % 360 as varchar), 3, '0') end || lpad(cast(event_id % 40 as varchar), 2, '0')
  || case when event_id % 3 = 0 then 'G' || lpad(cast(event_id % 40 + 10 as varchar), 2, '0') else '' end || 'KT '
  || case when event_id % 4 = 0 then '1 1/2SM' when event_id % 4 = 1 then 'M1/4SM' else cast(event_id % 10 + 1 as varchar) || 'SM' end || ' BKN' || lpad(cast(event_id % 50 as varchar), 3, '0') || ' OVC' || lpad(cast(event_id % 50 + 10 as varchar), 3, '0')
  || case when event_id % 5 = 0 then ' M05/M11' else ' 17/09' end || case when event_id % 2 = 0 then ' A2992' else ' Q1009' end"""


@query(f"""with r as (select event_id, ' ' || {REPORT} || ' ' as s from events),
f as (select event_id, try_cast(nullif(regexp_extract(s, ' (VRB|\\d{{3}})(\\d{{2,3}})(?:G(\\d{{2,3}}))?KT ', 1), '') as double) as d, cast(nullif(regexp_extract(s, ' (VRB|\\d{{3}})(\\d{{2,3}})(?:G(\\d{{2,3}}))?KT ', 2), '') as double) as kt,
  cast(nullif(regexp_extract(s, ' (VRB|\\d{{3}})(\\d{{2,3}})(?:G(\\d{{2,3}}))?KT ', 3), '') as double) as gust,
  case when event_id % 4 = 0 then 1.5 when event_id % 4 = 1 then 0.25 else event_id % 10 + 1.0 end as vis, case when event_id % 5 = 0 then -5.0 else 17.0 end as temp, case when event_id % 5 = 0 then -11.0 else 9.0 end as dew,
  case when event_id % 2 = 0 then 29.92 * 33.8639 else 1009.0 end as hpa, event_id % 50 * 100.0 as ceil from r)
select event_id, coalesce(d, -1) as wind_dir_deg, kt as wind_kt, coalesce(gust, -1) as wind_gust_kt, vis as vis_sm, temp as temp_c, dew as dewpoint_c, round(hpa, 4) as altim_hpa, ceil as ceiling_ft,
  case when vis < 1 or ceil < 500 then 'LIFR' when vis < 3 or ceil < 1000 then 'IFR' when vis < 5 or ceil < 3000 then 'MVFR' else 'VFR' end as flight_rule from f""")
def metar_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select("event_id", F.expr(REPORT.replace("varchar", "string")).alias("raw"))
    f = R.weather_lines(raw, "raw")
    none = [F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("wind_dir_deg", "wind_gust_kt")]
    return f.select("event_id", *none, "wind_kt", "vis_sm", "temp_c", "dewpoint_c", F.round("altim_hpa", 4).alias("altim_hpa"), "ceiling_ft", "flight_rule")


@query("""with {OBS}, w as (select *, (x % 60) as m, abs(x) % 90 as d from obs)
select event_id, 'O' || lpad(cast(event_id as varchar), 8, '0') as obstacle_id, round(-(abs(x) % 90 + (abs(y) % 60) / 60.0 + (z % 60) / 3600.0), 6) as lat, case event_id % 3 when 0 then 'TOWER' when 1 then 'BLDG' else 'POLE' end as kind,
  round((z % 1000) * 0.3048, 4) as agl_m, round((z % 1000 + 100) * 0.3048, 4) as msl_m, case event_id % 2 when 0 then 'red lights' else 'none' end as lighting from w""".replace("{OBS}", OBS))
def fixed_width_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir)
    line = F.format_string(
        "O%08d %-25s%02d %02d %05.2fS %03d 00 00.00W %-18s   %05d %05d   1 1 %s",
        "event_id", F.lit("US"), F.abs("x") % 90, F.abs("y") % 60, (F.col("z") % 60).cast("double"), F.abs("y") % 180,
        F.element_at(F.array(*map(F.lit, ("TOWER", "BLDG", "POLE"))), (F.col("event_id") % 3 + 1).cast("int")), F.col("z") % 1000, F.col("z") % 1000 + 100, F.when(F.col("event_id") % 2 == 0, "R").otherwise("N"),
    )
    found = R.obstacle_lines(o.select("event_id", line.alias("value")), R.OBSTACLE_LAYOUT)
    return found.select("event_id", "obstacle_id", F.round("lat", 6).alias("lat"), "kind", F.round("agl_m", 4).alias("agl_m"), F.round("msl_m", 4).alias("msl_m"), "lighting")


@query("select event_type, count(*) as n, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as k_sum, cast(max(cast(json_extract(props, '$.k') as bigint)) as bigint) as k_max from events group by event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


@query(f"""with {WX}, h as (select t // 3600000000 % 24 as hour, vis, ceil from wx)
select hour, count(*) as n, round(100.0 * avg(case when vis >= 3 and ceil >= 1000 then 1.0 else 0.0 end), 6) as reliability_pct, cast(count_if(vis < 5 / 1.609 or ceil < 1000) as bigint) as n_instrument from h group by hour""")
def weather_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = wx(spark, sf_dir).withColumn("hour", F.floor(F.col("t") / 3_600_000_000) % 24)
    rule = X.flight_rule(F.col("vis"), F.col("ceil"))
    ok = (F.col("vis") >= 3) & (F.col("ceil") >= 1000)
    return h.groupBy("hour").agg(F.count("*").alias("n"), F.round(100.0 * F.avg(ok.cast("double")), 6).alias("reliability_pct"), F.count_if(X.instrument_weather(F.col("vis"), F.col("ceil"), F.when(rule == "LIFR", rule))).alias("n_instrument"))


@query("""with c as (select o_orderkey as id, o_orderstatus <> 'P' as feasible, o_totalprice / 100.0 as length from orders),
w as (select l_orderkey as id, count(*) as n, min(l_quantity) - 3 as margin, avg(case when l_quantity <= 3 then 1.0 else 0.0 end) as rate from lineitem group by 1)
select c.id, coalesce(n, 0) as n_waypoints, case when feasible then round(coalesce(rate, 0), 6) else 1.0 end as violation_rate, case when feasible then coalesce(margin, -1) else -1 end as min_margin,
  round(3600 / (length / 67.0 + 60), 6) as ops_per_hour, round((length * 1.4 / 1000 / 50) * 60 - length / 67.0 / 60, 4) as saving_min from c left join w on w.id = c.id""")
def joint_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") != "P").alias("feasible"), (F.col("o_totalprice") / 100.0).alias("length"))
    w = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), (F.min("l_quantity") - 3).alias("margin"), F.avg((F.col("l_quantity") <= 3).cast("double")).alias("rate"))
    k = c.join(w, "id", "left")
    flight = F.col("length") / 67.0
    return k.select(
        "id", F.coalesce("n", F.lit(0)).alias("n_waypoints"),
        F.when(F.col("feasible"), F.round(F.coalesce("rate", F.lit(0.0)), 6)).otherwise(1.0).alias("violation_rate"),
        F.when(F.col("feasible"), F.coalesce("margin", F.lit(-1.0))).otherwise(-1.0).alias("min_margin"),
        F.round(3600 / (flight + 60), 6).alias("ops_per_hour"), F.round(F.col("length") * 1.4 / 1000 / 50 * 60 - flight / 60, 4).alias("saving_min"),
    )
