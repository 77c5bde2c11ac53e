"""Ordered operators: lags, running sums, first and last rows, queues, polylines.

All partition by a key that the caller names; order keys must be unique within it, so results do
not depend on file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RUNNING = (Window.unboundedPreceding, 0)


def first_rows(df: DataFrame, key: list[str], order: list[str | Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def latest_version(df: DataFrame, key: list[str], version: list[str], values: list[str]) -> DataFrame:
    """Values of the greatest version of each key, combined before the shuffle."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*version)).alias("__v")).select(*key, "__v.*")


def reject_outliers(points: DataFrame, key: str, time: str, altitude: str, speed: str, unit: float = 1e6, climb_m: float = 1000, jump_ms: float = 200, floor_m: float = -200, gap_s: float = 3600) -> DataFrame:
    """Points that follow the raw point before them plausibly; the one after a spike goes as well.

    A step counts only within a gap of more than 0 and less than gap_s seconds. Altitudes under
    floor_m go. Null measures never reject."""
    w = Window.partitionBy(key).orderBy(time)
    seconds = (F.col(time) - F.lag(time).over(w)) / unit
    steps = {"__dt": seconds, "__dz": F.abs(F.col(altitude) - F.lag(altitude).over(w)), "__dv": F.abs(F.col(speed) - F.lag(speed).over(w))}
    recent = (F.col("__dt") > 0) & (F.col("__dt") < gap_s)
    bad = (recent & ((F.col("__dz") > climb_m) | (F.col("__dv") > jump_ms))) | (F.col(altitude) < floor_m)
    return points.withColumns(steps).where(~F.coalesce(bad, F.lit(False))).drop(*steps)


def winners(counts: DataFrame, key: list[str], item: str, count: str, share: float = 0.5) -> DataFrame:
    """For each key the commonest items until their share reaches `share`, sorted, and the first one's share."""
    w = Window.partitionBy(*key).orderBy(F.desc(count), item)
    whole = Window.partitionBy(*key)
    ranked = counts.withColumns({"__before": F.coalesce(F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__all": F.sum(count).over(whole)})
    needed = ranked.where(F.col("__before") < F.lit(share) * F.col("__all"))
    return needed.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("active"), (F.max(count) / F.max("__all")).alias("top_share"))


def slice_spine(df: DataFrame, time: str, width: int, pad: int = 0) -> DataFrame:
    """Every slice number from the first to the last time of df, those without rows too."""
    ends = df.agg(F.floor(F.min(time) / width).cast("long").alias("a"), F.floor(F.max(time) / width).cast("long").alias("b"))
    return ends.where("a is not null").select(F.explode(F.sequence(F.col("a") - pad, F.col("b") + pad)).alias("slice"))


def ends_of_track(points: DataFrame, key: str, time: str, x: str, y: str, n: int = 5) -> DataFrame:
    """Offsets from the first to the n-th point of each track and from the n-th last to the last one."""
    up, down = (Window.partitionBy(key).orderBy(o) for o in (F.col(time), F.desc(time)))
    ranked = points.withColumns({"__up": F.row_number().over(up), "__down": F.row_number().over(down)}).where(f"__up <= {n} or __down <= {n}")

    def at(side: str, last: bool, c: str) -> Column:
        return (F.max_by if last else F.min_by)(F.when(F.col(side) <= n, F.col(c)), F.when(F.col(side) <= n, F.col(side)))

    return ranked.groupBy(key).agg(
        *((at("__up", True, c) - at("__up", False, c)).alias(f"start_d{c}") for c in (x, y)),
        *((at("__down", False, c) - at("__down", True, c)).alias(f"end_d{c}") for c in (x, y)),
    )


def arc_length(points: DataFrame, key: list[str], order: list[str], *axes: str) -> DataFrame:
    """Step and running length of each polyline."""
    w = Window.partitionBy(*key).orderBy(*order)
    step = F.sqrt(sum((F.pow(F.col(a) - F.lag(a).over(w), 2) for a in axes), F.lit(0.0)))
    stepped = points.withColumn("step", F.coalesce(step, F.lit(0.0)))
    return stepped.withColumn("arc", F.sum("step").over(w.rowsBetween(*RUNNING)))


def strided(points: DataFrame, key: list[str], order: list[str], keep: int) -> DataFrame:
    """Every k-th point of each polyline, counted from 0 as at, with k such that about `keep` of them stay."""
    at = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    stride = F.greatest(F.lit(1).cast("long"), F.expr(f"n div {keep}"))
    return points.withColumns({"at": at, "n": F.count("*").over(Window.partitionBy(*key))}).where(F.col("at") % stride == 0).drop("n")


def axis_crossings(points: DataFrame, key: list[str], order: list[str], along: str, across: str, reach: float) -> DataFrame:
    """How often each path changes side of an axis within reach of its origin; a touch of zero counts twice."""
    w = Window.partitionBy(*key).orderBy(*order)
    near = points.where(F.abs(F.col(along)) <= reach).withColumn("__side", F.signum(across))
    changed = near.withColumn("__change", (F.abs(F.col("__side") - F.lag("__side").over(w)) >= 1).cast("long"))
    return changed.groupBy(*key).agg(F.coalesce(F.sum("__change"), F.lit(0)).alias("crossings"))


def turn_angles(points: DataFrame, key: list[str], order: list[str], x: str, y: str) -> DataFrame:
    """Degrees between the step into each point and the step before it; null without two real steps."""
    w = Window.partitionBy(*key).orderBy(*order)
    s = points.withColumns({"__dx": F.col(x) - F.lag(x).over(w), "__dy": F.col(y) - F.lag(y).over(w)})
    px, py = F.lag("__dx").over(w), F.lag("__dy").over(w)
    norm = F.sqrt((F.col("__dx") ** 2 + F.col("__dy") ** 2) * (px**2 + py**2))
    cosine = F.least(F.greatest((F.col("__dx") * px + F.col("__dy") * py) / F.nullif(norm, F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))
    return s.withColumn("turn_deg", F.degrees(F.acos(cosine))).drop("__dx", "__dy")


def fifo_waits(arrivals: DataFrame, key: list[str], order: list[str], at: str, service: str) -> DataFrame:
    """Waiting time of each arrival at a single server, first come first served.

    Departure n is S(n) + max over i <= n of (a(i) - S(i - 1)), S the running service time."""
    w = Window.partitionBy(*key).orderBy(*order)
    done = F.sum(service).over(w.rowsBetween(*RUNNING))
    summed = arrivals.withColumn("__s", done)
    latest = F.max(F.col(at) - (F.col("__s") - F.col(service))).over(w.rowsBetween(*RUNNING))
    return summed.withColumn("wait", F.col("__s") + latest - F.col(service) - F.col(at)).drop("__s")


def resample_polyline(points: DataFrame, key: list[str], order: list[str], x: str, y: str, n: int) -> DataFrame:
    """n points at equal arc lengths of each polyline, linear between its vertices; one vertex repeats."""
    w = Window.partitionBy(*key).orderBy(*order)
    legs = arc_length(points, key, order, x, y)
    legs = legs.withColumns({"__x1": F.lead(x).over(w), "__y1": F.lead(y).over(w), "__to": F.lead("arc").over(w), "__all": F.max("arc").over(Window.partitionBy(*key)), "__rank": F.row_number().over(w), "__n": F.count("*").over(Window.partitionBy(*key))})
    grid = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spots = legs.withColumn("k", grid).withColumn("__s", F.col("__all") * F.col("k") / (n - 1))
    last = (F.col("k") == n - 1) & (F.col("__rank") == F.greatest(F.col("__n") - 1, F.lit(1)))
    inner = (F.col("k") < n - 1) & (F.col("arc") <= F.col("__s")) & (F.col("__s") < F.col("__to"))
    still = (F.col("__all") == 0) & (F.col("__rank") == 1)
    hit = spots.where(F.when(F.col("__all") == 0, still).otherwise(inner | last))
    share = F.coalesce((F.col("__s") - F.col("arc")) / F.nullif(F.col("__to") - F.col("arc"), F.lit(0.0)), F.lit(0.0))
    put = [(F.col(a) + (F.coalesce(b, a) - F.col(a)) * share).alias(a) for a, b in ((x, "__x1"), (y, "__y1"))]
    return hit.select(*key, "k", *put)


def temporal_holdout(df: DataFrame, day: str, key: list[str], share: float = 0.2) -> DataFrame:
    """held_out: rows of the last day; of a single day, a share by hashed key. The ends of the days are one small row."""
    ends = df.agg(F.min(day).alias("__first"), F.max(day).alias("__last"))
    some = F.pmod(F.xxhash64(*key), F.lit(1000)) < int(share * 1000)
    held = F.when(F.col("__first") == F.col("__last"), some).otherwise(F.col(day) == F.col("__last"))
    return df.crossJoin(F.broadcast(ends)).withColumn("held_out", held).drop("__first", "__last")


#: Rows of a range of running_sums, about.
RANGE_ROWS = 100_000


def range_cuts(df: DataFrame, order: str, ranges: int | None = None, rows: int | None = None) -> list[float]:
    """Values of a column that cut df into ranges of about `rows` rows (RANGE_ROWS); the driver knows only these."""
    ranges = ranges or max(1, min(1024, df.count() // (rows or RANGE_ROWS)))
    return sorted(set(df.approxQuantile(order, [k / ranges for k in range(1, ranges)], 0.5 / ranges))) if ranges > 1 else []


def range_of(order: str, cuts: list[float]) -> Column:
    """Number of the range that a value lies in."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order))) if cuts else F.lit(0)


def fifo_scan(arrivals: DataFrame, key: list[str], order: list[str], at: str, service: str, ranges: int | None = None) -> DataFrame:
    """fifo_waits where one server may hold very many arrivals: a (max, plus) scan in two passes over ranges.

    Serving a stretch of arrivals turns the time a server is free, D, into max(D + S, M): S is the stretch's service
    time and M the end of its service had the server been free throughout. Such maps compose, so ranges of the first
    column of order are scanned by themselves, and each takes over what the maps of those before it, one row a
    range, make of an idle server. A null time or service is an error of the caller's."""
    placed = arrivals.withColumn("__range", range_of(order[0], range_cuts(arrivals, order[0], ranges)))
    w = Window.partitionBy(*key, "__range").orderBy(*order).rowsBetween(*RUNNING)
    inner = placed.withColumn("__s", F.sum(service).over(w))
    inner = inner.withColumn("__m", F.max(F.col(at) - (F.col("__s") - F.col(service))).over(w))
    maps = placed_maps(inner, key, service)
    earlier = Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    maps = maps.withColumn("__before", F.coalesce(F.sum("__all").over(earlier), F.lit(0)))
    maps = maps.withColumn("__since", F.max(F.col("__late") - F.col("__before")).over(earlier))
    carried = maps.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key)), F.col("__range").alias("__r"), "__before", "__since")
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    found = inner.join(carried, same)
    latest = F.greatest(F.col("__m"), F.col("__since") + F.col("__before"))  # greatest skips nulls: nothing came before
    return found.withColumn("wait", F.col("__s") + latest - F.col(service) - F.col(at)).drop("__s", "__m", "__range", "__r", "__before", "__since", *(f"__k{i}" for i in range(len(key))))


def placed_maps(inner: DataFrame, key: list[str], service: str) -> DataFrame:
    """(key, __range, __all, __late): of each range its service time, and the latest start less service before it."""
    return inner.groupBy(*key, "__range").agg(F.sum(service).alias("__all"), F.max("__m").alias("__late"))


def running_sums(df: DataFrame, order: str, sums: dict[str, str], ranges: int | None = None) -> DataFrame:
    """Running sums over the whole table in the order of a column of distinct values, by default in ranges of about RANGE_ROWS.

    The table is cut into ranges of values, of which the driver knows only the cuts; each range is
    summed by itself and shifted by the totals of those before it, one row for each range."""
    placed = df.withColumn("__range", range_of(order, range_cuts(df, order, ranges)))
    totals = placed.groupBy("__range").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("__range", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__{n}") for n in sums))
    w = Window.partitionBy("__range").orderBy(order).rowsBetween(*RUNNING)
    summed = placed.withColumns({n: F.sum(c).over(w) for n, c in sums.items()}).join(F.broadcast(shift), "__range")
    return summed.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__range", *(f"__{n}" for n in sums))
