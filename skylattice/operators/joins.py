"""Joins that Spark has no operator for: as-of, interval, range and proximity, as equi-joins with residuals.

A non-equi condition alone makes a nested-loop join. Each helper here first derives a key that any
matching pair must share (a time slice, a bucket, a cell), joins on it, then tests the condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import range_cuts, range_of


def configured(df: DataFrame, most: int = 5_000) -> DataFrame:
    """df to be broadcast: more than `most` rows are an error, as configuration is small. The rows are counted in the plan
    that uses them, on one more than `most` at most, so what df is made of runs once."""
    counted = df.limit(most + 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    few = F.when(F.col("__n") <= most, F.lit(True)).otherwise(F.raise_error(F.lit(f"more than {most} rows are no configuration")).cast("boolean"))
    return F.broadcast(counted.where(few).drop("__n"))


#: Rows of a time slice of asof_nearest where no key spreads them, about.
SLICE_ROWS = 200_000


def slice_of(left: DataFrame, right: DataFrame, time: str) -> Column:
    """Numbers of slices of about SLICE_ROWS rows each, cut at quantiles of all times, so stray times leave the others spread."""
    times = left.select(time).unionByName(right.select(time)).where(F.col(time).isNotNull())
    return range_of(time, range_cuts(times, time, rows=SLICE_ROWS))


def asof_nearest(left: DataFrame, right: DataFrame, time: str, by: list[str], values: list[str], tie: str, tolerance: int | None = None, slice_: int | None = None) -> DataFrame:
    """left with the values of the row of right whose time is nearest, by equal keys; ties go to the earlier row.

    Times are longs. History is cut into slices of slice_ time units (by default as many as the rows ask for); the
    last right row before a slice and the first after it are found on one row for each slice and stand at its edges,
    so a key with very much history is spread. Rows look back in both orders of time, as a frame of all that
    follows would be scanned anew for every row. Of right rows at one time, an earlier one counts by its largest
    tie, a later one by its smallest."""
    number = slice_of(left, right, time) if not by and slice_ is None else F.floor(F.col(time) / (slice_ or 86_400_000_000))
    found = F.struct(F.col(time).alias("t"), F.col(tie).alias("k"), *values)
    rows = right.where(F.col(time).isNotNull()).withColumns({"__slice": number, "__row": found})
    keys = [*by, "__slice"]
    edges = rows.groupBy(*keys).agg(F.min("__row").alias("__first"), F.max("__row").alias("__last"))
    asked = left.withColumn("__slice", number)
    spine = asked.select(*keys).unionByName(rows.select(*keys)).distinct().join(edges, keys, "left")
    earlier, later = (Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, -1) for c in (F.asc("__slice"), F.desc("__slice")))
    carried = spine.select(*keys, F.last("__last", True).over(earlier).alias("__before"), F.last("__first", True).over(later).alias("__after"))
    one = asked.withColumns({"__t": F.col(time), "__side": F.lit(1), "__k": F.lit(None).cast(right.schema[tie].dataType), "__row": F.lit(None).cast(rows.schema["__row"].dataType)})
    two = rows.select(*keys, F.col(time).alias("__t"), F.lit(0).alias("__side"), F.col(tie).alias("__k"), "__row")
    both = one.unionByName(two, allowMissingColumns=True)
    back, ahead = (Window.partitionBy(*keys).orderBy(*(way(c) for c in ("__t", "__side", "__k"))).rowsBetween(Window.unboundedPreceding, 0) for way in (F.asc, F.desc))
    near = both.withColumn("__b", F.last("__row", True).over(back)).withColumn("__a", F.last("__row", True).over(ahead)).where("__side = 1")
    near = near.join(carried, keys, "left").withColumns({"__b": F.coalesce("__b", "__before"), "__a": F.coalesce("__a", "__after")})
    since, until = F.col("__t") - F.col("__b.t"), F.col("__a.t") - F.col("__t")
    pick = F.when(F.col("__a").isNull() | (since <= until), F.col("__b")).otherwise(F.col("__a"))
    if tolerance is not None:
        pick = F.when(F.least(since, until) <= tolerance, pick)
    near = near.withColumn("__pick", pick)
    return near.select(*(c for c in left.columns), *(F.col(f"__pick.{v}").alias(v) for v in values))


def buckets(start: Column, end: Column, width: int) -> Column:
    """All bucket numbers that the closed interval touches."""
    return F.sequence(F.floor(start / width).cast("long"), F.floor(end / width).cast("long"))


def interval_join(points: DataFrame, at: str, intervals: DataFrame, start: Column, end: Column, width: int, how: str = "inner") -> DataFrame:
    """Pairs with start <= at < end; width about the length of an interval keeps copies few."""
    spread = intervals.withColumns({"__start": start, "__end": end}).withColumn("__bucket", F.explode(buckets(F.col("__start"), F.col("__end"), width)))
    held = points.withColumn("__bucket", F.floor(F.col(at) / width).cast("long"))
    inside = (F.col(at) >= F.col("__start")) & (F.col(at) < F.col("__end"))
    keyed = spread.withColumnRenamed("__bucket", "__bucket_r")
    return held.join(keyed, (F.col("__bucket") == F.col("__bucket_r")) & inside, how).drop("__bucket", "__bucket_r", "__start", "__end")


def box_join(a: DataFrame, b: DataFrame, reach: dict[tuple[str, str], float], condition: Column) -> DataFrame:
    """Pairs within reach in every named pair of columns, that also meet the condition.

    Cells are as wide as the reach; a row of a looks into the 3**n cells around its own, so each
    pair meets once."""
    for k, ((x, y), width) in enumerate(reach.items()):
        a = a.withColumn(f"__c{k}", F.explode(F.sequence(*(F.floor(F.col(x) / width).cast("long") + d for d in (-1, 1)))))
        b = b.withColumn(f"__d{k}", F.floor(F.col(y) / width).cast("long"))
    same = [F.col(f"__c{k}") == F.col(f"__d{k}") for k in range(len(reach))]
    on = condition
    for s in same:
        on = on & s
    return a.join(b, on).drop(*(f"__{s}{k}" for k in range(len(reach)) for s in "cd"))


def nearest_within(a: DataFrame, b: DataFrame, on: list[tuple[str, str]], distance: Column, key: list[str], reach: float) -> DataFrame:
    """(key, distance) of the nearest row of b for each distinct key of a that has one within reach.

    on names pairs of columns; a fifth of the reach is searched first, and what finds nothing there looks further."""
    def within(left: DataFrame, far: float) -> DataFrame:
        hit = box_join(left, b, dict.fromkeys(on, far), distance <= far)
        return hit.groupBy(*key).agg(F.min(distance).alias("distance"))

    close = within(a, reach / 5)
    return close.unionByName(within(a.join(close, key, "left_anti"), reach))


#: Rows that share a bucket of time and a cell, about, where near_moving looks for a first witness.
WITNESSES = 48


def near_moving(points: DataFrame, segments: DataFrame, key: str, flat: float, high: float, width: int) -> DataFrame:
    """The distinct keys of segments (key, t0, t1, x0..z1) that some point (t, x, y, z) comes nearer than `flat` aside and `high`
    above or below, both at once, while the segment is flown from its first end to its second.

    One point is enough: segments first meet the points of one short bucket of time, in the cell where they are halfway, and
    only those that find none there meet all points of their time in the cells around. So where traffic is dense
    a segment meets a few points, and where it is thin there are few to meet."""
    o = points.select(F.col("t").alias("__t"), *(F.col(c).alias(f"__{c}") for c in "xyz")).dropna().withColumns({"__cx": F.floor(F.col("__x") / flat), "__cy": F.floor(F.col("__y") / flat)})
    seg = segments.select(key, "t0", "t1", *(f"{c}{k}" for c in "xyz" for k in (0, 1))).where("t0 < t1").dropna()
    span = width
    while span > 1:
        crowd = o.groupBy(F.floor(F.col("__t") / span).alias("b"), "__cx", "__cy").count()
        seen = crowd.agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0] or 0
        if seen <= WITNESSES:
            break
        span = max(1, int(span // max(2.0, seen / WITNESSES)))

    def at(c: str, t: Column) -> Column:
        return F.col(f"{c}0") + (t - F.col("t0")) / (F.col("t1") - F.col("t0")).cast("double") * (F.col(f"{c}1") - F.col(f"{c}0"))

    now = F.col("__t")
    aside = F.sqrt(F.pow(F.col("__x") - at("x", now), 2) + F.pow(F.col("__y") - at("y", now), 2)) < flat
    meets = now.between(F.col("t0"), F.col("t1")) & aside & (F.abs(F.col("__z") - at("z", now)) < high)

    def met(asked: DataFrame, there: DataFrame) -> DataFrame:
        return asked.join(there.hint("merge"), ["__b", "__cx", "__cy"]).where(meets).select(key).distinct()

    halfway = F.expr("t0 + (t1 - t0) div 2")
    first = seg.withColumns({"__b": F.floor(halfway / span), "__cx": F.floor(at("x", halfway) / flat), "__cy": F.floor(at("y", halfway) / flat)})
    found = met(first, o.withColumn("__b", F.floor(now / span)))
    rest = seg.join(found, key, "left_anti").withColumn("__b", F.explode(buckets(F.col("t0"), F.col("t1"), width)))
    since, until = F.greatest("t0", F.col("__b") * width), F.least("t1", (F.col("__b") + 1) * width)
    for c in "xy":
        ends = [F.floor(at(c, t) / flat) for t in (since, until)]
        rest = rest.withColumn(f"__c{c}", F.explode(F.sequence(F.least(*ends), F.greatest(*ends))))
    around = o.withColumn("__b", F.floor(now / width))
    for c in ("__cx", "__cy"):
        around = around.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    return found.unionByName(met(rest, around))


def best_match(pairs: DataFrame, key: list[str], score: str, order: str, values: list[str]) -> DataFrame:
    """The pair of least score for each key; the smaller order wins ties."""
    return pairs.groupBy(*key).agg(F.min_by(F.struct(score, *values), F.struct(score, order)).alias("__best")).select(*key, "__best.*")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many distinct keys only one side has."""
    left, right = (x.select(key).distinct() for x in (a, b))
    both = left.withColumn("l", F.lit(1)).join(right.withColumn("r", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))


#: Ends of intervals that share a bucket of a key, about, where interval_overlay compares pieces with intervals; parts of a bucket that is split.
ENDS_EACH, PARTS = 256, 64


def overlay_widths(df: DataFrame, key: list[str], start: str, end: str, width: int) -> list[int]:
    """Widths of nested buckets, coarse to fine: `width` or a little more, then parts of it until few ends share a bucket where most ends are."""
    ends = df.select(*key, F.explode(F.array(start, end)).alias("__at"))
    fine = [max(1, width)]
    while fine[-1] > 1:
        crowd = ends.groupBy(*key, F.floor(F.col("__at") / fine[-1]).alias("__b")).count()
        if (crowd.agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0] or 0) <= ENDS_EACH:
            break
        fine.append(max(1, fine[-1] // PARTS))
    return [fine[-1] * PARTS ** (len(fine) - 1 - k) for k in range(len(fine))]


def overlay_split(rows: DataFrame, width: int) -> DataFrame:
    """(__key, __b, __lo, __hi, __won, __done) of intervals cut at buckets of width: one row for each bucket that intervals cover whole,
    of the greatest rank of them, and the ends of intervals that reach into a bucket with a greater rank than that.

    Whole buckets are taken by dyadic runs, a few for each interval, and what is done is passed on."""
    lo, hi, w = "__lo", "__hi", f"{width}L"
    a, b = f"ceil({lo} / {w})", f"floor({hi} / {w})"  # whole buckets: a <= bucket < b
    level = "cast(greatest(0, ceil(log2(greatest(1, __e - __a)))) as int)"
    runs = f"""case when __a < __e then flatten(transform(sequence(0, {level}), j -> filter(array(
        if(-shiftright(-__a, j) < shiftright(__e, j) and -shiftright(-__a, j) & 1 != 0, named_struct('j', j, 'i', -shiftright(-__a, j), 'lo', 0L, 'hi', 0L), null),
        if(-shiftright(-__a, j) < shiftright(__e, j) and shiftright(__e, j) & 1 != 0, named_struct('j', j, 'i', shiftright(__e, j) - 1, 'lo', 0L, 'hi', 0L), null)), n -> n is not null))) else array() end"""
    first, last = f"floor({lo} / {w})", f"floor(({hi} - 1) / {w})"
    tips = f"""filter(array(
        if({lo} % {w} != 0 or {hi} < ({first} + 1) * {w}, named_struct('j', -1, 'i', {first}, 'lo', {lo}, 'hi', least({hi}, ({first} + 1) * {w})), null),
        if({last} > {first} and {hi} % {w} != 0, named_struct('j', -1, 'i', {last}, 'lo', {last} * {w}, 'hi', {hi}), null)), n -> n is not null)"""
    kept = f"array(named_struct('j', -2, 'i', {first}, 'lo', {lo}, 'hi', {hi}))"
    cut = rows.withColumns({"__a": F.expr(a), "__e": F.expr(b)}).withColumn("__n", F.explode(F.expr(f"case when __done then {kept} else concat({runs}, {tips}) end")))
    best = lambda df, *by: df.groupBy("__key", *by).agg(F.max_by("__won", "__won.rank").alias("__won"))
    cut = best(cut.select("__key", "__n.*", "__won"), "j", "i", "lo", "hi")
    each = f"case when j < 0 then array(i) else sequence(shiftleft(i, j), shiftleft(i + 1, j) - 1) end"
    cells = cut.withColumn("__b", F.explode(F.expr(each))).select("__key", "__b", F.least("j", F.lit(0)).alias("__kind"), F.expr(f"if(j < 0, lo, __b * {w})").alias(lo), F.expr(f"if(j < 0, hi, (__b + 1) * {w})").alias(hi), "__won")
    cells = best(cells.repartition("__key", "__b"), "__b", "__kind", lo, hi)
    bucket = Window.partitionBy("__key", "__b")
    whole = F.col("__kind") != -1
    cells = cells.withColumn("__top", F.max(F.when(whole, F.col("__won.rank"))).over(bucket)).where(whole | F.col("__top").isNull() | (F.col("__won.rank") > F.col("__top")))
    return cells.withColumn("__done", F.max(~whole).over(bucket) == F.lit(False)).select("__key", "__b", lo, hi, "__won", "__done")


def interval_overlay(df: DataFrame, key: list[str], start: str, end: str, rank: list[str | Column], values: list[str], width: int) -> DataFrame:
    """(key, start, end, values): for every stretch of time that some interval [start, end) of a key covers, the values of the one
    of greatest rank; neighbouring stretches of equal values are one. Ranks must tell intervals of a key apart.

    Intervals are cut at buckets of `width`, and crowded ones at parts of them. What covers a bucket whole is one row
    of it and rules out all ends of lower rank; the rest of a bucket is compared with the pieces between its ends. So
    a key's history is spread over tasks; only what changes meets in one row of pieces at the end."""
    spread = df.where(F.col(end) > F.col(start)).select(F.struct(*key).alias("__key"), F.col(start).cast("long").alias("__lo"), F.col(end).cast("long").alias("__hi"), F.struct(F.struct(*rank).alias("rank"), F.struct(*values).alias("v")).alias("__won"), F.lit(False).alias("__done"))
    for w in overlay_widths(df, key, start, end, width):
        spread = overlay_split(spread, w)
    pieces = spread.select("__key", "__b", F.explode(F.array("__lo", "__hi")).alias("__at")).distinct()
    pieces = pieces.withColumn("__to", F.lead("__at").over(Window.partitionBy("__key", "__b").orderBy("__at"))).where("__to is not null")
    inside = (F.col("__lo") <= F.col("__at")) & (F.col("__hi") >= F.col("__to"))
    won = pieces.join(spread, ["__key", "__b"]).where(inside).groupBy("__key", "__b", "__at", "__to").agg(F.max_by("__won.v", "__won.rank").alias("__v"))
    along = Window.partitionBy("__key").orderBy("__at")
    changed = ~F.coalesce((F.lag("__to").over(along) == F.col("__at")) & F.lag("__v").over(along).eqNullSafe(F.col("__v")), F.lit(False))
    runs = won.withColumn("__run", F.sum(changed.cast("int")).over(along))
    return runs.groupBy("__key", "__run").agg(F.min("__at").alias(start), F.max("__to").alias(end), F.first("__v").alias("__v")).select("__key.*", start, end, "__v.*")
