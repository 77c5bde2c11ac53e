"""Grouped operators: resampling, track summaries, order statistics, histograms, model metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import running_sums


def resample(points: DataFrame, key: str, time: str, width: int, medians: list[str], flags: list[str], last: list[str]) -> DataFrame:
    """Bins of width time units for each key: medians, any of flags, last values; bins without points are absent."""
    aggs = [F.median(c).alias(c) for c in medians] + [F.bool_or(c).alias(c) for c in flags] + [F.max_by(c, F.struct(time, c)).alias(c) for c in last]
    return points.groupBy(key, (F.floor(F.col(time) / width) * width).cast("long").alias("bin")).agg(*aggs, F.count("*").alias("n_points"))


def track_summary(points: DataFrame, key: str, time: str, least: int = 4) -> DataFrame:
    """First and last state, smallest distance from the origin and mean climb of tracks of `least` points or more."""
    ground = F.col("on_ground") if "on_ground" in points.columns else F.lit(False)
    state = F.struct("x", "y", "z", "speed", F.coalesce(ground, F.lit(False)).alias("ground"))
    return (
        points.groupBy(key)
        .agg(F.count("*").alias("n_points"), F.min(time).alias("t_start"), F.max(time).alias("t_end"), F.min_by(state, time).alias("entry"), F.max_by(state, time).alias("exit"), F.min(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)).alias("min_dist_m"), F.min("z").alias("min_z"))
        .where(F.col("n_points") >= least)
        .select(key, "n_points", "t_start", "t_end", "min_dist_m", "min_z", *(F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in ("entry", "exit") for c in ("x", "y", "z", "speed", "ground")))
    )


def movement(horizon_m: float = 25_000, low_m: float = 50, over_m: float = 1500, step_m: float = 150, takeoff_ms: float = 40, approach: tuple[float, float] = (30, 120)) -> Column:
    """Arrival, departure, overflight or unknown of a track summary; a missing speed counts as 70."""
    near_end = F.sqrt(F.col("exit_x") ** 2 + F.col("exit_y") ** 2) < horizon_m
    near_start = F.sqrt(F.col("entry_x") ** 2 + F.col("entry_y") ** 2) < horizon_m
    climb = F.col("exit_z") - F.col("entry_z")
    down, up = climb < -step_m, climb > step_m
    start_speed, end_speed = (F.coalesce(F.col(c), F.lit(70.0)) for c in ("entry_speed", "exit_speed"))
    return (
        F.when(((F.col("exit_z") < low_m) | F.col("exit_ground")) & near_end & down & (F.col("min_dist_m") < horizon_m), "arrival")
        .when(((F.col("entry_z") < low_m) | F.col("entry_ground")) & near_start & up & (start_speed >= takeoff_ms), "departure")
        .when(F.col("min_z") > over_m, "overflight")
        .when(near_end & down & end_speed.between(*approach), "arrival")
        .otherwise("unknown")
    )


def higher_quantile(df: DataFrame, value: str, q: Column) -> DataFrame:
    """(n, quantile): the order statistic at 0-based rank ceil((n - 1) q), without collecting the values.

    Values are counted by distinct value first, so ties cost one row; ranks come from running sums."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    running = running_sums(counts, value, {"upto": "c"})
    rank = F.ceil((F.col("n") - 1) * q) + 1
    return running.crossJoin(F.broadcast(total)).where(F.col("upto") >= rank).groupBy("n").agg(F.min(value).alias("quantile"))


def conformal_level(alpha: float) -> Column:
    """The corrected level min(1, ceil((n + 1)(1 - alpha)) / n) of split conformal prediction."""
    return F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * (1 - alpha)) / F.col("n"))


def voxel_counts(points: DataFrame, by: list[str], low: tuple[float, float, float], step: tuple[float, float, float], shape: tuple[int, int, int]) -> DataFrame:
    """Points in each voxel of a half-open grid; those outside do not count."""
    cells = {i: F.floor((F.col(c) - a) / s).cast("long") for i, c, a, s in zip(("ix", "iy", "iz"), "xyz", low, step, strict=True)}
    inside = [F.col(i).between(0, n - 1) for i, n in zip(cells, shape, strict=True)]
    return points.withColumns(cells).where(inside[0] & inside[1] & inside[2]).groupBy(*by, *cells).agg(F.count("*").alias("n"))


def block_reduce(voxels: DataFrame, shape: tuple[int, int, int], factor: tuple[int, int, int], **aggs: Column) -> DataFrame:
    """Blocks of whole factors of a grid; what is left over at the upper edges goes."""
    names = ("ix", "iy", "iz")
    whole = [F.col(c) < n // f * f for c, n, f in zip(names, shape, factor, strict=True)]
    blocks = [F.floor(F.col(c) / f).cast("long").alias(c) for c, f in zip(names, factor, strict=True)]
    return voxels.where(whole[0] & whole[1] & whole[2]).groupBy(*blocks).agg(*(a.alias(n) for n, a in aggs.items()))


def monotone(values: DataFrame, group: list[str], rank: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """Whether the mean value never grows from rank to rank in each group; missing ones are skipped."""
    means = values.where(F.col(value).isNotNull()).groupBy(*group, rank).agg(F.avg(value).alias("__mean"))
    before = F.lag("__mean").over(Window.partitionBy(*group).orderBy(rank))
    checked = means.withColumn("__ok", F.coalesce(F.col("__mean") <= before + tolerance, F.lit(True)))
    return checked.groupBy(*group).agg(F.bool_and("__ok").alias("monotone"), F.count("*").alias("n_ranks"))


def ranking_metrics(scored: DataFrame, label: str, score: str) -> DataFrame:
    """auroc by mid-ranks, average precision and log-loss; null if only one class occurs.

    Rows are first counted by score; the running sums then cover distinct scores."""
    counts = scored.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("all"))
    counts = counts.withColumn("neg", F.col("all") - F.col("pos"))
    ends = counts.agg(F.sum("pos").alias("all_pos"), F.sum("all").alias("all_all"))
    run = running_sums(counts, score, {"negs": "neg", "poss": "pos", "alls": "all"}).crossJoin(F.broadcast(ends))
    run = run.withColumns({"below": F.col("negs") - F.col("neg"), "found": F.col("all_pos") - F.col("poss") + F.col("pos"), "shown": F.col("all_all") - F.col("alls") + F.col("all")})
    p = F.least(F.greatest(F.col(score), F.lit(1e-6)), F.lit(1 - 1e-6))
    run = run.withColumns({"__auc": F.col("pos") * (F.col("below") + F.col("neg") / 2), "__ap": F.col("pos") * F.col("found") / F.col("shown"), "__ll": -(F.col("pos") * F.log(p) + F.col("neg") * F.log(1 - p))})
    sums = run.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum("__auc").alias("a"), F.sum("__ap").alias("ap"), F.sum("__ll").alias("ll"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return sums.select(F.col("p").alias("n_positive"), F.col("n").alias("n_negative"), F.when(both, F.col("a") / (F.col("p") * F.col("n"))).alias("auroc"), F.when(both, F.col("ap") / F.col("p")).alias("average_precision"), F.when(both, F.col("ll") / (F.col("p") + F.col("n"))).alias("log_loss"))
