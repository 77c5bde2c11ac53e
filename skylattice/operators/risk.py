"""Segments, labels, features and risk models."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import clip, draw, uniform
from .aggs import conformal_level, higher_quantile, ranking_metrics
from .joins import configured

TRIES = 20
CAUSES = ("adsb_near", "axis_cross", "approach_prism", "departure_prism", "missed_approach", "sdf_buffer")


def angle_limits(climb_ms: float = 30.0, climb_limit: float = 7.0, descent_ms: float = 25.0, descent_limit: float = 5.0) -> tuple[float, float]:
    """Steepest climb and descent in degrees, by vertical limits and the speeds flown in them."""
    return tuple(math.degrees(math.asin(min(1.0, limit / max(speed, 1.0)))) for limit, speed in ((climb_limit, climb_ms), (descent_limit, descent_ms)))


def sample_segments(slices: DataFrame, n: int, half_m: float, low_m: float, high_m: float, least_m: float = 200.0, climb_deg: float = angle_limits()[0], descent_deg: float = angle_limits()[1]) -> DataFrame:
    """n flight segments over slices (slice_no from 0): the first feasible of TRIES draws each, by hashed draws, so no partitioning changes them."""
    spark = slices.sparkSession
    total = slices.count()
    draws = spark.range(n).withColumnRenamed("id", "seg_no").withColumn("try_no", F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1))))
    place = {c: (uniform("seg_no", "try_no", salt=k) * 2 - 1) * half_m if c[0] != "z" else low_m + uniform("seg_no", "try_no", salt=k) * (high_m - low_m) for k, c in enumerate(("x0", "y0", "z0", "x1", "y1", "z1"))}
    draws = draws.withColumns(place)
    flat = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    angle = F.degrees(F.atan2(F.col("z1") - F.col("z0"), flat))
    fit = draws.where((flat >= least_m) & angle.between(-descent_deg, climb_deg))
    chosen = fit.groupBy("seg_no").agg(F.min_by(F.struct(*place), "try_no").alias("s")).select("seg_no", "s.*")
    return chosen.withColumn("slice_no", F.floor(uniform("seg_no", salt=99) * total).cast("long")).join(slices, "slice_no")


def draw_flights(spark: SparkSession, n: int, slices: DataFrame, n_slices: int, ports: DataFrame, n_ports: int, half_m: float, low_m: float, high_m: float, slice_s: float = 900.0, speed_ms: float = 67.0,
                 funnel: tuple[float, float, float] = (80.0, 80.0, 300.0), least_m: float = 200.0, climb_deg: float = angle_limits()[0], descent_deg: float = angle_limits()[1]) -> DataFrame:
    """n flights from vertiports into the airspace, each within a time slice: (seg_id, slice_no, port_no, x0 .. z1, t0, t1) and what slices hold.

    slices (slice_no from 0, t: the middle in microseconds) and ports (port_no from 0, px, py, pz) are drawn evenly. A flight
    begins in the port's funnel (radius below and above, height), evenly over its volume: the height by the inverse of
    its distribution, then the distance from the axis, then the direction. It ends anywhere in the box. The first of
    TRIES draws that is long enough and neither too steep up nor down is taken; a flight without one is an error. It
    begins so that it ends within its slice, or with the slice if it is longer. All draws hash numbers of the flight
    and try, so neither partitions nor engines change them; places are rounded to millimetres."""
    below, above, top = funnel
    u = lambda salt: draw("seg_id", "try_no", salt=salt)
    tries = spark.range(n).withColumnRenamed("id", "seg_id").withColumn("try_no", F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1))))
    tries = tries.withColumn("port_no", F.floor(u(1) * n_ports).cast("long")).join(ports, "port_no")
    rise = u(2) if below == above else (F.cbrt(u(2) * (above**3 - below**3) + below**3) - below) / (above - below)
    tries = tries.withColumn("__h", rise).withColumns({"__r": F.sqrt(u(3)) * (below + (above - below) * F.col("__h")), "__a": 2 * math.pi * u(4)})
    place = {
        "x0": F.col("px") + F.col("__r") * F.cos("__a"), "y0": F.col("py") + F.col("__r") * F.sin("__a"), "z0": F.col("pz") + F.col("__h") * top,
        "x1": (u(5) * 2 - 1) * half_m, "y1": (u(6) * 2 - 1) * half_m, "z1": low_m + u(7) * (high_m - low_m),
    }
    tries = tries.withColumns({c: F.round(v, 3) for c, v in place.items()})
    flat = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    fits = (flat >= least_m) & F.degrees(F.atan2(F.col("z1") - F.col("z0"), flat)).between(-descent_deg, climb_deg)
    chosen = tries.groupBy("seg_id").agg(F.min_by(F.when(fits, F.struct("port_no", *place)), F.when(fits, F.col("try_no"))).alias("s"))
    chosen = chosen.withColumn("s", F.when(F.col("s").isNotNull(), F.col("s")).otherwise(F.raise_error(F.lit(f"a flight has no fitting draw in {TRIES} tries"))))
    flights = chosen.select("seg_id", "s.*").withColumn("slice_no", F.floor(draw("seg_id", salt=8) * n_slices).cast("long")).join(slices, "slice_no")
    length = F.sqrt(sum(F.pow(F.col(f"{c}1") - F.col(f"{c}0"), 2) for c in "xyz"))
    flights = flights.withColumn("__d", length / speed_ms)
    begin = F.when(F.col("__d") < slice_s, draw("seg_id", salt=9) * (slice_s - F.col("__d"))).otherwise(0.0) - slice_s / 2
    flights = flights.withColumn("t0", F.col("t") + F.floor(begin * 1e6).cast("long")).withColumn("t1", F.col("t0") + F.floor(F.col("__d") * 1e6).cast("long"))
    return flights.drop("__d")


def cause(flags: dict[str, Column]) -> Column:
    """Names of the causes that hold, in fixed order, joined by commas."""
    return F.array_join(F.array_compact(F.array(*(F.when(flags[c], c) for c in CAUSES if c in flags))), ",")


def classifier(kind: str, n_features: int, seed: int = 0):
    """A pipeline stage by name: logistic regression, forest, boosted trees or a perceptron."""
    if kind == "lr":
        return LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="weight", maxIter=50)
    if kind == "rf":
        return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=60, maxDepth=8, seed=seed)
    if kind == "gbt":
        return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=30, maxDepth=4, stepSize=0.1, seed=seed)
    if kind == "mlp":
        return MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="label", layers=[n_features, 64, 64, 2], maxIter=60, seed=seed)
    raise ValueError(kind)


def train(df: DataFrame, features: list[str], label: str, kind: str = "gbt", seed: int = 0):
    """A fitted pipeline; classes are weighted to balance."""
    rate = df.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.5
    weighted = df.withColumn("label", F.col(label).cast("double")).withColumn("weight", F.when(F.col("label") == 1, 0.5 / max(rate, 1e-6)).otherwise(0.5 / max(1 - rate, 1e-6)))
    stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), StandardScaler(inputCol="features", outputCol="scaled", withMean=True), classifier(kind, len(features), seed)]
    return Pipeline(stages=stages).fit(weighted)


def score(model, df: DataFrame) -> DataFrame:
    """df with p, the probability of the positive class."""
    ready = df if "label" in df.columns else df.withColumn("label", F.lit(0.0))
    return model.transform(ready.withColumn("weight", F.lit(1.0))).withColumn("p", vector_to_array("probability")[1])


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def logistic(df: DataFrame, weights: dict[str, float], bias: float = 0.0) -> DataFrame:
    """df with p by a logistic model of given weights."""
    logit = sum((F.col(c) * w for c, w in weights.items()), F.lit(bias))
    return df.withColumn("p", 1 / (1 + F.exp(-logit)))


def hourly_slices(spark, first_hour: int, hours: int) -> DataFrame:
    """(hour) of that many hours from the first, counted from 1970."""
    return spark.range(first_hour, first_hour + hours).withColumnRenamed("id", "hour")


def score_grid(model: PipelineModel, slices: DataFrame, voxels: DataFrame) -> DataFrame:
    """p of every voxel in every slice; slices are few, voxels meet them where they are."""
    return score(model, voxels.crossJoin(configured(slices, 10_000)))


def calibrated(train_scored: DataFrame, test_scored: DataFrame, label: str, alpha: float = 0.1) -> DataFrame:
    """Test rows with a conformal interval (low, high) and whether it covers the label."""
    q = higher_quantile(train_scored.select(F.abs(F.col("p") - F.col(label)).alias("s")), "s", conformal_level(alpha)).select("quantile")
    held = test_scored.crossJoin(F.broadcast(q))
    held = held.withColumns({"low": clip(F.col("p") - F.col("quantile")), "high": clip(F.col("p") + F.col("quantile"))})
    return held.withColumn("covered", F.col(label).between(F.col("low"), F.col("high")))


def out_of_fold(df: DataFrame, features: list[str], label: str, fold: str, folds: int, kind: str = "gbt", seed: int = 0) -> DataFrame:
    """df with p by the model of `folds` that saw none of the row's fold; fold is a column of whole groups (days, say), which
    are dealt to folds by hash, so every row is scored once and by a model that knows nothing of its group."""
    placed = df.withColumn("__fold", F.pmod(F.xxhash64(fold), F.lit(folds)))
    parts = []
    for k in range(folds):
        mine, others = placed.where(F.col("__fold") == k), placed.where(F.col("__fold") != k)
        parts.append(score(train(others, features, label, kind, seed), mine).select(*df.columns, "p"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def fit_calibrated(df: DataFrame, features: list[str], label: str, fold: str, folds: int = 5, alpha: float = 0.1, kind: str = "gbt", seed: int = 0) -> tuple[PipelineModel, float]:
    """A model of all rows, and the half-width of its intervals: the conformal quantile of errors of rows out of their fold."""
    errors = out_of_fold(df, features, label, fold, folds, kind, seed).select(F.abs(F.col("p") - F.col(label)).alias("s"))
    return train(df, features, label, kind, seed), float(higher_quantile(errors, "s", conformal_level(alpha)).first()["quantile"])


def with_interval(scored: DataFrame, half: float, label: str | None = None) -> DataFrame:
    """scored with low and high around p, and with a label whether they cover it."""
    found = scored.withColumns({"low": clip(F.col("p") - half), "high": clip(F.col("p") + half)})
    return found if label is None else found.withColumn("covered", F.col(label).between(F.col("low"), F.col("high")))


def save_calibrated(model: PipelineModel, half: float, path: str, spark: SparkSession) -> None:
    save(model, f"{path}/model")
    spark.createDataFrame([(half,)], "half double").coalesce(1).write.mode("overwrite").parquet(f"{path}/interval")


def load_calibrated(path: str, spark: SparkSession) -> tuple[PipelineModel, float]:
    return load(f"{path}/model"), spark.read.parquet(f"{path}/interval").first()["half"]


def evaluate(scored: DataFrame, label: str) -> DataFrame:
    return ranking_metrics(scored, label, "p")
