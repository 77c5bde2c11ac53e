"""Sinks: columnar tables by partition, JSON and GeoJSON lines, manifests beside what was written."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: list[str] | None = None, codec: str = "zstd") -> None:
    """Parquet by partition columns; rows of a partition meet first, so each has few files."""
    out = df.repartition(*by) if by else df
    writer = out.write.mode("overwrite").option("compression", codec)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_json(df: DataFrame, path: str, compressed: bool = True) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if compressed else "none").json(path)


def feature(path: Column, properties: list[str]) -> Column:
    """A GeoJSON feature of a polyline (array of lon, lat, z structs); without points its geometry is null."""
    line = F.struct(F.lit("LineString").alias("type"), F.transform(path, lambda p: F.array(p["lon"], p["lat"], p["z"])).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.when(F.size(path) > 0, line).alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"})


def write_features(df: DataFrame, path: str, points: str, properties: list[str]) -> None:
    """One GeoJSON feature a line."""
    df.select(feature(F.col(points), properties).alias("value")).write.mode("overwrite").text(path)


def manifest(spark: SparkSession, path: str, parameters: dict) -> dict:
    """Digest, size and name of each file below a folder, taken where the files are, with the run's parameters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), "length").orderBy("name")
    return {"parameters": parameters, "files": [json.loads(r["j"]) for r in rows.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()]}


def merge_inventory(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old that new does not replace."""
    kept = old.join(new.select(F.col(key).alias("__key")).distinct(), old[key] == F.col("__key"), "left_anti")
    return new.unionByName(kept, allowMissingColumns=True)


def counted(df: DataFrame, stage: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """df that counts its rows (and what counts name) as it runs; no job of its own."""
    seen = Observation(stage)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in counts.items())), seen


def write_summary(path: str, name: str, stages: list[Observation], **more) -> dict:
    """The counts of finished stages and further facts of a run, as one JSON document on the driver."""
    summary = {"name": name, **more, "stages": {s._name: s.get for s in stages}}
    with open(path, "w") as out:
        json.dump(summary, out, default=str, sort_keys=True)
    return summary


def write_voxels(voxels: DataFrame, grid: dict, path: str) -> None:
    """A field as voxels and its grid, as voxel_table reads them."""
    voxels.write.mode("overwrite").parquet(f"{path}/voxels")
    write_grid(voxels.sparkSession, grid, path)


def write_grid(spark: SparkSession, grid: dict, path: str) -> None:
    fields = ("x_min", "y_min", "z_min", "dx", "dy", "dz", "nx", "ny", "nz")
    kinds = ", ".join(f"{f} {'int' if f[0] == 'n' else 'double'}" for f in fields)
    spark.createDataFrame([tuple(grid[f] for f in fields)], kinds).coalesce(1).write.mode("overwrite").parquet(f"{path}/grid")


def curve(*index: str, bits: int = 16) -> Column:
    """Place of a voxel on a space-filling curve: the bits of its indices in turn, so near voxels have near places."""
    return sum((F.shiftleft(F.shiftright(F.col(i), b).bitwiseAND(F.lit(1)).cast("long"), len(index) * b + k) for b in range(bits) for k, i in enumerate(index)), F.lit(0).cast("long"))


#: Voxels of a file of write_slices, about.
FILE_VOXELS = 500_000


def write_slices(voxels: DataFrame, grid: dict, path: str, slices: str = "slice", index: tuple[str, ...] = ("ix", "iy", "iz"), file_voxels: int = FILE_VOXELS) -> None:
    """A field over time, as voxel_slice and voxel_box read it: a folder for each slice, files of about file_voxels voxels that
    are cut and sorted along a curve, so that a box of voxels meets few files' and row groups' statistics; and its grid.

    Voxels of one slice go to several tasks where a slice is large, and slices to as many tasks as the rows ask for."""
    placed = voxels.withColumn("__c", curve(*index))
    files = max(1, -(-placed.count() // file_voxels))
    along = placed.repartitionByRange(files, slices, "__c").sortWithinPartitions(slices, "__c").drop("__c")
    along.write.mode("overwrite").partitionBy(slices).parquet(f"{path}/voxels")
    write_grid(voxels.sparkSession, grid, path)
