"""Stored regions: a region's features as a Parquet folder that jobs share, named by what its source file holds."""

from __future__ import annotations

import hashlib
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.sources.vector import Region, _geojson_polygons

log = logging.getLogger("rasterloom")


def path_for(base: str, source: str | Path) -> str:
    """The folder for a source file under `base`; another content makes another folder."""
    return f"{base.rstrip('/')}/roi_{hashlib.sha1(Path(source).read_bytes()).hexdigest()[:10]}"


def _place(spark: SparkSession, path: str):
    """The file system of a path (whatever Hadoop reaches) and the path as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Only a folder whose write was completed counts."""
    fs, where = _place(spark, path)
    return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(where, "_SUCCESS"))


def store(spark: SparkSession, region: Region, path: str) -> bool:
    """Write the features unless they are there; False if they were. What an unfinished write left is replaced."""
    if exists(spark, path):
        return False
    region.frame(spark).withColumn("epsg", F.lit(region.epsg)).coalesce(1).write.mode("overwrite").parquet(path)
    return True


def scan(spark: SparkSession, path: str) -> DataFrame:
    """fid, props, geometry and epsg of the features."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no stored region at {path}")
    return spark.read.parquet(path)


def load(spark: SparkSession, path: str) -> Region:
    """The stored region itself, a job's parameter, so it comes to the driver."""
    rows = scan(spark, path).orderBy("fid").collect()
    return Region([(json.loads(r["props"]), _geojson_polygons(json.loads(r["geometry"]))) for r in rows], rows[0]["epsg"])


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a stored region. What goes wrong is told as a warning; a job doesn't fail by it."""
    try:
        fs, where = _place(spark, path)
        if fs.delete(where, True):
            return True
        log.warning("no stored region at %s", path)
    except Exception as e:
        log.warning("%s stays: %s", path, e)
    return False
