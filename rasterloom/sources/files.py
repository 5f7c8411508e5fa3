"""Scans of what jobs have written: tile files and their documents, listed and decoded by the tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.sources.tiff import parse_geotiff

TILE = "path string, bands array<string>, width int, height int, epsg int, nodata double, a double, c double, e double, f double, values array<array<double>>"
ITEM = "id string, bbox array<double>, geometry struct<coordinates: array<array<array<double>>>>, properties struct<datetime: string, end_datetime: string, platform: string>"


def _local(path):
    """A file's path as the writers name it."""
    return F.regexp_replace(path, "^file:/+", "/")


def _tiffs(spark: SparkSession, folder: str, recursive: bool) -> DataFrame:
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif")
    return (read.option("recursiveFileLookup", "true") if recursive else read).load(folder)


def tile_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path and length of a folder's GeoTIFFs, by path; those in folders below it only if asked for. Contents aren't read."""
    return _tiffs(spark, folder, recursive).select(_local("path").alias("path"), "length").orderBy("path")


def scan_tiles(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """One row per GeoTIFF with an array of values (row by row) per band; nodata is NULL."""

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for path, content in zip(p["path"], p["content"]):  # a file a batch: a tile is megabytes
                t = parse_geotiff(bytes(content))
                a, (n, h, w), g = t["array"].astype(float), t["array"].shape, t["affine"]
                values = [[None if v == t["nodata"] else v for v in band] for band in a.reshape(n, h * w).tolist()]
                yield pd.DataFrame([(path, t["band_names"], w, h, t["epsg"], t["nodata"], g[0], g[2], g[4], g[5], values)], columns=[c.split()[0] for c in TILE.split(", ")])

    return _tiffs(spark, folder, recursive).select(_local("path").alias("path"), "content").mapInPandas(decode, TILE)


def tile_pixels(tiles: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("path",)) -> DataFrame:
    """keys, x, y (pixel centres) and the bands of scanned tiles: files as a collection that a job can read."""
    at = {b: F.element_at(F.col("values"), F.array_position("bands", F.lit(b)).cast("int")) for b in bands}
    rows = tiles.select(*keys, "width", "a", "c", "e", "f", F.posexplode(F.arrays_zip(*[v.alias(b) for b, v in at.items()])).alias("i", "v"))
    x, y = F.col("c") + (F.col("i") % F.col("width") + 0.5) * F.col("a"), F.col("f") + (F.floor(F.col("i") / F.col("width")) + 0.5) * F.col("e")
    return rows.select(*keys, x.alias("x"), y.alias("y"), *[F.col("v")[b].alias(b) for b in bands])


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """tile_id, datetime, path, bbox and ring of every raster below a folder that has its document beside it, by path."""
    read = spark.read.schema(ITEM).option("multiLine", True).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    written = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))  # metadata has the path as a URI
    items = read.json(folder).select("*", _local(written).alias("doc"))
    items = items.select(F.col("id").alias("tile_id"), F.col("properties.datetime").alias("datetime"), F.regexp_replace("doc", r"\.json$", ".tif").alias("path"), "bbox", F.col("geometry.coordinates")[0].alias("ring"))
    return items.join(tile_files(spark, folder, recursive=True).select("path"), "path", "left_semi").orderBy("path")

