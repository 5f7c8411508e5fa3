"""Tiles: the grid over a region, its classes and order, work units, and the assignment of pixels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import geometry as geo
from rasterloom.functions import grid

MIN_SIDE_PX = 32
KEPT = ("inside", "partial")
#: Edges up to which a region is an expression; longer ones compile slowly or not at all.
EDGES = 300


def generate_tiles(spark: SparkSession, polys: list[geo.Polygon], resolution_m: float, n_bands: int, overlap_px: int = 2, skip_coverage: float = 0.05, snap_m: float = 100, max_tile_bytes: int | None = None, all_classes: bool = False) -> DataFrame:
    """One row per tile that is worth requesting, in Hilbert order. Row 0 is the southernmost.

    Rows are made by range() and classified in parallel; the region, a job's parameter, goes with the function.
    """
    px = max(MIN_SIDE_PX, grid.tile_side_px(n_bands) if max_tile_bytes is None else grid.tile_side_px(n_bands, request_bytes=max_tile_bytes))
    side = float(px * resolution_m)
    minx, miny, maxx, maxy = geo.bounds(polys)
    x0, y0 = float(grid.snap_down(minx, snap_m)), float(grid.snap_down(miny, snap_m))
    cols, rows = int((maxx - x0) // side) + 1, int((maxy - y0) // side) + 1
    order = max(1, (max(cols, rows) - 1).bit_length())
    grow = float(overlap_px * resolution_m)
    cells = spark.range(cols * rows).select((F.col("id") % cols).cast("int").alias("col"), F.floor(F.col("id") / cols).cast("int").alias("row"))
    boxes = cells.withColumns({"minx": F.lit(x0) + F.col("col") * side, "miny": F.lit(y0) + F.col("row") * side}).withColumns({"maxx": F.col("minx") + side, "maxy": F.col("miny") + side})

    def classify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            found = [geo.classify_tile(polys, b, skip_coverage) for b in zip(p.minx, p.miny, p.maxx, p.maxy)]
            yield p.assign(tile_class=[c for c, _ in found], coverage=[s for _, s in found])

    done = boxes.mapInPandas(classify, boxes.schema.simpleString()[7:-1].replace(":", " ") + ", tile_class string, coverage double")
    if not all_classes:
        done = done.where(F.col("tile_class").isin(*KEPT))
    label = F.concat(grid.column_label_col(F.col("col")), F.format_string("%02d", F.col("row")))
    return done.select(
        label.alias("tile_id"), "col", "row", "minx", "miny", "maxx", "maxy", *[(F.col(c) + s * grow).alias(f"r{c}") for c, s in (("minx", -1), ("miny", -1), ("maxx", 1), ("maxy", 1))],
        "tile_class", "coverage", F.expr(grid.hilbert_expr("col", "row", order)).alias("hilbert"),
    ).orderBy("hilbert")


def work_units(tiles: DataFrame, windows: DataFrame) -> DataFrame:
    """unit_id and its parts for every tile and window; windows are a job's short list."""
    return tiles.crossJoin(F.broadcast(windows)).withColumn("unit_id", F.concat_ws("_", "tile_id", "label"))


def assign_pixels(df: DataFrame, x0: float, y0: float, side: float, x: str = "x", y: str = "y") -> DataFrame:
    """The tile column and row of each pixel, by arithmetic."""
    cell = lambda c, o: F.floor((F.col(c) - F.lit(float(o))) / F.lit(float(side))).cast("int")
    return df.withColumns({"tile_col": cell(x, x0), "tile_row": cell(y, y0)})


def inside_polygon(polys: list[geo.Polygon], x: Column, y: Column) -> Column:
    """Pixel centres inside the region: a code-generated expression of its edges, or, of more than EDGES, an Arrow function."""
    if sum(len(ring) for poly in polys for ring in poly) > EDGES:

        @F.pandas_udf("boolean")
        def within(xs: pd.Series, ys: pd.Series) -> pd.Series:
            found = np.zeros(len(xs), bool)
            for poly in polys:
                found |= geo.contains(poly, xs, ys)
            return pd.Series(found)

        return within(x, y)
    inside = F.lit(False)
    for poly in polys:
        odd = F.lit(0)
        for ring in poly:
            for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
                if y1 != y2:
                    hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1)
                    odd = odd + hit.cast("int")
        inside = inside | (F.pmod(odd, F.lit(2)) == 1)
    return inside


def clip(df: DataFrame, bands: list[str], inside: Column, partial: Column | None = None) -> DataFrame:
    """NULL outside the region; where `partial` is given, only its rows are looked at."""
    valid = inside if partial is None else ~partial | inside
    return df.withColumns({b: F.when(valid, F.col(b)) for b in bands})


def affine(minx: float, maxy: float, resolution: float) -> tuple[float, float, float, float, float, float]:
    """North up, origin top left."""
    return (resolution, 0.0, minx, 0.0, -resolution, maxy)


def pixel_size(extent: float, resolution: float) -> int:
    return round(extent / resolution) if math.isfinite(extent) else 0
