"""Raster blocks: pixels as rows, blocks as arrays, and what is done to them on the way to a file."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Smallest and largest value of an output type; values outside are an error, or NULL if asked for.
RANGES = {"int16": (-32768, 32767, "smallint"), "uint16": (0, 65535, "int"), "float32": (None, None, "float")}


class TileShapeError(ValueError):
    pass


class EmptyTileError(ValueError):
    pass


def to_blocks(df: DataFrame, keys: Sequence[str], bands: Sequence[str], width: int, height: int) -> DataFrame:
    """One row per key with a row-major array per band; pixels that no row has are NULL, of several rows of a pixel each band's least valid value counts.

    A block is gathered in one task: its size is bounded by the tile budget, and it is filled in time linear in its pixels.
    """
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{k}` {kind[k]}" for k in keys), "width int", "height int", *(f"`{b}` array<{kind[b]}>" for b in bands)])

    def fill(pixels: pa.Table) -> pa.Table:
        at = pixels.column("row").to_numpy().astype(np.int64) * width + pixels.column("col").to_numpy()
        one = pa.table([pa.array(at), *(pixels.column(b) for b in bands)], ["_at", *bands]).group_by("_at").aggregate([(b, "min") for b in bands])
        place = np.full(width * height, -1, dtype=np.int64)
        place[one.column("_at").to_numpy()] = np.arange(one.num_rows)
        taken = pa.array(place, mask=place < 0)
        arrays = [pa.ListArray.from_arrays(pa.array([0, width * height], pa.int32()), one.column(f"{b}_min").combine_chunks().take(taken)) for b in bands]
        first = pixels.select(list(keys)).slice(0, 1)
        return pa.table([*first.columns, pa.array([width], pa.int32()), pa.array([height], pa.int32()), *arrays], [*keys, "width", "height", *bands])

    inside = (F.col("row") >= 0) & (F.col("row") < height) & (F.col("col") >= 0) & (F.col("col") < width)
    return df.where(inside).select(*keys, "row", "col", *bands).groupBy(*keys).applyInArrow(fill, schema)


def from_blocks(df: DataFrame, keys: Sequence[str], band: str, width: int) -> DataFrame:
    """One row per pixel of an array column."""
    return df.select(*keys, F.posexplode(band).alias("i", "value")).select(*keys, (F.col("i") % width).alias("col"), F.floor(F.col("i") / width).cast("int").alias("row"), "value")


def crop(df: DataFrame, overlap: int, width: int, height: int) -> DataFrame:
    """Drop the overlap on all sides and count from the new corner."""
    return df.where(F.col("col").between(overlap, width - overlap - 1) & F.col("row").between(overlap, height - overlap - 1)).withColumns({"col": F.col("col") - overlap, "row": F.col("row") - overlap})


def overview(df: DataFrame, keys: Sequence[str], bands: Sequence[str], factor: int) -> DataFrame:
    """Average of factor x factor pixels; NULL pixels take no part."""
    shrink = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return df.groupBy(*keys, shrink("row"), shrink("col")).agg(*[F.avg(b).alias(b) for b in bands])


def merge_first(df: DataFrame, keys: Sequence[str], bands: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Overlapping tiles as one: of each pixel and band, the first valid value in file order."""
    first = lambda b: F.min_by(F.struct(b), F.when(F.col(b).isNotNull(), F.struct(*order)))[b].alias(b)
    return df.groupBy(*keys).agg(*[first(b) for b in bands])


def validate(df: DataFrame, band: str, size: int, nodata: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """shape_ok, n_valid, min, max, empty and range_warning of each block's array."""
    valid = F.filter(band, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (v != nodata))
    out = df.withColumn("_valid", valid).withColumns({"shape_ok": F.size(band) == size, "n_valid": F.size("_valid"), "lowest": F.array_min("_valid"), "highest": F.array_max("_valid")})
    outside = F.coalesce(F.col("lowest") < F.lit(low), F.lit(False)) | F.coalesce(F.col("highest") > F.lit(high), F.lit(False))
    return out.withColumns({"empty": F.col("n_valid") == 0, "range_warning": outside}).drop("_valid")


def check_array(array: np.ndarray, shape: tuple[int, ...], nodata: float) -> None:
    if array.shape != shape:
        raise TileShapeError(f"a block of {array.shape}, not {shape}")
    if not (np.isfinite(array) & (array != nodata)).any():
        raise EmptyTileError("a block without a valid pixel")


def cast_bands(df: DataFrame, bands: Sequence[str], dtype: str, strict: bool = False) -> DataFrame:
    """The output type, cut towards zero; out of range is NULL, or an error if strict. Unsigned 16 bits are kept in an int."""
    low, high, kind = RANGES[dtype]
    if low is None:
        return df.withColumns({b: F.col(b).cast(kind) for b in bands})
    out = {}
    for b in bands:
        whole = F.expr(f"try_cast(`{b}` AS bigint)")
        fits = whole.between(low, high)
        out[b] = F.when(F.col(b).isNull(), None).when(fits, whole.cast("int")).otherwise(F.raise_error(F.concat(F.lit(f"{b} is out of {dtype}: "), F.col(b).cast("string"))) if strict else None).cast(kind)
    return df.withColumns(out)


def by_band(df: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """band, value rows: what separate files per index are partitioned by."""
    return df.unpivot(list(keys), list(bands), "band", "value")


def stack(fields: np.ndarray, bands: Sequence[str]) -> np.ndarray:
    """(bands, height, width) of a structured array, or of one that has that shape or lacks the first axis."""
    if fields.dtype.names:
        return np.stack([fields[b] for b in bands])
    if fields.ndim == 2:
        return fields[None]
    if fields.ndim != 3:
        raise TileShapeError(f"an array of {fields.ndim} dimensions")
    return fields
