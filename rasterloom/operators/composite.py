"""From a collection of observations to one value per window, pixel and band."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import geometry as geo

STRATEGIES = ("median", "mean", "mosaic", "none")


def date_filter(df: DataFrame, start: date, end: date, at: str = "acquired_at") -> DataFrame:
    """start <= at < end, on the raw column, so that it reaches the scan."""
    kind = dict(df.dtypes)[at]
    return df.where((F.col(at) >= F.lit(start).cast(kind)) & (F.col(at) < F.lit(end).cast(kind)))


def bounds_filter(df: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """Footprints (minx to maxy of df) that meet a rectangle."""
    return df.where((F.col("minx") <= maxx) & (F.col("maxx") >= minx) & (F.col("miny") <= maxy) & (F.col("maxy") >= miny))


def region_filter(df: DataFrame, polys: list[geo.Polygon]) -> DataFrame:
    """Footprints (minx to maxy of df) that meet a region: its box on the raw columns, which reaches the scan, then its outline."""

    @F.pandas_udf("boolean")
    def meets(minx: pd.Series, miny: pd.Series, maxx: pd.Series, maxy: pd.Series) -> pd.Series:
        return pd.Series(geo.meets(polys, minx, miny, maxx, maxy))

    return bounds_filter(df, *geo.bounds(polys)).where(meets(*(F.col(c).cast("double") for c in ("minx", "miny", "maxx", "maxy"))))


def single_scene(df: DataFrame, scene_id: str, scene: str = "scene_id") -> DataFrame:
    """One scene by its id, a filter on the raw column."""
    return df.where(F.col(scene) == F.lit(scene_id).cast(dict(df.dtypes)[scene]))


def property_filter(df: DataFrame, filters: Sequence[tuple[str, object]], props: str | None = "props") -> DataFrame:
    for name, value in filters:
        df = df.where((F.col(props)[name] if props else F.col(name)) == F.lit(value))
    return df


def pinned(df: DataFrame, ids: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Only the listed scenes; dates, bounds and properties don't matter then."""
    return df.join(ids.select(F.explode("scene_ids").alias(scene)).distinct() if "scene_ids" in ids.columns else ids.select(scene).distinct(), scene, "left_semi")


def effective_strategy(wanted: str, override: str | None = None, scene_mode: bool = False) -> str:
    out = override or ("mosaic" if scene_mode else wanted)
    if out not in STRATEGIES:
        raise ValueError(f"no composite strategy {out!r}")
    return out


def composite(df: DataFrame, keys: Sequence[str], bands: Sequence[str], strategy: str = "median", order: Sequence[str] = ("acquired_at", "scene_id"), latest: bool = True) -> DataFrame:
    """One row per key. Masked (NULL) values take no part; a band without a valid value is NULL.

    mosaic takes each band's latest (or earliest) valid value by `order`, which must be total for a repeatable result.
    none takes the first scene of each window whole, so it needs keys[0] to be the window.
    """
    if strategy == "none":
        return first_scene(df, keys, bands, order)
    if strategy == "mosaic":
        pick = F.max_by if latest else F.min_by
        rank = F.struct(*order)
        return df.groupBy(*keys).agg(*[pick(F.when(F.col(b).isNotNull(), F.struct(F.col(b).alias("v"))), F.when(F.col(b).isNotNull(), rank))["v"].alias(b) for b in bands])
    if strategy not in STRATEGIES:
        raise ValueError(f"no composite strategy {strategy!r}")
    return df.groupBy(*keys).agg(*[(F.median(b) if strategy == "median" else F.avg(b)).alias(b) for b in bands])


def first_scene(df: DataFrame, keys: Sequence[str], bands: Sequence[str], order: Sequence[str]) -> DataFrame:
    window = keys[0]
    first = df.groupBy(window).agg(F.min(F.struct(*order)).alias("_first")).select(window, *[F.col("_first")[c].alias(c) for c in order])
    # One row per window of a job: a list that the driver made.
    return df.join(F.broadcast(first), [window, *order], "left_semi").select(*keys, *bands)


def unmask(df: DataFrame, bands: Sequence[str], nodata: float) -> DataFrame:
    return df.withColumns({b: F.coalesce(F.nanvl(F.col(b).cast("double"), F.lit(None).cast("double")), F.lit(float(nodata))) for b in bands})


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)
