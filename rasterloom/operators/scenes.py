"""Scene mode: listing scenes, their valid coverage, suggestions of other dates, and windows made of scenes."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.masks import validity
from rasterloom.operators.windows import Window

#: Suggestions: how many, within how many days of the wanted date, then of how many; candidates that get a coverage query.
SUGGESTIONS, RADII, CANDIDATES = 5, (365, 730), 12


class NoScenesAvailable(RuntimeError):
    def __init__(self, start: date, end: date, suggestions: list[tuple[date, float | None]]):
        self.start, self.end, self.suggestions = start, end, suggestions
        span = f"{start}" if start == end else f"{start} to {end}"
        near = "; nearest: " + ", ".join(str(d) for d, _ in suggestions) if suggestions else ""
        super().__init__(f"no scenes for {span}{near}")


def enumerate_scenes(df: DataFrame, start: date, end: date, time_ms: str = "time_start_ms") -> DataFrame:
    """scene_id, d, time_start_ms of the scenes from start to end, both inclusive, in time order. Unreadable times are left out."""
    ms = F.expr(f"try_cast({time_ms} AS bigint)")
    day = F.timestamp_millis(ms).cast("date")
    out = df.select("scene_id", day.alias("d"), ms.alias("time_start_ms")).where("time_start_ms IS NOT NULL").distinct()
    return out.where((F.col("d") >= F.lit(start)) & (F.col("d") < F.lit(end + timedelta(days=1)))).orderBy("time_start_ms", "scene_id")


def coverage(pixels: DataFrame, band: str, inside: Column | None = None, every: int = 1) -> DataFrame:
    """scene_id, coverage: the share of valid pixels of the region; none is 0. every: probe each n-th pixel of a row and column only."""
    df = pixels if inside is None else pixels.where(inside)
    if every > 1:
        df = df.where((F.pmod("col", F.lit(every)) == 0) & (F.pmod("row", F.lit(every)) == 0))
    return df.groupBy("scene_id").agg(F.coalesce(F.avg(validity(F.col(band))), F.lit(0.0)).alias("coverage"))


def keep_covered(scenes: DataFrame, covered: DataFrame, least: float) -> DataFrame:
    return scenes.join(covered, "scene_id", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0))).where(F.col("coverage") >= least)


def nearest_dates(days: DataFrame, target: date, n: int = SUGGESTIONS, radius: int = RADII[0], day: str = "d") -> DataFrame:
    """d, delta: the n dates nearest to the target, the earlier one of equals first."""
    delta = F.abs(F.datediff(F.col(day), F.lit(target))).cast("int")
    per_day = days.select(F.col(day).alias("d"), delta.alias("delta")).where(F.col("delta") <= radius).groupBy("d").agg(F.min("delta").alias("delta"))
    return per_day.orderBy("delta", "d").limit(n)


def suggest(days: DataFrame, target: date, n: int = SUGGESTIONS, day: str = "d") -> list[tuple[date, None]]:
    for radius in RADII:
        if found := nearest_dates(days, target, n, radius, day).collect():
            return [(r["d"], None) for r in found]
    return []


def cleaner_dates(scenes: DataFrame, covered: DataFrame, target: date, least: float, n: int = SUGGESTIONS, candidates: int = CANDIDATES, radius: int = RADII[0]) -> DataFrame:
    """d, delta, coverage of the nearest candidate dates whose best scene covers enough."""
    near = nearest_dates(scenes, target, candidates, radius)
    best = scenes.join(covered, "scene_id").groupBy("d").agg(F.max("coverage").alias("coverage"))
    return best.join(F.broadcast(near), "d").where(F.col("coverage") >= least).select("d", "delta", "coverage").orderBy("delta", "d").limit(n)


def scene_windows(scenes: DataFrame) -> DataFrame:
    """One window per date with the ids of its scenes in time order; it ends on the next day, which is outside."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("time_start_ms", "scene_id"))), lambda s: s["scene_id"])
    return scenes.groupBy("d").agg(ids.alias("scene_ids")).select(F.col("d").alias("w_start"), F.date_add("d", 1).alias("w_end"), F.col("d").cast("string").alias("label"), "scene_ids").orderBy("w_start")


def to_windows(scenes: DataFrame) -> list[Window]:
    return [Window(r["w_start"], r["w_end"], r["label"], tuple(r["scene_ids"])) for r in scene_windows(scenes).collect()]
