"""Time windows: their generation on the driver, and the three ways of joining observations with them.

Windows have inclusive ends. Observations are matched half-open by default (`end` itself is outside), as a collection's
date filter does; pass inclusive=True to take the last day in.
"""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = timedelta(days=1)
SCHEMA = "w_start date, w_end date, label string, scene_ids array<string>"


@dataclass(frozen=True)
class Window:
    start: date
    end: date
    label: str
    scene_ids: tuple[str, ...] | None = None


def anchored(start: date, end: date, anchor: str) -> date:
    points = {"start": start, "end": end, "center": start + timedelta(days=(end - start).days // 2)}
    if anchor not in points:
        raise ValueError(f"no anchor {anchor!r}")
    return points[anchor]


def _spans(start: date, end: date, kind: str, size: int | None, step: int | None) -> list[tuple[date, date]]:
    if kind == "full_range":
        return [(start, end)]
    if kind == "calendar_year":
        return [(max(start, date(y, 1, 1)), min(end, date(y, 12, 31))) for y in range(start.year, end.year + 1)]
    if kind == "calendar_month":
        months = range(start.year * 12 + start.month - 1, end.year * 12 + end.month)
        firsts = [date(m // 12, m % 12 + 1, 1) for m in months]
        return [(max(start, d), min(end, d.replace(day=calendar.monthrange(d.year, d.month)[1]))) for d in firsts]
    if kind == "fixed_days":
        step = size if step is None else step
        if not size or size <= 0 or step <= 0:
            raise ValueError("fixed_days takes a size and a step above 0")
        # A window that would reach beyond the end is left out.
        return [(start + k * DAY, start + (k + size - 1) * DAY) for k in range(0, (end - start).days - size + 2, step)]
    raise ValueError(f"no window type {kind!r}")


def generate_windows(start: date, end: date, kind: str, size: int | None = None, step: int | None = None, anchor: str = "start", label_format: str = "%Y-%m-%d") -> list[Window] | None:
    """None for `scene`: such windows come from the scenes themselves. Labels must differ, as outputs are named by them."""
    if end < start:
        raise ValueError(f"the range ends ({end}) before it starts ({start})")
    if kind == "scene":
        return None
    out = [Window(a, b, anchored(a, b, anchor).strftime(label_format)) for a, b in _spans(start, end, kind, size, step)]
    if len({w.label for w in out}) < len(out):
        raise ValueError(f"two windows have one label under {label_format!r}")
    return out


def windows_df(spark: SparkSession, windows: list[Window]) -> DataFrame:
    return spark.createDataFrame([(w.start, w.end, w.label, list(w.scene_ids) if w.scene_ids else None) for w in windows], SCHEMA)


def join_windows(df: DataFrame, windows: DataFrame, at: str = "acquired_at", inclusive: bool = False) -> DataFrame:
    """Any windows, overlapping or not: a range join with the few windows of a job, which the driver has listed before."""
    day = F.col(at).cast("date")
    until = day <= F.col("w_end") if inclusive else day < F.col("w_end")
    return df.join(F.broadcast(windows.select("w_start", "w_end", "label")), (day >= F.col("w_start")) & until)


def assign(df: DataFrame, windows: list[Window], kind: str, size: int | None = None, step: int | None = None, at: str = "acquired_at", inclusive: bool = False) -> DataFrame:
    """Rows with the `label` of their window. Calendar and fixed-day windows are found by a computed key, and one window by a filter; only others need a range join."""
    spark, day = df.sparkSession, F.col(at).cast("date")
    inside = lambda a, b: (day >= a) & ((day <= b) if inclusive else (day < b))
    if len(windows) == 1:
        return df.where(inside(F.lit(windows[0].start), F.lit(windows[0].end))).withColumn("label", F.lit(windows[0].label))
    table = windows_df(spark, windows)
    if kind in ("calendar_month", "calendar_year"):
        keyed, table = df.withColumn("_key", calendar_key(F.col(at), kind)), table.withColumn("_key", calendar_key(F.col("w_start"), kind))
    elif kind == "fixed_days":
        start = windows[0].start
        keyed = with_ordinals(df, start, windows[-1].end, size, step, at).withColumn("_key", F.col("w_start")).drop("k", "w_start")
        table = table.withColumn("_key", F.col("w_start"))
    else:
        return join_windows(df, table, at, inclusive)
    # A job's windows are a list that the driver has made.
    met = keyed.join(F.broadcast(table.select("_key", "w_start", "w_end", "label")), "_key")
    return met.where(inside(F.col("w_start"), F.col("w_end"))).drop("_key")


def calendar_key(at: Column, kind: str) -> Column:
    """The month or year a timestamp is in, without a join; calendar windows don't overlap."""
    return F.trunc(at.cast("date"), {"calendar_month": "MM", "calendar_year": "YYYY"}[kind])


def with_ordinals(df: DataFrame, start: date, end: date, size: int, step: int | None = None, at: str = "acquired_at") -> DataFrame:
    """Fixed-day windows without a join: `k` numbers each window that holds a row; ends are inclusive, partial windows left out."""
    step = step or size
    last = (end - start).days + 1 - size
    o = F.datediff(F.col(at).cast("date"), F.lit(start))
    low = F.greatest(F.lit(0), F.ceil((o - size + 1) / F.lit(step))).cast("int")
    high = F.least(F.floor(o / F.lit(step)), F.lit(last // step)).cast("int")
    inside = df.withColumns({"_low": low, "_high": high}).where("_low <= _high") if last >= 0 else df.withColumns({"_low": low, "_high": high}).where(F.lit(False))
    return inside.withColumn("k", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high").withColumn("w_start", F.date_add(F.lit(start), F.col("k") * step))
