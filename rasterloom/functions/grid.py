"""Grid arithmetic: tile sizes, labels, the Hilbert curve and UTM zones; the column forms stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of one request, and the share of it that a tile may fill (fixed values).
REQUEST_BYTES, HEADROOM = 20_000_000, 0.8


def tile_side_px(n_bands: int, bytes_per_pixel: int = 4, request_bytes: int = REQUEST_BYTES) -> int:
    if n_bands <= 0:
        raise ValueError("a tile has one band at least")
    return int(math.sqrt(request_bytes / (n_bands * bytes_per_pixel) * HEADROOM))


def tile_side_m(n_bands: int, resolution_m: float, bytes_per_pixel: int = 4, request_bytes: int = REQUEST_BYTES) -> float:
    return tile_side_px(n_bands, bytes_per_pixel, request_bytes) * resolution_m


def column_label(i: int) -> str:
    """0: A, 25: Z, 26: AA, as spreadsheets count."""
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def column_label_col(i: Column, letters: int = 4) -> Column:
    """column_label of a column below 26 + 26**2 + ... (letters terms)."""
    parts, rest = [], i.cast("long")
    for _ in range(letters):
        parts.insert(0, F.when(rest >= 0, F.char((F.pmod(rest, F.lit(26)) + 65).cast("int"))).otherwise(F.lit("")))
        rest = F.floor(rest / 26) - 1
    return F.concat(*parts)


def hilbert(x: int, y: int, order: int) -> int:
    """Distance of a cell along the Hilbert curve of 2**order cells a side."""
    d = 0
    for k in reversed(range(order)):
        s = 1 << k
        rx, ry = (x >> k) & 1, (y >> k) & 1
        d += s * s * ((3 * rx) ^ ry)
        if not ry:
            x, y = (s - 1 - (y & (s - 1)), s - 1 - (x & (s - 1))) if rx else (y & (s - 1), x & (s - 1))
        else:
            x, y = x & (s - 1), y & (s - 1)
    return d


def hilbert_expr(x: str, y: str, order: int) -> str:
    """hilbert() in SQL for any order: one fold over the bits, so the expression doesn't grow with the order."""
    step = """named_struct(
      'x', CASE WHEN ry = 1 THEN a.x & (s - 1) WHEN rx = 1 THEN s - 1 - (a.y & (s - 1)) ELSE a.y & (s - 1) END,
      'y', CASE WHEN ry = 1 THEN a.y & (s - 1) WHEN rx = 1 THEN s - 1 - (a.x & (s - 1)) ELSE a.x & (s - 1) END,
      'd', a.d + s * s * ((3 * rx) ^ ry))"""
    step = step.replace("rx", "(shiftright(a.x, k) & 1)").replace("ry", "(shiftright(a.y, k) & 1)")
    step = step.replace("s * s", "shiftleft(1L, 2 * k)").replace("s - 1", "shiftleft(1L, k) - 1")
    zero = f"named_struct('x', CAST({x} AS bigint), 'y', CAST({y} AS bigint), 'd', 0L)"
    return f"aggregate(reverse(sequence(0, {order - 1})), {zero}, (a, k) -> {step}, a -> a.d)"


def snap_down(x: float, step: float) -> float:
    return math.floor(x / step) * step


def utm_epsg(lon: float, lat: float) -> int:
    if not (-180 <= lon <= 180 and -90 <= lat <= 90):
        raise ValueError(f"no such place: {lon}, {lat}")
    return (32600 if lat >= 0 else 32700) + min(60, max(1, int((lon + 180) // 6) + 1))


def utm_epsg_col(lon: Column, lat: Column) -> Column:
    zone = F.greatest(F.lit(1), F.least(F.lit(60), F.floor((lon + 180) / 6) + 1))
    inside = lon.between(-180, 180) & lat.between(-90, 90)
    return F.when(inside, (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int"))
