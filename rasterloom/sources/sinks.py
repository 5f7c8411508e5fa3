"""Sinks: partitioned composites, GeoTIFF files, STAC documents and the spatial catalog."""

from __future__ import annotations

import json
import struct
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODECS = {"LZW": "snappy", "DEFLATE": "gzip", "ZSTD": "zstd", "none": "none"}


def write_composites(df: DataFrame, path: str, compression: str = "ZSTD", partition: Sequence[str] = ("label",), locality: str | None = None) -> None:
    """Parquet by window; a rerun replaces just the windows it has. locality: a column (the Hilbert key) that rows are sorted by in files."""
    if locality:
        df = df.repartitionByRange(*partition, locality).sortWithinPartitions(*partition, locality)
    df.write.partitionBy(*partition).option("compression", CODECS[compression]).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_by_band(df: DataFrame, keys: Sequence[str], bands: Sequence[str], path: str) -> None:
    """A folder per window and band: indices in files of their own."""
    df.unpivot(list(keys), list(bands), "band", "value").write.partitionBy("label", "band").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def file_name(template: str, **fields) -> str:
    """A template's fields are tile_id, window_label, dataset, strategy, date_start and date_end; others are an error."""
    try:
        return template.format(**fields)
    except (KeyError, IndexError) as e:
        raise ValueError(f"the file name template has no field {e}; there are {', '.join(sorted(fields))}") from None


def tiff_writer(
    blocks: DataFrame, folder: str, bands: Sequence[str], epsg: int, dtype: str = "float32", nodata: float = -9999.0, compression: str = "LZW", overviews: bool = True,
    template: str = "tile_{tile_id}_{window_label}", fields: dict[str, dict[str, str]] | None = None, retries: int = 1, delay: float = 1.0, timeout: float | None = None,
) -> DataFrame:
    """One GeoTIFF per block row (tile_id, label, width, height, a, c, e, f, bands...), written by the tasks to a shared folder.

    Returns tile_id, label, path, n_valid, error. A block without a valid pixel makes no file and has a null path; what goes wrong
    with one block is tried again if that may help, and then told in its row, and others go on. fields: further template fields by label.
    timeout: seconds that one try at a block's file may take.
    """
    from rasterloom.functions.retry import with_retry, within
    from rasterloom.sources.tiff import write_geotiff

    names, of = list(bands), fields or {}
    for label, more in of.items():
        file_name(template, tile_id="", window_label=label, **more)

    def write(r: dict) -> tuple[str | None, int]:
        a = np.array([np.array([np.nan if v is None else v for v in r[b]], dtype=float).reshape(r["height"], r["width"]) for b in names])
        if not (valid := int(np.isfinite(a).sum())):
            return None, 0
        path = f"{folder}/{r['label']}/{file_name(template, tile_id=r['tile_id'], window_label=r['label'], **of.get(r['label'], {}))}.tif"
        affine = (r["a"], 0.0, r["c"], 0.0, r["e"], r["f"])
        return str(with_retry(lambda: within(timeout, write_geotiff, path, a, affine, epsg, names, dtype, nodata, compression, overviews), max(1, retries), delay)), valid

    def run(batches):
        for p in batches:
            out = []
            for r in p.to_dict("records"):
                try:
                    out.append((*write(r), None))
                except Exception as e:  # told in the unit's row
                    out.append((None, 0, f"{type(e).__name__}: {e}"))
            yield p[["tile_id", "label"]].assign(path=[x for x, _, _ in out], n_valid=[n for _, n, _ in out], error=[e for _, _, e in out])

    return blocks.mapInPandas(run, "tile_id string, label string, path string, n_valid long, error string")


def merge_tiles(files: DataFrame, folder: str, bands: Sequence[str], extra: Sequence[str], epsg: int, dtype: str = "float32", nodata: float = -9999.0, compression: str = "LZW", overviews: bool = True) -> DataFrame:
    """One raster per window from its tile files (label, path), and one for each band in `extra`, which the main one then lacks.

    Of overlapping tiles the first valid value by file name counts. A window's raster is made in one task, band group by band group.
    Returns label, name (main, or the band), path, minx, miny, maxx, maxy.
    """
    from rasterloom.sources.tiff import read_geotiff, write_geotiff

    groups = [("main", main)] if (main := [b for b in bands if b not in extra]) else []
    groups += [(b, [b]) for b in bands if b in extra]

    def run(p):
        label, out = p["label"].iloc[0], []
        paths = sorted(p["path"])
        boxes = []
        for x in paths:
            t = read_geotiff(x)
            a, c, e, f = (t["affine"][i] for i in (0, 2, 4, 5))
            boxes.append((c, f + e * t["array"].shape[1], c + a * t["array"].shape[2], f))
        minx, miny, maxx, maxy = (g(b[i] for b in boxes) for i, g in enumerate((min, min, max, max)))
        for name, members in groups:
            whole = None
            for x, box in zip(paths, boxes):
                t = read_geotiff(x)
                if whole is None:
                    whole = np.full((len(members), round((miny - maxy) / e), round((maxx - minx) / a)), np.nan)
                part = t["array"][[t["band_names"].index(b) for b in members]].astype(float)
                row, col = round((box[3] - maxy) / e), round((box[0] - minx) / a)
                into = whole[:, row : row + part.shape[1], col : col + part.shape[2]]
                np.copyto(into, np.where(part == t["nodata"], np.nan, part), where=np.isnan(into))
            path = f"{folder}/{label}/{label}{'' if name == 'main' else f'_{name}'}.tif"
            write_geotiff(path, whole, (a, 0.0, minx, 0.0, e, maxy), epsg, members, dtype, nodata, compression, overviews)
            out.append((label, name, path, minx, miny, maxx, maxy))
        return pd.DataFrame(out, columns=["label", "name", "path", "minx", "miny", "maxx", "maxy"])

    return files.groupBy("label").applyInPandas(run, "label string, name string, path string, minx double, miny double, maxx double, maxy double")


def stac_item(tile_id: str, href: str, ring: Sequence[Sequence[float]], start, end, platform: str, gsd: float, bands: Sequence[str], extra: dict | None = None, prefix: str = "loom") -> dict:
    """ring: the closed footprint in degrees."""
    box = [f(p[i] for p in ring) for f in (min, max) for i in (0, 1)]
    times = {"start_datetime": f"{start:%Y-%m-%dT%H:%M:%S}Z", "end_datetime": f"{end:%Y-%m-%dT%H:%M:%S}Z"}
    return {
        "type": "Feature", "stac_version": "1.0.0", "id": tile_id, "geometry": {"type": "Polygon", "coordinates": [[list(p) for p in ring]]}, "bbox": box,
        "properties": {"datetime": times["start_datetime"], **times, "platform": platform, "gsd": gsd, **{f"{prefix}:{k}": v for k, v in (extra or {}).items()}},
        "links": [], "assets": {"data": {"href": href, "type": "image/tiff; application=geotiff", "roles": ["data"], "eo:bands": [{"name": b} for b in bands]}},
    }


def write_sidecar(path: str | Path, item: dict) -> Path:
    out = Path(path).with_suffix(".json")
    out.write_text(json.dumps(item, indent=1))
    return out


def stac_json(df: DataFrame, platform: str) -> DataFrame:
    """The core of an item as JSON text, built in the plan: tile_id, minx to maxy, start, end."""
    stamp = lambda c: F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    props = F.struct(stamp("start").alias("datetime"), stamp("end").alias("end_datetime"), F.lit(platform).alias("platform"))
    return df.select("tile_id", F.to_json(F.struct(F.col("tile_id").alias("id"), F.array("minx", "miny", "maxx", "maxy").alias("bbox"), props.alias("properties"))).alias("stac"))


def wkb_polygon(ring: Sequence[Sequence[float]]) -> bytes:
    return struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring)


def write_catalog(root: str | Path, rows: list[dict]) -> Path:
    """GeoParquet of footprints in degrees; one row per raster, so it is small by nature. rows: tile_id, datetime, path, and ring or bbox."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    if not rows:
        raise ValueError("a catalog without rows")
    of_box = lambda b: [(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3]), (b[0], b[1])]
    rings = [r.get("ring") or of_box(r["bbox"]) for r in rows]
    t = pa.table({"tile_id": [r["tile_id"] for r in rows], "datetime": [r["datetime"] for r in rows], "path": [r["path"] for r in rows], "geometry": pa.array([wkb_polygon(r) for r in rings], pa.binary())})
    geo = {"version": "1.0.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": ["Polygon"], "crs": {"id": {"authority": "OGC", "code": "CRS84"}}}}}
    out = Path(root) / "catalog.parquet"
    pq.write_table(t.replace_schema_metadata({b"geo": json.dumps(geo).encode()}), out)
    return out
