"""Regions of interest from GeoJSON, shapefiles and GeoPackages, parsed from their published layouts."""

from __future__ import annotations

import hashlib
import json
import math
import sqlite3
import struct
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from rasterloom.functions import geometry as geo
from rasterloom.functions.grid import utm_epsg


@dataclass
class Region:
    """Features with attributes; polygons in the coordinates of `epsg`."""

    features: list[tuple[dict, list[geo.Polygon]]]
    epsg: int

    @property
    def polygons(self) -> list[geo.Polygon]:
        return [p for _, parts in self.features for p in parts]

    def content_hash(self) -> str:
        said = json.dumps([[a, parts] for a, parts in self.features], sort_keys=True, default=str)
        return hashlib.sha1(said.encode()).hexdigest()[:10]

    def simplified(self, tolerance: float) -> "Region":
        return Region([(a, [[geo.simplify(r, tolerance) for r in p] for p in parts]) for a, parts in self.features], self.epsg)

    def frame(self, spark: SparkSession) -> DataFrame:
        """fid, props (JSON), and the geometry as GeoJSON text."""
        rows = [(i, json.dumps(a, default=str), json.dumps({"type": "MultiPolygon", "coordinates": [[[*r, r[0]] for r in p] for p in parts]})) for i, (a, parts) in enumerate(self.features)]
        return spark.createDataFrame(rows, "fid int, props string, geometry string")


def _open(ring) -> geo.Ring:
    pts = [(float(p[0]), float(p[1])) for p in ring]
    return pts[:-1] if len(pts) > 1 and pts[0] == pts[-1] else pts


def _geojson_polygons(g: dict | None) -> list[geo.Polygon]:
    if not g:
        return []
    if g["type"] == "Polygon":
        return [[_open(r) for r in g["coordinates"]]]
    if g["type"] == "MultiPolygon":
        return [[_open(r) for r in p] for p in g["coordinates"]]
    if g["type"] == "GeometryCollection":
        return [p for x in g["geometries"] for p in _geojson_polygons(x)]
    raise ValueError(f"a region is made of polygons, not of a {g['type']}")


def read_geojson(path: Path) -> tuple[list, int | None]:
    doc = json.loads(path.read_text())
    named = str(doc.get("crs", {}).get("properties", {}).get("name", "EPSG:4326"))
    epsg = 4326 if "CRS84" in named else int(named.rpartition(":")[2])
    items = doc["features"] if doc["type"] == "FeatureCollection" else [doc if doc["type"] == "Feature" else {"geometry": doc, "properties": {}}]
    return [(f.get("properties") or {}, _geojson_polygons(f.get("geometry"))) for f in items], epsg


def _group_rings(rings: list[geo.Ring]) -> list[geo.Polygon]:
    """Shapefile rings: clockwise ones are outer, the others are holes of the outer ring around them."""
    outer = [[r] for r in rings if geo.area(r) <= 0]
    for hole in (r for r in rings if geo.area(r) > 0):
        home = next((p for p in outer if geo.contains([p[0]], [hole[0][0]], [hole[0][1]], boundary=True)[0]), None)
        (home.append(hole) if home else outer.append([hole]))
    return outer


def read_shapefile(path: Path) -> tuple[list, int | None]:
    raw, shapes, at = path.read_bytes(), [], 100
    while at + 8 <= len(raw):
        words = struct.unpack(">ii", raw[at : at + 8])[1]
        body, at = raw[at + 8 : at + 8 + 2 * words], at + 8 + 2 * words
        kind = struct.unpack("<i", body[:4])[0]
        if kind in (5, 15, 25):
            n_parts, n_points = struct.unpack("<ii", body[36:44])
            starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
            pts = np.frombuffer(body, "<f8", 2 * n_points, 44 + 4 * n_parts).reshape(-1, 2).tolist()
            shapes.append(_group_rings([_open(pts[a:b]) for a, b in zip(starts, starts[1:])]))
        elif kind == 0:
            shapes.append([])
        else:
            raise ValueError(f"{path}: shapes of kind {kind} aren't polygons")
    dbf, prj = path.with_suffix(".dbf"), path.with_suffix(".prj")
    rows = _read_dbf(dbf) if dbf.exists() else [{} for _ in shapes]
    return list(zip(rows, shapes)), _epsg_of_wkt(prj.read_text()) if prj.exists() else None


def _read_dbf(path: Path) -> list[dict]:
    raw = path.read_bytes()
    n, head, size = struct.unpack("<IHH", raw[4:12])
    fields, at = [], 32
    while raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode(), chr(raw[at + 11]), raw[at + 16]))
        at += 32
    out = []
    for i in range(n):
        at, row = head + i * size + 1, {}
        for name, kind, length in fields:
            text = raw[at : at + length].decode("utf-8", "replace").strip()
            row[name] = (float(text) if "." in text else int(text)) if kind in "NF" and text.strip("*") else (text or None)
            at += length
        out.append(row)
    return out


def _epsg_of_wkt(wkt: str) -> int:
    import re

    if m := re.findall(r'AUTHORITY\["EPSG","(\d+)"\]\]\s*$|ID\["EPSG",(\d+)\]\]\s*$', wkt.strip()):
        return int(next(x for x in m[0] if x))
    if m := re.search(r"UTM[_ ]zone[_ ](\d+)([NS])", wkt, re.I):
        return (32600 if m[2].upper() == "N" else 32700) + int(m[1])
    if wkt.lstrip().startswith("GEOGCS") and "84" in wkt:
        return 4326
    raise ValueError("the projection file names no known reference system")


def _wkb(raw: bytes) -> list[geo.Polygon]:
    def take(at: int) -> tuple[list[geo.Polygon], int]:
        order = "<" if raw[at] else ">"
        kind = struct.unpack_from(order + "I", raw, at + 1)[0]
        dims = 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3)
        kind, n = kind % 1000, struct.unpack_from(order + "I", raw, at + 5)[0]
        at += 9
        if kind == 3:
            rings = []
            for _ in range(n):
                m = struct.unpack_from(order + "I", raw, at)[0]
                pts = np.frombuffer(raw, order + "f8", m * dims, at + 4).reshape(m, dims)[:, :2].tolist()
                rings.append(_open(pts))
                at += 4 + 8 * m * dims
            return [rings], at
        if kind not in (6, 7):
            raise ValueError(f"geometries of kind {kind} aren't polygons")
        out = []
        for _ in range(n):
            part, at = take(at)
            out += part
        return out, at

    return take(0)[0]


def read_geopackage(path: Path, layer: str | None) -> tuple[list, int | None]:
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    db.row_factory = sqlite3.Row
    layers = {r["table_name"]: r for r in db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns")}
    name = layer or next(iter(layers), None)
    if name not in layers:
        raise ValueError(f"{path} has no layer {name!r}; there are {', '.join(layers)}")
    column, out = layers[name]["column_name"], []
    for row in db.execute(f'SELECT * FROM "{name}"'):
        blob = row[column]
        envelope = (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7] if blob else 0
        out.append(({k: row[k] for k in row.keys() if k != column}, _wkb(blob[8 + envelope :]) if blob else []))
    db.close()
    return out, layers[name]["srs_id"]


READERS = {".geojson": lambda p, layer: read_geojson(p), ".json": lambda p, layer: read_geojson(p), ".shp": lambda p, layer: read_shapefile(p), ".gpkg": read_geopackage}


def load_region(path: str | Path, layer: str | None = None, mode: str = "union", filter_expr: str | None = None, metric: bool = True) -> Region:
    """Read features, filter them by attributes, and bring degrees to the UTM zone of their middle."""
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(path)
    if path.suffix.lower() not in READERS:
        raise ValueError(f"no reader for {path.suffix}")
    features, epsg = READERS[path.suffix.lower()](path, layer)
    if not features:
        raise ValueError(f"{path} has no features")
    if not epsg or epsg < 0:
        raise ValueError(f"{path} names no reference system")
    if mode == "filter" and filter_expr:
        import pandas as pd

        keep = pd.DataFrame([a for a, _ in features]).query(filter_expr).index
        features = [features[i] for i in keep]
        if not features:
            raise ValueError(f"no feature matches {filter_expr!r}")
    region = Region(features, epsg)
    if metric and epsg == 4326:
        minx, miny, maxx, maxy = geo.bounds(region.polygons)
        zone = utm_epsg((minx + maxx) / 2, (miny + maxy) / 2)
        project = lambda ring: list(zip(*(c.tolist() for c in geo.to_utm([p[0] for p in ring], [p[1] for p in ring], zone))))
        region = Region([(a, [[project(r) for r in p] for p in parts]) for a, parts in features], zone)
    if mode == "union":
        region = Region([({}, region.polygons)], region.epsg)
    return region


def auto_tolerance(resolution: float) -> float:
    return resolution / 10 if math.isfinite(resolution) else 0.0
