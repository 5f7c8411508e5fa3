"""Stored regions, scans of written files, outlines and time limits."""

import json
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.functions import geometry as geo
from rasterloom.functions.retry import is_transient, within
from rasterloom.operators import tiles
from rasterloom.sources import files, sinks, stored
from rasterloom.sources.tiff import write_geotiff
from rasterloom.sources.vector import Region

L_SHAPE = [[[(0.0, 0.0), (9.0, 0.0), (9.0, 4.0), (4.0, 4.0), (4.0, 9.0), (0.0, 9.0)]]]


def test_stored_region(spark, tmp_path, caplog):
    source = tmp_path / "r.geojson"
    source.write_text("one")
    at = stored.path_for(str(tmp_path / "regions"), source)
    region = Region([({"name": "a"}, L_SHAPE), ({"name": None}, [])], 32631)
    assert stored.store(spark, region, at) and not stored.store(spark, region, at)
    back = stored.load(spark, at)
    assert back.features == region.features and back.epsg == 32631
    source.write_text("two")
    assert stored.path_for(str(tmp_path / "regions"), source) != at
    assert stored.delete(spark, at) and not stored.exists(spark, at) and not stored.delete(spark, at) and "no stored region" in caplog.text
    assert not stored.delete(spark, "nosuchscheme://x/y")
    with pytest.raises(FileNotFoundError):
        stored.load(spark, at)


def test_scans(spark, tmp_path):
    root = tmp_path / "a b+c"
    a = np.array([[[1.0, np.nan, 3.0], [4.0, 5.0, 6.0]], [[10.0, 20.0, 30.0], [40.0, 50.0, np.nan]]])
    for name in ("w/t2", "w/t1", "w/NDVI/t3"):
        write_geotiff(root / f"{name}.tif", a, (10.0, 0.0, 500.0, 0.0, -10.0, 90.0), 32631, ["B4", "B8"])
    ring = [(1.0, 2.0), (3.0, 2.0), (3.0, 4.0), (1.0, 4.0), (1.0, 2.0)]
    import datetime

    sinks.write_sidecar(root / "w/t1.tif", sinks.stac_item("t1", "x", ring, datetime.date(2024, 1, 1), datetime.date(2024, 2, 1), "p", 10, ["B4"]))
    sinks.write_sidecar(root / "w/gone.tif", sinks.stac_item("gone", "x", ring, datetime.date(2024, 1, 1), datetime.date(2024, 2, 1), "p", 10, ["B4"]))
    here = str(root / "w")
    assert [r["path"] for r in files.tile_files(spark, here).collect()] == [f"{here}/t1.tif", f"{here}/t2.tif"]
    assert files.tile_files(spark, here, recursive=True).count() == 3
    px = files.tile_pixels(files.scan_tiles(spark, here).where(F.col("path").endswith("t1.tif")), ["B8", "B4"])
    got = {(r["x"], r["y"]): (r["B4"], r["B8"]) for r in px.collect()}
    assert got == {(505.0, 85.0): (1.0, 10.0), (515.0, 85.0): (None, 20.0), (525.0, 85.0): (3.0, 30.0), (505.0, 75.0): (4.0, 40.0), (515.0, 75.0): (5.0, 50.0), (525.0, 75.0): (6.0, None)}
    (doc,) = files.scan_documents(spark, here).collect()
    assert (doc["tile_id"], doc["path"], doc["datetime"], doc["bbox"]) == ("t1", f"{here}/t1.tif", "2024-01-01T00:00:00Z", [1.0, 2.0, 3.0, 4.0]) and [tuple(p) for p in doc["ring"]] == ring
    (tmp_path / "none").mkdir()
    assert files.scan_tiles(spark, str(tmp_path / "none")).count() == 0 and files.scan_documents(spark, str(tmp_path / "none")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(-3, 12), st.integers(-3, 12), st.integers(1, 6), st.integers(1, 6))
def test_boxes_that_meet_a_region(x, y, w, h):
    box = (x + 0.5, y + 0.5, x + 0.5 + w, y + 0.5 + h)
    assert geo.meets(L_SHAPE, *box)[0] == (geo.union_area(L_SHAPE, box) > 0)


def test_touching_and_holes():
    holed = [[[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(2.0, 2.0), (8.0, 2.0), (8.0, 8.0), (2.0, 8.0)]]]
    assert geo.meets(holed, [4, 10, 11, -5, 1], [4, 3, 3, -5, 1], [5, 12, 12, 15, 3], [5, 4, 4, 15, 3]).tolist() == [False, True, False, True, True]


def test_long_outlines(spark):
    angle = np.linspace(0, 2 * np.pi, 2 * tiles.EDGES, endpoint=False)
    ring = [(float(x), float(y)) for x, y in zip(50 + 40 * np.cos(angle), 50 + 40 * np.sin(angle))]
    df = spark.range(10_000).selectExpr("id % 100 + 0.5D AS x", "id DIV 100 + 0.5D AS y")
    got = {tuple(r) for r in df.where(tiles.inside_polygon([[ring]], F.col("x"), F.col("y"))).collect()}
    assert got == {(x + 0.5, y + 0.5) for x in range(100) for y in range(100) if np.hypot(x - 49.5, y - 49.5) < 40}


def test_time_limit():
    assert within(None, int, "3") == within(5, int, "3") == 3
    with pytest.raises(ValueError):
        within(5, int, "x")
    with pytest.raises(TimeoutError) as e:
        within(0.05, time.sleep, 1)
    assert is_transient(e.value)


def test_job_stores_and_reads_its_region(spark, tmp_path):
    from datetime import datetime

    from rasterloom.plans.config import JobConfig
    from rasterloom.plans.job import Job, stored_region

    ring = [[500000.0, 0.0], [500320.0, 0.0], [500000.0, 320.0], [500000.0, 0.0]]
    (tmp_path / "r.geojson").write_text(json.dumps({"type": "FeatureCollection", "crs": {"properties": {"name": "EPSG:32631"}}, "features": [{"properties": {}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    rows = [("s", datetime(2024, 1, 5), 500005.0 + 10 * i, 5.0 + 10 * j, 1000.0, 4, {}) for i in range(32) for j in range(32)]
    # A scene before it that meets the region's box only must not be the first one.
    rows += [("r", datetime(2024, 1, 2), 500315.0, 315.0, 7.0, 4, {})]
    df = spark.createDataFrame(rows, "scene_id string, acquired_at timestamp, x double, y double, B4 double, SCL int, props map<string,string>")
    base = {
        "job_name": "j", "roi": {"path": str(tmp_path / "r.geojson")}, "date": {"start": "2024-01-01", "end": "2024-01-31"}, "output": {"dir": str(tmp_path)}, "asset": {"base_path": str(tmp_path / "regions")},
        "dataset": {"name": "sentinel-2", "bands": {"select": ["B4"]}}, "tiling": {"max_tile_bytes": 20_000, "grid_snap_m": 10}, "composite": {"strategy": "none"},
    }
    c = JobConfig(base)
    assert Job(spark, c, df).run().get("done")
    kept = stored_region(c)
    assert stored.exists(spark, kept)
    out = spark.read.parquet(str(tmp_path / "j" / "composites"))
    assert out.count() == sum(i + j < 31 for i in range(32) for j in range(32)) and out.where("round(B4, 3) <> 0.1").count() == 0
    again = JobConfig(base | {"job_name": "k", "roi": {"path": kept}})
    assert stored_region(again) is None and Job(spark, again, df).region.polygons == Job(spark, c, df).outline.polygons
    gone = JobConfig(base | {"job_name": "l", "asset": {"base_path": str(tmp_path / "regions"), "auto_cleanup": True}})
    assert Job(spark, gone, df).run().get("done") and not stored.exists(spark, kept)
