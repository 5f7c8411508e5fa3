"""Pure functions: windows, configuration, registry, grid arithmetic, geometry, retries, blocks and files."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.functions import geometry as geo
from rasterloom.functions import grid, indices, masks, retry
from rasterloom.operators import bands, blocks, composite
from rasterloom.operators import windows as win
from rasterloom.operators.windows import generate_windows
from rasterloom.plans.config import ConfigError, JobConfig
from rasterloom.sources import manifest, registry, sinks, tiff, vector

BASE = {"job_name": "demo", "roi": {"path": "roi.geojson"}, "dataset": {"name": "sentinel-2"}, "date": {"start": "2021-02-03", "end": "2021-09-17"}}


def spans(*a, **b):
    return [(w.start, w.end) for w in generate_windows(*a, **b)]


def test_fixed_windows():
    got = spans(date(2021, 2, 3), date(2021, 9, 17), "fixed_days", 50)
    assert got[0] == (date(2021, 2, 3), date(2021, 3, 24)) and got[-1] == (date(2021, 7, 3), date(2021, 8, 21)) and len(got) == 4
    assert [a for a, _ in spans(date(2019, 12, 30), date(2020, 3, 2), "fixed_days", 32)] == [date(2019, 12, 30), date(2020, 1, 31)]
    assert len(spans(date(2019, 10, 28), date(2020, 3, 5), "fixed_days", 21, 8)) == 14
    for size in (1, 13, 29, 64):
        for step in (None, 5, 70):
            got = spans(date(2020, 1, 7), date(2020, 12, 3), "fixed_days", size, step)
            assert all((b - a).days == size - 1 and b <= date(2020, 12, 3) for a, b in got) and {(b - a).days for (a, _), (b, _) in zip(got, got[1:])} <= {step or size}
            assert got[-1][0] + timedelta(days=(step or size) + size - 1) > date(2020, 12, 3)


def test_calendar_windows():
    assert spans(date(2019, 12, 11), date(2020, 3, 2), "calendar_month") == [(date(2019, 12, 11), date(2019, 12, 31)), (date(2020, 1, 1), date(2020, 1, 31)), (date(2020, 2, 1), date(2020, 2, 29)), (date(2020, 3, 1), date(2020, 3, 2))]
    years = spans(date(2018, 11, 9), date(2020, 2, 29), "calendar_year")
    assert years == [(date(2018, 11, 9), date(2018, 12, 31)), (date(2019, 1, 1), date(2019, 12, 31)), (date(2020, 1, 1), date(2020, 2, 29))]


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("kind,size,step", [("calendar_month", None, None), ("calendar_year", None, None), ("fixed_days", 9, None), ("fixed_days", 9, 4), ("fixed_days", 4, 9), ("full_range", None, None)])
def test_keys_assign_windows_as_the_range_join_does(spark, kind, size, step, inclusive):
    start, end = date(2019, 12, 11), date(2020, 3, 2)
    windows = generate_windows(start, end, kind, size, step)
    df = spark.range(0, 24 * 110, 7).selectExpr("id", "TIMESTAMP '2019-12-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id AS int)) AS acquired_at")
    got = win.assign(df, windows, kind, size, step, inclusive=inclusive).select("id", "label").collect()
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, win.join_windows(df, win.windows_df(spark, windows), inclusive=inclusive).select("id", "label").collect()))


@pytest.mark.parametrize("anchor,label", [("start", "2021-03-05"), ("end", "2021-03-26"), ("center", "2021-03-15")])
def test_anchors(anchor, label):
    assert generate_windows(date(2021, 3, 5), date(2021, 3, 26), "full_range", anchor=anchor)[0].label == label


def test_window_errors():
    assert generate_windows(date(2023, 1, 1), date(2023, 1, 2), "scene") is None
    for bad in (("fixed_days", 0), ("weekly", None), ("fixed_days", None)):
        with pytest.raises(ValueError):
            generate_windows(date(2023, 1, 1), date(2023, 2, 1), *bad)
    with pytest.raises(ValueError):
        generate_windows(date(2023, 2, 1), date(2023, 1, 1), "full_range")
    with pytest.raises(ValueError):
        generate_windows(date(2023, 1, 1), date(2023, 3, 1), "calendar_month", label_format="%Y")


def test_config():
    a = JobConfig(BASE)
    assert a.composite.strategy == "median" and a == JobConfig(BASE) and a.config_hash() == JobConfig(BASE).config_hash()
    assert a.config_hash() != JobConfig(BASE | {"job_name": "other"}).config_hash()
    import yaml

    assert JobConfig(yaml.safe_load(a.dump())).config_hash() == a.config_hash()


@pytest.mark.parametrize(
    "patch",
    [
        {"date": {"start": "2023-02-01", "end": "2023-01-01"}}, {"hooks": {"post_tile": "not_a_hook"}}, {"composite": {"window": {"type": "fixed_days"}}}, {"dataset": {"name": "x", "bands": {"select": []}}},
        {"auth": {"method": "magic"}}, {"auth": {"method": "service_account"}}, {"nothing": 1}, {"output": {"format": "JPEG2000"}}, {"composite": {"strategy": "max"}}, {"roi": {}},
        {"composite": {"window": {"min_valid_coverage": 2}}},
    ],
)
def test_config_refuses(patch):
    with pytest.raises(ConfigError):
        JobConfig(BASE | patch)


def test_config_accepts():
    JobConfig(BASE | {"hooks": {"post_tile": "module:f"}, "composite": {"window": {"type": "fixed_days", "size": 40}}})
    JobConfig(BASE | {"dataset": {"name": "sentinel-2", "bands": {"select": []}, "indices": [{"name": "NDVI", "position": 2}, {"name": "EVI", "position": "after_bands"}]}})
    JobConfig(BASE | {"auth": {"method": "service_account", "service_account_email": "a", "key_file": "b"}})


def test_registry():
    assert registry.list_slugs() == ["landsat-7", "landsat-8", "landsat-9", "sentinel-1", "sentinel-1-rtc", "sentinel-2"]
    assert registry.get("landsat-7").slc_off_date == date(2003, 5, 31) and registry.get("sentinel-2").scale_factor == 0.0001
    assert "SCL" not in registry.get("sentinel-2").band_names() and "SCL" in registry.get("sentinel-2").band_names(True)
    with pytest.raises(KeyError):
        registry.get("landsat-5")


def test_masks_and_indices():
    assert masks.bad_classes() == [0, 1, 3, 8, 9, 10] and masks.bad_classes(False, True) == [0, 1, 8, 9, 10, 11]
    assert masks.bad_bits() == 31 and masks.bad_bits(snow=True) == 63 and masks.bad_bits(False) == 15
    assert masks.resolve(True, "auto", "s2_scl_mask") == "s2_scl_mask" and masks.resolve(False, "auto", "x") is None and masks.resolve(True, "auto", None) is None
    assert len(indices.REGISTRY) == 14 and indices.supports("NDVI", "landsat-7") and not indices.supports("EVI", "landsat-7") and indices.list_indices("sentinel-1") == ["RVI", "VV_VH_RATIO"]
    with pytest.raises(ValueError):
        indices.index("NDVI", "nir red")(lambda x: x)
    with pytest.raises(ValueError):
        indices.get("RVI", "sentinel-2")
    assert composite.effective_strategy("median", "mosaic") == "mosaic" == composite.effective_strategy("mean", None, True)
    with pytest.raises(ValueError):
        composite.effective_strategy("max")


def test_index_values(spark):
    df = spark.createDataFrame([(0.5, 0.1, 0.05)], "B8 double, B4 double, B2 double")
    r = indices.apply_indices(df, ["NDVI", "EVI", "SAVI"], "sentinel-2").first()
    assert [round(r[x], 6) for x in ("NDVI", "EVI", "SAVI")] == [0.666667, 0.57971, 0.545455]


def test_band_order():
    one = lambda n, p: {"names": [n], "position": p}
    assert bands.band_order(["B4", "B8"], [one("NDVI", "after_bands")]) == ["B4", "B8", "NDVI"]
    assert bands.band_order(["a"], [one("x", "before_bands"), one("y", "before_bands")]) == ["y", "x", "a"]
    assert bands.band_order(["a", "b"], [one("x", 0), one("y", 0)]) == ["x", "y", "a", "b"]


def test_grid():
    assert [grid.tile_side_px(n) for n in (1, 2, 4, 6, 12, 13, 16)] == [2000, 1414, 1000, 816, 577, 554, 500]
    with pytest.raises(ValueError):
        grid.tile_side_px(0)
    assert [grid.column_label(i) for i in (0, 25, 26, 51, 701, 702)] == ["A", "Z", "AA", "AZ", "ZZ", "AAA"]
    assert [grid.hilbert(*p, 1) for p in ((0, 0), (0, 1), (1, 1), (1, 0))] == [0, 1, 2, 3]
    assert [grid.utm_epsg(*p) for p in ((-0.1, 51.5), (151, -33), (0, 0), (180, 10), (-180, -1))] == [32630, 32756, 32631, 32660, 32701]
    for bad in ((0, 200), (-500, 0)):
        with pytest.raises(ValueError):
            grid.utm_epsg(*bad)


def test_hilbert_is_a_path():
    at = {grid.hilbert(x, y, 4): (x, y) for x in range(16) for y in range(16)}
    assert sorted(at) == list(range(256)) and all(abs(at[i][0] - at[i + 1][0]) + abs(at[i][1] - at[i + 1][1]) == 1 for i in range(255))


@given(st.integers(0, 700))
def test_labels_are_distinct_and_ordered_by_length(i):
    assert grid.column_label(i) != grid.column_label(i + 1) and len(grid.column_label(i)) <= len(grid.column_label(i + 1))


def test_geometry():
    square = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]]
    holed = [*square, [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)]]
    assert geo.contains(square, [5, 0, 11], [5, 5, 5]).tolist() == [True, False, False] and geo.contains(holed, [5, 1], [5, 1]).tolist() == [False, True]
    assert geo.clipped_area(holed, (0, 0, 5, 10)) == pytest.approx(48) and geo.clipped_area([[(0.0, 0.0), (8.0, 0.0), (0.0, 8.0)]], (0, 0, 4, 4)) == pytest.approx(16)
    line = [(0.0, 0.0), (1.0, 0.01), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert geo.simplify(line, 0.1) == [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)] and geo.simplify(line, 0) == line
    east, north = geo.to_utm([3.0, -0.1], [0.0, 51.5], 32631)
    assert east[0] == pytest.approx(500000) and north[0] == pytest.approx(0)
    # 51.5 N on the central meridian: the meridian arc times the scale.
    assert geo.to_utm([3.0], [45.0], 32631)[1][0] == pytest.approx(4982950.4, abs=0.1)


def test_tiles(spark):
    from rasterloom.operators.tiles import generate_tiles

    square = [[[(0.0, 0.0), (80_000.0, 0.0), (80_000.0, 80_000.0), (0.0, 80_000.0)]]]
    rows = generate_tiles(spark, square, 10, 4, snap_m=10).collect()
    assert [r["tile_id"] for r in rows[:10]] == "A00 B00 B01 A01 A02 A03 B03 B02 C02 C03".split()
    assert sum(r["tile_class"] == "inside" for r in rows) == 36 and sum(r["tile_class"] == "partial" for r in rows) == 28
    triangle = [[[(0.0, 0.0), (80_000.0, 0.0), (0.0, 80_000.0)]]]
    rows = generate_tiles(spark, triangle, 10, 4, snap_m=10).collect()
    assert sum(r["tile_class"] == "inside" for r in rows) == 21 - 11 and sum(r["coverage"] == 0.5 for r in rows) == 8
    sliver = [[[(0.0, 0.0), (200_000.0, 0.0), (200_000.0, 100.0), (0.0, 100.0)]]]
    assert generate_tiles(spark, sliver, 10, 4, skip_coverage=0.5, snap_m=10).count() == 0


def test_retry():
    calls = []

    def flaky(n, error):
        def f():
            calls.append(1)
            if len(calls) < n:
                raise error
            return 7

        return f

    assert retry.with_retry(flaky(3, retry.Retryable()), sleep=lambda s: None) == 7 and len(calls) == 3
    calls.clear()
    with pytest.raises(retry.Retryable):
        retry.with_retry(flaky(99, retry.Retryable()), attempts=3, sleep=lambda s: None)
    assert len(calls) == 3
    calls.clear()
    with pytest.raises(KeyError):
        retry.with_retry(flaky(99, KeyError("x")), sleep=lambda s: None)
    assert len(calls) == 1 and retry.is_transient(TimeoutError()) and retry.is_transient(RuntimeError("HTTP 429")) and not retry.is_transient(RuntimeError("400 bad request"))
    assert all(0 <= retry.delay(9, 1.0) <= 60 for _ in range(20))


def test_manifest(tmp_path, spark):
    m = manifest.Manifest(tmp_path / "m.db")
    assert m.begin_job("h") and not m.begin_job("h")
    with pytest.raises(ValueError):
        m.begin_job("other")
    assert m.register(["a", "b"]) == 2 and m.register(["a"]) == 0
    assert m.claim("a") and not m.claim("a") and m.failed("a", "x") and m.claim("a") and m.status("a") == "in_flight"
    left = tmp_path / "a.tif"
    left.write_text("")
    m.db.execute("UPDATE unit SET output_path = ? WHERE unit_id = 'a'", (str(left),))
    assert m.recover() == ["a"] and not left.exists() and m.pending() == ["a", "b"]
    assert m.claim("a") and m.done("a", "p") and m.counts() == {"done": 1, "pending": 1} and m.frame(spark).count() == 2
    m.close()


@pytest.mark.parametrize("compression", ["LZW", "DEFLATE", "ZSTD", "none"])
@pytest.mark.parametrize("dtype", ["float32", "int16", "uint16"])
def test_geotiff_round_trip(tmp_path, compression, dtype):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 200, (3, 70, 300)).astype(float)
    nodata = 9999.0
    a[0, :4, :4] = np.nan
    p = tiff.write_geotiff(tmp_path / "x.tif", a, (10.0, 0.0, 5.0, 0.0, -10.0, 320.0), 32631, ["r", "g", "b"], dtype, nodata, compression)
    got = tiff.read_geotiff(p)
    assert np.array_equal(got["array"], np.where(np.isnan(a), nodata, a)) and got["band_names"] == ["r", "g", "b"] and got["epsg"] == 32631 and got["affine"] == (10.0, 0.0, 5.0, 0.0, -10.0, 320.0)
    assert [o.shape[1:] for o in got["overviews"]] == [(35, 150), (18, 75), (9, 38)] and not list(tmp_path.glob("*.tmp"))


def test_lzw_of_random_bytes():
    rng = random.Random(3)
    for n in (0, 1, 300, 20_000):
        raw = bytes(rng.choice(b"abcd\0\xff") for _ in range(n))
        assert tiff.unlzw(tiff.lzw(raw)) == raw


def test_geotiff_refuses_and_masks(tmp_path):
    with pytest.raises(ValueError):
        tiff.write_geotiff(tmp_path / "x.tif", np.zeros((2, 4, 4)), (1, 0, 0, 0, -1, 4), 4326, ["a"])
    with pytest.raises(ValueError):
        tiff.write_geotiff(tmp_path / "x.tif", np.full((1, 4, 4), 1e6), (1, 0, 0, 0, -1, 4), 4326, ["a"], "int16")
    a, at = tiff.crop(np.ones((1, 32, 32)), (10.0, 0.0, 0.0, 0.0, -10.0, 320.0), 4)
    assert a.shape == (1, 24, 24) and at == (10.0, 0.0, 40.0, 0.0, -10.0, 280.0)
    box = [[[(50.0, 50.0), (150.0, 50.0), (150.0, 150.0), (50.0, 150.0)]]]
    assert (tiff.mask_outside(np.ones((1, 32, 32)), (10.0, 0.0, 0.0, 0.0, -10.0, 320.0), box, -1.0) == 1).sum() == 100


def test_blocks():
    with pytest.raises(blocks.TileShapeError):
        blocks.check_array(np.zeros((2, 4, 4)), (2, 4, 5), -9999)
    for v in (-9999.0, np.nan):
        with pytest.raises(blocks.EmptyTileError):
            blocks.check_array(np.full((2, 4, 4), v), (2, 4, 4), -9999)
    blocks.check_array(np.full((2, 4, 4), 0.5), (2, 4, 4), -9999)
    fields = np.zeros((4, 5), dtype=[("a", "f4"), ("b", "f4")])
    assert blocks.stack(fields, ["b", "a"]).shape == (2, 4, 5) and blocks.stack(np.zeros((4, 5)), ["a"]).shape == (1, 4, 5)


def test_vector_files(tmp_path):
    import json
    import sqlite3
    import struct

    ring = [[500000.0, 0.0], [500000.0, 1000.0], [501000.0, 1000.0], [501000.0, 0.0], [500000.0, 0.0]]
    g = {"type": "FeatureCollection", "crs": {"properties": {"name": "urn:ogc:def:crs:EPSG::32631"}}, "features": [{"properties": {"n": i}, "geometry": {"type": "Polygon", "coordinates": [ring]}} for i in (1, 2)]}
    p = tmp_path / "r.geojson"
    p.write_text(json.dumps(g))
    assert vector.load_region(p).epsg == 32631 and len(vector.load_region(p, mode="split").features) == 2 and len(vector.load_region(p, mode="filter", filter_expr="n > 1").features) == 1
    with pytest.raises(ValueError):
        vector.load_region(p, mode="filter", filter_expr="n > 9")
    with pytest.raises(FileNotFoundError):
        vector.load_region(tmp_path / "none.shp")
    body = struct.pack("<i4d2i1i", 5, 0, 0, 1, 1, 1, 5, 0) + b"".join(struct.pack("<dd", *q) for q in ring)
    raw = bytearray(100) + struct.pack(">ii", 1, len(body) // 2) + body
    (tmp_path / "s.shp").write_bytes(bytes(raw))
    with pytest.raises(ValueError):
        vector.load_region(tmp_path / "s.shp")
    (tmp_path / "s.prj").write_text('PROJCS["WGS_1984_UTM_Zone_31N"]')
    assert vector.load_region(tmp_path / "s.shp").polygons == vector.load_region(p, mode="split").polygons[:1]
    db = sqlite3.connect(tmp_path / "g.gpkg")
    db.executescript("CREATE TABLE gpkg_geometry_columns (table_name, column_name, srs_id); CREATE TABLE t (id, geom); INSERT INTO gpkg_geometry_columns VALUES ('t', 'geom', 32631)")
    wkb = struct.pack("<BIII", 1, 3, 1, 5) + b"".join(struct.pack("<dd", *q) for q in ring)
    db.execute("INSERT INTO t VALUES (1, ?)", (b"GP\0\x01" + struct.pack("<i", 32631) + wkb,))
    db.commit()
    db.close()
    assert vector.load_region(tmp_path / "g.gpkg").polygons == vector.load_region(tmp_path / "s.shp").polygons


def test_catalog(tmp_path):
    import json

    import pyarrow.parquet as pq

    with pytest.raises(ValueError):
        sinks.write_catalog(tmp_path, [])
    p = sinks.write_catalog(tmp_path, [{"tile_id": "A00", "datetime": "2024-01-01T00:00:00Z", "path": "x.tif", "bbox": [0, 0, 1, 1]}])
    assert json.loads(pq.read_schema(p).metadata[b"geo"])["primary_column"] == "geometry"


def test_degrees_and_back():
    rng = np.random.default_rng(1)
    for epsg in (32601, 32631, 32733, 32760):
        lon, lat = (epsg % 100) * 6 - 183 + rng.uniform(-3, 3, 200), rng.uniform(-80, 0, 200) if epsg > 32700 else rng.uniform(0, 84, 200)
        back = geo.from_utm(*geo.to_utm(lon, lat, epsg), epsg)
        assert np.abs(back[0] - lon).max() < 1e-8 and np.abs(back[1] - lat).max() < 1e-8
    ring = geo.footprint((499000.0, 0.0, 501000.0, 1000.0), 32631)
    assert ring[0] == ring[-1] and len(ring) == 5 and all(2.98 < x < 3.02 and -0.001 < y < 0.02 for x, y in ring) and geo.footprint((1, 2, 3, 4), 4326)[1] == (3, 2)


def test_overlapping_polygons_count_once():
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    a, b = [square(0, 0, 4)], [square(2, 2, 4)]
    assert geo.union_area([a, b], (0, 0, 10, 10)) == pytest.approx(28) and geo.union_area([a, a, b], (0, 0, 10, 10)) == pytest.approx(28)
    assert geo.union_area([a, b], (0, 0, 3, 3)) == pytest.approx(9) and geo.union_area([a, [square(6, 6, 1)]], (0, 0, 10, 10)) == pytest.approx(17)
    hole = [square(0, 0, 4), square(1, 1, 2)]
    assert geo.union_area([hole, [square(1.5, 1.5, 1)]], (0, 0, 10, 10)) == pytest.approx(13)
    rng = np.random.default_rng(2)
    polys = [[[tuple(p) for p in rng.uniform(0, 10, (3, 2))]] for _ in range(5)]
    x, y = (v.ravel() for v in np.meshgrid((np.arange(400) + 0.5) / 40, (np.arange(400) + 0.5) / 40))
    assert geo.union_area(polys, (0, 0, 10, 10)) == pytest.approx(np.any([geo.contains(p, x, y) for p in polys], axis=0).mean() * 100, rel=0.01)
    assert geo.classify_tile([a, a], (2, 2, 6, 6), 0.05) == ("partial", pytest.approx(0.25))


def test_blocks_of_real_size(spark):
    side = 1000
    df = spark.range(side * side).selectExpr("'t' AS tile", f"CAST(id DIV {side} AS int) AS row", f"CAST(id % {side} AS int) AS col", "CAST(id % 251 AS float) AS a", "CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id AS int) END AS b").where("row != 7")
    twice = df.unionByName(df.where("row = 3").withColumn("a", F.col("a") + 1)).unionByName(df.limit(5).withColumn("row", F.lit(-1)))
    r = blocks.to_blocks(twice, ["tile"], ["a", "b"], side, side).first()
    a, b = np.array(r["a"], dtype=float).reshape(side, side), r["b"]
    want = (np.arange(side * side) % 251).astype(float).reshape(side, side)
    assert np.isnan(a[7]).all() and (np.delete(a, 7, 0) == np.delete(want, 7, 0)).all() and b[3:6] == [None, 4, 5] and b[7 * side + 1] is None


def test_datasets_of_a_file(tmp_path):
    path = tmp_path / "more.yaml"
    path.write_text("mine:\n  collection: X/Y\n  native_res: 20\n  bands: {R: 20, N: 20}\n  code_bands: {Q: 20}\n  filters: {mode: IW}\n  slc_off_date: 2003-05-31\n")
    try:
        assert registry.register(path) == ["mine"] and "mine" in registry.list_slugs()
        d = registry.get("mine")
        assert d.band_names() == ["R", "N"] and d.bands["Q"].internal and d.extra_filters == (("mode", "IW"),) and d.slc_off_date == date(2003, 5, 31)
        for bad in ("x: {collection: a, native_res: 1}", "x: {collection: a, native_res: 1, bands: {A: 1}, colour: red}"):
            path.write_text(bad)
            with pytest.raises(ValueError, match="dataset x"):
                registry.register(path)
    finally:
        registry._registered.clear()


def test_file_names():
    fields = {"tile_id": "A00", "window_label": "w", "dataset": "d", "strategy": "median", "date_start": "2020-01-01", "date_end": "2020-01-31"}
    assert sinks.file_name("{dataset}_{tile_id}_{window_label}_{strategy}_{date_start}_{date_end}", **fields) == "d_A00_w_median_2020-01-01_2020-01-31"
    with pytest.raises(ValueError, match="no field"):
        sinks.file_name("{tile}", **fields)
