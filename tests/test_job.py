"""A job from configuration to files, resumed, in scene mode and from the command line; and the streaming form."""

import json
from datetime import datetime, timedelta

import numpy as np
import pyarrow.parquet as pq
import pytest
import yaml
from pyspark.sql import functions as F

from rasterloom import cli
from rasterloom.operators.scenes import NoScenesAvailable
from rasterloom.plans.config import JobConfig
from rasterloom.plans.job import Job, validate
from rasterloom.sources.manifest import Manifest
from rasterloom.sources.tiff import read_geotiff

called = []


def hook(*args):
    called.append(args)


@pytest.fixture(scope="module")
def world(tmp_path_factory, spark):
    """A 320 m square of 10 m pixels seen by six scenes; the first is cloudy, one pixel always."""
    root = tmp_path_factory.mktemp("job")
    ring = [[500000.0, 0.0], [500320.0, 0.0], [500320.0, 320.0], [500000.0, 320.0], [500000.0, 0.0]]
    (root / "roi.geojson").write_text(json.dumps({"type": "FeatureCollection", "crs": {"properties": {"name": "EPSG:32631"}}, "features": [{"properties": {}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    rows = []
    for s in range(6):
        for i in range(32):
            for j in range(32):
                cloudy = s == 0 or (i, j) == (3, 3)
                rows.append((f"s{s}", datetime(2024, 1, 1) + timedelta(days=5 * s), 500005.0 + 10 * i, 5.0 + 10 * j, 1000.0 + 10 * s, 3000.0 + i, 9 if cloudy else 4, {}))
    df = spark.createDataFrame(rows, "scene_id string, acquired_at timestamp, x double, y double, B4 double, B8 double, SCL int, props map<string,string>")
    return root, df


def config(root, name, **more):
    base = {
        "job_name": name, "roi": {"path": str(root / "roi.geojson")}, "date": {"start": "2024-01-01", "end": "2024-01-31"}, "output": {"dir": str(root)},
        "dataset": {"name": "sentinel-2", "bands": {"select": ["B4", "B8"]}, "indices": [{"name": "NDVI"}]}, "tiling": {"max_tile_bytes": 20_000, "grid_snap_m": 10},
        "hooks": {"post_job": "tests.test_job:hook", "post_tile": "tests.test_job:hook"},
    }
    return base | more


def test_run_and_resume(world, spark):
    root, df = world
    called.clear()
    job = Job(spark, JobConfig(config(root, "a")), df)
    counts = job.run()
    assert counts.get("done") == job.tiles().count() and not set(counts) - {"done", "empty"} and len(called) == counts["done"] + 1
    tif = next((root / "a" / "tiles").rglob("*.tif"))
    got = read_geotiff(tif)
    b4, b8, ndvi = got["array"]
    seen = b4 != -9999
    assert got["band_names"] == ["B4", "B8", "NDVI"] and seen.any()
    # The median of scenes 1 to 5 (the last, of January 26, is inside the half-open range).
    assert np.allclose(b4[seen], 0.103) and np.allclose(ndvi[seen], (b8 - b4)[seen] / (b8 + b4)[seen], atol=1e-6)
    merged = spark.read.parquet(str(root / "a" / "composites"))
    assert merged.count() == 1024 and merged.where("B4 = -9999").count() == 1
    item = json.loads(tif.with_suffix(".json").read_text())
    assert item["properties"]["platform"] == "sentinel-2" and (root / "a" / "catalog.parquet").exists() and (root / "a" / "indices").exists()
    stamp = tif.stat().st_mtime_ns
    assert Job(spark, JobConfig(config(root, "a")), df).run() == counts and tif.stat().st_mtime_ns == stamp
    m = Manifest(root / "a" / "manifest.db")
    m.db.execute("UPDATE unit SET status = 'failed' WHERE output_path = ?", (str(tif),))
    m.close()
    assert Job(spark, JobConfig(config(root, "a")), df).run(retry_failed=True) == counts and tif.stat().st_mtime_ns > stamp


def test_merged_rasters_and_footprints(world, spark):
    root, df = world
    output = {"dir": str(root), "structure": {"filename_template": "{dataset}_{tile_id}_{window_label}_{strategy}_{date_start}_{date_end}"}}
    Job(spark, JobConfig(config(root, "m", output=output)), df).run()
    assert not (root / "m" / "staged").exists()
    main, ndvi = (read_geotiff(root / "m" / "merged" / "2024-01-01" / f"2024-01-01{x}.tif") for x in ("", "_NDVI"))
    assert main["band_names"] == ["B4", "B8"] and ndvi["band_names"] == ["NDVI"] and main["array"].shape[1] >= 32 and main["epsg"] == 32631
    # Row 0 is the northernmost; the pixel of i = 3, j = 3 is cloudy in every scene.
    x0, y0 = round((500000.0 - main["affine"][2]) / 10), round((main["affine"][5] - 320.0) / 10)
    part = main["array"][:, y0 : y0 + 32, x0 : x0 + 32]
    assert (part[0] == -9999).sum() == 1 and part[0, 28, 3] == -9999 and np.allclose(part[1][part[1] != -9999].reshape(-1)[:28], (3000 + np.arange(28)) / 10000, atol=1e-6)
    tif = next((root / "m" / "tiles").rglob("*.tif"))
    assert tif.stem.startswith("sentinel-2_") and tif.stem.endswith("_2024-01-01_median_2024-01-01_2024-01-31")
    for path in (tif.with_suffix(".json"), root / "m" / "merged" / "2024-01-01" / "2024-01-01.json"):
        item = json.loads(path.read_text())
        assert all(2.99 < x < 3.02 for x in item["bbox"][::2]) and all(-0.01 < y < 0.02 for y in item["bbox"][1::2]) and item["geometry"]["coordinates"][0][0] == item["geometry"]["coordinates"][0][-1]
    rows = pq.read_table(root / "m" / "catalog.parquet")
    geo = json.loads(rows.schema.metadata[b"geo"])
    assert geo["columns"]["geometry"]["crs"]["id"]["code"] == "CRS84" and rows.num_rows == len(list((root / "m").rglob("*.tif")))


def test_one_failing_unit_leaves_the_others(world, spark):
    root, df = world
    more = {"pipeline": {"max_retries": 1}, "composite": {"window": {"type": "fixed_days", "size": 10}}}
    job = Job(spark, JobConfig(config(root, "f", **more)), df)
    some = job.tiles().first()["tile_id"]
    blocked = root / "f" / "tiles" / "2024-01-01" / f"tile_{some}_2024-01-01.tif"
    blocked.mkdir(parents=True)  # no file can take a folder's place
    counts = job.run()
    assert counts["failed"] == 1 and counts["done"] >= 1 and not (root / "f" / "merged").exists() and (root / "f" / "staged").exists()
    m = Manifest(root / "f" / "manifest.db")
    assert m.status(f"{some}_2024-01-01") == "failed" and "Error" in m.db.execute("SELECT last_error FROM unit WHERE status = 'failed'").fetchone()[0]
    m.close()
    blocked.rmdir()
    counts = Job(spark, JobConfig(config(root, "f", **more)), df).run(retry_failed=True)
    assert not counts.get("failed") and (root / "f" / "merged").exists() and not (root / "f" / "staged").exists()


def test_scene_mode(world, spark):
    root, df = world
    scene = {"window": {"type": "scene", "min_valid_coverage": 0.5}}
    job = Job(spark, JobConfig(config(root, "b", composite=scene)), df)
    windows = job.windows()
    assert [w.label for w in windows] == ["2024-01-06", "2024-01-11", "2024-01-16", "2024-01-21", "2024-01-26"] and windows[0].scene_ids == ("s1",)
    values, names = job.composite(windows)
    assert names == ["B4", "B8", "NDVI"] and values.groupBy("label").count().count() == 5
    early = Job(spark, JobConfig(config(root, "c", composite=scene, date={"start": "2023-12-01", "end": "2023-12-05"})), df)
    with pytest.raises(NoScenesAvailable, match="nearest: 2024-01-01"):
        early.windows()
    cloudy = Job(spark, JobConfig(config(root, "d", composite=scene, date={"start": "2024-01-01", "end": "2024-01-02"})), df)
    with pytest.raises(NoScenesAvailable) as e:
        cloudy.windows()
    assert e.value.suggestions[0][0].isoformat() == "2024-01-06"


def test_validation(world):
    root, _ = world
    landsat = {"name": "landsat-7"}
    said = validate(JobConfig(config(root, "e", dataset=landsat, composite={"window": {"type": "fixed_days", "size": 16}})))
    assert said and "gaps" in said[0]
    with pytest.raises(ValueError):
        validate(JobConfig(config(root, "e", dataset=landsat, composite={"window": {"type": "scene"}})))
    with pytest.raises(ValueError):
        validate(JobConfig(config(root, "e", dataset={"name": "sentinel-2", "indices": [{"name": "RVI"}]})))


def test_command_line(world, spark, capsys):
    root, df = world
    df.write.mode("overwrite").parquet(str(root / "pixels"))
    (root / "job.yaml").write_text(yaml.safe_dump(config(root, "cli")))
    at = ["-c", str(root / "job.yaml")]
    assert cli.main(["validate", *at]) == 0 and cli.main(["plan", *at]) == 0 and cli.main(["datasets"]) == 0 and cli.main(["indices", "--dataset", "sentinel-1"]) == 0
    said = capsys.readouterr().out
    assert "tiles" in said and "landsat-9" in said and "RVI" in said
    assert cli.main(["run", *at, "--pixels", str(root / "pixels")]) == 0 and cli.main(["status", *at]) == 0 and "done" in capsys.readouterr().out
    assert cli.main(["cleanup", *at]) == 0 and not (root / "cli" / "tiles").exists()


def test_stream_equals_batch(world, spark, tmp_path):
    from rasterloom.streaming.composite import append_windows, windowed_latest, windowed_means

    root, df = world
    df.drop("props").write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.drop("props").schema).parquet(str(tmp_path / "in"))
    append_windows(windowed_means(stream, ["x", "y"], ["B4"], "10 days", late="0 days"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = windowed_means(df, ["x", "y"], ["B4"], "10 days")
    first = want.agg(F.max("w_end")).first()[0]
    assert got.count() > 0 and got.select("w_start", "x", "y", "B4", "n").exceptAll(want.where(F.col("w_end") < first).select("w_start", "x", "y", "B4", "n")).count() == 0
    assert windowed_latest(df, ["x", "y"], ["B4"]).count() == want.count()
