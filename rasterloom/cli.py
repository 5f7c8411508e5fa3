"""Command line: run, validate, plan, status, datasets, indices, cleanup."""

from __future__ import annotations

import argparse
import shutil
import sys
from pathlib import Path

from rasterloom.functions import indices as ix
from rasterloom.plans.config import load_config
from rasterloom.sources import registry
from rasterloom.sources.manifest import Manifest


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("rasterloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rasterloom")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "validate", "plan", "status", "cleanup"):
        p = sub.add_parser(name)
        p.add_argument("-c", "--config", required=True)
        if name == "run":
            p.add_argument("--pixels", required=True, help="Parquet table of observations")
            p.add_argument("--fresh", action="store_true")
            p.add_argument("--retry-failed", action="store_true")
    sub.add_parser("datasets")
    sub.add_parser("indices").add_argument("--dataset")
    a = parser.parse_args(argv)
    if a.command == "datasets":
        print(*registry.list_slugs(), sep="\n")
        return 0
    if a.command == "indices":
        print(*ix.list_indices(a.dataset), sep="\n")
        return 0
    config = load_config(a.config)
    root = Path(config.output.dir) / config.job_name
    from rasterloom.plans import job

    if a.command == "validate":
        print(f"ok {config.config_hash()}", *job.validate(config), sep="\n")
    elif a.command == "plan":
        for w in job.plan_windows(config) or []:
            print(w.label, w.start, w.end)
        if Path(config.roi.path).exists():
            from rasterloom.operators.tiles import generate_tiles
            from rasterloom.sources.vector import load_region

            spec, t = registry.get(config.dataset.name), config.tiling
            region = load_region(config.roi.path, config.roi.layer, config.roi.feature_mode, config.roi.filter_expr)
            n = generate_tiles(_spark(), region.polygons, spec.native_res, job.n_bands(config), t.overlap_px, t.skip_coverage_threshold, t.grid_snap_m, t.max_tile_bytes).count()
            print(f"{n} tiles")
    elif a.command == "status":
        m = Manifest(root / "manifest.db")
        for state, n in m.counts().items():
            print(f"{state} {n}")
        m.close()
    elif a.command == "cleanup":
        shutil.rmtree(root / "tiles", ignore_errors=True)
        if kept := job.stored_region(config):
            from rasterloom.sources import stored

            if stored.delete(_spark(), kept):
                print(f"deleted {kept}")
    else:
        from rasterloom.operators.scenes import NoScenesAvailable

        spark = _spark()
        try:
            counts = job.Job(spark, config, spark.read.parquet(a.pixels)).run(a.fresh, a.retry_failed)
        except NoScenesAvailable as e:
            print(e, file=sys.stderr)
            return 2
        print(*(f"{k} {v}" for k, v in counts.items()), sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
