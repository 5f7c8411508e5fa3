"""The job facade: validate, plan and run a configuration over a table of pixel observations.

The table has scene_id, acquired_at, x and y (pixel centres), the dataset's bands, its quality band, and props (a map
of scene properties). One plan composites all windows and tiles.
"""

from __future__ import annotations

import importlib
import logging
import shutil
from datetime import timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import indices as ix
from rasterloom.functions import masks
from rasterloom.functions.geometry import bounds, footprint
from rasterloom.operators import bands as band_ops
from rasterloom.operators import blocks, scenes, tiles
from rasterloom.operators import composite as comp
from rasterloom.operators import windows as win
from rasterloom.plans.config import JobConfig
from rasterloom.sources import manifest as man
from rasterloom.sources import files as files_of
from rasterloom.sources import registry, sinks, stored
from rasterloom.sources.vector import Region, auto_tolerance, load_region

log = logging.getLogger("rasterloom")
#: Units after which progress is told.
PROGRESS = 100


def validate(config: JobConfig) -> list[str]:
    """Warnings; errors raise."""
    spec, said = registry.get(config.dataset.name), []
    for e in config.dataset.indices:
        ix.get(e["name"], spec.slug)
    for b in [*(config.dataset.bands.select or []), *(config.dataset.bands.order or [])]:
        if b not in spec.bands and b not in {o for e in config.dataset.indices for o in ix.get(e["name"], spec.slug).outputs}:
            raise ValueError(f"{spec.slug} has no band {b!r}")
    window = config.composite.window
    if spec.slc_off_date and config.date.start > spec.slc_off_date:
        if window.type == "scene":
            raise ValueError(f"single scenes of {spec.slug} have gaps after {spec.slc_off_date}; use a longer window")
        if window.type == "fixed_days" and window.size / 16 < config.dataset.slc_off.min_scenes_warning:
            said.append(f"windows of {window.size} days hold fewer than {config.dataset.slc_off.min_scenes_warning} scenes of {spec.slug}: gaps of about {spec.slc_off_coverage_loss:.0%} may stay")
    if config.output.dtype != "float32":
        scale = spec.scale_factor if config.dataset.bands.scale_factor is None else config.dataset.bands.scale_factor
        if config.dataset.indices or scale not in (None, 1.0):
            said.append(f"{config.output.dtype} cuts fractions off scaled bands and indices")
    return said


def plan_windows(config: JobConfig) -> list[win.Window] | None:
    w = config.composite.window
    return win.generate_windows(config.date.start, config.date.end, w.type, w.size, w.step, w.anchor, w.label_format)


def n_bands(config: JobConfig) -> int:
    spec, select = registry.get(config.dataset.name), config.dataset.bands.select
    return max(1, len(spec.band_names() if select is None else select) + len(config.dataset.indices))


def open_region(spark: SparkSession, config: JobConfig) -> Region:
    """From a file, or a stored region's folder."""
    r = config.roi
    if Path(r.path).suffix or Path(r.path).is_file():
        return load_region(r.path, r.layer, r.feature_mode, r.filter_expr)
    return stored.load(spark, r.path)


def stored_region(config: JobConfig) -> str | None:
    """Where the job keeps its region for others; None without asset.base_path, or if it reads a stored one itself."""
    base, source = config.asset.base_path, Path(config.roi.path)
    return stored.path_for(base, source) if base and source.is_file() else None


class Job:
    def __init__(self, spark: SparkSession, config: JobConfig, pixels: DataFrame):
        self.spark, self.config, self.spec = spark, config, registry.get(config.dataset.name)
        self.warnings = validate(config)
        self.region = open_region(spark, config)
        tolerance = config.roi.simplify_tolerance
        self.outline = self.region.simplified(auto_tolerance(self.spec.native_res) if tolerance == "auto" else tolerance)
        self.pixels = pixels

    def tiles(self) -> DataFrame:
        t = self.config.tiling
        return tiles.generate_tiles(self.spark, self.region.polygons, self.spec.native_res, n_bands(self.config), t.overlap_px, t.skip_coverage_threshold, t.grid_snap_m, t.max_tile_bytes)

    def collection(self) -> DataFrame:
        """Filtered by region (its box, which reaches the scan, then its outline) and properties, masked; dates are the windows' business."""
        minx, miny, maxx, maxy = bounds(self.region.polygons)
        df = self.pixels.where(F.col("x").between(minx, maxx) & F.col("y").between(miny, maxy))
        # Whole tiles aren't clipped to the simplified outline, so the exact one counts, too.
        either = self.outline.polygons + (self.region.polygons if self.region.polygons != self.outline.polygons else [])
        df = df.where(tiles.inside_polygon(either, F.col("x"), F.col("y")))
        df = comp.property_filter(df, self.spec.extra_filters)
        return self.masked(df)

    def masked(self, df: DataFrame) -> DataFrame:
        m = self.config.dataset.cloud_mask
        name = masks.resolve(m.enabled, m.profile, self.spec.cloud_mask)
        if not name:
            return df
        band, valid = masks.profile(name)
        return masks.apply_mask(df, valid(F.col(band), m.mask_shadow, m.mask_snow), [b for b in self.spec.band_names() if b in df.columns])

    def windows(self) -> list[win.Window]:
        """Also of scene mode, where scenes that cover too little are left out, and other dates suggested if none is left."""
        made = plan_windows(self.config)
        if made is not None:
            return made
        c = self.config
        df = comp.property_filter(self.pixels, self.spec.extra_filters).withColumn("time_start_ms", F.unix_millis(F.col("acquired_at").cast("timestamp")))
        found = scenes.enumerate_scenes(df, c.date.start, c.date.end)
        middle = c.date.start + (c.date.end - c.date.start) // 2
        least = c.composite.window.min_valid_coverage
        if not found.limit(1).count():
            raise scenes.NoScenesAvailable(c.date.start, c.date.end, scenes.suggest(df.select(F.col("acquired_at").cast("date").alias("d")), middle))
        if c.dataset.cloud_mask.enabled and self.spec.cloud_mask and least > 0:
            probe = next(b for b in self.spec.band_names() if b in df.columns)
            covered = scenes.coverage(self.masked(df), probe, tiles.inside_polygon(self.outline.polygons, F.col("x"), F.col("y")))
            found = scenes.keep_covered(found, covered, least)
            if not found.limit(1).count():
                every = scenes.enumerate_scenes(df, c.date.start - timedelta(days=scenes.RADII[0]), c.date.end + timedelta(days=scenes.RADII[0]))
                clean = scenes.cleaner_dates(every, covered, middle, least).collect()
                raise scenes.NoScenesAvailable(c.date.start, c.date.end, [(r["d"], r["coverage"]) for r in clean])
        return scenes.to_windows(found)

    def composite(self, windows: list[win.Window]) -> tuple[DataFrame, list[str]]:
        """label, x, y and the output bands of every window."""
        c, scene_mode = self.config, any(w.scene_ids for w in windows)
        df = self.collection()
        df = comp.date_filter(df, min(w.start for w in windows), max(w.end for w in windows))
        if scene_mode:
            table = win.windows_df(self.spark, windows)
            df = df.join(F.broadcast(table.select("label", F.explode("scene_ids").alias("scene_id"))), "scene_id")
        else:
            w = c.composite.window
            df = win.assign(df, windows, w.type, w.size, w.step)
        needed = [b for b in self.spec.band_names() if b in df.columns]
        strategy = comp.effective_strategy(c.composite.strategy, self.spec.composite_strategy_override, scene_mode)
        one = comp.composite(df, ["label", "x", "y"], needed, strategy)
        b = c.dataset.bands
        return band_ops.project(one, self.spec, b.select, b.order, b.rename, c.dataset.indices, b.scale_factor, b.offset, keys=["label", "x", "y"])

    def staged(self, root: Path, windows: list[win.Window]) -> tuple[DataFrame, list[str]]:
        """The composite, computed once: blocks, composites and a resumed run read what was written."""
        values, names = self.composite(windows)
        path = root / "staged"
        if not (path / "_SUCCESS").exists():
            values.write.mode("overwrite").partitionBy("label").parquet(str(path))
        return self.spark.read.schema(values.schema).parquet(str(path)), names

    def blocks(self, windows: list[win.Window], staged: tuple[DataFrame, list[str]] | None = None) -> tuple[DataFrame, list[str]]:
        """One row per tile and window with an array per band, clipped to the region where a tile is only partly in it."""
        values, names = staged or self.composite(windows)
        res = self.spec.native_res
        grid = self.tiles().drop("rminx", "rminy", "rmaxx", "rmaxy", "coverage", "hilbert")
        first = grid.agg(F.min(F.col("minx") - F.col("col") * (F.col("maxx") - F.col("minx"))), F.min(F.col("miny") - F.col("row") * (F.col("maxy") - F.col("miny"))), F.first(F.col("maxx") - F.col("minx"))).first()
        x0, y0, side = first
        px = tiles.pixel_size(side, res)
        cells = tiles.assign_pixels(values, x0, y0, side).join(F.broadcast(grid), (F.col("tile_col") == F.col("col")) & (F.col("tile_row") == F.col("row"))).drop("col", "row")
        cells = tiles.clip(cells, names, tiles.inside_polygon(self.outline.polygons, F.col("x"), F.col("y")), F.col("tile_class") == "partial")
        cells = cells.withColumns({"col": F.floor((F.col("x") - F.col("minx")) / res).cast("int"), "row": F.floor((F.col("maxy") - F.col("y")) / res).cast("int")})
        keyed = blocks.to_blocks(cells, ["tile_id", "label", "minx", "miny", "maxx", "maxy"], names, px, px)
        return keyed.withColumns({"a": F.lit(float(res)), "c": F.col("minx"), "e": F.lit(-float(res)), "f": F.col("maxy")}), names

    def run(self, fresh: bool = False, retry_failed: bool = False) -> dict[str, int]:
        """Write a file per unit with its document, then the merged composites and the catalog; returns counts by state."""
        c = self.config
        root = Path(c.output.dir) / c.job_name
        root.mkdir(parents=True, exist_ok=True)
        if fresh:
            for p in root.glob("manifest.db*"):
                p.unlink()
            shutil.rmtree(root / "staged", ignore_errors=True)
        (root / "job.yaml").write_text(c.dump())
        if kept := stored_region(c):
            stored.store(self.spark, self.outline, kept)
        windows = self.windows()
        units = tiles.work_units(self.tiles().select("tile_id"), win.windows_df(self.spark, windows).select("label"))
        manifest = man.Manifest(root / "manifest.db")
        try:
            manifest.begin_job(c.config_hash(), self.region.content_hash())
            manifest.recover()
            if retry_failed:
                manifest.reset("failed")
            manifest.register(r["unit_id"] for r in units.select("unit_id").toLocalIterator())
            todo = man.pending_units(units, manifest.frame(self.spark), with_failed=True)
            left = manifest.pending(with_failed=True)
            for r in man.units_per_window(todo).orderBy("label").collect():  # one row per window of the job's list
                log.info("%s: %d units to do", r["label"], r["n"])
            self._hook(c.hooks.pre_download, c, None, len(left))
            if left:
                self._write(root, windows, manifest, todo, left)
            counts = manifest.counts()
            if not counts.get("failed") and not counts.get("pending") and (left or not manifest.job(c.config_hash())[3]):
                self._finish(root, windows, manifest)
                manifest.complete_job(c.config_hash())
                shutil.rmtree(root / "staged", ignore_errors=True)
                if kept and c.asset.auto_cleanup:
                    stored.delete(self.spark, kept)
            self._hook(c.hooks.post_job, c, counts)
            return counts
        finally:
            manifest.close()

    def _fields(self, windows: list[win.Window]) -> dict[str, dict[str, str]]:
        """What a file name template may say besides tile and window."""
        c = self.config
        strategy = comp.effective_strategy(c.composite.strategy, self.spec.composite_strategy_override, any(w.scene_ids for w in windows))
        return {w.label: {"dataset": self.spec.slug, "strategy": strategy, "date_start": f"{w.start}", "date_end": f"{w.end}"} for w in windows}

    def _write(self, root: Path, windows: list[win.Window], manifest: man.Manifest, todo: DataFrame, left: list[str]) -> None:
        """Files and documents of the units that are left; a unit that fails is marked, and the others go on."""
        c, o = self.config, self.config.output
        made, names = self.blocks(windows, self.staged(root, windows))
        made = made.withColumn("unit_id", F.concat_ws("_", "tile_id", "label")).join(todo.select("unit_id"), "unit_id", "left_semi").drop("unit_id")
        manifest.claim_all(left)
        files = sinks.tiff_writer(
            made, str(root / "tiles"), names, self.region.epsg, o.dtype, o.nodata, o.compression, o.format == "COG", o.structure.filename_template, self._fields(windows), c.pipeline.max_retries, c.pipeline.retry_base_delay, c.pipeline.timeout_per_tile
        )
        boxes = {r["tile_id"]: tuple(r)[1:] for r in self.tiles().select("tile_id", "minx", "miny", "maxx", "maxy").toLocalIterator()}
        of, open_ = {w.label: w for w in windows}, set(left)
        for n, r in enumerate(files.toLocalIterator(), 1):
            unit = f"{r['tile_id']}_{r['label']}"
            open_.discard(unit)
            if r["error"]:
                manifest.failed(unit, r["error"])
                log.warning("%s failed: %s", unit, r["error"])
            elif r["path"] is None:
                manifest.empty(unit)
            else:
                w = of[r["label"]]
                ring = footprint(boxes[r["tile_id"]], self.region.epsg)
                sinks.write_sidecar(r["path"], sinks.stac_item(unit, r["path"], ring, w.start, w.end, self.spec.slug, self.spec.native_res, names, {"valid_pixels": r["n_valid"]}))
                manifest.done(unit, r["path"])
                self._hook(c.hooks.post_tile, unit, r["path"], c)
            if n % PROGRESS == 0:
                log.info("%d of %d units", n, len(left))
        for u in open_:  # no observation at all
            manifest.empty(u)

    def _finish(self, root: Path, windows: list[win.Window], manifest: man.Manifest) -> None:
        """Composites by window, one raster per window (and one per index), and the catalog."""
        c, o = self.config, self.config.output
        values, names = self.staged(root, windows)
        inside = tiles.inside_polygon(self.outline.polygons, F.col("x"), F.col("y"))
        out = comp.unmask(values.where(inside), names, o.nodata)
        sinks.write_composites(out, str(root / "composites"))
        apart = o.structure.separate_indices and bool(c.dataset.indices)
        extra = [n for n in names if n not in self.spec.bands] if apart else []
        if extra:
            sinks.write_by_band(out.select("label", "x", "y", *extra), ["label", "x", "y"], extra, str(root / "indices"))
        done = manifest.frame(self.spark).where("status = 'done'")
        files = done.join(tiles.work_units(self.tiles().select("tile_id"), win.windows_df(self.spark, windows).select("label")).select("unit_id", "label"), "unit_id").select("label", F.col("output_path").alias("path"))
        of = {w.label: w for w in windows}
        for r in sinks.merge_tiles(files, str(root / "merged"), names, extra, self.region.epsg, o.dtype, o.nodata, o.compression, o.format == "COG").collect():  # a few rows per window
            w, members = of[r["label"]], [r["name"]] if r["name"] != "main" else [n for n in names if n not in extra]
            ring = footprint((r["minx"], r["miny"], r["maxx"], r["maxy"]), self.region.epsg)
            sinks.write_sidecar(r["path"], sinks.stac_item(Path(r["path"]).stem, r["path"], ring, w.start, w.end, self.spec.slug, self.spec.native_res, members))
        found = [r.asDict() for d in ("merged", "tiles") if (root / d).exists() for r in files_of.scan_documents(self.spark, str((root / d).absolute())).toLocalIterator()]
        if found:
            sinks.write_catalog(root, found)

    @staticmethod
    def _hook(name: str | None, *args) -> None:
        if name:
            module, _, function = name.partition(":")
            getattr(importlib.import_module(module), function)(*args)
