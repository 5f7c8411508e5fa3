"""Job configuration: a YAML document checked against a declared schema. Unknown keys are refused; nothing changes it later."""

from __future__ import annotations

import hashlib
import json
from datetime import date
from pathlib import Path
from types import SimpleNamespace
from typing import Any

REQUIRED = object()


def one_of(*allowed):
    def check(v):
        if v not in allowed:
            raise ValueError(f"{v!r} isn't one of {', '.join(map(str, allowed))}")
        return v

    return check


def text(v):
    if not isinstance(v, str):
        raise ValueError(f"{v!r} isn't a text")
    return v


def number(v):
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise ValueError(f"{v!r} isn't a number")
    return float(v)


def whole(v):
    if isinstance(v, bool) or not isinstance(v, int):
        raise ValueError(f"{v!r} isn't a whole number")
    return v


def flag(v):
    if not isinstance(v, bool):
        raise ValueError(f"{v!r} is neither true nor false")
    return v


def day(v):
    return v if isinstance(v, date) else date.fromisoformat(text(v))


def texts(v):
    return [text(x) for x in v]


def mapping(v):
    return {text(k): text(x) for k, x in v.items()}


def share(v):
    if not 0 <= number(v) <= 1:
        raise ValueError(f"{v!r} isn't between 0 and 1")
    return float(v)


def hook(v):
    module, _, function = text(v).partition(":")
    if not module.strip() or not function.strip() or ":" in function:
        raise ValueError(f"a hook is module:function, not {v!r}")
    return v


def position(v):
    return v if v in ("after_bands", "before_bands") else whole(v)


def tolerance(v):
    return v if v == "auto" else number(v)


def maybe(check):
    return lambda v: None if v is None else check(v)


#: Section: key: (check, default). A default of REQUIRED must be given.
SECTIONS: dict[str, dict[str, tuple]] = {
    "roi": {"path": (text, REQUIRED), "layer": (maybe(text), None), "feature_mode": (one_of("union", "split", "filter"), "union"), "filter_expr": (maybe(text), None), "simplify_tolerance": (tolerance, "auto")},
    "date": {"start": (day, REQUIRED), "end": (day, REQUIRED)},
    "asset": {"project": (text, ""), "base_path": (text, ""), "auto_cleanup": (flag, False)},
    "auth": {"method": (one_of("browser", "service_account"), "browser"), "service_account_email": (maybe(text), None), "key_file": (maybe(text), None)},
    "tiling": {"max_tile_bytes": (maybe(whole), None), "overlap_px": (whole, 2), "skip_coverage_threshold": (number, 0.05), "grid_snap_m": (whole, 100)},
    "pipeline": {"concurrency": (whole, 16), "max_retries": (whole, 6), "retry_base_delay": (number, 1.0), "timeout_per_tile": (whole, 120)},
    "hooks": {"pre_download": (maybe(hook), None), "post_tile": (maybe(hook), None), "post_job": (maybe(hook), None)},
}
NESTED: dict[str, dict[str, dict[str, tuple]]] = {
    "dataset": {
        "": {"name": (text, REQUIRED)},
        "bands": {"select": (maybe(texts), None), "order": (maybe(texts), None), "rename": (maybe(mapping), None), "scale_factor": (maybe(number), None), "offset": (maybe(number), None)},
        "cloud_mask": {"enabled": (flag, True), "profile": (text, "auto"), "mask_shadow": (flag, True), "mask_snow": (flag, False)},
        "slc_off": {"strategy": (one_of("multi_temporal"), "multi_temporal"), "min_scenes_warning": (whole, 3)},
    },
    "composite": {
        "": {"strategy": (one_of("median", "mean", "mosaic", "none"), "median")},
        "window": {
            "type": (one_of("fixed_days", "calendar_month", "calendar_year", "full_range", "scene"), "full_range"), "size": (maybe(whole), None), "step": (maybe(whole), None),
            "anchor": (one_of("start", "end", "center"), "start"), "min_scenes": (whole, 1), "label_format": (text, "%Y-%m-%d"), "min_valid_coverage": (share, 0.5),
        },
    },
    "output": {
        "": {
            "dir": (text, "./output"), "format": (one_of("COG", "GeoTIFF"), "COG"), "nodata": (number, -9999.0), "dtype": (one_of("float32", "int16", "uint16"), "float32"), "crs": (maybe(text), None),
            "compression": (one_of("LZW", "DEFLATE", "ZSTD", "none"), "LZW"),
        },
        "structure": {"timeseries_mode": (flag, False), "band_interleave": (one_of("BIP", "BIL", "BSQ"), "BIP"), "filename_template": (text, "tile_{tile_id}_{window_label}"), "separate_indices": (flag, True)},
    },
}
INDEX = {"name": (text, REQUIRED), "output_band": (maybe(text), None), "position": (position, "after_bands")}


class ConfigError(ValueError):
    pass


def _section(given: Any, schema: dict[str, tuple], where: str) -> dict:
    given = {} if given is None else given
    if not isinstance(given, dict):
        raise ConfigError(f"{where} isn't a mapping")
    if odd := sorted(set(given) - set(schema)):
        raise ConfigError(f"{where} has no key {', '.join(odd)}")
    out = {}
    for key, (check, default) in schema.items():
        if key not in given:
            if default is REQUIRED:
                raise ConfigError(f"{where}.{key} is missing")
            out[key] = default
            continue
        try:
            out[key] = check(given[key])
        except (ValueError, TypeError, AttributeError) as e:
            raise ConfigError(f"{where}.{key}: {e}") from None
    return out


def _frozen(x: Any) -> Any:
    return SimpleNamespace(**{k: _frozen(v) if isinstance(v, dict) and k != "rename" else v for k, v in x.items()}) if isinstance(x, dict) else x


class JobConfig:
    """Sections as attributes; `resolved` is the whole document with its defaults."""

    def __init__(self, given: dict):
        if not isinstance(given, dict):
            raise ConfigError("a job is a mapping")
        if odd := sorted(set(given) - {"job_name", *SECTIONS, *NESTED}):
            raise ConfigError(f"a job has no section {', '.join(odd)}")
        out: dict[str, Any] = {"job_name": _section({"job_name": given["job_name"]} if "job_name" in given else {}, {"job_name": (text, REQUIRED)}, "job")["job_name"]}
        for name, schema in SECTIONS.items():
            out[name] = _section(given.get(name), schema, name)
        for name, parts in NESTED.items():
            mine = dict(given.get(name) or {})
            inner = {p: _section(mine.pop(p, None), schema, f"{name}.{p}") for p, schema in parts.items() if p}
            indices = mine.pop("indices", None) if name == "dataset" else None
            out[name] = _section(mine, parts[""], name) | inner
            if name == "dataset":
                out[name]["indices"] = [_section(e, INDEX, f"dataset.indices[{i}]") for i, e in enumerate(indices or [])]
        self._check(out)
        self.resolved = out
        for k, v in _frozen(out).__dict__.items():
            setattr(self, k, v)

    @staticmethod
    def _check(c: dict) -> None:
        if c["date"]["end"] < c["date"]["start"]:
            raise ConfigError("date.end is before date.start")
        if c["dataset"]["bands"]["select"] == [] and not c["dataset"]["indices"]:
            raise ConfigError("no bands and no indices: the result would have no band")
        window = c["composite"]["window"]
        if window["type"] == "fixed_days" and (not window["size"] or window["size"] <= 0):
            raise ConfigError("composite.window.size must be above 0 for fixed_days")
        if c["auth"]["method"] == "service_account" and not (c["auth"]["service_account_email"] and c["auth"]["key_file"]):
            raise ConfigError("auth.service_account_email and auth.key_file belong to service_account")

    def dump(self) -> str:
        import yaml

        return yaml.safe_dump(json.loads(json.dumps(self.resolved, default=str)), sort_keys=True)

    def config_hash(self) -> str:
        return hashlib.sha1(json.dumps(self.resolved, sort_keys=True, default=str).encode()).hexdigest()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, JobConfig) and self.resolved == other.resolved


def load_config(path: str | Path) -> JobConfig:
    import yaml

    return JobConfig(yaml.safe_load(Path(path).read_text()))
