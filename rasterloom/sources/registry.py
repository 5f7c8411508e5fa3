"""Datasets: their bands, scaling, masks and filters."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Band:
    name: str
    res: int
    scaled: bool = True
    internal: bool = False


@dataclass(frozen=True)
class Dataset:
    slug: str
    collection: str
    bands: dict[str, Band]
    native_res: int
    cloud_mask: str | None = None
    scale_factor: float | None = None
    offset: float = 0.0
    slc_off_date: date | None = None
    slc_off_coverage_loss: float | None = None
    extra_filters: tuple[tuple[str, str], ...] = ()
    composite_strategy_override: str | None = None
    date_property: str = field(default="system:time_start")

    def band_names(self, internal: bool = False) -> list[str]:
        return [b.name for b in self.bands.values() if internal or not b.internal]


KNOWN = Path(__file__).with_name("datasets.yaml")
_REQUIRED = {"collection", "native_res", "bands"}
_OPTIONAL = {"cloud_mask", "scale_factor", "offset", "slc_off_date", "slc_off_coverage_loss", "composite_strategy_override", "date_property"}
_registered: dict[str, Dataset] = {}


def load(path: str | Path) -> dict[str, Dataset]:
    """Datasets of a YAML file: by name collection, native_res, bands and code_bands (resolution by band), filters and further settings."""
    import yaml

    out = {}
    for slug, given in (yaml.safe_load(Path(path).read_text()) or {}).items():
        if missing := _REQUIRED - set(given):
            raise ValueError(f"dataset {slug} lacks {', '.join(sorted(missing))}")
        if odd := set(given) - _REQUIRED - _OPTIONAL - {"code_bands", "filters"}:
            raise ValueError(f"dataset {slug} has no setting {', '.join(sorted(odd))}")
        bands = {b: Band(b, int(res)) for b, res in given["bands"].items()}
        bands |= {b: Band(b, int(res), scaled=False, internal=True) for b, res in (given.get("code_bands") or {}).items()}
        filters = tuple((k, str(v)) for k, v in (given.get("filters") or {}).items())
        out[slug] = Dataset(slug, given["collection"], bands, int(given["native_res"]), extra_filters=filters, **{k: given[k] for k in _OPTIONAL & set(given)})
    return out


def register(path: str | Path) -> list[str]:
    """Add a file's datasets to the known ones, or put them in their places."""
    found = load(path)
    _registered.update(found)
    return sorted(found)


@lru_cache(maxsize=1)
def _known() -> dict[str, Dataset]:
    return load(KNOWN)


def datasets() -> dict[str, Dataset]:
    return _known() | _registered


def get(slug: str) -> Dataset:
    if slug not in datasets():
        raise KeyError(f"no dataset {slug!r}; there are {', '.join(list_slugs())}")
    return datasets()[slug]


def list_slugs() -> list[str]:
    return sorted(datasets())


def registry_df(spark: SparkSession) -> DataFrame:
    """One row per dataset and band."""
    rows = [(d.slug, d.collection, d.native_res, b.name, b.res, b.scaled, b.internal, d.cloud_mask, d.scale_factor, d.offset, d.composite_strategy_override) for d in datasets().values() for b in d.bands.values()]
    return spark.createDataFrame(rows, "slug string, collection string, native_res int, band string, res int, scaled boolean, internal boolean, cloud_mask string, scale_factor double, offset double, override string")
