"""Spectral indices as Column expressions, and the registry that plug-ins extend.

An index takes the columns of a dataset's bands, by their common names, and returns a dict of output columns: most give
one, named like the index; composites give several, named `<index>_<suffix>`. A zero denominator gives NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which band of each dataset is near infrared, red, green, blue, short-wave infrared 1 and 2.
BANDS: dict[str, dict[str, str]] = {
    "sentinel-2": {"nir": "B8", "red": "B4", "green": "B3", "blue": "B2", "swir1": "B11", "swir2": "B12"},
    "landsat-7": {"nir": "SR_B4", "red": "SR_B3", "green": "SR_B2", "blue": "SR_B1", "swir1": "SR_B5", "swir2": "SR_B7"},
    "landsat-8": {"nir": "SR_B5", "red": "SR_B4", "green": "SR_B3", "blue": "SR_B2", "swir1": "SR_B6", "swir2": "SR_B7"},
    "landsat-9": {"nir": "SR_B5", "red": "SR_B4", "green": "SR_B3", "blue": "SR_B2", "swir1": "SR_B6", "swir2": "SR_B7"},
    "sentinel-1": {"vv": "VV", "vh": "VH"},
    "sentinel-1-rtc": {"vv": "VV", "vh": "VH"},
}
OPTICAL = ("sentinel-2", "landsat-7", "landsat-8", "landsat-9")
WITH_BLUE = ("sentinel-2", "landsat-8", "landsat-9")

Formula = Callable[[Mapping[str, Column]], "Column | dict[str, Column]"]


@dataclass(frozen=True)
class Index:
    name: str
    formula: Formula
    inputs: tuple[str, ...]
    datasets: tuple[str, ...] | None  # None: any
    suffixes: tuple[str, ...] = ()

    @property
    def outputs(self) -> list[str]:
        return [f"{self.name}_{s}" for s in self.suffixes] or [self.name]


REGISTRY: dict[str, Index] = {}


def index(name: str, inputs: str, datasets: tuple[str, ...] | None = None, suffixes: str = "") -> Callable[[Formula], Formula]:
    def add(formula: Formula) -> Formula:
        if name in REGISTRY:
            raise ValueError(f"there is an index {name!r} already")
        REGISTRY[name] = Index(name, formula, tuple(inputs.split()), datasets, tuple(suffixes.split()))
        return formula

    return add


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def nd(a: Column, b: Column) -> Column:
    return ratio(a - b, a + b)


for _name, _a, _b in (("NDVI", "nir", "red"), ("NDWI", "green", "nir"), ("NDMI", "nir", "swir1"), ("NBR", "nir", "swir2"), ("NDSI", "green", "swir1")):
    index(_name, f"{_a} {_b}", OPTICAL)(lambda x, a=_a, b=_b: nd(x[a], x[b]))
index("EVI", "nir red blue", WITH_BLUE)(lambda x: 2.5 * ratio(x["nir"] - x["red"], x["nir"] + 6 * x["red"] - 7.5 * x["blue"] + 1))
index("SAVI", "nir red", OPTICAL)(lambda x, soil=0.5: ratio(x["nir"] - x["red"], x["nir"] + x["red"] + soil) * (1 + soil))
index("OSI", "green red blue", ("sentinel-2",))(lambda x: ratio(x["green"] + x["red"], x["blue"]))
index("BSI", "swir1 red nir blue", WITH_BLUE)(lambda x: nd(x["swir1"] + x["red"], x["nir"] + x["blue"]))
index("RVI", "vv vh", ("sentinel-1",))(lambda x: ratio(4 * x["vh"], x["vv"] + x["vh"]))
index("VV_VH_RATIO", "vv vh", ("sentinel-1",))(lambda x: x["vv"] - x["vh"])
index("WATER_S1", "vv vh", ("sentinel-1-rtc",))(lambda x: ((x["vv"] < 0.02) & (x["vh"] < 0.0063)).cast("int"))
index("RGB_RATIO", "vv vh", ("sentinel-1-rtc",), "R G B")(lambda x: {"R": x["vv"], "G": x["vh"], "B": ratio(x["vh"], x["vv"])})
index("SAR_URBAN", "vv vh", ("sentinel-1-rtc",), "R G B")(lambda x: {"R": x["vv"], "G": 2 * x["vh"], "B": ratio(x["vv"], x["vh"]) / 100})


def supports(name: str, dataset: str) -> bool:
    return name in REGISTRY and (REGISTRY[name].datasets is None or dataset in REGISTRY[name].datasets)


def list_indices(dataset: str | None = None) -> list[str]:
    return sorted(n for n in REGISTRY if dataset is None or supports(n, dataset))


def get(name: str, dataset: str) -> Index:
    if name not in REGISTRY:
        raise ValueError(f"no index {name!r}; there are {', '.join(list_indices())}")
    if not supports(name, dataset):
        raise ValueError(f"index {name!r} isn't defined for {dataset!r}")
    return REGISTRY[name]


def input_bands(name: str, dataset: str) -> list[str]:
    """The dataset's bands that an index reads; inputs without a common name are bands themselves."""
    return [BANDS.get(dataset, {}).get(x, x) for x in get(name, dataset).inputs]


def apply_indices(df: DataFrame, names: list[str], dataset: str) -> DataFrame:
    """Add the indices in order; later ones may read earlier ones' output."""
    for name in names:
        got = get(name, dataset)
        out = got.formula({x: F.col(b) for x, b in zip(got.inputs, input_bands(name, dataset))})
        df = df.withColumns({f"{name}_{k}": c for k, c in out.items()} if isinstance(out, dict) else {name: out})
    return df
