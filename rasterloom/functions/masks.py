"""Validity masks: a Column that is true where an observation may be used. Masked values become NULL, never rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scene-classification codes and quality bits that a profile masks.
CLASS_ALWAYS = (0, 1, 8, 9, 10)
CLASS_SHADOW = 3
CLASS_SNOW = 11
BITS_ALWAYS = (0, 1, 2, 3)
BIT_SHADOW = 4
BIT_SNOW = 5


def bad_classes(shadow: bool = True, snow: bool = False) -> list[int]:
    return sorted({*CLASS_ALWAYS, *([CLASS_SHADOW] if shadow else []), *([CLASS_SNOW] if snow else [])})


def bad_bits(shadow: bool = True, snow: bool = False) -> int:
    return sum(1 << b for b in (*BITS_ALWAYS, *([BIT_SHADOW] if shadow else []), *([BIT_SNOW] if snow else [])))


def by_class(code: Column, shadow: bool = True, snow: bool = False) -> Column:
    return F.coalesce(~code.isin(bad_classes(shadow, snow)), F.lit(False))


def by_bits(quality: Column, shadow: bool = True, snow: bool = False) -> Column:
    return F.coalesce(quality.bitwiseAND(F.lit(bad_bits(shadow, snow))) == 0, F.lit(False))


#: Profile name: quality band, function of its column.
PROFILES: dict[str, tuple[str, Callable[..., Column]]] = {
    "s2_scl_mask": ("SCL", by_class),
    "landsat_qa_mask": ("QA_PIXEL", by_bits),
}


def profile(name: str) -> tuple[str, Callable[..., Column]]:
    try:
        return PROFILES[name]
    except KeyError:
        raise KeyError(f"no mask profile {name!r}; there are {', '.join(sorted(PROFILES))}") from None


def resolve(enabled: bool, wanted: str, of_dataset: str | None) -> str | None:
    """The profile to apply, if any: none when masking is off or the dataset has none; `auto` is the dataset's own."""
    if not enabled or not of_dataset:
        return None
    return of_dataset if wanted == "auto" else wanted


def apply_mask(df: DataFrame, valid: Column, bands: list[str]) -> DataFrame:
    """NULL in every band where `valid` isn't true; rows stay, so a wholly masked scene still counts as a scene."""
    return df.withColumns({b: F.when(valid, F.col(b)) for b in bands})


def validity(column: Column) -> Column:
    return F.when(column.isNotNull() & ~F.isnan(column.cast("double")), 1).otherwise(0)
