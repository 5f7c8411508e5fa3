"""Band projection: select, scale, indices, order, rename."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import indices as ix


def scaled(df: DataFrame, bands: Sequence[str], scale: float | None, offset: float | None) -> DataFrame:
    """band * scale + offset; identities are left out of the plan."""
    by, plus = scale not in (None, 1.0), bool(offset)
    if not by and not plus:
        return df
    out = {}
    for b in bands:
        c = F.col(b) * F.lit(float(scale)) if by else F.col(b)
        out[b] = c + F.lit(float(offset)) if plus else c
    return df.withColumns(out)


def band_order(base: Sequence[str], entries: Sequence[Mapping]) -> list[str]:
    """Output order. entries: `names` (the outputs of an index) and `position`: after_bands, before_bands, or where to insert."""
    out, inserted = list(base), 0
    for e in entries:
        at, names = e.get("position", "after_bands"), list(e["names"])
        if at == "after_bands":
            out += names
        elif at == "before_bands":
            out[:0] = names
        elif isinstance(at, int) and not isinstance(at, bool):
            out[at + inserted : at + inserted] = names
            inserted += len(names)
        else:
            raise ValueError(f"no index position {at!r}")
    return out


def project(df: DataFrame, spec, select: Sequence[str] | None = None, order: Sequence[str] | None = None, rename: Mapping[str, str] | None = None, indices: Sequence[Mapping] = (), scale: float | None = None, offset: float | None = None, keys: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """select -> scale -> indices -> order -> rename; returns the bands' final names, too.

    select: None is the dataset's bands, an empty list none of them (indices only). Bands that only indices read are
    scaled as well and dropped at the end. scale and offset: None is the dataset's own, an explicit 0.0 is kept.
    """
    selected = spec.band_names() if select is None else list(select)
    names = [e["name"] for e in indices]
    read = [b for n in names for b in ix.input_bands(n, spec.slug) if b in df.columns]
    wanted = list(dict.fromkeys([*selected, *read]))
    df = df.select(*keys, *wanted)
    df = scaled(df, [b for b in wanted if spec.bands[b].scaled], spec.scale_factor if scale is None else scale, spec.offset if offset is None else offset)
    df = ix.apply_indices(df, names, spec.slug)
    entries = []
    for e in indices:
        made, name = ix.get(e["name"], spec.slug).outputs, e.get("output_band") or e["name"]
        new = [name + x.removeprefix(e["name"]) for x in made]
        df = df.withColumnsRenamed({a: b for a, b in zip(made, new) if a != b})
        entries.append({"names": new, "position": e.get("position", "after_bands")})
    final = band_order(order if order is not None else selected, entries)
    out = [(rename or {}).get(b, b) for b in final]
    return df.select(*keys, *[F.col(a).alias(b) for a, b in zip(final, out)]), out
