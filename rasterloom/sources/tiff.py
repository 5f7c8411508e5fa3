"""A GeoTIFF writer and reader by the published TIFF 6 and GeoTIFF layouts: tiled, pixel-interleaved, with overviews."""

from __future__ import annotations

import os
import struct
import zlib
from pathlib import Path

import numpy as np

BLOCK, FACTORS = 256, (2, 4, 8)
CODES = {"none": 1, "LZW": 5, "DEFLATE": 8, "ZSTD": 50000}
TYPES = {"float32": ("<f4", 3), "int16": ("<i2", 2), "uint16": ("<u2", 1)}


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, one step early."""
    out, acc, bits = bytearray(), 0, 0
    table, width = {bytes([i]): i for i in range(256)}, 9

    def put(code: int) -> None:
        nonlocal acc, bits
        acc, bits = (acc << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((acc >> bits) & 255)
        acc &= (1 << bits) - 1

    put(256)
    nxt, word = 258, b""
    for b in data:
        more = word + bytes([b])
        if more in table:
            word = more
            continue
        put(table[word])
        table[more] = nxt
        nxt += 1
        if nxt == 4095:
            put(256)
            table, nxt, width = {bytes([i]): i for i in range(256)}, 258, 9
        elif nxt == 1 << width:
            width += 1
        word = bytes([b])
    if word:
        put(table[word])
        nxt += 1
        if nxt == (1 << width) and width < 12:
            width += 1
    put(257)
    if bits:
        out.append((acc << (8 - bits)) & 255)
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    out, acc, bits, width, at = bytearray(), 0, 0, 9, 0
    table: list[bytes] = []
    last = None
    while True:
        while bits < width and at < len(data):
            acc, bits, at = (acc << 8) | data[at], bits + 8, at + 1
        if bits < width:
            return bytes(out)
        bits -= width
        code, acc = acc >> bits, acc & ((1 << bits) - 1)
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last is not None:
            table.append(last + word[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        last = word


def pack(data: bytes, compression: str) -> bytes:
    if compression == "ZSTD":
        import zstandard

        return zstandard.ZstdCompressor(level=9).compress(data)
    return {"none": lambda x: x, "LZW": lzw, "DEFLATE": lambda x: zlib.compress(x, 6)}[compression](data)


def unpack(data: bytes, code: int) -> bytes:
    if code == 50000:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data)
    return {1: lambda x: x, 5: unlzw, 8: zlib.decompress}[code](data)


def halve(array: np.ndarray, factor: int, nodata: float) -> np.ndarray:
    """Average of the valid pixels of each square."""
    n, h, w = array.shape
    hh, ww = -(-h // factor), -(-w // factor)
    wide = np.full((n, hh * factor, ww * factor), np.nan)
    wide[:, :h, :w] = np.where(array == nodata, np.nan, array)
    cells = wide.reshape(n, hh, factor, ww, factor)
    seen = (~np.isnan(cells)).sum(axis=(2, 4))
    mean = np.where(seen > 0, np.nansum(cells, axis=(2, 4)) / np.maximum(seen, 1), nodata)
    return mean if array.dtype.kind == "f" else np.round(mean)


def write_geotiff(path: str | Path, array: np.ndarray, affine: tuple[float, ...], epsg: int, band_names: list[str], dtype: str = "float32", nodata: float = -9999.0, compression: str = "LZW", overviews: bool = True) -> Path:
    """array (bands, height, width), north up. The file appears under its name only when it is whole."""
    path = Path(path)
    if array.ndim != 3 or array.shape[0] != len(band_names):
        raise ValueError(f"{len(band_names)} band names for an array of shape {array.shape}")
    kind, sample = TYPES[dtype]
    fill = np.where(np.isfinite(array), array, nodata)
    if sample != 3:
        info = np.iinfo(kind)
        if fill.min(initial=0) < info.min or fill.max(initial=0) > info.max:
            raise ValueError(f"values out of {dtype}")
    main = fill.astype(kind)
    levels = [main] + ([halve(main, f, nodata).astype(kind) for f in FACTORS if min(main.shape[1:]) >= 2 * f] if overviews else [])
    path.parent.mkdir(parents=True, exist_ok=True)
    tmp = path.with_name(path.name + ".tmp")
    tmp.write_bytes(_encode(levels, affine, epsg, band_names, sample, nodata, compression))
    try:
        os.replace(tmp, path)
    except OSError:
        tmp.unlink(missing_ok=True)
        raise
    return path


def _encode(levels: list[np.ndarray], affine, epsg: int, names: list[str], sample: int, nodata: float, compression: str) -> bytes:
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for level, a in enumerate(levels):
        n, h, w = a.shape
        offsets, sizes = [], []
        for y in range(0, h, BLOCK):
            for x in range(0, w, BLOCK):
                tile = np.full((BLOCK, BLOCK, n), nodata).astype(a.dtype)
                part = a[:, y : y + BLOCK, x : x + BLOCK]
                tile[: part.shape[1], : part.shape[2]] = part.transpose(1, 2, 0)
                data = pack(tile.tobytes(), compression)
                offsets.append(len(out))
                sizes.append(len(data))
                out += data + b"\0" * (len(data) & 1)
        tags: list[tuple[int, str, list]] = [
            (254, "I", [1 if level else 0]), (256, "I", [w]), (257, "I", [h]), (258, "H", [8 * a.dtype.itemsize] * n), (259, "H", [CODES[compression]]), (262, "H", [1]), (277, "H", [n]), (284, "H", [1]),
            (322, "H", [BLOCK]), (323, "H", [BLOCK]), (324, "I", offsets), (325, "I", sizes), (339, "H", [sample] * n), (42113, "s", [f"{nodata:g}"]),
        ]
        if n > 1:
            tags.append((338, "H", [0] * (n - 1)))
        if not level:
            geographic = epsg == 4326
            items = "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{x}</Item>' for i, x in enumerate(names))
            tags += [
                (33550, "d", [affine[0], -affine[4], 0.0]), (33922, "d", [0.0, 0.0, 0.0, affine[2], affine[5], 0.0]),
                (34735, "H", [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg]),
                (42112, "s", [f"<GDALMetadata>{items}</GDALMetadata>"]),
            ]
        link = _directory(out, sorted(tags), link)
    return bytes(out)


def _directory(out: bytearray, tags: list[tuple[int, str, list]], link: int) -> int:
    entries = []
    for tag, kind, values in tags:
        raw = (values[0].encode() + b"\0") if kind == "s" else struct.pack(f"<{len(values)}{kind}", *values)
        code, count = {"s": 2, "H": 3, "I": 4, "d": 12}[kind], len(raw) if kind == "s" else len(values)
        if len(raw) > 4:
            at = len(out)
            out += raw + b"\0" * (len(raw) & 1)
            raw = struct.pack("<I", at)
        entries.append(struct.pack("<HHI", tag, code, count) + raw.ljust(4, b"\0"))
    struct.pack_into("<I", out, link, len(out))
    out += struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0"
    return len(out) - 4


def read_geotiff(path: str | Path) -> dict:
    return parse_geotiff(Path(path).read_bytes())


def parse_geotiff(raw: bytes) -> dict:
    """array, affine, epsg, band_names, nodata, and the overviews' arrays of a file that write_geotiff wrote."""
    import re

    at = struct.unpack_from("<I", raw, 4)[0]
    levels, first = [], None
    while at:
        tags = {}
        for i in range(struct.unpack_from("<H", raw, at)[0]):
            tag, code, count = struct.unpack_from("<HHI", raw, at + 2 + 12 * i)
            kind = {2: "s", 3: "H", 4: "I", 12: "d"}[code]
            size = struct.calcsize("<" + kind) * count
            place = at + 10 + 12 * i if size <= 4 else struct.unpack_from("<I", raw, at + 10 + 12 * i)[0]
            tags[tag] = raw[place : place + count - 1].decode() if kind == "s" else struct.unpack_from(f"<{count}{kind}", raw, place)
        w, h, n = tags[256][0], tags[257][0], tags[277][0]
        kind = {3: "<f4", 2: "<i2", 1: "<u2"}[tags[339][0]]
        a = np.zeros((n, -(-h // BLOCK) * BLOCK, -(-w // BLOCK) * BLOCK), kind)
        for i, (o, s) in enumerate(zip(tags[324], tags[325])):
            y, x = (i // -(-w // BLOCK)) * BLOCK, (i % -(-w // BLOCK)) * BLOCK
            a[:, y : y + BLOCK, x : x + BLOCK] = np.frombuffer(unpack(raw[o : o + s], tags[259][0]), kind).reshape(BLOCK, BLOCK, n).transpose(2, 0, 1)
        levels.append(a[:, :h, :w])
        first = first or tags
        at = struct.unpack_from("<I", raw, at + 2 + 12 * struct.unpack_from("<H", raw, at)[0])[0]
    scale, tie = first[33550], first[33922]
    return {"array": levels[0], "overviews": levels[1:], "affine": (scale[0], 0.0, tie[3], 0.0, -scale[1], tie[4]), "epsg": first[34735][-1], "nodata": float(first[42113]), "band_names": re.findall(r'role="description">(.*?)</Item>', first[42112])}


def crop(array: np.ndarray, affine: tuple[float, ...], overlap: int) -> tuple[np.ndarray, tuple[float, ...]]:
    """Without the overlap on all sides, the origin moved along."""
    if not overlap:
        return array, affine
    a, b, c, d, e, f = affine
    return array[:, overlap:-overlap, overlap:-overlap], (a, b, c + overlap * a, d, e, f + overlap * e)


def mask_outside(array: np.ndarray, affine: tuple[float, ...], polys, nodata: float) -> np.ndarray:
    """Pixels whose centre is outside the polygons become nodata."""
    from rasterloom.functions.geometry import contains

    _, h, w = array.shape
    x, y = np.meshgrid(affine[2] + (np.arange(w) + 0.5) * affine[0], affine[5] + (np.arange(h) + 0.5) * affine[4])
    inside = np.any([contains(p, x.ravel(), y.ravel()) for p in polys], axis=0).reshape(h, w)
    return np.where(inside, array, nodata)
