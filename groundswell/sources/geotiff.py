"""A small codec for GeoTIFF in strips: any number of bands, georeference, nodata, band names.

Files are written uncompressed, as a head and float32 strips that may be made apart. Read are uncompressed and deflated strips, by
ranges: the directory first, then only the strips of the rows asked for.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from groundswell.model import GridSpec

# Fixed values of the format: tag numbers and type sizes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 339
SCALE, TIEPOINT, GEO_KEYS, GEO_ASCII, METADATA, NODATA = 33550, 33922, 34735, 34737, 42112, 42113
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
LETTERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


STRIP_ROWS = 64
DEFLATE = (8, 32946)


def head(bands: int, grid: GridSpec, band_names: list[str] | None = None, rows_per_strip: int = STRIP_ROWS) -> bytes:
    """All of a little-endian file before its strips, which follow in the order of bands, then rows."""
    height, width = grid.height, grid.width
    rows = [min(rows_per_strip, height - r) for r in range(0, height, rows_per_strip)]
    sizes = [n * width * 4 for n in rows] * bands
    names = "".join(f'<Item name="DESCRIPTION" sample="{k}" role="description">{n}</Item>' for k, n in enumerate(band_names or []))
    wkt = grid.crs_wkt + "|"
    fields: list[tuple[int, int, tuple | bytes]] = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (32,) * bands), (COMPRESSION, 3, (1,)), (PHOTOMETRIC, 3, (1,)), (OFFSETS, 4, (0,) * len(sizes)),
        (SAMPLES, 3, (bands,)), (ROWS, 4, (rows_per_strip,)), (COUNTS, 4, tuple(sizes)), (PLANAR, 3, (2,)), (FORMAT, 3, (3,) * bands),
        (SCALE, 12, (float(grid.res), float(grid.res), 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, float(grid.x_min), float(grid.y_max), 0.0)),
        (GEO_KEYS, 3, (1, 1, 0, 1, 1026, GEO_ASCII, len(wkt.encode()), 0)), (GEO_ASCII, 2, wkt.encode() + b"\0"),
        *([(METADATA, 2, f"<GDALMetadata>{names}</GDALMetadata>".encode() + b"\0")] if names else []), (NODATA, 2, repr(float(grid.nodata)).encode() + b"\0"),
    ]
    start = 8 + 2 + 12 * len(fields) + 4
    packed = [v if isinstance(v, bytes) else struct.pack(f"<{len(v)}{LETTERS[t]}", *v) for _, t, v in fields]
    at = start + sum(len(p) + len(p) % 2 for p in packed if len(p) > 4)
    if at + sum(sizes) >= 1 << 32:
        raise ValueError("a raster of 4 GB or more: write Parquet, or a mosaic")
    offsets = (at + np.cumsum([0, *sizes[:-1]])).tolist() if sizes else []
    packed[[f[0] for f in fields].index(OFFSETS)] = struct.pack(f"<{len(offsets)}I", *offsets)
    out, extra, at = [struct.pack("<2sHIH", b"II", 42, 8, len(fields))], [], start
    for (tag, kind, value), p in zip(fields, packed):
        out.append(struct.pack("<HHI", tag, kind, len(value)))
        if len(p) <= 4:
            out.append(p.ljust(4, b"\0"))
        else:
            out.append(struct.pack("<I", at))
            p += b"\0" * (len(p) % 2)
            extra.append(p)
            at += len(p)
    return b"".join([*out, b"\0" * 4, *extra])


def encode(data: np.ndarray, grid: GridSpec, band_names: list[str] | None = None, rows_per_strip: int = STRIP_ROWS) -> bytes:
    """(bands, height, width) as a file."""
    data = np.asarray(data, "<f4")
    strips = [data[b, r : r + rows_per_strip].tobytes() for b in range(len(data)) for r in range(0, data.shape[1], rows_per_strip)]
    return b"".join([head(len(data), grid, band_names, rows_per_strip), *strips])


@dataclass(frozen=True)
class Directory:
    """What a file says about its raster, and where its strips are."""

    grid: GridSpec
    names: list[str]
    bands: int
    kind: str  # numpy's
    planar: bool
    deflated: bool
    predictor: int
    rows_per_strip: int
    offsets: tuple[int, ...]
    counts: tuple[int, ...]


def directory(read: Callable[[int, int], bytes]) -> Directory:
    """From ranges of the file: ``read(offset, size)``."""
    first = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(first[:2])
    if order is None or struct.unpack(f"{order}H", first[2:4])[0] != 42:
        raise ValueError("not a classic TIFF file")
    at = struct.unpack(f"{order}I", first[4:8])[0]
    entries = read(at + 2, 12 * struct.unpack(f"{order}H", read(at, 2))[0])
    tags: dict[int, tuple | bytes] = {}
    for k in range(0, len(entries), 12):
        tag, kind, count = struct.unpack(f"{order}HHI", entries[k : k + 8])
        size = SIZES.get(kind, 1) * count
        value = entries[k + 8 : k + 8 + size] if size <= 4 else read(struct.unpack(f"{order}I", entries[k + 8 : k + 12])[0], size)
        tags[tag] = value.rstrip(b"\0") if kind == 2 else struct.unpack(f"{order}{count}{LETTERS[kind]}", value) if kind in LETTERS else value
    one = lambda tag, default: tags.get(tag, (default,))[0]
    if one(COMPRESSION, 1) not in (1, *DEFLATE) or OFFSETS not in tags or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError("only strips are read, uncompressed or deflated")
    width, height, bands = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1)
    scale, tie = tags.get(SCALE, (1.0, 1.0, 0.0)), tags.get(TIEPOINT, (0.0,) * 6)
    x_min, y_max = tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]
    wkt = tags.get(GEO_ASCII, b"").decode().rstrip("|")
    names = [p.split(">", 1)[1].split("<", 1)[0] for p in tags.get(METADATA, b"").decode().split("<Item")[1:]]
    # A file without a nodata tag has 0.
    grid = GridSpec(x_min, y_max - height * scale[1], scale[0], width, height, wkt, float(tags.get(NODATA, b"0") or 0))
    kind = f"{order}{({3: 'f', 1: 'u', 2: 'i'})[one(FORMAT, 1)]}{tags[BITS][0] // 8}"
    return Directory(grid, names, bands, kind, one(PLANAR, 1) == 2, one(COMPRESSION, 1) in DEFLATE, one(PREDICTOR, 1), min(height, one(ROWS, height)), tags[OFFSETS], tags[COUNTS])


def strip(about: Directory, number: int, read: Callable[[int, int], bytes]) -> np.ndarray:
    """(bands, rows, width) float32 of the strip that begins at row ``number`` * rows_per_strip."""
    rows = min(about.rows_per_strip, about.grid.height - number * about.rows_per_strip)
    shape = (rows, about.grid.width) if about.planar else (rows, about.grid.width, about.bands)
    strips = -(-about.grid.height // about.rows_per_strip)
    parts = []
    for k in [number + b * strips for b in range(about.bands)] if about.planar else [number]:
        raw = read(about.offsets[k], about.counts[k])
        part = np.frombuffer(zlib.decompress(raw) if about.deflated else raw, about.kind, count=math.prod(shape)).reshape(shape)
        parts.append(np.cumsum(part, axis=1, dtype=part.dtype) if about.predictor == 2 else part)
    return (np.stack(parts) if about.planar else parts[0].transpose(2, 0, 1)).astype(np.float32)


def decode(raw: bytes) -> tuple[np.ndarray, GridSpec, list[str]]:
    """(bands, height, width) float32, the grid and the band names of a whole file."""
    read = lambda offset, size: raw[offset : offset + size]
    about = directory(read)
    strips = range(-(-about.grid.height // about.rows_per_strip)) if about.grid.height else ()
    return np.concatenate([strip(about, k, read) for k in strips], axis=1), about.grid, about.names
