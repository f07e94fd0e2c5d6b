"""LAS point clouds: a Spark data source that reads record ranges in parallel, and a writer for small files.

Files of versions 1.0 to 1.4, point formats 0 to 10; compressed ones (LAZ) where the optional module ``lazrs`` is installed.
Partitions are ranges of ``records_per_partition`` records; a task seeks to its range and yields Arrow batches. Paths are those of a folder
that all machines mount, or URIs that Arrow's file systems open.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from groundswell.sources import files

# Fixed values of the format: where fields are in the header and in a record.
SIGNATURE = b"LASF"
CLASS_AT = {True: 16, False: 15}  # formats 6 and up; below, the low five bits
LEGACY_CLASS_MASK = 31


@dataclass(frozen=True)
class Header:
    version: tuple[int, int]
    offset: int
    kind: int
    length: int
    count: int
    scale: tuple[float, float, float]
    shift: tuple[float, float, float]
    compressed: bool
    crs_wkt: str
    laszip: bytes = b""


def header(path: str) -> Header:
    raw = files.read(path, 0, 375)
    if raw[:4] != SIGNATURE:
        raise ValueError(f"{path} is not a LAS file")
    version = raw[24], raw[25]
    size, offset, number_of = struct.unpack("<HII", raw[94:104])
    kind, length, count = struct.unpack("<BHI", raw[104:111])
    numbers = struct.unpack("<6d", raw[131:179])
    if version >= (1, 4) and len(raw) >= 255:
        count = struct.unpack("<Q", raw[247:255])[0] or count
    wkt, laszip, at = "", b"", 0
    more = files.read(path, size, max(0, offset - size))
    for _ in range(number_of):
        own = more[at : at + 54]
        if len(own) < 54:
            break
        user, number, n = own[2:18].rstrip(b"\0"), *struct.unpack("<HH", own[18:22])
        body = more[at + 54 : at + 54 + n]
        at += 54 + n
        if user == b"LASF_Projection" and number == 2112:
            wkt = body.rstrip(b"\0").decode(errors="replace")
        if user == b"laszip encoded" and number == 22204:
            laszip = body
    return Header(version, offset, kind & 63, length, count, numbers[:3], numbers[3:], bool(kind & 192), wkt, laszip)


def _decompressed(path: str, head: Header, first: int, count: int) -> bytes:
    try:
        import lazrs
    except ImportError as gone:
        raise ValueError(f"{path} is compressed: reading LAZ needs the module lazrs") from gone
    system, own = files.opened(path)
    with system.open_input_file(own) as f:
        f.seek(head.offset)
        reader = lazrs.LasZipDecompressor(f, head.laszip)
        reader.seek(first)
        raw = bytearray(count * head.length)
        reader.decompress_many(raw)
    return bytes(raw)


def records(path: str, head: Header, first: int, count: int) -> dict[str, np.ndarray]:
    count = max(0, min(count, head.count - first))
    made = _decompressed(path, head, first, count) if head.compressed else files.read(path, head.offset + first * head.length, count * head.length)
    raw = np.frombuffer(made, np.uint8)
    rows = raw[: len(raw) // head.length * head.length].reshape(-1, head.length)
    xyz = np.ascontiguousarray(rows[:, :12]).view("<i4")
    codes = rows[:, CLASS_AT[head.kind >= 6]]
    codes = codes if head.kind >= 6 else codes & LEGACY_CLASS_MASK
    return {c: xyz[:, k] * head.scale[k] + head.shift[k] for k, c in enumerate("xyz")} | {"classification": codes.astype(np.int32)}


def write(path: str, x: np.ndarray, y: np.ndarray, z: np.ndarray, classification: np.ndarray, scale: float = 0.001, crs_wkt: str = "") -> None:
    """A version 1.4 file of point format 6."""
    wkt = crs_wkt.encode() + b"\0" if crs_wkt else b""
    vlr = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(wkt), b"") + wkt if wkt else b""
    shift = [float(np.min(v)) if len(v) else 0.0 for v in (x, y, z)]
    ends = [f(v) if len(v) else 0.0 for v in (x, y, z) for f in (np.max, np.min)]
    head = bytearray(375)
    head[:4], head[24:26], head[6] = SIGNATURE, bytes((1, 4)), 16
    struct.pack_into("<HIIBH", head, 94, 375, 375 + len(vlr), int(bool(wkt)), 6, 30)
    struct.pack_into("<12d", head, 131, scale, scale, scale, *shift, *ends)
    struct.pack_into("<Q", head, 247, len(x))
    body = np.zeros((len(x), 30), np.uint8)
    whole = np.stack([np.round((v - s) / scale) for v, s in zip((x, y, z), shift)], axis=1).astype("<i4") if len(x) else np.zeros((0, 3), "<i4")
    body[:, :12] = np.ascontiguousarray(whole).view(np.uint8).reshape(-1, 12)
    body[:, 16] = classification
    with open(path, "wb") as f:
        f.write(bytes(head) + vlr + body.tobytes())


class _Range(InputPartition):
    def __init__(self, path: str, head: Header, first: int, count: int, id_base: int):
        self.path, self.head, self.first, self.count, self.id_base = path, head, first, count, id_base


class LasSource(DataSource):
    """``spark.dataSource.register(LasSource)``, then ``spark.read.format("las").load(path)``; the path may be a folder or a pattern."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return "point_id long, x double, y double, z double, classification int"

    def reader(self, schema) -> DataSourceReader:
        return LasReader(self.options)


class LasReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("records_per_partition", 1_000_000))

    def partitions(self) -> list[_Range]:
        clouds = files.found(self.path, "*.la[sz]")
        if not clouds:
            raise FileNotFoundError(self.path)
        out, base = [], 0
        for f in clouds:
            head = header(f)
            out += [_Range(f, head, k, min(self.size, head.count - k), base) for k in range(0, head.count, self.size)]
            base += head.count
        return out

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        yield from batches(part.path, part.head, part.first, part.count, part.id_base)


def batches(path: str, head: Header, first: int, count: int, id_base: int) -> Iterator[pa.RecordBatch]:
    """Points of a range of records; ids count on from ``id_base``."""
    for k in range(first, first + count, 100_000):
        n = min(100_000, first + count - k)
        cols = records(path, head, k, n)
        ids = np.arange(id_base + k, id_base + k + len(cols["x"]))
        yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(cols[c]) for c in ("x", "y", "z", "classification"))], names=["point_id", "x", "y", "z", "classification"])
